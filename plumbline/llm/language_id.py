"""Language identification by Bayesian evidence fusion.

log P(language | all) = log P(text | language) + log P(declared | language)
+ log P(address | language) + log P(language | host) + constant.

* text: naive Bayes over hashed byte trigrams, fitted to a bounded sample of labelled rows,
  tempered so that a long text isn't taken for independent trigrams;
* declared: what the markup (or a metadata column) declares, with a reliability table counted over all rows against the text's verdict;
* address: the language that the URL's suffix or first path part points to, with a table counted likewise;
* host: shares of languages on the host, smoothed towards its domain's, in turn smoothed towards all rows'.

The tables and shares are grouped aggregations of the text's posteriors over all rows; nothing but
tables of languages x declared values reaches the driver.

A row is rejected when nothing supports any language (no letter in the text), or when no language
reaches ``least`` of the posterior.  Defined results: null, empty and letterless texts are rejected with
lang null and posterior 0; unknown or missing declarations, addresses and hosts are evidence for nothing;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small, stash, utf8

BUCKETS, LABELLED, LEAST, TEMPER, SMOOTH = 1 << 16, 2_000, 0.7, 60.0, 8.0
_SKIP = np.ones(256, bool)  # bytes that aren't letters: between words all are one space
_SKIP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[_SKIP] = 32

SUFFIX = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "en": "en"}


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and word ends, and where each begins."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    low = _LOW[raw]
    keep = np.flatnonzero(~((low == 32) & (np.concatenate([[False], low[:-1] == 32]))))
    c = low[keep].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(16), keep[:-2]


def fit(rows: list[tuple[str, str]], languages: list[str]) -> np.ndarray:
    """(BUCKETS, languages) log-likelihoods of a trigram, with add-one smoothing."""
    counts = np.ones((BUCKETS, len(languages)))
    for lang, text in rows:
        counts[:, languages.index(lang)] += np.bincount(trigrams(text.encode())[0], minlength=BUCKETS)
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _likelihood(table: np.ndarray):
    """(n trigrams, tempered log-likelihoods) of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, size=1 << 19):
            texts = utf8(b.column("text"))
            data = b"\n".join(t or b"" for t in texts)
            h, at = trigrams(data)
            # row i's bytes start one later than in data: a space stands before
            cut = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]))
            s = table[h]
            n = np.diff(cut)
            some = np.flatnonzero(n > 0)
            total = np.zeros((len(texts), table.shape[1]))
            if len(some):
                total[some] = np.add.reduceat(s.astype(np.float64), cut[:-1][some], axis=0)
            letters = np.array([bool(t) and not _SKIP[np.frombuffer(t, np.uint8)].all() for t in texts])
            scaled = total * np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(letters), pa.array(list(scaled), pa.list_(pa.float64()))], names=[*rest, "letters", "ll"])

    return run


def address_language(url: Column) -> Column:
    """The language that a URL's first path part, else its host's suffix, points to; else null."""
    known = F.create_map(*[F.lit(x) for p in SUFFIX.items() for x in p])
    path, host = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1), F.regexp_extract(url, r"^[a-z]+://[^/:]*\.([a-z]{2})(?:[/:]|$)", 1)
    return F.coalesce(known[path], known[host])


def markup_language(html: Column) -> Column:
    """The lang attribute of <html>, its primary subtag in lower case; else null."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]*)$", 0)


def train(rows: DataFrame, lang: str = "lang", text: str = "text", most: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages and the trigram table from at most ``most`` labelled rows: those with the smallest hash of their text."""
    known = rows.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    thin = known.filter(F.pmod(F.xxhash64("t"), F.lit(max(1, known.count() // (4 * most)))) == 0).withColumn("k", F.xxhash64(F.lit(1), "t"))
    bound = thin.select("k").distinct().orderBy("k").limit(most).agg(F.max("k")).first()[0]
    got = [] if bound is None else [(r["l"], r["t"]) for r in thin.filter(F.col("k") <= bound).select("l", "t").distinct().limit(most).collect()]
    languages = sorted({x for x, _ in got})
    return languages, fit(got, languages)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], key: list[str], text: str = "text", declared: Column | None = None, address: Column | None = None, host: Column | None = None, least: float = LEAST) -> DataFrame:
    """``key`` columns, lang, posterior, text_lang, accepted of every row."""
    languages, table = model
    none = F.lit(None).cast("string")
    given = rows.select(*key, F.col(text).cast("string").alias("text"), (none if declared is None else declared).alias("declared"), (none if address is None else address).alias("address"), (none if host is None else host).alias("host"))
    if not languages:
        return given.select(*key, none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), F.lit(False).alias("accepted"))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "text")
    seen = stash(given.mapInArrow(_likelihood(table), f"{plain}, letters boolean, ll array<double>"))
    n = len(languages)

    def posterior(logs: Column) -> Column:
        raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))

    seen = seen.withColumn("p", F.when(F.col("letters"), posterior(F.col("ll"))).otherwise(F.array(*[F.lit(0.0)] * n)))
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)]
    whole = seen.agg(*sums).first()
    total = sum(x or 0.0 for x in whole)
    prior = [((x or 0.0) + 1.0) / (total + n) for x in whole]

    def reliability(column: str) -> Column:
        """log P(value | language), counted over all rows; other values than languages are one value, null is no evidence."""
        value = F.when(F.col(column).isin(languages), F.col(column)).when(F.col(column).isNotNull(), F.lit("other"))
        counted = {r["v"]: r for r in seen.withColumn("v", value).filter("v is not null").groupBy("v").agg(*sums).collect()}  # languages + 1 rows at most
        out = F.array(*[F.lit(0.0)] * n)
        for v, r in counted.items():
            logs = [float(np.log((r[f"c{i}"] + 0.5) / (sum(x[f"c{i}"] for x in counted.values()) + 0.5 * (n + 1)))) for i in range(n)]
            out = F.when(value == v, F.array(*map(F.lit, logs))).otherwise(out)
        return out

    hosts = seen.filter("host is not null").groupBy("host").agg(*sums).withColumn("domain", domain_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(n)])
    size = lambda c: sum((F.col(f"{c}{i}") for i in range(n)), F.lit(0.0))
    smooth = hosts.join(domains, "domain")
    share = [(F.col(f"d{i}") + SMOOTH * prior[i]) / (size("d") + SMOOTH) for i in range(n)]
    share = [(F.col(f"c{i}") + SMOOTH * share[i]) / (size("c") + SMOOTH) for i in range(n)]
    priors = stash(smooth.select("host", F.array(*[F.log(x) for x in share]).alias("hp")))
    fused = seen.withColumn("a", reliability("declared")).withColumn("b", reliability("address")).join(small(priors), "host", "left")
    flat = F.array(*[F.lit(float(np.log(x))) for x in prior])
    logs = F.array(*[F.col("ll")[i] + F.col("a")[i] + F.col("b")[i] + F.coalesce("hp", flat)[i] for i in range(n)])
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = fused.withColumn("q", posterior(logs))
    accepted = F.col("letters") & (F.array_max("q") >= least)
    return out.select(*key, F.when(F.col("letters"), best(F.col("q"))).alias("lang"), F.when(F.col("letters"), F.array_max("q")).otherwise(0.0).alias("posterior"), F.when(F.col("letters"), best(F.col("p"))).alias("text_lang"), accepted.alias("accepted"))


def identify_documents(docs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Documents: ``lang`` is what they declare, ``source`` is their host; they have no address."""
    rows = docs.select(*(key or ["doc_id"]), "text", "lang", "source")
    return identify(rows, train(rows), key or ["doc_id"], declared=F.col("lang"), host=F.col("source"))


def visible(html: Column) -> Column:
    """Text without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    return bare


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pages: markup, address and host of the page as evidence; the text model is fitted to ``labelled`` (text, lang)."""
    rows = pages.select("page_id", "url", "html", visible(F.col("html")).alias("text"))
    return identify(rows, train(labelled), ["page_id"], declared=markup_language(F.col("html")), address=address_language(F.col("url")), host=url_host(F.col("url")))
