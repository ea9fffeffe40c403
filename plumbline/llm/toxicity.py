"""Toxicity by lexicon induction (after SentProp: Hamilton et al., 2016).

Seed terms are those that labelled texts of one class hold far more often.  Words that
stand near each other anywhere in the corpus form a graph weighted by positive
pointwise mutual information; random walks with restart at the toxic and at the clean
seeds give each word a polarity between -1 and 1.  A document's score is a logistic
function of the polarity of its words, fitted to labelled rows.

Counts of neighbouring words cover every text.  Labelled rows are used up to ``LABELLED`` (those
with the smallest hash of doc_id), and the graph has up to ``VERTICES`` words (the most frequent in labelled rows, and all seeds);
both bound what the driver holds.

Words are runs of bytes other than ASCII punctuation, white space and control characters, A-Z lowered.
Defined results: null, empty and wordless texts get the score of a text without any polar word;
rows that repeat an id are scored one by one; of contradictory labels the greatest counts; rows without
doc_id are scored as if learnt from (held_out false); without toxic labels every score is the share of toxic labels, 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_ascii, texts_words, utf8, word_hashes
from .vectors import per_group

LABELLED, VERTICES, SEEDS, WINDOW, RESTART = 20_000, 2_000, 400, 3, 0.4
_BREAK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FEATURES = "x0 double, x1 double, x2 double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _hash(words: list[str]) -> np.ndarray:
    return np.array([word_hashes(w.encode())[0][0] for w in words], np.uint64)


def _places(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted table, -1 where it's missing."""
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at, -1)


def _near(table: np.ndarray, window: int):
    """Counts of pairs of vertices within the window, summed over a partition: a row of the matrix each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(table)
        total = np.zeros(n * n, np.int32)
        for b in chunks(batches):
            keys = []
            for words in texts_words([t and t.translate(_BREAK) for t in utf8(b.column("text"))]):
                at = _places(table, words)
                for d in range(1, window + 1):
                    u, v = at[:-d], at[d:]
                    both = (u >= 0) & (v >= 0)
                    keys.append(u[both] * n + v[both])
            if keys:
                k, c = np.unique(np.concatenate(keys), return_counts=True)
                total[k] += c.astype(np.int32)
        rows = total.reshape(n, n)
        some = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([rows[r].tobytes() for r in part], pa.binary())], names=["u", "counts"])

    return run


def _sum(n: int):
    def run(g: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(n, np.int64)
        for x in g.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        return pa.RecordBatch.from_arrays([g.column("u").slice(0, 1), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["u", "counts"])

    return run


def polarity(counts: np.ndarray, toxic: np.ndarray, clean: np.ndarray, restart: float = RESTART, steps: int = 60) -> np.ndarray:
    """(t - c) / (t + c) of the walks' stationary shares; ``toxic`` and ``clean`` are weights of the seeds."""
    m = (counts + counts.T).astype(float)
    total, degree = m.sum(), m.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ppmi = np.where(m > 0, np.maximum(0, np.log(m * total / np.outer(degree, degree))), 0.0)
    out = ppmi.sum(axis=1, keepdims=True)
    step = np.divide(ppmi, out, out=np.zeros_like(ppmi), where=out > 0)
    shares = []
    for seed in (toxic, clean):
        p = s = seed / max(seed.sum(), 1e-12)
        for _ in range(steps):
            p = restart * s + (1 - restart) * (p @ step)
        shares.append(p)
    t, c = shares
    even = 1e-2 / max(len(t), 1)  # a word that neither walk reaches is neutral
    return (t - c) / (t + c + even)


def _features(table: np.ndarray, weight: np.ndarray):
    """Of each text: log of its toxic weight, toxic weight a word, and the greatest polarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = np.zeros((b.num_rows, 3))
            for i, words in enumerate(texts_words([t and t.translate(_BREAK) for t in utf8(b.column("text"))])):
                if len(words) and len(table):
                    at = _places(table, words)
                    w = weight[at[at >= 0]]
                    mass = w[w > 0].sum()
                    x[i] = np.log1p(mass), mass / (len(words) + 20) * 20, w.max() if len(w) else 0
            columns = [b.column(n) for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[:, j]) for j in range(3))], names=[*(n for n in b.schema.names if n != "text"), "x0", "x1", "x2"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 200) -> np.ndarray:
    """Weights and, last, the constant, by Newton steps with a ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 4.0 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-8:
            break
    return w


def induce(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, polarity, logistic weights) learnt from the labelled rows given and all texts of ``docs``."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = docs.sparkSession.createDataFrame(known.collect(), "doc_id long, toxic int")  # LABELLED rows at most
    seen = docs.filter("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    n = {r["toxic"] > 0: r["n"] for r in seen.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return [], np.zeros(0), np.array([0.0, 0.0, 0.0, np.log((bad + 1e-9) / (good + 1e-9)) if bad or good else -30.0])
    word = F.explode(F.array_distinct(F.split(lower_ascii(F.col("text")), r"[\x00-/:-@\[-`{-\x7f]+"))).alias("word")
    terms = seen.select(word, (F.col("toxic") > 0).cast("long").alias("toxic")).filter("word != ''").groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    # a word of a share of the rows: as many as words a row over that share, at most
    found = terms.filter(F.col("n") >= max(3, 0.002 * (bad + good))).select("word", "a", (F.col("n") - F.col("a")).alias("b")).collect()
    found.sort(key=lambda r: (-r["a"] - r["b"], r["word"]))
    a, b = (np.array([r[c] for r in found], float) for c in ("a", "b"))
    odds = np.log((a + 0.5) / (bad - a + 0.5)) - np.log((b + 0.5) / (good - b + 0.5))
    share = (a + b) / (bad + good)
    z = (a / bad - b / good) / np.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    order = np.argsort(-z, kind="stable")
    # words of a passage that toxic rows happen to share stand far below the words that make them toxic
    bad_seeds = [i for i in order[:SEEDS] if z[i] >= max(3, z[order[0]] / 12) and odds[i] >= 4] or list(order[:1])
    good_seeds = [i for i in range(len(found)) if odds[i] <= 0.25][:SEEDS]
    keep = sorted({*range(min(VERTICES, len(found))), *bad_seeds, *good_seeds})
    words = [found[i]["word"] for i in keep]
    table = _hash(words)
    by = np.argsort(table)
    words, table, keep = [words[i] for i in by], table[by], [keep[i] for i in by]
    place = {k: i for i, k in enumerate(keep)}
    toxic, clean = np.zeros(len(keep)), np.zeros(len(keep))
    toxic[[place[i] for i in bad_seeds]] = np.maximum(z[bad_seeds], 0.1)
    clean[[place[i] for i in good_seeds]] = 1
    rows = docs.select("text").mapInArrow(_near(table, WINDOW), "u long, counts binary")
    summed = rows.repartition("u").sortWithinPartitions("u").mapInArrow(per_group(_sum(len(table)), ["u"]), "u long, counts binary")
    counts = np.zeros((len(table), len(table)))
    for r in summed.toLocalIterator():  # VERTICES rows and some seeds at most, one partition after the other
        counts[r["u"]] = np.frombuffer(r["counts"], "<i8")
    weight = polarity(counts, toxic, clean)
    weight = np.where(np.abs(weight) >= 0.5, weight, 0.0)
    x = seen.mapInArrow(_features(table, weight), "doc_id long, toxic int, " + FEATURES).select("x0", "x1", "x2", "toxic").toPandas().to_numpy(float)
    return words, weight, logistic(x[:, :3], (x[:, 3] > 0).astype(float))


def score(docs: DataFrame, lexicon: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""
    words, weight, w = lexicon
    used = [i for i in range(len(words)) if weight[i] != 0]
    table = _hash([words[i] for i in used])
    by = np.argsort(table)
    x = docs.select("doc_id", "text").mapInArrow(_features(table[by], np.array([weight[i] for i in used])[by] if used else np.zeros(0)), "doc_id long, " + FEATURES)
    line = sum((F.col(f"x{j}") * F.lit(float(w[j])) for j in range(3)), F.lit(float(w[3])))
    return x.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    scored = score(rows, induce(rows, known))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
