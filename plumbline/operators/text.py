"""Tokens, clones, secrets, logs, licences, names and inferred types of text columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words, and every other visible sign by itself."""
    return F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0))


def token_hash(toks: Column) -> Column:
    return F.md5(F.array_join(toks, " "))


def entropy(df: DataFrame, id: str, text: str) -> DataFrame:
    """Shannon entropy in bits a character of each text: counts of characters, then one sum."""
    chars = df.filter(F.length(text) > 0).select(id, F.explode(F.split(F.col(text), "")).alias("ch")).filter("ch != ''").groupBy(id, "ch").agg(F.count(F.lit(1)).alias("c"))
    g = chars.groupBy(id).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return df.select(id).join(g.select(id, (F.log2("n") - F.col("s") / F.col("n")).alias("entropy")), id, "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def masked(secret: Column, visible: int = 2) -> Column:
    """Stars but for the last ``visible`` (2 at most) characters; secrets of 4 or less are stars only."""
    v = max(0, min(2, visible))
    n = F.length(secret)
    if not v:
        return F.repeat(F.lit("*"), n)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - v), F.right(secret, F.lit(v))))


#: (category, kind, severity, pattern); the first kind of a category that matches a line counts.
SECRETS = (
    ("personal", "ssn", "CRITICAL", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("personal", "card", "CRITICAL", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13})\b"),
    ("personal", "email", "MEDIUM", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("personal", "phone", "MEDIUM", r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}"),
    ("credential", "password", "CRITICAL", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S{4,}"),
    ("credential", "api_key", "CRITICAL", r"(?i)\bapi[_-]?key\s*[:=]\s*\S{8,}"),
    ("cloud", "aws_key", "CRITICAL", r"\bAKIA[0-9A-Z]{16}\b"),
    ("cloud", "github", "CRITICAL", r"\bgh[oprsu]_\w{36,}"),
    ("key", "private_key", "CRITICAL", r"-----BEGIN [A-Z ]*PRIVATE KEY"),
    ("database", "connection", "CRITICAL", r"(?i)\b(?:mysql|postgres|postgresql|mongodb|redis)://[^\s:@]+:[^\s:@]+@"),
    ("token", "jwt", "HIGH", r"\beyJ[\w-]{20,}\.eyJ[\w-]{20,}\."),
    ("token", "bearer", "HIGH", r"\bBearer\s+[\w.-]{20,}"),
)


def secrets(df: DataFrame, id: str, text: str, patterns: Sequence[tuple[str, str, str, str]] = SECRETS) -> DataFrame:
    """id, line (from 1), category, kind, severity, masked value: per line and category the first kind that matches."""
    lines = df.filter(F.col(text).isNotNull()).select(id, F.posexplode(F.split(F.col(text), "\n")).alias("p", "s"))
    found = []
    for category in dict.fromkeys(p[0] for p in patterns):
        own = [p for p in patterns if p[0] == category]
        pick = None
        for _, kind, severity, rx in own:
            hit = F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.regexp_extract("s", rx, 0).alias("value"))
            pick = F.when(F.col("s").rlike(rx), hit) if pick is None else pick.when(F.col("s").rlike(rx), hit)
        found.append(pick)
    any_ = "|".join(f"(?:{p[3]})" for p in patterns)  # one cheap test spares most lines the rest
    hits = lines.filter(F.col("s").rlike(any_)).select(id, (F.col("p") + 1).alias("line"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("h"))
    return hits.select(id, "line", "h.category", "h.kind", "h.severity", masked(F.col("h.value")).alias("masked"))


EVENTS = (("auth_failure", r"(?i)failed (?:login|password)|authentication fail"), ("error", r"(?i)\berror\b|exception"), ("injection", r"(?i)union\s+select|<script"), ("timeout", r"(?i)time(?:d )?out"))


def log_events(df: DataFrame, line: str, classes: Sequence[tuple[str, str]] = EVENTS) -> DataFrame:
    """Class of each line (the first pattern that matches, else null) and its first IPv4 address."""
    out = None
    for name, rx in classes:
        out = F.when(F.col(line).rlike(rx), name) if out is None else out.when(F.col(line).rlike(rx), name)
    return df.withColumn("event_class", out).withColumn("ip", F.nullif(F.regexp_extract(line, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0), F.lit("")))


def typosquats(names: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """name, popular, distance: the nearest popular name at distance 1..2 and length gap of 2 at most.

    Deletion neighbourhoods make it an equi join: two names within distance d share a string after d deletions each.
    """

    def variants(c: Column) -> Column:
        drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        one = drop(c)
        return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, drop))))

    n = names.select(F.col("name")).distinct().join(popular.select(F.col("name")).distinct(), "name", "left_anti").withColumn("k", F.explode(variants(F.col("name"))))
    p = popular.select(F.col("name").alias("popular")).distinct().withColumn("k", F.explode(variants(F.col("popular"))))
    d = n.join(p, "k").select("name", "popular").distinct().withColumn("distance", F.levenshtein("name", "popular"))
    d = d.filter((F.col("distance") >= 1) & (F.col("distance") <= most) & (F.abs(F.length("name") - F.length("popular")) <= 2))
    return d.groupBy("name").agg(F.min(F.struct("distance", "popular")).alias("x")).select("name", "x.popular", "x.distance")


LICENCES = (("Apache-2.0", r"(?i)apache.{0,20}(?:2\.0|version 2)"), ("MIT", r"(?i)\bMIT\b"), ("GPL-3.0", r"(?i)general public license.{0,20}3|\bGPL-?v?3"), ("CC-BY-NC-4.0", r"(?i)CC BY-NC 4\.0"), ("BSD-3-Clause", r"(?i)\bBSD\b"))


#: What patterns without regard to case mean in RE2, in Java: word boundaries are of ASCII, only \n ends a line, and s and k have a third form.
_RE2 = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", ".": r"[^\n]", **dict.fromkeys("sS", r"[s\u017F]"), **dict.fromkeys("kK", r"[k\u212A]")}


def _java(rx: str) -> str:
    return re.sub(r"\\.|[.sSkK]", lambda m: _RE2.get(m[0], m[0]), rx)


def licence(text: Column) -> Column:
    """SPDX identifier of a licence line; null where none is recognised or the text is over 100 characters."""
    out = None
    for name, rx in ((n, _java(x)) for n, x in LICENCES):
        out = F.when(text.rlike(rx), name) if out is None else out.when(text.rlike(rx), name)
    return F.when(F.length(text) <= 100, out)


def licence_policy(spdx: Column, allowed: Sequence[str], warned: Sequence[str]) -> Column:
    return F.when(spdx.isNull(), "unknown").when(spdx.isin(*allowed), "allowed").when(spdx.isin(*warned), "warn").otherwise("prohibited")


def cvss_severity(score: Column) -> Column:
    return F.when(score.isNull(), "high").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def blocks(df: DataFrame, id: str, text: str, size: int = 6) -> DataFrame:
    """Sliding windows of ``size`` lines, step size / 2: id, start, hash of their tokens."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    l = df.filter(F.col(text).isNotNull()).select(id, lines.alias("l")).filter(F.size("l") >= size)
    w = l.select(id, "l", F.explode(F.sequence(F.lit(1), F.size("l") - size + 1, F.lit(max(1, size // 2)))).alias("start"))
    return w.select(id, "start", token_hash(tokens(F.array_join(F.slice("l", F.col("start"), F.lit(size)), "\n"))).alias("hash"))


def clone_families(block: DataFrame, id: str) -> DataFrame:
    """Blocks whose tokens are equal, in two or more places: hash, copies, texts."""
    return block.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(id).alias("texts"), F.min(F.struct(id, "start")).alias("x")).filter("copies > 1").select("hash", "copies", "texts", F.col(f"x.{id}").alias("first"), F.col("x.start").alias("start"))


def duplicated_share(block: DataFrame, id: str) -> DataFrame:
    """Per text the percent of its blocks that occur elsewhere too."""
    families = block.groupBy("hash").agg(F.count(F.lit(1)).alias("c"))
    j = block.join(families, "hash")
    return j.groupBy(id).agg(F.count(F.lit(1)).alias("blocks"), (F.avg(F.when(F.col("c") > 1, 1.0).otherwise(0.0)) * 100).alias("duplicated_pct"))


def value_format(v: Column) -> Column:
    """date-time, date, time, email, uri, uuid, ipv4 or null."""
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "date-time")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(v.rlike(r"^\d{2}:\d{2}(:\d{2})?$"), "time")
        .when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(v.rlike(r"^[a-z][a-z0-9+.-]*://"), "uri")
        .when(v.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid")
        .when(v.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ipv4")
    )


def inferred_schema(df: DataFrame, json: str) -> DataFrame:
    """Key by key of JSON objects: presence, whether required, types, range of numbers, lengths of strings, distinct values."""
    whole = df.filter(F.col(json).isNotNull())
    kv = whole.withColumn("__m", F.from_json(json, "map<string,string>")).select(F.explode("__m").alias("key", "v"))
    kind = F.when(F.col("v").isNull(), "null").when(F.col("v").rlike(r"^-?\d+$"), "integer").when(F.col("v").rlike(r"^-?\d+\.\d+$"), "number").when(F.col("v").isin("true", "false"), "boolean").otherwise("string")
    g = kv.withColumn("kind", kind).groupBy("key").agg(F.count(F.lit(1)).alias("present"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"), F.min(F.expr("try_cast(v as double)")).alias("min"), F.max(F.expr("try_cast(v as double)")).alias("max"), F.max(F.length("v")).alias("longest"), F.count_distinct("v").alias("values"))
    n = whole.agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(n)).withColumn("required", F.col("present") == F.col("n")).drop("n")


def top_values(df: DataFrame, by: Sequence[str], value: str, k: int = 10) -> DataFrame:
    g = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), value))).filter(F.col("place") <= k)
