"""Shared pieces: scratch tables in the cluster's shared folder, size-checked
broadcasts, distributed ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 64 << 20


def scratch(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; it goes when the driver ends.

    Without that setting a local master gets a temporary folder; a cluster has no folder that all executors share, so it raises.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("plumbline.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("plumbline.scratch.dir", base)
    path = f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = 48 if isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType) else 8
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * each + 24
    return F.lit(8 * max(1, len(kind.fields)) + 16 if isinstance(kind, T.StructType) else 8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the rows are shown to take at most ``limit`` bytes; else the plain DataFrame (a shuffled join).

    The bytes are summed in a job of its own, so ``df`` ought to be a stash or a cheap aggregate.
    """
    row = sum((_width(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 1 << 20, by: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds at most ``rows`` rows and, but for single long texts, some ``size`` bytes."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(by)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or total + n > size):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null, as long; no array of words is kept."""
    return F.coalesce(F.expr("0L") + F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0).cast("long"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, salt: Column, buckets: int = 64) -> DataFrame:
    """0-based place of each row among those of equal ``keys``, without one task per key.

    Rows of a key are split into ``buckets`` by ``salt``; counts of the buckets give
    each its offset (a table of at most keys x buckets rows), and rows are
    numbered within their bucket by ``order``.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("__b", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = salted.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("__n")
    for k in [*keys, "__b"]:
        offsets = offsets.withColumnRenamed(k, f"{k}__r")
    same = [salted[k].eqNullSafe(offsets[f"{k}__r"]) for k in [*keys, "__b"]]
    joined = salted.join(offsets, same)
    n = F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)).cast("long") - 1
    return joined.withColumn(out, F.col("__o") + n).drop("__b", "__o", *[f"{k}__r" for k in [*keys, "__b"]])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component_id) of every vertex in ``edges``: the smallest id reachable.

    Large-star and small-star steps (Kiveris et al., 2014) over written tables;
    vertices and links never reach the driver, only a count and a checksum.
    """
    spark = edges.sparkSession
    u, v = F.greatest(a, b), F.least(a, b)
    e = stash(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = stash(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    of = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    roots = e.select(F.col("v").alias("id")).distinct().join(e.select(F.col("u").alias("id")), "id", "left_anti").withColumn("component_id", F.col("id"))
    return of.unionByName(roots) if spark else of


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}
BLOCK = 1 << 22


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS["p"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, _P, np.uint64))])
            _POWERS["i"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, _P_INV, np.uint64))])
    return _POWERS["p"], _POWERS["i"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (runs of other bytes than ASCII white space), with their starts and ends.

    Long data go through in blocks that end at white space, so what is held beside the words stays bounded.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > BLOCK:
        parts, at = [], 0
        while at < len(raw):
            end = at + BLOCK
            while end < len(raw) and not (gap := _SPACE[raw[end : end + 4096]]).any():
                end += 4096
            end = len(raw) if end >= len(raw) else end + int(gap.argmax())
            h, a, b = _hashed_words(raw[at:end])
            parts.append((h, a + at, b + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _hashed_words(raw)


def _hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` make one shingle."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            h = np.uint64(n)
            for w in words:
                h = h * _P + w
            return mix64(np.array([h], np.uint64))
        h = words[: n - width + 1].copy()
        for j in range(1, width):
            h = h * _P + words[j : n - width + 1 + j]
        return np.unique(mix64(h))


def texts_words(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text (A-Z lowered), hashed together in one pass over their joined bytes."""
    data = b"\n".join(t or b"" for t in texts).lower()
    words, starts, _ = word_hashes(data)
    at = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    cut = np.searchsorted(starts, at)
    for i in range(len(texts)):
        yield words[cut[i] : cut[i + 1]]
