"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected rate = target / source size times.  The
expected copies are prefix-summed within the source, in an order by size so that
neighbours are alike, one offset per source is added, and a document is
emitted once per integer boundary that its interval crosses; so it is
taken floor(rate) or ceil(rate) times, 3 at the most.

Prefix sums are distributed: a source's documents fall into bands of size and
salted buckets; only the buckets' counts are summed over the whole source.

Defined results: null and wordless texts have size 0 and are taken 0 words;
ties of size and doc_id fall by a hash of the text, so reruns agree; very long texts are counted without being split; a null source is a source of its own, the last; repeated rows and rows without
doc_id are sampled like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, small, stash

WEIGHTS, MOST, BUCKETS = (5, 2, 1), 3, 64
#: Boundaries of the bands of size; between them sizes differ by half at most.
BANDS = (1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 675, 1000, 1500, 2250, 3400, 5000, 7500, 11000, 17000, 25000, 50000, 100000, 1000000)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of the sum of sizes by weight, none above ``most`` times the source's size.

    The level at which capped sources end is found by one ordered sum over sources (one row a source).
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    w = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("w", pick.cast("long"))
    w = w.withColumn("top", F.col("source_size") * most)
    by_level = W.orderBy((F.col("top") / F.col("w")), "i")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("top").over(before), zero)) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), zero))
    w = w.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("top") / F.col("w"))
    w = w.withColumn("final", F.min(F.when(F.col("fits"), F.struct((F.col("top") / F.col("w")).alias("r"), "i", "level"))).over(all_)["level"])
    target = F.least(F.col("top").cast("double"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("w"))
    return w.select("source", "source_size", target.alias("target"))


def _source_offset(seed: str) -> Column:
    """A number in (0, 1) that the source and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))).substr(1, 8)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of every row.

    ``keep``: further columns to carry through.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *keep)
    band = sum((F.when(F.col("size") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    salt = (F.coalesce("doc_id", F.lit(0)) % 1048576 * 40503 + F.coalesce("doc_id", F.lit(0)) % 1021) % 65536
    rows = stash(sized.withColumn("band", band).withColumn("bucket", F.pmod(salt, F.lit(BUCKETS)).cast("int")))
    counts = stash(rows.groupBy("source", "band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")))
    goal = targets(counts.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    before = W.partitionBy("source").orderBy("band", "bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("o", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    goal = goal.withColumnRenamed("source", "g")
    plan = offsets.join(goal, F.col("source").eqNullSafe(F.col("g"))).select(F.col("source").alias("of"), F.col("band").alias("b1"), F.col("bucket").alias("b2"), "o", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("band") == F.col("b1")) & (F.col("bucket") == F.col("b2"))
    place = F.col("o") + F.row_number().over(W.partitionBy("source", "band", "bucket").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie"))
    out = rows.join(small(stash(plan)), same).withColumn("k", place)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = _source_offset(seed)
    copies = F.floor(u + rate * F.col("k")) - F.floor(u + rate * (F.col("k") - 1))
    return out.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    columns = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    plain = docs.select("doc_id", "source", *columns)
    keep = plain.select("doc_id", "source", "text", F.struct(*columns, "source").alias("__row"))
    out = mix(keep, keep=("__row",)).filter("copies > 0").withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", *[F.col(f"__row.{c}").alias(c) for c in (*columns, "source")]).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS top,
      row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (coalesce(sum(top) OVER (ORDER BY top::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS used,
      (sum(w) OVER ())::DOUBLE AS tw, (coalesce(sum(w) OVER (ORDER BY top::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS uw FROM w),
v AS (SELECT *, (total - used) / (tw - uw) AS level FROM l),
f AS (SELECT min_by(level, (top::DOUBLE / w, i)) AS final FROM v WHERE level <= top::DOUBLE / w),
g AS (SELECT source, source_size, least(top::DOUBLE, coalesce(final, 0.0) * w) AS target FROM v, f),
b AS (SELECT *, len(list_filter([1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 675, 1000, 1500, 2250, 3400, 5000, 7500, 11000, 17000, 25000, 50000, 100000, 1000000], lambda x: x <= size)) AS band,
      ((coalesce(doc_id, 0) % 1048576 * 40503 + coalesce(doc_id, 0) % 1021) % 65536) % 64 AS bucket FROM d),
k AS (SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY b.source ORDER BY band, bucket, size, doc_id NULLS LAST) AS k,
      (('0x' || substr(md5('mix' || coalesce('s' || b.source, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (floor(u + rate * k) - floor(u + rate * (k - 1)))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
