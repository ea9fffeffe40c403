"""Descriptive statistics, percentiles, sketches, windows and rates over (keys, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STANDARD = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)
BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def _name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "")


def percentile(value: Column | str, p: float) -> Column:
    """Linear interpolation at rank p/100 * (n - 1)."""
    if not 0 <= p <= 100:
        raise ValueError(f"percentile {p} is outside of 0..100")
    return F.percentile(value, F.lit(p / 100))


def summary(df: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float] = STANDARD) -> DataFrame:
    """count, min, max, mean, population std and percentiles; a group without rows gives no row."""
    x = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit([p / 100 for p in percentiles])).alias("__p"))
    return x.select(*[c for c in x.columns if c != "__p"], *[F.col("__p")[i].alias(_name(p)) for i, p in enumerate(percentiles)])


def custom_percentiles(df: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """One row a percentile: pct, value."""
    got = df.groupBy(*by).agg(F.percentile(value, F.lit([p / 100 for p in percentiles])).alias("__p"))
    return got.select(*by, F.posexplode("__p").alias("__i", "value")).select(*by, F.element_at(F.lit(list(map(float, percentiles))), F.col("__i") + 1).alias("pct"), "value")


def _labels(bounds: Sequence[float]) -> list[str]:
    b = [f"{x:g}" for x in bounds]
    return [f"<={b[0]}", *(f"{lo}-{hi}" for lo, hi in zip(b[:-1], b[1:], strict=True)), f">{b[-1]}"]


def bucket_label(value: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """Label of the bucket whose upper bound, inclusive, is the first to reach the value."""
    labels = _labels(bounds)
    out = F.when(value <= bounds[0], labels[0])
    for b, name in zip(bounds[1:], labels[1:], strict=False):
        out = out.when(value <= b, name)
    return out.when(value.isNotNull(), labels[-1])


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Counts by bucket, empty ones included: by, bucket, label, n."""
    labels = _labels(bounds)
    counts = [F.count_if(bucket_label(F.col(value), bounds) == x).alias(f"__{i}") for i, x in enumerate(labels)]
    one = df.groupBy(*by).agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(x).alias("label"), F.col(f"__{i}").alias("n")) for i, x in enumerate(labels)])).alias("r")
    return one.select(*by, rows).select(*by, "r.*")


def dd_sketch(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None, accuracy: float = 0.01) -> DataFrame:
    """Log-bucket sketch as rows: by, idx, w; idx is null for values of 0 or less.  Merge with ``dd_merge``."""
    gamma = (1 + accuracy) / (1 - accuracy)
    idx = F.when(F.col(value) > 0, F.ceil(F.ln(F.col(value)) / F.ln(F.lit(gamma))))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, idx.alias("idx")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))


def dd_merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of many hosts as one: weights of equal buckets are added."""
    return sketches.groupBy(*by, "idx").agg(F.sum("w").alias("w"))


def dd_quantile(sketch: DataFrame, by: Sequence[str], q: float, accuracy: float = 0.01) -> DataFrame:
    """The first bucket whose cumulative weight passes q * (total - 1)."""
    gamma = (1 + accuracy) / (1 - accuracy)
    order = W.partitionBy(*by).orderBy(F.col("idx").asc_nulls_first())
    run = sketch.withColumn("c", F.sum("w").over(order)).withColumn("t", F.sum("w").over(W.partitionBy(*by)))
    hit = run.filter(F.col("c") > F.lit(q) * (F.col("t") - 1)).groupBy(*by).agg(F.min_by("idx", "c").alias("idx"))
    return hit.select(*by, F.coalesce(F.lit(2.0) * F.pow(F.lit(gamma), F.col("idx")) / (gamma + 1), F.lit(0.0)).alias("value"))


def kll_percentiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Approximate percentiles from the built-in KLL sketch."""
    s = df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("s"))
    return s.select(*by, *[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(_name(100 * q)) for q in qs])


def kll_states(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The stored form of a sketch: ``by``, state (binary); null values are left out."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("state"))


def kll_merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of coarser groups from stored ones; merging is associative, so states may be merged in any order."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double("state").alias("state"))


def kll_read(states: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    return states.select(*by, *[F.kll_sketch_get_quantile_double("state", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in points])


def throughput(n: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(n / seconds)


def rate(n: Column, total: Column) -> Column:
    """n / total * 100, 0 where the total is 0 or less."""
    return F.when(total <= 0, 0.0).otherwise(n / total * 100)


def aggregate(df: DataFrame, by: Sequence[str], value: str, seconds: float) -> DataFrame:
    """n, sum, mean, min, max and throughput (n / seconds, two digits)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(throughput(F.count(value), F.lit(float(seconds))), 2).alias("throughput"))


def tumbling(df: DataFrame, by: Sequence[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Windows on a grid aligned to the epoch."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds)
    return aggregate(df.withColumn("window_start", start), [*by, "window_start"], value, seconds)


def anchored_windows(df: DataFrame, by: Sequence[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Windows that begin at an event: the first of a key, then the first at or after the present window's end.

    A window's start depends on the one before, so each key's time stamps (not its values) are folded in order.
    """
    t = df.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).distinct()
    step = seconds * 1_000_000
    folded = t.groupBy(*by).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    begin = F.aggregate("ts", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x >= F.element_at(a, -1) + step), F.concat(a, F.array(x))).otherwise(a))
    starts = folded.select(*by, F.explode(begin).alias("s"))
    starts = starts.withColumn("e", F.lead("s").over(W.partitionBy(*by).orderBy("s")))
    # starts and events meet in one ordered window a key
    events = df.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).alias("v"))
    both = events.withColumn("s", F.lit(None).cast("long")).unionByName(starts.select(*by, F.col("s").alias("t"), F.lit(None).cast("double").alias("v"), "s"))
    own = F.last("s", True).over(W.partitionBy(*by).orderBy("t", F.col("s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("w", own).filter("s is null")
    return placed.groupBy(*by, F.timestamp_micros("w").alias("window_start")).agg(F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
