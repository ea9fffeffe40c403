"""Apdex, SLA checks and coordinated omission."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apdex_score(value: Column, threshold: float, factor: float = 4.0, errored: Column | None = None) -> Column:
    """1 satisfied, .5 tolerating, 0 frustrated; both bounds inclusive; an errored request is frustrated."""
    good = F.when(value <= threshold, 1.0).when(value <= threshold * factor, 0.5).otherwise(0.0)
    return good if errored is None else F.when(errored, 0.0).otherwise(good)


def apdex_rating(score: Column) -> Column:
    return F.when(score >= 0.94, "Excellent").when(score >= 0.85, "Good").when(score >= 0.70, "Fair").when(score >= 0.50, "Poor").otherwise("Unacceptable")


def apdex(df: DataFrame, by: Sequence[str], value: str, threshold: float, factor: float = 4.0, weight: Column | None = None, errored: Column | None = None, human: Column | None = None) -> DataFrame:
    """score, rating and counts; with weights, their sum is the denominator; rows that aren't human are counted apart."""
    v, rows = F.col(value), df
    rows = rows.withColumns({"__h": F.lit(True) if human is None else human, "__w": F.lit(1.0) if weight is None else weight, "__e": F.lit(False) if errored is None else errored})
    own = F.col("__h")
    s = apdex_score(v, threshold, factor, F.col("__e"))
    out = rows.groupBy(*by).agg(F.count_if(own).alias("n"), F.count_if(~own).alias("excluded"), F.count_if(own & (s == 1.0)).alias("satisfied"), F.count_if(own & (s == 0.5)).alias("tolerating"), F.count_if(own & (s == 0.0)).alias("frustrated"), (F.sum(F.when(own, s * F.col("__w"))) / F.sum(F.when(own, F.col("__w")))).alias("score"))
    return out.filter("n > 0").withColumn("rating", apdex_rating(F.col("score")))


def recommended_threshold(df: DataFrame, by: Sequence[str], value: str, target: float = 0.85) -> DataFrame:
    """The value at place int(target * n) in ascending order; the maximum for a target of 1."""
    order = W.partitionBy(*by).orderBy(value)
    place = df.withColumn("__r", F.row_number().over(order) - 1).withColumn("__n", F.count(value).over(W.partitionBy(*by)))
    return place.filter(F.col("__r") == F.least(F.floor(F.lit(target) * F.col("__n")), F.col("__n") - 1)).select(*by, F.col(value).alias("threshold"))


def apdex_rollup(scores: DataFrame, by: Sequence[str], endpoint: str, target: float = 0.85) -> DataFrame:
    """Percent of endpoints at or above the target, and the sorted list of the others."""
    ok = F.col("score") >= target
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("endpoints"), (F.avg(F.when(ok, 1.0).otherwise(0.0)) * 100).alias("passing_pct"), F.array_sort(F.collect_list(F.when(~ok, F.col(endpoint)))).alias("failing"))


def backfilled(df: DataFrame, by: Sequence[str], value: str, interval: float) -> DataFrame:
    """HDR correction: a sample s above the expected interval adds s - e, s - 2e ... as long as they reach e."""
    steps = F.greatest(F.floor(F.col(value) / interval) - 1, F.lit(0))
    return df.select(*by, F.col(value).alias("__v"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(value) > interval, steps).otherwise(F.lit(0)).cast("long"))).alias("__step")).select(*by, F.col("__step").alias("step"), (F.col("__v") - F.col("__step") * interval).alias(value))


def tene_suspicious(df: DataFrame, by: Sequence[str], value: str, duration_ms: float) -> DataFrame:
    """avg below max^2 / (2 * duration): stalls were likely not sampled."""
    a = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return a.withColumn("expected", F.col("max") * F.col("max") / (2 * duration_ms)).withColumn("suspicious", F.col("mean") < F.col("expected"))


def within_littles_law(throughput: Column, latency_s: Column, limit: Column) -> Column:
    return F.when(limit <= 0, False).otherwise(throughput * latency_s <= limit)


def sla_check(df: DataFrame, by: Sequence[str], value: str, threshold: float, percentile: float = 95.0, warning_percent: float = 90.0, errored: Column | None = None, error_rate_most: float | None = None) -> DataFrame:
    """Percentile against the threshold, margin %, error rate, and COMPLIANT, WARNING or BREACHED."""
    e = F.lit(False) if errored is None else errored
    a = df.groupBy(*by).agg(F.percentile(value, F.lit(percentile / 100)).alias("measured"), F.count(F.lit(1)).alias("n"), F.count_if(e).alias("errors"))
    a = a.withColumn("margin_pct", (F.lit(threshold) - F.col("measured")) / threshold * 100).withColumn("error_rate", F.col("errors") / F.col("n") * 100)
    broken = F.col("measured") > threshold
    if error_rate_most is not None:
        broken = broken | (F.col("error_rate") > error_rate_most)
    return a.withColumn("status", F.when(broken, "BREACHED").when(F.col("measured") > threshold * warning_percent / 100, "WARNING").otherwise("COMPLIANT"))


def sla_fraction(df: DataFrame, by: Sequence[str], value: str, threshold: float, target: float = 0.99) -> DataFrame:
    """Share of good events against the target; fewer than ceil(10 / (1 - target)) events can only warn."""
    least = math.ceil(round(10 / (1 - target), 6))
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) <= threshold).alias("good"))
    a = a.withColumn("fraction", F.col("good") / F.col("n")).withColumn("enough", F.col("n") >= least)
    return a.withColumn("status", F.when(F.col("fraction") >= target, "COMPLIANT").when(F.col("enough"), "BREACHED").otherwise("WARNING"))


def compliance_rate(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), (F.avg(F.when(F.col("status") == "COMPLIANT", 1.0).otherwise(0.0)) * 100).alias("compliance_pct"))
