"""Verdicts: two-sample gates, tool SLOs, timing scores, resource scores, and trace normalisation.

Defined results of this module: nulls in measured columns are left out of aggregates; groups without rows don't appear; an empty table gives an empty
result; extra columns are ignored; repeated rows count as often as they are there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf, t_p_value
from .graph import _cut
from .scores import _bounded, hodges_lehmann
from .series import mann_whitney, two_samples

PARENT = ["trace_id", "parent_span_id"]


def p_of_t(t: Column, df: Column) -> Column:
    """Two-sided p; beyond 30 degrees of freedom that of the normal distribution, 1 without any."""
    return F.when(df <= 0, 1.0).when(df > 30, 2 * (1 - normal_cdf(F.abs(t)))).otherwise(t_p_value(t, df))


def p_of_z(z: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z)))))


def mann_whitney_p(df: DataFrame, by: Sequence[str], value: str, after: Column) -> DataFrame:
    return mann_whitney(df, by, value, after).withColumn("p", p_of_z(F.col("z")))


def pseudo_median(df: DataFrame, by: Sequence[str], key: str, value: str, most: int = 250) -> DataFrame:
    """Median of the Walsh averages (x_i + x_j) / 2, i <= j, of at most ``most`` rows a group (those with the smallest md5 of ``key``)."""
    s = _bounded(df, by, key, most).select(*by, F.col(value).cast("double").alias("x"), F.col("__r").alias("i"))
    o = s.withColumnsRenamed({"x": "y", "i": "j"})
    return s.join(o, list(by)).filter("i <= j").groupBy(*by).agg(F.percentile((F.col("x") + F.col("y")) / 2, F.lit(0.5)).alias("pseudo_median"))


def change_severity(change_pct: Column, critical: float = 50.0, high: float = 25.0, least: float = 10.0) -> Column:
    a = F.abs(change_pct)
    return F.when(a >= critical, "critical").when(a >= high, "high").when(a >= least, "medium").when(a >= least / 2, "low").otherwise("info")


def regression_severity(regressed: Column, mean_change: Column, p99_change: Column, effect: Column, critical: float = 50.0, least: float = 10.0) -> Column:
    most, e = F.greatest(F.abs(mean_change), F.abs(p99_change)), F.abs(effect)
    return (
        F.when(~regressed, "info")
        .when((most >= critical) | (e >= 1.2), "critical")
        .when((most >= critical / 2) | (e >= 0.8), "high")
        .when((most >= least) | (e >= 0.5), "medium")
        .otherwise("low")
    )


def regression_confidence(significant: Column, p: Column, effect: Column) -> Column:
    return F.when(significant, 0.6 * (1 - p) + 0.4 * F.least(F.lit(1.0), F.abs(effect) / 0.8)).otherwise(0.0)


def three_gates(df: DataFrame, by: Sequence[str], key: str, value: str, after: Column, alpha: float = 0.05, shift: float = 10.0, relative: float = 0.05, delta: float = 0.5, most: int = 250) -> DataFrame:
    """A regression is one where Welch's p, the Hodges-Lehmann shift (absolute or relative) and Glass's delta all pass their gates.

    The relative shift is undefined where the pseudo-median before isn't positive.
    """
    s = two_samples(df, by, value, after)
    p99 = (F.col("p99_a") - F.col("p99_b")) / F.abs("p99_b") * 100
    s = s.select(*by, p_of_t(F.col("t"), F.col("df")).alias("p"), F.coalesce("glass_delta", "cohens_d").alias("effect"), "change_pct", p99.alias("p99_change_pct"))
    j = s.join(hodges_lehmann(df, by, key, value, after, most), list(by)).join(pseudo_median(df.filter(~after), by, key, value, most), list(by))
    practical = (F.col("shift") > shift) | ((F.col("pseudo_median") > 0) & (F.col("shift") > relative * F.col("pseudo_median")))
    j = j.withColumn("statistical", F.col("p") < alpha).withColumn("practical", practical).withColumn("magnitude", F.abs("effect") > delta)
    j = j.withColumn("regressed", F.col("statistical") & F.col("practical") & F.col("magnitude") & (F.col("shift") > 0))
    j = j.withColumn("severity", regression_severity(F.col("regressed"), F.col("change_pct"), F.col("p99_change_pct"), F.col("effect")))
    return j.withColumn("confidence", regression_confidence(F.col("statistical"), F.col("p"), F.col("effect")))


# tool SLOs


def analytical_yield(runs: DataFrame, by: Sequence[str], target: float = 0.995) -> DataFrame:
    """(scored + rejected) / submitted, and the entities that no disposition accounts for; nothing submitted: null."""
    g = runs.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("submitted", "scored", "rejected", "failed")])
    g = g.withColumn("silent_drop", F.greatest(F.lit(0).cast("long"), F.col("submitted") - F.col("scored") - F.col("rejected") - F.col("failed")))
    y = F.round(F.when(F.col("submitted") > 0, (F.col("scored") + F.col("rejected")) / F.col("submitted")), 6)
    return g.withColumn("yield", y).withColumn("meets_target", F.col("yield") >= target)


def freshness(runs: DataFrame, by: Sequence[str], delay_minutes: Column, most: float = 15.0, target: float = 0.95) -> DataFrame:
    """Share of runs ready within ``most`` minutes of the close of their data."""
    share = F.round(F.avg(F.when(delay_minutes <= most, 1.0).otherwise(0.0)), 6)
    return runs.groupBy(*by).agg(share.alias("fresh")).withColumn("meets_target", F.col("fresh") >= target)


def actionability(found: DataFrame, by: Sequence[str], acknowledged: Column, high: Sequence[str] = ("high", "sev1", "sev2"), target: float = 0.3) -> DataFrame:
    """Share of high-severity findings that were acknowledged; groups without any have a null share."""
    is_high = F.lower("severity").isin(*high)
    g = found.groupBy(*by).agg(F.round(F.avg(F.when(is_high, F.when(acknowledged, 1.0).otherwise(0.0))), 6).alias("acted_on"))
    return g.withColumn("meets_target", F.col("acted_on") > target)


# scores


def timing_score(x: Column, good: float, poor: float, zero: float) -> Column:
    """100 up to ``good``, from there linear to 50 at ``poor`` and to 0 at ``zero``."""
    return F.when(x <= good, 100.0).when(x <= poor, 50 + 50 * (poor - x) / (poor - good)).when(x.isNotNull(), F.greatest(F.lit(0.0), 50 * (zero - x) / (zero - poor)))


def lcp_score(ms: Column) -> Column:
    return timing_score(ms, 2500, 4000, 8000)


def fid_score(ms: Column) -> Column:
    return timing_score(ms, 100, 300, 600)


def cls_score(shift: Column) -> Column:
    return timing_score(shift, 0.1, 0.25, 0.5)


def resource_scores(findings: DataFrame, resource: str, universe: DataFrame | None = None, clean_weight: float = 0.05) -> DataFrame:
    """100 less 20, 10, 5, 2 a critical, high, medium, low finding (0 at least) of each resource; clean ones of ``universe`` weigh little."""
    s = F.col("severity")
    penalty = F.when(s == "critical", 20.0).when(s == "high", 10.0).when(s == "medium", 5.0).when(s == "low", 2.0).otherwise(0.0)
    g = findings.groupBy(resource).agg(F.count(F.lit(1)).alias("findings"), F.greatest(F.lit(0.0), 100 - F.sum(penalty)).alias("score")).withColumn("weight", F.lit(1.0))
    if universe is None:
        return g
    clean = universe.select(resource).distinct().join(g, resource, "left_anti")
    return g.unionByName(clean.select(resource, F.lit(0).cast("long").alias("findings"), F.lit(100.0).alias("score"), F.lit(clean_weight).alias("weight")))


def density_score(scores: DataFrame) -> DataFrame:
    """The resources' scores averaged by weight; 100 without any."""
    return scores.agg(F.coalesce(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), F.lit(100.0)).alias("score"))


# traces


def _down(spans: DataFrame, first: Column, step: Column, name: str, carry: Sequence[str], most: int = 4096) -> DataFrame:
    """trace_id, span_id, ``name``: ``first`` at the roots, then level by level ``step`` of the parent's value (``up``).

    Roots have no parent or one that's missing; the spans of a cycle never appear.
    """
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    s = _cut(spans.join(known, PARENT, "left").select("trace_id", "span_id", "parent_span_id", "known", *carry))
    level = _cut(s.filter("known is null").select("trace_id", "span_id", first.alias(name)))
    kids, out = s.filter("known"), level
    for _ in range(most):
        up = level.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col(name).alias("up"))
        level = _cut(kids.join(up, PARENT).select("trace_id", "span_id", step.alias(name)))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def truncated(spans: DataFrame, severe: float = 0.25) -> DataFrame:
    """trace_id, span_id, effective_end_ms (a span ends with its parent at the latest) and whether over ``severe`` of it was cut."""
    end = F.col("start_ms") + F.col("duration_ms")
    s = spans.withColumn("end_ms", end)
    out = _down(s, F.col("end_ms"), F.least("end_ms", "up"), "effective_end_ms", ["end_ms"])
    cut = F.col("end_ms") - F.col("effective_end_ms")
    return out.join(s.select("trace_id", "span_id", "end_ms", "duration_ms"), ["trace_id", "span_id"]).select("trace_id", "span_id", "effective_end_ms", (cut > severe * F.col("duration_ms")).alias("severe"))


def skew_corrected(spans: DataFrame, heavy_ms: float = 50.0) -> DataFrame:
    """trace_id, span_id, start_ms, offset_ms, heavy: a SERVER span under a CLIENT span of another service is centred in it, with all its descendants."""
    c = spans.filter("kind = 'CLIENT'").select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("cs"), F.col("start_ms").alias("c0"), F.col("duration_ms").alias("cd"))
    transit = (F.col("cd") - F.col("duration_ms")) / 2
    pair = (F.col("kind") == "SERVER") & (F.col("service") != F.col("cs"))
    s = spans.join(c, PARENT, "left").withColumn("own", F.coalesce(F.when(pair, F.round(F.col("c0") + transit - F.col("start_ms"), 6)), F.lit(0.0)))
    s = s.withColumn("heavy", F.coalesce(pair & ((F.abs("own") > heavy_ms) | (transit < 0)), F.lit(False)))
    out = _down(s, F.col("own"), F.col("own") + F.col("up"), "offset_ms", ["own"])
    return out.join(s.select("trace_id", "span_id", "start_ms", "heavy"), ["trace_id", "span_id"]).select("trace_id", "span_id", (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), "offset_ms", "heavy")
