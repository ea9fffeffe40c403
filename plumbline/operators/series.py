"""Trends, forecasts, change points and anomalies of ordered series (keys, order, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATENCY_NAMES = ("latency", "duration", "time", "delay", "response")


def indexed(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, order, v, i (0-based place) and n (length) of each point."""
    w = W.partitionBy(*by)
    return df.select(*by, order, F.col(value).cast("double").alias("v")).withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def change_percent(before: Column, after: Column) -> Column:
    """(after - before) / |before| * 100; from 0: 0 or 100."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise((after - before) / F.abs(before) * 100)


def regression(df: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    """n, slope, intercept, R squared (0 for a flat series, within 0..1)."""
    r2 = F.when(F.var_pop(y) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(y, x)))).otherwise(0.0)
    return df.groupBy(*by).agg(F.count(y).alias("n"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), F.coalesce(r2, F.lit(0.0)).alias("r2"))


def trend(df: DataFrame, by: Sequence[str], order: str, value: str, lower_is_better: bool = True, stable_pct: float = 5.0, least_r2: float = 0.7) -> DataFrame:
    """Least squares over places 0..n-1, change from first to last, direction, and points with |z| > 2; two points at least."""
    p = indexed(df, by, order, value)
    x, y = F.col("i").cast("double"), F.col("v")
    fit = regression(p, by, x, y)
    ends = p.groupBy(*by).agg(F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    z = p.join(ends, list(by)).groupBy(*by).agg(F.count_if((F.col("std") > 0) & (F.abs(F.col("v") - F.col("mean")) / F.col("std") > 2)).alias("anomalies"))
    out = fit.join(ends, list(by)).join(z, list(by)).filter("n >= 2").withColumn("change_pct", change_percent(F.col("first"), F.col("last")))
    worse = F.col("slope") > 0 if lower_is_better else F.col("slope") < 0
    direction = F.when(F.abs("change_pct") < stable_pct, "stable").when(F.col("r2") < least_r2, "unknown").when(worse, "degrading").otherwise("improving")
    return out.withColumn("direction", direction)


def trend_confidence(r2: Column, n: Column) -> Column:
    return 0.7 * r2 + 0.3 * F.least(F.lit(1.0), n / 30)


def timed_trend(df: DataFrame, by: Sequence[str], ts: str, value: str, name: Column, least_r2: float = 0.3, stable_pct: float = 5.0) -> DataFrame:
    """Least squares over seconds since the first point: slope a day, volatility, direction by the metric's name, confidence; five points at least."""
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    p = df.withColumn("__s", s).withColumn("__s", F.col("__s") - F.min("__s").over(W.partitionBy(*by))).withColumn("__v", F.col(value).cast("double"))
    fit = regression(p, by, F.col("__s"), F.col("__v"))
    more = p.groupBy(*by).agg(F.min_by("__v", ts).alias("first"), F.max_by("__v", ts).alias("last"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))
    out = fit.join(more, list(by)).filter("n >= 5")
    out = out.withColumn("slope_per_day", F.col("slope") * 86400).withColumn("volatility", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0))
    out = out.withColumn("change_pct", change_percent(F.col("first"), F.col("last")))
    slow = F.lit(False)
    for word in LATENCY_NAMES:
        slow = slow | F.lower(name).contains(word)
    up = F.when(slow, "degrading").otherwise("improving")
    down = F.when(slow, "improving").otherwise("degrading")
    flat = F.abs("change_pct") < stable_pct
    direction = F.when(flat, "stable").when(F.col("r2") < least_r2, "unknown").when(F.col("slope") > 0, up).otherwise(down)
    return out.withColumn("direction", direction).withColumn("confidence", trend_confidence(F.col("r2"), F.col("n")))


def compare_means(before: DataFrame, after: DataFrame, by: Sequence[str], value: str, lower_is_better: bool = True, stable_pct: float = 5.0) -> DataFrame:
    a, b = before.groupBy(*by).agg(F.avg(value).alias("before")), after.groupBy(*by).agg(F.avg(value).alias("after"))
    out = a.join(b, list(by)).withColumn("change_pct", change_percent(F.col("before"), F.col("after")))
    worse = F.col("change_pct") > 0 if lower_is_better else F.col("change_pct") < 0
    return out.withColumn("direction", F.when(F.abs("change_pct") < stable_pct, "stable").when(worse, "degrading").otherwise("improving"))


def change_points(df: DataFrame, by: Sequence[str], order: str, value: str, window: int = 10, threshold: float = 2.0) -> DataFrame:
    """Points where the means of the ``window`` values before and after differ by ``threshold`` pooled deviations."""
    p = indexed(df, by, order, value)
    w = W.partitionBy(*by).orderBy(order)
    b, a = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    p = p.select(*by, order, "i", "n", F.avg("v").over(b).alias("mb"), F.avg("v").over(a).alias("ma"), F.var_pop("v").over(b).alias("vb"), F.var_pop("v").over(a).alias("va"))
    p = p.filter((F.col("i") >= window) & (F.col("i") < F.col("n") - window)).withColumn("pooled", F.sqrt((F.col("vb") + F.col("va")) / 2))
    return p.filter("pooled > 0").withColumn("magnitude", F.abs(F.col("ma") - F.col("mb")) / F.col("pooled")).filter(F.col("magnitude") >= threshold).select(*by, order, "i", "magnitude")


def linear_forecast(df: DataFrame, by: Sequence[str], order: str, value: str, periods: int = 7, t: float = 1.96) -> DataFrame:
    """Prediction and interval of the next ``periods`` places: t * se * sqrt(1 + 1/n + (x - mean)^2 / Sxx)."""
    p = indexed(df, by, order, value).withColumn("x", F.col("i").cast("double"))
    x, y = F.col("x"), F.col("v")
    f = p.groupBy(*by).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.max(x).alias("last"))
    f = f.filter("n >= 3").withColumn("se", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)))
    f = f.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn("xf", F.col("last") + F.col("step"))
    half = F.lit(t) * F.col("se") * F.sqrt(1 + 1 / F.col("n") + (F.col("xf") - F.col("mx")) * (F.col("xf") - F.col("mx")) / F.col("sxx"))
    return f.withColumn("predicted", F.col("slope") * F.col("xf") + F.col("intercept")).select(*by, "step", "predicted", (F.col("predicted") - half).alias("lower"), (F.col("predicted") + half).alias("upper"))


def moving_average_forecast(df: DataFrame, by: Sequence[str], order: str, value: str, periods: int = 7, t: float = 1.96, window: int = 7) -> DataFrame:
    p = indexed(df, by, order, value).filter(F.col("i") >= F.col("n") - window)
    f = p.groupBy(*by).agg(F.avg("v").alias("predicted"), F.stddev_pop("v").alias("sd")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    half = F.lit(t) * F.col("sd") * F.sqrt(1 + F.col("step") * 0.05)
    return f.select(*by, "step", "predicted", (F.col("predicted") - half).alias("lower"), (F.col("predicted") + half).alias("upper"))


def holt_forecast(df: DataFrame, by: Sequence[str], order: str, value: str, periods: int = 7, alpha: float = 0.3, beta: float = 0.1, t: float = 1.96) -> DataFrame:
    """Double exponential smoothing; a fold over each ordered series (smoothing has no closed window form)."""
    p = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("a"))
    n, first, last = F.size("a"), F.element_at("a", 1), F.element_at("a", -1)
    zero = F.struct(first.alias("level"), F.when(n > 1, (last - first) / n).otherwise(0.0).alias("trend"), F.lit(0.0).alias("sse"))

    def step(s: Column, v: Column) -> Column:
        level = alpha * v + (1 - alpha) * (s["level"] + s["trend"])
        slope = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        miss = v - (level + slope)
        return F.struct(level.alias("level"), slope.alias("trend"), (s["sse"] + miss * miss).alias("sse"))

    f = p.withColumn("s", F.aggregate(F.slice("a", 2, F.greatest(n, F.lit(1))), zero, step)).withColumn("se", F.sqrt(F.col("s.sse") / n)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    f = f.withColumn("predicted", F.col("s.level") + F.col("step") * F.col("s.trend"))
    half = F.lit(t) * F.col("se") * F.sqrt(1 + F.col("step") * 0.1)
    return f.select(*by, "step", "predicted", (F.col("predicted") - half).alias("lower"), (F.col("predicted") + half).alias("upper"))


def median_gap(df: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Median positive distance of neighbours in seconds, a day where there is none."""
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    g = df.select(*by, (s - F.lag(s).over(W.partitionBy(*by).orderBy(ts))).alias("g"))
    return g.groupBy(*by).agg(F.coalesce(F.percentile(F.when(F.col("g") > 0, F.col("g")), F.lit(0.5)), F.lit(86400.0)).alias("interval_s"))


def centred_average(df: DataFrame, by: Sequence[str], order: str, value: str, period: int) -> DataFrame:
    """Trend of a seasonal series: centred moving average, 2 x N for even periods; null at the ends."""
    p = indexed(df, by, order, value)
    w, h = W.partitionBy(*by).orderBy(order), period // 2
    if period % 2:
        t = F.avg("v").over(w.rowsBetween(-h, h))
    else:
        t = (F.sum("v").over(w.rowsBetween(-h, h - 1)) + F.sum("v").over(w.rowsBetween(-h + 1, h))) / (2 * period)
    return p.withColumn("trend", F.when((F.col("i") >= h) & (F.col("i") < F.col("n") - h), t))


def seasonal(df: DataFrame, by: Sequence[str], order: str, value: str, period: int) -> DataFrame:
    """Trend, seasonal (median of each phase, centred) and residual; three cycles at least."""
    p = centred_average(df, by, order, value, period).filter(F.col("n") >= 3 * period).withColumn("phase", F.col("i") % period)
    m = p.groupBy(*by, "phase").agg(F.percentile(F.col("v") - F.col("trend"), F.lit(0.5)).alias("m"))
    m = m.withColumn("seasonal", F.col("m") - F.avg("m").over(W.partitionBy(*by))).drop("m")
    return p.join(m, [*by, "phase"]).select(*by, order, "i", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("residual"))


# anomalies


def z_severity(z: Column) -> Column:
    return F.when(z >= 5, "critical").when(z >= 4, "high").when(z >= 3, "medium").when(z >= 2, "low").otherwise("info")


def iqr_severity(d: Column) -> Column:
    return F.when(d >= 3, "critical").when(d >= 2, "high").when(d >= 1.5, "medium").when(d >= 1, "low").otherwise("info")


def z_confidence(z: Column) -> Column:
    return F.least(F.lit(0.99), 1 - F.exp(-F.abs(z) / 2))


def baseline(df: DataFrame, by: Sequence[str], value: str, multiplier: float = 1.5) -> DataFrame:
    """n, mean, median, std, min, max, p5..p99, iqr and fences."""
    v = F.col(value).cast("double")
    a = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.lit([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])).alias("p"))
    names = ("p5", "p25", "median", "p75", "p95", "p99")
    a = a.select(*by, "n", "mean", "std", "min", "max", *[F.col("p")[i].alias(x) for i, x in enumerate(names)]).withColumn("iqr", F.col("p75") - F.col("p25"))
    return a.withColumn("lower_fence", F.col("p25") - multiplier * F.col("iqr")).withColumn("upper_fence", F.col("p75") + multiplier * F.col("iqr"))


def anomalies(df: DataFrame, base: DataFrame, by: Sequence[str], key: str, value: str, method: str = "combined", z: float = 3.0, least: int = 10) -> DataFrame:
    """Points beyond ``z`` deviations and / or the fences of their baseline (join on ``by``; "iqr": severity and confidence by the distance from the fence in IQRs); none where it has fewer than ``least`` points."""
    p = df.select(*by, key, F.col(value).cast("double").alias("v")).join(base.filter(F.col("n") >= least), list(by))
    score = F.when(F.col("std") > 0, F.abs(F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)
    out = (F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))
    chosen = {"zscore": score >= z, "iqr": out, "combined": (score >= z) | out}[method]
    kind = F.when(F.col("v") > F.col("mean"), "spike").otherwise("drop")
    severity, confidence = z_severity(F.col("z")), z_confidence(F.col("z"))
    if method == "iqr":
        beyond = F.greatest(F.col("v") - F.col("upper_fence"), F.col("lower_fence") - F.col("v"))
        far = F.when(F.col("iqr") > 0, beyond / F.col("iqr")).otherwise(0.0)
        kind, severity, confidence = F.when(F.col("v") > F.col("upper_fence"), "spike").otherwise("drop"), iqr_severity(far), F.least(F.lit(0.99), 0.5 + far * 0.1)
    return p.withColumn("z", score).filter(chosen).select(*by, key, "v", "z", kind.alias("kind"), severity.alias("severity"), confidence.alias("confidence"))


def split_window_mad(df: DataFrame, by: Sequence[str], order: str, value: str, k: float = 3.0, segment: int = 5) -> DataFrame:
    """A step at the place of the largest |sum of (x - mean)|, if medians differ by more than k MADs of the left part."""
    p = indexed(df, by, order, value).filter(F.col("n") >= 2 * segment)
    p = p.withColumn("d", F.col("v") - F.avg("v").over(W.partitionBy(*by))).withColumn("c", F.abs(F.sum("d").over(W.partitionBy(*by).orderBy(order))))
    ok = (F.col("i") + 1 >= segment) & (F.col("i") + 1 <= F.col("n") - segment) & (F.col("i") < F.col("n") - 1)
    at = p.filter(ok).groupBy(*by).agg((F.max_by("i", F.struct("c", -F.col("i"))) + 1).alias("split"))
    q = p.join(at, list(by)).withColumn("left", F.col("i") < F.col("split"))
    med = q.groupBy(*by, "split").agg(F.percentile(F.when(F.col("left"), F.col("v")), F.lit(0.5)).alias("ml"), F.percentile(F.when(~F.col("left"), F.col("v")), F.lit(0.5)).alias("mr"))
    mad = q.filter("left").join(med, [*by, "split"]).groupBy(*by).agg(F.percentile(F.abs(F.col("v") - F.col("ml")), F.lit(0.5)).alias("mad"))
    out = med.join(mad, list(by)).withColumn("magnitude", F.col("mr") - F.col("ml"))
    hit = F.when(F.col("mad") > 0, F.abs("magnitude") / F.col("mad") > k).otherwise(F.abs("magnitude") > 0)
    return out.select(*by, hit.alias("detected"), F.when(hit, F.col("split")).alias("change_index"), "magnitude", F.when(F.col("mad") > 0, F.abs("magnitude") / F.col("mad")).alias("mad_units"))


def cusum(df: DataFrame, by: Sequence[str], order: str, value: str, kappa: float = 0.5, h: float = 5.0, share: float = 0.5, least: int = 10) -> DataFrame:
    """First alarm of the two-sided CUSUM; S = max(0, S + d) is the running sum less its running minimum, so windows do."""
    p = indexed(df, by, order, value).withColumn("ref", F.greatest(F.lit(least), F.floor(F.col("n") * share))).filter((F.col("n") >= least + 5) & (F.col("ref") < F.col("n")))
    w = W.partitionBy(*by)
    r = F.when(F.col("i") < F.col("ref"), F.col("v"))
    p = p.withColumn("mu", F.avg(r).over(w)).withColumn("sd", F.stddev_samp(r).over(w)).withColumn("sd", F.when(F.col("sd") == 0, 1e-12).otherwise(F.col("sd")))
    o = w.orderBy(order)
    for s, d in (("hi", F.col("v") - F.col("mu")), ("lo", F.col("mu") - F.col("v"))):
        p = p.withColumn(s, F.sum(d - kappa * F.col("sd")).over(o))
    for s in ("hi", "lo"):
        p = p.withColumn(s, F.col(s) - F.least(F.lit(0.0), F.min(s).over(o)))
    alarm = (F.col("hi") > h * F.col("sd")) | (F.col("lo") > h * F.col("sd"))
    return p.groupBy(*by).agg(F.min(F.when(alarm, F.col("i"))).alias("alarm_index")).withColumn("detected", F.col("alarm_index").isNotNull())


def drift(df: DataFrame, by: Sequence[str], order: str, value: str, critical: float = 2.0, least: int = 10) -> DataFrame:
    """t statistic of the least-squares slope; ``critical``: its bound for drift."""
    p = indexed(df, by, order, value).withColumn("x", F.col("i").cast("double"))
    x, y = F.col("x"), F.col("v")
    f = p.groupBy(*by).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).filter(F.col("n") >= least)
    se = F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return f.select(*by, "n", "slope", (F.col("slope") / se).alias("t")).withColumn("detected", F.abs("t") > critical)


def compare_to_baseline(df: DataFrame, base: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Current mean, median and p99 against a baseline with change %, deviation score of the mean, and a status."""
    cur = df.groupBy(*by).agg(F.avg(value).alias("c_mean"), F.percentile(value, F.lit([0.5, 0.99])).alias("p"), F.count(value).alias("c_n"))
    j = cur.select(*by, "c_n", "c_mean", F.col("p")[0].alias("c_median"), F.col("p")[1].alias("c_p99")).join(base, list(by))
    for m, b in (("mean", "mean"), ("median", "median"), ("p99", "p99")):
        j = j.withColumn(f"{m}_change", change_percent(F.col(b), F.col(f"c_{m}")))
    worst = F.greatest(F.abs("mean_change"), F.abs("p99_change"))
    return j.select(*by, "c_n", "c_mean", "c_median", "c_p99", "mean_change", "median_change", "p99_change", deviation_score(F.col("c_mean")).alias("deviation"), F.when(worst >= 50, "critical").when(worst >= 25, "degraded").when(worst >= 10, "changed").otherwise("normal").alias("status"))


def deviation_score(v: Column) -> Column:
    """0.6 |z| + 0.4 distance beyond the fences in IQRs (columns of ``baseline``)."""
    z = F.when(F.col("std") > 0, F.abs(v - F.col("mean")) / F.col("std")).otherwise(0.0)
    beyond = F.when(F.col("iqr") > 0, F.greatest(F.col("p25") - v, v - F.col("p75"), F.lit(0.0)) / F.col("iqr")).otherwise(0.0)
    return 0.6 * z + 0.4 * beyond


def diff_in_diff(df: DataFrame, by: Sequence[str], value: str, treated: Column, post: Column) -> DataFrame:
    part = lambda a, b: F.avg(F.when(a & b, F.col(value)))
    return df.groupBy(*by).agg(((part(treated, post) - part(treated, ~post)) - (part(~treated, post) - part(~treated, ~post))).alias("effect"))


def without_cold_start(df: DataFrame, ts: str, deployed: Column, seconds: float = 180.0) -> DataFrame:
    """Samples outside of [deployed, deployed + seconds)."""
    s = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(deployed)
    return df.filter((s < 0) | (s >= F.lit(seconds * 1e6)))


# two samples


def two_samples(df: DataFrame, by: Sequence[str], value: str, after: Column) -> DataFrame:
    """Means, sample deviations, sizes, percentiles of both, Welch's t with its degrees of freedom, Cohen's d and Glass's delta."""
    v = F.col(value).cast("double")
    aggs = []
    for s, c in (("b", ~after), ("a", after)):
        x = F.when(c, v)
        aggs += [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"mean_{s}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std_{s}"), *[F.percentile(x, F.lit(p / 100)).alias(f"p{p}_{s}") for p in (50, 90, 99)], F.min(x).alias(f"min_{s}"), F.max(x).alias(f"max_{s}")]
    j = df.groupBy(*by).agg(*aggs)
    vb, va = F.col("std_b") * F.col("std_b") / F.col("n_b"), F.col("std_a") * F.col("std_a") / F.col("n_a")
    d = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt(((F.col("n_b") - 1) * F.col("std_b") * F.col("std_b") + (F.col("n_a") - 1) * F.col("std_a") * F.col("std_a")) / (F.col("n_a") + F.col("n_b") - 2))
    return j.withColumn("t", d / F.sqrt(va + vb)).withColumn("df", (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).withColumn("cohens_d", d / pooled).withColumn("glass_delta", d / F.col("std_b")).withColumn("change_pct", change_percent(F.col("mean_b"), F.col("mean_a")))


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, after: Column) -> DataFrame:
    """U of the first sample and its tie-corrected z, from mid-ranks over counted values (equal values are one row)."""
    v = df.groupBy(*by, F.col(value).alias("v")).agg(F.count_if(~after).alias("b"), F.count_if(after).alias("a"))
    w = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    c = F.col("a") + F.col("b")
    r = v.withColumn("rank", F.coalesce(F.sum(c).over(w), F.lit(0)) + (c + 1) / 2.0)
    s = r.groupBy(*by).agg(F.sum("b").alias("n1"), F.sum("a").alias("n2"), F.sum(F.col("rank") * F.col("b")).alias("r1"), F.sum(c.cast("double") * c * c - c).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(*by, "n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / sd).alias("z"))


def quick_regression(df: DataFrame, by: Sequence[str], value: str, after: Column, threshold: float = 10.0) -> DataFrame:
    return two_samples(df, by, value, after).select(*by, "change_pct", (F.col("change_pct") >= threshold).alias("regressed"))
