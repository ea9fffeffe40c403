"""Utilities and ratings of quality measures, SLO arithmetic, robust estimators, memory, I/O and schema differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# utilities in 0..1


def weighted_issues(df: DataFrame, by: Sequence[str], severity: str, weights: Mapping[str, float]) -> DataFrame:
    """Issues weighted by severity in units of a medium one; unknown severities count as medium."""
    w = F.lit(1.0)
    for s, x in weights.items():
        w = F.when(F.lower(severity) == s, x / weights["medium"]).otherwise(w)
    return df.groupBy(*by).agg(F.sum(w).alias("weighted"))


def complexity_utility(worst: Column, mean: Column, threshold: float = 15.0, k: float = 0.05) -> Column:
    leg = lambda c: F.exp(-k * F.greatest(c - threshold, F.lit(0.0)))
    return F.when(mean.isNull(), leg(worst)).otherwise(0.7 * leg(worst) + 0.3 * leg(mean))


def bounded_utility(pct: Column, invert: bool = False) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)) / 100
    return 1 - u if invert else u


def debt_utility(pct: Column) -> Column:
    return F.exp(-0.021 * F.greatest(pct, F.lit(0.0)))


def size_utility(lines: Column, middle: float = 600.0, k: float = 0.01) -> Column:
    return 1 - 1 / (1 + F.exp(-k * (F.greatest(lines, F.lit(0)) - middle)))


def cycle_utility(n: Column) -> Column:
    return F.exp(-0.15 * F.greatest(n, F.lit(0)))


def band_utility(x: Column, low: float, high: float, decay: float) -> Column:
    """0 at 0, rising to 1 at ``low``, 1 up to ``high``, then decaying; assertion density: 1, 10, .15; tests to code: .5, 4, .1."""
    return F.when(x <= 0, 0.0).when(x < low, x / low).when(x <= high, 1.0).otherwise(F.exp(-decay * (x - high)))


def risk_profile(files: DataFrame, by: Sequence[str], grade: str, lines: str) -> DataFrame:
    """Share of lines by grade."""
    g = files.groupBy(*by, grade).agg(F.sum(lines).alias("loc"))
    return g.withColumn("share", F.col("loc") / F.sum("loc").over(W.partitionBy(*by)))


def composite(df: DataFrame, by: Sequence[str], category: str, utility: str, weight: str) -> DataFrame:
    """Weighted mean within a category, then the geometric mean over categories."""
    c = df.groupBy(*by, category).agg((F.sum(F.col(utility) * F.col(weight)) / F.sum(weight)).alias("u"))
    return c.groupBy(*by).agg(F.exp(F.avg(F.ln(F.greatest(F.col("u"), F.lit(1e-6))))).alias("score"))


def posture(df: DataFrame, by: Sequence[str], p: str, weight: str) -> DataFrame:
    """Joint risk 1 - product(1 - p) and the weighted L3 norm."""
    return df.groupBy(*by).agg((1 - F.exp(F.sum(F.ln(1 - F.least(F.col(p), F.lit(0.999999)))))).alias("risk"), F.pow(F.sum(F.col(weight) * F.pow(F.col(p), F.lit(3.0))) / F.sum(weight), F.lit(1 / 3)).alias("l3"))


# SLO arithmetic


def derived_threshold(window_days: Column, share: float = 0.02, alert_hours: float = 1.0) -> Column:
    """Burn rate that spends ``share`` of the budget within the alert window."""
    return share / (alert_hours / (window_days * 24))


def full_outage_burn(target_pct: Column) -> Column:
    return 1 / (1 - target_pct / 100)


def detectable_outage_seconds(target_pct: Column, threshold: float, hours: float) -> Column:
    return threshold * hours * 3600 / full_outage_burn(target_pct)


def budget_impact(bad: Column, allowed: Column) -> Column:
    return F.when(allowed > 0, F.round(bad / allowed * 100, 4)).otherwise(0.0)


def nines(share: Column) -> Column:
    return -F.log10(F.greatest(1 - share, F.lit(1e-9)))


def uncalibrated(df: DataFrame, target_pct: str, achieved_pct: str) -> DataFrame:
    """Objectives overachieved by a whole nine or more."""
    return df.filter(nines(F.col(achieved_pct) / 100) >= nines(F.col(target_pct) / 100) + 1)


def canary_seconds(rps: Column, share: float, cv: float, effect: float) -> Column:
    return 8 / (rps * share * (1 - share)) * (cv / effect) ** 2


# robust estimators; pairs come from at most ``most`` rows a side and key, chosen by hash


def _bounded(df: DataFrame, by: Sequence[str], key: str, most: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("__r", r).filter(F.col("__r") <= most)


def hodges_lehmann(df: DataFrame, by: Sequence[str], key: str, value: str, after: Column, most: int = 250) -> DataFrame:
    """Median of the pairwise differences after - before."""
    b = _bounded(df.filter(~after), by, key, most).select(*by, F.col(value).alias("x"))
    a = _bounded(df.filter(after), by, key, most).select(*by, F.col(value).alias("y"))
    return b.join(a, list(by)).groupBy(*by).agg(F.percentile(F.col("y") - F.col("x"), F.lit(0.5)).alias("shift"))


def theil_sen(df: DataFrame, by: Sequence[str], key: str, x: str, y: str, most: int = 200) -> DataFrame:
    """Median slope of pairs, and the 75th percentile of what lies above it as base."""
    s = _bounded(df, by, key, most).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    o = s.withColumnsRenamed({"x": "x2", "y": "y2"})
    m = s.join(o, list(by)).filter("x2 > x").groupBy(*by).agg(F.percentile((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x")), F.lit(0.5)).alias("slope"))
    return s.join(m, list(by)).groupBy(*by, "slope").agg(F.percentile(F.col("y") - F.col("slope") * F.col("x"), F.lit(0.75)).alias("base"))


def bootstrap(df: DataFrame, by: Sequence[str], value: str, after: Column, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Interval of the difference of means from Poisson weights: rows never move, each round is a pair of weighted sums."""
    cuts = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
    rows = df.select(*by, F.col(value).alias("v"), after.alias("a"), F.monotonically_increasing_id().alias("row"))
    p = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    h = (F.pmod(F.xxhash64(F.col("k") + seed, "row"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    p = p.withColumn("h", h).withColumn("w", sum((F.when(F.col("h") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("v") * F.col("w"))), F.sum(F.when(c, F.col("w"))))
    d = p.groupBy(*by, "k").agg((mean(F.col("a")) - mean(~F.col("a"))).alias("d"))
    return d.groupBy(*by).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("p_above"))


def bimodality(df: DataFrame, by: Sequence[str], value: str, valley: float = 0.5, least: int = 30, share: float = 0.1) -> DataFrame:
    """Whether a smoothed histogram of min(40, max(8, sqrt n)) bins has two peaks with a valley below ``valley`` of the lower
    one and ``share`` of the values on each side; split: the valley's middle.  Bins, at most 40 a key, are what is joined."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).filter((F.col("n") >= least) & (F.col("hi") > F.col("lo")))
    s = s.withColumn("bins", F.greatest(F.lit(8), F.least(F.lit(40), F.floor(F.sqrt("n")).cast("int")))).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    c = df.join(s, list(by)).groupBy(*by, place.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    grid = s.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).join(c, [*by, "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    o = W.partitionBy(*by).orderBy("b")
    g = grid.withColumn("s", (F.coalesce(F.lag("c").over(o), F.col("c")) + F.col("c") + F.coalesce(F.lead("c").over(o), F.col("c"))) / 3.0)
    g = g.withColumn("below", F.sum("c").over(o)).withColumn("peak", (F.col("s") > F.coalesce(F.lag("s").over(o), F.lit(-1.0))) & (F.col("s") >= F.coalesce(F.lead("s").over(o), F.lit(-1.0))) & (F.col("s") > 0))
    pk = g.filter("peak")
    pairs = pk.select(*by, F.col("b").alias("b1"), F.col("s").alias("s1")).join(pk.select(*by, F.col("b").alias("b2"), F.col("s").alias("s2")), list(by)).filter("b2 > b1 + 1")
    between = pairs.join(g.select(*by, "b", "s"), list(by)).filter("b > b1 and b < b2").groupBy(*by, "b1", "b2", "s1", "s2").agg(F.min(F.struct("s", "b")).alias("v"))
    best = between.withColumn("ratio", F.col("v.s") / F.least("s1", "s2")).groupBy(*by).agg(F.min(F.struct("ratio", "b1", "b2", F.col("v.b").alias("at"))).alias("x"))
    j = s.join(best, list(by), "left").withColumn("split", F.col("lo") + (F.col("x.at") + 0.5) * F.col("width"))
    sides = df.join(j.select(*by, "split"), list(by)).groupBy(*by).agg(F.count_if(F.col(value) <= F.col("split")).alias("low_n"), F.count_if(F.col(value) > F.col("split")).alias("high_n"))
    ok = (F.col("x.ratio") < valley) & (F.col("low_n") >= F.greatest(F.lit(3), F.floor(share * F.col("n")))) & (F.col("high_n") >= F.greatest(F.lit(3), F.floor(share * F.col("n"))))
    return j.join(sides, list(by)).select(*by, "n", F.col("x.ratio").alias("valley_ratio"), "split", "low_n", "high_n", F.coalesce(ok, F.lit(False)).alias("bimodal"))


# memory, I/O, network


def memory(df: DataFrame, by: Sequence[str], used: Column, total: Column, available: Column, faults: Column) -> DataFrame:
    """Usage by what is available where known, else by what is used; major faults are saturation."""
    pct = F.when(total > 0, F.when(available.isNotNull(), (1 - available / total) * 100).otherwise(used / total * 100)).otherwise(0.0)
    g = df.groupBy(*by).agg(F.avg(pct).alias("usage_pct"), F.max(faults).alias("faults"))
    return g.withColumn("status", F.when((F.col("usage_pct") >= 95) | (F.col("faults") > 100), "critical").when(F.col("usage_pct") >= 85, "warning").otherwise("healthy"))


def disk_io(df: DataFrame, by: Sequence[str], read: Column, written: Column, ops: Column, wait_ms: Column, seconds: float) -> DataFrame:
    g = df.groupBy(*by).agg((F.sum(ops) / seconds).alias("iops"), (F.sum(read + written) / (1024 * 1024) / seconds).alias("mb_s"), F.avg(wait_ms).alias("await_ms"))
    return g.withColumn("status", F.when(F.col("await_ms") > 50, "critical").when(F.col("await_ms") > 20, "warning").otherwise("healthy"))


def congestion(df: DataFrame, by: Sequence[str], order: str, value: str, ratio: float = 1.5) -> DataFrame:
    """Variance of the second half above ``ratio`` times the first's; skew: any negative one-way value."""
    w = W.partitionBy(*by)
    p = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w))
    half = F.col("__i") <= F.floor(F.col("__n") / 2)
    g = p.groupBy(*by).agg(F.var_pop(F.when(half, F.col(value))).alias("first"), F.var_pop(F.when(~half, F.col(value))).alias("second"), F.count_if(F.col(value) < 0).alias("negative"))
    return g.withColumn("congested", F.col("second") > ratio * F.col("first")).withColumn("skewed", F.col("negative") > 0).drop("negative")


# schemas as rows

_WIDER = {"int": ("int", "long", "float", "double"), "long": ("long", "float", "double"), "float": ("float", "double"), "double": ("double",), "string": ("string", "bytes"), "bytes": ("bytes", "string")}


def promotable(old: Column, new: Column) -> Column:
    """int -> long -> float -> double, string <-> bytes, and equal types."""
    ok = old == new
    for a, b in _WIDER.items():
        ok = ok | ((old == a) & new.isin(*b))
    return ok


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns (table_name, column_name, type) added, dropped, changed (compatibly or not)."""
    a, b = old.withColumnRenamed("type", "old_type"), new.withColumnRenamed("type", "new_type")
    j = a.join(b, ["table_name", "column_name"], "full")
    return j.withColumn("change", F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped").when(F.col("old_type") == F.col("new_type"), "same").when(promotable(F.col("old_type"), F.col("new_type")), "compatible").otherwise("breaking"))
