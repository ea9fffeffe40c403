"""SLIs, error budgets, burn rates, incidents and budget policies over (service, ts, good, total, rejected) rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _us(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def history(sli: DataFrame, service: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of a service within [start, end], both ends inclusive."""
    out = sli if service is None else sli.filter(F.col("service") == service)
    out = out if start is None else out.filter(F.col("ts") >= start)
    return out if end is None else out.filter(F.col("ts") <= end)


def latest(sli: DataFrame) -> DataFrame:
    """The last row of each service."""
    rest = [c for c in sli.columns if c != "service"]
    return sli.groupBy("service").agg(F.max_by(F.struct(*rest), "ts").alias("x")).select("service", "x.*")


def rates(sli: DataFrame, by: Sequence[str]) -> DataFrame:
    g = sli.groupBy(*by).agg(F.sum("good").alias("good"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("measurements"))
    g = g.withColumn("bad", F.col("total") - F.col("good"))
    ok = F.col("total") > 0
    return g.withColumn("success_rate", F.when(ok, F.col("good") / F.col("total")).otherwise(0.0)).withColumn("failure_rate", F.when(ok, F.col("bad") / F.col("total")).otherwise(0.0))


def by_period(sli: DataFrame, hours: int) -> DataFrame:
    """Buckets aligned to the epoch."""
    start = F.timestamp_seconds(F.floor(_us("ts") / (3600 * 10**6 * hours)) * 3600 * hours)
    return rates(sli.withColumn("period", start), ["service", "period"])


def error_budget(sli: DataFrame, by: Sequence[str], target: float, start: Column, end: Column) -> DataFrame:
    """SLI, allowed failures, remaining and consumed % of the window [start, end], and a status; no events: unknown."""
    w = (F.col("ts") >= start) & (F.col("ts") <= end)
    g = sli.groupBy(*by).agg(*[F.sum(F.when(w, F.col(c)).otherwise(0)).alias(c) for c in ("good", "total", "rejected")])
    g = g.withColumn("bad", F.greatest(F.lit(0), F.col("total") - F.col("good") - F.col("rejected")))
    g = g.withColumn("allowed", F.col("total") * (100 - target) / 100).withColumn("remaining", F.col("allowed") - F.col("bad"))
    used = F.when(F.col("allowed") > 0, F.col("bad") / F.col("allowed") * 100).otherwise(0.0)
    g = g.withColumn("consumed_pct", used).withColumn("sli", F.when(F.col("total") > 0, F.col("good") / F.col("total") * 100).otherwise(0.0))
    return g.withColumn("status", F.when(F.col("total") == 0, "unknown").when(F.col("consumed_pct") >= 100, "breached").when(F.col("consumed_pct") >= 80, "at_risk").otherwise("compliant"))


def severity(burn: Column, critical: float = 14.4, warning: float = 6.0, elevated: float = 1.0) -> Column:
    return F.when(burn >= critical, "critical").when(burn >= warning, "warning").when(burn >= elevated, "elevated").otherwise("normal")


def _spent() -> Column:
    return F.col("total") - F.col("good") - F.coalesce("rejected", F.lit(0))


def _bad(spent: Column) -> Column:
    return F.greatest(F.sum(spent), F.lit(0).cast("long"))


def burn_rate(sli: DataFrame, by: Sequence[str], target: float, now: Column, hours: float) -> DataFrame:
    """Failure rate of the last ``hours``, both ends inclusive, over the budgeted share; rejections don't burn budget."""
    w = (_us("ts") >= _us(now) - int(hours * 3.6e9)) & (_us("ts") <= _us(now))
    g = sli.groupBy(*by).agg(F.sum(F.when(w, F.col("total")).otherwise(0)).alias("total"), _bad(F.when(w, _spent()).otherwise(0)).alias("bad"))
    rate = F.when(F.col("total") > 0, F.col("bad") / F.col("total")).otherwise(0.0) / ((100 - target) / 100)
    return g.withColumn("burn_rate", rate).withColumn("severity", severity(F.col("burn_rate")))


TIERS = (("page", 1.0, 5 / 60, 14.4), ("page", 6.0, 0.5, 6.0), ("ticket", 72.0, 6.0, 1.0))


def alert_policy(sli: DataFrame, by: Sequence[str], target: float, now: Column, tiers: Sequence[tuple[str, float, float, float]] = TIERS) -> DataFrame:
    """Each tier fires where both its windows burn at the threshold and the long one has enough traffic; all windows in one pass."""
    us, end = _us("ts"), _us(now)
    aggs = []
    for i, (_, long, short, _) in enumerate(tiers):
        for s, h in (("l", long), ("s", short)):
            w = (us >= end - int(h * 3.6e9)) & (us <= end)
            aggs += [F.sum(F.when(w, F.col("total")).otherwise(0)).alias(f"t{s}{i}"), _bad(F.when(w, _spent()).otherwise(0)).alias(f"b{s}{i}")]
    g = sli.groupBy(*by).agg(*aggs)
    rate = lambda s, i: F.when(F.col(f"t{s}{i}") > 0, F.col(f"b{s}{i}") / F.col(f"t{s}{i}")).otherwise(0.0) / ((100 - target) / 100)
    rows = [F.struct(F.lit(i).alias("tier"), F.lit(a).alias("action"), rate("l", i).alias("long_burn"), rate("s", i).alias("short_burn"), (F.col(f"tl{i}") >= minimum_traffic(target)).alias("enough"), F.lit(t).alias("threshold")) for i, (a, _, _, t) in enumerate(tiers)]
    out = g.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    return out.withColumn("fires", (F.col("long_burn") >= F.col("threshold")) & (F.col("short_burn") >= F.col("threshold")) & F.col("enough"))


def minimum_traffic(target: float) -> int:
    return math.ceil(round(10 / (1 - target / 100), 6))


def burn_history(sli: DataFrame, by: Sequence[str], target: float, start: Column, steps: int, step_hours: int, window_hours: int) -> DataFrame:
    """Burn rate at each step over overlapping windows, both ends inclusive: a row goes to the few steps whose window holds it (no cross join)."""
    step, window = step_hours * 3600 * 10**6, window_hours * 3600 * 10**6
    at = _us("ts") - _us(start)
    first, last = F.greatest(F.ceil(at / step), F.lit(0)), F.least(F.floor((at + window) / step), F.lit(steps - 1))
    rows = sli.withColumn("step", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    g = rows.groupBy(*by, "step").agg(F.sum("total").alias("total"), _bad(_spent()).alias("bad"))
    return g.withColumn("burn_rate", F.when(F.col("total") > 0, F.col("bad") / F.col("total")).otherwise(0.0) / ((100 - target) / 100)).withColumn("severity", severity(F.col("burn_rate")))


def incidents(burns: DataFrame, by: Sequence[str], order: str, step_hours: float = 1.0, least_hours: float = 0.5) -> DataFrame:
    """Runs of critical or warning steps (gaps and islands), from the first of them to the first good step after.

    Runs shorter than ``least_hours`` and one still open at the end aren't reported.
    """
    w = W.partitionBy(*by).orderBy(order)
    p = burns.withColumn("bad_", F.col("severity").isin("critical", "warning")).withColumn("next_", F.lead(order).over(w))
    p = p.withColumn("new_", (F.col("bad_") & ~F.coalesce(F.lag("bad_").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("new_").over(w))
    critical = F.max(F.when(F.col("severity") == "critical", 1).otherwise(0))
    g = p.filter("bad_").groupBy(*by, "run").agg(F.min(order).alias("first"), F.max_by("next_", order).alias("ended"), F.count(F.lit(1)).alias("steps"), F.max("burn_rate").alias("peak"), critical.alias("c"))
    long_enough = (F.col("ended") - F.col("first")) * step_hours >= least_hours
    return g.filter(long_enough).select(*by, "first", "ended", "steps", "peak", F.when(F.col("c") == 1, "critical").otherwise("warning").alias("severity"))


def daily_budgets(sli: DataFrame, by: Sequence[str], target: float, now: Column, days: int = 30) -> DataFrame:
    """Error budget of each of the last ``days`` days counted back from ``now``, both ends of a day inclusive; days without rows are left out."""
    day = 86_400_000_000
    back = _us(now) - _us("ts")
    first, last = F.greatest(F.ceil(back / day) - 1, F.lit(0)), F.least(F.floor(back / day), F.lit(days - 1))
    held = sli.filter(back >= 0).withColumn("day", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))))
    return error_budget(held, [*by, "day"], target, F.lit(0).cast("timestamp"), now)


def hours_to_exhaustion(burn: Column, window_hours: float) -> Column:
    return F.when(burn > 1, window_hours / burn)


def policy_tier(remaining_pct: Column) -> Column:
    return F.when(remaining_pct > 50, "normal").when(remaining_pct > 25, "caution").when(remaining_pct > 0, "freeze").otherwise("exhausted")


def nlogn(units: Column) -> Column:
    return F.when(units <= 1, units.cast("double")).otherwise(units * F.log2(units.cast("double")))


def latency_budget(df: DataFrame, by: Sequence[str], duration: Column, cost: Column, base: float, per_unit: float) -> DataFrame:
    """Share of requests within base + cost * per_unit."""
    ok = duration <= base + F.greatest(cost, F.lit(0)) * per_unit
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("pass_rate"))


def portfolio(rows: DataFrame, success: str, burn: str, weight: str, centrality: str) -> DataFrame:
    """Customer index (weighted success * 100) and reliability index (weighted min(100, 100 / burn))."""
    w, c = F.greatest(F.col(weight), F.lit(0.0)), F.greatest(F.col(centrality), F.lit(0.0))
    score = F.when(F.col(burn) <= 1, 100.0).otherwise(100.0 / F.col(burn))
    mean = lambda v, k: F.coalesce(F.try_divide(F.sum(v * k), F.sum(k)), F.avg(v))
    return rows.agg((mean(F.col(success), w) * 100).alias("cxi"), mean(score, c).alias("sri"))


def overlap_recall(events: DataFrame, found: DataFrame, id: str, ts: str, hours: float = 1.0) -> DataFrame:
    """Share of events with a finding within +- ``hours``: an equi join on buckets of that width and their neighbours."""
    width = int(hours * 3.6e9)
    a = events.select(F.col(id).alias("id"), _us(ts).alias("t")).withColumn("b", F.explode(F.array(*[F.floor(F.col("t") / width) + d for d in (-1, 0, 1)])))
    f = found.select(_us(ts).alias("u")).withColumn("b", F.floor(F.col("u") / width))
    hit = a.join(f, "b").filter(F.abs(F.col("t") - F.col("u")) <= width).select("id").distinct().withColumn("hit", F.lit(1.0))
    return events.select(F.col(id).alias("id")).distinct().join(hit, "id", "left").agg(F.count(F.lit(1)).alias("incidents"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
