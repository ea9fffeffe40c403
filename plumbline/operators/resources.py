"""Database, cache, network, system and web performance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# database


def query_fingerprint(sql: Column) -> Column:
    """Literals and IN lists become ?, white space collapses, upper case."""
    x = F.regexp_replace(sql, r"'(?:[^'\\]|\\.)*'", "?")
    x = F.regexp_replace(x, r"(?i)\bIN\s*\([^)]*\)", "IN (?)")
    x = F.regexp_replace(x, r"(?<!\w)-?\d+(?:\.\d+)?(?!\w)", "?")
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def query_metrics(df: DataFrame, by: Sequence[str], ms: str, examined: Column, affected: Column, indexed: Column, slow: float = 100.0) -> DataFrame:
    p = F.percentile(ms, F.lit([0.5, 0.95, 0.99]))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), p.alias("p"), F.max(ms).alias("max"), F.min(ms).alias("min"), F.count_if(F.col(ms) > slow).alias("slow"), (F.avg(F.when(indexed, 1.0).otherwise(0.0)) * 100).alias("index_pct"), (F.sum(examined) / F.greatest(F.sum(affected), F.lit(1))).alias("examined_per_row"))
    return g.select(*by, "n", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max", "min", "slow", "index_pct", "examined_per_row")


def shift_in_mads(df: DataFrame, base: DataFrame, by: Sequence[str], value: str, most: float = 3.0) -> DataFrame:
    """Shift of the median against a baseline in units of 1.4826 * MAD."""
    m = base.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("base_median"))
    mad = base.join(m, list(by)).groupBy(*by, "base_median").agg((F.percentile(F.abs(F.col(value) - F.col("base_median")), F.lit(0.5)) * 1.4826).alias("spread"))
    cur = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    out = cur.join(mad, list(by)).withColumn("shift", F.when(F.col("spread") > 0, (F.col("median") - F.col("base_median")) / F.col("spread")))
    return out.withColumn("shifted", F.coalesce(F.abs("shift") > most, F.lit(False)))


def pool_size(arrivals_per_s: Column, service_s: Column, least: int = 5, cores: int = 1) -> Column:
    """ceil(arrival rate * service time / 0.7), ``least`` at least."""
    return F.greatest(F.ceil(arrivals_per_s * service_s / 0.7), F.lit(max(least, cores)).cast("long"))


def optimal_pool(concurrent: Column, query_ms: Column) -> Column:
    """Connections in use by Little's law and half as many again, at least the concurrent requests and 5."""
    return F.greatest(F.floor(concurrent * query_ms / 1000 * 1.5), concurrent.cast("long"), F.lit(5).cast("long"))


def per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(n / seconds, 2)).otherwise(0.0)


def megabytes_per_second(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / (1024 * 1024) / seconds).otherwise(0.0)


def capacity(load: Column, limit: Column) -> Column:
    """Utilisation (100 at most) and headroom (0 at least)."""
    return F.struct(F.least(F.lit(100.0), load / limit * 100).alias("utilisation"), F.greatest(F.lit(0.0), limit - load).alias("headroom"))


# cache


def cache_status(hit_pct: Column) -> Column:
    return F.when(hit_pct >= 95, "excellent").when(hit_pct >= 85, "good").when(hit_pct >= 70, "fair").otherwise("poor")


def cache_metrics(df: DataFrame, by: Sequence[str], hit: Column, ms: Column) -> DataFrame:
    """Hits, misses, hit %, status, and the latency that hits saved."""
    g = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.avg(F.when(hit, ms)).alias("hit_ms"), F.avg(F.when(~hit, ms)).alias("miss_ms"))
    g = g.withColumn("hit_pct", F.col("hits") / (F.col("hits") + F.col("misses")) * 100)
    return g.withColumn("saved_ms", F.col("hits") * F.coalesce(F.col("miss_ms") - F.col("hit_ms"), F.lit(0.0))).withColumn("status", cache_status(F.col("hit_pct")))


def uncacheable_keys(keys: DataFrame, least_misses: int = 20, most_pct: float = 10.0) -> DataFrame:
    """Keys with many misses and hardly a hit."""
    return keys.filter((F.col("misses") >= least_misses) & (F.col("hit_pct") < most_pct))


def stampedes(misses: DataFrame, key: str, ts_ms: Column, window_ms: float, most: int = 5) -> DataFrame:
    """The most misses of a key within any window of that length; flagged above ``most``."""
    w = W.partitionBy(key).orderBy("t").rangeBetween(-int(window_ms), 0)
    m = misses.select(key, ts_ms.cast("long").alias("t")).withColumn("c", F.count(F.lit(1)).over(w))
    return m.groupBy(key).agg(F.max("c").alias("worst")).withColumn("stampede", F.col("worst") > most)


def evictions(df: DataFrame, by: Sequence[str], reason: Column, age: Column, ttl: Column, seconds: float) -> DataFrame:
    early = age < ttl * 0.5
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("evicted"), (F.avg(F.when(early & (reason != "expired"), 1.0).otherwise(0.0)) * 100).alias("premature_pct"), (F.avg(F.when(reason == "lru", 1.0).otherwise(0.0)) * 100).alias("lru_pct"), (F.count(F.lit(1)) / seconds).alias("per_second"))
    return g.withColumn("status", F.when(F.col("premature_pct") > 30, "critical").when(F.col("premature_pct") > 20, "high").when(F.col("premature_pct") > 10, "moderate").otherwise("normal"))


def warmup(buckets: DataFrame, by: Sequence[str], order: str, drop: float = 15.0, grace: int = 3, flat: float = 0.5, collapse: float = 5.0, least: int = 3) -> DataFrame:
    """State of each hit-rate trajectory, with baseline (running best before the drop), drop and recovery slope.

    Buckets without traffic don't count.  Fewer than ``least``: insufficient_data; a rate below ``collapse`` at any time: collapsed; no rate more than
    ``drop`` points under the running best: stable; else the mean change over ``grace`` buckets from the first bucket of the fall
    that holds the lowest such rate says whether it's warming (above ``flat``) or flatlined.
    """
    w = W.partitionBy(*by).orderBy(order)
    b = buckets.filter(F.col("hits") + F.col("misses") > 0).withColumn("rate", F.col("hits") / (F.col("hits") + F.col("misses")) * 100)
    b = b.withColumn("at", F.row_number().over(w)).withColumn("best", F.max("rate").over(w.rowsBetween(W.unboundedPreceding, -1)))
    b = b.withColumn("gap", F.when(F.col("best") - F.col("rate") > drop, F.struct((-F.col("rate")).alias("low"), (-F.col("at")).alias("first"), "at", "best", "rate")))
    later = [F.lead("rate", k).over(w) for k in range(1, grace + 1)]
    reach = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in later), F.lit(0))
    b = b.withColumn("slope", F.when(reach > 0, (F.coalesce(*reversed(later)) - F.col("rate")) / reach).otherwise(0.0))
    begins = F.col("gap").isNotNull() & F.lag("gap").over(w).isNull()
    b = b.withColumn("slope", F.last(F.when(begins, F.col("slope")), ignorenulls=True).over(w))
    g = b.groupBy(*by).agg(F.count(F.lit(1)).alias("buckets"), F.min("rate").alias("least"), F.min_by("rate", "at").alias("start"), F.max("best").alias("top"), F.max(F.struct("gap", "slope")).alias("x"))
    fell = F.col("x.gap").isNotNull()
    state = F.when(F.col("buckets") < least, "insufficient_data").when(F.col("least") < collapse, "collapsed").when(~fell, "stable").when(F.col("x.slope") > flat, "warming").otherwise("flatlined")
    told = state.isin("warming", "flatlined")
    return g.select(*by, "buckets", state.alias("state"), F.when(told, F.col("x.gap.best") - F.col("x.gap.rate")).alias("drop_pct"), F.when(told, F.col("x.slope")).alias("recovery_slope"))


# network


def latency_status(mean: Column, loss_pct: Column) -> Column:
    return F.when((mean > 100) | (loss_pct > 5), "poor").when(mean > 50, "fair").otherwise("good")


def network_latency(df: DataFrame, by: Sequence[str], order: str, rtt: str, lost: Column) -> DataFrame:
    """Percentiles, jitter (mean difference of neighbours) and loss."""
    w = W.partitionBy(*by).orderBy(order)
    p = df.withColumn("__d", F.abs(F.col(rtt) - F.lag(rtt).over(w))).withColumn("__l", lost)
    g = p.groupBy(*by).agg(F.avg(rtt).alias("mean"), F.percentile(rtt, F.lit([0.5, 0.95, 0.99])).alias("p"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("jitter"), (F.avg(F.when(F.col("__l"), 1.0).otherwise(0.0)) * 100).alias("loss_pct"))
    return g.select(*by, "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "jitter", "loss_pct", latency_status(F.col("mean"), F.col("loss_pct")).alias("status"))


def bandwidth(df: DataFrame, by: Sequence[str], sent: Column, received: Column, seconds: float, limit_mbps: float) -> DataFrame:
    mbps = lambda c: F.sum(c) * 8 / 1e6 / seconds
    g = df.groupBy(*by).agg(mbps(sent).alias("up_mbps"), mbps(received).alias("down_mbps"))
    g = g.withColumn("total_mbps", F.col("up_mbps") + F.col("down_mbps")).withColumn("utilisation", F.col("total_mbps") / limit_mbps * 100)
    return g.withColumn("status", F.when(F.col("utilisation") > 90, "saturated").when(F.col("utilisation") > 70, "high").when(F.col("utilisation") > 30, "moderate").otherwise("low"))


def dns(df: DataFrame, overall: str, kind: str, ms: str, cached: Column, failed: Column) -> DataFrame:
    """Of all look-ups and of each record type, in one pass of grouping sets (kind is null for all)."""
    return df.withColumns({"__c": cached, "__f": failed}).groupingSets([[kind], []], kind).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), F.percentile(ms, F.lit(0.95)).alias("p95"), F.max(ms).alias("max"), (F.avg(F.when(F.col("__c"), 1.0).otherwise(0.0)) * 100).alias("cached_pct"), (F.avg(F.when(F.col("__f"), 1.0).otherwise(0.0)) * 100).alias("failed_pct"))


# system


def cpu(df: DataFrame, by: Sequence[str], idle: Column, steal: Column, load: Column, cores: Column) -> DataFrame:
    """Usage, steal band, load ratio, and the queueing multiplier 1 / (1 - rho)."""
    g = df.groupBy(*by).agg((100 - F.avg(idle)).alias("usage_pct"), F.avg(steal).alias("steal_pct"), F.avg(load / cores).alias("load_ratio"))
    rho = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("usage_pct") / 100))
    g = g.withColumn("queueing", 1 / (1 - rho)).withColumn("steal_band", F.when(F.col("steal_pct") > 5, "critical").when(F.col("steal_pct") > 2, "warning").otherwise("ok"))
    return g.withColumn("status", F.when((F.col("usage_pct") >= 95) | (F.col("steal_band") == "critical"), "critical").when((F.col("usage_pct") >= 80) | (F.col("steal_band") == "warning"), "warning").otherwise("healthy"))


def human_bytes(size: Column) -> Column:
    """Units of 1024, two digits."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    out = F.format_string("%.2f B", size.cast("double"))
    for i, u in enumerate(units[1:], 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.2f {u}", size / float(1024**i))).otherwise(out)
    return out


def psi(some10: Column, some300: Column, full10: Column) -> Column:
    """Severity and trajectory of pressure stall information."""
    level = F.when(full10 > 0, "critical").when(some10 > 25, "high").when(some10 > 10, "moderate").otherwise("none")
    return F.struct(level.alias("severity"), F.when(some300 > 0, some10 / some300 > 2).otherwise(some10 > 0).alias("worsening"))


def cgroup(throttled: Column, periods: Column, throttled_ns: Column) -> Column:
    ratio = F.when(periods > 0, throttled / periods).otherwise(0.0)
    return F.struct(ratio.alias("ratio"), F.when(throttled > 0, throttled_ns / throttled / 1e6).otherwise(0.0).alias("stall_ms"), F.when(ratio > 0.25, "critical").when(ratio > 0.05, "warning").otherwise("ok").alias("status"))


def lagged_correlation(df: DataFrame, by: Sequence[str], order: str, a: str, b: str, lags: int = 5) -> DataFrame:
    """Pearson correlation of a with b some steps later, by lag, and whether the lag is the best."""
    w = W.partitionBy(*by).orderBy(order)
    p = df.select(*by, F.col(a).alias("a"), *[F.lead(b, k).over(w).alias(f"b{k}") for k in range(lags + 1)])
    g = p.groupBy(*by).agg(*[F.corr(F.when(F.col(f"b{k}").isNotNull(), F.col("a")), F.col(f"b{k}")).alias(f"r{k}") for k in range(lags + 1)])
    rows = g.select(*by, F.posexplode(F.array(*[f"r{k}" for k in range(lags + 1)])).alias("lag", "r"))
    return rows.withColumn("best", F.col("r") == F.max("r").over(W.partitionBy(*by)))


# web

VITALS = {"LCP": (2500.0, 4000.0), "INP": (200.0, 500.0), "CLS": (0.1, 0.25), "FCP": (1800.0, 3000.0), "TTFB": (800.0, 1800.0), "FID": (100.0, 300.0)}


def vital_rating(metric: str, value: Column) -> Column:
    good, poor = VITALS[metric]
    return F.when(value <= good, "good").when(value <= poor, "needs-improvement").otherwise("poor")


def vital_distribution(df: DataFrame, by: Sequence[str], metric: str, value: str, least: int = 30) -> DataFrame:
    """p75 with its rating, the fractions of the three bands, and whether there are enough samples."""
    good, poor = VITALS[metric]
    v = F.col(value)
    g = df.groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, F.lit(0.75)).alias("p75"), F.avg(F.when(v <= good, 1.0).otherwise(0.0)).alias("good"), F.avg(F.when((v > good) & (v <= poor), 1.0).otherwise(0.0)).alias("middling"), F.avg(F.when(v > poor, 1.0).otherwise(0.0)).alias("poor"))
    return g.withColumn("rating", vital_rating(metric, F.col("p75"))).withColumn("enough", F.col("n") >= least)


def navigation_phases(df: DataFrame, by: Sequence[str], phases: Sequence[tuple[str, Column]]) -> DataFrame:
    """p50, p75, p95 and count of each phase; nulls are skipped."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), F.round(c, 2).alias("ms")) for n, c in phases])).alias("x")
    x = df.select(*by, rows).select(*by, "x.*").filter("ms is not null")
    g = x.groupBy(*by, "phase").agg(F.count("ms").alias("n"), F.percentile("ms", F.lit([0.5, 0.75, 0.95])).alias("p"))
    return g.select(*by, "phase", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p75"), F.col("p")[2].alias("p95"))


def top_resources(df: DataFrame, by: Sequence[str], size: str, name: str, k: int = 5) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col(size).desc(), name)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(*by, name, size, "place")


def blocking_time(df: DataFrame, by: Sequence[str], duration: Column) -> DataFrame:
    """Sum of what tasks take beyond 50 ms."""
    return df.groupBy(*by).agg(F.sum(F.greatest(F.lit(0.0), duration - 50)).alias("tbt_ms"))
