"""Queries of database, cache, network, system and web metrics over ``events`` and ``lineitem``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resources as R
from .registry import Tables, query

T = ["event_type"]
HIT = "user_id % 10 < 8"


@query("SELECT event_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('select  * from t where a = ' || event_id || ' and b in (1, 2,' || user_id || ') and c = ''x' || event_type || '''', '''(?:[^'']|'''')*''', '?', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', '?', 'g'), '(?i)\\bIN\\s*\\(\\s*\\?(?:\\s*,\\s*\\?)*\\s*\\)', 'IN (?)', 'g'), '\\s+', ' ', 'g'))) AS fingerprint FROM events")
def db_query_fingerprint(t: Tables) -> DataFrame:
    sql = F.concat(F.lit("select  * from t where a = "), F.col("event_id").cast("string"), F.lit(" and b in (1, 2,"), F.col("user_id").cast("string"), F.lit(") and c = 'x"), F.col("event_type"), F.lit("'"))
    return t.events.select("event_id", R.query_fingerprint(sql).alias("fingerprint"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max, min(value) AS min, count(*) FILTER (WHERE value > 100) AS slow, avg(CASE WHEN user_id % 3 > 0 THEN 1.0 ELSE 0.0 END) * 100 AS index_pct, sum(user_id) / greatest(sum(event_id % 4), 1) AS examined_per_row FROM events GROUP BY 1", "mean median p95 p99 max min index_pct examined_per_row")
def db_query_metrics(t: Tables) -> DataFrame:
    return R.query_metrics(t.events, T, "value", F.col("user_id"), F.col("event_id") % 4, F.col("user_id") % 3 > 0)


@query("WITH b AS (SELECT * FROM events WHERE event_id % 2 = 0), c AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events WHERE event_id % 2 = 1 GROUP BY 1), m AS (SELECT event_type, quantile_cont(value, 0.5) AS base_median FROM b GROUP BY 1), d AS (SELECT event_type, base_median, quantile_cont(abs(value - base_median), 0.5) * 1.4826 AS spread FROM b JOIN m USING (event_type) GROUP BY ALL) SELECT event_type, median, base_median, spread, (median - base_median) / spread AS shift, abs((median - base_median) / spread) > 3 AS shifted FROM c JOIN d USING (event_type)", "median base_median spread shift")
def db_fingerprint_shift(t: Tables) -> DataFrame:
    e = t.events
    return R.shift_in_mads(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), T, "value")


@query("SELECT event_type, greatest(ceil(n / 3600.0::DOUBLE * (m / 1000) / 0.7), 5)::BIGINT AS pool FROM (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)")
def db_pool_size(t: Tables) -> DataFrame:
    a = t.events.groupBy(*T).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return a.select("event_type", R.pool_size(F.col("n") / 3600.0, F.col("m") / 1000).alias("pool"))


@query("SELECT l_returnflag, round(count(*) / 3600.0::DOUBLE + 1e-9, 2) AS qps, sum(l_extendedprice) / 1048576 / 3600 AS mb_s, least(100, count(*) / 20000.0::DOUBLE * 100) AS utilisation, greatest(0, 20000.0::DOUBLE - count(*)) AS headroom FROM lineitem GROUP BY 1", "qps mb_s utilisation headroom")
def db_throughput(t: Tables) -> DataFrame:
    n, s = F.count(F.lit(1)), F.lit(3600.0)
    g = t.lineitem.groupBy("l_returnflag").agg(R.per_second(n, s).alias("qps"), R.megabytes_per_second(F.sum("l_extendedprice"), s).alias("mb_s"), R.capacity(n, F.lit(20000.0)).alias("c"))
    return g.select("l_returnflag", "qps", "mb_s", "c.*")


_CM = f"SELECT *, hits * coalesce(miss_ms - hit_ms, 0) AS saved_ms, CASE WHEN hit_pct >= 95 THEN 'excellent' WHEN hit_pct >= 85 THEN 'good' WHEN hit_pct >= 70 THEN 'fair' ELSE 'poor' END AS status FROM (SELECT *, hits::DOUBLE / (hits + misses) * 100 AS hit_pct FROM (SELECT {{by}}, count(*) FILTER (WHERE {HIT}) AS hits, count(*) FILTER (WHERE NOT ({HIT})) AS misses, avg(value) FILTER (WHERE {HIT}) AS hit_ms, avg(value) FILTER (WHERE NOT ({HIT})) AS miss_ms FROM events GROUP BY ALL))"


@query(_CM.format(by="event_type"), "hit_ms miss_ms hit_pct saved_ms")
def cache_metrics(t: Tables) -> DataFrame:
    return R.cache_metrics(t.events, T, F.col("user_id") % 10 < 8, F.col("value"))


@query("SELECT * FROM (" + _CM.format(by="user_id") + ") WHERE misses >= 5 AND hit_pct < 10", "hit_ms miss_ms hit_pct saved_ms")
def cache_uncacheable_keys(t: Tables) -> DataFrame:
    return R.uncacheable_keys(R.cache_metrics(t.events, ["user_id"], F.col("user_id") % 10 < 8, F.col("value")), 5)


@query("SELECT event_type, max(c) AS worst, max(c) > 5 AS stampede FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS c FROM events WHERE user_id % 10 >= 8) GROUP BY 1")
def cache_stampede(t: Tables) -> DataFrame:
    m = t.events.filter("user_id % 10 >= 8")
    return R.stampedes(m, "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000), 3600000)


@query("SELECT *, CASE WHEN premature_pct > 30 THEN 'critical' WHEN premature_pct > 20 THEN 'high' WHEN premature_pct > 10 THEN 'moderate' ELSE 'normal' END AS status FROM (SELECT event_type, count(*) AS evicted, avg(CASE WHEN value < 100 * 0.5 AND r <> 'expired' THEN 1.0 ELSE 0.0 END) * 100 AS premature_pct, avg(CASE WHEN r = 'lru' THEN 1.0 ELSE 0.0 END) * 100 AS lru_pct, count(*) / 86400.0::DOUBLE AS per_second FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'expired' WHEN event_id % 3 = 1 THEN 'lru' ELSE 'size' END AS r FROM events) GROUP BY 1)", "premature_pct lru_pct per_second")
def cache_evictions(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    return R.evictions(t.events, T, F.when(k == 0, "expired").when(k == 1, "lru").otherwise("size"), F.col("value"), F.lit(100.0), 86400.0)


@query(
    "WITH b AS (SELECT event_type || '/' || (user_id % 7) AS event_type, day(ts) AS d, count(*) FILTER (WHERE value < 55) AS hits, count(*) FILTER (WHERE NOT value < 55) AS misses FROM events GROUP BY ALL), "
    "r AS (SELECT *, hits::DOUBLE / (hits + misses) * 100 AS rate, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY event_type ORDER BY d)), "
    "s AS (SELECT *, max(rate) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r), "
    "f AS (SELECT event_type, rate AS low, best, i FROM s WHERE best - rate > 15 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rate, i) = 1), "
    "n AS (SELECT *, gap AND NOT coalesce(lag(gap) OVER (PARTITION BY event_type ORDER BY i), false) AS begins FROM (SELECT *, coalesce(best - rate > 15, false) AS gap FROM s)), "
    "o AS (SELECT f.event_type, max(n.i) AS i, max_by(n.rate, n.i) AS rate FROM f JOIN n ON n.event_type = f.event_type AND n.begins AND n.i <= f.i GROUP BY 1), "
    "p AS (SELECT o.event_type, (SELECT coalesce(max_by(r.rate, r.i) - o.rate, 0) / greatest(count(*), 1) FROM r WHERE r.event_type = o.event_type AND r.i > o.i AND r.i <= o.i + 3) AS slope FROM o), "
    "g AS (SELECT event_type, count(*) AS buckets, min(rate) AS least FROM r GROUP BY 1), "
    "z AS (SELECT g.*, f.best - f.low AS drop_pct, p.slope AS recovery_slope, CASE WHEN buckets < 3 THEN 'insufficient_data' WHEN least < 5 THEN 'collapsed' WHEN f.low IS NULL THEN 'stable' WHEN p.slope > 0.5 THEN 'warming' ELSE 'flatlined' END AS state FROM g LEFT JOIN f USING (event_type) LEFT JOIN p USING (event_type)) "
    "SELECT event_type, buckets, state, CASE WHEN state IN ('warming', 'flatlined') THEN drop_pct END AS drop_pct, CASE WHEN state IN ('warming', 'flatlined') THEN recovery_slope END AS recovery_slope FROM z",
    "drop_pct recovery_slope",
)
def cache_warmup(t: Tables) -> DataFrame:
    who = F.concat("event_type", F.lit("/"), (F.col("user_id") % 7).cast("string")).alias("event_type")
    b = t.events.groupBy(who, F.dayofmonth("ts").alias("d")).agg(F.count_if(F.col("value") < 55).alias("hits"), F.count_if(~(F.col("value") < 55)).alias("misses"))
    return R.warmup(b, T, "d")


@query("SELECT event_type, greatest(floor(n * m / 1000 * 1.5)::BIGINT, n, 5) AS pool FROM (SELECT event_type, count(*) // 100 AS n, avg(value) AS m FROM events GROUP BY 1)")
def db_optimal_pool(t: Tables) -> DataFrame:
    a = t.events.groupBy(*T).agg(F.floor(F.count(F.lit(1)) / 100).alias("n"), F.avg("value").alias("m"))
    return a.select("event_type", R.optimal_pool(F.col("n"), F.col("m")).alias("pool"))



@query("SELECT *, CASE WHEN mean > 100 OR loss_pct > 5 THEN 'poor' WHEN mean > 50 THEN 'fair' ELSE 'good' END AS status FROM (SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, avg(d) AS jitter, avg(CASE WHEN event_id % 40 = 0 THEN 1.0 ELSE 0.0 END) * 100 AS loss_pct FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS d FROM events) GROUP BY 1)", "mean p50 p95 p99 jitter loss_pct")
def network_latency(t: Tables) -> DataFrame:
    return R.network_latency(t.events, T, "event_id", "value", F.col("event_id") % 40 == 0)


@query("SELECT *, CASE WHEN utilisation > 90 THEN 'saturated' WHEN utilisation > 70 THEN 'high' WHEN utilisation > 30 THEN 'moderate' ELSE 'low' END AS status FROM (SELECT *, up_mbps + down_mbps AS total_mbps, (up_mbps + down_mbps) / 0.02 * 100 AS utilisation FROM (SELECT l_shipmode, sum(q) * 8 / 1e6 / 60 AS up_mbps, sum(x) * 8 / 1e6 / 60 AS down_mbps FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS q, l_tax * 1000 AS x FROM lineitem) GROUP BY 1))", "up_mbps down_mbps total_mbps utilisation")
def network_bandwidth(t: Tables) -> DataFrame:
    return R.bandwidth(t.lineitem.withColumnRenamed("l_returnflag", "l_shipmode"), ["l_shipmode"], F.col("l_quantity"), F.col("l_tax") * 1000, 60.0, 0.02)


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.95) AS p95, max(value) AS max, avg(CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE 0.0 END) * 100 AS cached_pct, avg(CASE WHEN event_id % 50 = 0 THEN 1.0 ELSE 0.0 END) * 100 AS failed_pct FROM events GROUP BY GROUPING SETS ((event_type), ())", "mean p95 max cached_pct failed_pct")
def network_dns(t: Tables) -> DataFrame:
    return R.dns(t.events, "all", "event_type", "value", F.col("user_id") % 4 == 0, F.col("event_id") % 50 == 0)


@query("SELECT *, CASE WHEN usage_pct >= 95 OR steal_band = 'critical' THEN 'critical' WHEN usage_pct >= 80 OR steal_band = 'warning' THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT *, 1 / (1 - least(0.999, greatest(0, usage_pct / 100))) AS queueing, CASE WHEN steal_pct > 5 THEN 'critical' WHEN steal_pct > 2 THEN 'warning' ELSE 'ok' END AS steal_band FROM (SELECT event_type, 100 - avg((user_id % 60)::DOUBLE) AS usage_pct, avg((event_id % 7)::DOUBLE) AS steal_pct, avg(value / 8) AS load_ratio FROM events GROUP BY 1))", "usage_pct steal_pct load_ratio queueing")
def system_cpu(t: Tables) -> DataFrame:
    return R.cpu(t.events, T, (F.col("user_id") % 60).cast("double"), (F.col("event_id") % 7).cast("double"), F.col("value"), F.lit(8))


@query("SELECT o_orderkey, CASE WHEN x >= 1073741824 THEN format('{:.2f} GB', x / 1073741824.0::DOUBLE) WHEN x >= 1048576 THEN format('{:.2f} MB', x / 1048576.0::DOUBLE) WHEN x >= 1024 THEN format('{:.2f} KB', x / 1024.0::DOUBLE) ELSE format('{:.2f} B', x) END AS size FROM (SELECT o_orderkey, o_totalprice * o_totalprice AS x FROM orders)")
def system_human_bytes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.human_bytes(F.col("o_totalprice") * F.col("o_totalprice")).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'critical' WHEN value > 25 THEN 'high' WHEN value > 10 THEN 'moderate' ELSE 'none' END AS severity, CASE WHEN user_id % 9 > 0 THEN value / (user_id % 9) > 2 ELSE value > 0 END AS worsening FROM events")
def system_pressure(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.psi(F.col("value"), F.col("user_id") % 9, F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(0.0)).alias("x")).select("event_id", "x.*")


@query("SELECT event_type, a::DOUBLE / b AS ratio, CASE WHEN a > 0 THEN c / a / 1e6 ELSE 0 END AS stall_ms, CASE WHEN a::DOUBLE / b > 0.25 THEN 'critical' WHEN a::DOUBLE / b > 0.05 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT event_type, count(*) FILTER (WHERE value > 80) AS a, count(*) AS b, sum(value * 1e6) AS c FROM events GROUP BY 1)", "ratio stall_ms")
def system_cgroup(t: Tables) -> DataFrame:
    g = t.events.groupBy(*T).agg(F.count_if(F.col("value") > 80).alias("a"), F.count(F.lit(1)).alias("b"), F.sum(F.col("value") * 1e6).alias("c"))
    return g.select("event_type", R.cgroup(F.col("a"), F.col("b"), F.col("c")).alias("x")).select("event_type", "x.*")


@query("WITH p AS (SELECT event_type, value AS a, " + ", ".join(f"lead((user_id % 50)::DOUBLE, {k}) OVER w AS b{k}" for k in range(6)) + " FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), g AS (" + " UNION ALL ".join(f"SELECT event_type, {k} AS lag, corr(a, b{k}) AS r FROM p WHERE b{k} IS NOT NULL GROUP BY 1" for k in range(6)) + ") SELECT *, r = max(r) OVER (PARTITION BY event_type) AS best FROM g", "r")
def system_lagged_correlation(t: Tables) -> DataFrame:
    return R.lagged_correlation(t.events.withColumn("u", (F.col("user_id") % 50).cast("double")), T, "event_id", "value", "u")


_V = {"LCP": "value * 40", "INP": "value * 3", "CLS": "value / 500", "FCP": "value * 30", "TTFB": "value * 12"}


@query(" UNION ALL ".join(f"SELECT *, CASE WHEN p75 <= {R.VITALS[m][0]} THEN 'good' WHEN p75 <= {R.VITALS[m][1]} THEN 'needs-improvement' ELSE 'poor' END AS rating, n >= 30 AS enough FROM (SELECT event_type, '{m}' AS metric, count(v) AS n, quantile_cont(v, 0.75) AS p75, avg(CASE WHEN v <= {R.VITALS[m][0]} THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN v > {R.VITALS[m][0]} AND v <= {R.VITALS[m][1]} THEN 1.0 ELSE 0.0 END) AS middling, avg(CASE WHEN v > {R.VITALS[m][1]} THEN 1.0 ELSE 0.0 END) AS poor FROM (SELECT event_type, {x} AS v FROM events) GROUP BY 1)" for m, x in _V.items()), "p75 good middling poor")
def web_vitals(t: Tables) -> DataFrame:
    out = None
    for m, x in _V.items():
        d = R.vital_distribution(t.events.withColumn("v", F.expr(x)), T, m, "v").withColumn("metric", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT event_type, phase, count(ms) AS n, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.75) AS p75, quantile_cont(ms, 0.95) AS p95 FROM (SELECT event_type, 'dns' AS phase, (user_id % 30)::DOUBLE AS ms FROM events UNION ALL SELECT event_type, 'ssl', CASE WHEN user_id % 3 > 0 THEN (event_id % 40)::DOUBLE END FROM events UNION ALL SELECT event_type, 'response', (user_id % 200)::DOUBLE / 4 FROM events) WHERE ms IS NOT NULL GROUP BY ALL", "p50 p75 p95")
def web_navigation_phases(t: Tables) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return R.navigation_phases(t.events, T, [("dns", (u % 30).cast("double")), ("ssl", F.when(u % 3 > 0, (e % 40).cast("double"))), ("response", (u % 200) / 4.0)])


@query("SELECT event_type, event_id, value, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5", "value")
def web_top_resources(t: Tables) -> DataFrame:
    return R.top_resources(t.events, T, "value", "event_id")


@query("SELECT event_type, sum(greatest(0, value - 50)) AS tbt_ms FROM events GROUP BY 1", "tbt_ms")
def web_blocking_time(t: Tables) -> DataFrame:
    return R.blocking_time(t.events, T, F.col("value"))
