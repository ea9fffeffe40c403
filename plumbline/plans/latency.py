"""Queries over latency samples: ``events`` by type, value as milliseconds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apdex as A
from ..operators import descriptive as D
from .registry import Tables, query

T = ["event_type"]


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, " + ", ".join(f"quantile_cont(value, {p / 100}) AS p{p:g}".replace(" AS p99.9", " AS p999") for p in D.STANDARD) + " FROM events GROUP BY event_type", "min max mean std p50 p75 p90 p95 p99 p999")
def percentile_summary(t: Tables) -> DataFrame:
    return D.summary(t.events, T, "value")


@query("SELECT event_type, quantile_cont(value, 0.42) AS p FROM events GROUP BY event_type", "p")
def percentile_single(t: Tables) -> DataFrame:
    return t.events.groupBy(*T).agg(D.percentile("value", 42).alias("p"))


@query("SELECT event_type, pct, quantile_cont(value, [0.1, 0.33, 0.875])[i] AS value FROM events, (VALUES (1, 10.0::DOUBLE), (2, 33.0), (3, 87.5)) x(i, pct) GROUP BY event_type, pct, i", "value")
def percentile_custom(t: Tables) -> DataFrame:
    return D.custom_percentiles(t.events, T, "value", [10.0, 33.0, 87.5])


_B = D.BOUNDS
_CASE = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(_B)) + f" ELSE {len(_B)} END"
_L = ", ".join(f"({i}, '{x}')" for i, x in enumerate(D._labels(_B)))


@query(f"SELECT e.event_type, l.bucket, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (VALUES {_L}) l(bucket, label) LEFT JOIN (SELECT event_type, {_CASE} AS b, count(*) AS n FROM events GROUP BY ALL) c ON c.event_type = e.event_type AND c.b = l.bucket")
def histogram(t: Tables) -> DataFrame:
    return D.histogram(t.events, T, "value")


_G = 1.01 / 0.99


@query(f"WITH s AS (SELECT event_type, CASE WHEN value > 0 THEN ceil(ln(value) / ln({_G!r}::DOUBLE)) END AS idx, count(*)::DOUBLE AS w FROM events GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY idx NULLS FIRST) AS c, sum(w) OVER (PARTITION BY event_type) AS t FROM s), m AS (SELECT event_type, min_by(coalesce(idx, -1e18), c) AS idx FROM c WHERE c > 0.95::DOUBLE * (t - 1) GROUP BY 1) SELECT event_type, CASE WHEN idx < -1e17 THEN 0 ELSE 2 * pow({_G!r}::DOUBLE, idx) / ({_G!r}::DOUBLE + 1) END AS value FROM m", "value")
def ddsketch_quantile(t: Tables) -> DataFrame:
    hosts = D.dd_sketch(t.events.withColumn("host", F.col("user_id") % 16), ["event_type", "host"], "value")
    return D.dd_quantile(D.dd_merge(hosts, T), T, 0.95)


@query()
def kll_quantiles(t: Tables) -> DataFrame:
    return D.kll_percentiles(t.events, T, "value", [0.5, 0.95, 0.99])


@query("SELECT event_type, count(value) AS n, sum(value) AS sum, avg(value) AS mean, min(value) AS min, max(value) AS max, round(count(value) / 3600.0::DOUBLE + 1e-9, 2) AS throughput FROM events GROUP BY 1", "sum mean min max throughput")
def aggregate_window(t: Tables) -> DataFrame:
    return D.aggregate(t.events, T, "value", 3600)


@query("SELECT event_type, strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600), '%Y-%m-%d %H:%M:%S') AS window_start, count(value) AS n, sum(value) AS sum, avg(value) AS mean, min(value) AS min, max(value) AS max, round(count(value) / 3600.0::DOUBLE + 1e-9, 2) AS throughput FROM events GROUP BY 1, 2", "sum mean min max throughput")
def aggregate_tumbling(t: Tables) -> DataFrame:
    out = D.tumbling(t.events, T, "ts", "value", 3600)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH RECURSIVE w AS (SELECT event_type, min(epoch_us(ts)) AS s FROM events GROUP BY 1 UNION ALL SELECT w.event_type, (SELECT min(epoch_us(ts)) FROM events e WHERE e.event_type = w.event_type AND epoch_us(ts) >= w.s + 86400000000) AS s FROM w WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = w.event_type AND epoch_us(ts) >= w.s + 86400000000)), b AS (SELECT *, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS e FROM w) SELECT b.event_type, b.s AS window_us, count(value) AS n, sum(value) AS sum, avg(value) AS mean, min(value) AS min, max(value) AS max FROM b JOIN events x ON x.event_type = b.event_type AND epoch_us(x.ts) >= b.s AND (b.e IS NULL OR epoch_us(x.ts) < b.e) GROUP BY ALL", "sum mean min max")
def aggregate_anchored(t: Tables) -> DataFrame:
    out = D.anchored_windows(t.events, T, "ts", "value", 86400)
    return out.withColumn("window_us", F.unix_micros("window_start")).drop("window_start")


@query("SELECT event_type, count(*) / 86400.0::DOUBLE AS per_second, count(*) FILTER (WHERE value > 100) * 1.0 / count(*) * 100 AS slow_pct FROM events GROUP BY 1", "per_second slow_pct")
def throughput_and_rate(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.events.groupBy(*T).agg(D.throughput(n, F.lit(86400.0)).alias("per_second"), D.rate(F.count_if(F.col("value") > 100), n).alias("slow_pct"))


_S = "CASE WHEN value <= 20 THEN 1.0 WHEN value <= 80 THEN 0.5 ELSE 0.0 END"
_R = "CASE WHEN score >= 0.94 THEN 'Excellent' WHEN score >= 0.85 THEN 'Good' WHEN score >= 0.7 THEN 'Fair' WHEN score >= 0.5 THEN 'Poor' ELSE 'Unacceptable' END AS rating"


def _apdex_sql(by: str, source: str = "events", s: str = _S, own: str = "true", w: str = "1.0") -> str:
    return f"SELECT *, {_R} FROM (SELECT {by}, count(*) FILTER (WHERE {own}) AS n, count(*) FILTER (WHERE NOT ({own})) AS excluded, count(*) FILTER (WHERE {own} AND {s} = 1) AS satisfied, count(*) FILTER (WHERE {own} AND {s} = 0.5) AS tolerating, count(*) FILTER (WHERE {own} AND {s} = 0) AS frustrated, sum(CASE WHEN {own} THEN ({s})::DOUBLE * {w} END) / sum(CASE WHEN {own} THEN {w} END) AS score FROM {source} GROUP BY ALL) WHERE n > 0"


@query(_apdex_sql("event_type"), "score")
def apdex_by_type(t: Tables) -> DataFrame:
    return A.apdex(t.events, T, "value", 20.0)


@query(_apdex_sql("event_type", w="(user_id % 5 + 1)::DOUBLE"), "score")
def apdex_weighted(t: Tables) -> DataFrame:
    return A.apdex(t.events, T, "value", 20.0, weight=(F.col("user_id") % 5 + 1).cast("double"))


@query(_apdex_sql("event_type", s=f"(CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE {_S} END)", own="user_id % 10 <> 3"), "score")
def apdex_with_errors(t: Tables) -> DataFrame:
    return A.apdex(t.events, T, "value", 20.0, errored=F.col("event_id") % 17 == 0, human=F.col("user_id") % 10 != 3)


@query(f"SELECT count(*) AS endpoints, avg(CASE WHEN score >= 0.7 THEN 1.0 ELSE 0.0 END) * 100 AS passing_pct, coalesce(list(event_type ORDER BY event_type) FILTER (WHERE score < 0.7), []) AS failing FROM ({_apdex_sql('event_type')})", "passing_pct")
def apdex_fleet_rollup(t: Tables) -> DataFrame:
    return A.apdex_rollup(A.apdex(t.events, T, "value", 20.0), [], "event_type", 0.7)


@query(_apdex_sql("'all' AS scope"), "score")
def apdex_pooled(t: Tables) -> DataFrame:
    return A.apdex(t.events.withColumn("scope", F.lit("all")), ["scope"], "value", 20.0)


@query("SELECT event_type, value AS threshold FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(floor(0.85::DOUBLE * n), n - 1)", "threshold")
def apdex_recommended_threshold(t: Tables) -> DataFrame:
    return A.recommended_threshold(t.events, T, "value", 0.85)


@query("SELECT event_type, count(*) AS n, avg(v) AS mean, max(v) AS max FROM (SELECT event_type, value - k * 10 AS v FROM (SELECT event_type, value, unnest(range(0, CASE WHEN value > 10 THEN greatest(floor(value / 10) - 1, 0)::BIGINT ELSE 0 END + 1)) AS k FROM events)) GROUP BY 1", "mean max")
def coordinated_omission_backfill(t: Tables) -> DataFrame:
    b = A.backfilled(t.events, T, "value", 10.0)
    return b.groupBy(*T).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))


@query("SELECT event_type, avg(value) AS mean, max(value) AS max, max(value) * max(value) / 20000 AS expected, avg(value) < max(value) * max(value) / 20000 AS suspicious FROM events GROUP BY 1", "mean max expected")
def coordinated_omission_tene(t: Tables) -> DataFrame:
    return A.tene_suspicious(t.events, T, "value", 10000.0)


@query("SELECT event_type, count(*) / 86400.0 * (avg(value) / 1000) <= 1.0 AS plausible FROM events GROUP BY 1")
def littles_law(t: Tables) -> DataFrame:
    a = t.events.groupBy(*T).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return a.select("event_type", A.within_littles_law(F.col("n") / 86400.0, F.col("m") / 1000, F.lit(1.0)).alias("plausible"))


_SLA = "SELECT *, CASE WHEN measured > 200 OR error_rate > 6 THEN 'BREACHED' WHEN measured > 180 THEN 'WARNING' ELSE 'COMPLIANT' END AS status FROM (SELECT *, (200 - measured) / 200 * 100 AS margin_pct, errors::DOUBLE / n * 100 AS error_rate FROM (SELECT {by}, quantile_cont(value, 0.95) AS measured, count(*) AS n, count(*) FILTER (WHERE event_id % 19 = 0) AS errors FROM events GROUP BY ALL))"


@query(_SLA.format(by="event_type"), "measured margin_pct error_rate")
def sla_check(t: Tables) -> DataFrame:
    return A.sla_check(t.events, T, "value", 200.0, errored=F.col("event_id") % 19 == 0, error_rate_most=6.0)


@query("SELECT *, CASE WHEN fraction >= 0.9 THEN 'COMPLIANT' WHEN enough THEN 'BREACHED' ELSE 'WARNING' END AS status FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value <= 100) AS good, count(*) FILTER (WHERE value <= 100)::DOUBLE / count(*) AS fraction, count(*) >= 100 AS enough FROM events GROUP BY 1)", "fraction")
def sla_fraction(t: Tables) -> DataFrame:
    return A.sla_fraction(t.events, T, "value", 100.0, 0.9)


@query(f"SELECT count(*) AS windows, avg(CASE WHEN status = 'COMPLIANT' THEN 1.0 ELSE 0.0 END) * 100 AS compliance_pct FROM ({_SLA.format(by='event_type, date_trunc(' + chr(39) + 'day' + chr(39) + ', ts) AS d')})", "compliance_pct")
def sla_compliance_rate(t: Tables) -> DataFrame:
    daily = A.sla_check(t.events.withColumn("d", F.date_trunc("day", "ts")), ["event_type", "d"], "value", 200.0, errored=F.col("event_id") % 19 == 0, error_rate_most=6.0)
    return A.compliance_rate(daily)
