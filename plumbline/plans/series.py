"""Queries over series: ``events`` by type and day (mean value), and before/after samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from .registry import Tables, query

T = ["event_type"]
DAY = "(SELECT event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)"
IDX = f"(SELECT event_type, day, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {DAY})"


def daily(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day")).agg(F.avg("value").alias("value"))


AFTER = "ts >= TIMESTAMP '2024-01-16'"


def after():
    return F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")


CH = "CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 0.0 ELSE 100.0 END ELSE ({a} - {b}) / abs({b}) * 100 END"
FIT = "count(v) AS n, regr_slope(v, i::DOUBLE) AS slope, regr_intercept(v, i::DOUBLE) AS intercept, CASE WHEN var_pop(v) > 0 THEN regr_r2(v, i::DOUBLE) ELSE 0 END AS r2"


@query(f"SELECT event_type, {FIT} FROM {IDX} GROUP BY 1", "slope intercept r2")
def linear_regression(t: Tables) -> DataFrame:
    return S.regression(S.indexed(daily(t), T, "day", "value"), T, F.col("i").cast("double"), F.col("v"))


@query(f"WITH p AS {IDX}, f AS (SELECT event_type, {FIT}, min_by(v, i) AS first, max_by(v, i) AS last, avg(v) AS mean, stddev_pop(v) AS std FROM p GROUP BY 1), z AS (SELECT p.event_type, count(*) FILTER (WHERE abs(v - mean) / std > 2) AS anomalies FROM p JOIN f USING (event_type) GROUP BY 1), c AS (SELECT *, {CH.format(b='first', a='last')} AS change_pct FROM f JOIN z USING (event_type)) SELECT *, CASE WHEN abs(change_pct) < 5 THEN 'stable' WHEN r2 < 0.01 THEN 'unknown' WHEN slope > 0 THEN 'degrading' ELSE 'improving' END AS direction FROM c", "slope intercept r2 first last mean std change_pct")
def trend_analysis(t: Tables) -> DataFrame:
    return S.trend(daily(t), T, "day", "value", least_r2=0.01)


_X = "(SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1000000.0::DOUBLE AS s FROM events)"


@query(f"WITH f AS (SELECT event_type, count(*) AS n, regr_slope(value, s) * 86400 AS slope_per_day, regr_r2(value, s) AS r2, min_by(value, ts) AS first, max_by(value, ts) AS last, stddev_pop(value) / avg(value) AS volatility FROM {_X} GROUP BY 1), c AS (SELECT *, {CH.format(b='first', a='last')} AS change_pct FROM f) SELECT event_type, n, slope_per_day, volatility, change_pct, CASE WHEN abs(change_pct) < 5 THEN 'stable' WHEN r2 < 0.3 THEN 'unknown' WHEN slope_per_day > 0 THEN 'improving' ELSE 'degrading' END AS direction, 0.7 * r2 + 0.3 * least(1.0, n / 30.0) AS confidence FROM c", "slope_per_day volatility change_pct confidence")
def trend_over_time(t: Tables) -> DataFrame:
    return S.timed_trend(t.events, T, "ts", "value", F.col("event_type")).select("event_type", "n", "slope_per_day", "volatility", "change_pct", "direction", "confidence")


@query(f"SELECT *, CASE WHEN abs(change_pct) < 5 THEN 'stable' WHEN change_pct > 0 THEN 'degrading' ELSE 'improving' END AS direction FROM (SELECT *, {CH.format(b='before', a='after')} AS change_pct FROM (SELECT event_type, avg(value) FILTER (WHERE NOT {AFTER}) AS before, avg(value) FILTER (WHERE {AFTER}) AS after FROM events GROUP BY 1))", "before after change_pct")
def trend_compare_periods(t: Tables) -> DataFrame:
    return S.compare_means(t.events.filter(~after()), t.events.filter(after()), T, "value")


@query(f"SELECT event_type, day, i, magnitude FROM (SELECT event_type, day, i, abs(ma - mb) / sqrt((vb + va) / 2) AS magnitude FROM (SELECT *, avg(v) OVER b AS mb, avg(v) OVER a AS ma, var_pop(v) OVER b AS vb, var_pop(v) OVER a AS va FROM {IDX} WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE i >= 5 AND i < n - 5) WHERE magnitude >= 1", "magnitude")
def change_points(t: Tables) -> DataFrame:
    return S.change_points(daily(t), T, "day", "value", 5, 1.0)


@query(f"WITH f AS (SELECT event_type, count(*) AS n, regr_slope(v, i::DOUBLE) AS slope, regr_intercept(v, i::DOUBLE) AS icept, avg(i::DOUBLE) AS mx, regr_sxx(v, i::DOUBLE) AS sxx, sqrt((regr_syy(v, i::DOUBLE) - pow(regr_sxy(v, i::DOUBLE), 2) / regr_sxx(v, i::DOUBLE)) / (count(*) - 2)) AS se, max(i) AS last FROM {IDX} GROUP BY 1), g AS (SELECT *, unnest(range(1, 8))::INT AS step FROM f), h AS (SELECT *, slope * (last + step) + icept AS predicted, 1.96::DOUBLE * se * sqrt(1 + 1.0::DOUBLE / n + pow(last + step - mx, 2) / sxx) AS half FROM g) SELECT event_type, step, predicted, predicted - half AS lower, predicted + half AS upper FROM h", "predicted lower upper")
def forecast_linear(t: Tables) -> DataFrame:
    return S.linear_forecast(daily(t), T, "day", "value")


@query(f"WITH f AS (SELECT event_type, avg(v) AS predicted, stddev_pop(v) AS sd FROM {IDX} WHERE i >= n - 7 GROUP BY 1), g AS (SELECT *, unnest(range(1, 8))::INT AS step FROM f) SELECT event_type, step, predicted, predicted - 1.96::DOUBLE * sd * sqrt(1 + step * 0.05::DOUBLE) AS lower, predicted + 1.96::DOUBLE * sd * sqrt(1 + step * 0.05::DOUBLE) AS upper FROM g", "predicted lower upper")
def forecast_moving_average(t: Tables) -> DataFrame:
    return S.moving_average_forecast(daily(t), T, "day", "value")


@query(f"WITH RECURSIVE p AS {IDX}, r AS (SELECT event_type, i, n, v AS level, (SELECT (max_by(q.v, q.i) - min_by(q.v, q.i)) / count(*) FROM p q WHERE q.event_type = p.event_type) AS trend, 0.0::DOUBLE AS sse FROM p WHERE i = 0 UNION ALL SELECT p.event_type, p.i, p.n, 0.3::DOUBLE * p.v + 0.7::DOUBLE * (r.level + r.trend), 0.1::DOUBLE * (0.3::DOUBLE * p.v + 0.7::DOUBLE * (r.level + r.trend) - r.level) + 0.9::DOUBLE * r.trend, r.sse + pow(p.v - ((0.3::DOUBLE * p.v + 0.7::DOUBLE * (r.level + r.trend)) + 0.1::DOUBLE * (0.3::DOUBLE * p.v + 0.7::DOUBLE * (r.level + r.trend) - r.level) + 0.9::DOUBLE * r.trend), 2) FROM r JOIN p ON p.event_type = r.event_type AND p.i = r.i + 1), g AS (SELECT *, sqrt(sse / n) AS se, unnest(range(1, 8))::INT AS step FROM r WHERE i = n - 1) SELECT event_type, step, level + step * trend AS predicted, level + step * trend - 1.96::DOUBLE * se * sqrt(1 + step * 0.1::DOUBLE) AS lower, level + step * trend + 1.96::DOUBLE * se * sqrt(1 + step * 0.1::DOUBLE) AS upper FROM g", "predicted lower upper")
def forecast_exponential(t: Tables) -> DataFrame:
    return S.holt_forecast(daily(t), T, "day", "value")


@query("SELECT event_type, coalesce(quantile_cont(g, 0.5) FILTER (WHERE g > 0), 86400) AS interval_s FROM (SELECT event_type, (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts)) AS g FROM events) GROUP BY 1", "interval_s")
def forecast_interval(t: Tables) -> DataFrame:
    return S.median_gap(t.events, T, "ts")


_TR = f"(SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend, i % 7 AS phase FROM {IDX})"


@query(f"WITH p AS {_TR}, m AS (SELECT event_type, phase, quantile_cont(v - trend, 0.5) AS m FROM p GROUP BY ALL), s AS (SELECT event_type, phase, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM m) SELECT event_type, day, i, v, trend, seasonal, v - trend - seasonal AS residual FROM p JOIN s USING (event_type, phase) WHERE n >= 21", "v trend seasonal residual")
def seasonal_decomposition(t: Tables) -> DataFrame:
    return S.seasonal(daily(t), T, "day", "value", 7)


_BASE = "SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower_fence, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper_fence FROM events {w} GROUP BY 1"


@query(_BASE.format(w=""), "mean std min max p5 p25 median p75 p95 p99 iqr lower_fence upper_fence")
def anomaly_baseline(t: Tables) -> DataFrame:
    return S.baseline(t.events, T, "value")


def _anomaly_sql(cond: str, w: str = "", rows: str = "events") -> str:
    return f"WITH b AS ({_BASE.format(w=w)}), p AS (SELECT e.event_type, event_id, value AS v, abs(value - mean) / std AS z, * EXCLUDE (event_type, event_id, value) FROM {rows} e JOIN b USING (event_type)) SELECT event_type, event_id, v, z, CASE WHEN v > mean THEN 'spike' ELSE 'drop' END AS kind, CASE WHEN z >= 5 THEN 'critical' WHEN z >= 4 THEN 'high' WHEN z >= 3 THEN 'medium' WHEN z >= 2 THEN 'low' ELSE 'info' END AS severity, least(0.99, 1 - exp(-z / 2)) AS confidence FROM p WHERE {cond}"


@query(_anomaly_sql("z >= 3"), "v z confidence")
def anomaly_zscore(t: Tables) -> DataFrame:
    return S.anomalies(t.events, S.baseline(t.events, T, "value"), T, "event_id", "value", "zscore")


_FAR = "greatest(v - upper_fence, lower_fence - v) / iqr"


@query(
    f"WITH b AS ({_BASE.format(w='')}), p AS (SELECT e.event_type, event_id, value AS v, abs(value - mean) / std AS z, lower_fence, upper_fence, iqr FROM events e JOIN b USING (event_type)) "
    f"SELECT event_type, event_id, v, z, CASE WHEN v > upper_fence THEN 'spike' ELSE 'drop' END AS kind, CASE WHEN {_FAR} >= 3 THEN 'critical' WHEN {_FAR} >= 2 THEN 'high' WHEN {_FAR} >= 1.5 THEN 'medium' "
    f"WHEN {_FAR} >= 1 THEN 'low' ELSE 'info' END AS severity, least(0.99, 0.5 + {_FAR} * 0.1) AS confidence FROM p WHERE v < lower_fence OR v > upper_fence",
    "v z confidence",
)
def anomaly_iqr(t: Tables) -> DataFrame:
    return S.anomalies(t.events, S.baseline(t.events, T, "value"), T, "event_id", "value", "iqr")


@query(_anomaly_sql("z >= 3 OR v < lower_fence OR v > upper_fence", f"WHERE NOT {AFTER}", f"(SELECT * FROM events WHERE {AFTER})"), "v z confidence")
def anomaly_against_baseline(t: Tables) -> DataFrame:
    return S.anomalies(t.events.filter(after()), S.baseline(t.events.filter(~after()), T, "value"), T, "event_id", "value")


@query(f"WITH p AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS d FROM {IDX}), c AS (SELECT *, abs(sum(d) OVER (PARTITION BY event_type ORDER BY day)) AS c FROM p), s AS (SELECT event_type, max_by(i, (c, -i)) + 1 AS split FROM c WHERE i + 1 >= 5 AND i + 1 <= n - 5 GROUP BY 1), m AS (SELECT event_type, split, quantile_cont(v, 0.5) FILTER (WHERE i < split) AS ml, quantile_cont(v, 0.5) FILTER (WHERE i >= split) AS mr FROM p JOIN s USING (event_type) GROUP BY ALL), a AS (SELECT event_type, quantile_cont(abs(v - ml), 0.5) AS mad FROM p JOIN m USING (event_type) WHERE i < split GROUP BY 1) SELECT event_type, abs(mr - ml) / mad > 1 AS detected, CASE WHEN abs(mr - ml) / mad > 1 THEN split END AS change_index, mr - ml AS magnitude, abs(mr - ml) / mad AS mad_units FROM m JOIN a USING (event_type)", "magnitude mad_units")
def step_change_mad(t: Tables) -> DataFrame:
    return S.split_window_mad(daily(t), T, "day", "value", k=1.0)


@query(f"WITH p AS (SELECT *, greatest(10, floor(n * 0.5)) AS ref FROM {IDX}), m AS (SELECT event_type, avg(v) AS mu, stddev_samp(v) AS sd FROM p WHERE i < ref GROUP BY 1), s AS (SELECT *, sum(v - mu - 0.25::DOUBLE * sd) OVER w AS hi, sum(mu - v - 0.25::DOUBLE * sd) OVER w AS lo FROM p JOIN m USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY day)), r AS (SELECT *, hi - least(0, min(hi) OVER w) AS h2, lo - least(0, min(lo) OVER w) AS l2 FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, min(i) FILTER (WHERE h2 > 2 * sd OR l2 > 2 * sd) AS alarm_index, min(i) FILTER (WHERE h2 > 2 * sd OR l2 > 2 * sd) IS NOT NULL AS detected FROM r GROUP BY 1")
def step_change_cusum(t: Tables) -> DataFrame:
    return S.cusum(daily(t), T, "day", "value", kappa=0.25, h=2.0)


@query(f"SELECT *, abs(t) > 1 AS detected FROM (SELECT event_type, count(*) AS n, regr_slope(v, i::DOUBLE) AS slope, regr_slope(v, i::DOUBLE) / sqrt((regr_syy(v, i::DOUBLE) - pow(regr_sxy(v, i::DOUBLE), 2) / regr_sxx(v, i::DOUBLE)) / (count(*) - 2) / regr_sxx(v, i::DOUBLE)) AS t FROM {IDX} GROUP BY 1)", "slope t")
def drift_ols(t: Tables) -> DataFrame:
    return S.drift(daily(t), T, "day", "value", critical=1.0)


@query(f"WITH b AS ({_BASE.format(w=f'WHERE NOT {AFTER}')}), c AS (SELECT event_type, count(value) AS c_n, avg(value) AS c_mean, quantile_cont(value, 0.5) AS c_median, quantile_cont(value, 0.99) AS c_p99 FROM events WHERE {AFTER} GROUP BY 1), j AS (SELECT *, {CH.format(b='mean', a='c_mean')} AS mean_change, {CH.format(b='median', a='c_median')} AS median_change, {CH.format(b='p99', a='c_p99')} AS p99_change, 0.6 * abs(c_mean - mean) / std + 0.4 * greatest(p25 - c_mean, c_mean - p75, 0) / iqr AS deviation FROM c JOIN b USING (event_type)) SELECT event_type, c_n, c_mean, c_median, c_p99, mean_change, median_change, p99_change, deviation, CASE WHEN w >= 50 THEN 'critical' WHEN w >= 25 THEN 'degraded' WHEN w >= 10 THEN 'changed' ELSE 'normal' END AS status FROM (SELECT *, greatest(abs(mean_change), abs(p99_change)) AS w FROM j)", "c_mean c_median c_p99 mean_change median_change p99_change deviation")
def baseline_comparison(t: Tables) -> DataFrame:
    return S.compare_to_baseline(t.events.filter(after()), S.baseline(t.events.filter(~after()), T, "value"), T, "value")


@query(f"SELECT event_type, (avg(value) FILTER (WHERE user_id % 2 = 0 AND {AFTER}) - avg(value) FILTER (WHERE user_id % 2 = 0 AND NOT {AFTER})) - (avg(value) FILTER (WHERE user_id % 2 <> 0 AND {AFTER}) - avg(value) FILTER (WHERE user_id % 2 <> 0 AND NOT {AFTER})) AS effect FROM events GROUP BY 1", "effect")
def diff_in_diff(t: Tables) -> DataFrame:
    return S.diff_in_diff(t.events, T, "value", F.col("user_id") % 2 == 0, after())


@query("SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-10 01:00:00' GROUP BY 1")
def cold_start_excluded(t: Tables) -> DataFrame:
    return S.without_cold_start(t.events, "ts", F.lit("2024-01-10").cast("timestamp"), 3600.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_TWO = ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{s}, avg(value) FILTER (WHERE {c}) AS mean_{s}, stddev_samp(value) FILTER (WHERE {c}) AS std_{s}, " + ", ".join(f"quantile_cont(value, {p / 100}) FILTER (WHERE {c}) AS p{p}_{s}" for p in (50, 90, 99)) + f", min(value) FILTER (WHERE {c}) AS min_{s}, max(value) FILTER (WHERE {c}) AS max_{s}" for s, c in (("b", f"NOT {AFTER}"), ("a", AFTER)))


@query(f"SELECT *, (mean_a - mean_b) / sqrt(va + vb) AS t, pow(va + vb, 2) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df, (mean_a - mean_b) / sqrt(((n_b - 1) * std_b * std_b + (n_a - 1) * std_a * std_a) / (n_a + n_b - 2)) AS cohens_d, (mean_a - mean_b) / std_b AS glass_delta, (mean_a - mean_b) / abs(mean_b) * 100 AS change_pct FROM (SELECT *, std_a * std_a / n_a AS va, std_b * std_b / n_b AS vb FROM (SELECT event_type, {_TWO} FROM events GROUP BY 1))".replace("SELECT *, (mean_a", "SELECT * EXCLUDE (va, vb), (mean_a", 1), "mean_b std_b p50_b p90_b p99_b min_b max_b mean_a std_a p50_a p90_a p99_a min_a max_a t df cohens_d glass_delta change_pct")
def regression_two_samples(t: Tables) -> DataFrame:
    return S.two_samples(t.events, T, "value", after())


@query(f"WITH v AS (SELECT event_type, value AS v, count(*) FILTER (WHERE NOT {AFTER}) AS b, count(*) FILTER (WHERE {AFTER}) AS a FROM events GROUP BY ALL), r AS (SELECT *, a + b AS c, coalesce(sum(a + b) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0 AS rank FROM v), s AS (SELECT event_type, sum(b)::BIGINT AS n1, sum(a)::BIGINT AS n2, sum(rank * b)::DOUBLE AS r1, sum(c::DOUBLE * c * c - c) AS ties FROM r GROUP BY 1), u AS (SELECT *, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u, (n1 + n2)::DOUBLE AS n FROM s) SELECT event_type, n1, n2, u, (u - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u", "u z")
def regression_mann_whitney(t: Tables) -> DataFrame:
    return S.mann_whitney(t.events, T, "value", after())


@query(f"SELECT event_type, (a - b) / abs(b) * 100 AS change_pct, (a - b) / abs(b) * 100 >= 10 AS regressed FROM (SELECT event_type, avg(value) FILTER (WHERE {AFTER}) AS a, avg(value) FILTER (WHERE NOT {AFTER}) AS b FROM events GROUP BY 1)", "change_pct")
def regression_quick_check(t: Tables) -> DataFrame:
    return S.quick_regression(t.events, T, "value", after())
