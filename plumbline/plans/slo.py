"""SLO queries: ``events`` by type and hour; good: value of 100 or less."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slo as S
from .registry import Tables, query

BY = ["service"]
SLI = "(SELECT event_type AS service, date_trunc('hour', ts) AS ts, count(*) FILTER (WHERE value <= 100) AS good, count(*) AS total, count(*) FILTER (WHERE value > 100 AND event_id % 5 = 0) AS rejected FROM events GROUP BY 1, 2)"
NOW, START = "2024-01-30 12:00:00", "2024-01-01 00:00:00"
FMT = "yyyy-MM-dd HH:mm:ss"


def sli(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("service"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts")).agg(F.count_if(F.col("value") <= 100).alias("good"), F.count(F.lit(1)).alias("total"), F.count_if((F.col("value") > 100) & (F.col("event_id") % 5 == 0)).alias("rejected"))


def _at(s: str):
    return F.lit(s).cast("timestamp")


@query(f"SELECT service, count(*) AS n, sum(total)::BIGINT AS total FROM {SLI} WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND service = 'click' GROUP BY 1")
def sli_history(t: Tables) -> DataFrame:
    return S.history(sli(t), "click", _at("2024-01-10"), _at("2024-01-20")).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


@query(f"SELECT service, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, good, total, rejected FROM {SLI} QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC) = 1")
def sli_latest(t: Tables) -> DataFrame:
    return S.latest(sli(t)).withColumn("ts", F.date_format("ts", FMT))


_RATES = "sum(good)::BIGINT AS good, sum(total)::BIGINT AS total, count(*) AS measurements, sum(total)::BIGINT - sum(good)::BIGINT AS bad, sum(good) / sum(total) AS success_rate, (sum(total) - sum(good)) / sum(total) AS failure_rate"


@query(f"SELECT service, {_RATES} FROM {SLI} GROUP BY 1", "success_rate failure_rate")
def sli_rates(t: Tables) -> DataFrame:
    return S.rates(sli(t), BY)


@query(f"SELECT service, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period, {_RATES} FROM {SLI} GROUP BY 1, 2", "success_rate failure_rate")
def sli_by_day(t: Tables) -> DataFrame:
    return S.by_period(sli(t), 24).withColumn("period", F.date_format("period", FMT))


@query(f"SELECT service, strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600), '%Y-%m-%d %H:%M:%S') AS period, {_RATES} FROM {SLI} GROUP BY 1, 2", "success_rate failure_rate")
def sli_by_six_hours(t: Tables) -> DataFrame:
    return S.by_period(sli(t), 6).withColumn("period", F.date_format("period", FMT))


_EB = "SELECT service, good, total, rejected, bad, allowed, allowed - bad AS remaining, CASE WHEN allowed > 0 THEN bad / allowed * 100 ELSE 0 END AS consumed_pct, CASE WHEN total > 0 THEN good::DOUBLE / total * 100 ELSE 0 END AS sli, CASE WHEN total = 0 THEN 'unknown' WHEN bad / allowed * 100 >= 100 THEN 'breached' WHEN bad / allowed * 100 >= 80 THEN 'at_risk' ELSE 'compliant' END AS status{x} FROM (SELECT *, greatest(0, total - good - rejected) AS bad, total * 10.0::DOUBLE / 100 AS allowed FROM (SELECT service{x}, sum(CASE WHEN {w} THEN good ELSE 0 END)::BIGINT AS good, sum(CASE WHEN {w} THEN total ELSE 0 END)::BIGINT AS total, sum(CASE WHEN {w} THEN rejected ELSE 0 END)::BIGINT AS rejected FROM {s} GROUP BY ALL))"


@query(_EB.format(x="", s=SLI, w="ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-30 12:00:00'"), "allowed remaining consumed_pct sli")
def error_budget(t: Tables) -> DataFrame:
    return S.error_budget(sli(t), BY, 90.0, _at("2024-01-03"), _at(NOW))


@query(" UNION ALL ".join(f"SELECT {d} AS days, * FROM (" + _EB.format(x="", s=SLI, w=f"ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {d} DAY AND ts <= TIMESTAMP '2024-01-30 12:00:00'") + ")" for d in (1, 7, 28)), "allowed remaining consumed_pct sli")
def error_budget_multi_window(t: Tables) -> DataFrame:
    rows, out = sli(t), None
    for d in (1, 7, 28):
        x = S.error_budget(rows, BY, 90.0, _at(NOW) - F.expr(f"interval {d} day"), _at(NOW)).withColumn("days", F.lit(d))
        out = x if out is None else out.unionByName(x)
    return out


_BURN = "SELECT service, total, bad, CASE WHEN total > 0 THEN bad::DOUBLE / total ELSE 0 END / 0.1::DOUBLE AS burn_rate, CASE WHEN total > 0 AND bad::DOUBLE / total / 0.1 >= 14.4 THEN 'critical' WHEN total > 0 AND bad::DOUBLE / total / 0.1 >= 6 THEN 'warning' WHEN total > 0 AND bad::DOUBLE / total / 0.1 >= 1 THEN 'elevated' ELSE 'normal' END AS severity FROM (SELECT service, sum(CASE WHEN {w} THEN total ELSE 0 END)::BIGINT AS total, greatest(0, sum(CASE WHEN {w} THEN total - good - rejected ELSE 0 END))::BIGINT AS bad FROM {s} GROUP BY 1)"


@query(_BURN.format(s=SLI, w=f"ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}'"), "burn_rate")
def burn_rate(t: Tables) -> DataFrame:
    return S.burn_rate(sli(t), BY, 90.0, _at(NOW), 24)


def _tier(i: int, long: float, short: float, a: str, th: float) -> str:
    f = lambda h: f"ts >= TIMESTAMP '{NOW}' - INTERVAL {round(h * 60)} MINUTE AND ts <= TIMESTAMP '{NOW}'"
    r = lambda h: f"coalesce(greatest(0, sum(total - good - rejected) FILTER (WHERE {f(h)})) / nullif(sum(total) FILTER (WHERE {f(h)}), 0), 0) / 0.1::DOUBLE"
    return f"SELECT *, long_burn >= threshold AND short_burn >= threshold AND enough AS fires FROM (SELECT service, {i} AS tier, '{a}' AS action, {r(long)} AS long_burn, {r(short)} AS short_burn, coalesce(sum(total) FILTER (WHERE {f(long)}), 0) >= 100 AS enough, {th}::DOUBLE AS threshold FROM {SLI} GROUP BY 1)"


@query(" UNION ALL ".join(_tier(i, lo, sh, a, th) for i, (a, lo, sh, th) in enumerate(S.TIERS)), "long_burn short_burn threshold")
def alert_policy(t: Tables) -> DataFrame:
    return S.alert_policy(sli(t), BY, 90.0, _at(NOW))


_HIST = f"SELECT service, step, sum(total)::BIGINT AS total, greatest(0, sum(total - good - rejected))::BIGINT AS bad, (greatest(0, sum(total - good - rejected)) / sum(total))::DOUBLE / 0.1::DOUBLE AS burn_rate FROM {SLI} s, range(0, 120) r(step) WHERE ts <= TIMESTAMP '{START}' + to_hours((step * 6)::INT) AND ts >= TIMESTAMP '{START}' + to_hours((step * 6 - 12)::INT) GROUP BY 1, 2"
_SEV = "CASE WHEN burn_rate >= {a} THEN 'critical' WHEN burn_rate >= {b} THEN 'warning' WHEN burn_rate >= 1 THEN 'elevated' ELSE 'normal' END AS severity"


@query(f"SELECT *, {_SEV.format(a=14.4, b=6)} FROM ({_HIST})", "burn_rate")
def burn_history(t: Tables) -> DataFrame:
    return S.burn_history(sli(t), BY, 90.0, _at(START), 120, 6, 12)


@query(f"WITH h AS (SELECT *, {_SEV.format(a=1.8, b=1.5)} FROM ({_HIST})), p AS (SELECT *, severity IN ('critical', 'warning') AS bad_, lead(step) OVER (PARTITION BY service ORDER BY step) AS e FROM h), q AS (SELECT *, CASE WHEN bad_ AND NOT coalesce(lag(bad_) OVER (PARTITION BY service ORDER BY step), false) THEN 1 ELSE 0 END AS n FROM p), r AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY step) AS run FROM q) SELECT service, min(step) AS first, max_by(coalesce(e, -1), step) AS ended, count(*) AS steps, max(burn_rate) AS peak, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE bad_ GROUP BY service, run HAVING max_by(coalesce(e, -1), step) > min(step)", "peak")
def burn_incidents(t: Tables) -> DataFrame:
    h = S.burn_history(sli(t), BY, 90.0, _at(START), 120, 6, 12).withColumn("severity", S.severity(F.col("burn_rate"), 1.8, 1.5))
    return S.incidents(h, BY, "step", step_hours=6)


_DAYS = f"(SELECT s.*, d AS day FROM {SLI} s, range(0, 10) r(d) WHERE ts >= TIMESTAMP '{NOW}' - to_days((d + 1)::INT) AND ts <= TIMESTAMP '{NOW}' - to_days(d::INT))"


@query(_EB.format(x=", day", s=_DAYS, w="true").replace("day, sum", "day::INT AS day, sum"), "allowed remaining consumed_pct sli")
def error_budget_daily(t: Tables) -> DataFrame:
    return S.daily_budgets(sli(t), BY, 90.0, _at(NOW), 10)


@query(f"SELECT service, CASE WHEN burn_rate > 1 THEN 720 / burn_rate END AS hours_left FROM ({_BURN.format(s=SLI, w='true')})", "hours_left")
def budget_exhaustion_forecast(t: Tables) -> DataFrame:
    return S.burn_rate(sli(t), BY, 90.0, _at("2030-01-01"), 24 * 10000).select("service", S.hours_to_exhaustion(F.col("burn_rate"), 720).alias("hours_left"))


@query("SELECT service, CASE WHEN r > 50 THEN 'normal' WHEN r > 25 THEN 'caution' WHEN r > 0 THEN 'freeze' ELSE 'exhausted' END AS tier FROM (SELECT service, 100 - consumed_pct AS r FROM (" + _EB.format(x="", s=SLI, w="true") + "))")
def budget_policy(t: Tables) -> DataFrame:
    b = S.error_budget(sli(t), BY, 90.0, _at("1970-01-01"), _at("2100-01-01"))
    return b.select("service", S.policy_tier(100 - F.col("consumed_pct")).alias("tier"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value <= 10 + greatest(c, 0) * 2) AS good, avg(CASE WHEN value <= 10 + greatest(c, 0) * 2 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM (SELECT *, CASE WHEN u <= 1 THEN u::DOUBLE ELSE u * log2(u) END AS c FROM (SELECT *, user_id % 20 AS u FROM events)) GROUP BY 1", "pass_rate")
def dynamic_latency_budget(t: Tables) -> DataFrame:
    e = t.events.withColumn("u", F.col("user_id") % 20)
    return S.latency_budget(e, ["event_type"], F.col("value"), S.nlogn(F.col("u")), 10.0, 2.0)


@query(f"WITH r AS (SELECT service, sum(good) / sum(total) AS s, (sum(total) - sum(good)) / sum(total) / 0.1::DOUBLE AS b, length(service)::DOUBLE AS w FROM {SLI} GROUP BY 1) SELECT sum(s * w) / sum(w) * 100 AS cxi, sum(CASE WHEN b <= 1 THEN 100.0 ELSE 100.0 / b END * w) / sum(w) AS sri FROM r", "cxi sri")
def portfolio_score(t: Tables) -> DataFrame:
    r = S.rates(sli(t), BY).select("service", F.col("success_rate").alias("s"), (F.col("failure_rate") / F.lit(0.1)).alias("b"), F.length("service").cast("double").alias("w"))
    return S.portfolio(r, "s", "b", "w", "w")


@query("WITH i AS (SELECT event_id, ts FROM events WHERE event_type = 'error' AND value > 150), f AS (SELECT ts FROM events WHERE event_type = 'click' AND value > 120) SELECT count(*) AS incidents, avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE abs(epoch_us(f.ts) - epoch_us(i.ts)) <= 3600000000) THEN 1.0 ELSE 0.0 END) AS recall FROM i", "recall")
def incident_recall(t: Tables) -> DataFrame:
    e = t.events
    return S.overlap_recall(e.filter("event_type = 'error' and value > 150"), e.filter("event_type = 'click' and value > 120"), "event_id", "ts")
