"""Queries of scores, SLO arithmetic, robust estimators, memory, I/O and schema differences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scores as S
from .content import FIND, findings
from .registry import Tables, query
from .series import AFTER, after

T = ["event_type"]
WEIGHTS = {"critical": 1000.0, "high": 60.0, "medium": 15.0, "low": 5.0}


@query(f"SELECT file_path, sum(CASE severity WHEN 'critical' THEN 1000.0 / 15 WHEN 'medium' THEN 1.0 ELSE 5.0 / 15 END) AS weighted FROM {FIND} GROUP BY 1", "weighted")
def rating_weighted_issues(t: Tables) -> DataFrame:
    return S.weighted_issues(findings(t), ["file_path"], "severity", WEIGHTS)


_B = "CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} < {a} THEN {x} / {a} WHEN {x} <= {b} THEN 1.0 ELSE exp(-{k} * ({x} - {b})) END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN exp(-0.05 * greatest(p_size - 15.0, 0)) ELSE 0.7 * exp(-0.05 * greatest(p_size - 15.0, 0)) + 0.3 * exp(-0.05 * greatest(p_size / 2.0 - 15.0, 0)) END AS complexity, 1 - greatest(0, least(100, p_retailprice / 10 - 20)) / 100 AS bounded, exp(-0.021 * p_size) AS debt, 1 - 1 / (1 + exp(-0.01 * (p_retailprice - 600))) AS size, exp(-0.15 * (p_size % 9)) AS cycles, {_B.format(x='(p_size / 4.0 - 1)', a=1.0, b=10.0, k=0.15)} AS assertions FROM part", "complexity bounded debt size cycles assertions")
def rating_utilities(t: Tables) -> DataFrame:
    s = F.col("p_size")
    mean = F.when(F.col("p_partkey") % 7 != 0, s / 2.0)
    return t.part.select("p_partkey", S.complexity_utility(s, mean).alias("complexity"), S.bounded_utility(F.col("p_retailprice") / 10 - 20, True).alias("bounded"), S.debt_utility(s).alias("debt"), S.size_utility(F.col("p_retailprice")).alias("size"), S.cycle_utility(s % 9).alias("cycles"), S.band_utility(s / 4.0 - 1, 1.0, 10.0, 0.15).alias("assertions"))


@query("SELECT *, loc / sum(loc) OVER (PARTITION BY p_brand) AS share FROM (SELECT p_brand, p_partkey % 5 AS g, sum(p_size)::BIGINT AS loc FROM part GROUP BY ALL)", "share")
def rating_risk_profile(t: Tables) -> DataFrame:
    return S.risk_profile(t.part.withColumn("g", F.col("p_partkey") % 5), ["p_brand"], "g", "p_size")


@query("SELECT p_brand, exp(avg(ln(greatest(u, 1e-6)))) AS score FROM (SELECT p_brand, p_partkey % 4 AS c, sum(p_size / 60.0 * p_retailprice) / sum(p_retailprice) AS u FROM part GROUP BY ALL) GROUP BY 1", "score")
def rating_composite(t: Tables) -> DataFrame:
    return S.composite(t.part.select("p_brand", (F.col("p_partkey") % 4).alias("c"), (F.col("p_size") / 60.0).alias("u"), "p_retailprice"), ["p_brand"], "c", "u", "p_retailprice")


@query("SELECT c_mktsegment, 1 - exp(sum(ln(1 - least(p, 0.999999)))) AS risk, pow(sum(w * pow(p, 3)) / sum(w), 1.0 / 3) AS l3 FROM (SELECT c_mktsegment, (c_custkey % 100)::DOUBLE / 10000 AS p, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer) GROUP BY 1", "risk l3")
def security_posture(t: Tables) -> DataFrame:
    return S.posture(t.customer.select("c_mktsegment", (F.col("c_custkey") % 100 / 10000.0).alias("p"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w")), ["c_mktsegment"], "p", "w")


@query("SELECT p_partkey, 0.02 / (1.0 / (d * 24)) AS threshold, 1 / (1 - g / 100) AS outage_burn, 14.4 * 3600 / (1 / (1 - g / 100)) AS detectable_s, round(p_size / (p_retailprice / 100) * 100, 4) AS impact_pct, 8 / (p_retailprice * 0.1 * 0.9) * pow(0.5 / 0.05, 2) AS canary_s FROM (SELECT *, p_size::DOUBLE AS d, 90 + p_size / 6.0::DOUBLE AS g FROM part)", "threshold outage_burn detectable_s impact_pct canary_s")
def slo_arithmetic(t: Tables) -> DataFrame:
    g = 90 + F.col("p_size") / 6.0
    return t.part.select("p_partkey", S.derived_threshold(F.col("p_size")).alias("threshold"), S.full_outage_burn(g).alias("outage_burn"), S.detectable_outage_seconds(g, 14.4, 1.0).alias("detectable_s"), S.budget_impact(F.col("p_size"), F.col("p_retailprice") / 100).alias("impact_pct"), S.canary_seconds(F.col("p_retailprice"), 0.1, 0.5, 0.05).alias("canary_s"))


@query("SELECT p_partkey FROM (SELECT p_partkey, 90.0 AS target, 90 + p_size / 5.05 AS achieved FROM part) WHERE -log10(greatest(1 - achieved / 100, 1e-9)) >= -log10(greatest(1 - target / 100, 1e-9)) + 1")
def slo_uncalibrated(t: Tables) -> DataFrame:
    return S.uncalibrated(t.part.select("p_partkey", F.lit(90.0).alias("target"), (90 + F.col("p_size") / 5.05).alias("achieved")), "target", "achieved").select("p_partkey")


_BND = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events WHERE {w}) WHERE r <= {n}"


@query(f"SELECT event_type, quantile_cont(a.value - b.value, 0.5) AS shift FROM ({_BND.format(w='NOT ' + AFTER, n=100)}) b JOIN ({_BND.format(w=AFTER, n=100)}) a USING (event_type) GROUP BY 1", "shift")
def regression_hodges_lehmann(t: Tables) -> DataFrame:
    return S.hodges_lehmann(t.events, T, "event_id", "value", after(), 100)


@query(f"WITH s AS ({_BND.format(w='true', n=80)}), m AS (SELECT event_type, quantile_cont((b.value - a.value) / (b.user_id - a.user_id), 0.5) AS slope FROM s a JOIN s b USING (event_type) WHERE b.user_id > a.user_id GROUP BY 1) SELECT event_type, slope, quantile_cont(value - slope * user_id, 0.75) AS base FROM s JOIN m USING (event_type) GROUP BY ALL", "slope base")
def db_budget_calibration(t: Tables) -> DataFrame:
    return S.theil_sen(t.events, T, "event_id", "user_id", "value", 80)


@query()
def regression_bootstrap(t: Tables) -> DataFrame:
    return S.bootstrap(t.events, T, "value", after(), 50)


_V = "(SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 300 + user_id % 50 ELSE 20 + user_id % 40 END::DOUBLE AS v FROM events)"
_BI = f"WITH s AS (SELECT event_type, count(*) AS n, min(v) AS lo, max(v) AS hi, greatest(8, least(40, floor(sqrt(count(*)))))::INT AS bins FROM {_V} GROUP BY 1), w AS (SELECT *, (hi - lo) / bins AS width FROM s), c AS (SELECT event_type, least(floor((v - lo) / width), bins - 1)::INT AS b, count(*) AS c FROM {_V} JOIN w USING (event_type) GROUP BY ALL), g0 AS (SELECT w.*, unnest(range(0, bins))::INT AS b FROM w), g1 AS (SELECT g0.*, coalesce(c, 0) AS c FROM g0 LEFT JOIN c USING (event_type, b)), g2 AS (SELECT *, (coalesce(lag(c) OVER o, c) + c + coalesce(lead(c) OVER o, c)) / 3.0::DOUBLE AS s FROM g1 WINDOW o AS (PARTITION BY event_type ORDER BY b)), g AS (SELECT *, s > coalesce(lag(s) OVER o, -1) AND s >= coalesce(lead(s) OVER o, -1) AND s > 0 AS peak FROM g2 WINDOW o AS (PARTITION BY event_type ORDER BY b)), p AS (SELECT a.event_type, a.b AS b1, z.b AS b2, least(a.s, z.s) AS small FROM g a JOIN g z USING (event_type) WHERE a.peak AND z.peak AND z.b > a.b + 1), v AS (SELECT p.event_type, b1, b2, small, min({{'s': g.s, 'b': g.b}}) AS v FROM p JOIN g USING (event_type) WHERE g.b > b1 AND g.b < b2 GROUP BY ALL), x AS (SELECT event_type, min({{'ratio': v.s / small, 'b1': b1, 'b2': b2, 'at': v.b}}) AS x FROM v GROUP BY 1), j AS (SELECT w.*, x.ratio AS valley_ratio, lo + (x.at + 0.5::DOUBLE) * width AS split FROM w LEFT JOIN x USING (event_type)) SELECT event_type, n, valley_ratio, split, count(*) FILTER (WHERE v <= split) AS low_n, count(*) FILTER (WHERE v > split) AS high_n, coalesce(valley_ratio < 0.5 AND count(*) FILTER (WHERE v <= split) >= greatest(3, floor(0.1 * n)) AND count(*) FILTER (WHERE v > split) >= greatest(3, floor(0.1 * n)), false) AS bimodal FROM {_V} JOIN j USING (event_type) GROUP BY event_type, n, valley_ratio, split"


@query(_BI, "valley_ratio split")
def anomaly_bimodality(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, 300 + F.col("user_id") % 50).otherwise(20 + F.col("user_id") % 40).cast("double")
    return S.bimodality(t.events.select("event_type", v.alias("v")), T, "v")


@query("SELECT *, CASE WHEN usage_pct >= 95 OR faults > 100 THEN 'critical' WHEN usage_pct >= 85 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT event_type, avg(CASE WHEN event_id % 2 = 0 THEN (1 - user_id % 100 / 1000.0::DOUBLE) * 100 ELSE user_id % 1000 / 1000.0::DOUBLE * 100 END) AS usage_pct, max(event_id % 90) AS faults FROM events GROUP BY 1)", "usage_pct")
def system_memory(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return S.memory(t.events, T, u % 1000, F.lit(1000.0), F.when(F.col("event_id") % 2 == 0, u % 100), F.col("event_id") % 90)


@query("SELECT *, CASE WHEN await_ms > 50 THEN 'critical' WHEN await_ms > 20 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT event_type, count(*) / 60.0::DOUBLE AS iops, sum(user_id * 100 + event_id) / 1048576 / 60 AS mb_s, avg(value) AS await_ms FROM events GROUP BY 1)", "iops mb_s await_ms")
def system_disk_io(t: Tables) -> DataFrame:
    return S.disk_io(t.events, T, F.col("user_id") * 100, F.col("event_id"), F.lit(1), F.col("value"), 60.0)


@query("SELECT *, second > 1.0 * first AS congested, neg > 0 AS skewed FROM (SELECT event_type, var_pop(value) FILTER (WHERE i <= n // 2) AS first, var_pop(value) FILTER (WHERE i > n // 2) AS second, count(*) FILTER (WHERE value < 0) AS neg FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1)".replace("SELECT *, second", "SELECT * EXCLUDE (neg), second", 1), "first second")
def network_congestion(t: Tables) -> DataFrame:
    return S.congestion(t.events, T, "event_id", "value", 1.0)


_TY = "CASE (p_partkey + {k}) % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'double' ELSE 'string' END"


@query(f"WITH a AS (SELECT p_brand AS table_name, p_partkey AS column_name, {_TY.format(k=0)} AS old_type FROM part WHERE p_partkey % 7 > 0), b AS (SELECT p_brand AS table_name, p_partkey AS column_name, CASE WHEN p_partkey % 3 = 0 THEN {_TY.format(k=1)} ELSE {_TY.format(k=0)} END AS new_type FROM part WHERE p_partkey % 11 > 0) SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'dropped' WHEN old_type = new_type THEN 'same' WHEN (old_type, new_type) IN (('int', 'long'), ('int', 'double'), ('long', 'double')) THEN 'compatible' ELSE 'breaking' END AS change FROM a FULL JOIN b USING (table_name, column_name)")
def schema_difference(t: Tables) -> DataFrame:
    def kind(k: int):
        x = (F.col("p_partkey") + k) % 4
        return F.when(x == 0, "int").when(x == 1, "long").when(x == 2, "double").otherwise("string")

    cols = [F.col("p_brand").alias("table_name"), F.col("p_partkey").alias("column_name")]
    a = t.part.filter("p_partkey % 7 > 0").select(*cols, kind(0).alias("type"))
    return S.schema_diff(a, t.part.filter("p_partkey % 11 > 0").select(*cols, F.when(F.col("p_partkey") % 3 == 0, kind(1)).otherwise(kind(0)).alias("type")))
