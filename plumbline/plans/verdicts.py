"""Queries of the verdicts: gates, tool SLOs, scores, normalised traces, merged sketches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import descriptive as D
from ..operators import verdicts as V
from .content import FIND, findings
from .registry import ORACLES, Tables, query
from .scores import _BND
from .series import AFTER, after
from .spans import X, spans

T = ["event_type"]


def _cdf(x: str) -> str:
    """Abramowitz and Stegun 26.2.17, as ``functions.scalar.normal_cdf`` has it."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"(1 - exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly})"  # of |x|


@query(f"SELECT *, greatest(0, least(1, 2 * (1 - {_cdf('z')}))) AS p FROM ({ORACLES['regression_mann_whitney']})".replace("OVER (PARTITION", "OVER (PARTITION"), "u z p")
def regression_mann_whitney_p(t: Tables) -> DataFrame:
    return V.mann_whitney_p(t.events, T, "value", after()).withColumn("z", F.round(F.col("z") + F.lit(3.3e-8), 6)).withColumn("p", V.p_of_z(F.col("z")))


_WALSH = f"SELECT event_type, quantile_cont((a.value + b.value) / 2, 0.5) AS pseudo_median FROM ({_BND.format(w='NOT ' + AFTER, n=250)}) a JOIN ({_BND.format(w='NOT ' + AFTER, n=250)}) b USING (event_type) WHERE a.r <= b.r GROUP BY 1"
_SHIFT = f"SELECT event_type, quantile_cont(a.value - b.value, 0.5) AS shift FROM ({_BND.format(w='NOT ' + AFTER, n=250)}) b JOIN ({_BND.format(w=AFTER, n=250)}) a USING (event_type) GROUP BY 1"


@query(_WALSH, "pseudo_median")
def regression_pseudo_median(t: Tables) -> DataFrame:
    return V.pseudo_median(t.events.filter(~after()), T, "event_id", "value")


def _lifted(by: str) -> str:
    """Events whose value after the change is higher for clicks."""
    return f"(SELECT event_id, event_type, ts, CASE WHEN {AFTER} AND event_type = 'click' THEN value * {by} ELSE value END AS value FROM events)"


_STEP = (
    "WITH e AS " + _lifted("2.5") + ", s AS (SELECT event_type, avg(value) FILTER (WHERE NOT {a}) AS mb, avg(value) FILTER (WHERE {a}) AS ma, stddev_samp(value) FILTER (WHERE NOT {a}) AS sb, stddev_samp(value) FILTER (WHERE {a}) AS sa, "
    "count(*) FILTER (WHERE NOT {a}) AS nb, count(*) FILTER (WHERE {a}) AS na, quantile_cont(value, 0.99) FILTER (WHERE NOT {a}) AS qb, quantile_cont(value, 0.99) FILTER (WHERE {a}) AS qa FROM e GROUP BY 1), "
    "v AS (SELECT event_type, (ma - mb) / sqrt(sa * sa / na + sb * sb / nb) AS t, (ma - mb) / sb AS effect, (ma - mb) / abs(mb) * 100 AS change_pct, (qa - qb) / abs(qb) * 100 AS p99_change_pct FROM s), "
    "h AS (" + _SHIFT.replace("FROM events", "FROM e") + "), m AS (" + _WALSH.replace("FROM events", "FROM e") + "), "
    "j AS (SELECT event_type, 2 * (1 - " + _cdf("t") + ") AS p, effect, change_pct, p99_change_pct, shift, pseudo_median FROM v JOIN h USING (event_type) JOIN m USING (event_type)), "
    "k AS (SELECT *, p < 0.05 AS statistical, shift > 10 OR (pseudo_median > 0 AND shift > 0.05 * pseudo_median) AS practical, abs(effect) > 0.5 AS magnitude FROM j), "
    "l AS (SELECT *, statistical AND practical AND magnitude AND shift > 0 AS regressed, greatest(abs(change_pct), abs(p99_change_pct)) AS most FROM k) "
    "SELECT * EXCLUDE (most), CASE WHEN NOT regressed THEN 'info' WHEN most >= 50 OR abs(effect) >= 1.2 THEN 'critical' WHEN most >= 25 OR abs(effect) >= 0.8 THEN 'high' WHEN most >= 10 OR abs(effect) >= 0.5 THEN 'medium' ELSE 'low' END AS severity, "
    "CASE WHEN statistical THEN 0.6 * (1 - p) + 0.4 * least(1, abs(effect) / 0.8) ELSE 0 END AS confidence FROM l"
)


@query(_STEP.replace("{a}", AFTER), "p effect change_pct p99_change_pct shift pseudo_median confidence")
def regression_verdict(t: Tables) -> DataFrame:
    lifted = F.when(after() & (F.col("event_type") == "click"), F.col("value") * 2.5).otherwise(F.col("value"))
    return V.three_gates(t.events.withColumn("value", lifted), T, "event_id", "value", after())


_CHANGE = "CASE WHEN abs(c) >= 50 THEN 'critical' WHEN abs(c) >= 25 THEN 'high' WHEN abs(c) >= 10 THEN 'medium' WHEN abs(c) >= 5 THEN 'low' ELSE 'info' END"


@query(f"SELECT p_partkey, {_CHANGE} AS severity FROM (SELECT p_partkey, p_size * 1.5 - 30 AS c FROM part)")
def change_severity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", V.change_severity(F.col("p_size") * 1.5 - 30).alias("severity"))


_RUNS = "(SELECT event_type, event_id % 50 AS submitted, (event_id % 50) // 2 AS scored, (event_id % 50) // 4 AS rejected, (event_id % 50) // 8 AS failed FROM events)"


@query(f"SELECT *, yield >= 0.995 AS meets_target FROM (SELECT *, greatest(0, submitted - scored - rejected - failed) AS silent_drop, round(CASE WHEN submitted > 0 THEN (scored + rejected)::DOUBLE / submitted END, 6) AS yield FROM (SELECT event_type, sum(submitted)::BIGINT AS submitted, sum(scored)::BIGINT AS scored, sum(rejected)::BIGINT AS rejected, sum(failed)::BIGINT AS failed FROM {_RUNS} GROUP BY 1))")
def slo_analytical_yield(t: Tables) -> DataFrame:
    n = F.col("event_id") % 50
    part = lambda k: F.floor(n / k)
    return V.analytical_yield(t.events.select("event_type", n.alias("submitted"), part(2).alias("scored"), part(4).alias("rejected"), part(8).alias("failed")), T)


@query("SELECT *, fresh >= 0.95 AS meets_target FROM (SELECT event_type, round(avg(CASE WHEN value <= 15 THEN 1.0 ELSE 0.0 END), 6) AS fresh FROM events GROUP BY 1)")
def slo_freshness(t: Tables) -> DataFrame:
    return V.freshness(t.events, T, F.col("value"))


@query(f"SELECT *, acted_on > 0.3 AS meets_target FROM (SELECT category, round(avg(CASE WHEN line % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE severity IN ('critical', 'high')), 6) AS acted_on FROM {FIND} GROUP BY 1)")
def slo_actionability(t: Tables) -> DataFrame:
    return V.actionability(findings(t), ["category"], F.col("line") % 3 == 0, ("critical", "high"))


def _score(x: str, g: float, p: float, z: float) -> str:
    return f"CASE WHEN {x} <= {g} THEN 100.0 WHEN {x} <= {p} THEN 50 + 50 * ({p} - {x}) / ({p} - {g}) ELSE greatest(0, 50 * ({z} - {x}) / ({z} - {p})) END"


@query(f"SELECT event_id, {_score('value * 50', 2500, 4000, 8000)} AS lcp, {_score('value * 3', 100, 300, 600)} AS fid, {_score('value / 300', 0.1, 0.25, 0.5)} AS cls FROM events", "lcp fid cls")
def page_timing_scores(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", V.lcp_score(v * 50).alias("lcp"), V.fid_score(v * 3).alias("fid"), V.cls_score(v / 300).alias("cls"))


_RES = f"(SELECT 'f' || p_partkey || '.py' AS file_path, coalesce(n, 0) AS findings, greatest(0, 100 - coalesce(p, 0))::DOUBLE AS score, CASE WHEN n IS NULL THEN 0.05 ELSE 1.0 END::DOUBLE AS weight FROM part LEFT JOIN (SELECT file_path, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) AS p FROM {FIND} GROUP BY 1) f ON f.file_path = 'f' || p_partkey || '.py')"


def _resources(t: Tables) -> DataFrame:
    return V.resource_scores(findings(t), "file_path", t.part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path")))


@query(f"SELECT * FROM {_RES}", "score weight")
def resource_scores(t: Tables) -> DataFrame:
    return _resources(t)


@query(f"SELECT sum(weight * score) / sum(weight) AS score FROM {_RES}", "score")
def resource_density(t: Tables) -> DataFrame:
    return V.density_score(_resources(t))


_TREE = "WITH RECURSIVE s AS MATERIALIZED {s}, d AS (SELECT trace_id, span_id, {first} AS x FROM s WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, {step} FROM d JOIN s ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id) "


@query(_TREE.format(s=f"(SELECT *, start_ms + duration_ms AS end_ms FROM {X})", first="end_ms", step="least(s.end_ms, d.x)") + "SELECT trace_id, span_id, x AS effective_end_ms, s.end_ms - x > 0.25 * s.duration_ms AS severe FROM d JOIN s USING (trace_id, span_id)", "effective_end_ms")
def trace_truncated(t: Tables) -> DataFrame:
    return V.truncated(spans(t))


_KIND = f"(SELECT *, CASE WHEN span_id % 2 = 1 THEN 'CLIENT' ELSE 'SERVER' END AS kind FROM {X})"
_OWN = f"(SELECT s.*, coalesce(CASE WHEN s.kind = 'SERVER' AND s.service <> c.service THEN round(c.start_ms + (c.duration_ms - s.duration_ms) / 2 - s.start_ms, 6) END, 0) AS own, coalesce(s.kind = 'SERVER' AND s.service <> c.service AND (abs(c.start_ms + (c.duration_ms - s.duration_ms) / 2 - s.start_ms) > 50 OR c.duration_ms < s.duration_ms), false) AS heavy FROM {_KIND} s LEFT JOIN (SELECT * FROM {_KIND} WHERE kind = 'CLIENT') c ON c.trace_id = s.trace_id AND c.span_id = s.parent_span_id)"


@query(_TREE.format(s=_OWN, first="own", step="s.own + d.x") + "SELECT trace_id, span_id, start_ms + x AS start_ms, x AS offset_ms, heavy FROM d JOIN s USING (trace_id, span_id)", "start_ms offset_ms")
def trace_skew_corrected(t: Tables) -> DataFrame:
    return V.skew_corrected(spans(t).withColumn("kind", F.when(F.col("span_id") % 2 == 1, "CLIENT").otherwise("SERVER")))


@query()
def kll_merged_quantiles(t: Tables) -> DataFrame:
    """Daily states merged to one a type; rank error is tested on a fixture."""
    daily = D.kll_states(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    return D.kll_read(D.kll_merged(daily, T), T, (0.5, 0.9, 0.99))
