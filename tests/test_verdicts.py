"""Worked numbers of verdicts, burn rates, warm-up and trace normalisation, and their results at the edges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import descriptive, resources, slo, verdicts

T0 = dt.datetime(2024, 1, 1)


def sli(spark, rows):
    return spark.createDataFrame([("s", T0 + dt.timedelta(hours=h), g, n, r) for h, g, n, r in rows], "service string, ts timestamp, good long, total long, rejected long")


def test_rejections_burn_no_budget_and_the_window_holds_both_ends(spark):
    rows = sli(spark, [(0, 90, 100, 10), (1, 80, 100, 5), (2, 100, 100, 0), (3, None, None, None)])
    got = {h: slo.burn_rate(rows, ["service"], 90.0, F.lit(T0 + dt.timedelta(hours=2)), h).first() for h in (0, 1, 2)}
    assert [(got[h]["total"], got[h]["bad"]) for h in (0, 1, 2)] == [(100, 0), (200, 15), (300, 15)]
    assert got[1]["burn_rate"] == pytest.approx(0.75)
    daily = slo.daily_budgets(sli(spark, [(0, 9, 10, 0), (24, 8, 10, 1), (30, 10, 10, 0)]), ["service"], 90.0, F.lit(T0 + dt.timedelta(hours=48)), 5).collect()
    assert {r["day"]: (r["total"], r["bad"]) for r in daily} == {0: (20, 1), 1: (20, 2), 2: (10, 1)}  # an instant between two days is in both


def test_incidents_end_at_the_first_good_step(spark):
    marks = ["normal", "warning", "critical", "normal", "warning", "normal", "critical"]
    burns = spark.createDataFrame([("s", i, m, float(i)) for i, m in enumerate(marks)], "service string, step int, severity string, burn_rate double")
    got = [tuple(r) for r in slo.incidents(burns, ["service"], "step", step_hours=1.0, least_hours=1.5).collect()]
    assert got == [("s", 1, 3, 2, 2.0, "critical")]
    assert len(slo.incidents(burns, ["service"], "step").collect()) == 2 and slo.incidents(burns.filter("step < 0"), ["service"], "step").count() == 0


@pytest.mark.parametrize(("rates", "state"), [([90, 50], "insufficient_data"), ([90, 4, 90], "collapsed"), ([90, 85, 88], "stable"), ([90, 50, 65, 78], "warming"), ([90, 50, 50, 49, 50], "flatlined"), ([90, 50, 60, 45, 60], "warming"), ([90, None, 50, 51], "warming")])
def test_warmup_states(spark, rates, state):
    rows = [("c", i, r or 0, 0 if r is None else 100 - r) for i, r in enumerate(rates)]
    got = resources.warmup(spark.createDataFrame(rows, "cache string, i int, hits long, misses long"), ["cache"], "i").collect()
    assert [r["state"] for r in got] == [state]


def test_optimal_pool(spark):
    rows = [(100, 200.0), (10, 5000.0), (1, 1.0)]
    assert [r[0] for r in spark.createDataFrame(rows, "c int, ms double").select(resources.optimal_pool(F.col("c"), F.col("ms"))).collect()] == [100, 75, 5]


def test_three_gates(spark):
    rng = random.Random(5)
    rows = [(i, k, a, rng.gauss(100, 10) + (lift if a else 0)) for k, lift in (("same", 0), ("up", 20), ("small", 2)) for i in range(400) for a in (False, True)]
    df = spark.createDataFrame(rows, "id long, k string, after boolean, v double")
    got = {r["k"]: r for r in verdicts.three_gates(df, ["k"], "id", "v", F.col("after")).collect()}
    assert [got[k]["regressed"] for k in ("same", "up", "small")] == [False, True, False]
    assert got["up"]["severity"] == "critical" and got["same"]["severity"] == "info" and got["up"]["confidence"] > 0.99 and not got["small"]["practical"]


def test_p_values(spark):
    got = spark.createDataFrame([(2.0, 10.0), (1.96, 1000.0), (3.0, 0.0), (0.0, 5.0)], "t double, df double").select(verdicts.p_of_t(F.col("t"), F.col("df"))).collect()
    assert [round(r[0], 4) for r in got] == [0.0734, 0.05, 1.0, 1.0]


def test_merged_sketches_keep_their_rank_error(spark):
    df = spark.range(60000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20).alias("part"), (F.abs(F.xxhash64("id")) % 10**6).cast("double").alias("v"))
    states = descriptive.kll_states(df, ["k", "part"], "v")
    got = descriptive.kll_read(descriptive.kll_merged(states, ["k"]), ["k"], (0.1, 0.5, 0.99)).collect()
    for r in got:
        own = sorted(x[0] for x in df.filter(F.col("k") == r["k"]).select("v").collect())
        assert all(abs(sum(v <= r[c] for v in own) / len(own) - q) < 0.03 for c, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)))
    assert descriptive.kll_merged(states.filter("k > 5"), ["k"]).count() == 0


def test_traces_are_truncated_and_shifted(spark):
    rows = [(1, 1, None, "a", "CLIENT", 0.0, 100.0), (1, 2, 1, "b", "SERVER", 200.0, 60.0), (1, 3, 2, "b", "INTERNAL", 210.0, 500.0), (1, 4, 99, "c", "SERVER", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "trace_id long, span_id long, parent_span_id long, service string, kind string, start_ms double, duration_ms double")
    skew = {r["span_id"]: (r["start_ms"], r["offset_ms"], r["heavy"]) for r in verdicts.skew_corrected(df).collect()}
    assert skew == {1: (0.0, 0.0, False), 2: (20.0, -180.0, True), 3: (30.0, -180.0, False), 4: (5.0, 0.0, False)}
    ends = {r["span_id"]: (r["effective_end_ms"], r["severe"]) for r in verdicts.truncated(df).collect()}
    assert ends == {1: (100.0, False), 2: (100.0, True), 3: (100.0, True), 4: (6.0, False)}
    assert verdicts.truncated(df.filter("trace_id = 2")).count() == 0


def test_tool_slos_and_scores(spark):
    runs = spark.createDataFrame([("a", 100, 90, 5, 1), ("b", 0, 0, 0, 0)], "k string, submitted long, scored long, rejected long, failed long")
    got = {r["k"]: (r["silent_drop"], r["yield"], r["meets_target"]) for r in verdicts.analytical_yield(runs, ["k"]).collect()}
    assert got == {"a": (4, 0.95, False), "b": (0, None, None)}
    found = spark.createDataFrame([("r1", "critical")] * 6 + [("r2", "low"), ("r2", None)], "resource string, severity string")
    scores = verdicts.resource_scores(found, "resource", spark.createDataFrame([("r1",), ("r3",)], "resource string"))
    assert {r["resource"]: (r["findings"], r["score"], r["weight"]) for r in scores.collect()} == {"r1": (6, 0.0, 1.0), "r2": (2, 98.0, 1.0), "r3": (0, 100.0, 0.05)}
    assert verdicts.density_score(scores).first()[0] == pytest.approx((98 + 5) / 2.05) and verdicts.density_score(scores.filter("score > 1000")).first()[0] == 100
    timing = spark.createDataFrame([(2500.0,), (3250.0,), (6000.0,), (9000.0,), (None,)], "x double").select(verdicts.lcp_score(F.col("x"))).collect()
    assert [r[0] for r in timing] == [100.0, 75.0, 25.0, 0.0, None]
