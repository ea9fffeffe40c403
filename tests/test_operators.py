"""Worked examples and edges of the library's operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import apdex, descriptive, findings, graph, pages, resources, series, slo, spans, text


def one(df):
    (r,) = df.collect()
    return r


def values(spark, xs, key="k"):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(xs)], "k string, i int, v double")


def test_percentiles_interpolate(spark):
    r = one(descriptive.summary(values(spark, range(100, 600, 50)), ["k"], "v"))
    assert (r["n"], r["min"], r["max"], r["p50"]) == (10, 100, 550, 325) and abs(r["p95"] - 527.5) < 1e-9
    with pytest.raises(ValueError):
        descriptive.percentile("v", 101)


def test_histogram_bounds_are_inclusive_and_empty_buckets_stay(spark):
    rows = {r["label"]: r["n"] for r in descriptive.histogram(values(spark, [10, 11, 10001]), ["k"], "v").collect()}
    assert len(rows) == 11 and rows["<=10"] == 1 and rows["10-25"] == 1 and rows[">10000"] == 1 and rows["25-50"] == 0


def test_sketch_is_within_its_accuracy(spark):
    df = values(spark, [1.01**i for i in range(2000)])
    q = one(descriptive.dd_quantile(descriptive.dd_sketch(df, ["k"], "v"), ["k"], 0.95))["value"]
    assert abs(q / 1.01**1899 - 1) < 0.03


def test_anchored_windows_begin_at_events(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0 + timedelta(seconds=s), 1.0) for s in (5, 30, 64, 65, 200)], "k string, ts timestamp, v double")
    assert sorted((r["window_start"].second + 60 * r["window_start"].minute, r["n"]) for r in descriptive.anchored_windows(df, ["k"], "ts", "v", 60).collect()) == [(5, 3), (65, 1), (200, 1)]


def test_backfill_of_a_stall(spark):
    df = values(spark, [100.0])
    got = sorted(r["v"] for r in apdex.backfilled(df, ["k"], "v", 1.0).collect())
    assert got == [float(x) for x in range(1, 101)]
    assert apdex.backfilled(values(spark, [0.5]), ["k"], "v", 1.0).count() == 1


def test_apdex_excludes_robots_and_frustrates_errors(spark):
    df = values(spark, [10, 10, 50, 500])
    r = one(apdex.apdex(df, ["k"], "v", 20.0, errored=F.col("i") == 0, human=F.col("i") != 3))
    assert (r["n"], r["excluded"], r["satisfied"], r["tolerating"], r["frustrated"], r["score"]) == (3, 1, 1, 1, 1, 0.5)


def test_step_and_drift(spark):
    step = values(spark, [50 + (i % 3) for i in range(40)] + [200 + (i % 3) for i in range(20)])
    r = one(series.split_window_mad(step, ["k"], "i", "v"))
    assert r["detected"] and r["change_index"] == 40 and r["magnitude"] == 150
    assert one(series.cusum(step, ["k"], "i", "v"))["alarm_index"] == 40
    assert one(series.drift(values(spark, [2 * i + (i % 2) for i in range(30)]), ["k"], "i", "v"))["detected"]
    assert series.split_window_mad(values(spark, [1, 2]), ["k"], "i", "v").count() == 0


def test_trend_of_degrading_latency(spark):
    r = one(series.trend(values(spark, range(100, 500, 20)), ["k"], "i", "v"))
    assert r["direction"] == "degrading" and r["r2"] == 1.0 and abs(r["slope"] - 20) < 1e-9


def test_seasonal_parts_add_up(spark):
    df = values(spark, [200 + 2 * i + 10 * (i % 24) for i in range(168)])
    rows = series.seasonal(df, ["k"], "i", "v", 24).filter("trend is not null").collect()
    assert len(rows) == 144 and all(abs(r["residual"]) < 1e-6 for r in rows)


def test_budget_without_events_is_unknown(spark):
    df = spark.createDataFrame([("s", datetime(2020, 1, 1), 1, 2, 0)], "service string, ts timestamp, good long, total long, rejected long")
    r = one(slo.error_budget(df, ["service"], 99.0, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")))
    assert r["status"] == "unknown" and r["total"] == 0
    assert slo.minimum_traffic(99.9) == 10000


def test_graph_cycles_and_levels(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    assert {(r["node"], r["component"]) for r in graph.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert graph.topological_levels(e, nodes).count() == 0
    assert {r["node"]: r["depth"] for r in graph.shortest_path_length(e, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert abs(sum(r["rank"] for r in graph.pagerank(e).collect()) - 1) < 1e-9


def counted(monkeypatch):
    cuts, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(1) or cut(df))
    return cuts


def test_ranks_meet_edges_no_oftener_than_paths_are_long(spark, monkeypatch):
    rows = [("n", "s", 1.0), ("n", "t", 1.0), ("s", "c", 3.0), ("t", "c", 1.0), ("t", "d", 1.0), ("t", "d", 2.0), ("e", "e", 1.0), ("f", "e", 1.0)]
    names = sorted({x for r in rows for x in r[:2]})

    def by_rounds(rows, rounds):
        total = {a: sum(w for x, _, w in rows if x == a) for a in names}
        rank = dict.fromkeys(names, 1 / len(names))
        for _ in range(rounds):
            even = 0.15 / len(names) + 0.85 * sum(rank[a] for a in names if not total[a]) / len(names)
            rank = {a: even + 0.85 * sum(rank[x] * w / total[x] for x, y, w in rows if y == a) for a in names}
        return rank

    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, "src string, dst string, weight double"), iterations=6).collect()}
    assert got == pytest.approx(by_rounds(rows, 6), abs=1e-12)
    cuts, rows = counted(monkeypatch), rows[:6]
    names = sorted({x for r in rows for x in r[:2]})
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, "src string, dst string, weight double")).collect()}
    assert got == pytest.approx(by_rounds(rows, 20), abs=1e-12)
    assert len(cuts) <= 6


def test_levels_take_edges_off_once(spark, monkeypatch):
    cuts = counted(monkeypatch)
    e = spark.createDataFrame([("n", "s"), ("n", "t"), ("s", "c"), ("t", "c"), ("n", "c"), ("c", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "nstcz"], "node string")
    assert {r["node"]: r["level"] for r in graph.topological_levels(e, nodes).collect()} == {"n": 0, "z": 0, "s": 1, "t": 1, "c": 2}
    assert len(cuts) <= 5


def test_modularity_of_a_function_of_the_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "cc"), ("cc", "dd"), ("dd", "dd")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("cc",), ("dd",)], "node string").withColumn("part", F.length("node"))
    assert graph.modularity(e, F.length).first()[0] == pytest.approx(2 / 3 - 0.5)
    assert graph.modularity(e, nodes).first()[0] == pytest.approx(2 / 3 - 0.5)
    assert graph.modularity(e.limit(0), nodes).first()[0] == 0.0


def test_orphans_go_to_the_tightest_span(spark):
    s = spark.createDataFrame([(1, 1, None, 0.0, 100.0), (1, 2, 1, 10.0, 50.0), (1, 3, 99, 20.0, 5.0)], "trace_id int, span_id int, parent_span_id int, start_ms double, duration_ms double")
    assert {r["span_id"]: r["parent_span_id"] for r in spans.orphans_adopted(s).collect()} == {1: None, 2: 1, 3: 2}


def test_fingerprints_and_masks(spark):
    df = spark.createDataFrame([("SELECT *  FROM t1 WHERE id = 12 AND n IN (1, 2) AND s = 'it\\'s'",)], "q string")
    assert one(df.select(resources.query_fingerprint(F.col("q")).alias("f")))["f"] == "SELECT * FROM T1 WHERE ID = ? AND N IN (?) AND S = ?"
    assert one(spark.range(1).select(text.masked(F.lit("abcdefgh")).alias("m"), text.masked(F.lit("abcd")).alias("s"))) == ("******gh", "****")


def test_licences_by_the_rules_of_their_sql(spark):
    known = {"éMIT": "MIT", "MIT\u0301": "MIT", "mit_": None, "xMIT": None, "B\u017fD": "BSD-3-Clause", "éGPL-3": "GPL-3.0", "apache\r2.0": "Apache-2.0", "apache ver\u017fion 2": "Apache-2.0", "CC BY-NC 4x0": None, "M\u0131T": None}
    rows = spark.createDataFrame([(x,) for x in known], "s string").select("s", text.licence(F.col("s")).alias("spdx")).collect()
    assert {r["s"]: r["spdx"] for r in rows} == known


def test_typosquats(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r["name"]: (r["popular"], r["distance"]) for r in text.typosquats(names("reqeusts", "numpy", "nunpy", "zzz"), names("requests", "numpy")).collect()}
    assert got == {"reqeusts": ("requests", 2), "nunpy": ("numpy", 1)}


def test_urls(spark):
    base = F.lit("https://a.example.org/x/y?z")
    df = spark.createDataFrame([("/b/?q#f",), ("c",), ("mailto:x@y",), ("https://o.example.org/",)], "h string").select("h", pages.normalized_url(base, F.col("h")).alias("n"), pages.link_type(base, F.col("h")).alias("t"))
    assert [tuple(r)[1:] for r in df.collect()] == [("https://a.example.org/b", "internal"), ("https://a.example.org/x/c", "internal"), (None, "mailto"), ("https://o.example.org", "external")]


def test_gate_without_metrics(spark):
    v = spark.createDataFrame([], "metric string, value double")
    r = one(findings.gate_status(findings.gate(v, [("m", "<", 1.0, True)], "skip")))
    assert r["status"] == "NOT_EVALUATED"


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, i int, v double")
    for df in (descriptive.summary(e, ["k"], "v"), apdex.apdex(e, ["k"], "v", 1.0), series.trend(e, ["k"], "i", "v"), series.change_points(e, ["k"], "i", "v")):
        assert df.count() == 0
