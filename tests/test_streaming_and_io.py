import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.sources import readers, reports
from plumbline.streaming import slo


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


T0 = datetime(2024, 1, 1)
ROWS = [(T0 + timedelta(minutes=m), "s", float(v)) for m, v in ((0, 10), (5, 200), (8, 300), (50, 20), (70, 500), (400, 1))]
SCHEMA = "ts timestamp, service string, value double"


def test_windows_and_sessions(spark, tmp_path):
    s = stream(spark, str(tmp_path / "a"), ROWS, SCHEMA)
    good = F.col("value") <= 100
    got = sorted((r["start"].hour, r["good"], r["total"]) for r in drained(spark, slo.tumbling_sli(s, "ts", "service", good), "sli"))
    assert got[:2] == [(0, 2, 4), (1, 0, 1)]
    burn = {r["end"]: r["burn_rate"] for r in drained(spark, slo.sliding_burn_rate(s, "ts", "service", good, 90.0, "1 hour", "1 hour"), "burn")}
    assert abs(burn[T0 + timedelta(hours=1)] - 5) < 1e-9
    inc = sorted((r["start"], r["n"]) for r in drained(spark, slo.session_incidents(s, "ts", "service", ~good), "inc"))
    assert inc == [(T0 + timedelta(minutes=5), 2), (T0 + timedelta(minutes=70), 1)]


def test_running_best(spark, tmp_path):
    s = stream(spark, str(tmp_path / "b"), [("k", 1, 90.0), ("k", 2, 60.0), ("k", 3, 95.0)], "key string, at long, rate double")
    got = sorted((r["at"], r["best"], r["fallen"]) for r in drained(spark, slo.running_best(s, "key", "at", "rate"), "best"))
    assert got == [(1, 90.0, False), (2, 90.0, True), (3, 95.0, False)]


def test_reports(spark):
    f = spark.createDataFrame([("R1", "a.py", 3, "high", 'x < "y"'), ("R1", "b.py", 1, "low", "z|z")], "rule_id string, file_path string, line int, severity string, message string")
    (doc,) = [json.loads(r["sarif"]) for r in reports.sarif(f).collect()]
    assert doc["version"] == "2.1.0" and [x["level"] for x in doc["runs"][0]["results"]] == ["error", "note"]
    assert '<failure message="x &lt; &quot;y&quot;"/>' in reports.junit(f).filter("file_path = 'a.py'").first()["xml"]
    assert reports.markdown(f).count() == reports.json_lines(f).count() == 2


def test_files_and_diffs(spark, tmp_path):
    (tmp_path / "x.py").write_text("a = 1\n")
    (tmp_path / "y.py").write_text("b = 2\n")
    files = readers.source_files(spark, str(tmp_path))
    known = files.filter(F.col("path").endswith("x.py"))
    assert [r["path"][-4:] for r in readers.changed(files, known).collect()] == ["y.py"]
    diff = spark.createDataFrame([("--- a/x.py\n+++ b/x.py\n@@ -1,2 +4,3 @@\n+q\n@@ -9 +12 @@\n",)], "d string")
    assert sorted(tuple(r) for r in readers.unified_diff(diff, "d").collect()) == [("x.py", 4, 3), ("x.py", 12, 1)]


def test_distributions(spark):
    r = spark.range(1).select(scalar.normal_cdf(F.lit(1.959964)).alias("n"), scalar.t_p_value(F.lit(2.228139), F.lit(10.0)).alias("t"), scalar.t_p_value(F.lit(0.0), F.lit(5.0)).alias("z")).first()
    assert abs(r["n"] - 0.975) < 1e-6 and abs(r["t"] - 0.05) < 1e-5 and abs(r["z"] - 1) < 1e-9
