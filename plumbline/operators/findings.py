"""Snapshots, issues, baselines, quality gates, ratings, calibration and scores over rows of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BETTER_LOW = ("issues", "debt", "complexity", "duplication", "vulnerabilities", "error", "latency")


def upserted(store: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The store with rows of ``new`` put in or in place of rows with their key."""
    return store.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def metric_trend(snapshots: DataFrame, by: Sequence[str], ts: str, value: str, lower: Column, band: float = 5.0) -> DataFrame:
    """Last against previous value: change, change %, direction; metrics with two values or more."""
    w = W.partitionBy(*by).orderBy(ts)
    p = snapshots.withColumn("prev", F.lag(value).over(w)).withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(F.col(ts).desc()))).filter("__r = 1 and prev is not null")
    p = p.select(*by, F.col(value).alias("current"), F.col("prev").alias("previous")).withColumn("change", F.col("current") - F.col("previous"))
    p = p.withColumn("change_pct", F.when(F.col("previous") != 0, F.col("change") / F.abs("previous") * 100).otherwise(0.0))
    return p.withColumn("direction", F.when(F.abs("change_pct") < band, "stable").when((F.col("change_pct") < 0) == lower, "improving").otherwise("degrading"))


def density(findings: DataFrame, by: Sequence[str], lines: Column) -> DataFrame:
    """Findings per thousand lines, by severity; 0 without lines."""
    g = findings.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"), F.max(lines).alias("loc"))
    return g.withColumn("density", F.when(F.col("loc") > 0, F.col("n") / F.col("loc") * 1000).otherwise(0.0))


def matched(findings: DataFrame, issues: DataFrame, near: int = 5) -> DataFrame:
    """Each finding's open issue of the same rule and file at most ``near`` lines off (the nearest, then the smallest id), else null.

    Lines fall in buckets of that width, so the range join is an equi join on three neighbouring buckets.
    """
    f = findings.withColumn("__b", F.explode(F.array(*[F.floor(F.col("line") / near) + d for d in (-1, 0, 1)])))
    i = issues.filter("status in ('open', 'confirmed')").select("rule_id", "file_path", F.col("line").alias("iline"), "issue_id", F.floor(F.col("line") / near).alias("__b"))
    j = f.join(i, ["rule_id", "file_path", "__b"]).filter(F.abs(F.col("line") - F.col("iline")) <= near)
    best = j.groupBy("finding_id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("iline")).alias("gap"), "issue_id")).alias("x")).select("finding_id", "x.issue_id")
    return findings.join(best, "finding_id", "left")


def resolved(issues: DataFrame, scan: Column) -> DataFrame:
    """Open issues that the scan hasn't seen are resolved."""
    gone = F.col("status").isin("open", "confirmed") & (F.col("last_seen") < scan)
    return issues.withColumn("status", F.when(gone, "resolved").otherwise(F.col("status")))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by status and severity with the total of each (grouping sets)."""
    return issues.groupingSets([["status", "severity"], ["status"], []], "status", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("first_detected").alias("oldest"))


def unsuppressed(findings: DataFrame, baseline: DataFrame, key: Sequence[str], now: Column) -> DataFrame:
    """Findings without a live entry of the baseline."""
    live = baseline.filter(F.col("expires").isNull() | (F.col("expires") > now))
    return findings.join(live.select(*key).distinct(), list(key), "left_anti")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def differential(now: DataFrame, before: DataFrame, blocking: Column) -> DataFrame:
    """Findings as pre-existing, new blocking or new advisory, by fingerprint."""
    old = before.select("fingerprint").distinct().withColumn("__o", F.lit(True))
    return now.join(old, "fingerprint", "left").withColumn("verdict", F.when(F.col("__o"), "pre_existing").when(blocking, "new_blocking").otherwise("new_advisory")).drop("__o")


def ratchet(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Only fingerprints that are still there stay in the baseline."""
    return stored.select("fingerprint").intersect(now.select("fingerprint"))


def undetermined_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rules whose fingerprints differ between two scans of the same input."""
    x, y = (d.select("rule_id", "fingerprint").distinct() for d in (a, b))
    return x.exceptAll(y).unionByName(y.exceptAll(x)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("differing"))


def gate(values: DataFrame, conditions: Sequence[tuple[str, str, float, bool]], missing: str = "skip") -> DataFrame:
    """metric, passed, blocking of each condition (metric, operator, threshold, blocking); missing metrics skip, warn or fail."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    rows = values.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(conditions)], "i int, metric string, op string, threshold double, blocking boolean")
    j = rows.join(values, "metric", "left")
    ok = None
    for name, fn in ops.items():
        x = fn(F.col("value"), F.col("threshold"))
        ok = F.when(F.col("op") == name, x) if ok is None else ok.when(F.col("op") == name, x)
    status = F.when(F.col("value").isNull(), {"skip": "skipped", "warn": "warning", "fail": "failed"}[missing]).when(ok, "passed").when(F.col("blocking"), "failed").otherwise("warning")
    return j.withColumn("status", status).select("metric", "op", "threshold", "value", "status")


def gate_status(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") == "passed").alias("passed")).withColumn("status", F.when(F.col("failed") > 0, "FAILED").when(F.col("warnings") > 0, "WARNING").when(F.col("passed") > 0, "PASSED").otherwise("NOT_EVALUATED"))


def security_score(findings: DataFrame, by: Sequence[str], lines: Column) -> DataFrame:
    """100 * .4^critical * .8^high * .9^medium * .95^low; medium and low are damped by category (n^.8) and by size, max(1, sqrt(lines / 1000))."""
    n = lambda s: F.count_if(F.col("severity") == s)
    c = findings.groupBy(*by, "category").agg(n("critical").alias("c"), n("high").alias("h"), F.pow(n("medium"), F.lit(0.8)).alias("m"), F.pow(n("low"), F.lit(0.8)).alias("l"), F.max(lines).alias("loc"))
    g = c.groupBy(*by).agg(F.sum("c").alias("c"), F.sum("h").alias("h"), F.sum("m").alias("m"), F.sum("l").alias("l"), F.max("loc").alias("loc"))
    s = F.greatest(F.lit(1.0), F.sqrt(F.col("loc") / 1000))
    raw = 100 * F.pow(F.lit(0.4), F.col("c")) * F.pow(F.lit(0.8), F.col("h")) * F.pow(F.lit(0.9), F.col("m") / s) * F.pow(F.lit(0.95), F.col("l") / s)
    return g.select(*by, F.floor(raw + 0.5).cast("double").alias("score"))


def grade(score: Column) -> Column:
    """A from .90, B from .80, C from .70, D from .60, else E."""
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("E")


def count_utility(weighted: Column, lines: Column) -> Column:
    return F.exp(-8 * weighted / (lines + 200))


def debt_percent(minutes: Column, lines: Column) -> Column:
    return F.when(lines > 0, minutes / (lines * 30) * 100).otherwise(0.0)


def interest(files: DataFrame, legs: Sequence[tuple[str, float]]) -> DataFrame:
    """Weighted mean of percentile ranks (share of files strictly below)."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    out = files
    for c, _ in legs:
        below = F.rank().over(W.orderBy(c)) - 1
        out = out.withColumn(f"{c}_rank", F.when(n > 1, below / (n - 1)).otherwise(0.0))
    return out.withColumn("interest", sum((w * F.col(f"{c}_rank") for c, w in legs), F.lit(0.0)))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """Nearest-rank percentile."""
    w = W.partitionBy(*by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count(value).over(w))
    return r.filter(F.col("__r") == F.greatest(F.lit(1), F.ceil(F.lit(p / 100) * F.col("__n")))).select(*by, F.col(value).alias("value"))


def precision_recall(truth: DataFrame, found: DataFrame, by: Sequence[str], beta: float = 1.0) -> DataFrame:
    """tp, fp, fn, precision, recall, F-beta over keys (id within ``by``)."""
    t, f = truth.select(*by, "id").distinct().withColumn("t", F.lit(1)), found.select(*by, "id").distinct().withColumn("f", F.lit(1))
    g = t.join(f, [*by, "id"], "full").groupBy(*by).agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    b = beta * beta
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f_beta", F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0)))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Equal bins of score: count, mean score, hit rate."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("hit_rate"))


def brier(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, fitted: pool-adjacent-violators over distinct x values."""
    g = df.groupBy(F.col(x).alias("x")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).alias("w"))
    from pyspark.ml.regression import IsotonicRegression  # built in, and distributed

    model = IsotonicRegression(labelCol="y_", featuresCol="x_", weightCol="w_").fit(g.select(F.col("x").cast("double").alias("x_"), (F.col("s") / F.col("w")).alias("y_"), F.col("w").cast("double").alias("w_")))
    return model.transform(g.select("x", F.col("x").cast("double").alias("x_"))).select("x", F.col("prediction").alias("fitted"))


def best_findings(findings: DataFrame, key: Sequence[str]) -> DataFrame:
    """One finding a key: the most confident (then the smallest id)."""
    w = W.partitionBy(*key).orderBy(F.col("confidence").desc(), "finding_id")
    return findings.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def hotspots(findings: DataFrame) -> DataFrame:
    """priority = severity weight * (1 + min(churn, 50) / 10) * (1 + reach)."""
    return findings.withColumn("priority", F.col("weight") * (1 + F.least(F.col("churn"), F.lit(50)) / 10) * (1 + F.col("reach")))
