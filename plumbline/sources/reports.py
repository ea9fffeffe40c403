"""Sinks: findings as SARIF, JUnit XML, Markdown and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sarif(findings: DataFrame, tool: str = "plumbline") -> DataFrame:
    """One SARIF document per rule (column sarif): a run with its results; rules bound the size of a document."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    g = findings.groupBy("rule_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results"))
    return g.select("rule_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def _escaped(c):
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def junit(findings: DataFrame) -> DataFrame:
    """One test suite per file (column xml)."""
    case = F.concat(F.lit('<testcase name="'), _escaped(F.concat_ws(":", "rule_id", F.col("line").cast("string"))), F.lit('"><failure message="'), _escaped(F.col("message")), F.lit('"/></testcase>'))
    g = findings.groupBy("file_path").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    return g.select("file_path", F.concat(F.lit('<testsuite name="'), _escaped(F.col("file_path")), F.lit('" failures="'), F.size("cases").cast("string"), F.lit('">'), F.array_join("cases", ""), F.lit("</testsuite>")).alias("xml"))


def markdown(findings: DataFrame) -> DataFrame:
    """A table row a finding (column value), ready for ``write.text``."""
    return findings.select(F.concat_ws(" | ", "severity", "rule_id", F.concat_ws(":", "file_path", F.col("line").cast("string")), F.replace(F.col("message"), F.lit("|"), F.lit("\\|"))).alias("value"))


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*")).alias("value"))
