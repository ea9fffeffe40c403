"""Sources: driver tables, logs, source lines, changed files, diffs and trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import spans


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; time stamps without zone are taken as UTC once, here."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def source_files(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """path, text and SHA-256 of files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("hash"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash isn't the one known."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def unified_diff(df: DataFrame, column: str) -> DataFrame:
    """file, first, lines of every hunk's new side."""
    numbered = df.select(F.monotonically_increasing_id().alias("d"), F.col(column).alias("t"))
    l = numbered.select("d", F.posexplode(F.split("t", "\n")).alias("p", "s"))
    from pyspark.sql import Window as W

    name = F.when(F.col("s").startswith("+++ "), F.regexp_replace("s", r"^\+\+\+ (?:b/)?", ""))
    l = l.withColumn("file", F.last(name, True).over(W.partitionBy("d").orderBy("p")))
    rx = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    h = l.filter(F.col("s").rlike(rx))
    return h.select("file", F.regexp_extract("s", rx, 1).cast("int").alias("first"), F.coalesce(F.expr(f"try_cast(regexp_extract(s, r'{rx}', 2) as int)"), F.lit(1)).alias("lines"))


def traces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Spans of whole-file JSON documents; ``kind``: otlp, jaeger or zipkin."""
    return {"otlp": spans.otlp, "jaeger": spans.jaeger, "zipkin": spans.zipkin}[kind](spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "json"))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
