"""Session defaults that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "plumbline", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and bench; on a cluster, pass your own session to the operators."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "4m",  # small tables of one file then keep all cores busy
        "spark.sql.files.openCostInBytes": "256k",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
