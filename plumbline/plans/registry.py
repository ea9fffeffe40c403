"""Queries with the SQL that checks them; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
#: Added before rounding, so that numbers halfway between two rounded ones (common in interpolated percentiles) go one way.
NUDGE = 3.3e-8


class Tables:
    """The input tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, doubles: str = ""):
    """Register a function of ``Tables`` under its name; ``doubles``: result columns to round."""
    names = doubles.split()

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(F.col(c).cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0) for c in names}) if names else out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + {NUDGE}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {c}' for c in names)}) FROM ({sql}) AS result" if names else sql
        return fn

    return add
