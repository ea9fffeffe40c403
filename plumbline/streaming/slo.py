"""Structured Streaming forms: windows with watermarks, session incidents, and a stateful running best."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_sli(events: DataFrame, ts: str, service: str, good: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """good and total by service and window; rows later than the watermark are dropped."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(service).alias("service"))
    return g.agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("total")).select("service", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "good", "total")


def sliding_burn_rate(events: DataFrame, ts: str, service: str, good: Column, target: float, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), F.col(service).alias("service")).agg(F.count_if(~good).alias("bad"), F.count(F.lit(1)).alias("total"))
    return g.select("service", F.col("w.end").alias("end"), (F.col("bad") / F.col("total") / F.lit((100 - target) / 100)).alias("burn_rate"))


def session_incidents(events: DataFrame, ts: str, service: str, bad: Column, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Bad events of a service with pauses of less than ``gap`` form one incident."""
    # the condition names the event time, so it stays above the watermark, which good events then move on too
    g = events.withWatermark(ts, late).filter(F.when(F.col(ts).isNotNull(), bad)).groupBy(F.session_window(ts, gap).alias("w"), F.col(service).alias("service")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("service", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_best(buckets: DataFrame, key: str, order: str, rate: str, drop: float = 15.0) -> DataFrame:
    """The best rate of a key so far and whether the present one has fallen by ``drop``; one double of state a key."""

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values(order)
        bests = rows[rate].cummax().clip(lower=best)
        state.update((float(bests.iloc[-1]),))
        yield pd.DataFrame({"key": str(k[0]), "at": rows[order].astype("int64"), "rate": rows[rate], "best": bests, "fallen": bests - rows[rate] > drop})

    return buckets.groupBy(key).applyInPandasWithState(step, "key string, at long, rate double, best double, fallen boolean", "best double", "append", GroupStateTimeout.NoTimeout)
