"""Functions that Spark lacks, as column expressions, and their registration for SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution (Abramowitz and Stegun 26.2.17; error below 7.5e-8), in JVM arithmetic."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised, by Lentz's continued fraction."""
    def cf(a, b, x):
        tiny, c = 1e-300, np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 200):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    lg = np.vectorize(math.lgamma)
    whole = x >= 1
    x = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    return np.where(whole, 1.0, np.where(swap, 1 - front * cf(b, a, 1 - x) / b, front * cf(a, b, x) / a))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    out = pd.Series(np.nan, index=t.index)
    ok = t.notna() & df.notna() & (df > 0)
    if ok.any():
        v, n = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = _incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + v * v))
    return out


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udf.register("t_p_value", t_p_value)
