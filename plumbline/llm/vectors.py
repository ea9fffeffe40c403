"""Vectors as packed binaries, random-hyperplane hash strings, and grouped streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a hash string.
BITS = 60


def element(df: DataFrame, column: str) -> str:
    """numpy type that holds the column's numbers without loss."""
    kind = df.schema[column].dataType.elementType
    return "<f4" if isinstance(kind, T.FloatType) else "<f8"


def usable(column: str):
    """True for vectors that are not null, empty or zero and hold finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares of large or small numbers then neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def planes(trees: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS))


def codes(m: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees) hash strings as integers of ``BITS`` bits, the first bit the highest."""
    bits = (m @ planes(trees, m.shape[1], seed) > 0).reshape(len(m), trees, BITS)
    return (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def packed(df: DataFrame, id: str, vector: str, *more: str) -> DataFrame:
    """id, more, v (binary), dim of the usable vectors."""
    kind = element(df, vector)
    names = [id, *more]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(vector)
            values, at = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            v = [values[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(v, pa.binary()), pa.array(np.diff(at), pa.int32())], names=[*names, "v", "dim"])

    fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.filter(usable(vector)).select(*names, vector).mapInArrow(run, f"{fields}, v binary, dim int")


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys of a sorted stream; a run of over ``most`` rows comes in pieces."""
    open_: list[pa.RecordBatch] = []
    key, held = None, 0
    for b in batches:
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows] if b.num_rows else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[i] for c in columns)
            if open_ and now != key:
                yield pa.Table.from_batches(open_).combine_chunks().to_batches()[0]
                open_, held = [], 0
            key = now
            while i < j:
                n = j - i if most is None else min(j - i, most - held)
                open_.append(b.slice(i, n))
                held, i = held + n, i + n
                if most is not None and held == most:
                    yield pa.Table.from_batches(open_).combine_chunks().to_batches()[0]
                    open_, held = [], 0
    if open_:
        yield pa.Table.from_batches(open_).combine_chunks().to_batches()[0]


def per_group(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], keys: list[str], most: int | None = None):
    """A mapInArrow function that joins the small outputs of many groups into larger batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for g in grouped(batches, keys, most):
            r = fn(g)
            if r is not None and r.num_rows:
                out.append(r)
                rows += r.num_rows
            if rows > 20000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, rows = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
