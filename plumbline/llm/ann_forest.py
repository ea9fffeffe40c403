"""Nearest neighbours by a hash-prefix forest (LSH Forest: Bawa, Condie and Ganesan, 2005).

Each tree gives every vector a long hash string of random-hyperplane signs; rows are
kept in the strings' order, cut into leaves by prefix.  A query descends to its
leaf in every tree and then ascends in all trees together, a bit at a time, until
the prefixes hold enough candidates; those are scored exactly, leaf by leaf,
where rows and queries meet.  For largest inner products, vectors are lifted to
one length by a further coordinate, which turns the order by inner product into the order by angle.

The only state of the driver is a histogram of prefixes of ``DEPTH`` bits at the most.  A leaf that
outgrows a task (equal strings) is salted.  Of equal vectors only as many as can be in an
answer (k + 1, the smallest ids) are searched, and equal queries are searched once.

``share`` sets the candidates a tree gives, in parts of all rows: vectors without any cluster structure
need that for a recall of 0.9 at 20 neighbours; clustered ones do with far less.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part; rows without id take no part; of
rows that repeat an id, each is a candidate but an id is returned once, with its best score; vectors meet those of their own dimension only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash
from .vectors import BITS, batch, codes, element, matrix, packed, per_group

TREES, SHARE, FLOOR, DEPTH, LEAF = 12, 0.125, 1000, 14, 2048


def _hash(kind: str, trees: int, seed: int, longest: float, query: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            out = np.zeros((b.num_rows, trees), np.int64)
            v = b.column("v").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = matrix([v[i] for i in at], kind) / longest
                lift = np.zeros((len(m), 1)) if query else np.sqrt(np.maximum(0, 1 - (m * m).sum(axis=1, keepdims=True)))
                out[at] = codes(np.hstack([m, lift]), trees, seed)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("dim"), b.column("v"), pa.array(list(out), pa.list_(pa.int64()))], names=["id", "dim", "v", "codes"])

    return run


def _route(counts: dict[int, np.ndarray], depth: dict[int, int], salts: dict[tuple[int, int, int], int], enough: dict[int, float]):
    """Query -> the leaves under its prefixes, after ascending in all trees together."""
    tall = {d: np.concatenate([np.zeros((len(c), 1), np.int64), np.cumsum(c, axis=1)], axis=1) for d, c in counts.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["tree", "dim", "leaf", "salt", "q", "id", "v"])
            for id, dim, v, code in zip(*(b.column(c).to_pylist() for c in ("id", "dim", "v", "codes")), strict=True):
                if dim not in tall:
                    continue
                deep, sums = depth[dim], tall[dim]
                leaf = np.array(code) >> (BITS - deep)
                tree = np.arange(len(code))
                for level in range(deep, -1, -1):
                    low = (leaf >> (deep - level)) << (deep - level)
                    high = low + (1 << (deep - level))
                    if (sums[tree, high] - sums[tree, low]).sum() >= enough[dim]:
                        break
                for t in tree:
                    for x in range(low[t], high[t]):
                        rows += [(int(t), dim, int(x), s, 1, id, v) for s in range(salts.get((dim, int(t), int(x)), 1)) if counts[dim][t, x]]
                    if len(rows) > 5000:  # copies of a query's vector go out in pieces
                        yield told(rows)
                        rows = []
            yield told(rows)

    return run


def _score(kind: str, k: int):
    def run(g: pa.RecordBatch) -> pa.RecordBatch | None:
        q = g.column("q").to_numpy()
        n = int(np.searchsorted(q, 1))
        if n in (0, len(q)):
            return None
        ids, m = g.column("id").to_numpy(), matrix(g.column("v").to_pylist(), kind)
        rows, asked = m[:n], m[n:]
        out: list[tuple] = []
        for i in range(0, len(asked), 256):
            s = asked[i : i + 256] @ rows.T
            kth = np.partition(s, -min(k, n), axis=1)[:, -min(k, n)]
            near = s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]
            at, to = np.nonzero(near)
            exact = (asked[i + at] * rows[to]).sum(axis=1)  # one order of summing: equal vectors have equal scores
            order = np.lexsort((ids[to], -exact, at))
            at, to, exact = at[order], to[order], exact[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            out.append((ids[n + i + at[keep]], ids[to[keep]], exact[keep]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return batch(query_id=a, vec_id=b, score=c)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", trees: int = TREES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query among all other rows."""
    kind = element(vectors, vector)
    clean = lambda df: packed(df.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("e")), "id", "e").select("id", "v", "dim")
    rows, asked = stash(clean(vectors)), stash(clean(queries).distinct())
    square = vectors.filter(F.col(vector).isNotNull()).select(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"))
    top = square.filter("s < double('Infinity')").agg(F.max("s")).first()[0]
    longest = float(np.sqrt(top)) if top else 1.0
    own = W.partitionBy("dim", "v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k + 1).drop("r")
    hashed = stash(few.mapInArrow(_hash(kind, trees, seed, longest, False), "id long, dim int, v binary, codes array<long>"))
    first = asked.groupBy("dim", "v").agg(F.min("id").alias("id"))
    totals = {r["dim"]: r["n"] for r in hashed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    depth = {d: int(np.clip(np.ceil(np.log2(max(n, 1) / LEAF)), 0, DEPTH)) for d, n in totals.items()}
    deep = F.element_at(F.create_map(*[F.lit(x) for p in depth.items() for x in p]), F.col("dim")) if depth else F.lit(0)
    coded = hashed.select("id", "dim", "v", F.posexplode("codes").alias("tree", "code")).withColumn("leaf", F.expr("shiftright(code, 0)") if not depth else F.floor(F.col("code") / F.pow(F.lit(2.0), F.lit(BITS) - deep)).cast("long"))
    counts = {d: np.zeros((trees, 1 << x), np.int64) for d, x in depth.items()}
    for r in coded.groupBy("dim", "tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # trees x 2^DEPTH rows at most
        counts[r["dim"]][r["tree"], r["leaf"]] = r["n"]
    salts = {(d, int(t), int(x)): int(-(-c[t, x] // (2 * LEAF))) for d, c in counts.items() for t, x in zip(*np.nonzero(c > 4 * LEAF), strict=True)}
    enough = {d: trees * min(n, max(FLOOR, share * n)) for d, n in totals.items()}
    split = rows.sparkSession.createDataFrame([(*key, n) for key, n in salts.items()], "dim int, tree int, leaf long, salts int")
    placed = coded.join(F.broadcast(split), ["dim", "tree", "leaf"], "left")
    placed = placed.select("tree", "dim", "leaf", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(0).alias("q"), "id", "v")
    routed = first.select("id", "dim", "v").mapInArrow(_hash(kind, trees, seed, longest, True), "id long, dim int, v binary, codes array<long>").mapInArrow(_route(counts, depth, salts, enough), "tree int, dim int, leaf long, salt int, q int, id long, v binary")
    keys = ["tree", "dim", "leaf", "salt"]
    met = placed.unionByName(routed).repartition(*keys).sortWithinPartitions(*keys, "q", "id")
    found = met.mapInArrow(per_group(_score(kind, k + 1), keys), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    best = best.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("r") <= k + 1)
    same = asked.join(first.select("dim", "v", F.col("id").alias("rep")), ["dim", "v"]).select("id", "rep")
    out = same.join(best, F.col("rep") == F.col("query_id")).filter("vec_id != id").select(F.col("id").alias("query_id"), "vec_id", "score").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
