"""Near-duplicate vectors by NN-descent (Dong, Moses and Li, 2011).

Vectors of one label keep lists of their nearest neighbours.  Lists start from
random-hyperplane leaves and are refined by local joins: the neighbours of each
vertex, forward and reverse, are compared with each other and enter each other's lists.
Every link that a comparison meets ties its two vectors, whether or not the lists have room for it; ties form components.
A list whose every entry is a link is saturated and sees nothing beyond its own component: where there are such lists,
``REPRESENTATIVES`` members of each component search once more among other components only, until no two are tied.
Members of a component are compared in blocks, so the count of links is exact within components.  An audit compares a
bounded sample of vectors with all rows; where it misses a link, another round with new leaves follows, and after
the last one an exact search in blocks.

Equal vectors of a label are one vertex with a multiplicity, so a group of copies costs nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, and vectors
without label, link with nothing; rows that repeat a vec_id count once (the greatest label, then vector); rows
without vec_id are left out; dimensions differ: no link; labels may be of any type; of equal vectors the smallest vec_id stands; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small, stash
from .vectors import BITS, batch, codes, element, matrix, packed, per_group, unit

NEIGHBOURS, TREES, LEAF, BLOCK, AUDITED, REPRESENTATIVES = 8, 8, 256, 1024, 256, 32
EDGE = "u long, v long, s double, tie boolean"


def _ties(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star over each connected part of the links among the rows."""
    rows = np.flatnonzero(near.any(axis=1))
    near, part = near[np.ix_(rows, rows)], np.arange(len(rows))
    while len(rows):
        new = np.minimum(part, np.where(near, part, len(rows)).min(axis=1))
        new = new[new]
        if (new == part).all():
            break
        part = new
    at = part != np.arange(len(rows))
    return ids[rows[at]], ids[rows[part[at]]]


def _top(ids: np.ndarray, m: np.ndarray, own: np.ndarray, k: int, least: float) -> pa.RecordBatch | None:
    """Each row's ``k`` nearest among the rows with another ``own``, and ties for all links."""
    n = len(ids)
    if n < 2:
        return None
    s = m @ m.T
    s[own[:, None] == own] = -2
    k = min(k, n - 1)
    to = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
    u, v, c = np.repeat(ids, k), ids[to].ravel(), np.take_along_axis(s, to, 1).ravel()
    keep = c > -2
    a, b = _ties(ids, s >= least)
    return batch(u=np.concatenate([u[keep], a]), v=np.concatenate([v[keep], b]), s=np.concatenate([c[keep], np.full(len(a), least)]), tie=np.arange(keep.sum() + len(a)) >= keep.sum())


def _leaf(kind: str, k: int, least: float):
    def run(g: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, m, own = g.column("id").to_numpy(), unit(matrix(g.column("v").to_pylist(), kind)), g.column("own").to_numpy()
        parts = [r for i in range(0, max(1, len(ids) - 256), 512) if (r := _top(ids[i : i + 768], m[i : i + 768], own[i : i + 768], k, least))]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    return run


def _hash(kind: str, trees: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dims, v = b.column("dim").to_numpy(), b.column("v").to_pylist()
                out = np.zeros((b.num_rows, trees), np.int64)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    out[at] = codes(unit(matrix([v[i] for i in at], kind)), trees, seed)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*b.schema.names, "codes"])

    return run


def _join(kind: str, k: int, least: float):
    return lambda g: _top(g.column("id").to_numpy(), unit(matrix(g.column("v").to_pylist(), kind)), g.column("own").to_numpy(), k, least)


def _exact(kind: str, least: float):
    """Ties between the members of two blocks."""

    def run(g: pa.RecordBatch) -> pa.RecordBatch | None:
        m = unit(matrix(g.column("v").to_pylist(), kind))
        a, b = _ties(g.column("id").to_numpy(), m @ m.T >= least)
        return batch(u=a, v=b)

    return run


def _links(kind: str, least: float):
    """Links between the members of two blocks of a component: (id, n)."""

    def run(g: pa.RecordBatch) -> pa.RecordBatch | None:
        i, j, own = g.column("i")[0].as_py(), g.column("j")[0].as_py(), g.column("own").to_numpy()
        ids, n = g.column("id").to_numpy(), g.column("n").to_numpy()
        m = unit(matrix(g.column("v").to_pylist(), kind))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        total = np.zeros(len(ids), np.int64)
        for s in range(0, len(a), 512):
            near = m[a[s : s + 512]] @ m[b].T >= least
            if i == j:
                near[np.arange(len(near)), np.arange(s, s + len(near))] = False
            total[a[s : s + 512]] += near @ n[b]
            if i != j:
                total[b] += n[a[s : s + 512]] @ near
        return batch(id=ids, n=total)

    return run


def _count(kind: str, least: float, asked: list[tuple[int, int, int, bytes]]):
    """Links of the audited vectors to the rows of a stream."""
    by: dict[tuple[int, int], list[int]] = {}
    for i, (_, label, dim, _) in enumerate(asked):
        by.setdefault((label, dim), []).append(i)
    tops = {k: (np.array(i), unit(matrix([asked[x][3] for x in i], kind))) for k, i in by.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            label, dim, v, n = b.column("label").to_numpy(), b.column("dim").to_numpy(), b.column("v").to_pylist(), b.column("n").to_numpy()
            for (x, d), (i, m) in tops.items():
                at = np.flatnonzero((label == x) & (dim == d))
                if len(at):
                    total[i] += (m @ unit(matrix([v[k] for k in at], kind)).T >= least) @ n[at]
        yield batch(id=np.array([x[0] for x in asked], np.int64), n=total)

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return once.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.col("s").desc(), "v"))).filter(F.col("r") <= k).drop("r")


def _label(vectors: DataFrame, label: str) -> Column:
    """Whole numbers as they are; labels of other types by the 64-bit hash of what they read as."""
    whole = isinstance(vectors.schema[label].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))


def near_duplicates(vectors: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", neighbours: int = NEIGHBOURS, trees: int = TREES, descents: int = 2, rounds: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector; ``rounds``: most rounds that the audit may ask for."""
    kind = element(vectors, vector)
    every = vectors.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), _label(vectors, label).alias("label"), F.col(vector).alias("e"))
    clean = stash(packed(every.filter("label is not null"), "id", "e", "label"))
    one = clean.groupBy("id").agg(F.max(F.struct("label", "v", "dim")).alias("x")).select("id", "x.*")
    group = one.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    vertex = stash(group.select(F.col("rep").alias("id"), "label", "dim", "v", "n"))
    member = stash(one.join(group, ["label", "dim", "v"]).select("id", "rep", "n"))

    def search(rows: DataFrame, seed: int, graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Lists of nearest ``rows`` (id, label, dim, v, own) that aren't of one ``own``, and ties for the links met."""
        sizes = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
        hashed = rows.select("id", "label", "dim", "v", "own").mapInArrow(_hash(kind, trees, seed), "id long, label long, dim int, v binary, own long, codes array<long>")
        deep = F.greatest(F.ceil(F.log2(F.col("size") / LEAF)), F.lit(0))
        leaf = hashed.join(small(sizes), ["label", "dim"]).select("id", "label", "dim", "v", "own", "size", F.posexplode("codes").alias("tree", "code"))
        leaf = stash(leaf.select("id", "label", "dim", "v", "own", "tree", "code", F.floor(F.col("code") / F.pow(F.lit(2.0), F.lit(BITS) - deep)).cast("long").alias("leaf")))
        keys = ["label", "dim", "tree", "leaf"]
        full = leaf.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / (8 * LEAF)).alias("over")).filter("over > 0")
        salted = leaf.join(small(full), keys, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("over", F.lit(0)) + 1))
        keys.append("salt")
        met = stash(salted.repartition(*keys).sortWithinPartitions(*keys, "code").select(*keys, "id", "v", "own").mapInArrow(per_group(_leaf(kind, neighbours // 2, least), keys), EDGE))
        ties, start = met.filter("tie"), met.filter("not tie").drop("tie")
        graph = stash(_best(start if graph is None else start.unionByName(graph), neighbours))
        for _ in range(descents):
            both = graph.select(F.col("u").alias("c"), F.col("v").alias("id")).unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("id"))).distinct()
            near = both.join(rows.select("id", "v", "own"), "id").repartition("c").sortWithinPartitions("c", F.xxhash64("id")).select("c", "id", "v", "own")
            met = stash(near.mapInArrow(per_group(_join(kind, 3, least), ["c"], BLOCK), EDGE))
            ties = ties.unionByName(met.filter("tie"))
            graph = stash(_best(graph.unionByName(met.filter("not tie").drop("tie")), neighbours))
        return graph, stash(ties.select("u", "v").unionByName(graph.filter(F.col("s") >= least).select("u", "v")).distinct())

    def blocked(rows: DataFrame, by: list[str]) -> DataFrame:
        """Rows of each ``by`` (with ``blocks``), once for each pair of blocks (i, j) that has them."""
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        return rows.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j").select(*by, "i", "j", "own", "id", "v", "n")

    def counted(of: DataFrame) -> DataFrame:
        many = of.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        pairs = blocked(of.join(many, "component_id").join(vertex.select("id", "v", "n"), "id"), ["component_id"])
        pairs = pairs.mapInArrow(per_group(_links(kind, least), ["component_id", "i", "j"]), "id long, n long")
        return stash(pairs.groupBy("id").agg(F.sum("n").alias("links")))

    graph, ties = None, None
    for turn in range(rounds):
        graph, found = search(vertex.withColumn("own", F.col("id")), turn, graph)
        ties = found if ties is None else ties.unionByName(found)
        of = stash(components(ties, "u", "v"))
        saturated = graph.groupBy("u").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("k")).filter((F.col("s") >= least) & (F.col("k") >= neighbours))
        again = rounds * (turn + 1)  # seeds that no round has
        while saturated.limit(1).count():
            again += rounds
            of_all = vertex.join(of, "id", "left").withColumn("own", F.coalesce("component_id", "id"))
            place = F.row_number().over(W.partitionBy("own").orderBy(F.xxhash64("id", F.lit(again)), "id"))
            few = stash(of_all.withColumn("r", place).filter(F.col("r") <= REPRESENTATIVES).select("id", "label", "dim", "v", "own"))
            _, found = search(few, again)
            if not found.limit(1).count():
                break
            ties = ties.unionByName(found)
            of = stash(components(ties, "u", "v"))
        links = counted(of)
        sample = vertex.orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(AUDITED)
        asked = [(r["id"], r["label"], r["dim"], bytes(r["v"])) for r in sample.collect()]
        if not asked:
            break
        true = vertex.mapInArrow(_count(kind, least, asked), "id long, n long").groupBy("id").agg(F.sum("n").alias("t"))
        missed = true.join(vertex.select("id", "n"), "id").join(links, "id", "left").filter(F.col("t") - F.col("n") != F.coalesce("links", F.lit(0)))
        if not missed.limit(1).count():
            break
    else:
        sizes = vertex.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        every_pair = blocked(vertex.join(small(sizes), ["label", "dim"]), ["label", "dim"])
        of = stash(components(every_pair.mapInArrow(per_group(_exact(kind, least), ["label", "dim", "i", "j"]), "u long, v long"), "u", "v"))
        links = counted(of)
    place = member.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(of.withColumnRenamed("id", "rep"), "rep", "left")
    place = place.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = every.select("id").distinct().join(place, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
