"""Graph operators over (src, dst, weight) edges: iterative joins, with lineage cut by written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Write to spark.checkpoint.dir (set a folder there on a cluster) and read again: the lineage of an iteration ends here."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, instability (out / (in + out)) of distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    g = both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return g.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None, reverse: bool = False) -> DataFrame:
    """node, depth: breadth-first from ``seeds`` (node), each node at its least depth."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = _cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = front = _cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while hops is None or depth < hops:
        depth += 1
        front = _cut(front.join(e, front["node"] == e["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = _cut(seen.unionByName(front))
    return seen


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """Weighted PageRank (src, dst, weight); the rank of dangling nodes is spread evenly.

    What a node gets evenly is one number a round, so the rank is a sum of v_j, ones sent j steps along the edges, each times a number
    that rounds of sums over dangling nodes give.  Edges are met once a step, and not at all once no path is that long.
    """
    e = _cut(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")))
    out = _cut(e.filter("src is not null").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("total")))
    nodes = _cut(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    n = max(nodes.count(), 1)
    sent = out.withColumn("v", F.lit(1.0))
    steps, loose = [nodes.withColumn("v", F.lit(1.0))], [float(nodes.count() - out.count())]
    while len(steps) <= iterations:
        given = sent.select("node", (F.col("v") / F.col("total")).alias("v")).join(e, F.col("node") == e["src"]).filter("dst is not null")
        got = given.groupBy(F.col("dst").alias("node")).agg(F.coalesce(F.sum(F.col("v") * F.col("weight")), F.lit(0.0)).alias("v"))
        met = _cut(got.join(out.withColumn("giving", F.lit(True)), "node", "left"))
        count, dangling = met.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("giving").isNull(), F.col("v"))), F.lit(0.0))).first()
        if not count:
            break
        steps.append(met.select("node", "v")), loose.append(dangling)
        sent = met.filter("giving").select("node", "total", "v")
    share = [1.0 / n]
    for _ in range(iterations):
        even = (1 - damping + damping * sum(x * d for x, d in zip(share, loose, strict=False))) / n
        share = [even, *[damping * x for x in share]]
    parts = [v.select("node", (F.col("v") * F.lit(x)).alias("rank")) for v, x in zip(steps, share, strict=False)]
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("rank").alias("rank"))


def closure(edges: DataFrame) -> DataFrame:
    """src, dst of every path, by doubling; as large as the closure itself."""
    seen = _cut(edges.select("src", "dst").distinct())
    n = seen.count()
    while True:
        step = seen.select("src", F.col("dst").alias("m")).join(seen.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
        seen = _cut(seen.unionByName(step).distinct())
        m = seen.count()
        if m == n:
            return seen
        n = m


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest member) of strongly connected components of two nodes or more."""
    c = closure(edges)
    mutual = c.join(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).filter("src != dst")
    return mutual.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: Kahn's order in layers; nodes on or behind a cycle are absent.

    Edges are counted once; a layer takes its own off, and the last one meets none.
    """
    nodes = _cut(nodes.select("node").distinct())
    e = _cut(edges.select("src", "dst").distinct().filter("src != dst").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi"))
    behind = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    left = _cut(nodes.join(behind, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")))
    out, level = [], 0
    while True:
        free, rest = left.filter("n = 0"), left.filter("n > 0")
        now, later = left.agg(F.count_if(F.col("n") == 0), F.count_if(F.col("n") > 0)).first()
        if now or not out:
            out.append(free.select("node", F.lit(level).alias("level")))
        if not now or not later:
            return reduce(DataFrame.unionByName, out)
        gone = e.join(free.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("gone"))
        left, level = _cut(rest.join(gone, "node", "left").select("node", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"))), level + 1


def shortest_path_length(edges: DataFrame, start: str) -> DataFrame:
    spark = edges.sparkSession
    return reach(edges, spark.range(1).select(F.lit(start).alias("node")))


def modularity(edges: DataFrame, partition: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """Q of a partition of the undirected, unweighted graph: (node, part), or a function of the node, which needs no join."""
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u != v").distinct()
    if isinstance(partition, DataFrame):
        p = partition
        j = e.join(p.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u").join(p.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v")
    else:
        j = e.select(partition(F.col("u")).alias("pu"), partition(F.col("v")).alias("pv"))
    ends = F.array(*[F.struct(F.col(p).alias("part"), F.when(F.lit(p == "pu") & (F.col("pu") == F.col("pv")), F.col("n")).otherwise(0).alias("inner"), "n") for p in ("pu", "pv")])
    g = j.groupBy("pu", "pv").agg(F.count(F.lit(1)).alias("n")).select(F.inline(ends)).groupBy("part").agg(F.sum("inner").alias("inside"), F.sum("n").alias("degree"))
    m = F.sum("degree") / 2.0  # an edge has two ends
    squares = F.sum(F.pow(F.col("degree").cast("double"), F.lit(2)))
    return g.agg(F.when(m > 0, F.sum("inside") / m - squares / (4 * m * m)).otherwise(0.0).alias("modularity"))
