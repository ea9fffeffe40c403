"""Links among members of shared buckets, found without comparing all members of a bucket with each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, small, stash, utf8

#: Members that a bucket may have to be compared member by member, splits of larger ones, and rounds of stars before.
FEW, SPLITS, STARS = 32, 2, 1
#: Members of a block, and pairs left from which on further rounds of stars come first, as long as they find links.
BLOCK, MANY = 1024, 1 << 28

Sets = Callable[[list[bytes | None]], Iterable[np.ndarray]]
Likely = Callable[[str, str], Column]


def linked(signed: DataFrame, confirmed: Callable[[DataFrame], DataFrame], few: int = FEW, splits: int = SPLITS, stars: int = STARS, likely: Likely | None = None) -> DataFrame:
    """(id, component_id) over the links among the rows of ``signed`` (id, bands array<long>, sig) that share a band.

    ``confirmed`` takes candidate pairs (p, id), each once, and returns the links (a, b) among them.  Members are compared with their
    bucket's smallest one; in ``stars`` rounds (more while they find links and over ``MANY`` pairs are left), those outside of its component with another member.
    What is then still apart is compared all with all, whatever the bucket's size, in blocks, so no task ever holds a large bucket: ``likely``, a condition on
    two ``sig``, meets every pair of different components, and those that it takes are confirmed.  Members of one component are never compared.

    Without ``likely`` (and ``sig``) all with all is for buckets of up to ``few``; a larger one is split by each later band of its members, so links between
    members that share fewer than three bands may be missed there: only for callers whose links share more.  What ``splits`` splits leave together meets in blocks.
    """
    band = signed.select("id", F.posexplode("bands").alias("j", "band")).select("id", "j", F.xxhash64("j", "band").alias("key"))
    shared = stash(band.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("p")).filter("size > 1"))
    bucket = stash(band.join(small(shared), "key"))  # only buckets of two or more matter from here on
    if not bucket.limit(1).count():
        return bucket.select("id", F.col("id").alias("component_id"))
    tested = stash(bucket.filter("id != p").select("p", "id").distinct())
    links = stash(confirmed(tested))
    of = stash(components(links))

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that hold two components or more, with their component and the bucket's size."""
        placed = rows.join(of, "id", "left").withColumn("c", F.coalesce("component_id", "id")).select("key", "j", "id", "c")
        mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
        return stash(placed.join(mixed.select("key", "size"), "key"))

    def found(pairs: DataFrame) -> bool:
        nonlocal links, of, tested
        pairs = pairs.select(F.least("p", "id").alias("p"), F.greatest("p", "id").alias("id")).distinct()
        pairs = stash(pairs.join(tested, ["p", "id"], "left_anti"))
        if not pairs.limit(1).count():
            return False
        tested = tested.unionByName(pairs)
        new = stash(confirmed(pairs))
        if not new.limit(1).count():
            return False
        links = links.unionByName(new)
        of = stash(components(links))
        return True

    def meet(rows: DataFrame, block: int) -> DataFrame:
        """All pairs of a bucket's members in different components, block by block."""
        more = [c for c in rows.columns if c == "sig"]
        n = rows.withColumn("n", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        rows = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("i", "own").alias("x"), F.greatest("i", "own").alias("y"), "own", "id", "c", *more)
        other = rows.select("key", "x", "y", F.col("own").alias("po"), F.col("id").alias("p"), F.col("c").alias("pc"), *[F.col(c).alias("ps") for c in more])
        across = (F.col("own") != F.col("po")) | (F.col("x") == F.col("y"))
        return rows.join(other, ["key", "x", "y"]).filter(across).filter("c != pc and p < id")

    left = apart(bucket.filter("size > 2"))
    star, gained = 0, True
    while star < stars or (likely and gained and (left.agg(F.sum("size")).first()[0] or 0) > 2 * MANY):
        if not left.limit(1).count():
            return of
        other = left.groupBy("key").agg(F.min_by(F.struct("id", "c"), F.xxhash64("id", F.lit(star))).alias("x")).select("key", F.col("x.id").alias("p"), F.col("x.c").alias("pc"))
        if gained := found(left.join(other, "key").filter("c != pc").select("p", "id")):
            left = apart(left.select("key", "j", "id"))
        star += 1
    if likely:
        if left.limit(1).count():
            found(meet(left.join(signed.select("id", "sig"), "id"), BLOCK).filter(likely("ps", "sig")).select("p", "id"))
        return of
    for split in range(splits + 1):
        if not left.limit(1).count():
            return of
        each = left.filter(F.col("size") <= few).select("key", "id", "c")
        other = each.select("key", F.col("id").alias("p"), F.col("c").alias("pc"))
        found(each.join(other, "key").filter("c != pc and p < id").select("p", "id"))
        large = left.filter(F.col("size") > few)
        if not large.limit(1).count():
            return of
        if split < splits:
            later = large.select("key", "j", "id").join(signed, "id").select("id", F.col("key").alias("above"), F.col("j").alias("k"), F.posexplode("bands").alias("j", "band"))
            later = later.filter("j > k").select("id", "j", F.xxhash64("above", "j", "band").alias("key"))
            left = apart(later)
    found(meet(large, 256).select("p", "id"))
    return of


def estimate(a: str, b: str, minima: int, planes: int, words: int) -> Column:
    """Similarity from the ``planes`` low bits of ``minima``, packed in ``words`` longs a plane, corrected for chance collisions:
    (share equal - 2^-planes) / (1 - 2^-planes)."""
    differ = F.lit(0)
    for w in range(words):
        bits = [F.col(a)[i * words + w].bitwiseXOR(F.col(b)[i * words + w]) for i in range(planes)]
        differ = differ + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), bits))
    chance = 2.0**-planes
    return ((F.lit(minima) - differ) / F.lit(float(minima)) - chance) / (1 - chance)


def _meet(sets: Sets, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for batch in chunks(batches):
            p, salt, ids = (batch.column(c).to_pylist() for c in ("p", "salt", "id"))
            a, b = [], []
            for i, s in enumerate(sets(utf8(batch.column("text")))):
                if (p[i], salt[i]) != at:
                    at, pivot = (p[i], salt[i]), None
                if p[i] == ids[i]:
                    pivot = s
                elif pivot is not None:
                    both = len(np.intersect1d(s, pivot, assume_unique=True))
                    if both and 100 * both >= percent * (len(s) + len(pivot) - both):
                        a.append(p[i]), b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Sets, percent: int, each: int = 2000) -> DataFrame:
    """Those of ``pairs`` (p, id) whose full sets meet ``percent`` (100 * intersection >= percent * union).

    ``texts`` joins the text of ``id`` to rows (p, salt, id); ``sets`` makes sorted distinct hashes of texts.
    A pivot's text goes once to each salted share of its members, followed by the members (a sort puts it first);
    no pair of texts is ever materialised.
    """
    pairs = stash(pairs)
    shares = stash(pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / each).alias("shares")))
    salted = pairs.join(small(shares), "p").select("p", "id", F.pmod(F.xxhash64("id"), F.col("shares")).alias("salt"))
    heads = shares.select("p", F.col("p").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"))
    rows = texts(stash(salted.unionByName(heads))).select("p", "salt", "id", "text")
    return rows.repartition("p", "salt").sortWithinPartitions("p", "salt", (F.col("id") != F.col("p"))).mapInArrow(_meet(sets, percent), "a long, b long").distinct()
