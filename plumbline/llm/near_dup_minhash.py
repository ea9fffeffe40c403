"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010).

One pass over the texts keeps, per document, a digest of its full shingle set,
24 band keys of full minima and a packed signature of the two low bits of 128
minima.  Equal sets are linked by digest.  Of the rest, documents that share
a band key are compared with the bucket's smallest member, never all with all; the similarity estimated from bit counts and corrected for chance
collisions drops hopeless pairs, and the others are confirmed on full sets.
Members that the star leaves outside are compared in further rounds
(``linking.linked``), until each bucket's members are in one component or known to differ.

Defined results: null or wordless texts have 0 shingles and link with nothing;
texts of fewer than five words are one shingle; very long texts go through in blocks, whole; rows that repeat a doc_id count
as one document, for which its largest set stands (ties: the greatest digest, then hash of the text), in links as in n_shingles;
of equal sets the smallest doc_id is kept; each row without doc_id comes out with a null doc_id and component_id, kept, linked with nothing.
An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, shingle_hashes, small, stash, texts_words, utf8
from .linking import confirm, estimate, linked

MINIMA, BANDS, ROWS = 128, 24, 5
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**32, (MINIMA, 1), dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)
SIGNATURE = "id long, h long, n long, digest binary, p0 long, p1 long, q0 long, q1 long, bands array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 128 minima; long sets go through in blocks, so memory stays bounded."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        h = short[None, i : i + 2048] ^ _XOR
        h *= _MUL
        np.minimum(low, h.min(axis=1), out=low)
    return low


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *((c, pa.int64()) for c in ("p0", "p1", "q0", "q1")), ("bands", pa.list_(pa.int64()))])
    for batch in chunks(batches):
        n, digest, planes, bands = [], [], [], []
        for words in texts_words(utf8(batch.column("text"))):
            s = shingle_hashes(words)
            n.append(len(s))
            if not len(s):
                digest.append(None), planes.append((0, 0, 0, 0)), bands.append([])
                continue
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            low = minima(s)
            p, q = np.packbits(low & 1).view(np.uint64), np.packbits((low >> 1) & 1).view(np.uint64)
            planes.append((*_signed(p), *_signed(q)))
            with np.errstate(over="ignore"):
                h = _BAND.copy()
                for j in range(ROWS):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + low[j * BANDS : (j + 1) * BANDS].astype(np.uint64) + np.uint64(1))
            bands.append(_signed(h))
        columns = [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array([x[i] for x in planes], pa.int64()) for i in range(4)), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 85, slack: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    ``percent``: least 100 * intersection / union of a link.  ``slack``: by how much the
    estimate may fall short before a pair is dropped unconfirmed (over 5 standard errors).
    """
    told = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = stash(told.mapInArrow(_sign, SIGNATURE))
    best = F.max_by(F.struct(*[c for c in signed.columns if c != "id"]), F.struct("n", F.hex("digest"), "h"))
    own = stash(signed.filter("id is not null").groupBy("id").agg(best.alias("x")).select("id", "x.*"))
    known = own.filter("n > 0")
    first = known.groupBy("digest", "n").agg(F.min("id").alias("rep"))
    member = stash(known.join(first, ["digest", "n"]).select("id", "rep"))
    sig = stash(known.join(member.filter("id = rep").select("id"), "id", "left_semi").select("id", "h", F.array("p0", "p1", "q0", "q1").alias("s"), "bands"))

    def likely(a: str, b: str) -> Column:
        return estimate(a, b, MINIMA, 2, 2) >= percent / 100 - slack

    def links(pairs: DataFrame) -> DataFrame:
        a = sig.select(F.col("id").alias("p"), F.col("s").alias("sa"))
        b = sig.select("id", F.col("s").alias("sb"))
        close = pairs.join(a, "p").join(b, "id").filter(likely("sa", "sb")).select("p", "id")

        def texts(wanted: DataFrame) -> DataFrame:  # of the row that stands for an id
            return told.join(small(stash(wanted.join(sig.select("id", "h"), "id"))), ["id", "h"])

        return confirm(close, texts, lambda t: map(shingle_hashes, texts_words(t)), percent)

    of = linked(sig.select("id", "bands", F.col("s").alias("sig")), links, likely=likely)
    component = member.join(of.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("id", F.coalesce("component_id", "rep").alias("component_id"))
    out = own.select("id", "n").join(component, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    out = out.withColumn("kept", F.col("id") == F.col("component_id"))
    nameless = signed.filter("id is null").select("id", "n", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", "kept")
