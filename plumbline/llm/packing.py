"""Packing by cutting-stock column generation (Gilmore and Gomory, 1961).

One pass tokenizes every text and cuts it into full sequences and a
remainder.  The histogram of remainders (classes of ``grain`` tokens, so at
most 1024 / grain rows) goes to the driver, where a linear program over
filling patterns is solved; a knapsack dynamic program prices new patterns.
Patterns are rounded down and those that fill a sequence are kept; the
remainders, ranked within their class, take the patterns' places.  The rest
(lengths that no pattern fills, such as all texts of 600 tokens) form a stream that
is cut at the sequences' ends, so only its last sequence is padded.

Defined results: a null text is empty; an empty document is the single id 0; a
repeated row is a document of its own; rows without doc_id are packed as well.
Texts are tokenized whole.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, ranked, small, stash

SPECIAL = "<|endoftext|>"
#: Most pieces of text that a worker remembers with their ids (some 150 bytes each).
REMEMBERED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    """Ids, as bytes, of what stands between two spaces; computed where it's missing."""

    def __init__(self, encode: Callable[[str], np.ndarray]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece).astype("<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@cache
def encoder(path: str) -> Callable[[str], bytes]:
    """text -> little-endian unsigned 32-bit ids, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    The merges of a byte-level BPE file are run by tiktoken, which is several times faster.  A text in which no white space
    stands before a space splits at spaces without any token crossing the cut, so ids of recurring pieces are remembered;
    any other text is encoded in one go.  A file of another kind is run by tokenizers itself.
    """
    import json
    import re

    spec = json.load(open(path, encoding="utf-8"))
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    plain = spec["model"].get("type", "BPE") == "BPE" and '"ByteLevel"' in pre and '"add_prefix_space": true' not in pre and not spec.get("normalizer")
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if not plain or set(added) - {SPECIAL}:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def whole(text: str) -> np.ndarray:
        return np.array(fast.encode(text, allowed_special="all") if SPECIAL in text else fast.encode_ordinary(text), np.uint32)

    pieces, crossing = _Pieces(whole), re.compile(r"\s ")

    def encode(text: str) -> bytes:
        if SPECIAL in text or crossing.search(text):
            return whole(text).astype("<u4").tobytes()
        first, *rest = text.split(" ")
        return whole(first).astype("<u4").tobytes() + b"".join(map(pieces.__getitem__, rest))

    return encode


def max_id(path: str) -> int:
    import json

    spec = json.load(open(path, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max([*ids, *(x["id"] for x in spec.get("added_tokens", []))])


def _cut(path: str, size: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in chunks(batches):
            rows: list[list] = [[], [], [], [], [], []]
            rest: list[bytes | None] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + b"\0\0\0\0"
                n, row = len(ids) // 4, batch.column("row")[i].as_py()
                for s in range(0, n, size):
                    part = ids[4 * s : 4 * (s + size)]
                    for column, x in zip(rows, (batch.column("doc_id")[i].as_py(), row, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
                    rest.append(np.frombuffer(part, "<u4").astype(f"<u{width}").tobytes() if len(part) < 4 * size else None)
            columns = [*(pa.array(c, pa.int64()) for c in rows), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value and counts of an unbounded knapsack."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        if fits.any():
            x = np.where(fits, values + best[np.maximum(c - sizes, 0)], -1.0)
            k = int(x.argmax())
            best[c], pick[c] = (x[k], k) if x[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, spare: int = 2, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pieces of each class, repeats): the rounded-down solution of the cutting-stock linear program,
    without patterns that leave more than ``spare`` classes' width empty.

    A revised simplex keeps the inverse of the basis; the start is one homogeneous pattern a class.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, room // s, 0) for i, s in enumerate(sizes)]
    inverse, x = np.diag([1.0 / (room // s) for s in sizes]), demand / (room // sizes)
    for _ in range(rounds):
        value, column = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-3:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        columns[out] = column
    left, done = demand.astype(np.int64).copy(), []
    for column, n in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        repeats = int(min(np.floor(n + 1e-6), *(left[column > 0] // column[column > 0])))
        if repeats > 0 and room - column @ sizes <= spare:
            done.append((column, repeats))
            left -= repeats * column
    return done


def _stream(size: int, width: int):
    """Cut remainders where their places in the stream cross a sequence's end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, start, n, tokens, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "at", "ids")), strict=True):
                wide, s = np.frombuffer(ids, f"<u{width}").astype("<u4"), 0
                while s < n:
                    k = min(n - s, size - (at + s) % size)
                    for column, x in zip(rows, (doc_id, start + s, k, zlib.crc32(wide[s : s + k].tobytes()), tokens, (at + s) // size, (at + s) % size), strict=True):
                        column.append(x)
                    s += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, grain: int = 4) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    ``tokenizer``: path of a tokenizer file that every executor can read.  ``grain``: width in tokens
    of a class of the histogram; wider classes solve faster and pad more.
    """
    spark, path, room = docs.sparkSession, tokenizer or default_tokenizer(), size // grain
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    width = 2 if max_id(path) < 1 << 16 else 4
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    tokens = stash(rows.mapInArrow(_cut(path, size, width), schema))
    pieces = tokens.drop("ids").withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    full, rest = pieces.filter(F.col("length") == size), pieces.filter(F.col("length") < size)
    histogram = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, n_sequences = [], 0
    if histogram:
        sizes = np.array(sorted(histogram))
        used = [0] * len(sizes)
        for column, repeats in patterns(sizes, np.array([histogram[k] for k in sizes], float), room):
            for k in np.flatnonzero(column):
                a = int(column[k])
                places.append((int(sizes[k]), used[k], used[k] + a * repeats, a, n_sequences))
                used[k] += a * repeats
            n_sequences += repeats
    # at most classes x classes rows: bounded by size and grain, not by the data
    place = F.broadcast(spark.createDataFrame(places, "of int, from_rank long, to_rank long, each int, first long"))
    rest = ranked(rest, ["class"], [F.col("row")], "rank", F.xxhash64("row"), 256)
    near = (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    put = stash(rest.join(place, near, "left").withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    matched = put.filter("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(before), zero)).select(*names)
    # the stream: where a remainder begins is its bucket's offset and the running sum in the bucket
    loose = put.filter("sequence_id is null").withColumn("b", F.pmod(F.xxhash64("row"), F.lit(1024)))
    total = loose.groupBy("b").agg(F.sum("length").alias("t"))
    begin = total.select("b", F.coalesce(F.sum("t").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), zero).alias("o"))
    own = F.coalesce(F.sum("length").over(W.partitionBy("b").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), zero)
    loose = stash(loose.join(F.broadcast(begin), "b").select("row", "length", (F.col("o") + own).alias("at")))  # begin: 1,024 rows at most
    ids = tokens.filter("ids is not null").join(small(loose.select("row", "at")), "row")
    cut = ids.select("doc_id", "start", "length", "doc_tokens", "at", "ids").mapInArrow(_stream(size, width), ", ".join(f"{c} long" for c in names))
    length = loose.agg(F.max(F.col("at") + F.col("length"))).first()[0] or 0
    cut = cut.withColumn("sequence_id", F.col("sequence_id") + n_sequences)
    n_sequences += -(-length // size)
    whole = ranked(full.withColumn("one", F.lit(1)), ["one"], [F.col("row"), F.col("start")], "rank", F.xxhash64("row", "start"), 1024)
    whole = whole.withColumn("sequence_id", F.col("rank") + n_sequences).withColumn("offset", zero).select(*names)
    return matched.unionByName(cut).unionByName(whole)
