"""Operators on documents against brute force, and their defined results at the edges."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from plumbline.llm import line_dedup, linking, mixing, near_dup_minhash, packing, sharding
from plumbline.llm.common import components, ranked, shingle_hashes, texts_words

from .conftest import words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(sets, linked):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(a, b):
    n = len(a & b)
    return n > 0 and 100 * n >= 85 * len(a | b)


def test_hashes_agree_with_plain_splitting():
    texts = [b"a  b\tc\x0bd", None, b"", b"x", "é è".encode()]
    got = list(texts_words(texts))
    assert [len(g) for g in got] == [4, 0, 0, 1, 2]
    assert got[3][0] == list(texts_words([b"q", b"x"]))[1][0]
    assert len(shingle_hashes(got[0])) == 1 and len(shingle_hashes(got[1])) == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    near_to = {frozenset((a, b)) for a, b in edges}
    assert got == {k: v for k, v in brute_components({i: i for i in nodes}, lambda a, b: frozenset((a, b)) in near_to).items()}


def test_ranked_counts_without_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.lit(None).cast("string")))
    rows = ranked(df, ["k"], [F.col("id")], "r", F.xxhash64("id"), 8).collect()
    for k in ("hot", None):
        assert sorted(r["r"] for r in rows if r["k"] == k) == list(range(sum(r["k"] == k for r in rows)))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    docs = {}
    for i in range(40):
        base = words(rng, rng.randrange(3, 120))
        docs[len(docs) * 3] = " ".join(base)
        for _ in range(rng.randrange(4)):
            edited = list(base)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randrange(50))
            docs[len(docs) * 3] = "  ".join(edited).upper() if rng.random() < 0.3 else " ".join(edited)
    got = near_dup_minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    sets = {i: shingle_set(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets, near)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_at_the_edges(edge, none):
    got = {r["doc_id"]: r for r in near_dup_minhash.near_duplicates(edge).collect()}
    assert sorted(x or 0 for x in got) == list(range(13))
    assert [got[i]["component_id"] for i in (1, 2, 3, 11)] == [1, 1, 1, 1]
    assert got[8]["component_id"] == 7 and got[8]["n_shingles"] == 1
    assert all(got[i]["n_shingles"] == 0 and got[i]["kept"] for i in (4, 5, 6))
    assert near_dup_minhash.near_duplicates(none).count() == 0


def test_estimate_corrects_for_chance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    a = words(rng, 600, 10**6)
    b = [x if rng.random() < 0.98 else "z" + x for x in a]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(words(rng, 600, 10**6)))], "id long, text string")
    s = df.withColumn("h", F.xxhash64("text")).mapInArrow(near_dup_minhash._sign, near_dup_minhash.SIGNATURE).select("id", F.array("p0", "p1", "q0", "q1").alias("s"))
    pair = s.select(F.col("id").alias("i"), F.col("s").alias("x")).crossJoin(s.select(F.col("id").alias("j"), F.col("s").alias("y"))).select("i", "j", linking.estimate("x", "y", near_dup_minhash.MINIMA, 2, 2).alias("e"))
    e = {(r["i"], r["j"]): r["e"] for r in pair.collect()}
    sets = [shingle_set(" ".join(x)) for x in (a, b)]
    assert e[1, 1] == 1 and abs(e[1, 3]) < 0.2 and abs(e[1, 2] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_packing(rows, texts, tokenizer):
    """``texts``: (doc_id, text) of every row; pieces must give back all ids and lie without gaps."""
    want = sorted((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts if d is not None)
    by = {}
    for r in rows:
        if r["doc_id"] is not None:
            by.setdefault(r["doc_id"], []).append(r)
    for d in {d for d, _ in want}:
        ids = next(i for x, i in want if x == d)
        times = sum(x == d for x, _ in want)
        assert sum(r["length"] for r in by[d]) == times * len(ids)
        for r in by[d]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert at[r["sequence_id"]] <= 1024 and r["length"] > 0
    return 1024 * len(at) - sum(at.values())


def test_packing_gives_back_every_id(spark, tokenizer):
    rng = random.Random(4)
    texts = [(i, " ".join(words(rng, rng.choice([0, 1, 30, 200, 700, 3000])))) for i in range(120)]
    padded = check_packing(packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, tokenizer)
    assert padded < 0.01 * sum(len(t) for _, t in texts) / 2


def test_packing_cuts_what_no_pattern_fills(spark, tokenizer):
    texts = [(i, " a" * 599) for i in range(100)]
    assert check_packing(packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, tokenizer) < 1024


def test_packing_at_the_edges(edge, none, edge_rows, tokenizer):
    rows = packing.pack(edge).collect()
    check_packing(rows, [(r[0], r[1]) for r in edge_rows], tokenizer)
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["a   b\n\n c \t d", "  x", "x  ", "don't we'll <|endoftext|> hi", " x　 y", "12 3四 ​ z", "", "\n", "a\r\n b", "A'S b's 'tis", "½ Ⅷ _x_ 😀 😀😀", "x" * 5000])
def test_encoder_equals_the_tokenizer(text, tokenizer):
    assert np.frombuffer(packing.encoder(packing.default_tokenizer())(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_column_generation_fills_sequences():
    sizes, demand = np.array([3, 5, 7, 11]), np.array([300.0, 200, 300, 100])
    found = packing.patterns(sizes, demand, 16)
    used = sum(c * n for c, n in found)
    assert (used <= demand).all() and all(16 - c @ sizes <= 2 for c, _ in found)
    assert used @ sizes >= 0.95 * (demand @ sizes)


def check_mix(spark, docs):
    got = mixing.mix(docs).toPandas()
    con = duckdb.connect()
    con.register("frame", docs.select("doc_id", "text", "source").toPandas())
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    want = con.sql(mixing.ORACLE).df()
    key = lambda df: sorted(tuple(round(float(x), 6) for x in r) for r in df[["size", "source_size", "target", "taken", "copies"]].fillna(-1).itertuples(index=False))
    assert key(got) == key(want)
    return got


def test_mixing_equals_sql_and_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), rng.choice(["hot"] * 6 + ["b", "c", "a", None, "é"])) for i in range(1500)]
    got = check_mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby(["target", "source_size"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.05 * g.target.iloc[0] + 120
    assert abs(got.groupby("source_size").target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()


def test_mixing_at_the_edges(spark, edge, none):
    got = check_mix(spark, edge)
    assert len(got) == 15 and (got[got["size"] == 0].taken == 0).all()
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and out.count() == got.copies.sum()


def test_sharding_balances_and_keeps_copies_together(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 200)))) for i in range(3000)] + [(5000 + i, "hot copy " * 40) for i in range(1500)] + [(9000 + i, f"twin {i // 3}") for i in range(300)]
    p = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sums = p.groupby("shard")["size"].sum()
    assert len(p) == len(rows) and len(sums) == 40 and sums.max() < 1.03 * sums.mean() and sums.min() > 0.97 * sums.mean()
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text = dict(rows)
    p["text"] = p.doc_id.map(text)
    assert (p[p.text.str.startswith("twin")].groupby("text").shard.nunique() == 1).all()
    assert all(zlib.crc32(t.encode()) == c for t, c in zip(p.text, p.text_crc32, strict=True))


def test_a_stored_map_is_held_to_and_edited(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60)))) for i in range(1200)]
    df, folder = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "maps")
    one = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(df, 10, 512, folder).collect()}
    again = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(df, 10, 512, folder).collect()}
    assert one == again and sharding.versions(spark, folder)[:2] == [1, 2]
    first = sharding.versions(spark, folder)[-1]
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 11, 512, folder).collect()}
    assert sharding.versions(spark, folder)[-1] == first + 1 and set(grown.values()) == set(range(11))
    assert sum(grown[d] != one[d][0] for d in grown) < 0.2 * len(rows) and sharding.load_map(spark, folder, 1) == sharding.first_map(512, 10)


def test_heavy_groups_without_ids_are_spread(spark):
    rows = [(None, "heavy copy " * 30)] * 800 + [(i, f"text {i}") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10, 512).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 1200 and sums.max() < 1.1 * sums.mean()


def test_sharding_at_the_edges(edge, none):
    got = sharding.shard(edge).collect()
    assert len(got) == 15 and all(r["law"] == "bytes" and 0 <= r["shard"] < 40 for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (4, 5)} == {16}
    assert sharding.shard(none).count() == 0


def test_rebalancing_moves_few_slots():
    rng = random.Random(1)
    weight = {i: rng.randrange(1, 1000) for i in range(4096)}
    one = sharding.first_map(4096, 40)
    two = sharding.rebalanced(one, weight, 40)
    assert sum(a != b for a, b in zip(one, two, strict=True)) < 1000
    more = sharding.rebalanced(two, weight, 41)
    load = [0] * 41
    for i, s in enumerate(more):
        load[s] += weight[i]
    assert max(load) < 1.01 * sum(load) / 41


def full_shingles(line):
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))}


def line_sets(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for x in (t or "").split("\n"):
            if x.strip():
                first.setdefault(x, d)
    return first, {x: full_shingles(x) for x in first}


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [" ".join(words(rng, rng.randrange(4, 40))) for _ in range(60)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randrange(1, 8)):
            w = rng.choice(pool).split() if rng.random() < 0.5 else words(rng, rng.randrange(2, 30))
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(9))
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    first, sets = line_sets(rows)
    lines = list(first)
    of = brute_components({i: sets[x] for i, x in enumerate(lines)}, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), emptied=True).collect()
    kept = [x for r in got for x in r["text"].split("\n") if x]
    number = {x: i for i, x in enumerate(lines)}
    assert len(kept) == len(set(kept))
    assert sorted(of[number[x]] for x in kept) == sorted(set(of.values()))  # one line of every component stays
    report = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_kept"] for r in report) == len(kept)
    for r in report:  # places point to the surviving lines
        own = [x for x in dict.fromkeys(rows[r["doc_id"]][1].split("\n")) if x.strip()]
        assert [own[i] for i in r["kept_lines"]] == [x for x in next(g for g in got if g["doc_id"] == r["doc_id"])["text"].split("\n") if x]


def kept_lines(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), emptied=True).collect()
    return sorted(x for r in got for x in r["text"].split("\n") if x)


def test_lines_with_long_runs_equal_full_shingles(spark):
    rng = random.Random(14)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(73))
    url = "https://example.org/" + "".join(rng.choice("abcdef0123456789") for _ in range(90))
    plain = "incomprehensibility of counterrevolutionary misunderstandings"
    other = list(plain)
    for i in (11, 13, 15, 34, 36, 38, 56, 58, 60):
        other[i] = "#"
    lines = [chinese, "\u4e00" + chinese, url, "x" + url + "\U0001f600", plain, "".join(other), "short", "shorty"]
    of = brute_components({i: full_shingles(x) for i, x in enumerate(lines)}, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert of == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7}
    assert kept_lines(spark, list(enumerate(lines))) == sorted(lines[i] for i in set(of.values()))


def test_every_link_between_short_lines_is_found(spark):
    rng = random.Random(15)
    lines = []
    for i in range(600):  # pairs of Jaccard 4/5, 7/9 (no link) and 12/15, which share nothing with other pairs
        n = (13, 18, 23)[i % 3]
        x = "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(n))
        lines += [x, x + "q"] if i % 3 == 0 else [x[1:], x[:-1]] if i % 3 == 1 else [x[:-2], x[:-2] + "xyz"]
    sets = [full_shingles(x) for x in lines]
    linked = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    want = sorted(x for i, x in enumerate(lines) if i % 2 == 0 or not linked[i // 2])
    assert sum(linked) >= 400 and kept_lines(spark, list(enumerate(lines))) == want


def test_lines_at_the_edges(edge, none):
    got = line_dedup.dedup_lines(edge, emptied=True)
    assert got.columns == edge.columns and got.count() == 14  # the row that is there twice comes out once
    text = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}
    assert text[1] and text[2] == "" and text[4] is None and text[5] == "" and text[6] == "  \n\t " and text[7] == "one two" and text[8] == ""
    left = [r["doc_id"] for r in line_dedup.dedup_lines(edge).collect()]
    assert sorted(x or 0 for x in left) == [0, 1, 4, 5, 6, 7, 9, 10, 12]
    assert line_dedup.line_report(edge).count() == 14
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.line_report(none).count() == 0


def test_lines_keep_blank_ones_and_clashing_columns(spark):
    names = ["d", "th", "h1", "kept", "__d", "n", "w", "bands"]
    first = "\n\npara one is here\n\n\npara two follows it\n"
    rows = [(1, first), (2, "para two follows it\n\nsomething wholly new\n\npara one is here\n\nsomething wholly new"), (2, "another text of this id"), (3, first)]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, first), (2, "another text of this id"), (2, "something wholly new\n")]
    assert all([r[n] for n in names] == list(range(8)) for r in got)


def test_line_hashes_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    lines = ["", "a", "é你😀", "x" * 100, "twelve bytes"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(2), "x").alias("b")).collect()
    assert all((r["a"], r["b"]) == (line_dedup.line_hash(r["x"].encode()), line_dedup.line_hash(r["x"].encode(), line_dedup._SEED2)) for r in got)


def test_windows_of_long_lines_go_through_in_blocks(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(chr(rng.choice([97, 98, 233, 0x4E00, 0x1F600])) for _ in range(n)) for n in (5, 9, 10, 11, 400, 0, 60)]
    data = [x.encode() for x in lines]
    whole, sets = line_dedup.signatures(data), [s.tolist() for s in line_dedup.shingle_sets(data)]
    assert [len(s) for s in sets] == [len(full_shingles(x)) for x in lines]
    monkeypatch.setattr(line_dedup, "CHARS", 7)
    assert (line_dedup.signatures(data) == whole).all() and [s.tolist() for s in line_dedup.shingle_sets(data)] == sets


def test_a_hot_bucket_is_split_and_never_compared_all_with_all(spark):
    rng = random.Random(16)
    n, asked = 3000, []
    rows = [(i, [7, *(rng.randrange(10**9) for _ in range(15))]) for i in range(n)]  # all share one band, and nothing else
    rows[1200] = (1200, [*rows[700][1][:9], *rows[1200][1][9:]])

    def none_but(pairs):
        asked.append(pairs.count())
        return pairs.filter("p = 700 and id = 1200").selectExpr("p as a", "id as b")

    of = {r["id"]: r["component_id"] for r in linking.linked(spark.createDataFrame(rows, "id long, bands array<long>"), none_but).collect()}
    assert of == {700: 700, 1200: 700} and sum(asked) <= 5 * n


def test_a_family_without_links_is_compared_in_blocks(spark):
    n, asked = 300, []
    rows = [(i, list(range(16))) for i in range(n)]

    def some(pairs):
        asked.append(pairs.count())
        return pairs.filter("p >= 10 and id = p + 150").selectExpr("p as a", "id as b")

    of = {r["id"]: r["component_id"] for r in linking.linked(spark.createDataFrame(rows, "id long, bands array<long>"), some, few=8, splits=1).collect()}
    assert of == {i: i if i < 150 else i - 150 for i in (*range(10, 150), *range(160, n))}


def test_a_repeated_id_links_by_the_text_that_stands(spark):
    rng = random.Random(18)
    a, b = words(rng, 200, 10**6), words(rng, 60, 10**6)
    got = near_dup_minhash.near_duplicates(spark.createDataFrame([(1, " ".join(b)), (2, " ".join(a)), (2, " ".join(b[:-1])), (3, " ".join(b[:-1])), (None, " ".join(b))], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 56, 0, True), (1, 56, 1, True), (2, 196, 2, True), (3, 55, 1, False)]


def test_words_of_long_texts_go_through_in_blocks(monkeypatch):
    from plumbline.llm import common

    data = " ".join(words(random.Random(4), 3000)).encode() + b" " + b"x" * 9000 + b"  y"
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "BLOCK", 500)
    assert all((a == b).all() for a, b in zip(whole, common.word_hashes(data), strict=True))


def test_links_that_share_one_band_of_a_large_bucket_are_found(spark):
    from pyspark.sql import functions as F

    rng = random.Random(23)
    n = 3000
    rows = [(i, [7, *(rng.randrange(10**9) for _ in range(15))], [i]) for i in range(n)]  # all share one band, and no two another
    linked = {(700, 1200), (1200, 2999), (40, 41)}

    def some(pairs):
        got = {(r["p"], r["id"]) for r in pairs.collect()}
        return spark.createDataFrame(sorted(got & linked) or [(0, 0)], "a long, b long").filter("a < b")

    likely = lambda a, b: F.array(F.least(F.col(a)[0], F.col(b)[0]), F.greatest(F.col(a)[0], F.col(b)[0])).isin([F.array(F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in linked])
    of = {r["id"]: r["component_id"] for r in linking.linked(spark.createDataFrame(rows, "id long, bands array<long>, sig array<long>"), some, likely=likely).collect()}
    assert of == {700: 700, 1200: 700, 2999: 700, 40: 40, 41: 40}


def test_lines_need_no_python_on_the_executors(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def none(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(DataFrame, "mapInArrow", none)
    rng = random.Random(31)
    x = " ".join(words(rng, 40))
    rows = [(1, x + "\nshort"), (2, x + "q"), (3, "short\n" + x[:50])]
    assert kept_lines(spark, rows) == sorted([x, "short", x[:50]])
    report = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_kept"], r["kept_lines"]) for r in report) == [(1, 2, 2, [0, 1]), (2, 1, 0, []), (3, 2, 1, [1])]


def test_windows_as_rows_and_as_arrays_confirm_alike(spark, monkeypatch):
    rng = random.Random(32)
    pairs = []
    for i in range(60):
        x = "".join(chr(rng.choice([97, 98, 233, 0x4E00, 0x1F600])) for _ in range(rng.randrange(10, 120)))
        pairs.append((i, 100 + i, x, x[rng.randrange(4) :] + "z" * rng.randrange(12)))
    df = spark.createDataFrame(pairs, "p long, id long, pl string, line string")
    sets = {p: (full_shingles(x), full_shingles(y)) for p, _, x, y in pairs}
    want = sorted((p, 100 + p) for p, (x, y) in sets.items() if len(x & y) >= 0.8 * len(x | y))
    for most in (1 << 14, 0):
        monkeypatch.setattr(line_dedup, "LONG", most)
        assert sorted(tuple(r) for r in line_dedup.alike(df, 80).collect()) == want and 5 < len(want) < 55


def test_line_maps_lose_no_link(spark):
    rng = random.Random(35)
    pairs = []
    for i in range(120):
        x = "".join(rng.choice("abc ü\u4f60\U0001f600"[: 4 if i % 2 else 7]) for _ in range(rng.choice([10, 11, 14, 60, 300, 900, 6000])))
        y, at = x * 2 if i % 9 == 0 else x, rng.randrange(len(x))
        cuts = [y[:at] + y[at + 1 :] + "z", "q" + y, y[max(1, len(y) // rng.choice([3, 6, 12])) :], "".join(c if rng.random() > 0.02 else "z" for c in y), "z" * len(y), y]
        pairs += [(x, c) for c in cuts if len(c) >= 10]
    pairs = [(2 * i, 2 * i + 1, *p) for i, p in enumerate(pairs)]
    share = [len(full_shingles(x) & full_shingles(y)) / len(full_shingles(x) | full_shingles(y)) for _, _, x, y in pairs]
    lines = spark.createDataFrame([r for p, i, x, y in pairs for r in ((p, x), (i, y))], "id long, line string")
    left = {r["p"] for r in line_dedup.possible(spark.createDataFrame([p[:2] for p in pairs], "p long, id long"), line_dedup.maps(lines), 80).collect()}
    alike = {p[0] for p, s in zip(pairs, share, strict=True) if s >= 0.8}
    far = {p[0] for p, s in zip(pairs, share, strict=True) if s < 0.6 and len(p[2]) < 1000}
    assert len(alike) > 100 and alike <= left
    assert len(far) > 100 and len(far & left) < 0.1 * len(far)


def test_most_lines_below_the_threshold_are_not_compared(spark, monkeypatch):
    rng = random.Random(36)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    lines = ["".join("z" if k in at else c for k, c in enumerate(base)) for at in (set(rng.sample(range(400), 4)) for _ in range(40))]
    seen, alike = [], line_dedup.alike

    def counted(pairs, percent):
        seen.append(pairs.count())
        return alike(pairs, percent)

    monkeypatch.setattr(line_dedup, "alike", counted)
    of = brute_components({i: full_shingles(x) for i, x in enumerate(lines)}, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert kept_lines(spark, list(enumerate(lines))) == sorted(lines[i] for i in set(of.values()))
    assert sum(seen) < 300  # of 780 pairs


def test_windows_are_hashed_by_place(spark):
    """As an array and as rows, with characters of any width; a line shorter than a window is one shingle, and no row."""
    from pyspark.sql import functions as F

    lines = ["short", "0123456789", "é你😀 wide one " * 3, "\U0001f600" * 21, "plain text of some length"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    want = [{line_dedup.line_hash(w.encode("utf-32-be") if len(w) == 10 else w.encode()) for w in full_shingles(x)} for x in lines]
    arrays = {r["id"]: r["s"] for r in df.select("id", line_dedup._shingles(F.col("line")).alias("s")).collect()}
    assert [set(arrays[i]) for i in range(len(lines))] == want and [len(arrays[i]) for i in range(len(lines))] == [max(1, len(x) - 9) for x in lines]
    rows = line_dedup._windows(df, "line").collect()
    assert [{r["h"] for r in rows if r["id"] == i} for i in range(len(lines))] == [{None}, *want[1:]]
