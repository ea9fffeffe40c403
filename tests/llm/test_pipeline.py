import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from plumbline.llm.common import stash  # noqa: E402

from .test_documents import check_packing, near, shingle_set  # noqa: E402


def test_stages_and_run_agree(spark, tmp_path):
    import random

    from tokenizers import Tokenizer

    from plumbline.llm import packing

    rng = random.Random(31)
    word = lambda lang: "".join(rng.choice({"en": ["th", "er", "on", "an", "wh"], "de": ["sch", "ei", "ung", "ü", "tz"]}[lang]) for _ in range(3))
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        text = ". ".join(" ".join(word(lang) for _ in range(12)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(200, "!!! 123", "en", "s0", 7), (201, None, "en", "s1", None), (202, rows[0][1], "en", "s1", 5), (203, rows[1][1] + "\nthwhon erthan whanth onthwh", "en", "s1", 5)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(folder, "documents.parquet"))
    docs, out = spark.read.parquet(os.path.join(folder, "documents.parquet")), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stash(stage(spark, docs, folder))
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in out[name]]
    assert sorted(ids("language_id")) == [*range(150), 202, 203]
    text = {r["doc_id"]: r["text"] for r in out["line_dedup"]}
    assert len(text) == 151 and 202 not in text and text[0] == rows[0][1] and text[203]
    sets = [shingle_set(r["text"]) for r in out["near_dedup"]]
    assert not any(near(a, b) for i, a in enumerate(sets) for b in sets[:i])
    check_packing(out["packing"], [(r["doc_id"], r["text"]) for r in out["mixing"]], Tokenizer.from_file(packing.default_tokenizer()))
    again = pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in again) == sum(r["length"] for r in out["packing"])


def test_near_dedup_takes_pairs_from_80_percent(spark):
    base = [f"a{i}" for i in range(104)]  # 100 shingles
    docs = [(1, base), (2, base + [f"b{i}" for i in range(22)]), (3, [f"c{i}" for i in range(104)]), (4, [f"c{i}" for i in range(104)] + [f"d{i}" for i in range(27)])]
    sets = [shingle_set(" ".join(w)) for _, w in docs]
    assert 0.8 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and len(sets[2] & sets[3]) < 0.8 * len(sets[2] | sets[3])
    got = pipeline.near_dedup(spark, spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]


def test_pairs_that_share_one_band_of_a_large_bucket_are_found_by_both_stages(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from plumbline.llm import line_dedup, linking, near_dup_minhash

    def one_band(signed, links, **more):  # all rows share one band, and no two another
        return linking.linked(signed.withColumn("bands", F.array(F.lit(7).cast("long"), *[F.xxhash64("id", F.lit(j)) for j in range(15)])), links, **more)

    monkeypatch.setattr(line_dedup, "linked", one_band)
    monkeypatch.setattr(near_dup_minhash, "linked", one_band)
    rng = random.Random(29)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (pipeline.line_dedup, pipeline.near_dedup):
        assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == list(range(60))
