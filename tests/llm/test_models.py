"""Toxicity and language identification: held-out accuracy and edges."""

import random
import zlib

from plumbline.llm import language_id, toxicity

from .conftest import words


def corpus(n=900):
    rng = random.Random(21)
    bad = ["vile", "scummy", "rotten", "filth"]
    docs, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120), 200)
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad).upper() + "!")
        docs.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    # held-out labels have no influence
    flipped = [(i, 1 - y if got[i]["held_out"] else y) for i, y in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


def test_toxicity_at_the_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (9, None), (11, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(edge, labels).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(edge, labels.filter("false")).filter("predicted = 1").count() == 0


def test_polarity_follows_neighbours():
    import numpy as np

    counts = np.zeros((4, 4))
    counts[0, 1] = counts[2, 3] = 50  # 0 and 1 keep company, and so do 2 and 3
    counts[1, 3] = 1
    p = toxicity.polarity(counts, np.array([1.0, 0, 0, 0]), np.array([0, 0, 1.0, 0]))
    assert p[0] > 0.5 and p[1] > 0.3 and p[2] < -0.5 and p[3] < -0.3


WORDS = {"de": "der die und nicht ist schön straße über mit auch".split(), "en": "the and that with this from have they were which".split(), "fr": "les des est dans pour que avec être cette où".split()}


def test_language_fuses_evidence(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(10, 60))), lang, f"www.{lang}.example.org" if i % 2 else None, lang))
    rows += [(1000, "zz", "fr", "www.fr.example.org", "fr"), (1001, "123 ... 456", "en", None, None), (1002, None, "de", None, None), (1003, "", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r["doc_id"]: r for r in language_id.identify_documents(d).collect()}
    assert all(got[r[0]]["lang"] == r[4] and got[r[0]]["accepted"] for r in rows if r[4])
    assert all(not got[i]["accepted"] and got[i]["lang"] is None and got[i]["posterior"] == 0 for i in (1001, 1002, 1003))


def test_language_priors_are_hierarchical(spark):
    rows = [(i, "the and that with this from have", "en", "a.example.org") for i in range(60)] + [(100 + i, "der die und nicht ist schön", "de", "b.other.net") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([*rows, (500, "xq", None, "a.example.org"), (501, "xq", None, "b.other.net"), (502, "xq", None, "new.other.net")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in language_id.identify(asked, model, ["doc_id"], host=F.col("source")).collect()}
    assert (got[500], got[501]) == ("en", "de")


def test_language_evidence_of_pages(spark):
    from pyspark.sql import functions as F

    rows = [("http://x.example.de/a", '<html lang="de-AT"><p>'), ("https://y.example.com/fr/1", "<HTML class=a LANG=FR>"), ("http://z.example.com/", "<html>"), (None, None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(language_id.address_language(F.col("url")).alias("a"), language_id.markup_language(F.col("html")).alias("m"), language_id.domain_of(language_id.url_host(F.col("url"))).alias("d")).collect()
    assert [tuple(r) for r in got] == [("de", "de", "example.de"), ("fr", "fr", "example.com"), (None, None, "example.com"), (None, None, None)]


def test_language_at_the_edges(edge, none):
    got = language_id.identify_documents(edge).collect()
    assert len(got) == 15
    assert language_id.identify_documents(none).count() == 0
