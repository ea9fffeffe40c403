"""Near-duplicate vectors and nearest neighbours against brute force."""

import numpy as np

from plumbline.llm import ann_forest, near_dup_vectors

SCHEMA = "vec_id long, label int, embedding array<float>, id string"
ODD = [(None, [1.0] * 16), (0, None), (0, [0.0] * 16), (0, [float("nan")] + [1.0] * 15), (0, [float("inf")] + [1.0] * 15), (0, [None] + [1.0] * 15), (0, []), (0, [1.0, 2.0])]


def rows(n=500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, 60):  # pairs and one larger group
        x[100 + i] = x[i] + rng.standard_normal(dim) * 0.05
    x[200:280] = x[199] + rng.standard_normal((80, dim)) * 0.05
    x[300:310] = x[299]
    x = x.astype(np.float32)
    label = rng.integers(0, 3, n)
    label[100:160], label[199:311] = label[:60], 1
    return [(int(i), int(label[i]), [float(v) for v in x[i]], "z") for i in range(n)]


def units(data):
    m = np.array([r[2] for r in data], dtype=float)
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_links_equal_brute_force(spark):
    data = rows()
    u = units(data)
    label = np.array([r[1] for r in data])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    odd = [(900 + i, lab, v, "o") for i, (lab, v) in enumerate(ODD)]
    got = {r["vec_id"]: r for r in near_dup_vectors.near_duplicates(spark.createDataFrame(data + odd, SCHEMA)).collect()}
    assert len(got) == len(data) + len(odd)
    assert [got[i]["n_links"] for i in range(len(data))] == near.sum(axis=1).tolist()
    component = list(range(len(data)))
    for _ in range(len(data)):
        new = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(len(data))]
        if new == component:
            break
        component = new
    assert [got[i]["component_id"] for i in range(len(data))] == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[900 + i]["n_links"] == 0 and got[900 + i]["kept"] for i in range(len(odd)))


def test_blocks_of_a_component_count_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup_vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    data = [(i, 0, [float(v) for v in (base + rng.standard_normal(16) * 0.03).astype(np.float32)], "z") for i in range(120)]
    got = near_dup_vectors.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    u = units(data)
    near = u @ u.T >= 0.93
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(near[i].sum()) - 1 for i in range(120)}


def two_groups(n, dim=16):
    """Two groups of ``n`` tight vectors (cosine .999), .947 across."""
    rng = np.random.default_rng(2)
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    centre = np.repeat([a, 0.947 * a + np.sqrt(1 - 0.947**2) * b], n, axis=0)
    x = (centre + rng.standard_normal((2 * n, dim)) * 0.005).astype(np.float32)
    return [(i, 0, [float(v) for v in x[i]], "z") for i in range(2 * n)]


def check_two_groups(spark, n, **more):
    data = two_groups(n)
    u = units(data)
    near = u @ u.T >= 0.93
    top = np.argsort(-(u @ u.T), axis=1)[:, 1:9]
    assert near.all() and not ((top >= n) != (np.arange(2 * n) >= n)[:, None]).any()  # no list of 8 shows the other group
    got = near_dup_vectors.near_duplicates(spark.createDataFrame(data, SCHEMA), **more).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2 * n - 1, 0)}


def test_links_beyond_saturated_lists(spark):
    check_two_groups(spark, 12)


def test_saturated_groups_larger_than_leaves(spark):
    check_two_groups(spark, 1500)


def test_exact_search_where_the_audit_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dup_vectors, "_leaf", lambda kind, k, least: lambda g: None)  # a search that finds nothing
    check_two_groups(spark, 12, rounds=1)


def test_vectors_at_the_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup_vectors.near_duplicates(empty).count() == 0
    assert ann_forest.nearest(empty, empty).count() == 0
    again = spark.createDataFrame([(1, 0, [1.0, 0.0], "a"), (1, 0, [1.0, 0.0], "a"), (2, 0, [2.0, 0.0], "a"), (None, 0, [1.0, 0.0], "a")], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_dup_vectors.near_duplicates(again).collect()}
    assert got == {1: (1, 1), 2: (1, 1)}


def brute_nearest(data, k):
    ids, m = np.array([r[0] for r in data]), np.array([r[2] for r in data], dtype=float)
    out = {}
    for i in range(0, len(data)):
        if ids[i] % 20 == 0:
            s = (m[i] * m).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_of_few_rows_are_exact(spark):
    data = rows(400)
    odd = [(900 + i, lab, v, "o") for i, (lab, v) in enumerate(ODD) if lab == 0]
    df = spark.createDataFrame(data + odd, SCHEMA)
    got = {}
    for r in ann_forest.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(data, 20)
    assert {k: [x for x, _ in v] for k, v in got.items() if k < 900} == {k: [x for x, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_recall_of_the_forest(spark):
    data = rows(6000, seed=9)
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in ann_forest.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(data, 20)
    assert np.mean([len(got[k] & {x for x, _ in v}) / 20 for k, v in want.items()]) >= 0.95


def test_labels_of_any_type(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (3, "b", [1.0, 0.0]), (4, None, [1.0, 0.0])]
    got = near_dup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}
