import numpy as np

from tessera.llm.embedding_join import embedding_join, pivot_count

SCHEMA = "vec_id long, embedding array<float>, label int, rep int"


def brute(rows, cosine):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    u = np.array([v / np.linalg.norm(v) for _, v in ok])
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    ids = [i for i, _ in ok]
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], 10**9).min(axis=1))
        if (new == label).all():
            break
        label = new
    out = {i: (0, i) for i, _ in rows if i is not None}
    return out | {i: (int(link[k].sum()), int(label[k])) for k, i in enumerate(ids)}


def test_exact_for_any_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _c in range(25):
        centre = rng.normal(size=8)
        for _ in range(8):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.4])]))
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [1.0] * 3), (204, [None] + [1.0] * 7), (205, []), (206, rows[0][1]), (207, [2 * x for x in rows[0][1]])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    want = brute(rows, 0.95)
    for how in ({}, {"cell": 30, "block": 16}, {"cell": 7, "block": 300}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join(table, **how).collect()}
        assert {i: x[:2] for i, x in got.items()} == want
        assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_empty_null_ids_and_repeated_rows(spark):
    assert embedding_join(spark.createDataFrame([], SCHEMA)).count() == 0
    t = spark.createDataFrame([(None, [1.0, 0.0], 0, 0), (4, [1.0, 0.0], 0, 0), (4, [1.0, 0.0], 0, 0), (2, [0.9, 0.01], 0, 0)], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_join(t).collect())
    assert got == [(0, 0, None), (2, 2, 2), (4, 2, 2), (4, 2, 2)]


def test_extreme_lengths_and_ties(spark):
    rows = [(1, [1e200, 1e199]), (2, [1e-200, 1e-201]), (3, [10.0, 1.0]), (4, [-1e308, 1e308]), (5, [5e-324, 0.0]), (6, [3.0, 4.0]), (7, [4.0, 3.0]), (8, [0.0, -0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join(t).collect()}
    assert got[1] == got[2] == got[3] == (3, 1) and got[5] == (3, 1) and got[4] == (0, 4) and got[8] == (0, 8)
    assert got[6] == (1, 6) and got[7] == (1, 6)  # 0.96
    tie = {r.vec_id: r.n_links for r in embedding_join(t.filter("vec_id in (6, 7)"), cosine=0.96).collect()}
    assert set(tie.values()) <= {0, 1} and len(set(tie.values())) == 1


def test_many_invalid_vectors_and_clashing_names(spark):
    rows = [(k, None if k % 2 else [0.0, 0.0], k) for k in range(3000)] + [(None, [1.0, 2.0], 1)]
    got = embedding_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")).collect()
    assert len(got) == 3001 and all(r.n_links == 0 and r.component_id == r.vec_id for r in got)


def test_pivots_grow():
    assert [pivot_count(n, 16384) for n in (0, 1, 16385, 10**8, 10**10)] == [1, 1, 2, 6104, 100_000]
