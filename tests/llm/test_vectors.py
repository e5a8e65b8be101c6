import math

import numpy as np

from corvane.llm import vector_join as V


def brute(rows, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                link[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= least
    root = V.roots(n, *np.nonzero(link))
    low = {r: min(rows[k][0] for k in range(n) if root[k] == r) for r in set(root.tolist())}
    return sorted((rows[k][0], int(link[k].sum()), low[root[k]], rows[k][0] == low[root[k]]) for k in range(n))


def data(seed, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[i % 12] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.25, 1.0])).astype("f4").tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(600, [2 * x for x in rows[7][1]]), (601, None), (602, [0.0] * d), (603, [float("nan")] + [1.0] * (d - 1)), (604, [None] + [1.0] * (d - 1)), (605, [1.0, 2.0]), (606, [1.0, 2.0]), (607, []), (608, [float("inf")] * d)]
    return rows


def test_against_brute_force(spark):
    rows = data(1)
    got = V.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rep int"), 0.95)
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.95)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 16)
    rows = data(2)
    got = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9)
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.9)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    """A near copy of 3 and another vector have the id 5; the near copy of the latter isn't drawn into the class of 3."""
    e = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05], [0.0, 0.0, 1.0]]
    rows = [(3, e[0]), (5, e[1]), (5, e[2]), (7, e[3]), (7, e[4])]
    got = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95)
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.95) == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (7, 0, 7, True), (7, 1, 5, False)]


def test_none_valid(spark):
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = V.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_early_stop_equals_full_product():
    rng = np.random.default_rng(3)
    a, b = (V.unit(rng.normal(size=(200, 64))) for _ in range(2))
    b[:20] = V.unit(a[:20] + rng.normal(size=(20, 64)) * 0.02)
    i, j, s = V.compare(a, b, 0.95)
    assert np.allclose(s, (a[i] * b[j]).sum(axis=1)) and set(zip(i, j)) == set(zip(*np.nonzero(a @ b.T >= 0.95))) and len(i) == 20


def test_all_open_pairs_are_summed_to_the_end():
    a = V.unit(np.ones((50, 40)) + np.random.default_rng(4).normal(size=(50, 40)) * 0.02)
    i, j, _ = V.compare(a, a, 0.95)
    assert len(i) == 2500
    i, j, _ = V.compare(a, -a, 0.95)
    assert len(i) == 0


def test_pairs_at_the_threshold_go_by_the_given_vectors(spark):
    """(3, 4) and (4, 3) have the cosine 0.96 to the last bit, whatever their axes; 0.96 links them, the next double doesn't."""
    rng = np.random.default_rng(5)
    rows = [(1, [3.0, 4.0, 0.0]), (2, [4.0, 3.0, 0.0])] + [(10 + i, rng.normal(size=3).round(3).tolist()) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for least, n in ((24 / 25, 1), (math.nextafter(24 / 25, 1), 0)):
        got = sorted(map(tuple, V.near_duplicates(table, least).collect()))
        assert got == brute(rows, least)
    a, b = np.array([rows[0][1]]), np.array([rows[1][1]])
    for least, n in ((24 / 25, 1), (math.nextafter(24 / 25, 1), 0)):
        assert len(V.decide(a, b, np.array([0]), np.array([0]), np.array([24 / 25 - 1e-12]), least)[0]) == n
