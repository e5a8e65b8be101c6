import random

import numpy as np
import pytest

from corvane.llm import set_join as S
from corvane.llm import common as C


def shingle_set(text, k):
    w = text.encode().lower().split() if text else []
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[i:] for i in range(k))))


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and den * both >= num * either:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed, n=70):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 9, 14, 60, 200, 700]))] for _ in range(10)]
    rows = [(i, edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4, 9]))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "a b"), (n + 6, "A  B"), (n + 7, "é\x1cx É\x1cx"), (n + 8, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,hot,seed", [(3, 90, 4096, 1), (5, 80, 4096, 2), (3, 90, 2, 3), (5, 80, 3, 4)])
def test_against_brute_force(spark, k, num, hot, seed):
    rows = corpus(seed)
    got = S.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, hot).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, num, 100)


def test_segments_meet_the_pigeonhole():
    """Every linked pair has an equal segment signature, also across size bands."""
    rng, bands = np.random.default_rng(5), S.Bands(90, 100)
    for n in (10, 11, 40, 150, 900):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = int(rng.integers(0, max(1, n // 19) + 1))
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 19) + 1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                assert set(S.signatures(a, bands)) & set(S.signatures(b, bands))
                diff = sum(bin(int(x)).count("1") for x in S.parity(a) ^ S.parity(b))
                assert diff <= len(a) + len(b) - 2 * both


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.jaccard_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "s", 3), (2, "a b c d e f", "t", 4), (None, "a b c", "u", 5)], "doc_id long, text string, sid string, component_id int")
    assert sorted(map(tuple, S.jaccard_components(df).collect()), key=repr) == sorted([(1, 2, 1), (2, 2, 1), (None, 1, None)], key=repr)
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(r["component_id"] for r in kept.collect()) == [3, 5]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b.upper()), (7, None), (7, "q x"), (None, a)]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, a), (5, b), (5, b), (7, None), (7, "q x"), (None, a)], key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 20), (30, 31), (31, 32), (32, 30), (3, 40)]
    got = dict(map(tuple, C.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 40: 1, 6: 6, 7: 6, 8: 6, 9: 6, 30: 30, 31: 30, 32: 30}
