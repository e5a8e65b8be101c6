import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import long_repeats as R


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        cuts = R.spans(np.array([seen[r[i : i + length]] > 1 for i in range(len(r) - length + 1)], bool), length)
        kept, at = b"", 0
        for a, b in cuts:
            kept, at = kept + r[at:a], b
        out.append((d, len(r), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept + r[at:]).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "é", "sit", "x"]) + str(rng.randrange(99)) for _ in range(n))
    shared = [say(30), say(60), say(15)]
    rows = []
    for i in range(40):
        t = say(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            q = rng.choice(shared)
            t += " " + q[rng.randrange(len(q) // 2) :] + " " + say(rng.randrange(20))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "a" * 1500), (103, "b" * 450), (104, say(90) * 3), (105, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (106, ("line of text " + say(3) + "\n") * 40)]
    return rows


@pytest.mark.parametrize("length,block", [(400, 2048), (400, 3), (100, 2), (101, 4)])
def test_against_brute_force(spark, monkeypatch, length, block):
    monkeypatch.setattr(R, "PLACE_BITS", 10)  # so that texts are taken in pieces, as very long ones are
    rows = corpus(length + block)
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, length)


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string, digest string")).count() == 0


def test_run_index(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 50))) * rng.randint(1, 3)
        monkeypatch.setattr(R.RunIndex, "LANE", rng.choice([1, 7, 512]))

        def common(i, j):
            n = 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            return n

        index = R.RunIndex(np.frombuffer(b, np.uint8))
        assert index.matches().tolist() == [max([common(i, j) for j in range(len(b)) if j != i], default=0) for i in range(len(b))]


def test_common_prefix():
    rng = random.Random(5)
    for _ in range(300):
        x, y = (bytes(rng.choice(b"aab") for _ in range(rng.randrange(9))) for _ in "xy")
        assert R.same(x, y) == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_planted_passages(spark):
    """Passages of over 50 words that recur lose their bytes if they are of 400 bytes or more, and nothing else does."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(5, 9))) for _ in range(n))
    passages = [say(n) for n in (55, 80, 300)]
    short = say(51)[:399]
    rows = [(i, f"{say(40)}\n{p}\n{say(25)}") for i, p in enumerate([p for p in passages for _ in range(4)])]
    rows += [(100 + i, f"{say(30)}\n{short}\n{say(30)}") for i in range(3)] + [(200 + i, say(120)) for i in range(8)]
    got = {r["doc_id"]: r for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate([p for p in passages for _ in range(4)]):
        assert got[i]["n_spans"] == 1 and len(p) <= got[i]["n_removed"] <= len(p) + 6
    assert all(got[i]["n_removed"] == 0 and got[i]["n_bytes"] == len(t) for i, t in rows if i >= 200)
    assert all(got[100 + i]["n_removed"] in (0, 400, 401) for i in range(3))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    core = bytes(rng.randrange(97, 103) for _ in range(450))
    one, two = b"zq" * 100 + core, b"y" * 77 + core + b"tail"
    a, b = (dict(zip(*(x.tolist() for x in R.anchors(t, 400)))) for t in (one, two))
    inside = [p - 200 for p in a if 200 <= p and p + R.GRAM <= 650]
    assert any(p + 77 in b and b[p + 77] == a[p + 200] for p in inside)


def test_index_holds_samples_of_runs_alone():
    text = np.tile(np.random.default_rng(9).integers(0, 4, 50), 40).astype(np.uint8)
    index = R.RunIndex(text)
    assert all(len(v) <= 100 for v in vars(index).values() if isinstance(v, np.ndarray)) and len(text) == 2000


def test_rounds_move_only_crowded_contexts(spark):
    """What a gram of many contexts takes to split doesn't depend on the contexts of all other grams."""
    rng = random.Random(11)
    say = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    core, forks = say(400), [(say(60), say(60)) for _ in range(5)]
    rows = [(i, rng.choice("xyz") + core + "".join(f[i >> j & 1] for j, f in enumerate(forks)) + say(500)) for i in range(64)]
    for i in range(300):
        passage = say(700)
        rows += [(1000 + 2 * i + j, say(600) + passage + say(600)) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def run(block):
        written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
        before = written()
        got = sorted(map(tuple, R.remove_repeats(docs, 400, block).collect()), key=repr)
        return got, written() - before

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        (whole, plain), (split, more) = run(2048), run(3)
    finally:
        spark.conf.set(key, old)
    assert whole == split == brute(rows, 400)
    assert more - plain < plain / 2, (plain, more)
