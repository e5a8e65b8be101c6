import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate as D
from corvane.llm import html_text as H
from corvane.llm import mixing as M
from corvane.llm import quality as Q
from corvane.llm import url_filter as W


def distance(item, text):
    """Least edit distance of item to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matches_equal_brute_force():
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(n))
    items = [(i, say(rng.randint(1, 25))) for i in range(25)] + [(98, None), (99, " ")]
    m = D.Matcher(items, 0.08)
    for _ in range(120):
        item = rng.choice(items[:25])[1]
        t = list(item)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(["", "a", "zz", t[0].upper()])
        text = say(rng.randint(0, 20)) + " \n " + "".join(t) + " " + say(5)
        expected = []
        for i, raw in items:
            n = D.normal(raw)
            if n and int(len(n) * 0.08) == 0:  # too short for an edit: whole words only
                if re.search(rf"(?<![a-z]){re.escape(n)}(?![a-z])", D.normal(text)):
                    expected.append((i, 0))
            elif n and (d := distance(n, D.normal(text))) <= int(len(n) * 0.08):
                expected.append((i, d))
        assert m(text) == sorted(expected)
    assert m(None) == m("") == m("  ") == []


def test_short_items_match_as_whole_words():
    m = D.Matcher([(1, "a"), (2, "ab"), (3, "yes"), (4, "x = 1"), (5, "+1")], 0.08)
    assert m("banana question, crab") == [] and m("say YES") == [(3, 0)] and m("a b") == [(1, 0)]
    assert m("max = 1") == [] and m("x = 12") == [] and m("if x  =\n1:") == [(4, 0)] and m("n+1") == [(5, 0)] and m("n+12") == []
    assert D.budget(12, 0.08) == 0 and D.budget(13, 0.08) == 1


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps over the lazy dog y", "k"), (2, None, "l"), (3, "clean", None), (1, "x The  quick brown fox jumps over the lazy dag", "m")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog"), (8, None)], "item_id long, text string")
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == [(1, 7, 0), (1, 7, 1)]
    assert sorted(r[0] for r in D.clean(docs, bench).collect()) == [2, 3] and D.clean(docs, bench).columns == docs.columns
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == 4
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    """A benchmark of more than one block is taken whole by both, with the same documents."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(i, say(3)) for i in range(9)] + [(20, None)]
    rows = [(i, f"{say(4)} {items[i][1] if i < 9 else say(3)} {say(4)}", f"k{i}") for i in range(14)] + [(30, None, "n")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.clean(docs, bench)
    assert len(list(D._blocks(bench))) > 3 and got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted((r for r in rows if r[0] > 8), key=lambda r: r[0])
    assert {r["doc_id"] for r in D.contaminated(docs, bench).collect()} == set(range(9))


def test_html(spark):
    tree = H.train()
    cases = {
        "<article><p>A &lt;b&gt; &amp;amp; &#65;&nbsp;x <i>y</i>z<br>w</article>": "A <b> &amp; A x yz w",
        "<title>t</title><article><header><h1>T</h1></header><p>x y</p><div class='share-bar'>Share</div></article><section id=comments><article><p>c c c</p></article></section>": "T\nx y",
        "<body><nav><a href=/>Home</a></nav><div class=cookie-banner>We use cookies</div><main><p>One.</p><p>Two</p><aside>Ad</aside></main><footer>&copy; me</footer>": "One.\nTwo",
        "<script>var t='</p>';</script><article><p>Is.</p><!-- no --><style>p{}</style><form><label>x</label></form></article>": "Is.",
        "<article><p>cut <b>off": "cut off",
        "": "",
        "<div": "",
        "<p>a b c</p>": "a b c",
        "<h1>Head</h1><p>Short one here.</p><p>Tiny.</p>": "Head\nShort one here.\nTiny.",
        "<article><p>Let <math><mi>x</mi></math> be <svg><text>odd</text></svg>.</p><section class='legal warning'><p>Do not open the case.</p></section></article>": "Let x be odd.\nDo not open the case.",
        "<div id='search-results'><p>What was found in the deep sea last year.</p></div>": "What was found in the deep sea last year.",
        "<ul><li><a href=/>Home</a></li><li><a href=/a>All of it</a></li></ul><div><p>" + "many words " * 20 + "</p><p>Few.</p><p>" + "and more " * 15 + "</p></div><div><a href=/x>Next page</a></div>": ("many words " * 20).strip() + "\nFew.\n" + ("and more " * 15).strip(),
    }
    for page, text in cases.items():
        assert H.main_text(page, tree) == text
    rows = [(1, "u", "<article><p>é x</p></article>", "t"), (2, None, None, "v")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "u", "é x", 3), (2, None, "", 0)]


def test_tree_uses_neighbours_and_holds_out():
    def used(tree):
        return {H.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert {"words", "link_density"} & used(H.train()) and {"words_before", "words_after", "link_density_before", "link_density_after"} & used(H.train())
    right = total = 0
    for i, page in enumerate(H.SAMPLES):
        tree = H.train(H.SAMPLES[:i] + H.SAMPLES[i + 1 :])
        found = H.blocks(page)
        right += sum(H.decide(tree, row) == int(b.mark or 0) for b, row in zip(found, H.features(found)))
        total += len(found)
    assert right / total > 0.75


def test_long_and_odd_pages():
    tree = H.train()
    long_ = "<article>" + "<p>word İ</p><script>x</script>" * 20_000 + "</article>"
    assert H.main_text(long_, tree) == "\n".join(["word İ"] * 20_000)
    assert H.main_text(None, tree) == H.main_text(" \n", tree) == ""


def test_pages_of_the_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.collect()
    assert H.extract(pages.limit(0)).count() == 0
    for r in H.extract(pages).collect():
        page = next(p["html"] for p in rows if p["page_id"] == r["page_id"])
        body = re.search("<article>(.*)</article>", page, re.S)[1]
        words = lambda t: re.sub(r"\s+", " ", t).strip()
        assert words(r["text"].replace("\n", " ")) == words(html.unescape(re.sub("<[^>]*>", " ", body)).replace("\n", " ")) and r["n_chars"] == len(r["text"])


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?y"), (2, "https://example.org/en/15#z"), (3, None), (4, "no scheme"), (5, "http://much.net/a"), (6, "http://little.net/"), (7, "x://com/fr/é"), (8, "http://bet.a.com/de/"), (9, "http://a.org?x=/es/"), (5, "http://much.net/a"), (10, "http://MUCH.net#b"), (11, "http://a.org/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    expected = [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/15", "example.org/en/1", "block"),
        (3, "", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "much.net", "/a", None, "block"),
        (5, "much.net", "/a", None, "block"),
        (6, "little.net", "/", None, "allow"),
        (7, "com", "/fr/é", "com/fr/", "allow"),
        (8, "bet.a.com", "/de/", "com/de/", "block"),
        (9, "a.org", "", None, "allow"),
        (10, "much.net", "", None, "block"),
        (11, "a.org", "/", "org/", "allow"),
    ]
    assert sorted(map(tuple, W.judge(df, least=3).collect())) == expected
    listed = spark.createDataFrame([("much.net",), (None,), ("",), ("much.net",), ("elsewhere.net",)], "host string")
    assert sorted(map(tuple, W.judge(df, listed=listed).collect())) == expected
    assert W.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for array_bits in (1 << 29, 512):
        c = W.Cascade(keys, bits_per_key=3.0, hashes=2, array_bits=array_bits)
        assert len(c.levels) > 2 and (array_bits > 512 or len(c.levels[0][0]) > 2)
        assert keys.where(c.listed(F.col("key")) != F.col("listed")).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 40), None if i % 11 == 0 else f"s{i % 5}", "x") for i in range(600)] + [(700, None, "s0", "y"), (701, "", "zero", "y"), (702, "a b", "s1", None), (702, "a b", "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = M.mix_sizes(df).collect()
    assert sorted(got) == sorted(M.mix_sizes(df).collect()) and len(got) == len(rows)
    by = {}
    for (_, t, s, _), r in zip(sorted(rows, key=lambda r: r[0]), sorted(got, key=lambda r: r["doc_id"])):
        assert r["size"] == len((t or "").split()) and r["taken"] in [r["size"] * k for k in range(4)]
        by.setdefault(s, []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(each[0]["target"] for each in by.values()) - total) < 1e-6
    for each in by.values():
        size, target = sum(r["size"] for r in each), each[0]["target"]
        assert each[0]["source_size"] == size and target <= 3 * size + 1e-9 and abs(sum(r["taken"] for r in each) - target) <= 40
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert M.mix_sizes(df.limit(0)).count() == 0


def test_targets_fill_by_weight(spark):
    rows = [("a", 1), ("b", 1000), ("c", 500), (None, 10)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: r["target"] for r in M.targets(sizes).collect()}
    assert got["a"] == 3 and got[None] == 30  # weights 5 and 5, both at their limits
    assert got["b"] == pytest.approx((1511 - 33) * 2 / 3) and got["c"] == pytest.approx((1511 - 33) / 3)


def test_quality(spark):
    rng = random.Random(4)
    words = ["the", "river", "runs", "past", "old", "stone", "houses", "and", "people", "walk"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 80))) + "."
    bad = lambda: " | ".join(rng.choice(words) + rng.choice(["###", "$$$"]) for _ in range(rng.randint(30, 80)))
    rows = [(i, bad() if i % 6 == 0 else good(), i) for i in range(300)] + [(400, None, 1), (401, "", 2), (3, rng.choice(words), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(0, 150)] + [(None, 1), (7, None)], "doc_id long, quality int")
    rows_ = Q.judge(docs, labels).collect()
    got = {r["doc_id"]: r["kept"] for r in rows_}
    good_id = lambda i: i % 6 != 0
    assert all(got[i] for i in range(150, 300) if good_id(i)) and sum(got[i] for i in range(150, 300) if not good_id(i)) <= 4
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    assert Q.judge(docs, labels.limit(0)).where("kept").count() == len(rows)
    assert Q.judge(docs.limit(0), labels).count() == 0

    # brute force: the models, the weights, and the k largest of weight and noise
    feats = [Q.features(t) for _, t, _ in rows]
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for (i, _, _), f in zip(rows, feats):
        np.add.at(raw, f, 1)
        if i < 150 and i != 7 and good_id(i):
            np.add.at(target, f, 1)
    np.add.at(target, Q.features(docs.where("doc_id = 7").first()["text"]), 1)  # its other label is null
    ratio = Q.ratio_of(raw, target)
    weights = sorted((i, round(float(ratio[f].sum()), 6)) for (i, _, _), f in zip(rows, feats))
    assert sorted((r["doc_id"], round(r["log_weight"], 6)) for r in rows_) == weights
    noise = [r["key"] - r["log_weight"] for r in rows_]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and abs(np.std(noise) - 1.2825) < 0.3
    for k in (1, 40, 200):
        drawn = Q.judge(docs, labels, k=k).collect()
        least = sorted((r["key"] for r in drawn), reverse=True)[k - 1]
        assert all(r["kept"] == (r["key"] >= least) for r in drawn)


def test_kth_largest(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 1) for _ in range(900)] + [5.0] * 40
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 20, 41, 500, 940):
        assert Q.kth_largest(df, k, slices=16) == sorted(xs, reverse=True)[k - 1]
