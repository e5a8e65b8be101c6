import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import token_files as T
from corvane.llm.queries import byte_bpe_50k
from corvane.llm.token_counts import Counted, count_tokens


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe_50k()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=700))
def test_words_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert (T.decode(*T.encode(a), len(a)) == a).all()


def test_segments_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        a = rng.integers(0, 50257, n).astype(np.uint64)
        docs, back = T.unpack(T.pack([None, 7], [n, 0], a))
        assert (back == a).all() and docs.tolist() == [[T.NULL_ID, n], [7, 0]]


ODD = ["", " ", "  a", "a  b\n\n c", "<|endoftext|> x", "it's 'll '", "a\x1c b \x1d", "日本 語\n\n", "a \n b\n  ", "\r\n a\r\nb", "x" * 3000]


def test_encoder_equals_the_library(bpe):
    e = T.Encoder(bpe, room=10)
    for t in ODD:
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_files(spark, bpe):
    rows = [(5, "one two"), (2, None), (9, ""), (-4, "It's <|endoftext|>"), (None, "z"), (5, "a"), *((i + 20, t) for i, t in enumerate(ODD))]
    got = T.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), bpe, segment_ids=8).collect()
    enc, at, expected = T.Encoder(bpe).tokenizer, 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = enc.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert T.token_digests(spark.createDataFrame([], "doc_id long, text string, n_ids int"), bpe).count() == 0


def test_edits_equal_a_fresh_count(bpe):
    enc, rng = T.Encoder(bpe), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "é", "日", "1", "!", "\t", "word", "'ll"]
    for _ in range(150):
        ref = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 20, 400])))
        d = Counted(ref, enc)
        for _ in range(5):
            s, n, ins = rng.randint(-1, len(ref) + 2), rng.choice([0, 1, 3, 50]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 150])))
            a = min(max(0, s), len(ref))
            ref = ref[:a] + ins + ref[min(a + n, len(ref)) :]
            d.edit(s, n, ins)
            assert d.text == ref and d.n_tokens == len(enc.tokenizer.encode(ref, add_special_tokens=False).ids)
            assert d.tree.n_leaves == len(enc.PIECE.findall(ref)) and d.tree.n_chars == len(ref)


def test_edits_reencode_little(bpe):
    d = Counted("word and more words. " * 5000, T.Encoder(bpe))
    d.edit(50_000, 3, "xyz")
    assert d.encoded < 8


def test_count_tokens(spark, bpe):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "one two three", 7), (2, None, 8), (None, "", 9), (1, "one two three", 7)], "doc_id long, text string, edits int")
    edits = F.array(F.struct(F.lit(4).cast("long").alias("start"), F.lit(3).cast("long").alias("deleted"), F.lit("2").alias("inserted")), F.lit(None))
    got = sorted([tuple(r)[:3] for r in count_tokens(df, bpe, edits).collect()], key=repr)
    n = len(T.Encoder(bpe).tokenizer.encode("one 2 three").ids)
    assert got == sorted([(1, 3, n), (2, 0, 1), (None, 0, 1), (1, 3, n)], key=repr)
    assert count_tokens(df.limit(0), bpe).count() == 0


def fresh():
    """The tokenizer as the library reads it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_added_tokens_are_the_librarys(bpe):
    end, e, plain, rng = "<|endoftext|>", T.Encoder(bpe), fresh(), random.Random(6)
    assert np.frombuffer(e("x" + end), "<u4").tolist() == plain.encode("x" + end, add_special_tokens=False).ids == [87, 50256]
    parts = [end, end, end[:5], end[5:], " ", "  ", "\n", "\n\n", "a", "it's", "<", "<|", "1", "日", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for t, ids in zip(texts, e.many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    for ref in texts[:400]:
        d = Counted(ref, e)
        for _ in range(6):
            s, n, ins = rng.randint(0, len(ref)), rng.choice([0, 1, 4]), "".join(rng.choice(parts + ["t|>", "<|endo"]) for _ in range(rng.choice([0, 1, 3])))
            ref = ref[:s] + ins + ref[min(s + n, len(ref)) :]
            d.edit(s, n, ins)
            assert d.text == ref and d.n_tokens == len(plain.encode(ref, add_special_tokens=False).ids)
            assert d.tree.n_leaves == len(e.cutter(ref).findall(ref)) and d.tree.n_chars == len(ref)


def test_white_space_is_the_tokenizers(bpe):
    e, plain, rng = T.Encoder(bpe), fresh(), random.Random(7)
    assert np.frombuffer(e("a\n\n\x1cb"), "<u4").tolist() == plain.encode("a\n\n\x1cb", add_special_tokens=False).ids == [64, 198, 198, 216, 65]
    parts = ["a", "1", "'s", ".", " ", " ", "\n", "\n", "\r", "\t", *map(chr, range(0x1B, 0x20)), "\x0b", "\x0c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    for t, ids in zip(texts, e.many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    for ref in texts[:300]:
        d = Counted(ref, e)
        for _ in range(4):
            s, n, ins = rng.randint(0, len(ref)), rng.choice([0, 1, 4]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3])))
            ref = ref[:s] + ins + ref[min(s + n, len(ref)) :]
            d.edit(s, n, ins)
            assert d.n_tokens == len(plain.encode(ref, add_special_tokens=False).ids)
