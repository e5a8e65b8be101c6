"""Token-ID output in a Simple-8b word-aligned format (operator 5).

A segment is one binary image, little-endian: magic, block length, ids, documents, blocks, words; then for each document
its id and number of ids; then the first word of each block and the end; then the 64-bit words. A word's upper four bits
select how many ids of how many bits follow; 15 escapes to a whole word that holds one id of more than 60 bits. Blocks of
256 ids start on a word, so that any of them can be decoded alone and all of them at once with array operations. A file
is a Parquet file whose rows are segments in ascending order of document, which every store that Spark writes to can hold.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .common import U

# Ids in a word, bits of an id, by selector (Anh and Moffat's Simple-8b without the run selectors).
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 64])
ESCAPE, BLOCK, PAD = 15, 256, 60
SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bits of small ids
HEAD = struct.Struct("<4sIQQQQ")
MAGIC = b"CVS8"
NULL_ID = -(1 << 63)
SEGMENT = "shard int, seq int, n_docs long, n_ids long, image binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned 64-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    whole = n // BLOCK
    grid[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, : n - whole * BLOCK] = ids[whole * BLOCK :]
    if not n or int(ids.max()) < len(SMALL):
        bits = SMALL[grid.view(np.int64)]
    elif int(ids.max()) >= 1 << 52:
        bits = np.searchsorted(U(1) << np.arange(64, dtype=np.uint64), grid, side="right").astype(np.uint8)
    else:
        bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)
    most, width = bits, 1
    pick = np.where(bits[:, :BLOCK] <= 60, 13, ESCAPE).astype(np.uint8)
    for s in range(12, -1, -1):
        step = int(COUNTS[s]) - width
        most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
        width += step
        pick[most[:, :BLOCK] <= BITS[s]] = s
    starts = np.zeros((blocks, BLOCK), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = n - (blocks - 1) * BLOCK
    while len(row):
        starts[row, at] = True
        at = at + COUNTS[pick[row, at]]
        on = at < length[row]
        row, at = row[on], at[on]
    where = np.flatnonzero(starts)
    sel = pick.ravel()[where]
    size = 1 + (sel == ESCAPE)
    end = np.cumsum(size)
    words = np.zeros(int(end[-1]) if n else 0, np.uint64)
    first = end - size
    words[first] = sel.astype(np.uint64) << U(60)
    cell = where // BLOCK * (BLOCK + PAD) + where % BLOCK
    flat = grid.ravel()
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[first[mine] + 1] = flat[cell[mine]]
            continue
        at, held = cell[mine], np.zeros(len(mine), np.uint64)
        for j in range(COUNTS[s]):
            held |= flat[at + j] << U(j * BITS[s])
        words[first[mine]] |= held
    per = np.bincount(where // BLOCK, weights=size, minlength=blocks).astype(np.int64) if n else np.zeros(0, np.int64)
    return words, np.concatenate(([0], np.cumsum(per)))


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    blocks = len(offsets) - 1
    sel = (words >> U(60)).astype(np.int64)
    real = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if real[i]:
            real[i + 1] = False
    idx = np.flatnonzero(real)
    sel, count = sel[idx], COUNTS[sel[idx]]
    block = np.searchsorted(offsets, idx, side="right") - 1
    before = np.cumsum(count) - count
    head = np.searchsorted(idx, offsets[:-1])
    at = before - before[head][block] if blocks else before
    out = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat, cell = out.ravel(), block * (BLOCK + PAD) + at
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == ESCAPE:
            flat[cell[mine]] = words[idx[mine] + 1]
            continue
        mask = U((1 << int(BITS[s])) - 1)
        at, held = cell[mine], words[idx[mine]]
        for j in range(COUNTS[s]):
            flat[at + j] = (held >> U(j * BITS[s])) & mask
    return out[:, :BLOCK].reshape(-1)[:n]


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    docs = np.array([[NULL_ID if d is None else d, k] for d, k in zip(doc_ids, lengths)], "<i8").reshape(-1, 2)
    return b"".join((HEAD.pack(MAGIC, BLOCK, len(ids), len(docs), len(offsets) - 1, len(words)), docs.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def unpack(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document ids and lengths, ids) of a segment."""
    magic, block, n, docs, blocks, words = HEAD.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token segment")
    at = HEAD.size
    table = np.frombuffer(image, "<i8", docs * 2, at).reshape(docs, 2)
    at += docs * 16
    offsets = np.frombuffer(image, "<u4", blocks + 1, at).astype(np.int64)
    return table, decode(np.frombuffer(image, "<u8", words, at + 4 * (blocks + 1)), offsets, n)


class Encoder:
    """Ids of texts from a tokenizers file, remembering pieces that come again.

    Where a single space or line end stands between characters that aren't white space, a byte-level tokenizer's
    pre-tokens start anew, and so do they between letters and a sign other than the apostrophe; pieces between such places
    can be encoded alone. An added token of the file, such as <|endoftext|>, is a piece wherever a text has it, and what
    stands on either side ends there, as in the library. Pieces of up to LONG characters are remembered while they and
    their ids take `room` bytes at most; others are encoded each time they come. A tokenizer with other pre-tokens than the
    byte-level ones, or with a normalizer, is refused.
    """

    WHITE, DARK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"  # the tokenizer's \s and \S; Python's \s has \x1c-\x1f as well
    LETTER, SIGN = r"[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-&(-/:-@\[-`{-~]"
    OTHER = r"(?:[^\s!-&(-/:-@\[-`{-~]|[\x1c-\x1f])"  # dark, and no sign
    PIECE = re.compile(rf" ?{LETTER}++(?!{OTHER})| ?{DARK}++|{WHITE}+(?!{DARK})|{WHITE}+")  # most words end in the first branch
    BLANK = re.compile(rf"{WHITE}+")
    LONG = 64

    def __init__(self, tokenizer_json: str, room: int = 160 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        told = json.loads(tokenizer_json)
        if told.get("normalizer") or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space") or not told["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normalizer can be taken piece by piece")
        added = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.longest = len(added[0]) if added else 0
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        if added:
            a = self.added.pattern
            w, d = rf"(?:(?!{a}){self.WHITE})+", rf"(?:(?!{a}){self.DARK})+"
            self.mixed = re.compile(rf"{a}| ?(?:(?!{a}){self.LETTER})++(?={self.SIGN})| ?{d}|{w}(?={a}|(?!{self.DARK}))|{w}")
        self.room = room
        self.known: dict[str, bytes] = {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def cutter(self, text: str) -> re.Pattern:
        """What finds the pieces of the text: PIECE, unless an added token is in it."""
        return self.mixed if self.added and self.added.search(text) else self.PIECE

    def made(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces. They are encoded as lines of one text, where they can't touch each other."""
        found: dict[str, bytes] = {}
        lines = [p for p in new if "\n" not in p and not self.BLANK.fullmatch(p)]
        if len(self.line) == 1 and lines:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) == len(lines) - 1:
                raw, at = ids.tobytes(), 0
                for p, e in zip(lines, [*(ends * 4).tolist(), len(raw)]):
                    found[p] = raw[at:e]
                    at = e + 4
        rest = [p for p in new if p not in found]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[p] = np.array(e.ids, "<u4").tobytes()
        if self.room > 0:
            kept = {p: x for p, x in found.items() if len(p) <= self.LONG}
            self.room -= sum(map(len, kept)) + sum(map(len, kept.values())) + 200 * len(kept)  # two objects and a place in the table
            self.known.update(kept)
        return found

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit words."""
        out = list(map(self.known.get, pieces))
        if None in out:
            at = [i for i, x in enumerate(out) if x is None]
            found = self.made(list({pieces[i] for i in at}))
            for i in at:
                out[i] = found[pieces[i]]
        return out

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        pieces, ends = [], []
        for t in texts:
            if t:
                pieces += self.cutter(t).findall(t)
            ends.append(len(pieces))
        ids = self.ids(pieces)
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


#: Characters of texts that are encoded together.
TOGETHER = 400_000


def encoded(enc: Encoder, batches):
    """(document id, ids) of Arrow batches of document ids and texts, a few texts at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0), b.column(1)):
            ids.append(d.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= TOGETHER:
                yield from zip(ids, enc.many(texts))
                ids, texts, size = [], [], 0
    yield from zip(ids, enc.many(texts))


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """This process's encoder of that tokenizer."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def _write(tokenizer, end_id: int, segment_ids: int):
    def run(batches):
        enc, shard, seq = encoder(tokenizer.value), TaskContext.get().partitionId(), 0
        docs, lengths, parts, total = [], [], [], 0
        end = struct.pack("<I", end_id)

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()), pa.array([pack(docs, lengths, ids)], pa.binary())], names=["shard", "seq", "n_docs", "n_ids", "image"])

        for d, ids in encoded(enc, batches):
            docs.append(d)
            lengths.append(len(ids) // 4 + 1)
            parts += (ids, end)
            total += lengths[-1]
            if total >= segment_ids:
                yield flush()
                docs, lengths, parts, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int = 0, segment_ids: int = 1 << 18, path: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) whole, appends end_id to each, and writes segments in ascending order of doc_id.

    Rows of equal doc_id stand in order of their texts; null ids come first; a null or empty text has the end id alone.
    Returns the segments as read back: shard, seq, n_docs, n_ids, image.
    """
    spark = docs.sparkSession
    C.ship(spark)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)  # of fixed size
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = dealt.mapInArrow(_write(vocabulary, end_id, segment_ids), SEGMENT)
    if path is None:
        return C.spill(made, "tokens")
    made.write.parquet(path)
    return spark.read.schema(SEGMENT).parquet(path)


def _digests(batches):
    for b in batches:
        for base, image in zip(b.column("base"), b.column("image")):
            docs, ids = unpack(image.as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(docs[:, 1])
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), docs[:, 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([None if d == NULL_ID else d for d in docs[:, 0].tolist()], pa.int64()), pa.array(base.as_py() + ends - docs[:, 1], pa.int64()), pa.array(docs[:, 1].copy(), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the images alone.

    Starts are sums over segments in two steps: over the shards, which are as many as the write had tasks, and within
    each shard.
    """
    spark: SparkSession = segments.sparkSession
    C.ship(spark)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    inner = Window.partitionBy("shard").orderBy("seq")
    bases = segments.select("shard", "seq", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inner_base")).join(shards, "shard").select("shard", "seq", (F.col("shard_base") + F.col("inner_base")).alias("base"))
    bases = C.spill(bases, "bases")  # whether it's sent to all tasks goes by its written size, under Spark's own bound
    return segments.join(bases, ["shard", "seq"]).select("base", "image").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_json: str, **options) -> DataFrame:
    return read_digests(write_tokens(docs, tokenizer_json, **options))
