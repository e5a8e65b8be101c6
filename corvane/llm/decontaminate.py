"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Texts are normalised: lower-cased, white space runs as one space. An item of m characters may occur with up to
k = floor(m * error) edits. An item too short for an edit must stand as it is, with no letter or digit beside its ends
where it has one there, so that "a" isn't found in "banana". Cut into k + 1 pieces, one of them stands unchanged in every such occurrence; an Aho-Corasick
automaton finds all exact pieces in one pass over a text, and Myers' bit-parallel distance verifies the item about each hit.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = re.compile(r"\s+")
#: Bytes of normalised items that one automaton holds; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 16 << 20


def normal(text: str | None) -> str:
    return SPACE.sub(" ", text.lower()).strip() if text else ""


def budget(m: int, error: float) -> int:
    return int(m * error)


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is cut out of no word."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    right = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not left and not right


def pieces(item: str, error: float) -> list[tuple[int, str]]:
    """(start, piece) of the item's k + 1 pieces, as even as they can be."""
    n = budget(len(item), error) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """(least distance of the pattern to a substring of text, its end); the distance is k + 1 if none is within k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds the items (id, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], error: float):
        import ahocorasick

        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            for start, piece in pieces(text, error):
                at.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item_id, text, budget(len(text), error), masks(text)))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of the items within their budget in text, each once."""
        text = normal(text)
        if not self.items or not text:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.auto.iter(text):
            for i, start in where:
                _, item, k, _ = self.items[i]
                lo = end + 1 - length - start - k
                spans.setdefault(i, []).append((max(0, lo), min(len(text), lo + len(item) + 2 * k)))
        found = []
        for i, each in spans.items():
            item_id, item, k, peq = self.items[i]
            if k == 0:  # the one piece is the item itself
                if any(bounded(text, lo, hi) for lo, hi in each):
                    found.append((item_id, 0))
                continue
            best, done = k + 1, -1
            each.sort()
            merged: list[list[int]] = []
            for lo, hi in each:  # hits close together are verified in one sweep
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                if best == 0:
                    break
                if item in text[lo:hi]:
                    best = 0
                else:
                    best = min(best, myers(peq, len(item), text[lo:hi], k)[0])
            if best <= k:
                found.append((item_id, best))
        return sorted(found)


def _match(blocks, error: float):
    made = {}

    def run(batches):
        if "m" not in made:
            made["m"] = [Matcher(x, error) for x in blocks.value]
        for b in batches:
            ids, items, dist = [], [], []
            for d, t in zip(b.column(0), b.column(1)):
                for m in made["m"]:
                    for item_id, k in m(t.as_py()):
                        ids.append(d.as_py())
                        items.append(item_id)
                        dist.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(dist, pa.int32())], names=["doc_id", "item_id", "distance"])

    return run


def _blocks(benchmark: DataFrame):
    """The items of benchmark in order, in blocks of about BLOCK_BYTES; one at least."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode("utf-8", "replace"))
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.08) -> DataFrame:
    """doc_id, item_id, distance: items of benchmark (item_id, text) in whole texts of docs (doc_id, text), within budget.

    A null, empty or blank text or item matches nothing; an item of under 1 / error characters only as whole words; equal rows of docs match alike, one row each; rows of one
    item_id are items of their own. The benchmark, a stated query set, is taken by all tasks in blocks of BLOCK_BYTES.
    """
    spark = docs.sparkSession
    C.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in _blocks(benchmark):
        made = docs.mapInArrow(_match(spark.sparkContext.broadcast([items]), error), "doc_id long, item_id long, distance int")
        out = made if out is None else out.unionByName(made)
    return out


def _clean(items, at: int, error: float):
    def run(batches):
        m = Matcher(items.value, error)
        for b in batches:
            yield b.filter(pa.array([not m(None if t is None else t.as_py()) for t in b.column(at)], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, error: float = 0.08) -> DataFrame:
    """The rows of docs in whose text no item occurs within its budget, with all columns; decided within the row.

    A stage of a pipeline: it deals nothing out, since each task has a whole block of the benchmark. A benchmark of more
    than one block goes block by block over what the one before has left, written to the shared folder in between, so
    that a task holds one automaton at a time.
    """
    spark = docs.sparkSession
    C.ship(spark)
    at, out, before = docs.columns.index("text"), None, None
    for items in _blocks(benchmark):
        if out is not None:
            left = C.spill(out, "clean")
            if before is not None:
                C.discard(before)
            docs = before = left
        out = docs.mapInArrow(_clean(spark.sparkContext.broadcast(items), at, error), docs.schema)
    return out
