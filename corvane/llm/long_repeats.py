"""Removal of long repeated byte strings by a run-length index (operator 10).

A string of `length` bytes that starts in two places has in both, at the same offset, the same anchor: the 32-byte gram of
least hash in it. So only places whose anchor gram occurs elsewhere can hold such a string, and all that share one are
compared through the text about them, the contexts. Contexts that are equal need no comparison, and of two that match long
enough, both agree on half of it either before or after the anchor: contexts that agree with none on either half go.

The rest are dealt by gram to shards of bounded size, and each shard is indexed: its Burrows-Wheeler transform in runs, with
the common prefixes with the suffixes above and below sampled at each run's start and end. LF steps over the runs stream
every position's matching statistics, backwards: within a run the prefixes grow by one a step, at its ends the samples
take over. Positions with long enough ones are marked.

A gram with more contexts than a shard may hold is split by what its contexts hold about the anchor: each is compared
with one of them, the head. Contexts that leave the head at different places have no more in common than with the head;
those that leave it at the same place by the same byte, before or after the anchor, form a group, which is split anew or
indexed. So the work is linear in the contexts of a gram in each round, and no two of its parts meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U

GRAM, PLACE_BITS = 32, 26
TABLE = C.mix(np.arange(1, 257, dtype=np.uint64))
SEPARATOR = 0xFF  # in no UTF-8 text
RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes): of each window of `length` bytes, its gram of least hash, the leftmost of equals."""
    step = 1 << PLACE_BITS
    if len(text) > step:
        parts = [anchors(text[i : i + step], length) for i in range(0, len(text), step - length + 1)]
        at = np.concatenate([p + i for (p, _), i in zip(parts, range(0, len(text), step - length + 1))])
        at, first = np.unique(at, return_index=True)
        return at, np.concatenate([h for _, h in parts])[first]
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = TABLE[np.frombuffer(text, np.uint8)]
    factor, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * U(factor) + h[width:]
        factor, width = factor * factor & (1 << 64) - 1, width * 2
    h = C.mix(h)
    n, w = len(h), length - GRAM + 1
    key = (h & U((1 << 64) - step)) | np.arange(n, dtype=np.uint64)
    pad = np.full(-(-n // w) * w, U((1 << 64) - 1))
    pad[:n] = key
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    at = np.unique((least & U(step - 1)).astype(np.int64))
    return at, h[at]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: ranks by eight bytes, then groups that are still equal are refined by the ranks further on."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = wide[:n].copy()
    for i in range(1, 8):
        key = (key << U(8)) | wide[i : n + i]
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(start, np.diff(np.concatenate((start, [n]))))
    rank[n] = -1
    h = 8
    slots = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while len(slots) and h < n:
        sub = sa[slots]
        pair = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        order = np.argsort(pair)
        sub, pair = sub[order], pair[order]
        sa[slots] = sub
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        start = np.flatnonzero(new)
        rank[sub] = np.repeat(slots[start], np.diff(np.concatenate((start, [len(slots)]))))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes that start at a and b."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(64, np.uint8)))
    out = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    span = np.arange(32)
    while len(on):
        x, y = a[on] + out[on], b[on] + out[on]
        inside = np.maximum(x, y) < n
        on, x, y = on[inside], x[inside], y[inside]
        same = wide[x[:, None] + span] == wide[y[:, None] + span]
        run = np.where(same.all(axis=1), 32, same.argmin(axis=1))
        out[on] += run
        on = on[run == 32]
    return np.minimum(out, n - np.maximum(a, b))


class RunIndex:
    """A text's Burrows-Wheeler transform in runs, with samples at their ends; the text and its suffix array aren't kept.

    For run k, `start` is its first row and `lf` the row that an LF step leads to from there; the step keeps the order of
    a run's rows. `bits` has a bit for each row, set where a run starts, and `ahead` the number of runs that start before
    each of its words, less one: so a row's run is found without a search. `above` is the common prefix of the suffix at that row with the one above it, `below` that of the
    suffix to which the run's last row leads with the one below. Every LANE positions, `rows`, `ups` and `downs` hold
    where a stream can begin.
    """

    LANE = 512

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        sa = suffix_array(text)
        row = np.empty(n, np.int64)
        row[sa] = np.arange(n)
        bwt = text[sa - 1]
        first = np.concatenate(([True], bwt[1:] != bwt[:-1])) | (sa == 0)
        first[1:] |= sa[:-1] == 0  # the text's start is a run by itself
        self.start = np.flatnonzero(first)
        self.bits = np.packbits(np.append(first, np.zeros(-n % 64, bool)), bitorder="little").view("<u8")
        self.ahead = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits) - 1
        self.end = np.append(self.start[1:], n) - 1
        self.lf = row[sa[self.start] - 1]
        order = np.argsort(self.lf)  # the rows that runs lead to follow each other in this order
        to = self.lf[order][1:]
        between = common_prefixes(text, sa[to], sa[to - 1])
        self.above, self.below = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.above[order] = np.append(0, between)
        self.below[order] = np.append(between, 0)
        last = np.minimum(np.arange(self.LANE, n + self.LANE, self.LANE), n) - 1
        self.rows = row[last]
        up, down = np.maximum(self.rows - 1, 0), np.minimum(self.rows + 1, n - 1)
        self.ups = np.where(self.rows > 0, common_prefixes(text, last, sa[up]), 0)
        self.downs = np.where(self.rows < n - 1, common_prefixes(text, last, sa[down]), 0)

    def run_of(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        return self.ahead[word] + np.bitwise_count(self.bits[word] << (U(63) - (row & 63).astype(np.uint64)))

    def matches(self) -> np.ndarray:
        """For each position of the text, the length of its longest match with any other position."""
        out = np.zeros(self.n, np.int64)
        row, up, down = self.rows, self.ups, self.downs
        low = np.arange(len(row)) * self.LANE
        at = np.minimum(low + self.LANE, self.n) - 1
        while len(at):
            out[at] = np.maximum(up, down)
            on = at > low
            if not on.all():
                row, up, down, low, at = row[on], up[on], down[on], low[on], at[on]
            k = self.run_of(row)
            up = np.where(row == self.start[k], self.above[k], up + 1)
            down = np.where(row == self.end[k], self.below[k], down + 1)
            row = self.lf[k] + row - self.start[k]
            at = at - 1
        return out


def mark(contexts: list[tuple[bytes, int, bytes]], length: int) -> list[np.ndarray]:
    """For each context (text id, start in it, bytes): whether a string of `length` bytes at each offset occurs elsewhere.

    Contexts of a text that overlap are one region, so that no place is taken for a repeat of itself.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][:2])
    parts, home, size, last = [], [0] * len(contexts), 0, None
    for i in order:
        tid, start, data = contexts[i]
        if last and last[0] == tid and start <= last[1]:
            home[i] = last[2] + start - last[3]
            more = data[max(0, last[1] - start) :]
            parts.append(more)
            size += len(more)
            last[1] = max(last[1], start + len(data))
        else:
            if last:
                parts.append(bytes([SEPARATOR]))
                size += 1
            home[i] = size
            last = [tid, start + len(data), size, start]
            parts.append(data)
            size += len(data)
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.append(np.flatnonzero(text == SEPARATOR), len(text))
    room = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    good = np.minimum(RunIndex(text).matches(), room) >= length
    return [good[h : h + max(0, len(c[2]) - length + 1)] for h, c in zip(home, contexts)]


def spans(good: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that marked strings cover."""
    if not len(good):
        return []
    edge = np.zeros(len(good) + length + 1, np.int64)
    at = np.flatnonzero(good)
    edge[at] += 1
    np.add.at(edge, at + length, -1)
    on = np.concatenate(([False], np.cumsum(edge) > 0))
    flip = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(flip[::2], flip[1::2])]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _scan(length: int):
    def run(batches):
        for b in batches:
            n, digest, grams, at = [], [], [], [0]
            for t in b.column(1):
                raw = _raw(t)
                n.append(len(raw))
                digest.append(hashlib.sha256(raw).digest())
                h, times = np.unique(anchors(raw, length)[1], return_counts=True)
                grams.append(np.repeat(h, np.minimum(times, 2)))  # twice where the text itself repeats it
                at.append(at[-1] + len(grams[-1]))
            flat = pa.array(C.signed(np.concatenate([np.zeros(0, np.uint64), *grams])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], names=["doc_id", "n_bytes", "digest", "grams"])

    return run


def _contexts(length: int):
    left = (length - GRAM) // 2  # two places whose match has fewer bytes before the anchor have `right` after
    right = length - left + 1

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for digest, t, wanted in zip(b.column(0), b.column(1), b.column(2)):
                raw = _raw(t)
                at, h = anchors(raw, length)
                h = C.signed(h)
                on = np.isin(h, np.array(wanted.as_py(), np.int64))
                found: dict[tuple[int, int], tuple] = {}
                for p, g in zip(at[on].tolist(), h[on].tolist()):
                    lo, hi = max(0, p - (length - GRAM)), min(len(raw), p + length)
                    data = raw[lo:hi]
                    key = (g, xxhash.xxh3_64_intdigest(data, seed=p - lo) - (1 << 63))
                    if key in found:
                        found[key][0].append(lo)
                        continue
                    half = [xxhash.xxh3_64_intdigest(raw[p - left : p]) - (1 << 63) if p >= left else None, xxhash.xxh3_64_intdigest(raw[p : p + right]) - (1 << 63) if p + right <= len(raw) else None]
                    found[key] = ([lo], hi - lo, p - lo, *half, None if key in seen else data)
                    if len(seen) < 1_000_000:
                        seen.add(key)
                n = len(found)
                cols = list(zip(*found.values())) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([digest.as_py()] * n, pa.binary()), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())], names=["gram", "ctx", "digest", "starts", "size", "at", "lefts", "rights", "data"])

    return run


def _index(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = mark([(r["digest"], r["start"], r["data"]) for r in rows], length)
        out = [(r["gram"], r["ctx"], [{"a": a, "b": b} for a, b in spans(g, length)]) for r, g in zip(rows, found) if g.any()]
        return pa.table({"gram": pa.array([x[0] for x in out], pa.int64()), "ctx": pa.array([x[1] for x in out], pa.int64()), "runs": pa.array([x[2] for x in out], RUNS)})

    return run


def same(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while n > 1:  # the first difference is within n bytes from low
        half = n // 2
        if x[low : low + half] == y[low : low + half]:
            low, n = low + half, n - half
        else:
            n = half
    return low


def _leave(batches):
    """What each context shares with its group's head: bytes before the anchor and from it on, and the bytes after those."""
    for b in batches:
        found = []
        for at, x, p, y in zip(*(b.column(c).to_pylist() for c in ("at", "data", "head_at", "head"))):
            left, right = same(x[:at][::-1], y[:p][::-1]), same(x[at:], y[p:])
            found.append((left, right, x[at - left - 1] if left < at else None, x[at + right] if at + right < len(x) else None))
        cols = list(zip(*found)) or [()] * 4
        kept = ("part", "gram", "ctx", "at", "data", "head_ctx", "head_at")
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, pa.int32()) for c in cols)], names=[*kept, "left", "right", "before", "after"])


LEFT = "part long, gram long, ctx long, at int, data binary, head_ctx long, head_at int, left int, right int, before int, after int"


def _split(held: DataFrame, length: int, block: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of at most `block` contexts, as (part, gram, ctx); runs found on the way, as (gram, ctx, runs)).

    held: (part, gram, ctx, at, data) of the groups that are too large. What their contexts hold goes with them from round
    to round, so a round reads and moves nothing but the groups that are still too large.
    """
    small, runs = [], []
    cell = lambda at, left, right: F.array(F.struct((F.col(at) - F.col(left)).cast("long").alias("a"), (F.col(at) + F.col(right)).cast("long").alias("b")))
    held = C.spill(held, "held")
    while not held.isEmpty():
        heads = held.groupBy("part").agg(F.min(F.struct("ctx", "at", "data")).alias("h"))
        heads = C.spill(heads.select("part", F.col("h.ctx").alias("head_ctx"), F.col("h.at").alias("head_at"), F.col("h.data").alias("head")), "heads")
        met = held.join(heads, "part").where(F.col("ctx") != F.col("head_ctx")).select("part", "gram", "ctx", "at", "data", "head_ctx", "head_at", "head")
        left = C.spill(met.mapInArrow(_leave, LEFT), "left")
        C.discard(held, heads)
        long_ = left.where(F.col("left") + F.col("right") >= length)
        top = long_.groupBy("part", "gram", "head_ctx", "head_at").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        top = top.select("gram", F.col("head_ctx").alias("ctx"), cell("head_at", "left", "right").alias("runs"))
        runs.append(C.spill(long_.select("gram", "ctx", cell("at", "left", "right").alias("runs")).unionByName(top), "runs"))
        ways = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64("part", F.lit(c), n, c)) for n, c in (("left", "before"), ("right", "after"))]), lambda x: x.isNotNull())
        went = C.spill(left.select(F.explode(ways).alias("part"), "gram", "ctx", "at", "data"), "went")
        C.discard(left)
        sizes = went.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = C.spill(went.select("part", "gram", "ctx").join(sizes, "part"), "parts")
        small.append(parts.where(F.col("n") <= block).select("part", "gram", "ctx"))
        large = parts.where(F.col("n") > block).select("part").distinct()  # one id for more than `block` contexts at least
        held = C.spill(went.join(F.broadcast(large), "part"), "held")
        C.discard(went)
    return small, runs


def _merge(batches):
    for b in batches:
        whole = [merged([(x["a"], x["b"]) for x in each]) for each in b.column(1).to_pylist()]
        cells = pa.array([[{"a": a, "b": z} for a, z in w] for w in whole], RUNS)
        yield pa.RecordBatch.from_arrays([b.column(0), cells], names=["digest", "cuts"])


def _rest(batches):
    for b in batches:
        out = []
        for t, cuts in zip(b.column(1), b.column(2)):
            raw, h, at = _raw(t), hashlib.sha256(), 0
            for c in cuts.as_py():
                h.update(raw[at : c["a"]])
                at = c["b"]
            h.update(raw[at:])
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["digest", "rest"])


def remove_repeats(docs: DataFrame, length: int = 400, block: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text), over whole texts in UTF-8.

    Each byte that lies in a string of `length` bytes which also starts elsewhere, in this row or another, is removed. A
    null or empty text has 0 bytes; texts shorter than `length` stay as they are; rows with equal texts, repeated rows
    among them, remove each other whole if long enough. Other columns are not read.
    """
    spark = docs.sparkSession
    C.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = C.spill(docs.mapInArrow(_scan(length), "doc_id long, n_bytes long, digest binary, grams array<long>"), "scan")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"))
    distinct = C.spill(copies, "texts")
    each = distinct.select(F.explode("grams").alias("gram"), "digest")
    twice = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    wanted = C.spill(each.join(twice, "gram").groupBy("digest").agg(F.collect_set("gram").alias("wanted")), "wanted")
    texts = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(wanted, "digest").groupBy("digest").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    texts = C.spill(texts, "candidates")
    C.discard(wanted)
    shape = "gram long, ctx long, digest binary, starts array<long>, size int, at int, lefts long, rights long, data binary"
    places = C.spill(texts.mapInArrow(_contexts(length), shape), "places")
    C.release(spark)  # Spark holds on to the latest write's plan, so the shuffle files before that go

    kinds = places.groupBy("gram", "ctx").agg(F.sum(F.size("starts")).alias("n"), F.first("size").alias("size"))
    pair = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b")))
    whole = kinds.where((F.col("n") > 1) & (F.col("size") >= length)).select("gram", "ctx", pair.alias("runs"))
    one = places.where("data is not null").dropDuplicates(["gram", "ctx"]).select("gram", "ctx", "digest", F.get("starts", F.lit(0)).alias("start"), "at", "data")
    sides = places.where("data is not null").select("gram", "ctx", "lefts", "rights").distinct()
    halves = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64("gram", F.lit(i), c)) for i, c in enumerate(("lefts", "rights"))]), lambda x: x.isNotNull())
    half = sides.select("gram", "ctx", F.explode(halves).alias("half"))
    alike = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    todo = C.spill(one.join(half.join(alike, "half").select("gram", "ctx").distinct(), ["gram", "ctx"]), "contexts")
    kinds = todo.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = C.spill(todo.select("gram", "ctx").join(kinds, "gram"), "dealt")
    C.release(spark)
    crowd = dealt.where(F.col("n") > block).select("gram").distinct()
    small, found = _split(todo.join(F.broadcast(crowd), "gram").select(F.col("gram").alias("part"), "gram", "ctx", "at", "data"), length, block)
    total = todo.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = F.lit(max(1, total // (2 << 20)))
    held = dealt.where(F.col("n") <= block).select(F.pmod("gram", shards).alias("shard"), "gram", "ctx")
    for s in small:
        held = held.unionByName(s.select(F.pmod("part", shards).alias("shard"), "gram", "ctx").distinct())
    made = [*small, *found]
    found.append(held.join(todo, ["gram", "ctx"]).select("shard", "gram", "ctx", "digest", "start", "data").groupBy("shard").applyInArrow(_index(length), "gram long, ctx long, runs array<struct<a:long,b:long>>"))
    for f in found:
        whole = whole.unionByName(f)
    cuts = C.spill(whole.groupBy("gram", "ctx").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")), "cuts")
    C.discard(dealt, todo, *made)
    moved = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r: F.struct((s + r["a"]).alias("a"), (s + r["b"]).alias("b")))))
    lines = cuts.join(places.select("gram", "ctx", "digest", "starts"), ["gram", "ctx"]).select("digest", moved.alias("x"))
    marked = C.spill(lines.groupBy("digest").agg(F.flatten(F.collect_list("x")).alias("x")).mapInArrow(_merge, "digest binary, cuts array<struct<a:long,b:long>>"), "marked")
    C.discard(places, cuts)
    C.release(spark)
    rest = texts.join(marked, "digest").select("digest", "text", "cuts").mapInArrow(_rest, "digest binary, rest string")
    known = distinct.select("digest", "copies").join(marked, "digest", "left").join(rest, "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    lost = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c["b"] - c["a"])
    out = rows.drop("grams").join(known, "digest").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(lost, F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce(F.array_size("cuts"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("rest", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    return out
