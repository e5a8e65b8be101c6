"""N-gram Jaccard join by universe-partition pigeonhole (operator 2).

A text is a set of hashed word shingles. Sets are dealt to size bands whose bounds grow by 1/threshold, so that linked sets
lie in one band or in two neighbours. For a band the universe of hashes is cut into H + 1 segments, H being the largest
symmetric difference of a linked pair there; such a pair agrees on a whole segment, so equal segment signatures give all
candidates. Candidates are first held against parities of the sets, in 512 bits within the join and in four bits an
element after it, which show nearly all pairs that are too far apart, and then verified exactly, on whole sets, from the text.

The sets that share a signature are its list; the least of them leads it. Sets of one group share most of their segments,
so that a pair's many common lists have few leads: pairs are made over leads, not over signatures. Only component ids are
asked for, so each set first meets its least lead; then only sets of leads that still span components meet, and only across
components, with more leaders each round, until no lead spans two.

A segment costs what its list costs. A list is too dear where all its pairs cost more than the one-deletion neighbourhoods
of its sets would: then the segment is skipped (threshold -1), and the sets that had it spend the saved budget on
one-deletion neighbourhoods of their other segments (threshold 1), indexed over all segments of those sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .common import U

MEMBER = "doc_id long, n_shingles long, sid long, parity array<long>, sketch binary, digest long"
#: Bits of the filter of shared signatures are 16 each, between these bounds; a full one lets more pass, which a join sorts out.
FILTER_BITS = (20, 29)
#: A row of a deletion key, made in Python, dealt out and joined, costs about as much as so many parity tests in a join.
KEY_COST = 64
#: Leaders of each lead's sets in the first round; few, since sets of one group link with most of them.
LEADERS = 4
WORDS = 8  # 64-bit words of parity
TRAITS = ["n", *(f"p{i}" for i in range(WORDS))]


class Bands:
    """Size bands and their number of segments for the threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.start = [1]
        while self.start[-1] < 1 << 40:
            self.start.append(self.start[-1] * den // num + 1)
        # |R| + |S| - 2I with I >= num/(num+den) (|R|+|S|) for Jaccard >= num/den
        most = [(self.start[i + 1] + self.start[i + 2] - 2) * (den - num) // (den + num) + 1 for i in range(len(self.start) - 2)]
        self.segments = [n + n // 8 + 1 for n in most]  # some to spare, since empty ones aren't used

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.start, n, side="right")) - 1

    def parts(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, how many are used) under which a set of n elements is indexed: its own band, and the next lower
        it probes. Of a pair both use at least one more than the differences that its sizes allow."""
        b = self.of(n)
        most = {b: n * self.den // self.num, b - 1: self.start[b] - 1}
        return [(i, self.segments[i], (n + most[i]) * (self.den - self.num) // (self.den + self.num) + 1) for i in (b, b - 1) if i >= 0]


def cuts(s: np.ndarray, m: int) -> np.ndarray:
    """Where the m segments of the hash universe start in the sorted set s, and its end."""
    at = np.ceil(np.arange(1, m) * (2.0**64 / m)).astype(np.uint64) if m > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(s, at), [len(s)]))


def tag(band: int, m: int, kind: int = 0) -> np.ndarray:
    return C.mix(np.arange(m, dtype=np.uint64) + U((band * 3 + kind) << 40))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The exact signatures of the segments used under each band of s: the first ones that aren't empty.

    Of a linked pair take the set whose last used segment comes first: of its segments one at least equals the other
    set's, isn't empty, and so is used there too. A set with too few non-empty segments uses all, empty ones as well. If
    one is enough, only equal sets link, and none is needed.
    """
    out, cs = [], np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix(s), dtype=np.uint64)))
    for band, m, used in bands.parts(len(s)):
        if used > 1:
            c = cuts(s, m)
            g = C.mix(cs[c[1:]] - cs[c[:-1]] + tag(band, m))
            full = np.flatnonzero(np.diff(c))
            out.append(g[full[:used]] if len(full) >= used else g)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def neighbourhood(s: np.ndarray, bands: Bands, hot: set[int]) -> tuple[list[np.ndarray], bool]:
    """Keys of one-deletion matching for a set that has hot segments; False if its budget can't make up for them.

    With a of m segments skipped, every pair left over has, among any a other segments, one that differs by exactly one
    element: of the pair's segments, one equals the other less an element. Each set lists all segments whole and less one.
    """
    out, enough = [], True
    mixed = C.mix(s)
    cs = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    for band, m, used in bands.parts(len(s)):
        if used < 2:
            continue
        c = cuts(s, m)
        whole = cs[c[1:]] - cs[c[:-1]]
        full = np.flatnonzero(np.diff(c))
        mine = full[:used] if len(full) >= used else np.arange(m)
        is_hot = np.isin(C.signed(C.mix(whole + tag(band, m))), np.fromiter(hot, np.int64, len(hot)))
        a = int(is_hot[mine].sum())
        if not a:
            continue
        enough &= 2 * a <= len(mine)
        seg = np.repeat(np.arange(m), np.diff(c))
        keep = ~is_hot
        out.append(C.mix(whole + tag(band, m, 1))[keep])
        out.append(C.mix(whole[seg] - mixed[: c[-1]] + tag(band, m, 1)[seg])[keep[seg]])
    return out, enough


def set_of(text: str | None, k: int) -> np.ndarray:
    return C.shingles(C.hash_all(C.words_of(text)), k)


def sid_of(items: bytes) -> int:
    """The set's id, signed: a hash of its sorted elements; 0 of the empty set."""
    x = xxhash.xxh3_64_intdigest(items) if items else 0
    return x - (1 << 64) if x >> 63 else x


def parity(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A bit for each of 64 * words classes of hashes: whether s has an odd number of them. Two sets differ in at least as
    many elements as their parities in bits."""
    odd = np.bincount((s & U(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """A parity of four to eight bits an element, of a power of two words."""
    return parity(s, 1 << max(0, (4 * len(s) - 1) // 64).bit_length())


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """A number of elements in which the sets of two sketches differ at least; the longer sketch is folded to the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(num: int, den: int) -> F.col:
    """Whether parities leave room for a link between the sets of traits n, p0.. and hn, hp0..: none that links is lost."""
    bits = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"hp{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("p0").bitwiseXOR(F.col("hp0"))))
    return (bits * (den + num) <= (F.col("n") + F.col("hn")) * (den - num)) & (F.col("n") * den >= F.col("hn") * num) & (F.col("hn") * den >= F.col("n") * num)


def _members(k: int):
    def run(batches):
        for b in batches:
            ids, ns, sids, odd, wide = [], [], [], [], []
            for i, t in zip(b.column(0), b.column(1)):
                s = set_of(t.as_py(), k)
                ids.append(i.as_py())
                ns.append(len(s))
                sids.append(sid_of(s.tobytes()))
                odd.append(C.signed(parity(s)).tolist())
                wide.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.binary()), b.column(2)], names=["doc_id", "n_shingles", "sid", "parity", "sketch", "digest"])

    return run


def _lists(k: int, bands: Bands, shared=None, bits: int = 0):
    """(sig, sid) of all texts; with a filter, of those signatures that it has."""

    def run(batches):
        held = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for b in batches:
            sids, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in b.column(0):
                s = set_of(t.as_py(), k)
                if len(s):
                    g = signatures(s, bands)
                    if held is not None:
                        at = (g & U((1 << bits) - 1)).astype(np.int64)
                        g = g[(held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                    sigs.append(C.signed(g))
                    sids.append(np.full(len(g), sid_of(s.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sids))], names=["sig", "sid"])

    return run


def shared_filter(dup: DataFrame) -> tuple[bytes, int]:
    """A bit for each low part of the signatures in dup, put together by the executors; and the low part's bits."""
    bits = min(max(FILTER_BITS[0], (16 * dup.count()).bit_length()), FILTER_BITS[1])
    at = F.expr(f"pmod(sig, {1 << bits}L) + 1")
    made = dup.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at"))
    out = bytearray(1 << bits - 3)
    for part, held in made.groupBy("part").agg(F.bitmap_construct_agg("at").alias("held")).toLocalIterator():
        out[(part - 1) * len(held) : part * len(held)] = held
    return bytes(out), bits


def _sets(k: int):
    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                items = set_of(t.as_py(), k).tobytes()
                if sid_of(items) == i.as_py():  # rows that share a doc_id may differ in text
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([items], pa.binary())], names=["sid", "items"])

    return run


def _against(test):
    """(a, b) of the pairs that pass test(x, n_x, y, n_y), of rows (b, salt, kind, a, n, data), sorted: the set b comes
    first (kind 0), then each a that it is to meet."""

    def run(batches):
        left, size = np.zeros(0, np.uint64), 0
        for batch in batches:
            keep = []
            for kind, n, data in zip(batch.column("kind").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_py(), np.uint64)
                if not kind:
                    left, size = x, n
                keep.append(bool(kind) and test(left, size, x, n))
            on = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(on), batch.column("b").filter(on)], names=["a", "b"])

    return run


def _near(num: int, den: int):
    """Whether sketches leave room for a link."""
    return lambda x, n, y, k: differ(x, y) * (den + num) <= (n + k) * (den - num)


def _links(num: int, den: int):
    """Whether whole sets link."""

    def test(x, n, y, k):
        at = np.minimum(np.searchsorted(x, y), n - 1)
        both = int((x[at] == y).sum())
        return den * both >= num * (n + k - both)

    return test


def _met(pairs: DataFrame, data: DataFrame, test, rows: int) -> DataFrame:
    """The pairs (a, b, salt) that pass the test on data (sid, n, data); b goes once to each salt, not to each pair."""
    each = pairs.join(data.withColumnRenamed("sid", "a"), "a").select("b", "salt", F.lit(1).alias("kind"), "a", "n", "data")
    against = pairs.select("b", "salt").distinct().join(data.withColumnRenamed("sid", "b"), "b").select("b", "salt", F.lit(0).alias("kind"), F.col("b").alias("a"), "n", "data")
    dealt = each.unionByName(against).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    return C.spill(dealt.mapInArrow(_against(test), "a long, b long").withColumn("salt", _salt()), "met", rows)


def _salt():
    return F.pmod(F.xxhash64("a"), F.lit(64))


def _covered(lists: DataFrame) -> DataFrame:
    """(lead, sid): which sets share a signature with which lead, each once, leads among them."""
    leads = lists.groupBy("sig").agg(F.min("sid").alias("lead"), F.max("sid").alias("most")).where("lead <> most").select("sig", "lead")
    return lists.join(leads, "sig").select("lead", "sid").distinct()


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, comp) after further links (a, b): those are taken between components, each pair once."""
    if comps is None:
        return C.components(links)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(comps.select(F.col("node").alias(end), F.col("comp").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    new = C.components(ends.select("a", "b").distinct())
    known = comps.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
    return C.spill(known.unionByName(new.join(comps.select("node"), "node", "left_anti")), "components")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, hot_group: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); links are Jaccard >= num/den of k-word shingles.

    A null or blank text has the empty set, links with nothing and is its own component. Repeated rows of one doc_id give
    one row each. Columns besides doc_id and text are not read. A null doc_id gives a row with a null component.
    With extra ("digest",) there is also xxhash64 of the text, which tells rows of one doc_id apart. Lists of more than
    hot_group sets get one-deletion keys; None decides by cost. Shingles and sets go by 64-bit hashes.
    """
    C.ship(docs.sparkSession)
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = C.spill(docs.withColumn("digest", F.xxhash64("text")).mapInArrow(_members(k), MEMBER), "members", 1000)
    members = made.select("doc_id", "n_shingles", "sid", *extra)
    reps = members.where("n_shingles > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    traits = made.where("n_shingles > 0").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.first("parity").alias("parity")).select("sid", "n", *[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(WORDS)])

    # signatures are made twice rather than kept: nearly all are of one set, and what is shared is told by a small filter
    texts = docs.where("doc_id is not null").select("text")
    rows = texts.mapInArrow(_lists(k, bands), "sig long, sid long").repartition("sig")
    dup = C.spill(rows.groupBy("sig").agg(F.min("sid").alias("lead"), F.max("sid").alias("most")).where("lead <> most").select("sig"), "shared", 1000)
    held, bits = shared_filter(dup)
    shared = docs.sparkSession.sparkContext.broadcast(held)
    lists = C.spill(texts.mapInArrow(_lists(k, bands, shared, bits), "sig long, sid long").distinct().join(dup, "sig"), "lists", 1000)
    C.discard(dup)
    C.release(docs.sparkSession)
    sketches = made.where("n_shingles > 0").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("data"))

    def check(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        pairs = C.spill(pairs.withColumn("salt", _salt()), "pairs")
        near = _met(pairs, sketches, _near(num, den), 2000)
        need = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid")
        sets = docs.join(need, docs.doc_id == need.rep).select("sid", "text").mapInArrow(_sets(k), "sid long, items binary")
        sets = C.spill(sets.groupBy("sid").agg(F.first("items").alias("data")).select("sid", (F.length("data") / 8).cast("long").alias("n"), "data"), "sets", 200)
        out = _met(near, sets, _links(num, den), 200).select("a", "b")
        C.discard(pairs, near, sets)
        return out

    cover = C.spill(_covered(lists).join(traits, "sid"), "cover")
    leads = cover.where("sid = lead").select("lead", *[F.col(c).alias(f"h{c}") for c in TRAITS])
    star = cover.groupBy("sid", *TRAITS).agg(F.min("lead").alias("lead")).where("sid <> lead").join(leads, "lead").where(may_link(num, den))
    links = check(star.select(F.col("sid").alias("a"), F.col("lead").alias("b")))
    comps = C.components(links)
    C.discard(links)
    C.release(docs.sparkSession)

    def spanning(key: str, rows: DataFrame) -> DataFrame:
        """The rows, with their components, whose key has sets of two components or more."""
        now = rows.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        mixed = now.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select(key, "size")
        return C.spill(now.join(mixed, key), "left")

    left = spanning("sig", lists)
    C.discard(lists, cover)
    dear = left.join(traits.select("sid", "n"), "sid").groupBy("sig").agg(F.first("size").alias("size"), F.avg("n").alias("n"))
    dear = dear.where(F.col("size") > (KEY_COST * F.col("n") if hot_group is None else F.lit(hot_group))).select("sig")
    if not dear.isEmpty():
        old, left = left, C.spill(_relieve(docs, reps, left, dear, k, bands), "left")
        C.discard(old)
    cover = C.spill(_covered(left.select("sig", "sid")).join(traits, "sid"), "cover")
    C.discard(left)
    leaders = LEADERS
    while True:
        left = spanning("lead", cover)
        if left.isEmpty():
            break
        ranked = Window.partitionBy("lead").orderBy(F.xxhash64("sid"), "sid")
        head = left.select("lead", "sid", "comp", *TRAITS, F.row_number().over(ranked).alias("rn")).where(F.col("rn") <= leaders)
        head = C.spill(head.select("lead", F.col("sid").alias("h"), F.col("comp").alias("hc"), *[F.col(c).alias(f"h{c}") for c in TRAITS]), "heads")
        pairs = left.join(head, "lead").where((F.col("comp") != F.col("hc")) & may_link(num, den))
        links = check(pairs.select(F.greatest("sid", "h").alias("a"), F.least("sid", "h").alias("b")).distinct())
        old, comps = comps, _merged(comps, links)
        rest = C.spill(left.drop("comp", "size").join(head.select("lead", F.col("h").alias("sid")), ["lead", "sid"], "left_anti"), "cover")
        C.discard(links, head, left, cover)
        cover = rest
        leaders *= 16
    C.discard(left, cover)
    roots = reps.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", F.coalesce("comp", "sid").alias("comp"))
    ids = roots.join(roots.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("sid", "component_id")
    out = C.spill(members.join(ids, "sid", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"), *extra), "classes")
    C.discard(made)
    return out


def _relieve(docs: DataFrame, reps: DataFrame, left: DataFrame, dear: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Lists (sig, sid) without the dear ones whose sets' budgets all allow it, with those sets' one-deletion keys instead."""
    hot = left.join(dear, "sig").select("sig", "sid")
    per = hot.groupBy("sid").agg(F.collect_set("sig").alias("hot"))  # at most two bands' segments of a set
    src = docs.join(per.join(reps, "sid"), docs.doc_id == F.col("rep")).select("sid", "text", "hot")

    def run(batches):
        for b in batches:
            for sid, t, h in zip(*(b.column(i) for i in range(3))):
                s = set_of(t.as_py(), k)
                if sid_of(s.tobytes()) != sid.as_py():
                    continue
                keys, enough = neighbourhood(s, bands, set(h.as_py()))
                keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(keys)), pa.array([sid.as_py()] * n, pa.int64()), pa.array([enough] * n, pa.bool_())], names=["sig", "sid", "enough"])

    keys = C.spill(src.mapInArrow(run, "sig long, sid long, enough boolean").distinct(), "deletions", 200)
    free = keys.where("enough").select("sid").distinct().withColumn("free", F.lit(True))
    relieved = hot.join(free, "sid", "left").groupBy("sig").agg(F.min(F.coalesce("free", F.lit(False))).alias("all")).where("all").select("sig")
    stay = left.join(relieved, "sig", "left_anti").select("sig", "sid")
    return stay.unionByName(keys.select("sig", "sid"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those that link to a document of lesser doc_id, directly or by others.

    Rows that share a doc_id are told apart by their texts; those of one text stay or go together. Rows of a null doc_id
    or without words stay.
    """
    classes = jaccard_components(docs, extra=("digest",), **options)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id_"), F.col("digest").alias("gone_digest_")).distinct()
    return docs.join(gone, (docs.doc_id == gone.gone_id_) & (F.xxhash64(docs.text.cast("string")) == gone.gone_digest_), "left_anti")
