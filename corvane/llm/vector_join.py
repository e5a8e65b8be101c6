"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 7).

Unit vectors are turned into the axes of their second moments, largest first, which keeps products. By cells
of the two leading axes they are packed into tiles of about TILE, with bounds on their leading coordinates; tiles whose
bounds lie too far apart for the threshold never meet. In a pair of tiles the products of the leading axes are summed first; what the rest
can add is at most the product of suffix norms, so pairs that can't reach the threshold stop there. Tiles carry the
vectors as given and are turned where they meet; a pair within rounding of the threshold is decided on the given ones.

Equal vectors are one, with a count. A pair of tiles gives each vector's number of links and its root in that pair's
links, never the links themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TILE, LEAD, BOX = 2048, 16, 8
#: Products of turned unit vectors are within SLACK of the cosine. Open pairs are listed when they are this share of a tile's.
SLACK, SPARSE = 1e-9, 0.1
TILE_SCHEMA = "tile long, c1 int, c2 int, lo array<double>, hi array<double>, ids binary, counts binary, items binary"


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists without nulls, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def moments(vectors: DataFrame, d: int) -> np.ndarray:
    """The sum of x x' over all unit vectors; each task sends one d x d matrix at most."""

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = unit(matrix(b.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s")).collect()
    out = np.zeros(d * d)
    for at, s in rows:
        out[at] = s
    return out.reshape(d, d)


def axes(moment: np.ndarray) -> np.ndarray:
    """Orthonormal columns, of largest second moment first."""
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes (i, j) of rows of a and b whose product may reach `least`, with the product; rows have length 1 and d columns.

    LEAD axes are added at a time. While many pairs are open, products are those of whole tiles, later those of open pairs.
    What is within SLACK of `least` stays in.
    """
    d = a.shape[1]
    suffix = [np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]) for x in (a, b)]
    s, i, j, at = np.zeros((len(a), len(b))), None, None, 0
    while at < d:
        nxt = min(at + LEAD, d)
        if i is None:
            s += a[:, at:nxt] @ b[:, at:nxt].T
        else:
            s = s + np.einsum("ij,ij->i", a[i, at:nxt], b[j, at:nxt])
        at = nxt
        rest = [x[:, at] if at < d else np.zeros(len(x)) for x in suffix]
        on = s + (rest[0][:, None] * rest[1] if i is None else rest[0][i] * rest[1][j]) >= least - SLACK
        if i is not None:
            i, j, s = i[on], j[on], s[on]
        elif at == d or np.count_nonzero(on) <= on.size * SPARSE:
            i, j = np.nonzero(on)
            s = s[i, j]
        if i is not None and not len(i):
            break
    if i is None:
        i, j = np.nonzero(s >= least - SLACK)
        s = s[i, j]
    return i, j, s


def decide(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose cosine is at least `least`: those within SLACK of it go by the given vectors a and b, not by turned ones."""
    on = s >= least
    near = np.flatnonzero(np.abs(s - least) <= SLACK)
    if len(near):
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a[i[near]], b[j[near]]))
        on[near] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= least
    return i[on], j[on]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least index that the edges reach."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            return root


def _pack(turn):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("least", "ascending"), ("rep", "ascending")])
        y = unit(matrix(t["embedding"])) @ turn.value
        return pa.table({"tile": t["tile"][:1], "c1": t["c1"][:1], "c2": t["c2"][:1], "lo": [y[:, :BOX].min(axis=0).tolist()], "hi": [y[:, :BOX].max(axis=0).tolist()], "ids": [t["rep"].to_numpy().tobytes()], "counts": [t["c"].to_numpy().tobytes()], "items": [matrix(t["embedding"]).tobytes()]})

    return run


def _cells(turn, cell: float):
    def run(batches):
        t = turn.value
        for b in batches:
            y = unit(matrix(b.column(2))) @ t[:, :2] if b.num_rows else np.zeros((0, 2))
            c = np.floor(y / cell).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(c[:, 0]), pa.array(c[:, 1] if y.shape[1] > 1 else c[:, 0] * 0)], names=["rep", "c", "embedding", "least", "c1", "c2"])

    return run


def _links(turn, d: int, least: float):
    def run(batches):
        t = turn.value
        for b in batches:
            for x in b.to_pylist():
                a, z = (np.frombuffer(x["items" + k], np.float64).reshape(-1, d) for k in "ab")
                ids = [np.frombuffer(x["ids" + k], np.int64) for k in "ab"]
                counts = [np.frombuffer(x["counts" + k], np.int64) for k in "ab"]
                i, j = decide(a, z, *compare(unit(a) @ t, unit(z) @ t, least), least)
                if x["a"] == x["b"]:
                    on = i < j
                    i, j = i[on], j[on]
                n = len(a)
                links = np.concatenate((np.bincount(i, counts[1][j], n), np.bincount(j, counts[0][i], len(z)))).astype(np.int64)
                node = np.concatenate(ids)
                root = node[roots(n + len(z), i, j + n)]
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(root[on])], names=["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding): links are cosines >= least.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths with each other. Rows that share a vec_id are vectors of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    C.ship(spark)
    e = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    base = vectors.select(F.col("vec_id").cast("long"), e.alias("embedding"))
    fair = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    valid = base.where(fair)
    groups = C.spill(valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("c")).select(F.monotonically_increasing_id().alias("rep"), "c", "embedding", "least"), "vectors")  # rep names a group, once written
    found = []
    for (d,) in groups.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).toLocalIterator():
        mine = groups.where(F.size("embedding") == d)
        found.append(_found(mine, d, least))
    members = base.join(groups.select(F.col("embedding").alias("e"), "rep", "c", "least"), fair & (F.col("embedding") == F.col("e")), "left").select("vec_id", "rep", "c", F.col("least").alias("own"))
    if found:
        all_ = found[0]
        for f in found[1:]:
            all_ = all_.unionByName(f)
        links = all_.groupBy("node").agg(F.sum("links").alias("links"))
        comps = C.components(all_.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = comps.join(groups.select(F.col("rep").alias("node"), "least"), "node").groupBy("comp").agg(F.min("least").alias("first"))
        known = C.spill(links.join(comps, "node", "left").join(named, "comp", "left").select("node", "links", "first"), "known")
        members = members.join(known, F.col("rep") == F.col("node"), "left")
    else:
        members = members.withColumns({"links": F.lit(0).cast("long"), "first": F.lit(None).cast("long")})
    comp = F.coalesce("first", "own", "vec_id")
    return members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("c") - 1, F.lit(0))).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def _found(groups: DataFrame, d: int, least: float) -> DataFrame:
    """node, links, root: what each pair of tiles found."""
    spark = groups.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9  # unit vectors of that cosine are no farther apart
    turn = spark.sparkContext.broadcast(axes(moments(groups, d)))
    placed = C.spill(groups.mapInArrow(_cells(turn, reach), "rep long, c long, embedding array<double>, least long, c1 int, c2 int"), "placed")
    cells = placed.groupBy("c1", "c2").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(TILE))).alias("parts"))
    dealt = placed.join(cells, ["c1", "c2"]).withColumn("tile", F.xxhash64("c1", "c2", F.pmod(F.xxhash64("embedding"), "parts")))
    tiles = C.spill(dealt.select("tile", "c1", "c2", "rep", "c", "embedding", "least").groupBy("tile").applyInArrow(_pack(turn), TILE_SCHEMA), "tiles")
    spot = tiles.select("tile", "c1", "c2", "lo", "hi")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = spot.select(F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(near).alias("d1"), "c1", "c2").select("a", "alo", "ahi", (F.col("c1") + F.col("d1")).alias("c1"), F.explode(near).alias("d2"), "c2").select("a", "alo", "ahi", "c1", (F.col("c2") + F.col("d2")).alias("c2"))
    gap = F.aggregate(F.zip_with(F.zip_with("alo", "hi", lambda x, y: x - y), F.zip_with("lo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(spot.withColumnRenamed("tile", "b"), ["c1", "c2"]).where("a <= b").where(gap <= F.lit(reach * reach)).select("a", "b")
    one = tiles.select(F.col("tile").alias("a"), F.col("ids").alias("idsa"), F.col("counts").alias("countsa"), F.col("items").alias("itemsa"))
    two = tiles.select(F.col("tile").alias("b"), F.col("ids").alias("idsb"), F.col("counts").alias("countsb"), F.col("items").alias("itemsb"))
    return C.spill(pairs.join(one, "a").join(two, "b").mapInArrow(_links(turn, d, least), "node long, links long, root long"), "vector_links", 16)
