"""Mixing sources to target weights by weighted fair queueing (operator 8), in DataFrame functions only.

Each source's documents queue in an order drawn by hash, over and over again up to `repeats` times. A document's virtual
finish time is the size that its source has sent by then, over the source's target. All documents together are sorted by
it over ranges, and the sort is cut off where the sum of sizes fills the budget. A document counts as finished when it is
half sent: sources of few, long documents then stop at the document nearest to their target, not always before it.

Running sums go in two steps so that no source meets in one task: the rows are dealt out over ranges of (source, draw), or
of finish times, and sums of whole ranges are added to sums within a range. What the mix takes of a source is its queue as
often as it fits and the start of it once more, so that a row of a few steps tells it for each source: the texts are never
moved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources by rank, repeating.
WEIGHTS = (5, 2, 1)


#: What a source's queue is ordered by: the draw of a document's id, and for rows of one id that of their texts.
ORDER = ("draw", "doc_id", "tie")


def drawn(doc_id: str, text: str) -> tuple[Column, Column]:
    """(draw in 0..2^60, tie): an order that reruns repeat; rows that share an id, or have none, go by their texts."""
    own = F.concat(F.lit("text "), F.coalesce(F.xxhash64(text), F.lit(0)).cast("string"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), own).cast("binary")), 1, 15), 16, 10).cast("long")
    return draw.alias("draw"), F.xxhash64(text).alias("tie")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text, 0 of null), draw, tie."""
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, *drawn("doc_id", "text"))


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """source, source_size, target of each source: shares of all sizes by weight, none above repeats x its size.

    What a source at its limit can't take goes to the others by weight until none is above: with sources in order of
    limit over weight, the first ones are at their limits and the rest get one level times weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.select("source", "source_size", F.element_at(turn, (rank - 1) % len(weights) + 1).alias("w"), (F.col("source_size") * F.lit(float(repeats))).alias("limit"))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "spent": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "share": F.sum("w").over(after)})
    s = s.withColumn("level", (F.col("total") - F.col("spent")) / F.col("share"))
    # the level of the first source that stays under its limit, the highest of such, holds for all after it
    s = s.withColumn("held", F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(Window.partitionBy()))
    level = F.col("held")
    return s.select("source", "source_size", F.when(level.isNull() | (level * F.col("w") > F.col("limit")), F.col("limit")).otherwise(level * F.col("w")).alias("target"))


def _ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in ranges of keys, with the number of the range; equal keys are in one range."""
    return C.spill(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")


def fair_queue(sizes: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """The rows of sized() with source_size, target and times: how often the mix takes the document, at most `repeats`.

    An empty table gives no rows, an empty text is taken 0 times, a null source is a source of its own. Rows of equal id
    and text stand next to each other in their queue.
    """
    goal = C.spill(targets(sizes, weights, repeats), "targets")
    rows = _ranges(sizes, "source", *ORDER)
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    known = base.join(goal, base.source.eqNullSafe(goal.source)).select(base.source, "part", "base", "source_size", "target")
    lines = rows.join(known, rows.source.eqNullSafe(known.source) & (rows.part == known.part)).select(rows["*"], "base", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    queued = C.spill(lines.withColumn("sent", F.col("base") + F.sum("size").over(inside)).drop("base", "part"), "queue")
    C.discard(rows)

    mid = F.col("sent") - F.col("size") / 2.0
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round")
    finish = (mid + F.col("round") * F.col("source_size")) / F.col("target")
    heard = queued.where("size > 0 and target > 0").select("size", "sent", "source_size", "target", rounds).select("size", finish.alias("finish"))
    cut = _budget_time(heard, queued.agg(F.sum("size")).first()[0] or 0)
    fits = F.floor((F.lit(cut) * F.col("target") - mid) / F.col("source_size")) + 1
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.greatest(F.lit(0), F.least(F.lit(repeats), fits))).otherwise(0)
    return queued.withColumn("times", times.cast("int")).drop("sent")


def _budget_time(heard: DataFrame, budget: int) -> float:
    """The finish time at which the sizes, sorted by it, reach the budget; equal times go together."""
    rows = _ranges(heard, "finish")
    upto = rows.groupBy("part").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("part")))
    full = upto.where(F.col("upto") >= budget).orderBy("part").limit(1).select("part", (F.col("upto") - F.col("n")).alias("base")).collect()
    if not full:
        return 0.0
    last = rows.where(F.col("part") == full[0]["part"]).groupBy("finish").agg(F.sum("size").alias("n"))
    cut = last.withColumn("upto", F.sum("n").over(Window.orderBy("finish")) + full[0]["base"]).where(F.col("upto") >= budget).agg(F.min("finish")).first()[0]
    C.discard(rows)
    return cut


def mix_sizes(docs: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source).

    taken is the number of words the mix takes of the document, its repeats counted. Nulls and ties are as in
    fair_queue(); other columns are not read.
    """
    queue = fair_queue(C.spill(sized(docs), "sized"), weights, repeats)
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """The rows of docs that the mix takes, whole, as often as it takes them, with the columns of docs.

    Along a source's queue the times only fall, so the last place of each number of times decides for all rows: (last,
    times) in order of places, `repeats` + 1 of them at most for a source. A null or empty text is never taken, a null
    source is a source of its own; rows of equal id and text are taken alike.
    """
    queue = fair_queue(C.spill(sized(docs), "sized"), weights, repeats).where("size > 0")
    last = queue.groupBy("source", "times").agg(F.max(F.struct(*ORDER)).alias("last"))
    steps = C.spill(last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("last", "times"))).alias("steps")), "steps")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    rows = docs.where(F.col("text").cast("string").rlike(WORD)).select(row, F.col("doc_id"), F.col("source").cast("string").alias("source"), *drawn("doc_id", "text"))
    known = rows.join(steps.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    times = F.get(F.filter("steps", lambda s: s["last"] >= F.struct(*ORDER)), F.lit(0))["times"]
    copies = F.explode(F.array_repeat(F.lit(1), times))
    return known.select("row", copies.alias("copy")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
