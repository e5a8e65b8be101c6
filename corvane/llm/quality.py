"""Quality by importance resampling (operator 4).

Two generative models over hashed unigrams and bigrams: of raw text (all documents), and of target text (labelled good),
which is half the target's own counts and half the raw model, so that an n-gram that few labelled texts have weighs no
text down by more than log 2. A document's log importance weight is the sum of its n-grams' log ratios. With standard
Gumbel noise added, the k largest of all documents are a sample of k without replacement, each draw in proportion to the
weights of those left. k is a parameter: by default as many as the labelled rows tell of good documents, and a small part
of the bad ones besides, so that the cut falls among those.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C
from .common import U

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS = 1 << 16
REPEAT = U(0x5EED)  # the bigram of a word and the same word
#: Labelled rows that the target model and the cut-off are fitted on at most, those of least hash of doc_id.
LABELLED = 200_000


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed unigrams and bigrams of the whole text, with repeats."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hash, tokens), np.uint64, len(tokens))
    two = C.mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])
    two[h[:-1] == h[1:]] = REPEAT
    return (np.concatenate((h, two)) & U(buckets - 1)).astype(np.int64)


MEMO_ROOM = 200_000


class _Memo(dict):
    def __missing__(self, token: str) -> int:
        x = xxhash.xxh3_64_intdigest(shape(token).encode("utf-8", "surrogatepass"))
        if len(self) < MEMO_ROOM:
            self[token] = x
        return x


_MEMO = _Memo()
_hash = _MEMO.__getitem__


def shape(token: str) -> str:
    """Lower case, with a mark where a word of two or more letters is all capitals; a run of one sign by its sign."""
    if len(token) > 1 and token.isupper():
        return "^" + token.lower()
    return token.lower()


def _count(buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for t, good in zip(b.column(0), b.column(1)):
                c = np.bincount(features(t.as_py(), buckets), minlength=buckets)
                total[0] += c
                if good.as_py():
                    total[1] += c
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(at * 2 + kind), pa.array(total[kind][at])], names=["at", "n"])

    return run


def _score(ratio, at: int):
    def run(batches):
        r = np.frombuffer(ratio.value, np.float64)
        for b in batches:
            w = [float(r[features(t.as_py(), len(r))].sum()) for t in b.column(at)]
            if len(_MEMO) > MEMO_ROOM // 2:  # the worker process goes on to other tasks
                _MEMO.clear()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], names=[*b.schema.names, "log_weight"])

    return run


def log_ratio(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(n-gram | target) - log p(n-gram | raw) by bucket; docs: text, good. Counts are of all rows."""
    C.ship(docs.sparkSession)
    sums = docs.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count(buckets), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros((buckets, 2))
    for r in sums.toLocalIterator():  # two counts a bucket at most
        counts[r["at"] // 2, r["at"] % 2] += r["n"]
    return ratio_of(counts[:, 0], counts[:, 1])


def ratio_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    base = (raw + 1) / (raw + 1).sum()
    return np.log(0.5 + 0.5 * target / max(1.0, target.sum()) / base) if target.any() else np.zeros(len(raw))


def kth_largest(values: DataFrame, k: int, slices: int = 4096) -> float:
    """The k-th largest of column x, by counts in slices of ever narrower ranges; only counts reach the driver."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    above = 0
    while high > low:
        width = (high - low) / slices
        at = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(slices - 1))
        counts = values.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("at")).collect()
        for c in counts:
            if above + c["n"] >= k:
                low, high = c["lo"], c["hi"]
                break
            above += c["n"]
        else:
            break
    return low


class Resampler:
    """The fitted models of a corpus: docs (doc_id, text, ...) against labels (doc_id, quality).

    labels: quality 1 is good and 0 bad; nulls are ignored; a doc_id labelled both ways counts as bad. Without labels of
    both kinds every row is kept, unless k says how many. At most `labelled` labelled ids are used to fit, all rows for
    the raw model. spare: the part of the documents labelled bad that k counts besides the good ones.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None, spare: float = 0.05, buckets: int = BUCKETS, labelled: int = LABELLED, seed: int = 7):
        spark = docs.sparkSession
        C.ship(spark)
        self.buckets, self.seed = buckets, seed
        marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good"))
        marks = F.broadcast(C.spill(marks.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled), "labels"))  # of bounded size
        base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        known = base.join(marks, F.col("id") == F.col("label_id"), "left")
        self.ratio = spark.sparkContext.broadcast(log_ratio(known.select("text", "good"), buckets).tobytes())
        self.scores = C.spill(self.keyed(base, "id"), "scores")
        good, bad = marks.agg(F.count(F.when(F.col("good"), 1)), F.count(F.when(~F.col("good"), 1))).first()
        n = self.scores.count()
        self.k = min(n, k) if k is not None else n if not (good and bad) else round(n * (good + spare * bad) / (good + bad))
        self.least = kth_largest(self.scores.select(F.col("key").alias("x")), self.k) if self.k else float("inf")

    def keyed(self, docs: DataFrame, id_column: str) -> DataFrame:
        """docs with log_weight and key at the end; of docs that are id and text alone, the text is left out."""
        at = docs.columns.index("text")
        schema = StructType([*docs.schema.fields, StructField("log_weight", DoubleType())])
        scored = docs.mapInArrow(_score(self.ratio, at), schema)
        draw = F.pmod(F.xxhash64(F.col(id_column).cast("long"), F.length(F.col("text").cast("string")), F.lit(self.seed)), F.lit(1 << 52).cast("long"))
        gumbel = -F.log(-F.log((draw + 0.5) / float(1 << 52)))
        keyed = scored.withColumn("key", F.col("log_weight") + gumbel)
        return keyed.select("id", "log_weight", "key") if docs.columns == ["id", "text"] else keyed


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, key, kept of each row of docs (doc_id, text); options are those of Resampler.

    log_weight is 0 for a text that is null or has no tokens; equal rows have equal keys and are kept or dropped
    together. An empty table gives no rows. Other columns are not read.
    """
    r = Resampler(docs, labels, **options)
    return r.scores.select(F.col("id").alias("doc_id"), "log_weight", "key", (F.col("key") >= F.lit(r.least)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the sample takes, with all columns as they were; nulls and ties as in judge()."""
    r = Resampler(docs, labels, **options)
    names = [f"c{i}" if c != "text" else "text" for i, c in enumerate(docs.columns)]
    scored = r.keyed(docs.toDF(*names), names[docs.columns.index("doc_id")])
    return scored.where(F.col("key") >= F.lit(r.least)).select(*names).toDF(*docs.columns)
