"""A corpus pipeline: five stages over documents, each of them one of the training-data operators.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common as C

#: What each stage has written to the shared folder for its result, by the stage's place.
_HELD: dict[int, list] = {}


def _stage(place: int):
    """A stage at that place. Its docs are its predecessor's written result, so what earlier stages wrote for theirs goes."""

    def wrap(f):
        @wraps(f)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in range(place):
                C.delete(_HELD.pop(earlier, []))
            before = C.spilled()
            out = f(spark, docs, sf_dir)
            _HELD[place] = [t for t in C.spilled() if t not in before]
            return out

        return stage

    return wrap


@_stage(0)
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling takes; labels are those of the data set."""
    from corvane.llm.quality import keep

    return keep(docs, C.table(spark, sf_dir, "labels"))


@_stage(1)
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8): that of the least doc_id."""
    from corvane.llm.set_join import keep_one

    return keep_one(docs, k=5, num=80, den=100)


@_stage(2)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item occurs."""
    from corvane.llm.decontaminate import clean

    return clean(docs, C.table(spark, sf_dir, "benchmark"))


@_stage(3)
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks."""
    from corvane.llm.mixing import mix_documents

    return mix_documents(docs)


@_stage(4)
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as coded token ids, and returns what is read from the files."""
    from corvane.llm.queries import byte_bpe_50k
    from corvane.llm.token_files import token_digests

    return token_digests(docs, byte_bpe_50k(), end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The first stage's noise and hashed models can't be said in SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = C.spill(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            C.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
