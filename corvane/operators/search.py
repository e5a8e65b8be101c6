"""Full-text search by BM25, and exact nearest neighbours of vectors."""

from __future__ import annotations

import math

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQuery, SchemaMismatch
from ..plans import predicates as P

TERM = r"[\p{IsAlphabetic}\p{N}]+"
_PY_TERM = regex.compile(r"[\p{Alphabetic}\p{N}]+")  # the same runs, for queries
# Fixed values of the ranking function.
K1, B = 1.2, 0.75
METRICS = ("cosine", "dot", "euclidean")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, each lower-cased after the split."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def query_terms(query: str) -> list[tuple[str, bool]]:
    """(term, whether it's a prefix): a * that ends a word makes the word's last term a prefix; each once."""
    out: list[tuple[str, bool]] = []
    for word in query.split():
        found = [t.lower() for t in _PY_TERM.findall(word)]
        for i, t in enumerate(found):
            item = (t, word.endswith("*") and i == len(found) - 1)
            if item not in out:
                out.append(item)
    return out


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, term, tf, len for each distinct term of each row whose text is not null."""
    t = df.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), tokens(F.col(column)).alias("terms")).withColumn("len", F.size("terms"))
    return t.select("key", "len", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25(df: DataFrame, key: str, column: str, query: str, limit: int | None = 10, match_all: bool = False, where: P.Pred | None = None) -> DataFrame:
    """df's columns and score, best first and ties by key. Statistics are over all rows; `where` cuts after scoring.

    A prefix stands for all terms that start with it, each with its own frequency. Only the query's terms leave the scan.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    texts = df.where(F.col(column).isNotNull())
    words = tokens(F.col(column))
    n, total = texts.agg(F.count(F.lit(1)), F.sum(F.size(words))).first()
    mean = max((total or 0) / n, 1.0) if n else 1.0

    def hit(t):
        one = [t.startswith(w) if prefix else t == F.lit(w) for w, prefix in terms]
        return one

    def any_of(t):
        out = F.lit(False)
        for c in hit(t):
            out = out | c
        return out

    rows = texts.select(F.col(key).alias("__key"), F.size(words).alias("len"), F.filter(words, any_of).alias("found")).where(F.size("found") > 0)
    post = rows.select("__key", "len", F.explode("found").alias("term")).groupBy("__key", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    asked = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(hit(F.col("term")))]), lambda x: x.isNotNull())
    df_of = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = post.join(df_of, "term").select("__key", F.explode(asked).alias("q"), part.alias("part"))
    score = scored.groupBy("__key").agg(F.sum("part").alias("score"), F.count_distinct("q").alias("nq"))
    if match_all:
        score = score.where(F.col("nq") == len(terms))
    out = df.join(score.select("__key", "score"), F.col(key) == F.col("__key")).drop("__key")
    if where is not None:
        out = out.where(P.compile(where, P.resolver(df), strict=False))
    out = out.orderBy(F.desc("score"), F.col(key))
    return out if limit is None else out.limit(limit)


# ---------------------------------------------------------------- vectors


def unpack(column: str, type: T.DataType, d: int) -> Column:
    """A vector column as an array of doubles; packed bytes are little-endian 32-bit floats."""
    if isinstance(type, T.ArrayType):
        return F.col(column).cast("array<double>")
    if isinstance(type, T.VariantType):
        return F.try_variant_get(F.col(column), "$", "array<double>")
    if not isinstance(type, T.BinaryType):
        raise SchemaMismatch(f"{column!r} holds no vectors")

    @F.pandas_udf("array<double>")
    def floats(raw):
        import numpy as np

        return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(bytes(b), "<f4").astype(float).tolist())

    return floats(F.col(column))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, key: str, column: str, query: list[float], k: int = 10, metric: str = "cosine", where: P.Pred | None = None) -> DataFrame:
    """df's columns and score of the k nearest rows, nearest first and ties by key; rows are cut by `where` before.

    Products are in doubles. Cosine leaves out zero vectors; euclidean ranks the lowest first.
    """
    if not query:
        raise InvalidQuery("the query vector is empty")
    if metric not in METRICS:
        raise InvalidQuery(f"no metric {metric!r}")
    rows = df if where is None else df.where(P.compile(where, P.resolver(df), strict=False))
    v = unpack(column, df.schema[column].dataType, len(query))
    rows = rows.withColumn("__v", v).where(F.col("__v").isNotNull())
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = F.when(F.size("__v") != len(query), F.raise_error(F.lit("a vector has another dimension"))).otherwise(F.col("__v"))
    if metric == "cosine":
        norm = math.sqrt(sum(float(x) * float(x) for x in query))
        if norm == 0:
            return df.withColumn("score", F.lit(0.0)).limit(0)
        score = dot(fits, q) / (F.sqrt(dot(F.col("__v"), F.col("__v"))) * F.lit(norm))
        rows = rows.where(F.exists("__v", lambda x: x != 0))
    elif metric == "dot":
        score = dot(fits, q)
    else:
        score = F.sqrt(F.aggregate(F.zip_with(fits, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    out = rows.withColumn("score", score).drop("__v")
    return out.orderBy(F.col("score").asc() if metric == "euclidean" else F.col("score").desc(), F.col(key)).limit(k)


class Search:
    """Search over a database's tables, by the indexes it was told of."""

    def __init__(self, db):
        self.db = db

    def create_text_index(self, table: str, column: str) -> None:
        f = self.db.table(table).schema.field(column)
        if f.kind != "str" or column == self.db.table(table).pk:
            raise SchemaMismatch("a text index needs a string column other than the key")
        self.db._set(text_indexes=self.db.state.text_indexes | {(table, column)})

    def drop_text_index(self, table: str, column: str) -> None:
        self.db._set(text_indexes=self.db.state.text_indexes - {(table, column)})

    def text(self, table: str, column: str, query: str, **options) -> DataFrame:
        if (table, column) not in self.db.state.text_indexes:
            raise InvalidQuery(f"no text index on {table}.{column}")
        t = self.db.table(table)
        return bm25(t.df, t.pk, column, query, **options)

    def create_vector_index(self, table: str, column: str, metric: str = "cosine", m: int = 16, ef_construction: int = 200) -> None:
        """Registers an index; searches scan exactly, which is within any recall that an index may promise."""
        if metric not in METRICS or not 2 <= m <= 1024 or ef_construction < 1:
            raise InvalidQuery("no such vector index")
        self.db.table(table).schema.field(column)
        rest = tuple(i for i in self.db.state.vector_indexes if i[:2] != (table, column))
        self.db._set(vector_indexes=(*rest, (table, column, metric, m, ef_construction)))

    def drop_vector_index(self, table: str, column: str) -> None:
        self.db._set(vector_indexes=tuple(i for i in self.db.state.vector_indexes if i[:2] != (table, column)))

    def vector_indexes(self) -> list[tuple]:
        return sorted(self.db.state.vector_indexes)

    def vector(self, table: str, column: str, query: list[float], k: int = 10, metric: str = "cosine", exact: bool = True, ef_search: int | None = None, where: P.Pred | None = None) -> DataFrame:
        t = self.db.table(table)
        return nearest(t.df, t.pk, column, query, k, metric, where)
