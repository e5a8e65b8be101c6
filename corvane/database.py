"""A database of tables, a graph and key-value tables: immutable snapshots of DataFrames, swapped on commit."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConstraintViolation, DuplicateKey, InvalidQuery, NotFound, SchemaMismatch, TableNotFound, TransactionAborted
from .functions.values import to_column_value
from .plans import predicates as P
from .plans.query import Query
from .schema import TableSchema, check_name
from .storage import settle

NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("properties", T.VariantType())])
EDGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("type", T.StringType()), T.StructField("dst", T.LongType()), T.StructField("properties", T.VariantType())])
KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
#: Writes to one DataFrame after which it is settled, so that plans stay short.
SETTLE_AFTER = 6


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Driver values as a DataFrame; variants come as JSON text."""
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VariantType) else f.dataType) for f in schema])
    df = spark.createDataFrame(rows, plain)
    return df.select(*[F.parse_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`") for f in schema])


@dataclass(frozen=True)
class State:
    """One version of everything."""

    tables: dict[str, tuple[TableSchema | None, DataFrame]] = field(default_factory=dict)
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    kv: dict[str, DataFrame] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    text_indexes: frozenset = frozenset()
    vector_indexes: tuple = ()
    writes: dict[str, int] = field(default_factory=dict)


class Database:
    """Reads and writes the latest version; begin() stages several writes, snapshot() keeps one version."""

    def __init__(self, spark: SparkSession, state: State | None = None):
        self.spark = spark
        self.state = state or State(nodes=local_rows(spark, [], NODE), edges=local_rows(spark, [], EDGE))
        self._open = False

    # ------------------------------------------------------------ versions

    def snapshot(self) -> Database:
        """A database that stays at this version."""
        return type(self)(self.spark, self.state)

    @contextmanager
    def begin(self):
        """A transaction: its writes are seen by itself, and by others when the block ends well. An operation that fails
        aborts it, so that it can't commit even if the caller catches the error."""
        if self._open:
            raise InvalidQuery("a transaction is open")
        self._open = True
        tx = Transaction(self.spark, self.state)
        try:
            yield tx
            if tx.aborted:
                raise TransactionAborted("an operation in the transaction failed")
            self.state = tx.state
        finally:
            self._open = False

    def write(self, fn: Callable):
        with self.begin() as tx:
            return fn(tx)

    def _set(self, **changes) -> None:
        if self._open:
            raise InvalidQuery("a transaction is open")
        self.state = replace(self.state, **changes)

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        """df, settled after several writes to what name stands for."""
        n = self.state.writes.get(name, 0) + 1
        if n >= SETTLE_AFTER:
            df, n = settle(df), 0
        self._set(writes={**self.state.writes, name: n})
        return df

    # ------------------------------------------------------------ tables

    def register(self, name: str, df: DataFrame, pk: str | None = None) -> Table:
        """A read-only table over any DataFrame."""
        self._set(tables={**self.state.tables, name: (None, df if pk is None else df.select(pk, *[c for c in df.columns if c != pk]))}, counters={**self.state.counters, f"pk:{name}": pk})
        return Table(self, name)

    def tables(self) -> list[str]:
        return sorted(self.state.tables)

    def table(self, name: str | TableSchema) -> Table:
        key = name if isinstance(name, str) else name.name
        if key not in self.state.tables:
            raise TableNotFound(f"no table {key!r}")
        if isinstance(name, TableSchema) and self.state.tables[key][0] != name:
            raise SchemaMismatch(f"table {key!r} is defined otherwise")
        return Table(self, key)

    def create_table(self, schema: TableSchema) -> bool:
        old = self.state.tables.get(schema.name)
        if old:
            if old[0] == schema:
                return False
            raise SchemaMismatch(f"table {schema.name!r} is defined otherwise")
        self._set(tables={**self.state.tables, schema.name: (schema, local_rows(self.spark, [], schema.spark()))})
        return True

    def ensure_table(self, schema: TableSchema) -> Table:
        """Creates the table, or migrates it: columns come and go, new ones with their default, and all is checked again."""
        old = self.state.tables.get(schema.name)
        if not old:
            self.create_table(schema)
            return Table(self, schema.name)
        was, df = old
        if was.pk != schema.pk or was.auto_increment != schema.auto_increment:
            raise SchemaMismatch("the primary key can't change")
        for f in schema.fields:
            before = next((x for x in was.fields if x.name == f.name), None)
            if before and before.kind != f.kind:
                raise SchemaMismatch(f"column {f.name!r} can't change its kind")
            if not before:
                value = local_rows(self.spark, [(to_column_value(f.default, f.kind),)], T.StructType([schema.spark()[f.name]]))
                df = df.crossJoin(F.broadcast(value)) if f.default is not None else df.withColumn(f.name, F.lit(None).cast(schema.spark()[f.name].dataType))
        df = df.select(*schema.names)
        self._check(schema, df)
        self._set(tables={**self.state.tables, schema.name: (schema, self._store(schema.name, df))})
        return Table(self, schema.name)

    def drop_table(self, name: str) -> None:
        self.table(name)
        self._set(tables={k: v for k, v in self.state.tables.items() if k != name}, counters={k: v for k, v in self.state.counters.items() if k != name}, text_indexes=frozenset(i for i in self.state.text_indexes if i[0] != name), vector_indexes=tuple(i for i in self.state.vector_indexes if i[0] != name))

    @staticmethod
    def _check(schema: TableSchema, df: DataFrame) -> None:
        for f in schema.fields:
            if not f.nullable and not df.where(F.col(f.name).isNull()).isEmpty():
                raise ConstraintViolation(f"column {f.name!r} may not be null")
            if f.unique and not df.where(F.col(f.name).isNotNull()).groupBy(f.name).count().where("count > 1").isEmpty():
                raise ConstraintViolation(f"column {f.name!r} must be unique")

    def sql(self, text: str, params=None):
        from .plans.sql import execute

        return execute(self, text, params)

    def match(self, text: str, params=None) -> DataFrame:
        from .plans.match import run

        return run(self.state.nodes, self.state.edges, text, params)

    # ------------------------------------------------------------ graph

    @property
    def graph(self):
        from .operators.graph import Graph

        return Graph(self.state.nodes, self.state.edges)

    def use_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """A graph from any DataFrames: nodes (id, label, properties), edges (id, src, type, dst, properties)."""
        self._set(nodes=nodes, edges=edges)

    def _ids(self, what: str, n: int) -> range:
        first = self.state.counters.get(what, 1)
        self._set(counters={**self.state.counters, what: first + n})
        return range(first, first + n)

    def create_nodes(self, items: Iterable[tuple[str, dict]]) -> list[int]:
        items = list(items)
        ids = self._ids("node", len(items))
        rows = [(i, label, to_column_value(props, "map")) for i, (label, props) in zip(ids, items)]
        self._set(nodes=self._store("nodes", self.state.nodes.unionByName(local_rows(self.spark, rows, NODE))))
        return list(ids)

    def create_node(self, label: str, properties: dict | None = None) -> int:
        return self.create_nodes([(label, properties or {})])[0]

    def create_edges(self, items: Iterable[tuple[int, int, str, dict]]) -> list[int]:
        items = list(items)
        ends = {e for a, b, *_ in items for e in (a, b)}
        have = {r[0] for r in self.state.nodes.where(F.col("id").isin(list(ends))).select("id").collect()}
        if ends - have:
            raise NotFound(f"no node {min(ends - have)}")
        ids = self._ids("edge", len(items))
        rows = [(i, a, t, b, to_column_value(props, "map")) for i, (a, b, t, props) in zip(ids, items)]
        self._set(edges=self._store("edges", self.state.edges.unionByName(local_rows(self.spark, rows, EDGE))))
        return list(ids)

    def create_edge(self, src: int, dst: int, type: str, properties: dict | None = None) -> int:
        return self.create_edges([(src, dst, type, properties or {})])[0]

    def _update(self, which: str, id: int, properties: dict) -> None:
        df = getattr(self.state, which)
        if df.where(F.col("id") == id).isEmpty():
            raise NotFound(f"no {which[:-1]} {id}")
        new = F.parse_json(F.lit(to_column_value(properties, "map")))
        self._set(**{which: self._store(which, df.withColumn("properties", F.when(F.col("id") == id, new).otherwise(F.col("properties"))))})

    def update_node(self, id: int, properties: dict) -> None:
        self._update("nodes", id, properties)

    def update_edge(self, id: int, properties: dict) -> None:
        self._update("edges", id, properties)

    def delete_nodes(self, ids: list[int]) -> None:
        gone = F.col("src").isin(ids) | F.col("dst").isin(ids)
        self._set(nodes=self._store("nodes", self.state.nodes.where(~F.col("id").isin(ids))), edges=self._store("edges", self.state.edges.where(~gone)))

    def delete_node(self, id: int) -> None:
        """The node with its edges of either direction."""
        if self.state.nodes.where(F.col("id") == id).isEmpty():
            raise NotFound(f"no node {id}")
        self.delete_nodes([id])

    def delete_edge(self, id: int) -> None:
        if self.state.edges.where(F.col("id") == id).isEmpty():
            raise NotFound(f"no edge {id}")
        self._set(edges=self._store("edges", self.state.edges.where(F.col("id") != id)))

    def cascade_delete(self, root: int, type: str) -> list[int]:
        """Deletes root and all that out-edges of the type reach from it; their ids in breadth-first order."""
        if self.state.nodes.where(F.col("id") == root).isEmpty():
            raise NotFound(f"no node {root}")
        reached = self.graph.bfs(root, types=[type], max_depth=None)
        order = [r[0] for r in reached.orderBy("depth", "rank").select("id").collect()]
        gone = F.broadcast(reached.select("id")) if len(order) < 100_000 else reached.select("id")
        nodes = self.state.nodes.join(gone, "id", "left_anti")
        edges = self.state.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*self.state.edges.columns)
        self._set(nodes=settle(nodes), edges=settle(edges))
        return order

    def sync(self, nodes=(), edges=(), rows: dict[str, list[dict]] | None = None) -> dict:
        """One batch: nodes (label, properties), edges (src, dst, type, properties) whose ends are ids or New(i) of this
        batch's nodes, and rows to upsert by table; all or nothing."""
        with self.begin() as tx:
            ids = tx.create_nodes(nodes)
            end = lambda e: ids[e.index] if isinstance(e, New) else e
            made = tx.create_edges([(end(a), end(b), t, p) for a, b, t, p in edges])
            keys = {name: tx.table(name).upsert(each) for name, each in (rows or {}).items()}
        return {"nodes": ids, "edges": made, "rows": keys}

    # ------------------------------------------------------------ key-value

    def put(self, table: str, key: bytes, value: bytes) -> None:
        check_name(table)
        old = self.state.kv.get(table, local_rows(self.spark, [], KV))
        new = old.where(F.col("key") != F.lit(key)).unionByName(local_rows(self.spark, [(key, value)], KV))
        self._set(kv={**self.state.kv, table: self._store(f"kv:{table}", new)})

    def delete_key(self, table: str, key: bytes) -> None:
        check_name(table)
        if table in self.state.kv:
            self._set(kv={**self.state.kv, table: self._store(f"kv:{table}", self.state.kv[table].where(F.col("key") != F.lit(key)))})

    def get(self, table: str, key: bytes) -> bytes | None:
        check_name(table)
        r = self.state.kv[table].where(F.col("key") == F.lit(key)).first() if table in self.state.kv else None
        return r and bytes(r["value"])

    def range(self, table: str, start: bytes | None = None, end: bytes | None = None, include_end: bool = False) -> DataFrame:
        """Keys from start up to end in ascending order; the end itself if it's included."""
        check_name(table)
        df = self.state.kv.get(table, local_rows(self.spark, [], KV))
        if start is not None:
            df = df.where(F.col("key") >= F.lit(start))
        if end is not None:
            df = df.where(F.col("key") <= F.lit(end) if include_end else F.col("key") < F.lit(end))
        return df.orderBy("key")

    # ------------------------------------------------------------ upkeep

    def stats(self) -> DataFrame:
        """name, n: nodes, edges, then tables by name."""
        frames = [("(nodes)", self.state.nodes), ("(edges)", self.state.edges), *((n, self.state.tables[n][1]) for n in self.tables())]
        counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in frames]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def compact(self) -> None:
        """Rewrites every table without the history of its writes."""
        self._set(nodes=settle(self.state.nodes), edges=settle(self.state.edges), tables={n: (s, settle(df)) for n, (s, df) in self.state.tables.items()}, kv={n: settle(df) for n, df in self.state.kv.items()}, writes={})

    def node_rows(self):
        from .operators.hybrid import Hybrid

        return Hybrid(self)

    hybrid = property(node_rows)

    @property
    def search(self):
        from .operators.search import Search

        return Search(self)


@dataclass(frozen=True)
class New:
    """The i-th node of the same sync batch."""

    index: int


class Transaction(Database):
    """Staged writes of begin()."""

    def __init__(self, spark, state):
        super().__init__(spark, state)
        self.aborted = False

    def __getattribute__(self, name: str):
        got = super().__getattribute__(name)
        if name in _GUARDED:
            return _guard(self, got)
        return got


_GUARDED = frozenset("sql match create_table ensure_table drop_table create_nodes create_node create_edges create_edge update_node update_edge delete_node delete_nodes delete_edge cascade_delete put delete_key table".split())


def _guard(tx: Transaction, fn: Callable) -> Callable:
    def call(*args, **options):
        if tx.aborted:
            raise TransactionAborted("an operation in the transaction failed")
        try:
            return fn(*args, **options)
        except Exception:
            tx.aborted = True
            raise

    return call


class Table:
    """A handle on a table of the database's current version."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    @property
    def schema(self) -> TableSchema:
        s = self.db.state.tables[self.name][0]
        if s is None:
            raise SchemaMismatch(f"table {self.name!r} is read-only")
        return s

    @property
    def pk(self) -> str | None:
        s = self.db.state.tables[self.name][0]
        return s.pk if s else self.db.state.counters.get(f"pk:{self.name}")

    @property
    def df(self) -> DataFrame:
        return self.db.state.tables[self.name][1]

    def select(self) -> Query:
        s = self.db.state.tables[self.name][0]
        return Query(self.df, self.pk, {f.name: f.kind for f in s.fields} if s else {})

    def get(self, key: Any):
        """The row of a key, or None."""
        return self.select().filter(P.Cmp(self.pk, "=", key)).rows().first()

    def iter_rows(self, page: int = 1000):
        """Rows in pages by key: each page reads the latest version."""
        last = None
        while True:
            q = self.select().order_by(self.pk).limit(page)
            rows = (q if last is None else q.filter(P.Cmp(self.pk, ">", last))).rows().collect()
            yield from rows
            if len(rows) < page:
                return
            last = rows[-1][self.pk]

    def select_df(self, pred: P.Pred | None = None):
        """A pandas frame indexed by the primary key."""
        q = self.select()
        return (q.filter(pred) if pred is not None else q).order_by(self.pk).rows().toPandas().set_index(self.pk)

    # ------------------------------------------------------------ writes

    def _put(self, df: DataFrame) -> None:
        df = self.db._store(self.name, df.select(*self.schema.names))
        self.db._set(tables={**self.db.state.tables, self.name: (self.schema, df)})

    def _frame(self, rows: list[dict]) -> DataFrame:
        s = self.schema
        return local_rows(self.db.spark, [tuple(to_column_value(r[n], s.field(n).kind) for n in s.names) for r in rows], s.spark())

    def _keyed(self, rows: Iterable[dict]) -> list[dict]:
        """Complete rows; absent keys count up from beyond all that were given."""
        s, out = self.schema, []
        next_key = self.db.state.counters.get(self.name, 1)
        for r in rows:
            r = s.complete(dict(r))
            if r[s.pk] is None:
                r[s.pk] = next_key
            if s.auto_increment:
                next_key = max(next_key, r[s.pk] + 1)
            out.append(r)
        if s.auto_increment:
            self.db._set(counters={**self.db.state.counters, self.name: next_key})
        return out

    def _unique(self, after: DataFrame, columns: Iterable[str] | None = None) -> None:
        s = self.schema
        for f in s.fields:
            if f.unique and (columns is None or f.name in columns) and not after.where(F.col(f.name).isNotNull()).groupBy(f.name).count().where("count > 1").isEmpty():
                raise ConstraintViolation(f"column {f.name!r} must be unique")

    def insert(self, rows: dict | Iterable[dict]) -> list:
        rows = self._keyed([rows] if isinstance(rows, dict) else rows)
        keys = [r[self.pk] for r in rows]
        new = self._frame(rows)
        if len(set(keys)) < len(keys) or not new.join(self.df, self.pk, "left_semi").isEmpty():
            raise DuplicateKey(f"a key of {self.name!r} exists")
        after = self.df.unionByName(new)
        self._unique(after)
        self._put(after)
        return keys

    def insert_with_pk(self, key: Any, row: dict) -> list:
        if self.schema.auto_increment:
            raise InvalidQuery(f"table {self.name!r} counts its own keys")
        return self.insert({**row, self.pk: key})

    def upsert(self, rows: dict | Iterable[dict]) -> list:
        """Whole rows replace those of their keys; of several for one key the last counts."""
        rows = self._keyed([rows] if isinstance(rows, dict) else rows)
        new = self._frame(list({r[self.pk]: r for r in rows}.values()))
        after = self.df.join(new, self.pk, "left_anti").unionByName(new)
        self._unique(after)
        self._put(after)
        return [r[self.pk] for r in rows]

    def upsert_frame(self, new: DataFrame) -> None:
        """Rows of a DataFrame that has the table's columns; keys must be unique in it."""
        new = new.select(*[F.col(n).cast(self.schema.spark()[n].dataType) for n in self.schema.names])
        after = self.df.join(new, self.pk, "left_anti").unionByName(new)
        self._unique(after)
        Database._check(self.schema, new)
        self._put(after)

    def update(self, values: dict, pred: P.Pred | None = None, order=(), limit: int | None = None) -> int:
        """Sets columns of the matching rows to literals; the number of rows."""
        s = self.schema
        if s.pk in values:
            raise InvalidQuery("the primary key can't be updated")
        for name, v in values.items():
            f = s.field(name)
            s.complete({**{x.name: x.default for x in s.fields if x.default is not None}, **{x.name: _some(x.kind) for x in s.fields if not x.nullable or x.name == s.pk}, name: v})
            if v is None and not f.nullable:
                raise ConstraintViolation(f"column {name!r} may not be null")
        hit, n = self._hit(pred, order, limit)
        base = hit
        for name, v in values.items():
            f = s.field(name)
            new = F.lit(to_column_value(v, f.kind))
            new = F.parse_json(new) if f.kind in ("list", "map") and v is not None else new
            base = base.withColumn(name, F.when(F.col("__hit"), new.cast(s.spark()[name].dataType) if f.kind not in ("list", "map") else new).otherwise(F.col(name)))
        after = base.drop("__hit")
        self._unique(after, values)
        self._put(after)
        return n

    def delete(self, pred: P.Pred | None = None, order=(), limit: int | None = None) -> int:
        hit, n = self._hit(pred, order, limit)
        self._put(hit.where(~F.col("__hit")).drop("__hit"))
        return n

    def _hit(self, pred, order, limit) -> tuple[DataFrame, int]:
        """The table with __hit, and the number of rows hit."""
        q = self.select()
        if pred is not None:
            q = q.filter(pred)
        if limit is None and not order:
            flag = F.lit(True) if q.pred is None else P.compile(q.pred, q.resolve)
            return self.df.withColumn("__hit", flag), q.count()
        for path, desc in order:
            q = q.order_by_desc(path) if desc else q.order_by(path)
        keys = q.limit(limit).rows().select(F.col(self.pk).alias("__k"))
        return self.df.join(keys, F.col(self.pk) == F.col("__k"), "left").withColumn("__hit", F.col("__k").isNotNull()).drop("__k"), keys.count()


def _some(kind: str):
    """Any value of a kind."""
    import uuid
    from datetime import datetime

    return {"bool": True, "int": 1, "float": 1.0, "str": "", "bytes": b"", "timestamp": datetime(2000, 1, 1), "uuid": uuid.UUID(int=0), "list": [], "map": {}}[kind]
