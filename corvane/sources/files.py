"""CSV and JSON-lines import and export, backup and verification."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..database import Database, State, Table
from ..errors import InvalidQuery, SchemaMismatch
from ..schema import TableSchema


def from_json(v):
    """A JSON value with the one-key tags for bytes, timestamps and uuids taken as those."""
    if isinstance(v, dict):
        if len(v) == 1:
            (tag, x), = v.items()
            if tag == "$bytes":
                return bytes.fromhex(x)
            if tag == "$datetime":
                from ..functions.values import parse_timestamp

                return parse_timestamp(x)
            if tag == "$uuid":
                return uuid.UUID(x)
        return {k: from_json(x) for k, x in v.items()}
    return [from_json(x) for x in v] if isinstance(v, list) else v


def _read_field(kind: str, raw: Column) -> Column:
    """A tagged JSON variant as the column's stored value."""
    if kind in ("list", "map"):
        return raw
    if kind == "bytes":
        return F.unhex(F.try_variant_get(raw, "$['$bytes']", "string"))
    if kind == "timestamp":
        return F.to_timestamp_ntz(F.try_variant_get(raw, "$['$datetime']", "string"))
    if kind == "uuid":
        return F.lower(F.coalesce(F.try_variant_get(raw, "$['$uuid']", "string"), F.try_variant_get(raw, "$", "string")))
    return F.try_variant_get(raw, "$", {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}[kind])


def read_jsonl(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """Rows of a JSON-lines file as the table stores them; an absent column takes its default, an explicit null doesn't."""
    v = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    cols = []
    for n in schema.names:
        f = schema.field(n)
        raw = F.try_variant_get("v", f"$.{n}", "variant")
        value = _read_field(f.kind, raw)
        if f.default is not None:
            value = F.when(raw.isNull(), F.lit(f.default)).otherwise(value)
        cols.append(value.cast(schema.spark()[n].dataType).alias(n) if f.kind not in ("list", "map") else value.alias(n))
    return v.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """Rows of a CSV file with a header; an empty cell is absent; a cell that isn't of its column's kind is an error."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')
    for c in raw.columns:
        schema.field(c)
    cols = []
    for n in schema.names:
        f = schema.field(n)
        cell = F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string")
        if f.kind == "bytes":
            value = F.unhex(cell)
        elif f.kind in ("list", "map"):
            value = F.parse_json(cell)
        else:
            value = cell.cast(schema.spark()[n].dataType)
        cols.append((F.coalesce(value, F.lit(f.default)) if f.default is not None else value).alias(n))
    return raw.select(*cols)


def import_frame(table: Table, df: DataFrame, upsert: bool = False) -> int:
    """Inserts or upserts a DataFrame into a table, checked as rows are; the number of rows."""
    s = table.schema
    missing = df.where(F.col(s.pk).isNull())
    if not missing.isEmpty():
        if not s.auto_increment:
            raise SchemaMismatch(f"primary key {s.pk!r} is null")
        first = table.db.state.counters.get(s.name, 1)
        first = max(first, (df.agg(F.max(s.pk)).first()[0] or 0) + 1)
        rows = missing.drop(s.pk).rdd.zipWithIndex().map(lambda x: (x[1] + first, *x[0]))
        n = missing.count()
        numbered = table.db.spark.createDataFrame(rows, T.StructType([s.spark()[s.pk], *[f for f in df.schema if f.name != s.pk]]))
        df = df.where(F.col(s.pk).isNotNull()).unionByName(numbered)
        table.db._set(counters={**table.db.state.counters, s.name: first + n})
    elif s.auto_increment:
        top = df.agg(F.max(s.pk)).first()[0]
        table.db._set(counters={**table.db.state.counters, s.name: max(table.db.state.counters.get(s.name, 1), (top or 0) + 1)})
    from ..storage import settle

    df = settle(df)
    if not upsert:
        from ..errors import DuplicateKey

        if not df.groupBy(s.pk).count().where("count > 1").isEmpty() or not df.join(table.df, s.pk, "left_semi").isEmpty():
            raise DuplicateKey(f"a key of {s.name!r} exists")
    table.upsert_frame(df)
    return df.count()


def import_jsonl(table: Table, path: str, upsert: bool = False) -> int:
    return import_frame(table, read_jsonl(table.db.spark, path, table.schema), upsert)


def import_csv(table: Table, path: str, upsert: bool = False) -> int:
    return import_frame(table, read_csv(table.db.spark, path, table.schema), upsert)


def _written(kind: str, c: Column, csv: bool) -> Column:
    if kind == "bytes":
        return F.lower(F.hex(c)) if csv else F.when(c.isNotNull(), F.struct(F.lower(F.hex(c)).alias("$bytes")))
    if kind == "timestamp":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return text if csv else F.when(c.isNotNull(), F.struct(text.alias("$datetime")))
    if kind == "uuid" and not csv:
        return F.when(c.isNotNull(), F.struct(c.alias("$uuid")))
    return F.to_json(c) if csv and kind in ("list", "map") else c


def export_jsonl(table: Table, path: str) -> int:
    """A folder of JSON-lines files in order of the key, the key first; the number of rows."""
    s = table.schema
    cols = [_written(s.field(n).kind, F.col(f"`{n}`"), False).alias(n) for n in s.names]
    table.df.orderBy(s.pk).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return table.df.count()


def export_csv(table: Table, path: str) -> int:
    s = table.schema
    table.df.orderBy(s.pk).select(*[_written(s.field(n).kind, F.col(f"`{n}`"), True).cast("string").alias(n) for n in s.names]).write.csv(path, header=True, escape='"')
    return table.df.count()


# ---------------------------------------------------------------- backup


def _print(df: DataFrame) -> list:
    """(rows, an order-free sum of row hashes)."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.VariantType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema]
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*plain).cast("decimal(38,0)"))).first()
    return [r[0], str(r[1])]


def backup(db: Database, path: str) -> dict:
    """A consistent copy of one version as Parquet, with a manifest of rows and hashes; returned."""
    s = db.state
    frames = {"nodes": s.nodes, "edges": s.edges, **{f"table/{n}": df for n, (_, df) in s.tables.items()}, **{f"kv/{n}": df for n, df in s.kv.items()}}
    manifest = {"parts": {}, "schemas": {}, "counters": s.counters}
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}")
        manifest["parts"][name] = _print(db.spark.read.parquet(f"{path}/{name}"))
    for n, (schema, _) in s.tables.items():
        manifest["schemas"][n] = schema and [schema.pk, schema.auto_increment, [[f.name, f.kind, f.nullable, f.unique, f.indexed, _plain(f.default)] for f in schema.fields]]
    db.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def _plain(v):
    return {"$datetime": v.isoformat()} if isinstance(v, datetime) else {"$uuid": str(v)} if isinstance(v, uuid.UUID) else {"$bytes": v.hex()} if isinstance(v, bytes) else v


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def verify(spark: SparkSession, path: str) -> None:
    """Reads a backup whole; an error if rows or hashes differ from its manifest."""
    for name, expected in _manifest(spark, path)["parts"].items():
        if _print(spark.read.parquet(f"{path}/{name}")) != expected:
            raise InvalidQuery(f"{name} is damaged")


def restore(spark: SparkSession, path: str) -> Database:
    from ..schema import Field

    m = _manifest(spark, path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    tables = {}
    for n, d in m["schemas"].items():
        schema = d and TableSchema(n, d[0], tuple(Field(*f[:5], from_json(f[5])) for f in d[2]), d[1])
        tables[n] = (schema, read(f"table/{n}"))
    kv = {p[3:]: read(p) for p in m["parts"] if p.startswith("kv/")}
    return Database(spark, State(tables=tables, nodes=read("nodes"), edges=read("edges"), kv=kv, counters=m["counters"]))
