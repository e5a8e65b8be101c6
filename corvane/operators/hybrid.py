"""Joins between the graph and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaMismatch
from ..functions.values import kind_of_type
from ..plans.query import Query


def nodes_with_rows(ids: DataFrame, nodes: DataFrame, table: DataFrame, pk: str) -> DataFrame:
    """pos, node, row for each row of ids (pos, id): the node of that id and the table's row of that key, or null."""
    if kind_of_type(table.schema[pk].dataType) != "int":
        raise SchemaMismatch("the table's key must be a whole number")
    n = nodes.select(F.col("id").alias("__n"), F.struct("id", "label", "properties").alias("node"))
    r = table.select(F.col(pk).cast("long").alias("__r"), F.struct("*").alias("row"))
    return ids.join(n, F.col("id") == F.col("__n"), "left").join(r, F.col("id") == F.col("__r"), "left").select("pos", "id", "node", "row")


def nodes_with_groups(ids: DataFrame, nodes: DataFrame, table: DataFrame, fk: str, pk: str) -> DataFrame:
    """pos, node, rows for each row of ids: all table rows whose fk is the id, in order of their key; perhaps none."""
    if kind_of_type(table.schema[fk].dataType) != "int":
        raise SchemaMismatch("the joining column must hold whole numbers")
    n = nodes.select(F.col("id").alias("__n"), F.struct("id", "label", "properties").alias("node"))
    wanted = ids.select(F.col("id").alias("__w")).distinct()
    rest = [c for c in table.columns if c != pk]
    groups = table.join(wanted, F.col(fk) == F.col("__w"), "left_semi").groupBy(F.col(fk).cast("long").alias("__f")).agg(F.sort_array(F.collect_list(F.struct(pk, *rest))).alias("rows"))
    out = ids.join(n, F.col("id") == F.col("__n"), "left").join(groups, F.col("id") == F.col("__f"), "left")
    return out.select("pos", "id", "node", F.coalesce("rows", F.array().cast(groups.schema["rows"].dataType)).alias("rows"))


def rows_with_nodes(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """rows with the node whose id is in the column; null where that is null, negative or no whole number."""
    node = nodes.select(F.col("id").alias("__n"), F.struct("id", "label", "properties").alias("node"))
    if kind_of_type(rows.schema[column].dataType) != "int":
        return rows.withColumn("node", F.lit(None).cast(node.schema["node"].dataType))
    return rows.join(node, (F.col(column) == F.col("__n")) & (F.col(column) >= 0), "left").drop("__n")


def query_rows_with_nodes(q: Query, nodes: DataFrame, column: str) -> DataFrame:
    return rows_with_nodes(q.rows(), nodes, column)


class Hybrid:
    def __init__(self, db):
        self.db = db

    def _ids(self, ids) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids
        return self.db.spark.createDataFrame(list(enumerate(ids)), "pos long, id long")

    def join_nodes_with_table(self, ids, table: str) -> DataFrame:
        t = self.db.table(table)
        return nodes_with_rows(self._ids(ids), self.db.state.nodes, t.df, t.pk).orderBy("pos")

    def join_nodes_by_column(self, ids, table: str, fk: str) -> DataFrame:
        t = self.db.table(table)
        return nodes_with_groups(self._ids(ids), self.db.state.nodes, t.df, fk, t.pk).orderBy("pos")

    def join_rows_with_nodes(self, rows: DataFrame, column: str) -> DataFrame:
        return rows_with_nodes(rows, self.db.state.nodes, column)

    def query_rows_with_nodes(self, q: Query, column: str) -> DataFrame:
        return query_rows_with_nodes(q, self.db.state.nodes, column)
