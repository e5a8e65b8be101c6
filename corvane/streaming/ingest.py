"""Streamed upserts: each micro-batch of a stream is one committed write to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..database import Database


def upsert_stream(db: Database, table: str, stream: DataFrame, order: str | None = None, **options):
    """Starts a query that upserts a stream's rows into the table; of several for one key in a batch, the last by `order`."""
    pk = db.table(table).pk

    def write(batch: DataFrame, _):
        if order:
            last = Window.partitionBy(pk).orderBy(F.col(order).desc())
            batch = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        else:
            batch = batch.dropDuplicates([pk])
        db.write(lambda tx: tx.table(table).upsert_frame(batch))

    writer = stream.writeStream.foreachBatch(write)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
