"""Micro-batches: each is appended whole or not at all, and what is current is a grouped query over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import merge
from larder.operators.temporal import first_wins
from larder.sources.tables import BatchTables


def append_batches(stream: DataFrame, tables: BatchTables, split: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append what `split` makes of each micro-batch to its tables, all of them or none. A batch is known by the streaming query, whose id is kept in the checkpoint, and its number: one that is replayed is not taken twice, one of another query is."""

    def run(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = (query_id or hashlib.sha256(checkpoint.encode()).hexdigest()).replace("-", "")[:16]
        tables.append(split(batch), own, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_rows(rows: DataFrame, keys: list[str], observed: str | None, seq: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """What out-of-order observations, appended batch by batch, have made of each key: the fold of `merge.upsert` over all batches in the order of their commits. Rows older than what was known are without effect, however late they came."""
    columns = list(dict.fromkeys([*keys, *overwrite, *fill, *([observed] if observed else [])]))
    placed = rows.select(*columns, F.struct("batch_order", F.col(seq)).alias("_seq"))
    return merge.upsert(placed.limit(0), placed, keys, observed, "_seq", overwrite, fill).withColumn(seq, F.col(f"_seq.{seq}")).drop("_seq")


def first_documents(rows: DataFrame, checksum: str = "checksum", order: str = "path") -> DataFrame:
    """Effectively once: of documents with one checksum the one that was committed first, however often it came again."""
    return first_wins(rows, [checksum], [F.col("batch_order"), F.col(order)])


def snapshot_step(person: str, scope: list[str], identity: list[str], payload: list[str]):
    """Authoritative lists: a stale one changes nothing."""

    def step(table: DataFrame | None, batch: DataFrame) -> DataFrame:
        if table is None:
            table = batch.limit(0).withColumn("discontinued_at", F.lit(None).cast("timestamp"))
        return merge.reconcile_snapshot(table, batch, person, scope, identity, payload)

    return step


def event_windows(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts in tumbling or sliding windows with a watermark; works on batches and streams alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(F.count("*").alias("n"))


def next_state(status, succeeded, failed):
    """pending or failed becomes extracted, failed or skipped; what is extracted or skipped stays."""
    return F.when(status.isin("extracted", "skipped"), status).when(failed & ~succeeded, "failed").when(succeeded, "extracted").otherwise("skipped")


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)
