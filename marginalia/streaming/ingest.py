"""Structured Streaming: checkpointed ingestion into a keyed table, and the audit log as a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators import knowledge as kn
from marginalia.operators.ingest import embedded, note_chunks
from marginalia.operators.storage import KeyedTable


def ingest_notes(spark: SparkSession, source: str, schema: str, target: KeyedTable, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Notes that arrive as Parquet files: chunked, embedded and upserted by note; ends when all are read.

    A note that has become blank loses its chunks. Batches count by the checkpoint's own id, so one that is repeated
    is skipped, and a new checkpoint on the same table starts anew.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        latest = kn.newest(batch, ["note_id"], [F.desc("updated_at")], keep=1)
        rows = embedded(note_chunks(latest), "text").select("note_id", "chunk_index", "title", "content", "vector")
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        target.upsert(rows, number, latest.select("note_id"), stream_id)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_counts(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Actions by window of a stream ``(ts timestamp, action)``; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "action").agg(F.count("*").alias("n")).select("window.start", "action", "n")


def known_actions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an action of the log's domain, and the others, which are kept apart."""
    every = kn.actions_of(None)
    return log.where(F.col("action").isin(every)), log.where(~F.coalesce(F.col("action").isin(every), F.lit(False)))
