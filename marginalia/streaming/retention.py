"""The audit log's daily counts as a stream: late rows correct them, and days beyond the retention go."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.functions import text as tx
from marginalia.operators.storage import KeyedTable

COUNTS = "day date, action string, n long, expired boolean"


def _by_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of each batch, so that a common action is one row for each batch when it is shuffled."""
    for rows in batches:
        yield rows.groupby(["day", "action"], dropna=False, as_index=False).agg(ts=("ts", "max"), n=("ts", "size"))[["ts", "day", "action", "n"]]


def _counted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    day, action = key
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"day": [day], "action": [action], "n": [0], "expired": [True]})
        return
    n = (state.get[0] if state.exists else 0) + sum(int(f["n"].sum()) for f in frames)
    state.update((n,))
    end = datetime.datetime.combine(day, datetime.time(), datetime.UTC) + datetime.timedelta(days=1)
    # a day is over for good when all of it is older than the retention
    state.setTimeoutTimestamp(int(end.timestamp() * 1000))
    yield pd.DataFrame({"day": [day], "action": [action], "n": [n], "expired": [False]})


def daily_counts(stream: DataFrame, days: int) -> DataFrame:
    """``day, action, n, expired`` of a stream ``(ts timestamp, action)``: a day's count whenever it changes, and a last row when it goes.

    The watermark is ``days`` behind the newest row: rows that are later than the retention are left out, all others are
    counted, however late they are; a timer drops a day's state once all of the day, by UTC, lies before the watermark.
    """
    partial = stream.select("ts", tx.utc_day(F.unix_seconds("ts")).alias("day"), "action").mapInPandas(_by_batch, "ts timestamp, day date, action string, n long")
    grouped = partial.withWatermark("ts", f"{days} days").groupBy("day", "action")
    return grouped.applyInPandasWithState(_counted, COUNTS, "n long", "update", GroupStateTimeout.EventTimeTimeout)


def keep_counts(spark: SparkSession, stream: DataFrame, days: int, target: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Daily counts kept in ``target``, a table ``(day, action, n)`` keyed by day and action; ends when all that is there is read.

    Batches count by the checkpoint's own id, so one that is repeated after a failure is skipped.
    """

    def store(batch: DataFrame, number: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        rows = batch.select("day", F.coalesce("action", F.lit("")).alias("action"), "n", "expired").persist()
        target.upsert(rows.where("NOT expired").drop("expired"), number, rows.select("day", "action"), stream_id)
        rows.unpersist()

    out = daily_counts(stream, days).writeStream.foreachBatch(store).outputMode("update")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
