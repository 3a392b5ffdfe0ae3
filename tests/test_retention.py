import datetime
import random
import time

from marginalia.operators.storage import KeyedTable
from marginalia.streaming import retention

DAY = datetime.timedelta(days=1)


def test_counts_follow_late_rows_and_days_expire(spark, tmp_path):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    table, every = KeyedTable(spark, str(tmp_path / "t"), ["day", "action"]), []
    # rows up to four days late, over three runs of the query on one checkpoint
    files = [[(start + DAY * (4 * k + rng.random() * 4 - 4 * (rng.random() < 0.3)), rng.choice(["chat", "chat", "open", None])) for _ in range(40)] for k in range(5)]
    for k, rows in enumerate(files):
        every += rows
        spark.createDataFrame(rows, "ts timestamp, action string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(1.1)  # files are read in order of their stamps
        if k in (1, 2, 4):
            stream = spark.readStream.schema("ts timestamp, action string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
            retention.keep_counts(spark, stream, 10, table, str(tmp_path / "check")).awaitTermination()
    newest = max(ts for ts, _ in every)
    want = {}
    for ts, action in every:
        day = ts.date()
        if datetime.datetime.combine(day, datetime.time()) + DAY > newest - 10 * DAY:
            want[day, action or ""] = want.get((day, action or ""), 0) + 1
    got = {(r.day, r.action): r.n for r in table.read().collect()}
    assert got == want and len({d for d, _ in got}) < len({ts.date() for ts, _ in every})
    # nothing new: a further run changes nothing
    version = table.state().version
    retention.keep_counts(spark, spark.readStream.schema("ts timestamp, action string").parquet(str(tmp_path / "in/*")), 10, table, str(tmp_path / "check")).awaitTermination()
    assert {(r.day, r.action): r.n for r in table.read().collect()} == want and table.state().version >= version
