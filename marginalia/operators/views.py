"""Tags, links and days of a note collection as stored views that follow its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as tx

from . import knowledge as kn
from .storage import KeyedTable, persisted, side

#: The views' key columns and schemas.
TABLES = {
    "tags": (["tag"], "tag string, n long"),
    "days": (["date"], "date date, created long, modified long"),
    "wanted": (["title", "source_id"], "title string, source_id long"),
    "links": (["source_id", "title"], "source_id long, title string, target_id long"),
    "titles": (["title", "note_id"], "title string, note_id long, updated_at long"),
    "state": (["note_id"], "note_id long, title string, created_at long, updated_at long, tags array<string>, wanted array<string>"),
}


class NoteViews:
    """Views below ``path``: ``tags`` (notes of each tag), ``days`` (notes made and changed on each day), ``links``
    (source, title and target of each link whose title is that of a note), and what they are kept up by: ``wanted``
    (all link titles), ``titles`` and ``state`` (of each note what it brought).

    A batch of changed notes brings signed differences to what is known of them; of each view only the keys that these name
    are read and written. Where a title comes, goes or falls to another note, the links to it are resolved again,
    whoever holds them. Each table depends on none that is written after it in the order of ``TABLES``, or on
    what does not change by repetition, so a batch that failed half way is repeated with its number.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.tables = {name: KeyedTable(spark, f"{path.rstrip('/')}/{name}", key) for name, (key, _) in TABLES.items()}

    def _of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys."""
        found = self.tables[name].lookup(keys)
        return self.spark.createDataFrame([], TABLES[name][1]) if found is None else found

    def read(self, name: str) -> DataFrame:
        found = self.tables[name].read()
        return self.spark.createDataFrame([], TABLES[name][1]) if found is None else found

    def _summed(self, name: str, differences: DataFrame, counts: list[str], number: int, stream: str) -> int:
        """Add signed counts by key; keys without any left go."""
        key = TABLES[name][0][0]
        changed = differences.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])
        changed = persisted(changed.where(" OR ".join(f"{c} != 0" for c in counts)), name)
        before = self._of(name, changed.select(key)).select(key, *[F.col(c).alias(f"_{c}") for c in counts])
        after = changed.join(side(before), key, "left").select(key, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in counts])
        return self.tables[name].upsert(after.where(" OR ".join(f"{c} > 0" for c in counts)), number, changed.select(key), stream)

    def apply(self, changed: DataFrame, number: int, gone: DataFrame | None = None, stream: str = "notes") -> dict[str, int]:
        """The views after ``changed(note_id, title, content, created_at, updated_at)`` came in place of notes with their ids, and those of ``gone(note_id)`` went.

        Of rows with equal ids the one updated last counts; an id in both goes. Returns the bytes written of each view.
        """
        latest = kn.newest(changed, ["note_id"], [F.desc("updated_at"), F.col("title"), F.col("content")], 1)
        if gone is not None:
            latest = latest.join(side(gone.select("note_id")), "note_id", "left_anti")
        content = F.coalesce("content", F.lit(""))
        new = persisted(latest.select("note_id", "title", F.col("created_at").cast("long").alias("created_at"), F.col("updated_at").cast("long").alias("updated_at"), tx.parse_tags(content).alias("tags"), F.array_distinct(tx.parse_wiki_links(content)).alias("wanted")), "new")
        ids = changed.select("note_id") if gone is None else changed.select("note_id").unionByName(gone.select("note_id"))
        ids = persisted(ids.distinct(), "ids")
        old = persisted(self._of("state", ids).select(new.columns), "old")
        signed = new.withColumn("sign", F.lit(1).cast("long")).unionByName(old.withColumn("sign", F.lit(-1).cast("long")))

        wrote = {"tags": self._summed("tags", signed.select(F.explode("tags").alias("tag"), F.col("sign").alias("n")), ["n"], number, stream)}
        wrote["days"] = self._summed("days", signed.select(F.inline(_days("created_at", "updated_at", "sign"))), ["created", "modified"], number, stream)

        pairs = lambda rows: rows.select(F.explode("wanted").alias("title"), F.col("note_id").alias("source_id"))
        mine = persisted(pairs(new).unionByName(pairs(old)).distinct(), "pairs")
        wrote["wanted"] = self.tables["wanted"].upsert(pairs(new), number, mine, stream)

        # titles whose note is another one than before, and those that the changed notes link to
        named = persisted(signed.where("title IS NOT NULL").select("title").unionByName(pairs(new).select("title")).distinct(), "named")
        before = persisted(self._of("titles", named), "titles")
        after = before.join(side(ids), "note_id", "left_anti").select("title", "note_id", "updated_at").unionByName(new.select("title", "note_id", "updated_at"))
        first, then = (kn.first_by_title(rows) for rows in (before, after))
        then = persisted(then, "first")
        moved = named.join(side(first.withColumnRenamed("target_id", "was")), "title", "left").join(side(then), "title", "left").where(~F.col("was").eqNullSafe(F.col("target_id"))).select("title")
        others = self._of("wanted", persisted(moved, "moved")).join(side(ids.withColumnRenamed("note_id", "source_id")), "source_id", "left_anti")
        open_ = persisted(others.select("title", "source_id").unionByName(pairs(new)), "open")
        resolved = open_.join(side(then), "title").where("source_id != target_id").select("source_id", "title", "target_id")
        wrote["links"] = self.tables["links"].upsert(resolved, number, open_.unionByName(mine).distinct(), stream)

        key = lambda rows: rows.where("title IS NOT NULL").select("title", "note_id")
        wrote["titles"] = self.tables["titles"].upsert(new.where("title IS NOT NULL").select("title", "note_id", "updated_at"), number, key(new).unionByName(key(old)).distinct(), stream)
        wrote["state"] = self.tables["state"].upsert(new, number, ids, stream)
        return wrote

    def links(self) -> DataFrame:
        """``source_id, target_id``."""
        return self.read("links").select("source_id", "target_id")

    def heatmap(self, as_of: int, days: int = 365) -> DataFrame:
        """``date, created, modified`` from the day of ``as_of`` less so many days on."""
        return self.read("days").where(F.col("date") >= tx.utc_day(F.lit(as_of - days * 86_400)))


def _days(created: str, updated: str, sign: str) -> Column:
    """What a note counts for: the day it was made and another day on which it was changed."""
    made, changed, none = tx.utc_day(F.col(created)), tx.utc_day(F.col(updated)), F.lit(0).cast("long")
    one = F.struct(made.alias("date"), F.col(sign).alias("created"), none.alias("modified"))
    return F.when(changed != made, F.array(one, F.struct(changed.alias("date"), none.alias("created"), F.col(sign).alias("modified")))).otherwise(F.array(one))
