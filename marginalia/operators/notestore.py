"""Notes and their versions as stored tables: each operation reads and writes the rows of the notes that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import knowledge as kn
from . import notes as ns
from .storage import KeyedTable, persisted, side

VERSION = "note_id long, version_id long, title string, content string, created_at long"


class NoteStore:
    """A note collection below ``path``: ``notes``, keyed by note, and ``versions``, by note and version, so that a new version leaves the older ones where they are.

    Operations are batches with a number within their stream: one that is repeated, or goes on after it failed half way, changes
    nothing twice, since versions are written before the notes that they are made of.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        path = path.rstrip("/")
        self.notes, self.versions = KeyedTable(spark, f"{path}/notes", ["note_id"]), KeyedTable(spark, f"{path}/versions", ["note_id", "version_id"])

    def build(self, notes: DataFrame, versions: DataFrame | None = None) -> NoteStore:
        """``notes(note_id, title, content, folder_id, created_at, updated_at)`` of a new store."""
        self.versions.upsert(self.spark.createDataFrame([], VERSION) if versions is None else versions.select("note_id", "version_id", "title", "content", "created_at"), 0, stream="build")
        self.notes.upsert(notes, 0, stream="build")
        return self

    def _touched(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ids and the notes that are there, both written once."""
        asked = persisted(ids.select("note_id").distinct(), "ids")
        return asked, persisted(self.notes.lookup(asked), "touched")

    def _put(self, changed: DataFrame, number: int, stream: str) -> int:
        return self.notes.upsert(changed, number, stream=stream)

    def create(self, new: DataFrame, now: int, number: int, stream: str = "create") -> int:
        """Add ``new(title, content, folder_id)`` with ids above all there are; the bytes written."""
        top = self.notes.read().agg(F.coalesce(F.max("note_id"), F.lit(0))).first()[0]
        none = self.notes.read().limit(0)
        return self._put(ns.created(none, new, top + 1, now), number, stream)

    def save(self, changes: DataFrame, now: int, number: int, stream: str = "save", keep: int = kn.KEEP_VERSIONS) -> int:
        """``changes(note_id, title, content)``; what the notes were becomes their newest versions. Ids that are not there are ignored."""
        ids = persisted(changes.select("note_id").distinct(), "ids")
        # contents move once, from where they are to the new versions; all else is found out without them
        was = persisted(self.notes.lookup(ids).drop("title", "content"), "touched")
        old = persisted(self.versions.lookup(ids).select("note_id", "version_id", "created_at"), "versions")
        last = old.groupBy("note_id").agg(F.max("version_id").alias("last"), F.count_if(F.col("created_at") > now).alias("later"))
        new = was.select("note_id").join(last, "note_id", "left").where(F.coalesce("later", F.lit(0)) < keep)
        new = persisted(new.select("note_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version_id")), "new")
        place = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("created_at"), F.desc("version_id"))) + F.when(F.col("created_at") > now, 0).otherwise(1)
        gone = old.withColumn("place", place).where(F.col("place") > keep).select("note_id", "version_id")
        shot = self.notes.lookup(ids).select("note_id", "title", "content").join(side(new), "note_id").select("note_id", "version_id", "title", "content", F.lit(now).cast("long").alias("created_at"))
        after = was.join(changes.select("note_id", "title", "content"), "note_id").withColumn("updated_at", F.lit(now).cast("long"))
        return self.versions.upsert(shot, number, new.unionByName(gone), stream, ranged=False) + self.notes.upsert(after, number, was.select("note_id"), stream, ranged=False)

    def restore(self, chosen: DataFrame, now: int, number: int, stream: str = "restore") -> int:
        """Notes as ``chosen(note_id, version_id)`` had them; what they were becomes a version."""
        old = self.versions.lookup(chosen.select("note_id"))
        return self.save(persisted(old.join(chosen, ["note_id", "version_id"]).select("note_id", "title", "content"), "chosen"), now, number, stream)

    def rename(self, names: DataFrame, now: int, number: int, stream: str = "rename") -> int:
        """``names(note_id, title)``."""
        return self._put(ns.renamed(self._touched(names)[1], names, now), number, stream)

    def move(self, places: DataFrame, now: int, number: int, blocked: DataFrame | None = None, stream: str = "move") -> int:
        """``places(note_id, folder_id)``, null for none; neither out of nor into blocked folders."""
        return self._put(ns.moved(self._touched(places)[1], places, now, blocked), number, stream)

    def duplicate(self, ids: DataFrame, now: int, number: int, stream: str = "duplicate") -> int:
        """A copy of each note of ``ids``."""
        own = self._touched(ids)[1]
        return self.create(own.select(F.concat("title", F.lit(" (copy)")).alias("title"), "content", "folder_id"), now, number, stream)

    def delete(self, ids: DataFrame, number: int, stream: str = "delete") -> int:
        """Notes with their versions."""
        asked, _ = self._touched(ids)
        return self.versions.upsert(self.versions.read().limit(0), number, self.versions.lookup(asked), stream) + self.notes.upsert(self.notes.read().limit(0), number, asked, stream)
