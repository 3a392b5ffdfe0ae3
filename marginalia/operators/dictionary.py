"""Titles by their beginning: folded titles in order, of which a prefix reads a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import KeyedTable, persisted


def after_prefix(prefix: str) -> str | None:
    """The least text, in order of UTF-8, that is behind all that begin with a prefix; None if there is none."""
    while prefix:
        code = ord(prefix[-1])
        if code < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if code == 0xD7FF else code + 1)
        prefix = prefix[:-1]
    return None


class TitleDictionary:
    """``titles(folded, note_id, title)`` below ``path``, sorted by the title in lower case, in small row groups.

    Changed notes replace their entries. A search by prefix is a range of ``folded``, so files, row groups and pages
    outside of it are not read.
    """

    ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 15)}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.titles = KeyedTable(spark, f"{path.rstrip('/')}/titles", ["folded", "note_id"], self.ROWS)
        self.state = KeyedTable(spark, f"{path.rstrip('/')}/state", ["note_id"])

    def apply(self, changed: DataFrame, number: int, gone: DataFrame | None = None, stream: str = "titles") -> int:
        """``changed(note_id, title)`` in place of what was known of these notes, without those of ``gone(note_id)``; the bytes written."""
        new = changed.where("title IS NOT NULL").select(F.lower("title").alias("folded"), "note_id", "title")
        new = persisted(new if gone is None else new.join(gone, "note_id", "left_anti"), "titles")
        ids = changed.select("note_id") if gone is None else changed.select("note_id").unionByName(gone.select("note_id"))
        ids = persisted(ids.distinct(), "ids")
        old = self.state.lookup(ids)
        keys = new.select("folded", "note_id")
        keys = keys if old is None else keys.unionByName(old.select("folded", "note_id")).distinct()
        # the titles come from what is known, so that changes last
        return self.titles.upsert(new, number, keys, stream) + self.state.upsert(new, number, ids, stream)

    def starting(self, typed: str) -> DataFrame:
        """``title, note_id`` of the titles that begin with what is typed, in any case; nothing typed: all."""
        low = self.spark.range(1).select(F.lower(F.trim(F.lit(typed)))).first()[0]
        rows = self.titles.between(low, after_prefix(low)) if low else self.titles.read()
        if rows is None:
            raise LookupError("the dictionary was not built")
        return rows.select("title", "note_id")

    def suggestions(self, typed: str, limit: int = 10) -> DataFrame:
        """The first titles, in order."""
        return self.starting(typed).orderBy("title", "note_id").limit(limit)
