"""Notes with what they embed in place of ``![[title]]``, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.documents import UDFS

from .knowledge import first_by_title
from .storage import persisted

#: Fixed value: levels of embeds within embeds.
DEPTH = 5


def expanded(notes: DataFrame, blocked: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """``note_id, text, faults``: all embeds replaced; those that are missing, locked, circular or too deep stay as ``[kind: title]``.

    Each level is one join of the embeds that are left with the titles, and is written, so that none is made twice; parts carry
    their place as an array, by which a note is put together in the end. ``faults`` counts the stubs.
    """
    def split(rows: DataFrame, found) -> DataFrame:
        parts = rows.select("root", "place", "trail", F.posexplode(found).alias("i", "part"))
        return parts.select("root", F.concat("place", F.array("i")).alias("place"), "trail", F.col("part.kind").alias("kind"), F.col("part.value").alias("value"))

    segments = lambda content: UDFS["embed_segments"](F.coalesce(content, F.lit("")))
    empty = F.array().cast("array<int>")
    todo = persisted(split(notes.select(F.col("note_id").alias("root"), empty.alias("place"), F.array("title").alias("trail"), "content"), segments(F.col("content"))), "parts")

    # whatever is embedded at any level is so by a note, so these are all titles that are looked up
    wanted = persisted(todo.where("kind = 'embed'").select(F.col("value").alias("title")).distinct(), "wanted")
    heads = first_by_title(notes.join(wanted, "title", "left_semi"))
    heads = notes.select(F.col("note_id").alias("target_id"), "content", "folder_id").join(heads, "target_id")
    if blocked is not None:
        heads = heads.join(blocked.withColumn("shut", F.lit(True)), "folder_id", "left")
    else:
        heads = heads.withColumn("shut", F.lit(False))
    heads = persisted(heads.select(F.col("title").alias("value"), "content", F.coalesce("shut", F.lit(False)).alias("shut")), "heads")

    shown = lambda parts: parts.where("kind != 'embed'").select("root", "place", "value", F.when(F.col("kind") == "text", 0).otherwise(1).alias("fault"))
    done = shown(todo)
    stub = lambda kind: F.concat(F.lit(f"[{kind}: "), F.col("value"), F.lit("]"))
    for level in range(depth + 1):
        open_ = todo.where("kind = 'embed'").join(heads, "value", "left")
        fault = F.when(F.array_contains("trail", F.col("value")), stub("circular")).when(F.col("shut").isNull(), stub("missing")).when(F.col("shut"), stub("locked"))
        if level == depth:
            fault = F.coalesce(fault, stub("too deep"))
        judged = open_.withColumn("fault", fault).withColumn("trail", F.concat("trail", F.array("value"))).withColumn("content", F.when(F.col("fault").isNull(), F.col("content")))
        stubs = F.array(F.struct(F.lit("stub").alias("kind"), F.col("fault").alias("value")))
        # stubs and what contents fall into are written at once, the contents themselves not
        todo = persisted(split(judged, F.when(F.col("fault").isNotNull(), stubs).otherwise(segments(F.col("content")))), "parts")
        done = done.unionByName(shown(todo))
    parts = F.array_sort(F.collect_list(F.struct("place", "value")))
    text = done.groupBy(F.col("root").alias("note_id")).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("text"), F.sum("fault").alias("faults"))
    return notes.select("note_id").join(text, "note_id", "left").select("note_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("faults", F.lit(0)).alias("faults"))
