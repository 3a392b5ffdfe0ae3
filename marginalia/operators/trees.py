"""Folder trees as intervals: each folder gets the numbers between which lies all that is below it.

A walk around a tree goes down into each folder and up out of it. Each of these two steps knows the next one from
parents and siblings alone; how far each is from the end of its walk is found by looking twice as far ahead in
each round. So a tree of any depth takes as many rounds as its size has binary digits, each of them one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import persisted, side


def _siblings(rows: DataFrame) -> DataFrame:
    """``id, parent_id, sibling``: the next folder of the same parent, or null.

    Rows are sorted into ranges, so the folders of one parent may be many: each range's last row gets the first of the
    next, from a table of as many rows as there are ranges.
    """
    ordered = rows.repartitionByRange("parent_id", "id").sortWithinPartitions("parent_id", "id")
    ordered = persisted(ordered.select("id", "parent_id", F.spark_partition_id().alias("range")), "siblings")
    firsts = ordered.groupBy("range").agg(F.min(F.struct("parent_id", "id")).alias("first"))
    firsts = firsts.select("range", F.lead("first").over(W.orderBy("range")).alias("then"))
    following = F.coalesce(F.lead(F.struct("parent_id", "id")).over(W.partitionBy("range").orderBy("parent_id", "id")), F.col("then"))
    found = ordered.join(F.broadcast(firsts), "range").withColumn("following", following)
    return found.select("id", "parent_id", F.when(F.col("following.parent_id") == F.col("parent_id"), F.col("following.id")).alias("sibling"))


def labelled(folders: DataFrame) -> DataFrame:
    """``id, root, first, last, depth, cyclic`` of ``folders(id, parent_id)``.

    Of two folders with one root, one is below the other if its ``first`` lies between the other's ``first`` and
    ``last``. A folder whose parent is not there is a root. Folders on a cycle, or below one, are ``cyclic`` and have no
    numbers. There is no bound on the depth.
    """
    known = folders.select("id").withColumnRenamed("id", "parent_id").withColumn("there", F.lit(True))
    rows = folders.select("id", "parent_id").join(side(known), "parent_id", "left").select("id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id"))
    rows = persisted(rows, "folders")
    roots = rows.where("parent_id IS NULL").select("id", "parent_id", F.lit(None).cast(rows.schema["id"].dataType).alias("sibling"))
    placed = persisted(_siblings(rows.where("parent_id IS NOT NULL")).unionByName(roots), "placed")
    children = rows.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.min("id").alias("child"))

    # a step is a folder and whether it leads up out of it; ``left`` steps follow up to the end, ``drop`` is how much deeper these lead
    down = placed.join(side(children), "id", "left").select("id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("next_id"), F.col("child").isNull().alias("next_up"), F.lit(1).alias("drop"))
    above = placed.select("id", F.lit(True).alias("up"), F.coalesce("sibling", "parent_id").alias("next_id"), F.col("sibling").isNull().alias("next_up"), F.lit(-1).alias("drop"))
    steps = down.unionByName(above).withColumn("root", F.when(F.col("next_id").isNull(), F.col("id")))
    steps = persisted(steps.withColumn("left", F.lit(1).cast("long")).withColumn("drop", F.col("drop").cast("long")), "steps")
    span, most = 1, 2 * placed.count()
    while span <= most and not steps.where("next_id IS NOT NULL").isEmpty():
        ahead = steps.select(F.col("id").alias("next_id"), F.col("up").alias("next_up"), F.col("next_id").alias("then_id"), F.col("next_up").alias("then_up"), F.col("left").alias("_left"), F.col("drop").alias("_drop"), F.col("root").alias("_root"))
        met = steps.join(side(ahead), ["next_id", "next_up"], "left")
        add = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        steps = persisted(met.select("id", "up", F.col("then_id").alias("next_id"), F.col("then_up").alias("next_up"), add("drop"), F.coalesce("root", "_root").alias("root"), add("left")), "steps")
        span *= 2
    whole = F.col("next_id").isNull()
    into = steps.where("NOT up").select("id", F.when(whole, F.col("root")).alias("root"), F.col("left").alias("a"), (-F.col("drop")).alias("depth"), (~whole).alias("cyclic"))
    out = steps.where("up").select("id", F.col("left").alias("b"))
    length = into.where("NOT cyclic AND id = root").select("root", F.col("a").alias("length"))
    met = into.join(side(out), "id").join(side(length), "root", "left")
    shown = lambda c: F.when(~F.col("cyclic"), c)
    return met.select("id", "root", shown(F.col("length") - F.col("a")).alias("first"), shown(F.col("length") - F.col("b")).alias("last"), shown(F.col("depth")).cast("int").alias("depth"), "cyclic")


def below(labels: DataFrame, folder: int) -> DataFrame:
    """``id, depth`` of a folder and all below it: those whose number lies within its own."""
    own = labels.where((F.col("id") == folder) & ~F.col("cyclic")).select(F.col("root").alias("_root"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
    found = labels.join(F.broadcast(own), (F.col("root") == F.col("_root")) & (F.col("first") >= F.col("_first")) & (F.col("first") < F.col("_last")))
    return found.select("id", (F.col("depth") - F.col("_depth")).alias("depth"))


def above(labels: DataFrame, folder: int) -> DataFrame:
    """``id, depth`` of a folder and all above it, the root at depth 0."""
    own = labels.where((F.col("id") == folder) & ~F.col("cyclic")).select(F.col("root").alias("_root"), F.col("first").alias("_first"))
    found = labels.join(F.broadcast(own), (F.col("root") == F.col("_root")) & (F.col("first") <= F.col("_first")) & (F.col("last") > F.col("_first")))
    return found.select("id", "depth")


def sizes(labels: DataFrame) -> DataFrame:
    """``id, below``: how many folders are below each."""
    return labels.select("id", ((F.col("last") - F.col("first") - 1) / 2).cast("long").alias("below"))
