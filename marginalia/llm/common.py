"""Helpers that the training-data operators share: scratch tables and graph components."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: ``spark.checkpoint.dir``; a new temporary one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application's scratch tables, apart from what it stores for good."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marginalia-{spark.sparkContext.applicationId}/scratch"


class _Written(threading.local):
    """Paths of the scratch tables that a thread has written so far, in order: runs in other threads have their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive the loss of any executor. They stay until
    :func:`drop_scratch`, since lazily evaluated results read them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written() -> int:
    """How many scratch tables this thread has written, as a mark for :func:`drop_written`."""
    return len(_written.paths)


def written_since(mark: int) -> list[str]:
    """Paths of the scratch tables written since a mark that are not deleted."""
    return _written.paths[mark:]


def drop_written(spark: SparkSession, since: int) -> None:
    """Delete the scratch tables written from ``since`` on, but for the last: what it was made of is not read again."""
    for path in _written.paths[since:-1]:
        drop_path(spark, path)
    del _written.paths[since:-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them become unusable, stored tables and indexes stay."""
    drop_path(spark, _scratch(spark))


def fold_id(doc_id: Column) -> Column:
    """CRC-32 of an id's decimal text (null: of the empty text), for fixed folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, label)``, label being the smallest node reachable.

    Each round every node is merged into the first of itself and its neighbours, in an order by hash that is
    new in each round, and the edges are carried over to what is left, until there are none. However the nodes
    are numbered, a round leaves a fraction of them, so that rounds grow with the logarithm of a component's
    size and each is smaller than the last. Then the merges are followed back from the last round to the first.
    A round is one pre-aggregated minimum and two joins, written to the shared folder; only whether edges are
    left reaches the driver. Spark splits the skewed keys of its joins.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, merges = persisted(pairs.where("a != b").distinct(), "edges"), []
    while not merges or left.limit(1).count():
        order = lambda c, turn=len(merges): F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("hash"), F.col(c).alias("node"))
        first = left.groupBy("a").agg(F.min(order("b")).alias("first"))
        into = persisted(first.select(F.col("a").alias("node"), F.least("first", order("a"))["node"].alias("into")), "merges")
        ends = [into.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into")) for c in "ab"]
        carried = left.join(ends[0], "a").join(ends[1], "b").select(F.col("a_into").alias("a"), F.col("b_into").alias("b"))
        left = persisted(carried.where("a != b").distinct(), "edges")
        merges.append(into)
    found = merges.pop()
    while merges:
        later = found.select(F.col("node").alias("into"), F.col("into").alias("last"))
        found = persisted(merges.pop().join(later, "into", "left").select("node", F.coalesce("last", "into").alias("into")), "merges")
    return found.join(found.groupBy("into").agg(F.min("node").alias("label")), "into").select("node", "label")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_of_each(keyed: DataFrame, classes: DataFrame, key: str = "_key") -> DataFrame:
    """One row with the smallest id of each component of ``classes(_key, rep, component)``, rep being the smallest id of a key.

    Rows of ``keyed(doc_id, <key>, ...)`` are chosen by id and key, so an id's other rows do not matter. All rows
    of a component without any id stay.
    """
    firsts = classes.groupBy("component").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "_key"))).alias("first"))
    chosen = firsts.where("first IS NOT NULL").select(F.col("first.rep").alias("doc_id"), F.col("first._key").alias(key))
    kept = keyed.join(chosen, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    nameless = classes.join(firsts.where("first IS NULL"), "component", "left_semi").select(F.col("_key").alias(key))
    return kept.select(keyed.columns).unionByName(keyed.where("doc_id IS NULL").join(nameless, key, "left_semi").select(keyed.columns))
