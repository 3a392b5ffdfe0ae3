"""Folders that all nodes share, and keyed tables in them that change by batches and are merged when they are read."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table for each core below which it may have fewer splits than there are cores.
THIN = 32 << 20
#: Bytes of one side of a join up to which it may pass through the driver to all tasks.
SENT = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new temporary folder only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use, below a folder of this application."""
    return f"{shared_dir(spark)}/marginalia-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark can reach; of one that is not there: none."""
    where, store = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def put_mark(spark: SparkSession, path: str) -> None:
    """An empty file, which is there at once or not at all."""
    where, store = _at(spark, path)
    store.create(where).close()


def drop(spark: SparkSession, path: str) -> None:
    where, store = _at(spark, path)
    store.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; of one that is not there: none."""
    where, store = _at(spark, path)
    return store.getContentSummary(where).getLength() if store.exists(where) else 0


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless there is one of that name: of all who try at once, one gets True.

    The text goes to a file of its own, which then gets the name: by a rename, which stores refuse where the name is
    taken, or by a link in a local folder, whose renames replace.
    """
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    where, store = _at(spark, aside)
    target, _ = _at(spark, path)
    out = store.create(where)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getScheme() == "file":
            nio = spark.sparkContext._jvm.java.nio.file
            own, new = (nio.Path.of(x.toUri().getPath(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0)) for x in (where, target))
            try:
                nio.Files.createLink(new, own)
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                return False
            return True
        return not store.exists(target) and store.rename(where, target)
    finally:
        if store.exists(where):
            store.delete(where, False)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, store = _at(spark, path)
    stream = store.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def persisted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage with files that outlive executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size(df: DataFrame) -> int:
    """Bytes of a table as Spark estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it is too small to be read by all of them; for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < cores * THIN else df


def side(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join whose sides grow with the tables: unless it is small both are dealt by key, and none passes through the driver."""
    return df.hint("merge") if _size(df) > SENT else df


class Conflict(Exception):
    """Another writer's batch became part of a table first."""


@dataclass(frozen=True)
class Segment:
    """What one batch, or several that were merged, brought: rows, and the keys that these replace."""

    name: str
    rows: int
    bytes: int
    #: Whether there are keys to look for in older segments.
    keys: bool
    #: The stream of a batch; none of segments that were merged.
    stream: str = ""


@dataclass(frozen=True)
class State:
    """A table as of a version: its segments from the oldest on, the last number of each stream, and the rows' schema."""

    version: int = -1
    segments: tuple[Segment, ...] = ()
    done: dict[str, int] = field(default_factory=dict)
    schema: str = ""


class KeyedTable:
    """A Parquet table in which a batch replaces all rows of its keys, merged when it is read.

    A batch writes its own rows and keys and nothing else, however large the table is. Readers take of each key the
    rows of the newest segment that has it: one join of the rows with the keys of all segments but the oldest, which
    are few beside the rows. Segments of like size that follow each other are merged, ``FANOUT`` at a time, so a row
    is written anew about as often as the table grew by that factor; where the oldest is among them, deleted keys are
    forgotten. A version is one small file, which is there once: of two writers with the same version in mind one gets
    :class:`Conflict`, and its batch is not part of the table. Versions know each stream's last number, so a
    batch that is repeated is skipped. Rows lie in ``order``, by which they are looked up; that is their key unless given.
    """

    #: Segments of like size that are merged, bytes below which sizes are alike, versions whose segments are kept for readers, and keys that a lookup names one by one.
    FANOUT, UNIT, VERSIONS, NAMED = 4, 1 << 20, 3, 256

    def __init__(self, spark: SparkSession, path: str, key: list[str], options: dict[str, str] | None = None, order: list[str] | None = None) -> None:
        self.spark, self.path, self.key, self.options, self.order = spark, path.rstrip("/"), key, options or {}, order or key

    # --- versions ---

    def _versions(self) -> list[int]:
        return sorted(int(name) for name in names_in(self.spark, f"{self.path}/versions") if name.isdigit())

    def state(self, version: int | None = None) -> State:
        """The table as of a version, or as it is."""
        known = self._versions() if version is None else [version]
        if not known:
            return State()
        raw = json.loads(text_of(self.spark, f"{self.path}/versions/{known[-1]}"))
        return State(raw["version"], tuple(Segment(**x) for x in raw["segments"]), raw["done"], raw["schema"])

    def _commit(self, new: State) -> None:
        if not put_new(self.spark, f"{self.path}/versions/{new.version}", json.dumps(asdict(new))):
            raise Conflict(f"version {new.version} of {self.path} is another writer's")

    def done(self, stream: str) -> int:
        """The last number of a stream that is part of the table, or -1."""
        return self.state().done.get(stream, -1)

    # --- reading ---

    def _part(self, state: State, segments: tuple[Segment, ...], part: str) -> DataFrame:
        """Rows or keys of segments with ``_at``, the place of each segment in the state."""
        schema = T.StructType.fromJson(json.loads(state.schema))
        kind = schema if part == "rows" else T.StructType([schema[c] for c in self.key])
        place = {s.name: k for k, s in enumerate(state.segments)}
        every = self.spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("_at", T.IntegerType())]))
        for s in segments:
            if part == "rows" or s.keys:
                every = every.unionByName(self.spark.read.schema(kind).parquet(f"{self.path}/{s.name}/{part}").withColumn("_at", F.lit(place[s.name])))
        return every

    def _merged(self, state: State, segments: tuple[Segment, ...], only: DataFrame | None = None, within: Column | None = None) -> DataFrame:
        """The rows that count among those of ``segments``, which are the newest of the state, or of keys among ``only`` or ``within`` a range."""
        rows, newer = self._part(state, segments, "rows"), self._part(state, segments[1:], "keys")
        if only is not None:
            rows = rows.join(side(only), [c for c in self.order if c in only.columns], "left_semi")
            newer = newer.join(side(only), [c for c in self.key if c in only.columns], "left_semi") if self.order == self.key else newer
        if within is not None:
            rows, newer = rows.where(within), newer.where(within) if self.order == self.key else newer
        if any(s.keys for s in segments[1:]):
            last = newer.groupBy(*self.key).agg(F.max("_at").alias("_last"))
            # keys that were asked for are not null, and rows that were dealt by them stay where they are
            asked = only is not None and set(self.key) <= set(only.columns)
            rows = (rows.join(side(last), self.key, "left") if asked else _null_safe(rows, last, self.key)).where("_last IS NULL OR _at >= _last").drop("_last")
        return rows.drop("_at")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows, as of now or of a version that is still kept; None before the first batch."""
        state = self.state(version)
        return self._merged(state, state.segments) if state.segments else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of ``keys``, which hold all columns of the order or the first of them; None before the first batch. Null keys find nothing.

        Rows lie in order of key, so files and row groups without any of ``keys``, or for many of them outside of their
        range, are not read.
        """
        state = self.state()
        if not state.segments:
            return None
        own = [c for c in self.order if c in keys.columns]
        asked, first = keys.select(own).distinct(), own[0]
        few = [r[0] for r in asked.select(first).distinct().limit(self.NAMED + 1).collect()]
        if len(few) <= self.NAMED:
            within = F.col(first).isin([x for x in few if x is not None])
        else:
            least, most = asked.agg(F.min(first), F.max(first)).first()
            within = F.col(first).between(F.lit(least), F.lit(most))
        return self._merged(state, state.segments, asked, within)

    def between(self, least, below=None) -> DataFrame | None:
        """The rows whose first column of the order is at least ``least`` and, if given, less than ``below``: a range of the files; None before the first batch."""
        state, first = self.state(), F.col(self.order[0])
        within = first >= F.lit(least)
        return self._merged(state, state.segments, None, within if below is None else within & (first < F.lit(below))) if state.segments else None

    # --- writing ---

    def _write(self, rows: DataFrame, keys: DataFrame | None, dealt: bool, keyed: bool, tests: dict[str, Column]) -> Segment:
        """A new segment; rows that are ``dealt`` are sorted in the partitions where they are, others in ranges of the order.

        A segment that is ``keyed`` has ``keys``, or those of its rows as they were written. Where a row fails one of ``tests`` there is none.
        """
        name = f"segments/{uuid.uuid4().hex}"
        ordered = lambda df, by, dealt=False: (df if dealt else df.repartitionByRange(*by)).sortWithinPartitions(*by)
        seen, options = Observation(), {"compression": "zstd"} | self.options
        faults = [F.count_if(~F.coalesce(test, F.lit(False))).alias(fault) for fault, test in tests.items()]
        ordered(rows, self.order, dealt).observe(seen, F.count(F.lit(1)).alias("n"), *faults).write.options(**options).parquet(f"{self.path}/{name}/rows")
        if found := {fault: seen.get[fault] for fault in tests if seen.get[fault]}:
            drop(self.spark, f"{self.path}/{name}")
            raise ValueError(", ".join(f"{n} rows: {fault}" for fault, n in found.items()))
        if keyed:
            keys = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/rows") if keys is None else keys
            ordered(keys.select(self.key).distinct(), self.key).write.options(**options).parquet(f"{self.path}/{name}/keys")
        return Segment(name, seen.get["n"], size_of(self.spark, f"{self.path}/{name}"), keyed)

    def _rewritten(self, state: State, segments: tuple[Segment, ...]) -> DataFrame:
        """The rows that count among those of ``segments``, the newest of the state, in ranges of the key: rows and keys meet there, so rows are dealt once."""
        rows, newer = self._part(state, segments, "rows"), self._part(state, segments[1:], "keys")
        both = rows.withColumn("_row", F.lit(True)).unionByName(newer.withColumn("_row", F.lit(False)), allowMissingColumns=True)
        last = F.max(F.when(~F.col("_row"), F.col("_at"))).over(Window.partitionBy(*self.key))
        return both.repartitionByRange(*self.key).withColumn("_last", last).where("_row AND (_last IS NULL OR _at >= _last)").drop("_row", "_at", "_last")

    def upsert(self, rows: DataFrame, number: int, keys: DataFrame | None = None, stream: str = "", merge: bool = True, ranged: bool = True, tests: dict[str, Column] | None = None) -> int:
        """``rows`` in place of all rows of ``keys``, which are those of ``rows`` if not given; a key without rows is deleted.

        Returns the bytes that the batch wrote, 0 for one that is part of the table already. Without ``ranged`` its rows are
        not shuffled for their order: each file is sorted, but files overlap until they are merged. Such rows are computed once.
        A batch with rows that fail one of ``tests``, which are named by the fault, is a ValueError and no part of the table.
        """
        before = self.state()
        if number <= before.done.get(stream, -1):
            return 0
        if before.segments:
            schema = T.StructType.fromJson(json.loads(before.schema))
            rows = rows.select([F.col(f.name).cast(f.dataType) for f in schema])
        else:
            schema = rows.schema
        for f in schema:
            f.nullable = True
        segment = replace(self._write(rows, keys, not ranged, bool(before.segments), tests or {}), stream=stream)
        self._commit(State(before.version + 1, (*before.segments, segment), before.done | {stream: number}, json.dumps(schema.jsonValue())))
        if merge:
            self.merge()
        self._sweep()
        return segment.bytes

    def settle(self, stream: str, number: int, batches: int) -> bool:
        """End a stream whose ``batches`` hold all rows that are to stay, and no key twice: what is older goes without being read, and readers join nothing.

        False, and nothing is done, where those are not the newest segments, one by one, as another writer's batch came between.
        """
        state = self.state()
        own = state.segments[-batches:]
        if len(own) < batches or any(s.stream != stream for s in own):
            return False
        self._commit(State(state.version + 1, tuple(replace(s, keys=False) for s in own), state.done | {stream: number}, state.schema))
        self._sweep()
        return True

    def _tier(self, segment: Segment) -> int:
        size, tier = segment.bytes // self.UNIT, 0
        while size:
            size, tier = size // self.FANOUT, tier + 1
        return tier

    def merge(self) -> int:
        """Merge the newest segments as long as ``FANOUT`` of them are of one size or less than the one before; the bytes written.

        A batch that is part of the table by then makes what was merged void, which is no loss.
        """
        written = 0
        while True:
            state = self.state()
            n, size = 0, -1
            for k, s in enumerate(reversed(state.segments)):
                size = max(size, self._tier(s))
                # as many as are no larger than the largest so far; a larger one before them ends the run
                run = [x for x in state.segments[-(k + 1) :] if self._tier(x) == size]
                n = k + 1 if len(run) >= self.FANOUT else n
            if not n:
                return written
            newest = state.segments[-n:]
            whole = n == len(state.segments)
            keys = None if whole else self._part(state, newest, "keys")
            merged = self._write(self._rewritten(state, newest), keys, self.order == self.key, not whole, {})
            written += merged.bytes
            try:
                self._commit(State(state.version + 1, (*state.segments[:-n], merged), state.done, state.schema))
            except Conflict:
                drop(self.spark, f"{self.path}/{merged.name}")
                return written

    def _sweep(self) -> None:
        """Delete versions beyond the last few, and the segments that only these name. What a writer has not committed yet stays."""
        versions = self._versions()
        old, kept = versions[: -self.VERSIONS], versions[-self.VERSIONS :]
        if not old:
            return
        used = {s.name for v in kept for s in self.state(v).segments}
        for v in old:
            for s in self.state(v).segments:
                if s.name not in used:
                    drop(self.spark, f"{self.path}/{s.name}")
            drop(self.spark, f"{self.path}/versions/{v}")


def _null_safe(rows: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """A left join by a key that may hold nulls, which are equal to each other."""
    named = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[c for c in last.columns if c not in key])
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(side(named), same, "left").drop(*[f"_k{i}" for i in range(len(key))])
