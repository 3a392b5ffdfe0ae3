"""ZIM archives as tables: a data source lists their entries by windows of the pointer lists, tasks read the clusters.

The format is public: a header, a list of types, a list of places of entries in order of path, entries that name a
cluster and a blob in it or the entry that they redirect to, and clusters of blobs, which are stored as they are or
compressed with LZMA or Zstandard.
"""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.functions.documents import UDFS
from marginalia.operators.storage import persisted

#: Fixed values of the format: its number, the header, the type of a redirect, and kinds of clusters.
MAGIC, HEADER, REDIRECT = 0x44D495A, "<IHH16sIIQQQQIIQ", 0xFFFF
PLAIN, XZ, ZSTD, EXTENDED = 1, 4, 5, 0x10
#: Entries of a window, bytes that are read at once, and room for an entry with its path and title.
WINDOW, SPAN, ROOM = 4096, 4 << 20, 4096
ENTRY = "archive string, entry long, namespace string, path string, title string, mime string, redirect long, cluster long, blob long"


def _opened(uri: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_file(at)


@dataclass(frozen=True)
class Header:
    entries: int
    clusters: int
    places: int
    cluster_places: int
    types: int
    checksum: int

    @classmethod
    def of(cls, file) -> Header:
        raw = file.read_at(80, 0)
        if len(raw) < 80 or struct.unpack_from("<I", raw)[0] != MAGIC:
            raise ValueError("not a ZIM archive")
        _, _, _, _, entries, clusters, places, _, cluster_places, types, _, _, checksum = struct.unpack(HEADER, raw)
        return cls(entries, clusters, places, cluster_places, types, checksum)


def _types(file, header: Header) -> list[str]:
    raw, size = b"", 1024
    while b"\0\0" not in raw:
        raw, size = file.read_at(size, header.types), size * 2
        if len(raw) < size // 2 and b"\0\0" not in raw:
            raise ValueError("the list of types does not end")
    return [x.decode() for x in raw[: raw.index(b"\0\0")].split(b"\0")]


def _spans(file, places: list[int]) -> Iterator[tuple[int, bytes]]:
    """Each place with what is there, read in spans; a long entry is read by itself."""
    order, at = sorted(places), 0
    while at < len(order):
        end = at
        while end + 1 < len(order) and order[end + 1] - order[end] <= ROOM and order[end + 1] - order[at] < SPAN:
            end += 1
        raw = file.read_at(order[end] + ROOM - order[at], order[at])
        for place in order[at : end + 1]:
            yield place, raw[place - order[at] : place - order[at] + ROOM]
        at = end + 1


def _names(raw: bytes) -> int:
    """Where an entry's path begins."""
    return 12 if struct.unpack_from("<H", raw)[0] == REDIRECT else 16


def _entry(raw: bytes) -> tuple[int, str, int, int, str, str]:
    """Type, name space, cluster or target of a redirect, blob, path and title."""
    kind, _, space, _, first = struct.unpack_from("<HBcII", raw)
    path, title, _ = raw[_names(raw) :].split(b"\0", 2)
    return kind, space.decode("latin-1"), first, 0 if kind == REDIRECT else struct.unpack_from("<I", raw, 12)[0], path.decode(), title.decode()


@dataclass
class _Window(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, archives: list[str], start: int, size: int | None) -> None:
        self.archives, self.start, self.size = archives, start, size

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in self.archives:
            with _opened(archive) as file:
                n = Header.of(file).entries
            end = n if self.size is None else min(n, self.start + self.size)
            out += [_Window(archive, a, min(end, a + WINDOW)) for a in range(self.start, end, WINDOW)]
        return out or [_Window("", 0, 0)]

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        with _opened(partition.archive) as file:
            header = Header.of(file)
            types = _types(file, header)
            n = partition.end - partition.start
            places = struct.unpack(f"<{n}Q", file.read_at(8 * n, header.places + 8 * partition.start))
            found = {}
            for place, raw in _spans(file, list(places)):
                if raw[_names(raw) :].count(b"\0") < 2:
                    raw = file.read_at(1 << 20, place)  # a path and title of such a length are not known
                found[place] = _entry(raw)
        rows = [found[p] for p in places]
        moved = [r[0] == REDIRECT for r in rows]
        columns = [
            [partition.archive] * n, range(partition.start, partition.end), [r[1] for r in rows], [r[4] for r in rows], [r[5] or r[4] for r in rows],
            [types[r[0]] if r[0] < len(types) else None for r in rows], [r[2] if m else None for r, m in zip(rows, moved, strict=True)],
            [None if m else r[2] for r, m in zip(rows, moved, strict=True)], [None if m else r[3] for r, m in zip(rows, moved, strict=True)],
        ]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])


class ArchiveSource(DataSource):
    """``spark.read.format("zim").load(folder or file)``: the entries of all archives there; options ``start`` and ``size`` are a window of each archive's entries."""

    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: T.StructType) -> DataSourceReader:
        from pyarrow import fs

        path, size = self.options["path"].rstrip("/"), self.options.get("size")
        store, at = fs.FileSystem.from_uri(path)
        archives = [path]
        if store.get_file_info(at).type == fs.FileType.Directory:
            archives = sorted(f"{path}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".zim"))
        return ArchiveReader(archives, int(self.options.get("start", 0)), None if size is None else int(size))


def entries(spark: SparkSession, path: str, start: int = 0, size: int | None = None) -> DataFrame:
    """``archive, entry, namespace, path, title, mime, redirect, cluster, blob`` of a window of each archive's entries, in order of path."""
    spark.dataSource.register(ArchiveSource)
    window = {"start": start} | ({} if size is None else {"size": size})
    return spark.read.format("zim").options(**window).load(path)


def blobs_of(raw: bytes) -> list[bytes]:
    """The blobs of a cluster."""
    kind, body = raw[0] & 0x0F, raw[1:]
    if kind == XZ:
        body = lzma.LZMADecompressor().decompress(body)
    elif kind == ZSTD:
        import zstandard

        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    elif kind not in (0, PLAIN):
        raise ValueError(f"a cluster of unknown kind {kind}")
    width, letter = (8, "Q") if raw[0] & EXTENDED else (4, "I")
    n = struct.unpack_from(f"<{letter}", body)[0] // width
    at = struct.unpack_from(f"<{n}{letter}", body)
    return [body[a:b] for a, b in zip(at, at[1:], strict=False)]


def contents(rows: DataFrame) -> DataFrame:
    """``rows(archive, cluster, blob, ...)`` with ``content``; redirects have none.

    Rows are sorted by cluster, so a task reads and unpacks each of its clusters once and holds one at a time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, header, archive, known, blobs = None, None, None, None, []
        for batch in batches:
            held, found, start = 0, [], 0
            keys = zip(*(batch.column(c).to_pylist() for c in ("archive", "cluster", "blob")), strict=True)
            for i, (name, cluster, blob) in enumerate(keys):
                if name != archive:
                    file = _opened(name)
                    header, archive, known = Header.of(file), name, None
                if cluster is None:
                    found.append(None)
                    continue
                if cluster != known:
                    places = struct.unpack("<2Q", file.read_at(16, header.cluster_places + 8 * cluster)) if cluster + 1 < header.clusters else (*struct.unpack("<Q", file.read_at(8, header.cluster_places + 8 * cluster)), _end(file, header, cluster))
                    blobs, known = blobs_of(file.read_at(places[1] - places[0], places[0])), cluster
                found.append(blobs[blob])
                held += len(found[-1])
                if held >= SPAN:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, pa.array(found, pa.binary())], [f.name for f in schema])
                    held, start, found = 0, i + 1, []
            if found:
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, pa.array(found, pa.binary())], [f.name for f in schema])

    return rows.repartitionByRange("archive", "cluster").sortWithinPartitions("archive", "cluster", "blob").mapInArrow(read, schema)


def _end(file, header: Header, cluster: int) -> int:
    """Where the last cluster ends: at the next thing behind it."""
    start = struct.unpack("<Q", file.read_at(8, header.cluster_places + 8 * cluster))[0]
    return min(x for x in (header.checksum, header.places, header.cluster_places, file.size()) if x > start)


def resolved(rows: DataFrame) -> DataFrame:
    """Entries with ``target``, the entry that a redirect leads to in the end, or their own; those that lead in a circle or to nothing go.

    Each round a redirect looks twice as far, so rounds grow with the logarithm of the longest way.
    """
    ways = persisted(rows.select("archive", "entry", F.col("redirect").alias("next"), F.when(F.col("redirect").isNull(), F.col("entry")).alias("target")), "ways")
    span, most = 1, ways.where("next IS NOT NULL").count()
    while span <= 2 * most and not ways.where("target IS NULL AND next IS NOT NULL").isEmpty():
        ahead = ways.select("archive", F.col("entry").alias("next"), F.col("next").alias("then"), F.col("target").alias("there"))
        ways = ways.join(ahead, ["archive", "next"], "left").select("archive", "entry", F.when(F.col("target").isNull(), F.col("then")).alias("next"), F.coalesce("target", "there").alias("target"))
        ways, span = persisted(ways, "ways"), span * 2
    return rows.join(ways.where("target IS NOT NULL").select("archive", "entry", "target"), ["archive", "entry"])


def pages(spark: SparkSession, path: str, start: int = 0, size: int | None = None) -> DataFrame:
    """``archive, page_id, url, title, html`` of the HTML entries in a window; redirects are left out. Old name spaces stay before the path, as in ``A/``."""
    found = entries(spark, path, start, size).where("redirect IS NULL AND mime LIKE 'text/html%'")
    url = F.when(F.col("namespace").isin("C", ""), F.col("path")).otherwise(F.concat("namespace", F.lit("/"), "path"))
    return contents(found).select("archive", F.col("entry").alias("page_id"), url.alias("url"), "title", UDFS["decode_text"](F.col("content")).alias("html"))


def read_paths(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted, archive, path, mime, content`` of each ``wanted(wanted)`` path, in whatever archive, after its redirects."""
    every = resolved(persisted(entries(spark, path), "entries"))
    asked = every.join(wanted.select("wanted").distinct(), F.col("wanted") == F.col("path")).select("wanted", "archive", "target")
    targets = every.where("redirect IS NULL").select("archive", F.col("entry").alias("target"), "path", "mime", "cluster", "blob")
    return contents(asked.join(targets, ["archive", "target"])).select("wanted", "archive", "path", "mime", "content")


def written(rows: DataFrame, folder: str, kind: int = ZSTD, blobs: int = 64) -> int:
    """Write ``rows(path, title, mime, content, redirect)`` as archives, one for each partition; ``redirect`` names a path of the same partition, else ``content`` holds.

    Returns how many entries were written. A partition's rows are held by its task, so they are to be as many as fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        held = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["path"].encode())
        if held:
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.zim") as out:
                out.write(archive_of(held, kind, blobs))
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    return rows.select("path", "title", "mime", "content", "redirect").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def archive_of(rows: list[dict], kind: int, blobs: int, space: bytes = b"C") -> bytes:
    """An archive of rows in order of path."""
    import hashlib

    import zstandard

    types = sorted({r["mime"] for r in rows if r["redirect"] is None})
    place = {r["path"]: i for i, r in enumerate(rows)}
    stored = [i for i, r in enumerate(rows) if r["redirect"] is None]
    clusters = []
    for a in range(0, len(stored), blobs):
        parts = [rows[i]["content"] or b"" for i in stored[a : a + blobs]]
        at = [4 * (len(parts) + 1)]
        for part in parts:
            at.append(at[-1] + len(part))
        body = struct.pack(f"<{len(at)}I", *at) + b"".join(parts)
        packed = {XZ: lambda b: lzma.compress(b, check=lzma.CHECK_CRC32), ZSTD: lambda b: zstandard.ZstdCompressor().compress(b)}.get(kind, bytes)(body)
        clusters.append(bytes([kind]) + packed)
    where = {i: divmod(n, blobs) for n, i in enumerate(stored)}
    dirents = []
    for i, r in enumerate(rows):
        ends = r["path"].encode() + b"\0" + ("" if r["title"] == r["path"] else r["title"] or "").encode() + b"\0"
        if r["redirect"] is None:
            dirents.append(struct.pack("<HBcIII", types.index(r["mime"]), 0, space, 0, *where[i]) + ends)
        else:
            dirents.append(struct.pack("<HBcII", REDIRECT, 0, space, 0, place[r["redirect"]]) + ends)
    head = b"".join(t.encode() + b"\0" for t in types) + b"\0"
    places = 80 + len(head)
    titles, cluster_places = places + 8 * len(rows), places + 12 * len(rows)
    first = cluster_places + 8 * len(clusters)
    at, entry_at = first, []
    for x in dirents:
        entry_at.append(at)
        at += len(x)
    cluster_at = []
    for x in clusters:
        cluster_at.append(at)
        at += len(x)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["title"] or "").encode())
    header = struct.pack(HEADER, MAGIC, 6, 1, bytes(16), len(rows), len(clusters), places, titles, cluster_places, 80, 0xFFFFFFFF, 0xFFFFFFFF, at)
    whole = header + head + struct.pack(f"<{len(rows)}Q", *entry_at) + struct.pack(f"<{len(rows)}I", *order) + struct.pack(f"<{len(clusters)}Q", *cluster_at) + b"".join(dirents) + b"".join(clusters)
    return whole + hashlib.md5(whole).digest()
