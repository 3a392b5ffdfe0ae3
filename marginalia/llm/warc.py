"""WARC archives of pages, written with an index and read back through it.

Each record is a gzip member of its own, so its offset and length in the archive are enough to read it. The
writer hands on an index row per record; a reader takes index rows, sorts them by archive and offset and
coalesces near ones into one byte-range read. Records of equal payloads are stored once: the others are
revisits that name the record which has the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted, scratch_path

#: Fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id string"
#: Bytes that one task's read covers, and the gap up to which two records are read at once.
CELL, GAP = 4 << 20, 64 << 10


class WarcError(ValueError):
    """A record cannot be read, or its payload does not have its digest."""


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One compressed record: a response, or a revisit without payload where ``refers_to`` is a page."""
    digest = payload_digest(payload)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url))] if url is not None else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    fields += [("X-Page-Id", page_id)] if page_id is not None else []
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)] if revisit else []
    return _member("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a compressed record; the payload's digest is checked."""
    try:
        data = gzip.decompress(member)
    except (OSError, EOFError, zlib.error) as fault:
        raise WarcError(f"no gzip member: {fault}") from fault
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise WarcError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if fields.get("warc-type") not in ("response", "revisit"):
        return fields, block
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
        raise WarcError(f"payload of {fields['warc-record-id']} does not have its digest")
    return fields, payload


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; the index, one row per record.

    Of pages with equal payloads (UTF-8 of html; null: empty) of at least ``min_bytes``, that with the
    largest page_id is the response and the others are revisits of it; a repeated page_id with the same
    payload has one response and revisits of itself. Null ids are never referred to. ``folder`` is a URI
    that all nodes share and pyarrow can write. A task writes one archive under a name of its own and then
    renames it; rows are sorted within it, so that a task that runs again writes the same bytes.
    """
    kind = pages.schema["page_id"].dataType
    raw = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = persisted(raw.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes), "digests")
    best = hashed.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    again = hashed.join(best, "sha1").groupBy(key.alias("key"), "sha1").agg(F.max("best").cast("string").alias("best"))
    # repeated rows meet in one task, whichever join is chosen
    keyed = raw.withColumn("key", key).withColumn("sha1", F.sha1(F.col("html").cast("binary"))).repartition("key", "sha1")
    ready = keyed.join(again, ["key", "sha1"], "left").select(F.col("page_id").cast("string"), "url", F.col("html").cast("binary").alias("html"), "best", "sha1").sortWithinPartitions("page_id", "sha1", "url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}.warc.gz"
        draft, sink, at, last = f"{root}/.{name}-{task.taskAttemptId()}", None, 0, None
        for batch in batches:
            rows = []
            for page_id, url, html, best, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    sink = store.open_output_stream(draft, compression=None)
                    head = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, 'warcinfo')}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n\r\n".encode())
                    sink.write(head)
                    at = len(head)
                first = (page_id, sha1) != last
                last = (page_id, sha1)
                refers_to = best if best is not None and not (best == page_id and first) else None
                data = record(page_id, url, html, refers_to, date)
                sink.write(data)
                rows.append((name, at, len(data), url, payload_digest(html), "response" if refers_to is None else "revisit", page_id))
                at += len(data)
            if rows:
                yield _batch(rows, INDEX)
        if sink is not None:
            sink.close()
            # an earlier run of the task left the same bytes
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                store.move(draft, f"{root}/{name}")
            else:
                store.delete_file(draft)

    index = ready.mapInArrow(archive, INDEX)
    return persisted(index.withColumn("page_id", F.col("page_id").cast(kind)), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` selects: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    (and ``payload``, if asked for; that of a revisit is null).

    Index rows are gathered by archive and cell of offsets, which bounds what a task reads, and sorted;
    records no further than ``GAP`` apart are read at once. A record that does not parse fails the job.
    """
    kind = index.schema["page_id"].dataType
    fields = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    cells = index.groupBy("archive", F.floor(F.col("offset") / CELL).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places")).select("archive", "places")
    # the rows are small but what they stand for is not, so tasks are dealt by the bytes to read
    total = index.agg(F.sum("length")).first()[0] or 0
    cells = cells.repartition(max(1, -(-total // CELL)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{archive}") as file:
                    rows = []
                    for run in _runs([(p["offset"], p["length"]) for p in places]):
                        start = run[0][0]
                        data = file.read_at(run[-1][0] + run[-1][1] - start, start)
                        for offset, length in run:
                            rows.append(_described(data[offset - start : offset - start + length], with_payload))
                yield _batch(rows, fields)

    found = cells.mapInArrow(fetch, fields)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _runs(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in runs without a gap over ``GAP``."""
    run: list[tuple[int, int]] = []
    for place in places:
        if run and place[0] - sum(run[-1]) > GAP:
            yield run
            run = []
        run.append(place)
    if run:
        yield run


def _described(member: bytes, with_payload: bool) -> tuple:
    fields, payload = parse(member)
    revisit = fields["warc-type"] == "revisit"
    size = int(fields["x-payload-length"])
    if not revisit and size != len(payload):
        raise WarcError(f"payload of {fields['warc-record-id']} is cut")
    row = (fields.get("x-page-id"), fields.get("warc-target-uri"), size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields.get("x-refers-to-page-id"))
    return (*row, None if revisit else payload) if with_payload else row


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back through the index.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Null html is an
    empty payload; null and repeated ids keep their rows; other columns are ignored; no pages give no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    index = write(pages, folder, min_bytes)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for :func:`round_trip` over ``pages`` (ids neither null nor repeated): base32 as four characters for five hex digits.
ROUND_TRIP_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM p
"""
