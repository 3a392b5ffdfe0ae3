"""The collection's relations, derived from the benchmark tables, in Spark and as the same rules in SQL."""

from __future__ import annotations

import zlib
from itertools import accumulate, pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.lexical import TextIndex, indexed
from marginalia.operators.storage import spread

#: Seconds of the epoch that the collection starts with, and those that stand for now.
EPOCH, NOW = 1_704_067_200, 1_735_689_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work on each row."""
    return spread(table(spark, sf_dir, name))


def notes(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """Documents as notes; ``marked`` adds tags for language and source and a link to the content."""
    content = "text || ' #' || lang || ' #' || source || ' [[doc-' || (doc_id * 7 % 997) || ']]'" if marked else "text"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS note_id", "'doc-' || doc_id AS title", f"{content} AS content",
        "CAST(CASE WHEN source = 'src19' THEN NULL WHEN CAST(substr(source, 4) AS INT) < 5 THEN CAST(substr(source, 4) AS INT) ELSE 100 + CAST(substr(source, 4) AS INT) END AS BIGINT) AS folder_id",
        f"{EPOCH} + doc_id * 3600 AS created_at", f"{EPOCH} + doc_id * 3600 + (doc_id % 5) * 86400 AS updated_at",
    )


#: The actions that events stand for; errors are of no action that the log knows.
_ACTION = "CASE event_type WHEN 'view' THEN 'note_open' WHEN 'signup' THEN 'note_create' WHEN 'purchase' THEN 'note_export' WHEN 'click' THEN 'search_fts' ELSE 'page_' || event_type END"
#: Full-text indexes by application and folder of tables.
_indexes: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the notes, built at its first use in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes[key] = indexed(spark, notes(spark, sf_dir))
    return _indexes[key]


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name", "CAST(NULL AS BIGINT) AS parent_id")
    nation = table(spark, sf_dir, "nation").selectExpr("CAST(100 + n_nationkey AS BIGINT) AS id", "n_name AS name", "CAST(n_regionkey AS BIGINT) AS parent_id")
    return region.unionByName(nation).withColumn("locked", F.col("id") % 7 == 0)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", f"{_ACTION} AS action", "CASE WHEN event_id % 3 = 0 THEN 'Note' ELSE 'file' END AS resource_type", "user_id AS resource_id",
        "'user-' || user_id AS resource_name", "props AS detail", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS created_at",
    )


def property_defs(spark: SparkSession) -> DataFrame:
    return spark.range(5).selectExpr("id AS folder_id", "inline(array(named_struct('k', 1, 'name', 'status', 'type', 'select'), named_struct('k', 2, 'name', 'priority', 'type', 'select'), named_struct('k', 3, 'name', 'total', 'type', 'number'), named_struct('k', 4, 'name', 'date', 'type', 'date')))").selectExpr("folder_id * 10 + k AS def_id", "folder_id", "name", "type", "k - 1 AS position")


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS note_id", "o_custkey % 5 AS folder_id")


def property_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the orders; every seventh order lacks its priority."""
    long = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS note_id", "o_custkey % 5 * 10 AS base",
        "stack(4, 1L, o_orderstatus, 2L, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, 3L, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), 4L, date_format(o_orderdate, 'yyyy-MM-dd')) AS (k, value)",
    )
    return long.where("value IS NOT NULL").selectExpr("note_id", "base + k AS def_id", "value")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS note_id", "l_shipdate", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_partkey", "l_suppkey")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "vec_id DIV 5 AS note_id", "'vec-' || (vec_id DIV 5) AS title", "vec_id % 5 AS chunk_index", "'chunk ' || vec_id AS content", "embedding AS vector")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")


#: The same relations as SQL, by name.
SQL = {
    "notes": f"""notes AS (SELECT doc_id AS note_id, 'doc-' || doc_id AS title, text AS content,
  CAST(CASE WHEN source = 'src19' THEN NULL WHEN CAST(substr(source, 4) AS INT) < 5 THEN CAST(substr(source, 4) AS INT) ELSE 100 + CAST(substr(source, 4) AS INT) END AS BIGINT) AS folder_id,
  {EPOCH} + doc_id * 3600 AS created_at, {EPOCH} + doc_id * 3600 + (doc_id % 5) * 86400 AS updated_at FROM documents)""",
    "marked": """marked AS (SELECT doc_id AS note_id, 'doc-' || doc_id AS title, text || ' #' || lang || ' #' || source || ' [[doc-' || (doc_id * 7 % 997) || ']]' AS content FROM documents)""",
    "folders": """folders AS (SELECT r_regionkey::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id, r_regionkey % 7 = 0 AS locked FROM region
  UNION ALL SELECT (100 + n_nationkey)::BIGINT, n_name, n_regionkey::BIGINT, (100 + n_nationkey) % 7 = 0 FROM nation)""",
    "log": f"""log AS (SELECT event_id AS id, {_ACTION} AS action, CASE WHEN event_id % 3 = 0 THEN 'Note' ELSE 'file' END AS resource_type, user_id AS resource_id,
  'user-' || user_id AS resource_name, props AS detail, floor(epoch(ts))::BIGINT AS created_at FROM events)""",
    "defs": """defs AS (SELECT f * 10 + k AS def_id, f AS folder_id, name, type, k - 1 AS position FROM (SELECT unnest(range(5)) AS f) CROSS JOIN (VALUES (1, 'status', 'select'), (2, 'priority', 'select'), (3, 'total', 'number'), (4, 'date', 'date')) t(k, name, type))""",
    "order_notes": """order_notes AS (SELECT o_orderkey AS note_id, o_custkey % 5 AS folder_id FROM orders)""",
    "cells": """cells AS (SELECT o_orderkey AS note_id, o_custkey % 5 * 10 + 1 AS def_id, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, o_custkey % 5 * 10 + 2, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, o_custkey % 5 * 10 + 3, o_totalprice::DECIMAL(12,2)::VARCHAR FROM orders
  UNION ALL SELECT o_orderkey, o_custkey % 5 * 10 + 4, strftime(o_orderdate, '%Y-%m-%d') FROM orders)""",
    "view": """view AS (SELECT n.note_id, d.def_id, d.name, d.type, d.position, c.value FROM order_notes n JOIN defs d USING (folder_id) LEFT JOIN cells c ON c.note_id = n.note_id AND c.def_id = d.def_id)""",
    "links": """raw_links AS (SELECT note_id AS source_id, unnest(regexp_extract_all(content, '\\[\\[(.*?)\\]\\]', 1)) AS title FROM marked),
links AS (SELECT DISTINCT r.source_id, m.note_id AS target_id FROM raw_links r JOIN marked m ON m.title = trim(r.title) WHERE r.source_id <> m.note_id)""",
    "tags": r"""tags AS (SELECT DISTINCT note_id, lower(unnest(regexp_extract_all(content, '(?:^|\s)#([\p{L}\p{N}_-]+)', 1))) AS tag FROM marked)""",
    "near": """near AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.vec_id // 5 AS note_id, 'vec-' || (e.vec_id // 5) AS title, e.vec_id % 5 AS chunk_index, 'chunk ' || e.vec_id AS content,
  list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near)""",
    "blocked": """blocked AS (SELECT id AS folder_id FROM folders WHERE locked)""",
    "tree": """tree AS (WITH RECURSIVE t AS (SELECT id AS ancestor, id, 0 AS depth FROM folders UNION ALL SELECT t.ancestor, f.id, t.depth + 1 FROM t JOIN folders f ON f.parent_id = t.id) SELECT * FROM t)""",
}


def with_(*names: str) -> str:
    """A WITH clause of these relations."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def pdf_file(text: str | None, streams: bool = True, lines: int = 40) -> bytes | None:
    """A text as a PDF file: a page for ``lines`` of its lines, words set apart by gaps, codes of two bytes in the order in which characters first occur.

    With ``streams`` objects and references are in compressed streams, otherwise plain with a table.
    """
    if text is None:
        return None
    shown = text.replace("\n", "").replace(" ", "")
    codes = {c: i + 1 for i, c in enumerate(dict.fromkeys(shown))}
    places = np.zeros(1 + max(map(ord, codes), default=0), ">u2")
    places[[*map(ord, codes)]] = [*codes.values()]
    # the codes of all characters in a row, from which each word takes its own
    digits, at, rows = places[np.frombuffer(shown.encode("utf-32-le"), "<u4")].tobytes().hex(), 0, []
    for line in text.split("\n"):
        ends = [*accumulate((4 * len(word) for word in line.split(" ") if word), initial=at)]
        rows.append(" -400 ".join([f"<{digits[i:j]}>" for i, j in pairwise(ends)]))
        at = ends[-1]
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)]
    pairs = [f"<{i:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, i in codes.items()]
    cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "".join(f"{len(pairs[i : i + 100])} beginbfchar\n{''.join(pairs[i : i + 100])}endbfchar\n" for i in range(0, len(pairs), 100))
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {
        1: "<</Type/Catalog/Pages 2 0 R>>",
        2: f"<</Type/Pages/Count {len(pages)}/Kids[{kids}]/Resources<</Font<</F0 3 0 R>>>>>>",
        3: "<</Type/Font/Subtype/Type0/BaseFont/Sans/Encoding/Identity-H/ToUnicode 4 0 R/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/DW 600>>]>>",
    }
    bodies = {4: cmap}
    for i, page in enumerate(pages):
        objects[5 + 2 * i] = f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Contents {6 + 2 * i} 0 R>>"
        bodies[6 + 2 * i] = "BT /F0 10 Tf 12 TL 50 800 Td\n" + "".join(f"[{row}] TJ T*\n" for row in page) + "ET"
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, body: str, raw: bytes | None = None) -> None:
        places[number] = (1, len(out), 0)
        out.extend(f"{number} 0 obj\n{body}".encode())
        if raw is not None:
            out.extend(b"\nstream\n" + raw + b"\nendstream")
        out.extend(b"\nendobj\n")

    for number, body in bodies.items():
        raw = zlib.compress(body.encode()) if streams else body.encode()
        put(number, f"<</Length {len(raw)}{'/Filter/FlateDecode' if streams else ''}>>", raw)
    n = 5 + 2 * len(pages)
    if not streams:
        for number, body in objects.items():
            put(number, body)
        table = "".join(f"{places[i][1]:010d} 00000 n \n" for i in range(1, n))
        return bytes(out) + f"xref\n0 {n}\n0000000000 65535 f \n{table}trailer\n<</Size {n}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    heads, held = "", ""
    for i, (number, body) in enumerate(objects.items()):
        heads, held, places[number] = heads + f"{number} {len(held)} ", held + body + "\n", (2, n, i)
    raw = zlib.compress((heads + held).encode())
    put(n, f"<</Type/ObjStm/N {len(objects)}/First {len(heads)}/Filter/FlateDecode/Length {len(raw)}>>", raw)
    start, above, table = len(out), bytes(7), bytearray()
    places[n + 1] = (1, start, 0)
    for i in range(n + 2):
        kind, x, y = places.get(i, (0, 0, 0))
        row = bytes([kind]) + x.to_bytes(4) + y.to_bytes(2)
        table += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    raw = zlib.compress(table)
    put(n + 1, f"<</Type/XRef/Size {n + 2}/W[1 4 2]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length {len(raw)}>>", raw)
    return bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()
