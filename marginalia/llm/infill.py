"""Fill-in-the-middle: texts are cut into prefix, middle and suffix at random units and put in another order.

DuckDB does the work within Arrow batches: each batch, in lots of bounded bytes, is registered as a view, and one
SQL statement cuts it into units, places the cuts and joins the parts; no text passes through a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: Runs of letters, and every other code point by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of the texts that one statement cuts, as it holds a few times as much for their units; a longer text is a lot by itself.
LOT = 4 << 20

#: Arrow's types of the columns that are added.
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}

_CUT = """
WITH units AS (
    SELECT pos, text, regexp_extract_all(text, $unit) AS units, sha256($seed || ':' || id) AS h FROM lot
), drawn AS (
    SELECT *, len(units) AS n,
        CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
        text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m)
            OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 - $plain AS whole,
        CAST('0x' || h[25:32] AS BIGINT) % 100 < $spm AS turned
    FROM units
), parts AS (
    SELECT pos, text, n, CASE WHEN whole THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form,
        CASE WHEN NOT whole THEN coalesce(array_to_string(list_slice(units, 1, least(c1, c2)), ''), '') END AS prefix,
        CASE WHEN NOT whole THEN coalesce(array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), ''), '') END AS middle,
        CASE WHEN NOT whole THEN coalesce(array_to_string(list_slice(units, greatest(c1, c2) + 1, n), ''), '') END AS suffix
    FROM drawn
)
SELECT n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle
        ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM parts ORDER BY pos
"""

_REBUILD = """
WITH cut AS (
    SELECT pos, form, output, split_part(output, $m, 1) AS head, split_part(output, $m, 2) AS middle FROM lot
)
SELECT CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(head[length($p) + 1:], $s, 1) || middle || split_part(head[length($p) + 1:], $s, 2)
    ELSE split_part(head[length($s) + 1:], $p, 2) || middle || split_part(head[length($s) + 1:], $p, 1) END AS restored
FROM cut ORDER BY pos
"""


def _lots(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows of at most ``LOT`` bytes, or of one row."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > LOT:
            yield start, k - start
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def _by_duckdb(rows: DataFrame, inputs: dict[str, str], outputs: list[T.StructField], statement: str, values: dict) -> DataFrame:
    """``rows`` and the statement's columns, one result row for each row; ``inputs`` are the view's columns by name, the first of them the bytes to bound."""
    names = list(inputs)
    schema = T.StructType([*rows.schema.fields, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        for batch in batches:
            sizes = pc.binary_length(batch.column(inputs[names[0]])).fill_null(0).to_pylist()
            for start, length in _lots(sizes):
                part = batch.slice(start, length)
                view = pa.table({"pos": pa.array(range(length), pa.int64()), **{c: part.column(inputs[c]) for c in names}})
                con.register("lot", view)
                found = con.sql(statement, params=values).to_arrow_table()
                con.unregister("lot")
                made = [pa.concat_arrays(found.column(f.name).chunks).cast(_ARROW[f.dataType]) for f in outputs]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [f.name for f in schema])
        con.close()

    return rows.mapInArrow(run, schema)


def _checked(marks: tuple[str, str, str]) -> dict[str, str]:
    """The marks by their name in SQL; each must be found where it was put, so none may begin with another's end or its own."""
    if not all(marks) or len(set(marks)) < 3:
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and b in a):
                raise ValueError(f"{a!r} and {b!r} overlap")
    return dict(zip("psm", marks, strict=True))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``n`` (units of the text), ``form``, ``prefix_chars`` and ``middle_chars`` (code points) and ``output``.

    The cuts lie at random units, drawn from the SHA-256 of ``<seed>:<id>``, so reruns agree. ``form`` is ``psm``
    (prefix, suffix, middle), for ``spm_percent`` of the others ``spm`` (suffix, prefix, middle), and ``plain`` for
    ``plain_percent`` of the texts, for empty ones and for those that hold a mark: these are kept as they are, and
    the characters are null. A null text is an empty one. Each row is by itself: equal rows have equal results, a
    null id is drawn as the empty text. New columns whose names are taken, whatever the case, get underscores before
    them. An empty table gives an empty result.
    """
    values = _checked(marks) | {"unit": UNIT, "seed": str(seed), "plain": plain_percent, "spm": spm_percent}
    names = {c: unused(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
    text, key = unused(docs, "fim_text"), unused(docs, "fim_id")
    rows = docs.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), key: F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    outputs = [T.StructField(name, T.StringType() if c in ("form", "output") else T.LongType()) for c, name in names.items()]
    return _by_duckdb(rows, {"text": text, "id": key}, outputs, _aliased(_CUT, names), values).drop(text, key)


def restored(cut: DataFrame, marks: tuple[str, str, str] = MARKS, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``cut`` with ``restored``: the exact text, rebuilt from the output and its form alone; null where the output is null."""
    name = unused(cut, "restored")
    outputs = [T.StructField(name, T.StringType())]
    return _by_duckdb(cut, {"output": output_col, "form": form_col}, outputs, _aliased(_REBUILD, {"restored": name}), _checked(marks))


def _aliased(statement: str, names: dict[str, str]) -> str:
    """The statement with its columns under the given names."""
    return f"SELECT {', '.join(f'{c} AS "{name}"' for c, name in names.items())} FROM ({statement})"


def digests(docs: DataFrame) -> DataFrame:
    """Each document's cuts, and the digests of its output and of the text rebuilt from it."""
    out = restored(fill_in_middle(docs.select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: The query in SQL: the cuts by the characters before them, the digest of the text itself in place of that of the rebuilt one.
DIGESTS_SQL = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
    SELECT *, len(u) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS d FROM units
), cuts AS (
    SELECT *, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR d[3] % 100 >= 90 THEN 'plain'
        WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        list_sum([length(x) FOR x IN u[1:least(d[1] % (n + 1), d[2] % (n + 1))]]) AS a,
        list_sum([length(x) FOR x IN u[1:greatest(d[1] % (n + 1), d[2] % (n + 1))]]) AS b
    FROM drawn
), parts AS (
    SELECT *, coalesce(a, 0)::BIGINT AS x, coalesce(b, 0)::BIGINT AS y FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || left(text, x) || '<S>' || substring(text, y + 1) || '<M>' || substring(text, x + 1, y - x)
        ELSE '<S>' || substring(text, y + 1) || '<P>' || left(text, x) || '<M>' || substring(text, x + 1, y - x) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
