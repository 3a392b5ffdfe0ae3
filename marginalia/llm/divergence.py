"""Audit of sources: how far the word frequencies of a language's sources lie apart, and which words set a source off.

Tasks count terms by (language, source). A language's frequent terms are cut into blocks; each block is one dense
tile, groups by terms, in which all pairs of groups are compared by broadcasting. Pair sums and best terms of the
tiles are put together by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted

#: Runs of letters of ASCII and of all characters beyond it, in bytes of UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries that a task counts before it passes them on, and words of a text that are taken at once.
HELD, WORDS = 400_000, 100_000
#: Terms of a block, cells of a tile, and cells of a broadcast difference, at most.
BLOCK, CELLS, SPREAD = 1024, 1 << 20, 1 << 22
#: Frequencies are parts of 10 ** 9, made in three steps of this factor, so that no step leaves 64 bits.
STEP, STEPS = 1000, 3
#: What is added to each count.
PRIOR = 5


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, uses, docs`` by task: occurrences and documents of each term, and a row with the empty term for each document's group."""
    read = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(read("lang").alias("lang"), read("source").alias("source"), read("text").cast("binary").alias("text"))
    schema = "lang string, source string, term string, uses long, docs long"
    names = [x.split()[0] for x in schema.split(", ")]

    def passed_on(uses: dict, in_docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in in_docs.items():
            n = len(terms)
            if n:
                own = uses[lang, source]
                values = [pa.array([lang] * n), pa.array([source] * n), pa.array([t.decode() for t in terms]), pa.array([own.get(t, 0) for t in terms], pa.int64()), pa.array(terms.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict = {}
        in_docs: dict = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                group = lang.as_py(), source.as_py()
                own, own_docs = uses.setdefault(group, Counter()), in_docs.setdefault(group, Counter())
                found, seen = TERM.finditer(text.as_py().lower()), {b""}
                while lot := [m.group() for m in islice(found, WORDS)]:
                    own.update(lot)
                    seen.update(lot)
                own_docs.update(seen)
            if sum(map(len, in_docs.values())) > HELD:
                yield from passed_on(uses, in_docs)
                uses.clear()
                in_docs.clear()
        yield from passed_on(uses, in_docs)

    return rows.mapInArrow(run, schema)


def parts_of(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(10 ** 9 * (count + PRIOR) / (total + PRIOR * terms))``, exact for totals up to 9 * 10 ** 15."""
    whole = total + PRIOR * terms
    part, left = np.divmod(count + PRIOR, whole)
    for _ in range(STEPS):
        more, left = np.divmod(left * STEP, whole)
        part = part * STEP + more
    return 1 + part


def _tile(table: pa.Table, keep: int) -> pa.Table:
    """Pair sums and best terms of one block of a language.

    Rows without term are the language's groups, all of them, with their totals in ``uses`` and the language's
    terms in ``terms``; the others are the counts that are not zero.
    """
    lang, of_group = table.column("lang")[0].as_py(), table.column("term").is_null()
    groups = table.filter(of_group).sort_by("source")
    cells = table.filter(pa.compute.invert(of_group))
    sources, totals = groups.column("source").to_pylist(), groups.column("uses").to_numpy()
    terms = sorted({t.encode() for t in cells.column("term").to_pylist()})
    row, col = {s: k for k, s in enumerate(sources)}, {t: k for k, t in enumerate(terms)}
    count = np.zeros((len(sources), len(terms)), np.int64)
    count[[row[s] for s in cells.column("source").to_pylist()], [col[t.encode()] for t in cells.column("term").to_pylist()]] = cells.column("uses").to_numpy()
    vocabulary = groups.column("terms")[0].as_py()
    p = parts_of(count, totals[:, None], vocabulary) if terms else count
    q = parts_of(count.sum(0), totals.sum(), vocabulary) if terms else count.sum(0)

    apart = np.empty((len(sources), len(sources)), np.int64)
    lot = max(1, SPREAD // max(1, len(sources) * len(terms)))
    for k in range(0, len(sources), lot):
        apart[k : k + lot] = np.abs(p[k : k + lot, None, :] - p[None, :, :]).sum(2)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    out = [("pair", sources[i], sources[j], v) for i, j, v in zip(a, b, apart[a, b].tolist(), strict=True)]
    for i, source in enumerate(sources):
        more = np.flatnonzero((count[i] > 0) & (p[i] > q))
        # terms are in order, so that a stable sort leaves ties in it
        best = more[np.argsort(-(p[i] - q)[more], kind="stable")][:keep]
        out += [("term", source, terms[k].decode(), int(p[i, k] - q[k])) for k in best]
    part, source, item, value = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, least_docs: int = 30, keep: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each (language, source) of ``docs(text, lang, source)``.

    Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those in
    ``least_docs`` of its documents. A term's frequency in a group is in parts of 10 ** 9, each count raised by
    ``PRIOR``, in integers. Part ``pair``: the sum of differences to each other source of the language. Part
    ``term``: the ``keep`` terms of the group that exceed the language's frequency by the most. Ranks are from 1,
    by falling value, then by the item's bytes.

    Null texts, languages and sources are empty ones. Groups without terms, and languages without a kept term,
    have their pairs all the same (with value 0 in the latter case); a language's only source has none. Repeated
    rows count as often as they are there; other columns are ignored. An empty table gives an empty result.
    """
    counts = persisted(counted(docs).groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    cells = persisted(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "uses"), "term-cells")
    groups = counts.where("term = ''").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("uses").alias("uses")), ["lang", "source"], "left")
    # a row for each language
    shape = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.col("sources"))))
    shape = persisted(shape.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / width)).cast("int").alias("blocks")), "languages")
    every = groups.join(shape, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.coalesce("uses", F.lit(0)).alias("uses"), "terms")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    dealt = cells.join(shape, "lang").select("lang", block.alias("block"), "source", "term", "uses", "terms")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "part", "item")] + [T.StructField("value", T.LongType())])
    tiles = every.unionByName(dealt).groupBy("lang", "block").applyInArrow(lambda table: _tile(table, keep), schema)
    # a pair's tiles are summed; a term is in one tile
    whole = tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= keep))


#: The query in SQL.
DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), tokens AS (SELECT n, lang, source, unnest(terms) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS uses, count(DISTINCT n) AS docs FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, sum(uses) AS uses FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
shape AS (SELECT lang, count(*)::HUGEINT AS v, sum(uses)::HUGEINT AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
    SELECT g.lang, g.source, k.term, k.uses AS lang_uses, coalesce(c.uses, 0) AS uses
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sized AS (SELECT *, sum(uses) OVER (PARTITION BY lang, source)::HUGEINT AS own FROM cells),
p AS (
    SELECT lang, source, term, uses, (1 + (1000000000 * (uses + 5)::HUGEINT) // (own + 5 * v))::BIGINT AS p,
        (1 + (1000000000 * (lang_uses + 5)::HUGEINT) // (total + 5 * v))::BIGINT AS q
    FROM sized JOIN shape USING (lang)
), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every AS (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE uses > 0 AND p > q
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""
