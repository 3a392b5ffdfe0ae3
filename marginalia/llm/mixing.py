"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations alone.

Each source's documents are shuffled by a hash and laid end to end, which cuts the source into blocks
of equal words. Golden-ratio points mapped through the cumulative target shares deal slots to the
sources; the k-th slot of a source takes its k-th block, going round a second time where the target
asks for it. The mix is read in the order of the slots: :func:`mix` tells each document's first one,
:func:`repeated` gives the documents in their order. Ranks and positions are two-level prefix sums, so no
source has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, persisted, unused

#: Fraction of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots whose ranks one task counts together.
_RUN = 4096
#: Cells of the unit interval by which points find their source.
_CELLS = 1024


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sid, source, source_size, target, quota`` for each source of ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. Targets are ``least(repeats * size,
    level * weight)``: the level at which they sum to ``share`` of all words, which is where resharing
    the excess by weight ends. It is the largest of the levels that result from taking out the sources
    by rising size to weight. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1).alias("sid")
    numbered = totals.select(sid, "source", "source_size")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * repeats
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    level = F.max("level").over(every)
    target = F.least((F.col("source_size") * repeats).cast("double"), level * F.col("weight"))
    return levels.select("sid", "source", "source_size", target.alias("target")).withColumn("quota", F.floor("target").cast("long"))


def positions(sizes: DataFrame, seed: int = 0, per_bucket: int = 2048) -> DataFrame:
    """``sizes`` with ``at``: the words before a row in its source, in an order shuffled by a hash of ``doc_id``; ties by size and ``row``.

    Running sums within hash buckets of a source start at the sum of the buckets before; the number of
    buckets follows the number of rows, so that none holds many.
    """
    buckets = 1 << min(27, (sizes.count() // per_bucket).bit_length())
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    keyed = sizes.withColumn("key", key).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    run = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("sum").over(run), F.lit(0)).alias("start"))
    inner = W.partitionBy("sid", "bucket").orderBy("key", "size", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    return keyed.join(starts, ["sid", "bucket"]).withColumn("at", at).drop("key", "bucket", "start")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """``slot, sid, rank``: which source's how-manieth block each slot takes.

    ``plan(sid, target, quota)``. Slot i holds the point frac((i+1) * golden ratio). Points fall to
    each source in proportion, but for a few; slots beyond a source's quota are left out, and what it
    then lacks follows at the end, so that each source's ranks are exactly those its quota asks for.
    """
    needs = plan.select("sid", "target", F.ceil(F.col("quota") / block).cast("long").alias("slots")).where("slots > 0")
    n = needs.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) / F.sum("target").over(every)
    ends = needs.select("sid", "slots", upto.alias("high"))
    spans = ends.select("sid", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0.0)).alias("low"), F.when(F.lead("sid").over(W.orderBy("sid")).isNull(), F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    last = F.least(F.lit(_CELLS - 1), F.floor(F.col("high") * _CELLS).cast("int"))
    cells = persisted(spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _CELLS).cast("int"), last))), "cells")
    # in two parts, to keep the fraction exact for large slot numbers
    i, step = F.col("id") + 1, 1 << 26
    point = F.floor(i / step) * (GOLDEN * step % 1) + i % step * GOLDEN
    points = cells.sparkSession.range(n).select("id", F.floor(F.col("id") / _RUN).alias("run"), (point - F.floor(point)).alias("u"))
    dealt = points.withColumn("cell", F.floor(F.col("u") * _CELLS).cast("int")).join(cells, "cell").where("u >= low AND u < high").select("id", "run", "sid")
    counts = dealt.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("sid", "run", before.alias("start"))
    rank = F.col("start") + F.row_number().over(W.partitionBy("sid", "run").orderBy("id")) - 1
    ranked = dealt.join(starts, ["sid", "run"]).select(F.col("id").alias("slot"), "sid", rank.alias("rank"))
    kept = ranked.join(needs.select("sid", "slots"), "sid").where("rank < slots").select("slot", "sid", "rank")
    got = needs.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").selectExpr("sid", "slots", "coalesce(got, 0L) AS got").where("got < slots")
    late = got.select((F.lit(n) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    return kept.unionByName(late)


def _placed(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, source, size, row)`` with their places and their sources' targets, and the schedule of the sources' blocks."""
    raw = persisted(rows, "sizes")
    plan = persisted(targets(raw, weights, share, repeats), "targets")
    sizes = raw.join(plan, raw["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "row", "sid", "source_size", "target", "quota")
    return persisted(positions(sizes, seed), "positions"), schedule(plan, block)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block: int = 2048, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, first_slot``.

    ``size`` counts words (null text: 0), ``target`` is the words that the mix takes of the document's
    source, ``taken`` those it takes of the document, repeats counted; a source's ``taken`` sums to the
    whole part of its target. ``first_slot`` is the slot that takes the document's first word; null where none
    is taken. A null source is a source of its own, the last. Rows whose ids are null or repeat are rows of
    their own. Texts without words are taken with no words. Columns besides ``doc_id, text, source`` are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(None).cast("binary").alias("row"))
    placed, slots = _placed(rows, weights, share, repeats, block, seed)
    laps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("lap")
    spread = placed.where("size > 0").select("sid", "at", "size", "quota", (F.col("source_size")).alias("around"), laps).withColumn("low", F.col("at") + F.col("lap") * F.col("around")).where("low < quota")
    high = F.least(F.col("low") + F.col("size"), F.col("quota"))
    blocks = F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((high - 1) / block))).alias("rank")
    parts = spread.withColumn("high", high).select("sid", "at", "low", "high", blocks)
    overlap = F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)
    taken = parts.join(slots, ["sid", "rank"]).groupBy("sid", "at").agg(F.sum(overlap).alias("taken"), F.min("slot").alias("first_slot"))
    worded = placed.where("size > 0").join(taken, ["sid", "at"], "left")
    wordless = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    return worded.unionByName(wordless).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block: int = 2048, seed: int = 0) -> DataFrame:
    """The documents in the order of the mix, each once for every time that the mix begins to take its words; columns as ``docs``.

    A time that the mix takes but the first words of a document gives it whole. Rows without words use up nothing
    of a target and come once, where their source's order has them, or last. Rows with null or repeated ids are rows
    of their own; equal rows stand for each other. An empty table gives no rows. Columns may have any names.
    """
    own = unused(docs, "_row")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).cast("binary"))))
    rows = keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col(own).alias("row"))
    placed, slots = _placed(rows, weights, share, repeats, block, seed)
    laps = F.sequence(F.lit(0), F.when(F.col("size") > 0, repeats - 1).otherwise(0))
    begun = placed.select("row", "sid", "at", "size", "quota", "source_size", F.explode(laps).alias("lap"))
    begun = begun.withColumn("low", F.col("at") + F.col("lap") * F.col("source_size")).where("size = 0 OR low < quota")
    begun = begun.withColumn("rank", F.floor(F.greatest(F.least("low", F.col("quota") - 1), F.lit(0)) / block))
    order = [unused(docs, name) for name in ("_slot", "_source", "_place")]
    starts = begun.join(slots, ["sid", "rank"], "left").select(F.col("row").alias(own), *[F.col(c).alias(n) for c, n in zip(("slot", "sid", "low"), order, strict=True)])
    every = keyed.dropDuplicates([own]).join(starts, own)
    return every.orderBy(F.col(order[0]).asc_nulls_last(), order[1], order[2], own).select(docs.columns)


#: DuckDB SQL for :func:`mix` over ``documents`` with its defaults (a block has 2048 words).
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS sid FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT sid, source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
needs AS (SELECT sid, target, ceil(floor(target) / 2048)::BIGINT AS slots FROM targets WHERE floor(target) > 0),
shares AS (SELECT sid, sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM needs),
spans AS (SELECT sid, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low, CASE WHEN lead(sid) OVER (ORDER BY sid) IS NULL THEN 2 ELSE high END AS high FROM shares),
points AS (SELECT i AS slot, (i + 1) * 0.6180339887498949::DOUBLE % 1 AS u FROM (SELECT unnest(range((SELECT coalesce(sum(slots), 0)::BIGINT FROM needs))) AS i)),
dealt AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points JOIN spans ON u >= low AND u < high),
late AS (SELECT sid, unnest(range((SELECT count(*) FROM dealt d WHERE d.sid = n.sid), slots)) AS rank FROM needs n),
schedule AS (
  SELECT d.sid, d.rank, d.slot FROM dealt d JOIN needs n ON n.sid = d.sid AND d.rank < n.slots
  UNION ALL SELECT sid, rank, (SELECT sum(slots) FROM needs) + sid - 1 FROM late),
placed AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(pos + size, quota) - pos) + greatest(0, least(pos + source_size + size, quota) - pos - source_size))::BIGINT AS taken,
       slot::BIGINT AS first_slot
FROM placed p LEFT JOIN schedule s ON s.sid = p.sid AND s.rank = p.pos // 2048 AND p.pos < p.quota AND p.size > 0
"""
