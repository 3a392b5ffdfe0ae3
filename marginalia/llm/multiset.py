"""Homomorphic fingerprints: a text's is the sum of wide vectors that are hashed from its paragraphs.

A paragraph, which is a line or a sentence of a line, gives ``LANES`` bits of its SHA-256; the fingerprint counts, for
each lane, the paragraphs that have the bit, modulo ``MODULUS``, and the paragraphs modulo ``COUNTED``. So the order of paragraphs does not
matter, fingerprints of parts add up to that of the whole, and a paragraph is inserted or deleted without the rest of
the text. Lanes are packed four to a number with one bit between them, so one addition moves four. As the bits are
random signs, the product of two fingerprints estimates what the texts have in common.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import persisted, unused

#: What lies between line breaks and after ends of sentences.
PARAGRAPH = r"[^\x0A.!?]+[.!?]*|[.!?]+"
#: White space of ASCII, which does not count at a paragraph's ends.
SPACE = " \t\n\x0b\x0c\r"
#: Digits of the digest in a piece, pieces, lanes of a number, bits from lane to lane, and of a lane.
DIGITS, PIECES, PACKED, APART, BITS = 15, 4, 4, 15, 14
WORDS, MODULUS, COUNTED = PIECES * APART, 1 << BITS, 1 << 32
LANES = WORDS * PACKED
_ONES = sum(1 << APART * k for k in range(PACKED))
_KEPT = _ONES * (MODULUS - 1)
_GUARD = _ONES << BITS


def paragraphs(text: Column) -> Column:
    """Lines and sentences of a text, without white space around them and without blank ones."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.btrim(p, F.lit(SPACE))), lambda p: p != "")


def _hashed(found: Column) -> list[Column]:
    """Of each of a paragraph's pieces of digest the arrays of all paragraphs."""
    digest = F.transform(found, lambda p: F.sha2(p.cast("binary"), 256))
    piece = lambda k: F.transform(digest, lambda d: F.conv(F.substring(d, DIGITS * k + 1, DIGITS), 16, 10).cast("long"))
    return [piece(k) for k in range(PIECES)]


def fingerprints(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: a struct of ``n``, the paragraphs, and ``lanes``, the packed counts. A null text is an empty one."""
    found, names = unused(rows, "paragraphs_found"), [unused(rows, f"digest_{k}") for k in range(PIECES)]
    # columns of their own, so that paragraphs are cut and hashed once and not for each lane
    cut = rows.withColumn(found, paragraphs(F.coalesce(F.col(text), F.lit(""))))
    cut = cut.withColumns(dict(zip(names, _hashed(F.col(found)), strict=True)))
    zero = F.lit(0).cast("long")
    turn = lambda shift: lambda total, h: (total + F.shiftright(h, shift).bitwiseAND(F.lit(_ONES))).bitwiseAND(F.lit(_KEPT))
    lanes = F.array(*[F.aggregate(F.col(c), zero, turn(shift)) for c in names for shift in range(APART)])
    return cut.withColumn(out, F.struct(F.size(found).cast("long").alias("n"), lanes.alias("lanes"))).drop(found, *names)


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + y).bitwiseAND(F.lit(_KEPT)))
    return F.struct(F.pmod(a["n"] + b["n"], F.lit(COUNTED)).alias("n"), lanes.alias("lanes"))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    # the bits between lanes lend what a lane lacks
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + F.lit(_GUARD) - y).bitwiseAND(F.lit(_KEPT)))
    return F.struct(F.pmod(a["n"] - b["n"], F.lit(COUNTED)).alias("n"), lanes.alias("lanes"))


def summed(rows: DataFrame, by: list[str], fingerprint: str) -> DataFrame:
    """``by`` and the fingerprint of each group's texts together; sums are made before the shuffle."""
    lane = lambda k, j: F.pmod(F.sum(F.shiftright(F.col(fingerprint)["lanes"][k], APART * j).bitwiseAND(F.lit(MODULUS - 1))), F.lit(MODULUS))
    word = lambda k: reduce(Column.__add__, [lane(k, j) * F.lit(1 << APART * j) for j in range(PACKED)])
    lanes = F.array(*[word(k) for k in range(WORDS)])
    return rows.groupBy(*by).agg(F.struct(F.pmod(F.sum(F.col(fingerprint)["n"]), F.lit(COUNTED)).alias("n"), lanes.alias("lanes")).alias(fingerprint))


def encoded(fingerprint: Column) -> Column:
    """The fingerprint in hexadecimal: 8 digits of the paragraphs' number, then 15 for each four lanes."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(F.pmod(fingerprint["n"], F.lit(COUNTED)), 8), F.array_join(F.transform(fingerprint["lanes"], lambda w: digits(w, DIGITS)), ""))


def signs(fingerprint: Column) -> Column:
    """Of each lane the paragraphs with its bit less those without, as the nearest number to zero that it can be."""
    half, n = MODULUS // 2, fingerprint["n"]
    lane = lambda w, j: F.pmod(2 * F.shiftright(w, APART * j).bitwiseAND(F.lit(MODULUS - 1)) - n + half, F.lit(MODULUS)) - half
    return F.flatten(F.transform(fingerprint["lanes"], lambda w: F.array(*[lane(w, j) for j in range(PACKED)])))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x)


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a column for each of ``pairs``, from two columns of fingerprints: what both share by what either has.

    1 for equal fingerprints, else the lanes' product by the squares of both less the product, within 0 and 1: an
    estimate of the paragraphs in common by all of both, whose error is near ``1 / sqrt(LANES)`` at most.
    """
    used = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    own = {c: (unused(rows, f"signs_{k}"), unused(rows, f"square_{k}")) for k, c in enumerate(used)}
    wide = rows.withColumns({own[c][0]: signs(F.col(c)) for c in used})
    wide = wide.withColumns({own[c][1]: _product(F.col(own[c][0]), F.col(own[c][0])) for c in used})
    joint = {name: unused(rows, f"joint_{k}") for k, name in enumerate(pairs)}
    wide = wide.withColumns({joint[name]: _product(F.col(own[a][0]), F.col(own[b][0])) for name, (a, b) in pairs.items()})

    def likeness(name: str, a: str, b: str) -> Column:
        both = F.col(joint[name])
        return F.when(F.col(a) == F.col(b), 1.0).when(both <= 0, 0.0).otherwise(both / (F.col(own[a][1]) + F.col(own[b][1]) - both))

    # both squares less the product are at least the product
    return wide.withColumns({name: likeness(name, a, b) for name, (a, b) in pairs.items()}).drop(*[c for names in own.values() for c in names], *joint.values())


def followed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``key, n_chars, next_key`` of each different row of ``docs(<id>, key, text)`` in order of id: the first follows the last.

    Only keys are sorted: into ranges, within which a window finds the next; each range's last gets the first of
    the next range, which is a table of as many rows as there are ranges.
    """
    slim = docs.groupBy(F.col(id_col).alias("id"), "key", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("rows"))
    ordered = slim.repartitionByRange(F.asc_nulls_first("id"), "key").sortWithinPartitions(F.asc_nulls_first("id"), "key")
    ordered = persisted(ordered.select("id", "key", "n_chars", F.spark_partition_id().alias("range")), "order")
    firsts = ordered.groupBy("range").agg(F.min(F.struct("id", "key"))["key"].alias("first"))
    ranges = W.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges)).alias("then"))
    inside = F.lead("key").over(W.partitionBy("range").orderBy(F.asc_nulls_first("id"), "key"))
    return ordered.withColumn("inside", inside).join(firsts, "range").select("key", "n_chars", F.coalesce("inside", "then").alias("next_key"))


def edits(docs: DataFrame, part: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text and the fingerprints of both and of the next document.

    ``doc_id, text, n_chars, edited, own, changed, next_id, next`` for ``docs``: the last ``n_chars / part`` code points,
    rounded down, are replaced by the first as many of the next document in order of id, or by all of it. A null
    text is an empty one; null ids come first. Rows with equal ids are in an order that their texts set; rows with
    equal ids and texts are one document, whose row is there as often. Other columns are ignored. A single document
    follows itself; an empty table gives an empty result.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    order = persisted(followed(keyed), "followed")
    known = fingerprints(keyed, "text", "own")
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.floor(F.col("n_chars") / part).cast("int").alias("take"))
    # repeated rows bring the same beginning; it is kept once. Both joins read the same columns by key, so texts are shuffled once
    heads = known.join(wanted, "key").groupBy(F.col("before").alias("key")).agg(F.max("take").alias("take"), F.max(F.expr("substring(text, 1, take)")).alias("head"), F.max("own").alias("next"), F.max("doc_id").alias("next_id"))
    met = known.join(heads, "key").withColumn("n_chars", F.length("text").cast("long"))
    whole = met.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - take), head)"))
    return fingerprints(whole, "edited", "changed").select("doc_id", "text", "n_chars", "edited", "own", "changed", "next_id", "next")


def likenesses(docs: DataFrame) -> DataFrame:
    """Each document's and its edited text's fingerprint, and how alike it is to the edited text and to the next document."""
    near = with_likeness(edits(docs).drop("text"), {"near_edited": ("own", "changed"), "near_next": ("own", "next")})
    return near.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), encoded(F.col("own")).alias("fingerprint"), encoded(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next", "next_id")


#: The query in SQL: lanes one by one instead of packed, for ids that are different and not null.
LIKENESS_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
        coalesce(lead(coalesce(text, '')) OVER w, first(coalesce(text, '')) OVER w) AS next, coalesce(lead(doc_id) OVER w, first(doc_id) OVER w) AS next_id
    FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
    SELECT *, left(text, n_chars - n_chars // 4) || left(next, n_chars // 4) AS edited FROM d
), texts AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'changed', edited FROM e),
pieces AS (
    SELECT doc_id, kind, unnest(list_filter([trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR p IN regexp_extract_all(text, '[^\x0A.!?]+[.!?]*|[.!?]+')], lambda p: p <> '')) AS piece
    FROM texts
), digests AS (SELECT doc_id, kind, sha256(piece) AS h FROM pieces),
bits AS (
    SELECT doc_id, kind, k, j, sum((('0x' || substr(h, 15 * (k // 15) + 1, 15))::BIGINT >> (k % 15 + 15 * j)) & 1) % 16384 AS c
    FROM digests, range(60) t(k), range(4) u(j) GROUP BY ALL
), counted AS (SELECT doc_id, kind, count(*) AS n FROM digests GROUP BY ALL),
every AS (
    SELECT t.doc_id, t.kind, coalesce(c.n, 0) AS n, k, j, coalesce(b.c, 0)::BIGINT AS c
    FROM texts t CROSS JOIN range(60) a(k) CROSS JOIN range(4) u(j) LEFT JOIN counted c USING (doc_id, kind) LEFT JOIN bits b USING (doc_id, kind, k, j)
), lanes AS (
    SELECT doc_id, kind, n, list(((2 * c - n + 8192) % 16384 + 16384) % 16384 - 8192 ORDER BY k, j) AS s, list(c << (15 * j) ORDER BY k, j) AS w FROM every GROUP BY ALL
), coded AS (
    SELECT doc_id, kind, s, printf('%08x', n) || list_aggregate([lpad(printf('%x', w[4 * k + 1] + w[4 * k + 2] + w[4 * k + 3] + w[4 * k + 4]), 15, '0') FOR k IN range(60)], 'string_agg', '') AS f FROM lanes
), own AS (SELECT doc_id, s, f, coalesce(lead(s) OVER w, first(s) OVER w) AS next_s, coalesce(lead(f) OVER w, first(f) OVER w) AS next_f
    FROM coded WHERE kind = 'own' WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
products AS (
    SELECT o.doc_id, o.f, c.f AS cf, o.next_f AS nf, list_inner_product(o.s::DOUBLE[], o.s::DOUBLE[]) AS oo, list_inner_product(c.s::DOUBLE[], c.s::DOUBLE[]) AS cc,
        list_inner_product(o.next_s::DOUBLE[], o.next_s::DOUBLE[]) AS nn, list_inner_product(o.s::DOUBLE[], c.s::DOUBLE[]) AS oc, list_inner_product(o.s::DOUBLE[], o.next_s::DOUBLE[]) AS one
    FROM own o JOIN coded c ON c.doc_id = o.doc_id AND c.kind = 'changed'
)
SELECT e.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, f AS fingerprint, cf AS edited_fingerprint,
    CASE WHEN f = cf THEN 1.0 WHEN oc <= 0 THEN 0.0 ELSE oc / (oo + cc - oc) END::DOUBLE AS near_edited,
    CASE WHEN f = nf THEN 1.0 WHEN one <= 0 THEN 0.0 ELSE one / (oo + nn - one) END::DOUBLE AS near_next, next_id
FROM e JOIN products USING (doc_id)
"""
