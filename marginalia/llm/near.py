"""Near copies by the Jaccard similarity of word shingles: SimHash ball hashing finds candidates, whole texts verify them.

A text's shingles give 16 anchored fingerprints: 16 bits of SimHash behind an anchor, the hash of two minima of
the shingles. Two texts of similarity s have an anchor in common with probability s², and differ there in at most
two bits, which ball hashing finds, with 0.55 at s = 0.8: over 16 parts 0.999 at 0.8, more above. The anchor keeps
the number of chance meetings from growing with the corpus, however short the fingerprint. Pairs found are compared
by 384 bits of SimHash, then as whole texts, but for those already connected. Texts that are equal but for case and
white space are merged beforehand.

A large group of texts that have a passage in common, or of copies that are changed too much, would make as many
pairs as its square. So each text first counts its shingles that texts of other components have as well. They bound
its similarity to any of them, and a text that cannot reach the least similarity meets none. Texts that resemble each
other at about 0.7 can have all their shingles from others and pass; so those that are left get an odd sketch, whose
differing bits are at most the shingles that only one of two texts has. Where texts meet, a pair becomes a row only
if that bound allows the similarity, too; like the first, it leaves out no similar pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop_written, first_of_each, persisted, unused, written
from .simhash import ball_pairs, bit_counts

#: Anchored fingerprints of a text, bits of each, minima in an anchor, and 64-bit words of SimHash in all.
PARTS, PART_BITS, MINIMA, WORDS = 16, 16, 2, 6
#: Differing bits of all words up to which a pair is verified: over four standard deviations above the mean at 0.8.
FAR = 104
#: 64-bit words of an odd sketch, a power of two: its bound is close to the truth for texts of up to about as many shingles as it has bits, and weaker for longer ones.
ODD_WORDS = 32
#: Shingles worked on at once; bounds memory on very long texts.
_BLOCK = 4096
#: Shingles that a task holds, or hands back at once, beside those of one text; rows of signed texts handed back at once.
HELD, PIECE = 1 << 18, 512
_RNG = np.random.default_rng(42)
_MULTIPLY, _ADD = (_RNG.integers(0, 1 << 64, (PARTS * MINIMA + WORDS, 1), np.uint64) for _ in range(2))
_MULTIPLY |= np.uint64(1)
_ODD, _HALF, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(32), np.uint64(29)


def _folded(parts: Iterator[np.ndarray], start: np.ndarray) -> np.ndarray:
    """One hash of each row of hashes, in order."""
    for part in parts:
        start = (start ^ (start >> _THIRD)) * _ODD + part
    start = (start ^ (start >> _HALF)) * _ODD
    return start ^ (start >> _THIRD)


def words_of(text: str | None) -> list[bytes]:
    """Words, parted by ASCII white space, A-Z in small letters; null: none."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; fewer words are one shingle, none have none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    total = len(words) - width + 1
    return np.unique(_folded((hashes[k : k + total] for k in range(width)), np.full(total, width, np.uint64)))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchored fingerprints and the words of SimHash of a set of shingles, as signed integers; of an empty set: none."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least, counts = np.full(PARTS * MINIMA, (1 << 64) - 1, np.uint64), 0
    for at in range(0, len(found), _BLOCK):
        mixed = found[None, at : at + _BLOCK] * _MULTIPLY + _ADD
        least = np.minimum(least, mixed[: PARTS * MINIMA].min(1))
        spread = (mixed[PARTS * MINIMA :] ^ (mixed[PARTS * MINIMA :] >> _HALF)) * _ODD
        counts = counts + bit_counts(np.ascontiguousarray((spread ^ (spread >> _THIRD)).T))
    words = np.packbits(counts * 2 > len(found)).view(np.uint64)
    minima = least.reshape(PARTS, MINIMA)
    anchors = _folded((minima[:, k] for k in range(MINIMA)), np.arange(PARTS, dtype=np.uint64))
    low = np.uint64((1 << PART_BITS) - 1)
    return ((anchors & ~low) | words.view(np.uint16)[:PARTS].astype(np.uint64)).view(np.int64), words.view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bits that an odd number of a set of shingles falls on, as signed integers: what is in both of two sets falls on equal bits twice, so sketches differ in at most as many bits as there are shingles in one set only."""
    bits = ODD_WORDS * 64
    return np.packbits(np.bincount(found & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; of two empty ones: 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of SimHash words."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _reaches(shared: Column, n: Column, other: Column, least: float) -> Column:
    """Whether sets of ``n`` and ``other`` shingles with at most ``shared`` in common can have the similarity."""
    most = F.least(shared, n, other)
    return most >= (n + other - most) * least


def _alike(a: str, b: str, least: float, counted: bool = False) -> Column:
    """Whether sizes and SimHash bits of two structs ``n, sketch`` (if ``counted`` also ``shared`` shingles and sketches ``odd``) allow the similarity."""
    n, other = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = _reaches(F.least(f"{a}.shared", f"{b}.shared") if counted else F.least(n, other), n, other, least)
    fits = fits & (_distance(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) <= FAR)
    if not counted:
        return fits
    # not a sum of its words as code of their own, which would be too much of it for Java to compile
    apart = F.aggregate(F.zip_with(f"{a}.odd", f"{b}.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return fits & _reaches((n + other - apart) / 2, n, other, least)


def _anchor(code: Column) -> Column:
    return code.bitwiseAND(F.lit(-(1 << PART_BITS)))


def best_centres(met: DataFrame, crowds: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: for each text ``b`` of ``met(code, own)`` the closest among the centres of its anchors.

    ``crowds(anchor, texts)`` are the anchors of several texts; an anchor's centre is that text of it which meets
    most others over all anchors, in a group of copies one near the original.
    """
    placed = met.select(_anchor(F.col("code")).alias("anchor"), "own").join(crowds, "anchor")
    company = placed.groupBy(F.col("own._key").alias("_key")).agg(F.sum("texts").alias("company"))
    known = placed.join(company, F.col("own._key") == F.col("_key")).select("anchor", "own", "company")
    centres = known.groupBy("anchor").agg(F.max(F.struct("company", "own")).alias("first")).select("anchor", F.col("first.own").alias("centre"))
    pairs = placed.join(centres, "anchor").where("own._key != centre._key").where(_alike("own", "centre", least))
    far = _distance(F.col("own.sketch"), F.col("centre.sketch"))
    return pairs.groupBy(F.col("own._key").alias("b")).agg(F.min(F.struct(far.alias("far"), F.col("centre._key").alias("a"))).alias("best")).select("best.a", "b")


def _tag(component: str = "component") -> Column:
    return F.xxhash64(component)


def _meeting(rows: DataFrame) -> DataFrame:
    """Of ``rows(anchor, own, component, ...)`` those at whose anchor another component has a text small enough for
    ``own.reach``, the most shingles of a similar text, and one whose own reach is as far as ``own.n``."""
    sides = rows.groupBy("anchor", _tag().alias("tag")).agg(F.min("own.n").alias("n"), F.max("own.reach").alias("reach"))
    first = sides.groupBy("anchor").agg(F.min(F.struct("n", "tag")).alias("small"), F.max(F.struct("reach", "tag")).alias("far"))
    both = sides.join(first, "anchor").groupBy("anchor", "small", "far").agg(F.min(F.when(F.col("tag") != F.col("small.tag"), F.col("n"))).alias("small2"), F.max(F.when(F.col("tag") != F.col("far.tag"), F.col("reach"))).alias("far2"))
    met = rows.join(both, "anchor")
    small = F.when(_tag() != F.col("small.tag"), F.col("small.n")).otherwise(F.col("small2"))
    far = F.when(_tag() != F.col("far.tag"), F.col("far.reach")).otherwise(F.col("far2"))
    return met.where((F.col("own.reach") >= small) & (F.col("own.n") <= far)).select(rows.columns)


def shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``shingle, _key, tag`` of batches ``_key, tag, text``, a piece at a time: a batch of long texts has many times its bytes of shingles."""

    def piece(batch: pa.RecordBatch, first: int, found: list[np.ndarray]) -> pa.RecordBatch:
        rows = pa.array(np.repeat(np.arange(first, first + len(found)), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], ["shingle", "_key", "tag"])

    for batch in batches:
        first, found, held = 0, [], 0
        for i, text in enumerate(batch.column(2)):
            found.append(shingles(words_of(text.as_py()), width))
            held += len(found[-1])
            if held >= HELD:
                yield piece(batch, first, found)
                first, found, held = i + 1, [], 0
        if held:
            yield piece(batch, first, found)


def odd_sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``_key, odd`` of batches ``_key, text``, a piece at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            batch = whole.slice(at, PIECE)
            odd = [odd_sketch(shingles(words_of(text.as_py()), width)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], ["_key", "odd"])


def within_reach(met: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The rows of ``met(code, own, component)`` whose text can be similar to one of another component there; ``own`` gets ``shared``, ``reach`` and ``odd``.

    ``shared`` counts a text's shingles that a text of another component has, of those that share an anchor with
    another component at all; ``reach`` is the most shingles that a text similar to it can have; ``odd`` is the odd sketch.
    """
    mark = written()
    anchored = met.withColumn("anchor", _anchor(F.col("code")))
    mixed = anchored.groupBy("anchor").agg(F.min(_tag()).alias("lo"), F.max(_tag()).alias("hi")).where("lo != hi").select("anchor")
    live = persisted(anchored.join(mixed, "anchor", "left_semi").select("anchor", "code", "own", "component"), "live")
    keys = live.select("own._key", _tag().alias("tag")).distinct()

    runs = persisted(texts.join(keys, "_key").select("_key", "tag", "text").mapInArrow(lambda batches: shingled(batches, width), "shingle long, _key binary, tag long"), "shingles")
    both = runs.groupBy("shingle").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo != hi").select("shingle")
    counts = runs.join(both, "shingle", "left_semi").groupBy("_key").agg(F.count("*").alias("shared"))
    reach = (F.floor(F.col("shared") * ((1 + least) / least) + 1e-6) - F.col("own.n")).alias("reach")
    counted = live.join(counts, F.col("own._key") == F.col("_key")).withColumn("own", F.struct("own._key", "own.n", "shared", reach, "own.sketch")).select(live.columns)
    reaching = persisted(_meeting(persisted(_meeting(persisted(counted, "live")), "live")), "live")
    left = reaching.select("own._key").distinct()
    odd = persisted(texts.join(left, "_key").select("_key", "text").mapInArrow(lambda batches: odd_sketches(batches, width), "_key binary, odd array<bigint>"), "odd")
    sketched = reaching.join(odd, F.col("own._key") == F.col("_key")).withColumn("own", F.struct("own.*", "odd")).select(reaching.columns)
    kept = persisted(sketched, "live")
    drop_written(met.sparkSession, mark)
    return kept


def candidates(met: DataFrame, least: float, one_each: bool = False) -> DataFrame:
    """Pairs ``(a, b, ca, cb, far)`` of texts of ``met(anchor, code, own, component)`` in unlike components ``ca`` and ``cb``
    that have an anchor in common and differ in at most two bits of the fingerprint behind it.

    Only fingerprints at anchors where texts can reach another component are emitted with their variants, so a
    group of copies that is connected costs nothing. Pairs of fingerprints are made from the at most 17 that meet
    at a variant, then of the components there, then of their texts, each only where sizes and reaches allow it, and
    sketches, too, as soon as a component has but one text at its fingerprint; with ``one_each`` one text stands for all of its component that have a fingerprint.
    """
    mark = written()
    live = _meeting(met)
    live = persisted(live.groupBy("code", "component").agg(F.min("own").alias("own")) if one_each else live.select("code", "own", "component"), "live")
    parts = persisted(live.groupBy("code", "component").agg(F.min("own.n").alias("n"), F.max("own.reach").alias("reach"), F.when(F.count("*") == 1, F.min("own")).alias("only")), "parts")
    codes = persisted(parts.groupBy("code").agg(F.min(_tag()).alias("lo"), F.max(_tag()).alias("hi"), F.min("n").alias("n"), F.max("reach").alias("reach")), "codes")
    fits = lambda a, b: (F.col(f"{a}_n") <= F.col(f"{b}_reach")) & (F.col(f"{b}_n") <= F.col(f"{a}_reach"))
    side = lambda c: codes.select(F.col("code").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("lo", "hi", "n", "reach")])
    near = ball_pairs(codes.select("code"), PART_BITS).join(side("u"), "u").join(side("w"), "w").where(fits("u", "w")).where("u_lo != u_hi OR w_lo != w_hi OR u_lo != w_lo").select("u", "w")
    near = near.unionByName(codes.where("lo != hi").select(F.col("code").alias("u"), F.col("code").alias("w")))
    part = lambda code, c: parts.select(F.col("code").alias(code), F.col("component").alias(c), F.col("n").alias(f"{c}_n"), F.col("reach").alias(f"{c}_reach"), F.col("only").alias(f"{c}_only"))
    near = near.join(part("u", "cx"), "u").join(part("w", "cy"), "w").where("cx != cy AND (u != w OR cx < cy)").where(fits("cx", "cy"))
    near = near.where(F.col("cx_only").isNull() | F.col("cy_only").isNull() | _alike("cx_only", "cy_only", least, counted=True)).drop("cx_only")
    text = lambda code, c, own: live.select(F.col("code").alias(code), F.col("component").alias(c), F.col("own").alias(own))
    pairs = near.join(text("u", "cx", "x"), ["u", "cx"]).where("x.n <= cy_reach AND x.reach >= cy_n")
    pairs = pairs.where(F.col("cy_only").isNull() | _alike("x", "cy_only", least, counted=True)).drop("cy_only")
    pairs = pairs.join(text("w", "cy", "y"), ["w", "cy"]).where(_alike("x", "y", least, counted=True))
    first = F.col("x._key") < F.col("y._key")
    ends = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("a", "x._key", "y._key"), ("b", "y._key", "x._key"), ("ca", "cx", "cy"), ("cb", "cy", "cx"))]
    found = persisted(pairs.select(*ends, _distance(F.col("x.sketch"), F.col("y.sketch")).alias("far")).distinct(), "pairs")
    drop_written(met.sparkSession, mark)
    return found


def closest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b, ca, cb, far)`` for each text the closest in each other component."""
    ways = F.inline(F.array(F.struct(F.col("a").alias("text"), F.col("cb").alias("to"), "far", "a", "b", "ca", "cb"), F.struct(F.col("b").alias("text"), F.col("ca").alias("to"), "far", "a", "b", "ca", "cb")))
    return pairs.select(ways).groupBy("text", "to").agg(F.min(F.struct("far", "a", "b", "ca", "cb")).alias("best")).select("best.a", "best.b", "best.ca", "best.cb").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The ``pairs(a, b, ...)`` whose whole texts are similar enough. ``texts(_key, text)`` has a row for each key."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, texts_a, texts_b = (batch.column(name) for name in ("a", "b", "text_a", "text_b"))
            known, held, take = {}, 0, []
            for i in range(batch.num_rows):
                if held >= HELD:
                    known, held = {}, 0
                sets = []
                for key, text in ((a[i].as_py(), texts_a[i]), (b[i].as_py(), texts_b[i])):
                    if key not in known:
                        known[key] = shingles(words_of(text.as_py()), width)
                        held += len(known[key])
                    sets.append(known[key])
                take.append(similarity(*sets) >= least)
            yield batch.select(columns).filter(pa.array(take, pa.bool_()))

    columns = pairs.columns
    left = texts.select(F.col("_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("_key").alias("b"), F.col("text").alias("text_b"))
    return persisted(pairs.join(left, "a").join(right, "b").select(*columns, "text_a", "text_b").mapInArrow(similar, pairs.schema), "links")


def _joined(named: DataFrame, edges: DataFrame) -> DataFrame:
    """``named(_key, ..., component)`` after the components that ``edges(a, b)`` connect have become one."""
    mark = written()
    labels = components(edges).withColumnRenamed("node", "component")
    found = persisted(named.join(labels, "component", "left").withColumn("component", F.coalesce("label", "component")).select(named.columns), "components")
    drop_written(named.sparkSession, mark)
    return found


def classes(rows: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """``_key, rep, component`` of the distinct texts of ``rows(doc_id, text, _key, n, codes, sketch)``; ``rep`` is the
    smallest id of a key, ``component`` the same for texts that links of similarity connect.

    A text is first compared with the closest of its anchors' centres, then, where it can reach one, with the closest
    that stands for each other component it meets, then with the closest of all in each, then with all that are left.
    """
    merged = rows.groupBy("_key").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n", "codes", "sketch")).alias("s"))
    every = persisted(merged.select("_key", "rep", "s.n", "s.codes", "s.sketch"), "classes")
    met = every.select(F.explode("codes").alias("code"), F.struct("_key", "n", "sketch").alias("own"))

    # whatever is compared has an anchor in common with another text
    crowds = persisted(met.groupBy(_anchor(F.col("code")).alias("anchor")).agg(F.count("*").alias("texts")).where("texts > 1"), "anchors")
    wanted = met.select(_anchor(F.col("code")).alias("anchor"), "own._key").join(crowds, "anchor", "left_semi").select("_key").distinct()
    texts = persisted(rows.select("_key", "text").join(wanted, "_key", "left_semi").dropDuplicates(["_key"]), "texts")

    named = every.select("_key", "rep", F.col("_key").alias("component"))
    named = _joined(named, verified(persisted(best_centres(met, crowds, least), "pairs"), texts, least, width))
    with_component = lambda df: df.drop("component").join(named.select("_key", "component"), F.col("own._key") == F.col("_key")).drop("_key")
    live = within_reach(with_component(met), texts, least, width)
    placed = lambda: with_component(live)
    edges = lambda links: links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    done = persisted(closest(candidates(placed(), least, one_each=True)), "pairs")
    named = _joined(named, edges(verified(done, texts, least, width)))
    left = persisted(candidates(placed(), least).join(done, ["a", "b"], "left_anti"), "pairs")
    if left.isEmpty():
        return named
    done = persisted(closest(left), "pairs")
    close = _joined(named, edges(verified(done, texts, least, width)))
    now = named.select("component", "_key").join(close.select("_key", F.col("component").alias("now")), "_key").groupBy("component").agg(F.first("now").alias("now"))
    renamed = lambda df, c: df.join(now.select(F.col("component").alias(c), F.col("now").alias(f"{c}_now")), c)
    rest = renamed(renamed(left.join(done, ["a", "b"], "left_anti"), "ca"), "cb").where("ca_now != cb_now")
    rest = persisted(rest.select("a", "b", F.col("ca_now").alias("ca"), F.col("cb_now").alias("cb")), "pairs")
    return close if rest.isEmpty() else _joined(close, edges(verified(rest, texts, least, width)))


def signatures(batches: Iterator[pa.RecordBatch], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with ``names`` beside their columns, a piece at a time."""
    longs = pa.list_(pa.int64())
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            batch = whole.slice(at, PIECE)
            keys, sizes, codes, sketches = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                own = shingles(words, width)
                found = signature(own)
                keys.append(hashlib.md5(b" ".join(words)).digest())
                sizes.append(len(own))
                codes.append(found[0])
                sketches.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(codes, longs), pa.array(sketches, longs)], [*batch.schema.names, *names])


def signed(docs: DataFrame, width: int, names: list[str]) -> DataFrame:
    """``docs`` with ``names``: MD5 of a text's words, their number of shingles, anchored fingerprints and words of SimHash."""

    longs = T.ArrayType(T.LongType())
    kinds = [T.BinaryType(), T.LongType(), longs, longs]
    return docs.mapInArrow(lambda batches: signatures(batches, width, names), T.StructType([*docs.schema, *[T.StructField(*f) for f in zip(names, kinds, strict=True)]]))


def keep_first(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """The documents without near copies: of each component of texts at least ``least`` similar one row with the smallest id stays.

    Similarity is that of the sets of ``width``-word shingles, words being parted by white space and compared
    without ASCII case. Null texts and texts without words are copies of one another; texts of fewer words than a
    shingle are copies only of equal ones. Rows are judged one by one, whatever their ids; of equal rows one stays.
    Rows of a component without any id stay. Very long texts are compared whole. An empty table gives an empty
    result. Columns are those of ``docs``, whatever their names.
    """
    names = [unused(docs, name) for name in ("_key", "_n", "_codes", "_sketch")]
    rows = persisted(signed(docs, width, names), "signed")
    found = classes(rows.select("doc_id", "text", *[F.col(own).alias(name) for own, name in zip(names, ("_key", "n", "codes", "sketch"), strict=True)]), least, width)
    return first_of_each(rows.select(*docs.columns, names[0]), found, names[0]).select(docs.columns)
