"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most two bits exactly if they share a value within one bit of
both. So each distinct fingerprint emits its 65 values within half the radius, one shuffle brings
equal values together, and all that meet there are linked. A value has at most 65 fingerprints
within one bit, so no group can grow with the data; equal fingerprints are merged beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, persisted

#: Row b holds the bits of byte b, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Shingles hashed at once; bounds memory on very long texts.
_BLOCK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, by byte of the 64-bit word (little-endian) and bit (highest first); a column of words each has its bytes after the last one's."""
    bytes_ = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)
    wide = bytes_.shape[1]
    found = np.bincount((bytes_ + np.arange(wide, dtype=np.int64) * 256).ravel(), minlength=wide * 256)
    return found.reshape(wide, 256) @ _BITS


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: bit set where over half the shingle hashes have it; no words: 0."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    total, counts = len(words) - width + 1, np.zeros((8, 8))
    for at in range(0, total, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        runs = zip(*(part[k:] for k in range(width)), strict=False)
        counts += bit_counts(np.array([digest(b" ".join(run), seed) for run in runs], dtype="<u8"))
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: each text's fingerprint as a signed 64-bit integer."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, schema)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` that connect all of ``distinct(fp)`` within ``radius`` bits (2 or less).

    All that share a value are within the radius of each other, so each is linked to the smallest
    there: no pairs within a group are made, and what is connected stays so.
    """
    if radius > 2:
        raise ValueError("values within one bit find radius 2 at most")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    variants = distinct.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("variant"))
    met = variants.selectExpr("fp AS b", "min(fp) OVER (PARTITION BY variant) AS a")
    return met.where("a != b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def ball_pairs(codes: DataFrame, bits: int) -> DataFrame:
    """Pairs ``(u, w)``, u < w, of the distinct ``codes(code)`` that differ in one or two of their ``bits`` lowest bits (62 or fewer), and in no others.

    Each emits itself and its values one bit away; what meets at a value is kept as one mask of the bits that
    were turned, so a value has one small row however many meet there, and at most ``bits + 1`` codes can.
    """
    turned = [F.col("code"), *[F.col("code").bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(bits)]]
    variants = codes.select(F.posexplode(F.array(*turned)).alias("turn", "variant")).repartition("variant")
    met = variants.groupBy("variant").agg(F.bit_or(F.expr("shiftleft(1L, turn)")).alias("mask")).where(F.bit_count("mask") > 1)
    ways = F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.getbit("mask", k) == 1)
    back = F.transform(ways, lambda k: F.when(k == 0, F.col("variant")).otherwise(F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k - 1))))
    here = met.select(back.alias("here")).select("here", F.explode("here").alias("u"))
    return here.select("u", F.explode(F.filter("here", lambda w: w > F.col("u"))).alias("w")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest
    doc_id that it reaches over links of at most ``radius`` differing bits, itself included.

    Null and blank texts have fingerprint zero and are linked like any other. Rows with equal ids each
    have a row of their own; a null id never names a component, so a component of null ids has a null
    component_id. Columns besides id and text are ignored. An empty table gives an empty result.
    """
    fps = persisted(fingerprints(docs, width, seed), "simhash")
    classes = persisted(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = labels.join(classes, "fp")
    heads = linked.groupBy("label").agg(F.min("rep").alias("head"))
    named = classes.join(linked.join(heads, "label").select("fp", "head"), "fp", "left").select("fp", F.coalesce("head", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
