"""A corpus pipeline over ``documents``: toxic texts go, near copies go, personal values are pseudonymised,
sources are mixed to their targets, and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import mixing, near, packing, pii, toxicity
from marginalia.llm.common import drop_path, drop_written, persisted, unused, written, written_since

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the last stage, and its place, of each run: of a thread over a folder of tables.
_left: dict[tuple[int, str], tuple[int, list[str]]] = {}
_order: list[Stage] = []


def stage(make: Stage) -> Stage:
    """A stage that begins by deleting the scratch tables of an earlier stage of its run, whose result has been written and read again by then.

    Those of the same stage or a later one stay, since their results may not have been read; so do those of other
    threads and other folders.
    """
    _order.append(make)

    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run, place = (threading.get_ident(), sf_dir), _order.index(make)
        before, paths = _left.get(run, (place, []))
        if before < place:
            for path in paths:
                drop_path(spark, path)
            paths = []
        mark = written()
        out = make(spark, docs, sf_dir)
        _left[run] = (place, (paths if before == place else []) + written_since(mark))
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learnt from ``labels`` and the texts at hand."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more) stays, that with the smallest id; SimHash ball hashing finds the candidates."""
    return near.keep_first(docs)


@stage
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; ``n_chars`` of changed texts is counted anew. A session without a key uses the published one, with a warning."""
    kinds = unused(docs, "pii")
    changed = F.aggregate(F.map_values(kinds), F.lit(0), lambda a, n: a + n) > 0
    found = pii.pseudonyms(docs, pii.secret(spark, otherwise=pii.TEST_KEY), out=kinds)
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes any of its words."""
    return mixing.repeated(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii pseudonyms", pseudonymise),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, the lexicon and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``; of the scratch tables only the last stage's input stays."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, make in STAGES[:-1]:
        docs = persisted(make(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_written(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
