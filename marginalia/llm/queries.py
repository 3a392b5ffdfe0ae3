"""The operators as queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, gif, hnsw, infill, langid, lm, mixing, multiset, packing, pii, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no unigram vocabulary is at hand: this one's merge ranks stand for scores, and one round of expectation fits them
    return lm.score(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(_table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables are synthetic, so a session without a key may use the published one
    found = pii.pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.secret(spark, otherwise=pii.TEST_KEY))
    return found.select("doc_id", "text", *[found["pii"][kind].alias(f"n_{kind}") for kind in pii.KINDS])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.likenesses(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_round_trip": warc.ROUND_TRIP_SQL,
        "op6_source_mixing": mixing.MIX_SQL,
        "op11_source_divergence": divergence.DIVERGENCE_SQL,
        "op12_multiset_fingerprints": multiset.LIKENESS_SQL,
        "op13_fill_in_middle": infill.DIGESTS_SQL,
    }
