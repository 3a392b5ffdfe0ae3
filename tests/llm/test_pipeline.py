import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import mixing, simhash, toxicity
from tests.llm.test_pii import brute_card


def make(spark, folder):
    rng, rows, labels = random.Random(11), [], []
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.choice([20, 80, 900]))]
        if i % 7 == 0:
            words += ["you", "vile", "snotling"]
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        if i % 11 == 3:
            words[5] = "4417744280351547"
        rows.append((i, " ".join(words), "en", f"src{i % 5}" if i % 10 else None, 0))
    rows += [(1000 + i, rows[i][1] + ("" if i % 2 else " "), "en", "copies", 0) for i in range(1, 60)] + [(2000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_agree_with_brute_force(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns
        outs.append(docs.collect())
        sizes.append(len(outs[-1]))
    toxic = {d for d, t, *_ in rows if "snotling" in (t or "")}
    clean = [r for r in rows if r[0] not in toxic]
    assert {r.doc_id for r in outs[0]} == {r[0] for r in clean}
    first = {}
    for d, t, *_ in sorted(clean):
        first.setdefault(simhash.fingerprint(t), d)
    kept = {r.doc_id: r for r in outs[1]}
    # random texts are far apart, so only equal fingerprints are linked
    assert set(kept) == set(first.values())
    told = {r.doc_id: r for r in outs[2]}
    card = "4417744280351547"
    for d, r in kept.items():
        want = r.text and r.text.replace(card, secret_card(card))
        assert told[d].text == want and told[d].n_chars == (len(want) if want != r.text else r.n_chars)
    taken = {r.doc_id: r for r in mixing.mix(spark.read.parquet(f"{tmp_path}/out2")).collect()}
    assert Counter(r.doc_id for r in outs[3]) == {d: math.ceil(r.taken / r.size) if r.size else 1 for d, r in taken.items() if r.taken or not r.size}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in outs[3])
    filled = defaultdict(int)
    for r in outs[4]:
        filled[r.sequence_id] += r.length
    assert sum(filled.values()) == want and max(filled.values()) <= 4096
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[4]


def secret_card(card):
    import tests.llm.test_pii as brute

    own, brute.KEY = brute.KEY, "not a secret"
    try:
        return brute_card(card)
    finally:
        brute.KEY = own


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "pii pseudonyms", "source mixing", "best-fit packing"]
    assert toxicity.keep_clean and corpus_pipeline.ORACLE_SQL is None


def test_a_stage_keeps_what_another_call_of_it_reads(spark, docs_of):
    rows = [(i, f"words of text {i} " * (i % 7)) for i in range(40)]
    docs = docs_of(rows)
    first = corpus_pipeline.mix_sources(spark, docs, "/none")
    second = corpus_pipeline.mix_sources(spark, docs, "/none")
    assert first.count() == second.count() > 0


def test_scratch_goes_without_stored_tables(spark, docs_of):
    from marginalia.llm import common
    from marginalia.operators import storage

    stored, scratch = storage.persisted(docs_of([(1, "a")]), "kept"), common.persisted(docs_of([(1, "a")]), "scratch")
    common.drop_scratch(spark)
    assert stored.count() == 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(scratch.inputFiles()[0]).count()
