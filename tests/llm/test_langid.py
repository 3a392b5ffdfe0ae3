import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "en", "ung", "ver"], "cc": ["eau", "oi", "que", "é"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    rng = random.Random(6)
    return [(i, text(rng, lang, rng.choice([3, 20, 300])), lang, "s", 0) for i, lang in zip(range(n), itertools.cycle(SYLLABLES), strict=False)]


def test_held_out_accuracy(docs_of):
    rows = corpus()
    got = {r.doc_id: r for r in langid.predict(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    held = [(got[d], lang) for d, _, lang, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.98 * len(held)
    assert all(0 < r.score <= 1 for r in got.values())


def test_words_of_code_switched_text(docs_of):
    model = langid.learn(docs_of(corpus()))
    rng = random.Random(9)
    parts = [(lang, text(rng, lang, 8).split()) for lang in ("aa", "bb", "aa", "cc")]
    (found,) = langid.label_words(model, [[w for _, ws in parts for w in ws]])
    truth = [model.langs.index(lang) for lang, ws in parts for _ in ws]
    assert np.mean(found.argmax(1) == truth) >= 0.85
    assert (np.diag(model.moves) > model.moves.mean()).all()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_forward_backward_matches_enumeration(n):
    rng = np.random.default_rng(n)
    model = langid.Chain(["x", "y", "z"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, lengths = rng.normal(size=(2, 5, 3)) * 3, np.array([n, 5])
    found, total, counts = model.marginals(scores, lengths, moved=True)
    logs, moves = 0.0, np.zeros((3, 3))
    for c, length in enumerate(lengths):
        weight, want, own = 0.0, np.zeros((length, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(length)):
            w = np.exp(model.start[path[0]] + sum(scores[c, t, y] for t, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            for t, y in enumerate(path):
                want[t, y] += w
            for a, b in itertools.pairwise(path):
                own[a, b] += w
        assert np.allclose(found[c, :length], want / weight)
        logs += np.log(weight)
        moves += own / weight
    assert np.isclose(total, logs) and np.allclose(counts, moves)


@pytest.mark.parametrize("n", [257, 512, 900])
def test_a_long_chain_is_one(n, monkeypatch):
    rng = np.random.default_rng(n)
    model = langid.Chain(["x", "y", "z"], rng.normal(size=(1 << langid.BITS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    words = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(n)]
    (blocks,) = langid.label_words(model, [words])
    (whole,) = model.marginals(model.emissions(words)[None], np.array([n]))
    assert np.allclose(blocks, whole)


def test_letters_and_marks():
    assert langid.words_of("²½ Ⅷ ① 12_") == [] and langid.words_of("Naïve na\u0308hen हिन्दी x2y") == ["naïve", "na\u0308hen", "हिन्दी", "x", "y"]


def test_languages_of_long_texts_are_learnt(docs_of):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 9000 if lang == "bb" else 30), lang, "s", 0) for i, lang in zip(range(60), itertools.cycle(("aa", "bb")), strict=False)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of([*rows, (500, "²½", "aa", "s", 0)])).collect()}
    assert all(got[d] == lang for d, _, lang, _, _ in rows) and got[500] == "und"


def test_rows_that_repeat_an_id_are_drawn_alike(docs_of):
    rows = [(7, t, lang, s, n) for _, t, lang, s, n in corpus(200)]
    docs = docs_of(rows)
    assert np.array_equal(langid.learn(docs, 20).weights, langid.learn(docs.repartition(7), 20).weights)


def test_features_are_those_of_single_words():
    words = ["a", "über", "x" * 200, "漢字"]
    slots, owner = langid.features(words)
    for i, w in enumerate(words):
        own, _ = langid.features([w])
        assert sorted(own) == sorted(slots[owner == i])


def test_held_out_languages_are_not_learnt(docs_of):
    rows = corpus(60)
    wrong = [(d, t, "aa" if zlib.crc32(str(d).encode()) % 5 == 0 else lang, s, n) for d, t, lang, s, n in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(x)).collect()} for x in (rows, wrong))
    assert a == b


def test_defined_on_odd_tables(docs_of):
    assert langid.predict(docs_of([])).count() == 0
    rng = random.Random(1)
    rows = [*corpus(90), (200, None, "aa", "s", 0), (201, "", "aa", "s", 0), (202, "12 -- 34", "bb", "s", 0), (None, text(rng, "bb", 9), None, None, None), (203, text(rng, "cc", 70_000), None, "s", 0), (3, "kato", "aa", "s", 0), (3, "kato", "aa", "s", 0)]
    odd = docs_of(rows).withColumn("lang_pred", F.lit(1)).withColumn("held_out", F.lit("x")).withColumn("score", F.lit("y"))
    got = langid.predict(odd).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and (by[200], by[201], by[202], by[None], by[203]) == ("und", "und", "und", "bb", "cc")
    assert {r.lang_pred for r in langid.predict(docs_of([(1, "kato miru", None, "s", 0)])).collect()} == {"und"}
