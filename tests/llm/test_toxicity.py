import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import toxicity

BAD = ["grumbug", "snotling", "vexo"]


def corpus(n=900):
    rng, rows, labels = random.Random(8), [], []
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([3, 30, 200]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                bad = rng.choice(BAD)
                bad += rng.choice(["", "um", "ita", "es"]) if bad == "vexo" else ""
                words.insert(rng.randrange(len(words)), rng.choice([bad, bad.title(), bad.replace("o", "0"), bad.replace("u", "ü"), f"({bad})"]))
        rows.append((i, " ".join(words)))
        if i % 3 != 2:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_folds(docs_of, labels_of):
    rows, labels = corpus()
    got = toxicity.assess(docs_of(rows), labels_of(labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    wrong = [r for r in held if r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 0.02 * len(held)


def test_held_out_labels_are_not_learnt_from(docs_of, labels_of):
    rows, labels = corpus(300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.assess(docs_of(rows), labels_of(x)).collect()} for x in (labels, flipped))
    assert a == b


def test_folding():
    for text, want in (("1D10T!", "idiot "), ("ѕсυм", "scum"), ("ｌｏｓｅｒ", "loser"), ("tr@$h.", "trash "), ("Éß-x $$ ok$$", "eß x    ok  "), ("a!b", "aib")):
        assert toxicity.fold(text) == want and len(want) == len(text)
    for text in ("i\u200bd\u00adi\u2060ot", "I\u0308D\u0301IOT", "𝕚𝔡𝒊𝐨𝚝", "ɪᴅɪᴏᴛ", "🅸🅳🅸🅾🆃", "іԁɨøŧ", "ⓘⓓⓘⓞⓣ"):
        assert toxicity.fold(text) == "idiot"


def brute_lexicon(rows):
    """Terms from their counts by plain loops. ``rows``: pairs of text and label."""
    uses, texts, words, sizes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0], [0, 0]
    for text, toxic in rows:
        sizes[toxic] += 1
        words[toxic] += len(re.split(r"\s+", text or ""))
        own = [t for w in toxicity.fold(text or "").split() if len(w) >= 3 for t in [*(f" {w[:k]}" for k in range(3, min(len(w), 24) + 1)), f" {w} "]]
        for t in own:
            uses[t][toxic] += 1
        for t in set(own):
            texts[t][toxic] += 1
    out = {}
    for t, (clean, toxic) in texts.items():
        by_uses = math.log((uses[t][1] + 0.5) / (words[1] + 1)) - math.log((uses[t][0] + 0.5) / (words[0] + 1))
        by_texts = math.log((toxic + 0.5) / (sizes[1] + 1)) - math.log((clean + 0.5) / (sizes[0] + 1))
        sure = min(by_uses, by_texts) - 1.64 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if toxic >= 4 and sure >= 1:
            out[t] = (sure, toxic)
    pruned = {}
    for t in sorted(out, key=len):
        weight, toxic = out[t]
        if any(u != t and u.startswith(t) and n >= 0.9 * toxic for u, (_, n) in out.items()):
            continue
        if not any(t.startswith(u) and w >= weight - 1 for u, w in pruned.items()):
            pruned[t] = weight
    return pruned


def brute_score(lexicon, text):
    folded = f" {toxicity.fold(text or '')} "
    found = []
    for i in range(len(folded)):
        weight = max((w for t, w in lexicon.terms.items() if folded.startswith(t, i)), default=None)
        if weight is not None and not any(p <= i < p + len(e) + 1 for e in lexicon.exceptions for p in range(len(folded)) if folded.startswith(f" {e} ", p)):
            found.append(weight)
    rate = sum(found) / max(1, len(folded.split())) + 1e-4 if text else 1e-4
    return 1 / (1 + math.exp(-max(-60, min(60, lexicon.offset + lexicon.slopes[0] * math.log(rate) + lexicon.slopes[1] * max(found, default=0.0)))))


def test_the_whole_result_agrees_with_brute_force(docs_of, labels_of):
    rows, labels = corpus(240)
    rows[5] = (5, None)
    docs, marks = docs_of(rows), labels_of(labels)
    lexicon, known = toxicity.learn(docs, marks), {d: t for d, _, t in labels}
    want = brute_lexicon([(t, known[d]) for d, t in rows if d in known and zlib.crc32(str(d).encode()) % 3 != 1])
    assert lexicon.terms == pytest.approx(want) and want
    for r in toxicity.assess(docs, marks).collect():
        assert r.score == pytest.approx(brute_score(lexicon, rows[r.doc_id][1]), abs=1e-9)


def test_no_term_is_cut(docs_of, labels_of):
    words = ["".join(p) for p in itertools.product("bcdf", "aeio", "klmn", "aeio", "rst", "aeio", "z")]
    rows = [(i, " ".join(words[k * 60 : k * 60 + 600])) for i in range(800) if zlib.crc32(str(i).encode()) % 3 != 1 for k in [i % 90]]
    clean = [(i, "lorem ipsum " * 300) for i in range(1000, 1400)]
    lexicon = toxicity.learn(docs_of(rows + clean), labels_of([(i, 1, 1) for i, _ in rows] + [(i, 1, 0) for i, _ in clean]))
    assert all(lexicon.hits(toxicity.fold(w)) for w in words[600:])


def test_hits_agree_with_brute_force():
    rng = random.Random(3)
    terms = {" ab": 2.0, " abc": 3.0, " b ": 1.0, " ca": 1.5}
    lexicon = toxicity.Lexicon(terms, ["ab c", "b b"])
    for _ in range(300):
        text = "".join(rng.choice("abc  ") for _ in range(30))
        padded, want = f" {text} ", {}
        for i in range(len(padded)):
            weight = max((w for t, w in terms.items() if padded.startswith(t, i)), default=0)
            spared = any(p <= i < p + len(e) + 1 for e in ("ab c", "b b") for p in range(len(padded)) if padded.startswith(f" {e} ", p))
            if weight and not spared:
                want[i] = weight
        assert {a: w for a, _, w in lexicon.hits(text)} == want


def test_exception_phrases_are_learnt(docs_of, labels_of):
    rng = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "sit"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(20)) + (" you grumbug now" if i % 4 == 0 else " the grumbug beetle" if i % 40 == 1 else "")) for i in range(800)]
    docs, labels = docs_of(rows), labels_of([(i, 0, int(i % 4 == 0)) for i in range(800)])
    lexicon = toxicity.learn(docs, labels)
    assert "grumbug beetle" in lexicon.exceptions
    assert lexicon.score("a b c the grumbug beetle") < 0.3 < 0.7 < lexicon.score("a b c you grumbug now")


def test_defined_on_odd_tables(docs_of, labels_of):
    assert toxicity.assess(docs_of([]), labels_of([])).count() == 0
    rows, labels = corpus(200)
    odd = docs_of([*rows, (None, "grumbug"), (None, None), (0, ""), (0, ""), (1, "x" * 500_000)]).withColumn("score", F.lit("a")).withColumn("toxic", F.lit(1))
    more = labels_of([*labels, (None, None, 1), (5, 1, None), (6, 1, 0), (6, 1, 1), (7, None, 9)])
    got = toxicity.assess(odd, more).collect()
    assert len(got) == 205 and sum(r.doc_id is None for r in got) == 2 and all(r.score < 0.7 for r in got if r.doc_id == 0 and r.score != max(x.score for x in got if x.doc_id == 0))
    assert all(r.predicted == 0 for r in toxicity.assess(docs_of(rows), labels_of([])).collect())
    kept = toxicity.keep_clean(odd, more)
    assert kept.columns == odd.columns and 150 < kept.count() < 205


def test_hits_outside_of_exceptions_agree_with_a_plain_search_and_grow_with_the_text():
    rng = random.Random(4)
    words = ["bad", "badly", "good", "not", "so", "x"]
    lexicon = toxicity.Lexicon({" bad": 1.0, " badly ": 2.0, " so ": 1.5}, ["not bad", "so good x", "x so", "good x so not"])
    for _ in range(200):
        folded = " ".join(rng.choices(words, k=rng.randrange(0, 40)))
        padded = f" {folded} "
        spans = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(padded)) if padded.startswith(f" {p} ", i)]
        want = {}
        for term, weight in lexicon.terms.items():
            for i in range(len(padded)):
                if padded.startswith(term, i) and weight > want.get(i, 0) and not any(a <= i < b for a, b in spans):
                    want[i] = weight
        assert {a: w for a, _, w in lexicon.hits(folded)} == want
    began = time.process_time()
    assert len(lexicon.hits("not bad " * 300_000 + "bad")) == 1 and time.process_time() - began < 20
