import random
import re
from collections import Counter, defaultdict

import numpy as np

from marginalia.llm import divergence


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, least=30, keep=50):
    uses, in_docs = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        uses[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        own = [s for l, s in groups if l == lang]

        def parts(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = parts(sum((uses[lang, s] for s in own), Counter()))
        p = {s: parts(uses[lang, s]) for s in own}
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, keep)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)}
    return out


def corpus(rng, n=400):
    words = ["the", "The", "É", "é", "naïve", "日本", "x", "of", "a1b", "don't", "ß", "end."] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for _ in range(n):
        source = rng.choice(["s1", "s2", "s2", "s2", None, "é", "S1"])
        text = " ".join(rng.choices(words, weights=[1 + (hash((w, source)) % 5) for w in words], k=rng.randrange(0, 30)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    return [*rows, (None, "en", "mute"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("rare", "fr", "c"), ("only", "xx", "one"), *[("same text again", "en", "s1")] * 40]


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)


def test_matches_brute_force(spark):
    for least, keep in ((30, 50), (1, 3), (10**6, 5)):
        rows = corpus(random.Random(least))
        got = divergence.divergence(table(spark, rows), least, keep).collect()
        assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == brute(rows, least, keep)
        assert len(got) == len({tuple(r) for r in got})


def test_many_small_tiles_and_lots_give_the_same(spark, monkeypatch):
    rows = corpus(random.Random(8), 200)
    for name, value in (("BLOCK", 3), ("SPREAD", 7), ("HELD", 5), ("WORDS", 2)):
        monkeypatch.setattr(divergence, name, value)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = divergence.divergence(table(spark, rows), 2, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == brute(rows, 2, 4)


def test_frequencies_are_exact_in_large_numbers():
    rng = random.Random(2)
    for total in (0, 7, 10**6, 10**12, 9 * 10**15 - 10**9):
        terms = rng.randrange(1, 10**7)
        count = np.array([0, total, *[rng.randrange(total + 1) for _ in range(50)]], np.int64)
        want = [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in count]
        assert divergence.parts_of(count, np.int64(total), terms).tolist() == want


def test_empty_table_other_columns_and_long_texts(spark):
    assert divergence.divergence(table(spark, []).where("lang = 'x'")).count() == 0
    long = "alpha beta " * 300_000
    rows = [(long, "en", "a"), ("beta gamma", "en", "b"), ("gamma " * 10, "en", "b")]
    wide = table(spark, rows).selectExpr("*", "1 AS term", "2 AS uses", "'x' AS value", "3 AS rank")
    got = divergence.divergence(wide, 1, 10).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == brute(rows, 1, 10)
