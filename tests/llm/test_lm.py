import random
import zlib
from collections import Counter
from math import isclose, log, log10

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from marginalia.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def corpus(n=60):
    rng, rows = random.Random(4), []
    common = ["the", "of", "über", "Gate", "x1", "été,"]
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else "".join(rng.choice("abcdé漢͸") for _ in range(rng.randrange(1, 7))) for _ in range(rng.choice([0, 3, 50]))]
        rows.append((i, rng.choice([" ", "\n", "\x0b \t"]).join(words)))
    return [*rows, (61, None), (62, " "), (63, "z" * 3000 + " the")]


def test_marginal_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "<0x63>"]
    p = np.array([0.1, 0.2, 0.05, 0.1, 0.3, 0.15, 0.1])
    at = dict(zip(pieces, p, strict=True))

    def total(s):
        if not s:
            return 1.0
        return sum(at[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in at) + (at["<0x63>"] * total(s[1:]) if s[0] == "c" else 0)

    lattice = lm.Lattice(pieces, np.log(p))
    for word in ("a", "ab", "abab", "aabbab", "acb"):
        assert isclose(lattice.marginal(word), log(total("▁" + word)))
        got = np.zeros(7)
        lattice.expected(word, 1.0, got)
        # derivative of the log marginal by each log probability
        for k in range(7):
            eps = np.zeros(7)
            eps[k] = 1e-5
            up, down = (lm.Lattice(pieces, np.log(p) + s * eps).marginal(word) for s in (1, -1))
            assert isclose(got[k], (up - down) / 2e-5, abs_tol=1e-6)


def test_scores_match_brute_force(docs_of):
    rows = corpus()
    for head in (3, 50_000):
        got = {r.doc_id: r for r in lm.score(docs_of(rows), PATH, head=head).collect()}
        assert len(got) == len(rows)
        split = {d: (t or "").encode().lower().split() + [b""] for d, t in rows}
        held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in split}
        c = Counter(w for d, ws in split.items() if not held[d] for w in ws)
        n, v = sum(c.values()), len(c)
        pieces, base = lm.read_vocabulary(PATH)
        lattice, sums = lm.Lattice(pieces, np.log(base)), base * 1000
        for w, k in c.items():
            if w:
                lattice.expected(w.decode(), k, sums)
        end = (c[b""] + 1) / (sums.sum() + c[b""] + 1)
        final = lm.Lattice(pieces, np.log(sums / sums.sum() * (1 - end)))
        for d, ws in split.items():
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
            assert isclose(r.base_score, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
            want = sum(final.marginal(w.decode()) for w in ws if w) + log(end)
            assert isclose(r.score, want / log(10), rel_tol=1e-6)


def test_learning_helps_on_held_out_text(docs_of):
    docs = docs_of([(i, "banana split " * 20 if i % 2 else "split decision tree " * 15) for i in range(120)])
    sums = [lm.score(docs, PATH, rounds=k).where("held_out").agg(F.sum("score")).first()[0] for k in (0, 1)]
    assert sums[1] > sums[0] * 0.8 and sums[1] > sums[0]


def test_defined_on_odd_tables(docs_of):
    assert lm.score(docs_of([]), PATH).count() == 0
    odd = docs_of([(None, "a b"), (None, "a b"), (5, "a b"), (5, None)]).withColumn("word", F.lit("x")).withColumn("held_out", F.lit("y")).withColumn("row", F.lit(1))
    got = lm.score(odd, PATH).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3, 3] and sum(r.doc_id is None for r in got) == 2


def test_long_words_are_worked_on_in_little_memory(monkeypatch):
    import tracemalloc

    pieces, p = ["▁", "a", "b", "ab", "aba", *(f"<0x{i:02X}>" for i in range(256))], np.full(261, 1 / 261)
    lattice = lm.Lattice(pieces, np.log(p))
    word = "abaé" * 900
    kept, again = np.zeros(261), np.zeros(261)
    lattice.expected(word, 2.0, kept)
    monkeypatch.setattr(lm, "_LONG", 10)
    lattice.expected(word, 2.0, again)
    assert np.allclose(kept, again)
    tracemalloc.start()
    lattice.marginal("ab" * 200_000)
    lattice.expected("ab" * 100_000, 1.0, again)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_plain_probabilities_fit_as_logarithms_do(monkeypatch):
    pieces, p = lm.read_vocabulary(PATH)
    lattice = lm.Lattice(pieces, np.log(p))
    words = ["lattice", "naïve", "日本語", "𝄞", "<0x41>", "▁x", "-" * 100, "𝄞" * 100, ""]
    assert lattice._expected_plain("lattice", 1.0, np.zeros(len(pieces))) and not lattice._expected_plain("𝄞" * 100, 1.0, [])
    plain, logs = np.zeros(len(pieces)), np.zeros(len(pieces))
    for word in words:
        lattice.expected(word, 3.0, plain)
    monkeypatch.setattr(lm, "_PLAIN", 0)
    for word in words:
        lattice.expected(word, 3.0, logs)
    assert np.allclose(plain, logs, rtol=1e-9, atol=1e-12)
