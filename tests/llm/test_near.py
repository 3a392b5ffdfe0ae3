import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import near


def brute_similarity(a, b):
    def runs(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_firsts(rows):
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if brute_similarity(rows[i][1], rows[j][1]) >= 0.8:
            head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def replaced(rng, words, n):
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"x{rng.randrange(10**9)}"
    return own


@pytest.fixture(scope="module")
def copies():
    """Texts, copies with one word replaced and copies of a similarity around the bound."""
    rng, rows = random.Random(9), []
    for size, changes in ((60, (1,)), (150, (1, 3)), (400, (1, 6, 9, 12)), (1000, (1, 16, 25))):
        for k in range(8):
            words = text_of(rng, size)
            rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate([words, *(replaced(rng, words, n) for n in changes)])]
    return [*rows, (9001, None), (9002, " \n"), (9003, "Short text"), (9004, "short  TEXT "), (9005, "short texts")]


def test_near_copies_of_similarity_above_the_bound_go(spark, docs_of, copies):
    got = corpus_pipeline.drop_near_copies(spark, docs_of(copies), "").collect()
    assert sorted(r.doc_id for r in got) == brute_firsts(copies)
    assert 50 < len(copies) - len(got) < len(copies) - 32


def test_a_large_group_of_near_copies_is_one(docs_of):
    rng = random.Random(2)
    words = text_of(rng, 200)
    rows = [(i, " ".join(replaced(rng, words, 2))) for i in range(300)]
    assert [r.doc_id for r in near.keep_first(docs_of([*rows, (500, "other")])).orderBy("doc_id").collect()] == [0, 500]


def test_rows_are_judged_one_by_one(docs_of):
    a, b, c = (" ".join(text_of(random.Random(k), 50)) for k in range(3))
    got = near.keep_first(docs_of([(3, a), (5, a), (5, b), (7, b), (5, b), (None, a), (None, c), (None, c)])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, a), (5, b), (None, c), (None, c)], key=str)
    assert near.keep_first(docs_of([])).count() == 0


def test_shingles_and_similarity(copies):
    for (_, a), (_, b) in zip(copies[:40], copies[1:41], strict=True):
        assert near.similarity(*(near.shingles(near.words_of(t)) for t in (a, b))) == brute_similarity(a, b)
    assert near.words_of(None) == near.words_of(" ") == [] and len(near.signature(near.shingles([]))[0]) == 0


def test_fingerprints_find_pairs_at_the_bound():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 64, 900, np.uint64)
        b = np.concatenate([a[:800], rng.integers(0, 1 << 64, 100, np.uint64)])
        (a, far_a), (b, far_b) = near.signature(np.unique(a)), near.signature(np.unique(b))
        close = [x >> near.PART_BITS == y >> near.PART_BITS and (x ^ y).bit_count() <= 2 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        found += any(close) and np.bitwise_count((far_a ^ far_b).view(np.uint64)).sum() <= near.FAR
    assert found >= 296


def test_outliers_of_a_large_group_are_linked(docs_of):
    """Texts that are near some of a group, but not the ones compared first, and one that only looks near."""
    rng = random.Random(8)
    words = text_of(rng, 300)
    rows = [(i, " ".join(replaced(rng, words, 1 + i % 11))) for i in range(120)]
    rows += [(200 + i, " ".join(replaced(rng, rows[i][1].split(), 4))) for i in range(0, 100, 7)]
    rows += [(400 + i, " ".join([*words[: 180 + 2 * i], *text_of(rng, 120 - 2 * i)])) for i in range(30)]
    assert sorted(r.doc_id for r in near.keep_first(docs_of(rows)).collect()) == brute_firsts(rows)


def test_groups_that_only_look_near_make_few_pairs(spark, docs_of):
    """Copies changed too much, and texts with a passage in common, meet no one: the bound by shared shingles."""
    rng = random.Random(12)
    words, passage = text_of(rng, 150), text_of(rng, 60)
    rows = [(i, " ".join(replaced(rng, words, 6 if i % 2 else 1))) for i in range(400)]
    rows += [(1000 + i, " ".join([*text_of(rng, 60), *passage, *text_of(rng, 60)])) for i in range(300)]
    seen = []
    keep = near.candidates

    def counted(*args, **options):
        pairs = keep(*args, **options)
        seen.append(pairs.count())
        return pairs

    near.candidates = counted
    try:
        got = sorted(r.doc_id for r in near.keep_first(docs_of(rows)).collect())
    finally:
        near.candidates = keep
    assert got == brute_firsts(rows) and max(seen) < 400


def test_copies_of_the_same_changes_make_few_pairs(docs_of):
    """Copies that each have 6 of 24 changes, so that others have all their shingles, but few texts have as many as five of theirs: the bound by odd sketches."""
    rng = random.Random(21)
    words, changes = text_of(rng, 150), [(4 + 6 * k, f"y{k}" if k % 2 else "") for k in range(24)]

    def copy():
        own = list(words)
        for at, word in rng.sample(changes, 6):
            own[at] = word
        return " ".join(own)

    rows, seen = [(i, copy()) for i in range(300)], []
    keep = near.candidates

    def counted(*args, **options):
        pairs = keep(*args, **options)
        seen.append(pairs.count())
        return pairs

    near.candidates = counted
    try:
        got = sorted(r.doc_id for r in near.keep_first(docs_of(rows)).collect())
    finally:
        near.candidates = keep
    assert got == brute_firsts(rows) and 30 < len(rows) - len(got) < 250 and max(seen) < 600, (len(got), seen)


def test_odd_sketches_differ_at_most_as_the_sets_do():
    rng = np.random.default_rng(6)
    for n, apart in ((1, 1), (40, 9), (150, 60), (900, 200), (20_000, 4000)):
        every = np.unique(rng.integers(0, 1 << 64, n + apart, np.uint64))
        a, b = every[:n], every[apart // 2 : apart // 2 + n]
        differing = int(np.bitwise_count((near.odd_sketch(a) ^ near.odd_sketch(b)).view(np.uint64)).sum())
        union = len(np.setxor1d(a, b, assume_unique=True))
        assert differing <= union and (union - differing) % 2 == 0
        assert n > 900 or differing >= 0.7 * union
    assert not near.odd_sketch(np.empty(0, np.uint64)).any() and len(near.odd_sketch(a)) == near.ODD_WORDS


def test_columns_of_clashing_names_stay(spark, docs_of):
    docs = docs_of([(1, "one two three"), (2, "one two  three"), (3, "")]).withColumn("_key", F.lit("k")).withColumn("__KEY", F.lit(1)).withColumn("component", F.col("doc_id"))
    got = near.keep_first(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r._key, r.component) for r in got.collect()) == [(1, "k", 1), (3, "k", 3)]


def test_shingles_and_signatures_are_handed_back_in_pieces():
    rng = random.Random(3)
    texts = [" ".join(text_of(rng, 400)) for _ in range(2000)] + [None, "", "a b"]
    keys, tags = [str(i).encode() for i in range(len(texts))], list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tags, pa.int64()), pa.array(texts)], ["_key", "tag", "text"])
    pieces = list(near.shingled(iter([batch, batch.slice(0, 0), batch.slice(2000, 2)]), 5))
    assert max(p.num_rows for p in pieces) < near.HELD + 400
    got = pa.Table.from_batches(pieces)
    want = [near.shingles(near.words_of(t)).view(np.int64) for t in texts]
    assert got["shingle"].to_numpy().tolist() == np.concatenate(want).tolist()
    assert got["_key"].to_pylist() == [k for k, w in zip(keys, want, strict=True) for _ in w] and got["tag"].to_pylist() == [int(k) for k in got["_key"].to_pylist()]
    signed = list(near.signatures(iter([batch]), 5, ["k", "n", "codes", "sketch"]))
    assert max(p.num_rows for p in signed) <= near.PIECE
    whole = pa.Table.from_batches(signed)
    assert whole["text"].to_pylist() == texts and whole["n"].to_pylist() == [len(w) for w in want]
