import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from marginalia.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    fps = [brute(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus():
    rng, rows = random.Random(5), []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 30, 400, 900]))]
        for k in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(k // 2):
                own[rng.randrange(len(own))] = f"x{k}"
            rows.append((100 * g + k, "\t\n".join(own) if k % 2 else " ".join(own).upper()))
    return [*rows, (9001, None), (9000, ""), (9002, " \n "), (9003, "über all É"), (5, "a " * 200_000)]


def test_matches_brute_force(docs_of):
    rows = corpus()
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert {tuple(r) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_every_pair_within_two_bits_is_linked(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [base[0] ^ (1 << 63), base[1] ^ 7]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    found = {r.node: r.label for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    for a, b in combinations(signed, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            assert found[a] == found[b]


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert set(labels.values()) == {0, 200} and len(labels) == 73


def test_a_shuffled_chain_is_one_component(spark):
    order = random.Random(3).sample(range(1000), 1000)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (2000, 2001)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert labels == {**dict.fromkeys(range(1000), 0), 2000: 2000, 2001: 2000}


def test_defined_on_odd_tables(docs_of, spark):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    odd = docs_of([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q")]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == [(3, 3), (3, 3), (None, 3), (None, 3), (None, None)]


def test_ball_pairs_are_all_within_two_low_bits(spark):
    rng = random.Random(4)
    codes = {(rng.randrange(4) << 60) - (1 << 61) | rng.randrange(1 << 10) for _ in range(600)}
    got = {(r.u, r.w) for r in simhash.ball_pairs(spark.createDataFrame([(c,) for c in codes], "code long"), 10).collect()}
    assert got == {(u, w) for u in codes for w in codes if u < w and u >> 10 == w >> 10 and (u ^ w).bit_count() <= 2}
