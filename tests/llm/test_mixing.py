import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    sources = [*["big"] * 60, *["b"] * 12, *["é"] * 9, *["zz"] * 5, *["tiny"], *[None] * 6, "void"]
    for i, s in enumerate(sources):
        n = 0 if s == "void" else rng.choice([0, 1, 40, 300])
        rows.append((i, " \t".join("w" for _ in range(n)) if i % 9 else None, "en", s, n))
    return [*rows, (7, "long " * 9000, "en", "big", 1), (7, "long " * 9000, "en", "big", 1), (None, "a b", None, "zz", 3)]


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, done = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return done | {s: level * weight[s] for s in open_}
        for s in over:
            done[s] = 2 * sizes[s]
            left -= done[s]
        open_ -= over
    return done


def test_targets_and_taken(docs_of):
    rows = corpus()
    got = mixing.mix(docs_of(rows), block=64).collect()
    sizes, taken, source_of = defaultdict(int), defaultdict(int), defaultdict(set)
    for d, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
        source_of[d].add(s)
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        (s,) = [x for x in source_of[r.doc_id] if sizes[x] == r.source_size and math.isclose(want[x], r.target, abs_tol=1e-6)][:1]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)


def test_agrees_with_sql_and_with_a_rerun(docs_of, tmp_path):
    docs = docs_of(corpus(2))
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    for block in (64, 2048):
        want = sorted(con.execute(mixing.MIX_SQL.replace("2048", str(block))).fetchall(), key=str)
        assert sorted((tuple(r) for r in mixing.mix(docs.repartition(5), block=block).collect()), key=str) == want


@pytest.mark.parametrize("block", [16, 1000])
def test_schedule_is_even(spark, block):
    plan = spark.createDataFrame([(0, 60000.0, 60000), (1, 30000.0, 30000), (2, 10000.0, 10000), (3, 0.0, 0), (4, 5.0, 5)], "sid long, target double, quota long")
    slots = sorted(mixing.schedule(plan, block).collect())
    ranks = defaultdict(list)
    for r in slots:
        ranks[r.sid].append(r["rank"])
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(math.ceil(q / block))) for s, q in ((0, 60000), (1, 30000), (2, 10000), (4, 5))}
    half = slots[: len(slots) // 2]
    for sid, share in ((0, 0.6), (1, 0.3)):
        assert abs(sum(r.sid == sid for r in half) - share * len(half)) <= 6


def test_defined_on_odd_tables(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]
    odd = docs_of(corpus()).withColumn("size", F.lit("x")).withColumn("sid", F.lit(1)).withColumn("target", F.lit(None))
    assert mixing.mix(odd).count() == len(corpus())


def test_repeated_documents_in_the_order_of_the_slots(docs_of):
    rng = random.Random(5)
    docs = docs_of([(i, "a b c d " * rng.randrange(1, 30), "en", f"s{i % 4}", 7) for i in range(80)])
    got = [r.doc_id for r in mixing.repeated(docs, block=16).collect()]
    told = {r.doc_id: r for r in mixing.mix(docs, block=16).collect()}
    assert Counter(got) == {d: math.ceil(r.taken / r.size) for d, r in told.items() if r.taken}
    first = {d: got.index(d) for d in set(got)}
    order = sorted(first, key=first.get)
    assert [told[d].first_slot for d in order] == sorted(told[d].first_slot for d in order)
    # sources alternate by their shares from the beginning on
    half = order[: len(order) // 2]
    assert len({told[d].target for d in half}) > 1 and len({d % 4 for d in half[:12]}) >= 3


def test_no_row_is_lost_on_the_way(docs_of):
    rows = [(1, "a b", "en", "x", 1), (1, "c d", "en", "x", 1), (1, "c d", "en", "x", 1), (None, "e f", "en", "y", 1), (2, None, None, "y", 1), (3, "", "en", None, 1), (None, None, None, None, None), (4, "long " * 3000, "en", "x", 1)]
    docs = docs_of(rows).withColumn("_row", F.lit("r")).withColumn("_slot", F.lit(1)).withColumn("size", F.col("doc_id")).withColumn("tags", F.create_map(F.lit("k"), "doc_id"))
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert all(kept[d, t] == 1 for d, t in [(2, None), (3, ""), (None, None)])
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += max(1, math.ceil(r.taken / r.size)) if r.taken else int(not r.size)
    assert Counter(d for d, _ in kept.elements()) == +want and kept[None, "e f"] and kept[1, "c d"] >= 2
    assert mixing.repeated(docs_of([])).count() == 0
