import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import hnsw


def brute(rows, k=20, every=20):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    all_ = np.array([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (all_ * good[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, scaled):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.2, 3, size=(6000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(hnsw.nearest(table(spark, rows), per_shard=2000)), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    exact = {q: dict(want[q]) for q in want}
    assert all(exact[q].get(i, s) == pytest.approx(s, abs=1e-12) for q in got for i, s in got[q])


def test_copies_and_ties_go_by_id(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).round(1)
    rows = [(i, x[i % 3 if i % 2 else i].tolist()) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)]
    assert answers(hnsw.nearest(table(spark, rows, "double"))) == {q: [(i, pytest.approx(s)) for i, s in hits] for q, hits in brute(rows).items()}


def test_bottom_of_the_table_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 0.5]), (2, [2.0, 0.5]), (3, [1.0, 2.0, 3.0]), (5, []), (120, [1.0, 0.0, 0.0])]
    df = table(spark, rows).withColumn("v", F.lit("x")).withColumn("shard", F.lit(1))
    assert answers(hnsw.nearest(df)) == {0: [(2, 2.0), (1, 1.0)], 120: [(3, 1.0)]}
    assert hnsw.nearest(table(spark, [])).count() == 0
    assert hnsw.nearest(table(spark, [(0, [1.0])])).count() == 0


def test_each_dimension_is_searched_on_its_own(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=(3, 5, 8)[i % 3 if i % 7 else 0]).tolist()) for i in range(900)]
    got, want = answers(hnsw.nearest(table(spark, rows, "double"))), {}
    for n in (3, 5, 8):
        want |= brute([(i, v) for i, v in rows if len(v) == n])
    assert got == {q: [(i, pytest.approx(s)) for i, s in hits] for q, hits in want.items()}


def test_insertion_in_batches_finds_as_much():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:300] @ x.T
    want = np.argsort(-s, axis=1)[:, :20]
    for first in (1000, 9000):
        graph = hnsw.build(x, first)
        got, scores = hnsw.search(graph, x, x[:300])
        assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(got, want, strict=True)]) >= 0.97
        assert np.allclose(scores, np.take_along_axis(s, got, 1), atol=1e-4) and all(len(set(r)) == len(r) for r in got.tolist())


def test_all_vectors_of_a_shard_can_be_reached():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 5
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.1).astype(np.float32)
    graph = hnsw.build(x)
    assert [len(n) for n in graph.nodes] == sorted((len(n) for n in graph.nodes), reverse=True) and len(graph.nodes) > 1
    got, _ = hnsw.search(graph, x, x[:200])
    s = x[:200] @ x.T
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(got, want, strict=True)]) >= 0.9
