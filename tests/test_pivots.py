import numpy as np
import pytest

from marginalia.operators import pivots
from marginalia.operators import search as se

SCHEMA = "chunk_id long, title string, vector array<float>"


def rows_of(spark, x):
    return spark.createDataFrame([(i, f"t{i}", None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(x)], SCHEMA).repartition(4)


def brute(x, queries, k, own=True):
    out = set()
    for q in queries:
        d = {i: float(np.square(np.float32(v).astype(np.float64) - np.float32(x[q]).astype(np.float64)).sum()) for i, v in enumerate(x) if v is not None and len(v) == len(x[q]) and all(c is not None and np.isfinite(c) for c in v) and (i != q or not own)}
        out |= {(q, i, r + 1) for r, i in enumerate(sorted(d, key=lambda i: (d[i], i))[:k])}
    return out


def test_pruned_search_equals_the_full_scan(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 30
    clusters = [centres[i % 12] + rng.normal(size=8) for i in range(1500)]
    spread = list(rng.normal(size=(600, 8)))
    same = [np.ones(8)] * 300 + [np.full(8, np.nan), None, [1.0] * 7, [1.0] * 7 + [None], [np.inf] * 8]
    for x, most in ((clusters, 0.4), (spread, 1.0), (same, 1.0)):
        chunks = rows_of(spark, x)
        index = pivots.PivotIndex(spark).build(chunks)
        asked = [i for i in range(0, len(x), 97) if x[i] is not None]
        queries = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in asked], "query_id long, query_vector array<float>")
        found = index.search(queries, 9, exclude_self="chunk_id")
        got = {(r.query_id, r.chunk_id, r["rank"]) for r in found.rows.collect()}
        assert got == brute(x, asked, 9) == {(r.query_id, r.chunk_id, r["rank"]) for r in se.knn_join(chunks, queries, 9, exclude_self="chunk_id").collect()}
        assert 0 < found.share <= most


def test_blocks_few_vectors_and_none(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 3)
    x = [np.array([i, 0.0]) for i in range(5)]
    chunks = rows_of(spark, x)
    queries = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "query_id long, query_vector array<double>")
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in pivots.PivotIndex(spark).build(chunks).search(queries, 9).rows.collect()} == brute(x, range(5), 9, own=False)
    assert pivots.PivotIndex(spark).build(chunks).search(queries.limit(0), 9).rows.count() == 0
    assert pivots.PivotIndex(spark).build(chunks.limit(0)).search(queries, 9).rows.count() == 0
    assert pivots.PivotIndex(spark).build(chunks.where("chunk_id < 1"), 5).search(queries, 9).rows.count() == 5


def test_what_cannot_be_compared_takes_no_part(spark):
    chunks = rows_of(spark, [[1, 0], None, [1, 0, 0], [None, 1], [float("nan"), 0], [0, 1]])
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0])], "query_id long, query_vector array<double>")
    assert [(r.query_id, r.chunk_id, r.distance) for r in sorted(se.knn_join(chunks, queries, 5).collect(), key=lambda r: r["rank"])] == [(1, 0, 0.0), (1, 5, 2.0)]
    with pytest.raises(ValueError, match="dimensions"):
        se.knn_join(chunks, spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, query_vector array<double>"), 5)


def test_products_do_not_decide_what_is_nearest():
    rng = np.random.default_rng(0)
    far = 1e6 + rng.normal(size=(400, 4)) * 1e-3
    a, b, distance = se.nearest_of(far, np.arange(400), far[:20], 5)
    exact = np.square(far[None, :, :] - far[:20, None, :]).sum(2)
    for q in range(20):
        assert b[a == q].tolist() == np.lexsort((np.arange(400), exact[q]))[:5].tolist() and (distance[a == q] == exact[q][b[a == q]]).all()
