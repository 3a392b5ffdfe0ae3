"""The queries that SQL can express agree with it, and all of them run over whole tables."""

import os

import duckdb
import pytest

from marginalia.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, name):
    got = queries.queries()[name](spark, DIR)
    rows = got.collect()
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    if name in queries.oracle_sql():
        want = con.execute(queries.oracle_sql()[name])
        order = [got.columns.index(c[0]) for c in want.description]
        assert sorted((tuple(r[i] for i in order) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)
    elif name not in ("op5_best_fit_packing", "op7_hnsw_search", "op11_source_divergence"):
        assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_recall_of_the_search_query(spark):
    import numpy as np

    table = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    got = queries.queries()["op7_hnsw_search"](spark, DIR).toPandas()
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = (x * x[ids == q][0]).sum(1)
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(got.vec_id[got.query_id == q]))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()
