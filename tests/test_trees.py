import random

from marginalia.operators import knowledge as kn
from marginalia.operators import notes as ns
from marginalia.operators import trees as tr

SCHEMA = "id long, parent_id long"


def brute(parents):
    out = {}
    for k in parents:
        path, at = [k], k
        while parents[at] in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        out[k] = path if parents[at] not in parents else None
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    parents = {0: None}
    for k in range(1, 60):
        parents[k] = rng.choice([None, 999, *[j for j in range(k)][-4:], *range(k), *range(k)])
    parents |= {100: 101, 101: 102, 102: 100, 103: 101, 104: 103, 105: 105}
    folders = spark.createDataFrame(list(parents.items()), SCHEMA).repartition(3)
    labels = tr.labelled(folders)
    got, up = {r.id: r for r in labels.collect()}, brute(parents)
    assert {k for k, r in got.items() if r.cyclic} == {100, 101, 102, 103, 104, 105} and len(got) == len(parents)
    for k, path in up.items():
        if path is not None:
            assert (got[k].root, got[k].depth) == (path[-1], len(path) - 1)
            mine = {j for j, r in got.items() if not r.cyclic and r.root == got[k].root and got[k].first <= r.first < got[k].last}
            assert mine == {j for j, p in up.items() if p and k in p}
    assert {(r.id, r.depth) for r in tr.below(labels, 0).collect()} == {(j, len(p) - 1 - (len(up[0]) - 1)) for j, p in up.items() if p and 0 in p}
    assert {r.id for r in tr.above(labels, 59).collect()} == set(up[59]) and tr.below(labels, 101).count() == 0
    assert {r.id: r.below for r in tr.sizes(labels).collect()} == {k: None if p is None else sum(k in (q or []) for q in up.values()) - 1 for k, p in up.items()}


def test_long_chains_and_wide_folders(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    wide = spark.range(n, 2 * n).selectExpr("id", f"CASE WHEN id > {n} THEN {n} END AS parent_id")
    rows = {r.id: r for r in tr.labelled(chain.unionByName(wide)).collect()}
    assert all((rows[k].depth, rows[k].first, rows[k].last) == (k, k, 2 * n - 1 - k) for k in range(n))
    assert rows[n].last - rows[n].first == 2 * n - 1 and all(rows[k].depth == 1 and rows[k].last == rows[k].first + 1 for k in range(n + 1, 2 * n))


def test_empty_and_single(spark):
    assert tr.labelled(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in tr.labelled(spark.createDataFrame([(7, None)], SCHEMA)).collect()] == [(7, 7, 0, 1, 0, False)]


def test_locks_reach_folders_of_any_depth(spark):
    from pyspark.sql import functions as F

    folders = spark.range(700).selectExpr("id", "'f' AS name", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "false AS locked")
    notes = spark.range(700).selectExpr("id AS note_id", "'t' AS title", "'secret' AS content", "id AS folder_id")
    assert kn.subtree(folders, 0).count() == 700
    shut, sealed, rest = ns.locked(folders, notes, 0, F.lit(b"k" * 32), {"rows": notes.select("note_id")})
    assert shut.where("locked").count() == 700 and sealed.where("content = 'secret'").count() == 0 and rest["rows"].count() == 0
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3)], SCHEMA)
    assert {(r.id, r.depth) for r in kn.subtree(ring, 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)} and kn.subtree(ring, 4).count() == 1
    assert kn.closure(ring).count() == 13


def test_large_trees_do_not_pass_through_the_driver(spark):
    rows = spark.range(1, 60_001).selectExpr("id", "CASE WHEN id > 1 THEN id DIV 2 END AS parent_id")
    labels = tr.labelled(rows)
    assert "Broadcast" not in labels._jdf.queryExecution().executedPlan().toString()
    assert labels.where("last - first > 1").agg({"depth": "max"}).first()[0] == 14
