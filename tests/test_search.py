import random
import sqlite3

import numpy as np
import pytest

from marginalia.operators import lexical as lx
from marginalia.operators import search as se


def notes(spark, rows):
    return spark.createDataFrame([(i, t, c, i % 4) for i, (t, c) in enumerate(rows)], "note_id long, title string, content string, folder_id long")


def corpus():
    rng = random.Random(7)
    words = ["alpha", "alphabet", "Beta", "béta", "gamma_ray", "foo-bar", "foo", "bar", "barley", "ß", "straße", "漢字", "x1", "don't", "naïve"]
    return [(f"title {rng.choice(words)}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for _ in range(120)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return lx.indexed(spark, notes(spark, corpus()), path=str(tmp_path_factory.mktemp("index")))


def fts5(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, content, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, title, content) VALUES (?, ?, ?)", [(i, t, c) for i, (t, c) in enumerate(rows)])
    return con


def ranked_by_fts5(con, query):
    return dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (se.match_expression(query),)).fetchall())


QUERIES = ["alpha", "alph beta", "foo-bar", '"al"pha b', "naive x", "bar fo", "漢", "gamma_r", "-- alpha", "don't", "stra", "a", "bar-foo b", "alpha alpha"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranking_agrees_with_fts5(spark, index, query):
    want = ranked_by_fts5(fts5(corpus()), query)
    assert {r.id: r.score for r in index.search(query).collect()} == {i: pytest.approx(s, abs=1e-6) for i, s in want.items()}


def test_empty_queries_find_nothing(spark, index):
    for query in ("", '  " ', "--- !"):
        assert index.search(query).count() == 0
    assert se.match_expression('two "words') == '"two"* "words"*'


def test_a_search_reads_the_folders_of_its_terms_and_no_text(index, capsys):
    index.search("alph beta").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket" in plan and "regexp_extract_all" not in plan and "StringStartsWith" in plan


def test_locked_folders_can_crowd_out(spark):
    df = notes(spark, [("t", "alpha " * (9 if i % 4 == 0 else 1)) for i in range(40)] + [("q", "other")] * 60)
    blocked, index = spark.createDataFrame([(0,)], "folder_id long"), lx.indexed(spark, df)
    late = lx.fts_search(index, df, "alpha", blocked, limit=3)
    early = lx.fts_search(index, df, "alpha", blocked, limit=3, prefilter=True)
    assert late.count() == 0 and early.count() == 3 and early.where("folder_id = 0").count() == 0
    assert "<b>alpha</b>" in early.first().snippet


def test_term_statistics(spark):
    index = lx.indexed(spark, notes(spark, [("a", "x y x"), ("b", "y"), ("", "")]))
    assert {(r.term, r.tf, r.df) for r in lx.term_stats(index.postings()).collect()} == {("x", 2, 1), ("y", 2, 2), ("a", 1, 1), ("b", 1, 1)}
    assert {(r.id, r.len) for r in index.rows().collect()} == {(0, 4), (1, 2), (2, 0)}


def test_a_refreshed_index_ranks_as_a_new_one(spark, tmp_path):
    """Changes, new rows and deletions over several generations, before and after they are merged."""
    rows, rng = dict(enumerate(corpus()[:60])), random.Random(3)
    as_df = lambda some: spark.createDataFrame([(i, *some[i]) for i in some], "note_id long, title string, content string")
    index = lx.indexed(spark, as_df(rows), path=str(tmp_path / "i"))
    for turn in range(3):
        changed = {i: (f"alpha {turn}", f"new words foo bar {rng.choice('abc')}") for i in [*rng.sample(sorted(rows), 4), 100 + turn]}
        gone = rng.sample([i for i in rows if i not in changed], 2)
        rows = {i: r for i, r in (rows | changed).items() if i not in gone}
        index.refresh(as_df(changed), spark.createDataFrame([(i,) for i in gone], "note_id long"))
    con = fts5([])
    con.executemany("INSERT INTO f(rowid, title, content) VALUES (?, ?, ?)", [(i, t, c) for i, (t, c) in rows.items()])
    for _ in range(2):
        for query in ("alpha", "foo-bar", "b"):
            assert {r.id: r.score for r in index.search(query).collect()} == {i: pytest.approx(s, abs=1e-6) for i, s in ranked_by_fts5(con, query).items()}
        index.compact()
    assert index.build(as_df({1: ("t", "alpha")})).search("alpha").count() == 1
    index.drop()
    index.drop()
    with pytest.raises(LookupError):
        index.search("alpha")


def test_postings_are_grouped_in_tasks_without_a_shuffle(spark):
    texts = {i: (" ".join("abcd"[(i * j) % 4] for j in range(i % 7)), "b" * (i % 3) + " a b a") for i in range(1200)}
    rows = spark.createDataFrame([(i, *t) for i, t in texts.items()], "note_id long, title string, content string").coalesce(1)
    found = lx.postings(lx.tokenised(rows, "note_id", ("title", "content")), 2)
    want = {(term, i, k, tuple(j for j, x in enumerate(t[k].split()) if x == term), sum(len(x.split()) for x in t)) for i, t in texts.items() for k in (0, 1) for term in set(t[k].split())}
    got = found.collect()
    assert {(r.term, r.id, r.col, tuple(r.places), r.len) for r in got} == want and len(got) == len(want) and all(r.tf == len(r.places) for r in got)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    one = found.where("col = 1")
    assert sorted(lx.term_stats(one, one_column=True).collect()) == sorted(lx.term_stats(one).collect())


def test_an_index_holds_without_postings(spark, tmp_path):
    """Refreshes that only delete, notes that become blank, tables without rows, and a refresh before the first build."""
    as_df = lambda some: spark.createDataFrame([(i, t, c) for i, (t, c) in some.items()], "note_id long, title string, content string")
    found = lambda index, query: {r.id for r in index.search(query).collect()}
    index = lx.indexed(spark, as_df({}), path=str(tmp_path / "i"))
    assert found(index, "alpha") == set() and index.postings().count() == 0
    index.refresh(as_df({1: ("a", "alpha"), 2: ("b", "alpha beta")}))
    assert found(index, "alpha") == {1, 2}
    index.refresh(as_df({}), as_df({1: ("", "")}).select("note_id"))
    assert found(index, "alpha") == {2}
    index.refresh(as_df({2: ("", " ")}))
    assert found(index, "alpha") == set() and index.rows().count() == 1
    index.refresh(as_df({3: ("c", "alpha")}))
    index.compact()
    assert found(index, "alpha") == {3}
    other = lx.TextIndex(spark, str(tmp_path / "new"))
    assert found(other.refresh(as_df({5: ("t", "gamma")})), "gamm") == {5}


def chunks(spark, vectors):
    return spark.createDataFrame([(i, i // 3, f"t{i // 3}", i % 3, f"c{i}", v) for i, v in enumerate(vectors)], "chunk_id long, note_id long, title string, chunk_index long, content string, vector array<double>")


def test_knn_agrees_with_numpy(spark):
    x = np.random.default_rng(1).normal(size=(90, 8))
    df = chunks(spark, x.tolist())
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "query_id long, query_vector array<double>")
    got = se.knn_join(df, queries, 7, exclude_self="chunk_id").collect()
    for q in range(5):
        dist = ((x - x[q]) ** 2).sum(1)
        want = [i for i in np.argsort(dist, kind="stable") if i != q][:7]
        mine = sorted((r["rank"], r.chunk_id, r.distance) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == want and [m[2] for m in mine] == pytest.approx(dist[want])
    with pytest.raises(ValueError, match="over 4"):
        se.knn_join(df, queries, 7, max_queries=4)


def test_knn_searches_any_number_of_queries(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    df = chunks(spark, x.tolist())
    rows = spark.range(10_050).selectExpr("id AS query_id", "array(id / 100d, 1d, 0d, -1d) AS query_vector")
    got = se.knn_join(df, rows, 2)
    assert got.count() == 2 * 10_050
    whole, blocks = (sorted(map(tuple, se.knn_join(df, rows.where("query_id < 25"), 3, block=n).collect())) for n in (25, 4))
    assert whole == blocks and len(whole) == 75
    assert se.knn_join(df, rows.limit(0), 2).count() == 0


def test_sources_ceiling_and_spread(spark):
    near = lambda *d: spark.createDataFrame([(1, i, i // 2, f"t{i // 2}", i % 2, f"c{i}", x, i + 1) for i, x in enumerate(d)], "query_id int, chunk_id long, note_id long, title string, chunk_index int, content string, distance double, rank int")
    got = {r.note_id: r.excerpts for r in se.by_source(near(0.5, 0.9, 0.57, 0.8, 0.6), "note_id", 100, 5, 0.9, 1.15).collect()}
    assert got == {0: ["c0", "c1"], 1: ["c2", "c3"]}
    assert se.by_source(near(0.91, 0.95), "note_id", 100, 5, 0.9, 1.15).count() == 0
    assert [r.note_id for r in se.by_source(near(0.0, 0.1, 0.1), "note_id", 100, 5, 0.9, 1.15).collect()] == [0]
    assert se.by_source(near(0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), "note_id", 100, 3, 0.9, 1.15).count() == 3


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(i, r) for r, i in enumerate(ids, 1)], "note_id long, rank int")
    got = se.fused([("fts", ranked([1, 2])), ("semantic", ranked([2, 3]))], "note_id", 12).collect()
    assert [(r.note_id, r.matched_by) for r in got] == [(2, "both"), (1, "fts"), (3, "semantic")]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert se.fused([("fts", ranked([1]).limit(0)), ("semantic", ranked([3]))], "note_id", 12).count() == 1


def test_hybrid_articles(spark):
    lexical = spark.createDataFrame([("a", "A", "snip", 1), ("b", "B", "", 2)], "article_id string, title string, snippet string, rank int")
    semantic = spark.createDataFrame([("a", "old", ["x", "snip"], 0.7, 2), ("c", "C", ["y"], 0.5, 1)], "article_id string, title string, excerpts array<string>, distance double, rank int")
    got = [(r.article_id, r.title, r.excerpts, r.distance) for r in se.hybrid_articles(lexical, semantic).collect()]
    assert got == [("a", "A", ["x", "snip"], 0.7), ("c", "C", ["y"], 0.5), ("b", "B", [""], 0.0)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (3, "z", 9)], "query_id int, item string, rank int")
    cases = spark.createDataFrame([(1, "b"), (1, "q"), (2, "x"), (3, "z")], "query_id int, item string")
    summary, each = se.evaluation(ranked, cases, 5)
    assert tuple(summary.first()) == (3, pytest.approx(2 / 3), 0.5, 2)
    assert {r.query_id: r.reciprocal_rank for r in each.collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
