import random

from pyspark.sql import functions as F

from marginalia.operators import knowledge as kn
from marginalia.operators.notestore import NoteStore
from marginalia.operators.views import NoteViews

NOTE = "note_id long, title string, content string, created_at long, updated_at long"


def note(rng, k, now):
    titles = [f"t{i}" for i in range(8)]
    words = [rng.choice(["#a", "#b", "#Çé", "plain", f"[[{rng.choice(titles)}]]", f"[[{rng.choice(titles)}|shown]]", "[[gone]]"]) for _ in range(rng.randrange(7))]
    made = 86_400 * rng.randrange(5)
    return (k, rng.choice([*titles, None]), rng.choice([" ".join(words)] * 6 + [None]), made, made + 40_000 * rng.randrange(4) + now)


def test_views_follow_random_batches(spark, tmp_path):
    rng, views, now = random.Random(7), NoteViews(spark, str(tmp_path)), {}
    for number in range(4):
        changed = [note(rng, rng.randrange(25), number) for _ in range(rng.choice([0, 1, 12]))]
        if changed and number == 2:
            changed.append((*changed[0][:4], changed[0][4] - 1))  # an older row of the same note
        gone = [rng.randrange(25) for _ in range(rng.choice([0, 0, 5]))]
        views.apply(spark.createDataFrame(changed, NOTE), number, spark.createDataFrame([(k,) for k in gone], "note_id long"))
        for row in sorted(changed, key=lambda r: (r[4], r[1] or "", r[2] or "")):
            latest = max((r for r in changed if r[0] == row[0]), key=lambda r: r[4])
            now[row[0]] = latest if sum(r[0] == row[0] and r[4] == latest[4] for r in changed) == 1 else min((r for r in changed if r[0] == row[0] and r[4] == latest[4]), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
        for k in gone:
            now.pop(k, None)
        notes = spark.createDataFrame(list(now.values()), NOTE)
        same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
        assert same(views.read("tags"), kn.tag_counts(kn.note_tags(notes)))
        assert same(views.links(), kn.note_links(notes))
        assert same(views.heatmap(86_400 * 10, 10), kn.heatmap(notes, 86_400 * 10, 10))


def test_only_touched_keys_are_written_and_repeats_change_nothing(spark, tmp_path, monkeypatch):
    views = NoteViews(spark, str(tmp_path))
    base = spark.range(400).selectExpr("id AS note_id", "'n' || id AS title", "'#t' || id % 50 || ' [[n' || (id + 1) || ']]' AS content", "id * 100 AS created_at", "id * 100 AS updated_at")
    first = views.apply(base, 0)
    one = spark.createDataFrame([(7, "n7", "#t7 #new [[n8]]", 700, 701)], NOTE)
    small = views.apply(one, 1)
    held = views.tables["tags"].state().segments[-1]
    assert small["links"] < first["links"] and held.rows == 1
    # the title stays with its note, so none but the changed note's own links are resolved again
    assert views.tables["links"].state().segments[-1].rows == 1
    assert all(size == 0 for size in views.apply(one, 1).values())
    renamed = spark.createDataFrame([(7, "other", "#t7 #new [[n8]]", 700, 702)], NOTE)
    views.apply(renamed, 2)
    assert views.links().where("source_id = 6").count() == 0 and views.links().where("source_id = 7").count() == 1
    assert views.read("tags").where("tag = 't7'").first().n == 8


def test_a_batch_that_failed_half_way_is_repeated(spark, tmp_path, monkeypatch):
    base = spark.createDataFrame([(k, f"n{k}", f"#x [[n{(k + 1) % 5}]]", 0, 0) for k in range(5)], NOTE)
    change = spark.createDataFrame([(1, "n9", "#y [[n3]]", 0, 90_000), (2, "n1", "[[n9]]", 0, 1)], NOTE)
    for table in ("days", "links", "state"):
        views = NoteViews(spark, str(tmp_path / table))
        views.apply(base, 0)
        with monkeypatch.context() as patch:
            patch.setattr(views.tables[table], "upsert", lambda *a, **k: 1 / 0)
            try:
                views.apply(change, 1)
            except ZeroDivisionError:
                pass
        views.apply(change, 1)
        now = spark.createDataFrame([*[r for r in base.collect() if r.note_id not in (1, 2)], *change.collect()], NOTE)
        assert set(map(tuple, views.links().collect())) == set(map(tuple, kn.note_links(now).collect())), table
        assert set(map(tuple, views.read("tags").collect())) == set(map(tuple, kn.tag_counts(kn.note_tags(now)).collect())), table


def test_the_store_agrees_with_the_relations(spark, tmp_path):
    schema = "note_id long, title string, content string, folder_id long, created_at long, updated_at long"
    notes = spark.createDataFrame([(k, f"n{k}", "c", k % 3, 0, 0) for k in range(1, 8)], schema)
    store = NoteStore(spark, str(tmp_path)).build(notes)
    ids = lambda *ks: spark.createDataFrame([(k,) for k in ks], "note_id long")
    rows = lambda some, schema: spark.createDataFrame(some, schema)
    for number in range(3):
        change = rows([(1, f"a{number}", f"v{number}"), (99, "x", "x")], "note_id long, title string, content string")
        assert store.save(change, number + 1, number, keep=2) > 0 and store.save(change, number + 1, number) == 0
    assert {(r.version_id, r.content) for r in store.versions.read().collect()} == {(2, "v0"), (3, "v1")}
    store.restore(rows([(1, 2)], "note_id long, version_id long"), 9, 0)
    store.rename(rows([(2, "two")], "note_id long, title string"), 9, 0)
    store.move(rows([(3, 7), (4, None), (5, 2)], "note_id long, folder_id long"), 9, 0, rows([(2,)], "folder_id long"))
    store.duplicate(ids(2), 10, 0)
    store.delete(ids(6, 98), 0)
    store.create(rows([("fresh", None, None)], "title string, content string, folder_id long"), 11, 0)
    got = sorted((r.note_id, r.title, r.content, r.folder_id, r.updated_at) for r in store.notes.read().collect())
    assert [g[:4] for g in got[:6]] == [(1, "a0", "v0", 1), (2, "two", "c", 2), (3, "n3", "c", 7), (4, "n4", "c", None), (5, "n5", "c", 2), (7, "n7", "c", 1)]
    assert [g[1:] for g in got[6:]] == [("two (copy)", "c", 2, 10), ("fresh", None, None, 11)] and len({g[0] for g in got}) == 8
    assert store.versions.read().where("note_id = 1").agg(F.max("version_id")).first()[0] == 4


def test_large_batches_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    n = 40_000
    rows = spark.range(n).selectExpr("id AS note_id", "'note number ' || md5(CAST(id AS STRING)) AS title", "'#t' || id % 7 || ' [[note-' || id || ']]' AS content", "0L AS created_at", "id AS updated_at")
    views = NoteViews(spark, f"file://{tmp_path}/views")
    views.apply(rows, 0)
    views.apply(rows.where("note_id % 2 = 0"), 1)
    assert "Broadcast" not in views.read("state")._jdf.queryExecution().executedPlan().toString()
    assert views.read("state").count() == n and views.read("tags").agg({"n": "sum"}).first()[0] == n


def test_a_new_version_leaves_the_older_ones_where_they_are(spark, tmp_path):
    content = lambda number: f"repeat(md5(concat({number}, id)), 1) || sha2(concat(id, {number}), 512) || sha2(concat('x', id, {number}), 512) AS content"
    ids = spark.range(2_000)
    store = NoteStore(spark, str(tmp_path)).build(ids.selectExpr("id AS note_id", "'t' AS title", content(-1), "1L AS folder_id", "0L AS created_at", "0L AS updated_at"))
    wrote = [store.save(ids.selectExpr("id AS note_id", f"'t{number}' AS title", content(number)), (5, 9, 7, 1)[number], number, keep=3) for number in range(4)]
    assert wrote[3] < 1.1 * wrote[0]
    # the newest three by time: the last of the four is older than all and does not stay
    assert {(r.note_id, r.version_id, r.title, r.created_at) for r in store.versions.read().where("note_id < 2").collect()} == {(k, v, t, at) for k in (0, 1) for v, t, at in ((1, "t", 5), (2, "t0", 9), (3, "t1", 7))}
    store.save(ids.where("id < 2").selectExpr("id AS note_id", "'last' AS title", "'c' AS content"), 8, 4, keep=3)
    assert {(r.version_id, r.title) for r in store.versions.read().where("note_id = 1").collect()} == {(2, "t0"), (3, "t1"), (4, "t3")}
    store.delete(ids.selectExpr("id AS note_id").where("id > 0"), 0)
    assert {r.note_id for r in store.versions.read().select("note_id").collect()} == {0}
