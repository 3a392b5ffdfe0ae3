"""The note store against plain dictionaries, and the composites over stored tables."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import articles as ar
from marginalia.operators import ingest as ing
from marginalia.operators import knowledge as kn
from marginalia.operators import notes as ns
from marginalia.operators import vault
from marginalia.operators.storage import KeyedTable
from marginalia.plans.queries import QUERIES
from marginalia.sources import files as fi


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "A", "one", None, 5, 5), (2, "B", "two", 7, 6, 9), (3, "C", "three", 8, 7, 8)]
    return spark.createDataFrame(rows, "note_id long, title string, content string, folder_id long, created_at long, updated_at long")


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame([(7, "f", None, False), (8, "g", 7, False), (9, "h", None, True)], "id long, name string, parent_id long, locked boolean")


def by_id(df, *columns):
    return {r.note_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_places_are_those_of_the_order_over_many_ranges(spark):
    rows = spark.range(20_000, numPartitions=7).selectExpr("(id * 7919) % 20011 AS note_id", "'t' || (id % 50) AS title", "id % 90 AS created_at", "id % 11 AS updated_at")
    got = {(r.note_id, r.place) for r in ns.places(ns.listed(rows, "name"), "note_id", "place").collect()}
    assert got == {(r.note_id, i) for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.title, r.note_id)), 1)}
    # one row keeps no list of all
    plan = QUERIES["sr4_note_list_sort"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan


def test_saving_keeps_versions_and_restoring_brings_them_back(spark, notes):
    versions = spark.createDataFrame([], "note_id long, version_id long, title string, content string, created_at long")
    now_, kept = notes, versions
    for turn in range(4):
        change = spark.createDataFrame([(2, f"B{turn}", f"two{turn}"), (99, "x", "y")], "note_id long, title string, content string")
        now_, kept = ns.saved(now_, kept, change, 100 + turn, keep=3)
        now_, kept = (spark.createDataFrame(df.collect(), df.schema) for df in (now_, kept))
    assert by_id(now_, "title", "content", "updated_at") == {1: ("A", "one", 5), 2: ("B3", "two3", 103), 3: ("C", "three", 8)}
    assert {(r.version_id, r.title) for r in kept.collect()} == {(2, "B0"), (3, "B1"), (4, "B2")}
    back, kept = ns.restored(now_, kept, spark.createDataFrame([(2, 3)], "note_id long, version_id long"), 200, keep=3)
    assert by_id(back, "title", "content")[2] == ("B1", "two1") and {r.title for r in kept.collect()} == {"B1", "B2", "B3"}


def test_life_cycle(spark, notes, folders):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "note_id long")
    assert by_id(ns.renamed(notes, spark.createDataFrame([(1, "Z")], "note_id long, title string"), 50), "title")[1] == "Z"
    places = spark.createDataFrame([(1, 9), (2, None), (3, 7)], "note_id long, folder_id long")
    assert by_id(ns.moved(notes, places, 50, kn.blocked_folders(folders)), "folder_id") == {1: None, 2: None, 3: 7}
    twice = ns.duplicated(notes, ids(2, 3), 100, 60).collect()
    assert len(twice) == 5 and len({r.note_id for r in twice}) == 5 and {(r.title, r.folder_id) for r in twice if r.note_id >= 100} == {("B (copy)", 7), ("C (copy)", 8)}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source_id long, target_id long")
    rest, related = ns.deleted(notes, ids(2), {"links": (links, ["source_id", "target_id"])})
    assert set(by_id(rest, "title")) == {1, 3} and [tuple(r) for r in related["links"].collect()] == [(3, 1)]
    files = spark.createDataFrame([("/x/Plan.v2.md", "text", None), ("/x/.md", "hidden", None), ("/x/bad.pdf", None, "unsupported format")], "path string, content string, error string")
    assert {r.title for r in ns.imported(notes, files, 7, 500, 9).where("note_id >= 500").collect()} == {"Plan.v2", ".md"}
    assert [r.note_id for r in ns.listed(notes, "modified").collect()] == [2, 3, 1] and [r.title for r in ns.listed(notes, "name").collect()] == ["A", "B", "C"]
    assert ns.in_folder(notes, None).count() == ns.in_folder(notes, 7).count() == 1 and ns.by_id(notes, folders, 2).first().folder == "f"
    page = spark.range(1).select(ns.as_markdown(F.lit("T"), F.lit("b")).alias("m"), ns.as_html(F.lit("a<b"), F.lit("<p>x</p>")).alias("h")).first()
    assert page.m == "# T\n\nb" and "<title>a&lt;b</title>" in page.h and "<p>x</p>" in page.h


def test_folders(folders):
    assert [r.id for r in ns.folders_near(folders, 7).collect()] == [8, 7, 9] and {r.name for r in ns.masked_folders(folders).collect()} == {"f", "g", "<locked>"}
    assert ns.root_named(folders, "g").count() == 0 and ns.root_named(folders, "h").first().id == 9
    assert ns.folder_moved(folders, 8, 9).where("id = 8").first().parent_id == 9
    with pytest.raises(ValueError, match="below itself"):
        ns.folder_moved(folders, 7, 8)


def test_locks(spark, notes, folders):
    key = vault.derived_key("pass word", b"salt" * 4)
    assert len(key) == 32 and key == vault.derived_key("pass word", b"salt" * 4) != vault.derived_key("other", b"salt" * 4)
    lit, wrong = F.lit(key), F.lit(b"w" * 32)
    check = spark.range(1).select(vault.sentinel(lit).alias("s")).select(vault.opens(F.col("s"), lit), vault.opens(F.col("s"), wrong), vault.opens(F.lit("junk"), lit)).first()
    assert tuple(check) == (True, False, False)
    chunks = spark.createDataFrame([(1,), (2,), (2,), (3,)], "note_id long")
    shut, hidden, purged = ns.locked(folders, notes, 7, lit, {"chunks": chunks})
    assert {r.id: r.locked for r in shut.collect()} == {7: True, 8: True, 9: True} and [r.note_id for r in purged["chunks"].collect()] == [1]
    stored = by_id(hidden, "content")
    assert stored[1] == "one" and "two" not in stored[2] and "three" not in stored[3]
    open_, plain, again = ns.unlocked(shut, hidden, 7, lit)
    assert by_id(plain, "content") == by_id(notes, "content") and {r.note_id for r in again.collect()} == {2, 3} and open_.where("locked").count() == 1


DEFS = "def_id long, folder_id long, name string, type string, options string, position int, template_id long"


def test_properties(spark, notes):
    defs = spark.createDataFrame([(1, 7, "state", "text", None, 0, None), (2, 8, "due", "date", None, 4, None)], DEFS)
    more = ns.with_definition(ns.with_definition(defs, 3, 7, "n", "number"), 4, 7, "state", "text")
    assert {(r.def_id, r.position) for r in more.collect()} == {(1, 0), (2, 4), (3, 1)}
    assert ns.with_definition(defs, 5, 1, "x", "select", "[]").where("def_id = 5").first().position == 0
    with pytest.raises(ValueError, match="unknown type"):
        ns.with_definition(defs, 5, 1, "x", "colour")
    cells = spark.createDataFrame([(2, 1, "old")], "note_id long, def_id long, value string")
    values = spark.createDataFrame([(2, 1, "new"), (3, 2, "2024"), (1, 1, "no folder"), (2, 2, "other folder")], "note_id long, def_id long, value string")
    after, refused = ns.with_values(cells, notes, defs, values)
    assert {tuple(r) for r in after.collect()} == {(2, 1, "new"), (3, 2, "2024")} and {r.value for r in refused.collect()} == {"no folder", "other folder"}
    left, rest = ns.without_definition(defs, after, 1)
    assert left.count() == rest.count() == 1
    assert {tuple(r) for r in ns.named_values(after, defs).collect()} == {(2, "state", "new"), (3, "due", "2024")}


def test_templates(spark, notes):
    templates = spark.createDataFrame([(5, '[{"name":"state","type":"select","options":"[1]"},{"name":"due","type":"date"},{"name":"bad","type":"colour"}]'), (6, "not json"), (7, None)], "template_id long, properties string")
    wanted = ns.specs(templates)
    assert {(r.template_id, r.name) for r in wanted.collect()} == {(5, "state"), (5, "due")}
    defs = spark.createDataFrame([(1, 7, "state", "text", "[0]", 3, None), (2, 8, "due", "date", None, 0, 9)], DEFS)
    stamped = notes.withColumn("template_id", F.when(F.col("note_id") == 3, 4).cast("long"))
    cells = spark.createDataFrame([(2, 1, "set")], "note_id long, def_id long, value string")
    more, after, filled = ns.template_applied(stamped, defs, cells, wanted.drop("template_id"), 5, 7, 100)
    assert {(r.def_id, r.folder_id, r.name, r.options, r.position, r.template_id) for r in after.collect()} == {(1, 7, "state", "[1]", 3, 5), (2, 8, "due", None, 0, 9), (100, 7, "due", None, 4, 5)}
    assert {tuple(r) for r in filled.collect()} == {(2, 1, "set"), (2, 100, "")} and by_id(more, "template_id") == {1: None, 2: 5, 3: 4}
    more, after, filled = ns.template_applied(stamped, defs, cells, wanted.drop("template_id"), 5, 8, 100, note_id=3)
    assert by_id(more, "template_id") == {1: None, 2: None, 3: 5} and {(r.def_id, r.name, r.options) for r in after.where("folder_id = 8").collect()} == {(2, "due", None), (100, "state", "[1]")}
    assert {(r.note_id, r.def_id) for r in filled.collect()} == {(2, 1), (3, 2), (3, 100)}


def test_bookmarks_and_highlights(spark, notes):
    marks = spark.createDataFrame([(3, 0, 10), (99, 1, 11)], "note_id long, position int, added_at long")
    more = ns.bookmarked(ns.bookmarked(marks, 1, 20), 3, 21)
    assert [(r.note_id, r.added_at) for r in ns.bookmarks(more, notes).collect()] == [(3, 10), (1, 20)] and ns.unmarked(more, 3).count() == 2
    rows = spark.createDataFrame([(1, "b", "p", "active", 5), (2, "b", "p", "orphaned", 4), (3, "b", "q", "active", 3), (4, "b", "p", "active", 1)], "id long, bundle_id string, path string, status string, created_at long")
    assert [r.id for r in ns.highlights_of(rows, "b", "p").collect()] == [4, 1]
    assert ns.highlighted(rows, rows.where("id = 3").withColumn("path", F.lit("p"))).where("path = 'p'").count() == 4


def test_reindexing_goes_on_where_it_stopped(spark, tmp_path):
    notes = spark.createDataFrame([(i, f"t{i}", f"line {i}\nmore", i) for i in range(30)], "note_id long, title string, content string, updated_at long")
    table = KeyedTable(spark, str(tmp_path / "v"), ["note_id"])
    calls = []

    def run(batches):
        return ing.reindex_all(table, batches, "m", ing.hashing_embedder(8), dims=8, batches=4)

    keep = ing.index_notes

    def failing(*args, **options):
        calls.append(args[2])
        if len(calls) == 3:
            raise RuntimeError("lost")
        keep(*args, **options)

    ing.index_notes = failing
    try:
        with pytest.raises(RuntimeError, match="lost"):
            run(notes)
    finally:
        ing.index_notes = keep
    assert 0 < table.read().select("note_id").distinct().count() < 30
    assert run(notes) == 2 and table.read().count() == 60 and run(notes) == 0
    fewer = notes.where("note_id < 20").withColumn("content", F.lit("only"))
    assert run(fewer) == 4 and table.read().count() == 20 and table.read().first().content == "only"
    with pytest.raises(ValueError, match="dimensions"):
        ing.index_notes(table, notes, 0, ing.hashing_embedder(9), dims=8, stream="x")


def test_a_reindexed_collection_is_not_written_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("marginalia.operators.storage.shared_dir", lambda spark: str(tmp_path / "scratch"))
    notes = spark.range(40).selectExpr("id AS note_id", "'t' AS title", "'old' AS content")
    table = KeyedTable(spark, str(tmp_path / "v"), ["note_id"])
    run = lambda rows, model, batches=3: ing.reindex_all(table, rows, model, ing.hashing_embedder(8), 8, batches)
    assert run(notes, "a") == 3 and run(notes.where("note_id < 30").withColumn("content", F.lit("new")), "b") == 3
    assert {s.rows for s in table.state().segments} == {s.rows for s in table.state(table.state().version - 1).segments[-3:]} and len(table.state().segments) == 3
    assert "Join" not in table.read()._jdf.queryExecution().optimizedPlan().toString() and not (tmp_path / "scratch").exists()
    assert sorted((r.note_id, r.content) for r in table.read().collect()) == [(i, "new") for i in range(30)]
    # another number of batches deals notes anew, so it is another job
    assert run(notes.where("note_id < 30"), "b", 2) == 2 and len(table.state().segments) == 2
    ing.index_notes(table, notes.where("note_id = 3").withColumn("content", F.lit("later\nand more")), 0, ing.hashing_embedder(8), 8)
    assert sorted((r.note_id, r.content) for r in table.read().collect()) == sorted([(i, "old") for i in range(30) if i != 3] + [(3, "later"), (3, "and more")])


def test_changes_during_a_reindexing_stay(spark, tmp_path, monkeypatch):
    notes = spark.range(20).selectExpr("id AS note_id", "'t' AS title", "'old' AS content")
    table, keep, calls = KeyedTable(spark, str(tmp_path / "v"), ["note_id"]), ing.index_notes, []
    embedder = ing.hashing_embedder(8)
    keep(table, spark.range(15, 25).selectExpr("id AS note_id", "'t' AS title", "'before' AS content"), 0, embedder, 8)

    def disturbed(*args, **options):
        keep(*args, **options)
        if not calls:
            calls.append(keep(table, notes.where("note_id < 4").withColumn("content", F.lit("changed")), 1, embedder, 8))

    monkeypatch.setattr(ing, "index_notes", disturbed)
    ing.reindex_all(table, notes, "m", embedder, 8, batches=2)
    got = {r.note_id: r.content for r in table.read().collect()}
    second = {r.note_id for r in notes.where(F.pmod(F.xxhash64("note_id", F.lit(5)), F.lit(2)) == 1).collect()}
    assert got == {i: "changed" if i < 4 and i not in second else "old" for i in range(20)}


def test_articles_are_indexed_in_batches(spark, tmp_path):
    body = "<html><head><title>T{0}</title></head><body><p>" + "words and more words " * 20 + "</p></body></html>"
    pages = spark.createDataFrame([(i, f"http://x/P{i}", body.format(i)) for i in range(9)] + [(9, "http://x/File:Q", body)], "page_id long, url string, html string")
    table = KeyedTable(spark, str(tmp_path / "a"), ["bundle_id", "path"])
    assert ing.index_articles(table, pages, "b1", dims=16, batches=3) == 3 and table.read().count() == 9
    assert ing.index_articles(table, pages, "b1", dims=16, batches=3) == 0


def test_whole_articles_are_indexed(spark, tmp_path):
    words = " ".join(f"word{i}é" for i in range(900)) + " " + "x" * 3700 + " last"
    pages = spark.createDataFrame([(1, "http://x/P", f"<html><head><title>T</title></head><body><p>{words}</p><p>end 𝄞</p></body></html>")], "page_id long, url string, html string")
    table = KeyedTable(spark, str(tmp_path / "a"), ["bundle_id", "path"])
    assert ing.index_articles(table, pages, "b1", dims=16, batches=1) == 1
    parts = [r.content for r in table.read().orderBy("chunk_index").collect()]
    assert "".join("".join(parts).split()) == "".join(words.split()) + "end𝄞" and max(map(len, parts)) <= ar.CHARS
    assert [w for part in parts for w in part.split() if w.startswith("word")] == words.split()[:900]
    assert {r.path: r.n for r in ar.articles(pages).selectExpr("path", "length(content) AS n").collect()} == {"P": len(words) + 6}


def test_archives(spark):
    page = lambda to: f'<meta http-equiv="refresh" content="0;url={to}">'
    pages = spark.createDataFrame([(1, "A/One", "<p>one</p>"), (2, "Two", page("A/One")), (3, "Three", page("Two#x")), (4, "Loop", page("Loop")), (5, "Four", page("Three")), (6, "Five", page("Four")), (7, "Lost", page("Nowhere"))], "page_id long, url string, html string")
    wanted = spark.createDataFrame([("One",), ("Three",), ("Loop",), ("None",), ("Four",), ("Five",), ("Lost",)], "wanted string")
    assert {r.wanted: r.path for r in ar.read_articles(wanted, pages).collect()} == {"One": "A/One", "Three": "A/One", "Four": "A/One"}
    assert {r.wanted for r in ar.read_articles(wanted, pages, hops=4).collect()} == {"One", "Three", "Four", "Five"}
    assert [r.page_id for r in ar.scan_window(pages, 1, 2).collect()] == [1] and ar.scan_windows(pages, 2).first().window == 0


def test_lists_sets_and_salvage(spark):
    of = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, id long")
    assert kn.same_list(of(1, 2, 3), of(1, 2, 3)) and not kn.same_list(of(1, 2, 3), of(1, 3, 2)) and not kn.same_list(of(1, 2), of(1, 2, 3))
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (None, "7")], "k long, v string")
    good, bad = fi.salvaged(rows, {"no key": F.col("k").isNotNull(), "no number": F.col("v").try_cast("int").isNotNull()})
    assert good.count() == 1 and {r.fault for r in bad.collect()} == {"no key", "no number"}
    assert spark.range(1).select(fi.cases(F.lit('{"version":1,"cases":[{"id":"a","body":"b"}]}')).alias("c"), fi.cases(F.lit("bad")).alias("n")).first().c[0].body == "b"


@pytest.mark.parametrize("args, want", [((4096, 16, [(24000, False)]), "low"), ((32768, 16, [(24000, False)]), "high"), ((32768, 4, [(24000, False)]), "mid"), ((32768, 16, [(16000, True)]), "mid"), ((32768, 16, [(20480, True)]), "high"), ((12000, 8, []), "low"), ((12000, 8, [(8000, False)]), "mid"), ((12000, 8, [(8000, False)], "embedding"), "low"), ((65536, 32, [], "insufficient"), "low")])
def test_tiers(args, want):
    assert ing.tier(*args) == want and want in ing.PLANS
    assert [ing.next_batch(*x) for x in ((16, False, 16, 32), (24, False, 16, 32), (32, False, 16, 32), (32, True, 16, 32), (9, True, 16, 32), (8, False, 16, 32), (12, False, 16, 32))] == [24, 32, 32, 16, 8, 16, 16]


def test_limits_of_models(spark):
    assert ing.model_of("mxbai-embed-large:latest") == ing.Model(1024, 350, 48) and ing.model_of("nomic-embed-text") == ing.Model(768, 1500, 128)
    assert [ing.model_of("mxbai", p).cap for p in ("low", "mid", "high")] == [32, 48, 48] and [ing.model_of("x", p).cap for p in ("low", "mid", "high")] == [32, 128, 128]
    rows = spark.range(3).selectExpr("id", "repeat('x', 400 + id) AS text")
    got = ing.embedded_by(rows, "text", lambda texts: [[float(len(t))] * 1024 for t in texts], "mxbai-embed-large").collect()
    assert {len(r.text) for r in got} == {350} and all(r.fault is None and r.vector == [350.0] * 1024 for r in got)


def test_single_notes_are_written_unless_locked(spark, tmp_path):
    notes = spark.createDataFrame([(1, "a/b", "x < y", 5), (2, "t", None, None), (3, "t", "s", 6)], "note_id long, title string, content string, folder_id long")
    folders = spark.createDataFrame([(5, "F", None, False), (6, "G", None, True)], "id long, name string, parent_id long, locked boolean")
    ids = lambda *ks: spark.createDataFrame([(k,) for k in ks], "note_id long")
    assert ns.exported(notes, folders, ids(1, 2, 9), f"file://{tmp_path}/md") == 2 and ns.exported(notes, folders, ids(1), f"file://{tmp_path}/html", as_page=True) == 1
    assert (tmp_path / "md/a-b.md").read_text() == "# a/b\n\nx < y" and (tmp_path / "md/t.md").read_text() == "# t\n\n"
    assert "<h1>a/b</h1>x &lt; y" in (tmp_path / "html/a-b.html").read_text()
    with pytest.raises(PermissionError):
        ns.exported(notes, folders, ids(1, 3), f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_settings_are_kept(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "s"), ["key"])
    rows = lambda **values: spark.createDataFrame(list(values.items()), "key string, value string")
    assert vault.stored_settings(table) == vault.Settings()
    assert vault.set_settings(table, rows(retries="40", reading_wpm="7"), 0) == vault.Settings(retries=10, reading_wpm=50)
    assert vault.set_settings(table, rows(retries="-3"), 1) == vault.Settings(retries=0, reading_wpm=50) == vault.stored_settings(table)
    with pytest.raises(KeyError):
        vault.set_settings(table, rows(nope="1"), 2)
