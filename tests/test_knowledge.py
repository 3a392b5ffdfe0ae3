import re
import pytest
from pyspark.sql import functions as F

from marginalia.operators import articles as ar
from marginalia.operators import ingest as ing
from marginalia.operators import knowledge as kn
from marginalia.operators import vault


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "A", "see [[B]] and [[B|x]] #T1", 1, 10, 20), (2, "B", "plain A here [[B]]", 2, 10, 30), (3, "B", "newer #t1 A", None, 10, 40), (4, "C", "A [[A]]", 2, 10, 10)]
    return spark.createDataFrame(rows, "note_id long, title string, content string, folder_id long, created_at long, updated_at long")


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame([(1, "r", None, False), (2, "a/b", 1, True), (3, "c", 2, False), (7, "x", 8, False), (8, "y", 7, False)], "id long, name string, parent_id long, locked boolean")


def test_access(notes, folders):
    blocked = kn.blocked_folders(folders)
    assert {r.note_id for r in kn.accessible(notes, blocked).collect()} == {1, 3}
    assert kn.accessible(notes, kn.blocked_folders(folders, [2])).count() == 4
    assert {r.note_id: (r.title, r.locked) for r in kn.masked(notes, blocked).collect()} == {1: ("A", False), 2: ("", True), 3: ("B", False), 4: ("", True)}


def test_links_go_to_the_note_updated_last(notes):
    links = kn.note_links(notes)
    assert {tuple(r) for r in links.collect()} == {(1, 3), (2, 3), (4, 1)}
    assert [r.note_id for r in kn.unlinked_mentions(notes, links, 1, "A").orderBy("note_id").collect()] == [2, 3]
    assert {tuple(r) for r in kn.all_unlinked_mentions(notes, links).collect()} >= {(2, 1), (3, 1)}
    assert kn.graph_edges(links, notes.where("note_id != 3")).count() == 1


def test_mentions_of_all_titles_are_whole_words(spark):
    rows = [(1, "laí", "x"), (2, "New York", "in laíjara, laí!"), (3, "c", "a New  York-trip; New York"), (4, "d", "[[New York]] and a new york"), (5, "e", "NewYork la [[laí]]"), (6, "a b a", "a b a b"), (7, "...", "..."), (8, "f", "New (York) a b-a")]
    notes = spark.createDataFrame([(i, t, c, i) for i, t, c in rows], "note_id long, title string, content string, updated_at long")
    links = spark.createDataFrame([(8, 2)], "source_id long, target_id long")
    found = {tuple(r) for r in kn.all_unlinked_mentions(notes, links).collect()}
    words = lambda t: " " + " ".join(re.findall(r"[\w-]+", t)) + " "
    brute = {(i, j) for i, _, c in rows for j, t, _ in rows if i != j and words(t).strip() and words(t) in words(c.replace(f"[[{t}]]", " | "))}
    assert found == brute - {(8, 2)} and (3, 2) in found and (5, 1) not in found and (2, 1) in found
    changed, kept = kn.mention_linked(notes, links, 3, "New York")
    assert "[[New York]]" in changed.where("note_id = 3").first().content and {tuple(r) for r in kept.collect()} == {(8, 2), (3, 2)}


def test_tags(notes):
    tags = kn.note_tags(notes)
    assert [tuple(r) for r in kn.tag_counts(tags).collect()] == [("t1", 2)]
    assert kn.notes_by_tag(notes, tags, "#T1").count() == 2 and kn.filtered_tags(kn.tag_counts(tags), "").count() == 1


def test_folder_tree_with_a_cycle(folders, notes):
    found = {(r.ancestor, r.id): r.depth for r in kn.closure(folders).collect()}
    assert found[1, 3] == 2 and found[7, 8] == 1 and found[7, 7] == 0 and (3, 1) not in found
    assert {(r.id, r.depth) for r in kn.subtree(folders, 7).collect()} == {(7, 0), (8, 1)} and kn.subtree(folders, 99).count() == 0
    assert kn.is_within(folders, 3, 1) and kn.is_within(folders, 3, 3) and not kn.is_within(folders, 1, 3)
    assert [t["id"] for t in kn.folder_tree(folders.where("id < 7"))] and kn.folder_tree(folders, 1)[0]["children"]
    assert not kn.can_move(folders, 1, 3) and not kn.can_move(folders, 1, 1) and kn.can_move(folders, 3, 1) and kn.can_move(folders, 1, None)
    paths = {r.note_id: r.path for r in kn.export_paths(notes.withColumn("title", F.lit("t?")), folders.where("id < 7")).collect()}
    assert paths == {1: "r/t-.md", 2: "r/a-b/t-_2.md", 3: "t-.md", 4: "r/a-b/t-_4.md"}


def test_deep_folders(spark):
    chain = spark.createDataFrame([(i, str(i), i - 1 if i else None, False) for i in range(130)], "id long, name string, parent_id long, locked boolean")
    assert kn.subtree(chain, 0).count() == 130 and kn.subtree(chain, 100).agg(F.max("depth")).first()[0] == 29


CELLS = [None, "", "12abc", "5", "-3.5", "abc", "true", "false", "2024-01-05", "X"]


@pytest.mark.parametrize(("kind", "op", "value", "want"), [
    ("text", "contains", "AB", {"12abc", "abc"}), ("text", "equals", "x", {"X"}), ("text", "is_empty", None, {None, ""}), ("text", "is_not_empty", None, set(CELLS) - {None, ""}),
    ("number", "=", "12", {"12abc"}), ("number", "!=", 5, {"12abc", "-3.5", "2024-01-05"}), ("number", "<", 0, {"-3.5"}), ("number", ">=", 12, {"12abc", "2024-01-05"}),
    ("date", "on", "2024-01-05", {"2024-01-05"}), ("date", "between", ["2024-01-01", ""], set()), ("date", "after", "2024", {"2024-01-05", "abc", "true", "false", "5", "X"}),
    ("boolean", "is_true", None, {"true"}), ("boolean", "is_false", None, set(CELLS) - {"true"}), ("select", "any_of", ["X", ""], {"X", "", None}), ("select", "none_of", ["X"], set(CELLS) - {"X"}),
])
def test_property_filters(spark, kind, op, value, want):
    df = spark.createDataFrame([(v,) for v in CELLS], "value string")
    assert {r.value for r in df.where(kn.property_filter(kind, op, value)).collect()} == want


def test_filters_that_are_not_active(spark):
    assert kn.property_filter("text", "contains", "") is None and kn.property_filter("select", "any_of", ["", None]) is None and kn.property_filter("text", "", "x") is None
    cells = spark.createDataFrame([("12 kg",), ("x",), (None,)], "value string")
    assert cells.where(kn.property_filter("number", "=", "abc")).count() == 0 and [r.value for r in cells.where(kn.property_filter("number", "=", " 12abc")).collect()] == ["12 kg"]
    view = spark.createDataFrame([(1, "p", "a"), (2, "p", None)], "note_id long, name string, value string")
    assert kn.filtered_notes(view, [("p", "text", "contains", "")]).count() == 2
    assert [r.note_id for r in kn.filtered_notes(view, [("p", "text", "contains", "A"), ("none", "text", "equals", "z")]).collect()] == [1]


def test_boards(spark):
    view = spark.createDataFrame([(1, "s", "a"), (2, "s", " "), (3, "s", "odd"), (4, "s", None)], "note_id long, name string, value string")
    rows = lambda **k: [(r.column, r.n, r.note_ids) for r in kn.board(view, "s", ["b", "a"], **k).orderBy("place", "column").collect()]
    assert rows() == [("__unset__", 2, [2, 4]), ("b", 0, []), ("a", 1, [1])]
    assert rows(unknown=True) == [("b", 0, []), ("a", 1, [1]), ("__unset__", 2, [2, 4]), ("odd", 1, [3])]


def test_moves_keep_positions_whole(spark):
    defs = spark.createDataFrame([(i, 1, f"d{i}", i) for i in range(5)], "def_id long, folder_id long, name string, position int")
    for a, b, want in ((0, 3, [1, 2, 3, 0, 4]), (4, 1, [0, 4, 1, 2, 3]), (2, 2, [0, 1, 2, 3, 4])):
        assert [r.def_id for r in kn.moved(defs, a, b).orderBy("position").collect()] == want


def test_heatmap_across_midnight(spark):
    day = 86_400
    df = spark.createDataFrame([(1, 20 * day - 1, 20 * day), (2, 20 * day, 20 * day + 5), (3, 1, 20 * day)], "note_id long, created_at long, updated_at long")
    got = {str(r.date): (r.created, r.modified) for r in kn.heatmap(df, 21 * day, 5).collect()}
    assert got == {"1970-01-20": (1, 0), "1970-01-21": (1, 2)}
    grid = kn.heat_grid(kn.heatmap(df, 21 * day, 5), "1970-01-21").collect()
    assert len(grid) == 371 and sum(r.total or 0 for r in grid) == 4 and sum(r.total is None for r in grid) == 4


def test_free_titles(spark):
    df = spark.createDataFrame([("d",), ("d (2)",), ("d (x)",)], "title string")
    assert kn.free_title(df, "d") == "d (3)" and kn.free_title(df, "e") == "e"


def test_audit(spark, notes, folders):
    rows = [(1, "chat", "note", 2, "n", "d", 5), (2, "chat", "NOTE", 1, "x%y", None, 6), (3, "odd", "note", 99, "n", "d", 7), (4, "chat", "file", 2, "n", "D_", 8)]
    log = spark.createDataFrame(rows, "id long, action string, resource_type string, resource_id long, resource_name string, detail string, created_at long")
    shown = kn.visible_log(log, notes, kn.blocked_folders(folders))
    assert {r.id for r in shown.collect()} == {2, 3, 4}
    assert [r.id for r in kn.log_page(log, 1, 2).collect()] == [4, 3] and [r.id for r in kn.log_page(log, 0, 500).collect()] == [4, 3, 2, 1]
    assert {r.id for r in kn.searched_log(log, None, " d ").collect()} == {1, 3, 4} and kn.searched_log(log, ["chat"], "").count() == 3
    assert kn.expired(log, 0, 9).count() == 0 and kn.pruned(log, 0, 9).count() == 4 and kn.expired(log, 1, 86_407).count() == 2
    with pytest.raises(ValueError, match="negative"):
        kn.pruned(log, -1, 9)
    assert len(kn.actions_of("nope")) == 16


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(kn.upserted(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c")] == rows(kn.upserted(kn.upserted(old, new, ["k"]), new, ["k"]))
    assert rows(kn.inserted_or_ignored(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(kn.without_keys(old, new, ["k"])) == [(1, "a")]


def test_articles(spark):
    body = "<p>" + "word " * 60 + "</p>"
    page = lambda t, b=body: f"<html><head><title>{t}</title></head><body>{b}</body></html>"
    rows = [(1, "http://x/Good", page("Good")), (2, "http://x/-/style", page("S")), (3, "http://x/File:Q", page("Q")), (4, "http://x/Short", page("S", "<p>x</p>")), (5, "http://x/D", page("D (disambiguation)")), (6, "http://x/R", '<meta HTTP-EQUIV="Refresh">' + body), (7, "http://x/Mercury_(disambiguation)", page("M"))]
    assert [r.page_id for r in ar.articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [1]


def test_links_across_bundles(spark):
    bundles = spark.createDataFrame([("b1", "X", "t"), ("b2", "A/X", "a"), ("b2", "Y", None)], "bundle_id string, path string, title string")
    wanted = spark.createDataFrame([(1, "./A/X#f"), (2, "Z"), (3, "/wiki/Y")], "id int, wanted string")
    got = lambda current: {r.id: (r.bundle_id, r.path) for r in ar.resolved_links(wanted, "id", bundles, current).collect()}
    assert got("b1") == {1: ("b1", "X"), 3: ("b2", "Y")} and got(None)[1] == ("b2", "A/X")


def test_chat_context(spark):
    turns = spark.createDataFrame([(1, 0, "user", "old"), (1, 1, "user", "What have I written about llamas"), (1, 2, "assistant", "q"), (1, 3, "user", "and tell me about y?"), (2, 0, "user", "please explain tea"), (3, 0, "user", " tell me about ")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r["query"] for r in ar.chat_queries(turns).collect()} == {1: "llamas and y?", 2: "please explain tea", 3: " tell me about "}
    section = lambda *rows: spark.createDataFrame(rows, "rank int, title string, body string")
    got = [tuple(r) for r in ar.context([("daily", section((1, "T", "a"))), ("notes", section((1, "T", "b"), (2, "U", "c"), (3, "V", "d")))], cap=1).collect()]
    assert got == [("daily", "## T\na"), ("notes", "## U\nc\n… 1 more")]


def test_highlights(spark):
    df = spark.createDataFrame([("b1", "active"), ("b2", "active")], "bundle_id string, status string")
    assert {tuple(r) for r in ar.orphaned(df, "b1").collect()} == {(None, "orphaned"), ("b2", "active")}


def test_encryption(spark):
    key, other = F.lit(b"k" * 32), F.lit(b"o" * 32)
    df = spark.createDataFrame([(1, 2, "héllo"), (2, 3, "")], "note_id long, folder_id long, content string")
    locked = vault.reencrypted(df, spark.createDataFrame([(2,)], "folder_id long"), None, key)
    (row,) = locked.where("note_id = 1").select("content", vault.decrypted(F.col("content"), key).alias("a"), vault.decrypted(F.col("content"), other).alias("b"), vault.note_text(F.lit("plain"), key).alias("c")).collect()
    assert (row.a, row.b, row.c) == ("héllo", None, "plain") and row.content != "héllo" and "\n" not in row.content
    assert vault.reencrypted(locked, spark.createDataFrame([(2,)], "folder_id long"), key, None).where("note_id = 1").first().content == "héllo"


def test_settings(spark):
    rows = spark.createDataFrame([("retries", "99"), ("audit_enabled", "false"), ("reading_wpm", "x")], "key string, value string")
    assert vault.Settings.of(rows) == vault.Settings(retries=10, audit_enabled=False)


def test_chunks_and_reindexing(spark):
    df = spark.createDataFrame([(1, "T", "One\n\nTwo", 1), (2, "U", " ", 1)], "note_id long, title string, content string, updated_at long")
    rows = ing.note_chunks(df).orderBy("chunk_index").collect()
    assert [(r.note_id, r.content, r.text) for r in rows] == [(1, "One", "search_document: T\nOne"), (1, "Two", "search_document: T\nTwo")]
    index = ing.embedded(ing.note_chunks(df), "text").select("note_id", "chunk_index", "content", "vector")
    once = ing.reindexed(index, df.withColumn("content", F.lit("New")))
    assert [r.content for r in ing.reindexed(once, df.withColumn("content", F.lit("New"))).orderBy("note_id").collect()] == ["New", "New"]
    queue = spark.createDataFrame([(0, 1), (1, 2)], "pos int, note_id long")
    assert ing.can_resume("m", "m", 2, 1, queue, queue) and not ing.can_resume("m", "n", 2, 1, queue, queue) and not ing.can_resume("m", "m", 2, 2, queue, queue) and not ing.can_resume("m", "m", 2, 1, queue, queue.limit(1))


def test_synthetic_notes_are_seeded(spark):
    a, b = (vault.synthetic_notes(spark, 300, 9, seed=s).collect() for s in (1, 1))
    assert a == b != vault.synthetic_notes(spark, 300, 9, seed=2).collect() and len(a) == 300
    assert 0.3 < sum(r.style == "structured" for r in a) / 300 < 0.5


def test_embeds_are_expanded(spark):
    from marginalia.operators.embeds import expanded

    rows = [(1, "A", "a ![[B]] z"), (2, "B", "b![[C]]"), (3, "C", "c![[A]]"), (4, "D", "![[none]]![[L]]"), (5, "L", "secret"), (6, "E", None)] + [(10 + i, f"N{i}", f"{i}![[N{i + 1}]]") for i in range(9)]
    df = spark.createDataFrame([(i, t, c, 9 if t == "L" else 1, i) for i, t, c in rows], "note_id long, title string, content string, folder_id long, updated_at long")
    got = {r.note_id: (r.text, r.faults) for r in expanded(df, spark.createDataFrame([(9,)], "folder_id long")).collect()}
    assert got[1] == ("a bc[circular: A] z", 1) and got[4] == ("[missing: none][locked: L]", 2) and got[6] == ("", 0)
    assert got[10] == ("012345[too deep: N6]", 1)
