import io
import json
import os
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions import documents
from marginalia.functions import text as tx
from marginalia.functions.documents import UDFS, csv_text
from marginalia.operators import ingest as ing
from marginalia.operators.knowledge import export_paths
from marginalia.sources import files as fi
from marginalia.streaming import ingest as st


@pytest.fixture
def folder(tmp_path):
    def docx(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:d xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>{text}</w:t></w:p></w:d>')
        return out.getvalue()

    for name, data in {"a.txt": "é".encode("utf-16"), "sub/b.CSV": b'x, "1,2" ,z\n\ny,,"q""r"', "sub/c.html": b"<h1>T</h1><p>u", "node_modules/d.md": b"# no", "e.docx": docx("hi"), "f.pdf": b"%PDF", "g.bin": b"?", "h.log": b"  "}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path / "in"


def test_scan_and_extraction(spark, folder):
    rows = fi.extracted(fi.scan(spark, str(folder), ["# comment", "node_modules"])).collect()
    got = {os.path.basename(r.path): (r.content, r.error) for r in rows}
    assert got == {"a.txt": ("é", None), "b.CSV": ('x\t1,2\tz\ny\t\tq"r', None), "c.html": ("# T\n\nu", None), "e.docx": ("hi", None), "f.pdf": (None, "no text"), "h.log": ("  ", "no text")}


def test_csv_cells():
    assert csv_text('a,"b, c\nd",e\r\n , \n"q""r", s ') == "a\tb, c d\te\nq\"r\ts" and csv_text(None) is None and csv_text("") == ""


def test_listing_reads_no_content(spark, folder, capsys):
    listed = fi.listing(spark, str(folder), ["node_modules"])
    assert {r.relative for r in listed.collect()} == {"a.txt", "sub/b.CSV", "sub/c.html", "e.docx", "f.pdf", "h.log"}
    listed.explain("formatted")
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[1].splitlines()[0]


def test_walks_prune_folders_and_read_in_tasks(spark, tmp_path, monkeypatch):
    for name in ("a.txt", "x/b.md", "x/y/z/c.csv", "skip/d.txt", "x/skip/e.txt", "x/f.bin", "x/g.log", "empty/none"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name * 3)
    (tmp_path / "locked").mkdir()
    got = {r.relative: r for r in fi.walk(spark, str(tmp_path), ["skip/", "*.log"]).collect()}
    assert set(got) == {"a.txt", "x/b.md", "x/y/z/c.csv"}
    assert all(r.path == f"{tmp_path}/{k}" and r.length == 3 * len(k) and r.mtime == int((tmp_path / k).stat().st_mtime) for k, r in got.items())
    assert {r.relative for r in fi.walk(spark, f"file://{tmp_path}/").collect()} == {"a.txt", "x/b.md", "x/y/z/c.csv", "skip/d.txt", "x/skip/e.txt", "x/g.log"}
    monkeypatch.setattr(fi, "HELD", 10)
    listed = fi.walk(spark, f"file://{tmp_path}", ["skip/", "*.log"])
    assert {r.relative: r.content.decode() for r in fi.contents(listed).collect()} == {k: k * 3 for k in got}
    (tmp_path / "a.txt").unlink()
    assert {r.path.rpartition("/")[2]: r.error for r in fi.extracted(fi.contents(listed)).collect()} == {"a.txt": "not readable", "b.md": None, "c.csv": None}
    (tmp_path / "nothing").mkdir()
    assert fi.scan(spark, f"file://{tmp_path}/nothing").count() == 0


def test_requests_that_fail_are_halved_and_lose_only_what_fails(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id = 5 THEN NULL ELSE 'text ' || id END AS text").coalesce(1)
    bad = {"text 7", "text 8", "text 131", "text 299"}
    calls = spark.sparkContext.accumulator(0)
    sizes = spark.sparkContext.accumulator(0)

    def request(texts):
        calls.add(1)
        sizes.add(len(texts))
        if bad & set(texts):
            raise RuntimeError("refused")
        if "text 200" in texts:
            return [[1.0]] * (len(texts) + 1)
        return [[float(len(t)), 0.0] if t != "text 50" else [1.0] for t in texts]

    good, faulty = ing.salvaged(ing.embedded_or_faulty(rows, "text", request, dims=2))
    assert {r.id: r.fault for r in faulty.collect()} == {7: "RuntimeError: refused", 8: "RuntimeError: refused", 131: "RuntimeError: refused", 299: "RuntimeError: refused", 200: "ValueError: 2 vectors for 1 texts", 50: "1 dimensions"}
    assert {r.id: tuple(r.vector) for r in good.collect()} == {i: (0.0 if i == 5 else float(len(f"text {i}")), 0.0) for i in range(300) if i not in (7, 8, 131, 299, 200, 50)}
    assert calls.value <= 300 / 8 + 2 * 5 * 5
    calls.value = 0
    ing.embedded_or_faulty(rows, "text", lambda texts: (calls.add(1), [[0.0]] * len(texts))[1], base=16, most=64).collect()
    assert calls.value == len([16, 24, 32, 40, 48, 56, 64, 20])


def test_folders_are_indexed_by_what_changed(spark, folder, tmp_path):
    state, chunks = st.KeyedTable(spark, str(tmp_path / "state"), ["path"]), st.KeyedTable(spark, str(tmp_path / "chunks"), ["path"])
    run = lambda n: ing.index_folder(spark, str(folder), state, chunks, n, ["node_modules"])
    names = lambda: {os.path.basename(r.path) for r in chunks.read().select("path").distinct().collect()}
    assert run(0) == {"indexed": 4, "failed": 2, "unchanged": 0, "removed": 0} and names() == {"a.txt", "b.CSV", "c.html", "e.docx"}
    assert run(1) == {"indexed": 0, "failed": 0, "unchanged": 6, "removed": 0}
    (folder / "a.txt").write_text("other words\nand more")
    os.utime(folder / "a.txt", (1, 1))
    (folder / "e.docx").unlink()
    assert run(2) == {"indexed": 1, "failed": 0, "unchanged": 4, "removed": 1} and names() == {"a.txt", "b.CSV", "c.html"}
    assert {r.content for r in chunks.read().collect() if r.path.endswith("a.txt")} == {"other words", "and more"}
    # another folder's files are not taken for gone; a run that is done does nothing
    other = tmp_path / "other"
    other.mkdir()
    (other / "new.md").write_text("hello")
    assert ing.index_folder(spark, f"file://{other}", state, chunks, 0) == {"indexed": 1, "failed": 0, "unchanged": 0, "removed": 0}
    assert run(2) == {"indexed": 0, "failed": 0, "unchanged": 0, "removed": 0} and run(3)["unchanged"] == 5
    assert names() == {"a.txt", "b.CSV", "c.html", "new.md"}


@pytest.mark.parametrize(("pattern", "path", "want"), [
    ("*.log", "a/b.log", True), ("build", "x/build/y", True), ("build", "builds/y", False), ("docs/*.md", "docs/a/b.md", True), ("docs/*.md", "other/docs/a.md", False), ("a?c", "x/abc", True),
    ("tmp/", "tmp", True), ("", "x", False), ("#x", "#x", False), ("[ab].txt", "q/b.txt", True), ("[!ab].txt", "q/b.txt", False), ("**/deep/*", "deep/x", True),
])
def test_globs(spark, pattern, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(fi.excluded(F.col("p"), [pattern])).first()[0] == want


def test_paths(spark):
    df = spark.createDataFrame([("/a", "/a/b"), ("/a/b", "/a"), ("/a", "/ab"), ("/a", "/a")], "x string, y string")
    assert [r[0] for r in df.select(fi.overlaps(F.col("x"), F.col("y"))).collect()] == [True, True, False, True]
    assert fi.under_enabled(df, "y", ["/a/"]).count() == 3 and fi.under_enabled(df, "y", []).count() == 0


def test_only_changed_files_are_read_again(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime long")
    assert {r.path for r in fi.changed(now, spark.createDataFrame([("a", 1), ("b", 9)], "path string, mtime long"), "path").collect()} == {"b", "c"}


def test_catalogue(spark, tmp_path):
    entry = lambda i, f: f'<entry><id>urn:uuid:{i}</id><title>T{i}</title><flavour>{f}</flavour><link rel="self" href="x"/><link rel="http://opds-spec.org/acquisition/open-access" href="http://h/{i}.zim.meta4"/></entry>'
    (tmp_path / "c.xml").write_text(f"<feed>{entry(1, 'nopic')}{entry(2, 'maxi')}</feed>")
    assert [tuple(r) for r in fi.catalogue(spark, str(tmp_path / "c.xml")).collect()] == [("1", "T1", "http://h/1.zim")]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, "chat", None), (2, "x,y", 'q"')], "id long, action string, detail string")
    fi.write_csv(log, str(tmp_path / "csv"))
    fi.write_json(log, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert {r["id"] for p in (tmp_path / "json").glob("*.json") for r in map(json.loads, p.read_text().splitlines())} == {1, 2}
    notes = spark.createDataFrame([(1, "T", "body", 5), (2, "T", None, None)], "note_id long, title string, content string, folder_id long")
    folders = spark.createDataFrame([(5, "F", None)], "id long, name string, parent_id long")
    paths = notes.select("note_id", "content").join(export_paths(notes, folders), "note_id")
    assert fi.write_tree(paths, f"file://{tmp_path}/tree") == 2
    assert (tmp_path / "tree/F/T.md").read_text() == "body" and (tmp_path / "tree/T.md").read_text() == ""


def test_ingestion_resumes_and_repeats_safely(spark, tmp_path):
    schema = "note_id long, title string, content string, updated_at long"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    table = st.KeyedTable(spark, str(tmp_path / "out"), ["note_id"])
    source, check = str(tmp_path / "in/*"), str(tmp_path / "check")
    put("one", [(1, "a", "x\ny", 1), (2, "b", "z", 1)])
    st.ingest_notes(spark, source, schema, table, check).awaitTermination()
    assert table.read().count() == 3
    time.sleep(1.1)
    put("two", [(1, "a", "only", 2), (1, "a", "stale", 1)])
    st.ingest_notes(spark, source, schema, table, check).awaitTermination()
    assert {(r.note_id, r.content) for r in table.read().collect()} == {(1, "only"), (2, "z")}
    time.sleep(1.1)
    put("three", [(2, "b", " \n ", 3), (3, "c", "new", 3)])
    st.ingest_notes(spark, source, schema, table, check).awaitTermination()
    assert {(r.note_id, r.content) for r in table.read().collect()} == {(1, "only"), (3, "new")}
    # a new checkpoint reads all files again, from number 0 on
    st.ingest_notes(spark, source, schema, table, str(tmp_path / "other")).awaitTermination()
    assert {r.note_id for r in table.read().collect()} == {1, 3}
    assert len(table.state().done) == 2


def test_audit_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "chat"), ("2024-01-01 11:00:00", "chat"), ("2024-01-03 00:00:00", "x")], "t string, action string").selectExpr("CAST(t AS TIMESTAMP) AS ts", "action").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, action string").parquet(str(tmp_path / "in"))
    run = st.audit_counts(stream).writeStream.format("memory").queryName("audit_counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(str(r.start)[:10], r.action, r.n) for r in spark.sql("SELECT * FROM audit_counts").collect()} == {("2024-01-01", "chat", 2), ("2024-01-03", "x", 1)}
    known, other = st.known_actions(spark.createDataFrame([("llm_chat",), ("search_wikipedia",), (None,)], "action string"))
    assert known.count() == 1 and other.count() == 2


def test_files_are_dealt_to_as_many_tasks_as_there_is_work_for():
    assert fi.tasks_for(0, 0, 12) == 1 and fi.tasks_for(50, 0, 12, 1) == 48 and fi.tasks_for(65, 0, 12) == 2
    # small files in any number have no more tasks; large ones have more
    assert fi.tasks_for(1_000_000, 1 << 30, 12) == 48 and fi.tasks_for(10_000, 1 << 40, 12) == 157


def test_sentences_of_a_text_are_cut_once_and_not_for_each_chunk(spark):
    # a long text takes time in proportion: it was cut for each of its chunks before
    rows = spark.range(1, numPartitions=1).select(F.repeat(F.lit("Some words of a line that is not long.\n"), 20_000).alias("text"))
    began = time.monotonic()
    assert rows.select(F.size(tx.chunks(tx.sentences(F.col("text")))).alias("n")).first().n == 20_000
    assert time.monotonic() - began < 30


def test_batches_of_long_values_are_worked_on_in_pieces(spark):
    def sizes(batches):
        for texts in batches:
            yield pd.Series([[float(len(texts))]] * len(texts))

    rows = spark.range(2_000, numPartitions=1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("a the "), "id")).alias("text"))
    got = ing.embedded(rows, "text", sizes).select("id", F.col("vector")[0].alias("n")).collect()
    # an embedder got the whole batch before
    assert [r.id for r in got] == list(range(2_000)) and max(r.n for r in got) <= ing.PIECE < 2_000
    linked = rows.select("id", UDFS["link_first_mention"](F.col("text"), F.lit("the")).alias("c")).collect()
    assert [r.c for r in linked] == [f"a [[the]] {i}" if i % 3 else None for i in range(2_000)]
    assert documents.PIECE < 2_000
