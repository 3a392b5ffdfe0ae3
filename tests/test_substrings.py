import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import substrings
from marginalia.operators.substrings import SubstringIndex, literal_runs

SCHEMA = "note_id long, title string, content string"


def test_patterns():
    assert literal_runs("%a_bc%%d\\%e\\_") == ["a", "bc", "d%e_"] and literal_runs("%_%") == [] == literal_runs("")


def test_searches_equal_ilike_after_random_changes(spark, tmp_path):
    rng, now, index = random.Random(2), {}, SubstringIndex(spark, str(tmp_path), ("title", "content"))
    word = lambda: "".join(rng.choices("abÉéßİΣσς 日%_x", k=rng.randrange(0, 14)))
    with pytest.raises(LookupError):
        index.search("%abc%")
    for number in range(3):
        changed = {rng.randrange(120): (word(), rng.choice([word(), word() * 3, None])) for _ in range(60)}
        gone = [k for k in rng.sample(range(120), 15) ][:9]
        index.apply(spark.createDataFrame([(k, *v) for k, v in changed.items()], SCHEMA), number, spark.createDataFrame([(k,) for k in gone], "note_id long"))
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        whole = spark.createDataFrame([(k, *v) for k, v in now.items()], SCHEMA).cache()
        some = rng.choice([t for v in now.values() for t in v if t and len(t) > 5])
        for pattern in (f"%{some[1:5].upper()}%", f"{some}", "%a_b%b%", "%ÉÉÉ%", "%\\%\\_%", "%ab%", "%zzz%"):
            want = whole.where(F.col("title").ilike(pattern) | F.col("content").ilike(pattern))
            assert {r.note_id for r in index.search(pattern).collect()} == {r.note_id for r in want.collect()}, pattern
        for needle, exact in ((some[:4], True), (some[:4].upper(), False), ("%", True), ("", True)):
            low = F.lower(F.lit(needle))
            test = (lambda c: F.contains(F.col(c), F.lit(needle))) if exact else (lambda c: F.contains(F.lower(c), low))  # noqa: B023
            assert {r.note_id for r in index.containing(needle, exact).collect()} == {r.note_id for r in whole.where(test("title") | test("content")).collect()}


def test_a_search_reads_its_grams_and_no_text_beyond_the_candidates(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path), ("title",))
    rows = spark.range(3000).selectExpr("id AS note_id", "'title ' || id AS title")
    index.apply(rows, 0)
    found = index.search("%e 123_%")
    plan = found._jdf.queryExecution().toString()
    assert {r.note_id for r in found.collect()} == set(range(1230, 1240)) and "In(note_id, [" in plan
    assert "In(gram, [" in index.candidates(["e 123"])._jdf.queryExecution().toString()
    small = index.apply(spark.createDataFrame([(5, "other")], "note_id long, title string"), 1)
    assert small < 20_000 and index.search("%title 5").count() == 0 and index.containing("OTHER").count() == 1


def test_grams_are_cut_for_many_rows_at_once():
    rng = random.Random(4)
    texts = [["".join(rng.choices("abcÉ日😀 ", k=rng.randrange(0, 40))) for _ in range(700)] for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), *map(pa.array, texts)], ["note_id", "title", "content"])
    pieces = list(substrings.grams_of_batches(iter([batch, batch.slice(0, 0)]), "note_id", ("title", "content")))
    got = [r for p in pieces for r in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)]
    want = {(g, i) for i, row in enumerate(zip(*texts, strict=True)) for t in row for g in substrings.grams_of(t)}
    assert len(pieces) == 1 and len(got) == len(want) and set(got) == want


def test_a_change_does_not_read_the_texts_that_it_replaces(spark, tmp_path, monkeypatch):
    index = SubstringIndex(spark, str(tmp_path), ("title",))
    index.apply(spark.range(50).selectExpr("id AS note_id", "'title ' || id AS title"), 0)
    monkeypatch.setattr(index.texts, "lookup", None)
    index.apply(spark.range(10).selectExpr("id AS note_id", "'other ' || id AS title"), 1, spark.range(5).selectExpr("id AS note_id"))
    monkeypatch.undo()
    assert {r.note_id for r in index.search("%other%").collect()} == set(range(5, 10)) and index.search("%title%").count() == 40
    assert index.candidates(["title"]).count() == 40


def test_merged_grams_are_those_of_the_newest_rows(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path), ("title",))
    for number in range(5):
        index.apply(spark.range(number, 12).selectExpr("id AS note_id", f"'round {number} ' || id AS title"), number)
    assert len(index.grams.state().segments) < 5
    assert {r.note_id for r in index.candidates(["round 4"]).collect()} == set(range(4, 12)) and {r.note_id for r in index.candidates(["d 2 "]).collect()} == {2}
