import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from marginalia.operators import storage as so
from marginalia.operators.storage import Conflict, KeyedTable


@pytest.fixture
def rows(spark):
    return lambda some: spark.createDataFrame(some, "k long, v string")


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_random_batches_agree_with_a_dictionary(spark, rows, tmp_path):
    rng, want, table = random.Random(1), {}, KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.UNIT = 600  # so that segments are of several sizes
    assert table.read() is None and table.lookup(rows([(1, "")])) is None
    for number in range(9):
        some = [(rng.choice([None, *range(30)]), f"{number}-{i}") for i in range(rng.choice([0, 1, 3, 40]))]
        gone = [rng.choice([None, *range(35)]) for _ in range(rng.randrange(4))]
        keys = {k for k, _ in some} | set(gone)
        table.upsert(rows(some), number, rows([(k, "") for k in keys]), "s")
        want = {k: v for k, v in want.items() if k not in keys}
        for k, v in some:
            want.setdefault(k, []).append(v)
        assert content(table) == sorted(((k, v) for k, vs in want.items() for v in vs), key=repr)
        asked = [3, 4, 29, 77]
        assert sorted(map(tuple, table.lookup(rows([(k, "") for k in asked])).collect())) == sorted((k, v) for k in asked for v in want.get(k, []))
    assert len(table.state().segments) < 8


def test_a_batch_writes_as_much_whatever_the_table_holds(spark, tmp_path):
    batch = spark.range(1_000).selectExpr("id * 7 AS k", "cast(rand(3) AS string) AS v")
    wrote = []
    for n in (2_000, 200_000):
        table = KeyedTable(spark, str(tmp_path / f"t{n}"), ["k"])
        table.upsert(spark.range(n).selectExpr("id AS k", "cast(rand(1) AS string) AS v"), 0)
        before = {f for d, _, names in os.walk(tmp_path / f"t{n}" / "segments") for f in names}
        wrote.append(table.upsert(batch, 1))
        after = {f: os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / f"t{n}" / "segments") for f in names if f not in before and f.endswith(".parquet")}
        assert 0 < sum(after.values()) <= wrote[-1]
        assert table.read().count() == max(n, n + sum(k * 7 >= n for k in range(1_000)))
    assert wrote[1] < 1.1 * wrote[0]


def test_repeated_batches_are_skipped_and_streams_have_any_name(spark, rows, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    for stream in ("a/b", "org/model:latest", "~", "", "file:///x/y z", "ü"):
        assert table.done(stream) == -1
        assert table.upsert(rows([(1, stream)]), 0, stream=stream) > 0
        assert table.upsert(rows([(1, "again")]), 0, stream=stream) == 0
        assert table.done(stream) == 0 and content(table) == [(1, stream)]


def test_of_two_writers_one_gets_an_error_and_leaves_nothing(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, two = KeyedTable(spark, path, ["k"]), KeyedTable(spark, path, ["k"])
    one.upsert(rows([(1, "a")]), 0)
    write = KeyedTable._write

    def slow(self, *args):
        if self is one:
            two.upsert(rows([(2, "two")]), 0, stream="two")  # becomes part while the other one writes
        return write(self, *args)

    monkeypatch.setattr(KeyedTable, "_write", slow)
    with pytest.raises(Conflict):
        one.upsert(rows([(3, "one")]), 1)
    monkeypatch.undo()
    assert content(one) == [(1, "a"), (2, "two")]
    one.upsert(rows([(3, "one")]), 1)
    assert content(two) == [(1, "a"), (2, "two"), (3, "one")]


def test_a_name_is_taken_once(spark, tmp_path):
    os.makedirs(tmp_path / "v")
    got = []
    tasks = [threading.Thread(target=lambda i=i: got.append((so.put_new(spark, f"{tmp_path}/v/7", f"text {i}"), i))) for i in range(8)]
    [t.start() for t in tasks]
    [t.join() for t in tasks]
    winner = [i for ok, i in got if ok]
    assert len(winner) == 1 and so.text_of(spark, f"{tmp_path}/v/7") == f"text {winner[0]}"
    assert [n for n in os.listdir(tmp_path / "v") if not n.startswith(".")] == ["7"]


def test_merging_forgets_deleted_keys_and_keeps_late_readers(spark, rows, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.upsert(rows([(k, "a") for k in range(20)]), 0)
    seen = table.read()
    for number in range(1, 3):
        table.upsert(rows([]), number, rows([(number, "")]))
    assert seen.count() == 20 and len(table.state().segments) == 3
    table.upsert(rows([(50, "x")]), 3)
    state = table.state()
    assert len(state.segments) == 1 and not state.segments[0].keys and state.segments[0].rows == 19
    assert table.read(state.version - 1).count() == 19
    for number in range(4, 9):
        table.upsert(rows([(number, "y")]), number)
    held = set(os.listdir(tmp_path / "t/segments"))
    used = {s.name.rpartition("/")[2] for v in table._versions() for s in table.state(v).segments}
    assert held == used and len(table._versions()) == table.VERSIONS


def test_lookups_read_the_range_of_their_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "part"])
    table.upsert(spark.range(1000).selectExpr("id AS k", "explode(array('a', 'b')) AS part", "id * 2 AS v"), 0)
    found = table.lookup(spark.createDataFrame([(7,), (9,)], "k long"))
    assert sorted(map(tuple, found.collect())) == [(k, p, 2 * k) for k in (7, 9) for p in "ab"]
    assert "In(k, [7,9])" in found._jdf.queryExecution().toString()
    many = table.lookup(spark.range(300, 700).withColumnRenamed("id", "k"))
    assert many.count() == 800 and "GreaterThanOrEqual(k,300)" in many._jdf.queryExecution().toString()
    assert table.lookup(spark.createDataFrame([(7, "b")], "k long, part string")).count() == 1
    assert table.lookup(spark.createDataFrame([], "k long")).count() == 0


def test_batches_take_the_types_of_the_table(spark, rows, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    table.upsert(rows([(1, "a")]), 0)
    table.upsert(spark.createDataFrame([("b", 2)], "v string, k int"), 1)
    assert content(table) == [(1, "a"), (2, "b")] and table.read().where(F.col("k") == 2).count() == 1
