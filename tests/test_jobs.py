import random
import threading
import time

import pytest

from marginalia.operators import ingest as ing
from marginalia.operators.dictionary import TitleDictionary, after_prefix
from marginalia.operators.jobs import Busy, Cancelled, Job
from marginalia.operators.storage import KeyedTable


def test_a_second_run_is_refused_and_a_cancelled_one_goes_on(spark, tmp_path):
    table, folder = KeyedTable(spark, str(tmp_path / "v"), ["note_id"]), str(tmp_path)
    notes = spark.range(40).selectExpr("id AS note_id", "'t' AS title", "'text ' || id AS content")
    seen = []

    def listener(progress):
        seen.append((progress.done, progress.of))
        if len(seen) == 3:
            assert Job(spark, folder, "re/index").running() == 0 and Job(spark, folder, "re/index").progress().done == 2
            with pytest.raises(Busy), Job(spark, folder, "re/index"):
                pass
            assert Job(spark, folder, "re/index").cancel()

    run = lambda job: ing.reindex_all(table, notes, "org/m:1", ing.hashing_embedder(4), 4, batches=4, job=job)
    with pytest.raises(Cancelled), Job(spark, folder, "re/index", listener=listener) as job:
        run(job)
    assert seen == [(0, 4), (1, 4), (2, 4)] and not Job(spark, folder, "re/index").cancel()
    with Job(spark, folder, "other"), Job(spark, folder, "re/index", listener=listener) as job:
        assert run(job) == 2
    assert seen[3:] == [(2, 4), (3, 4)] and table.read().count() == 40


def test_a_cancel_ends_the_jobs_at_work(spark, tmp_path):
    threading.Timer(4, lambda: Job(spark, str(tmp_path), "long").cancel()).start()
    began = time.time()
    with pytest.raises(Cancelled), Job(spark, str(tmp_path), "long"):
        spark.range(0, 4, 1, 4).where("java_method('java.lang.Thread', 'sleep', 60000L * id) IS NULL").count()
        raise AssertionError("not cancelled")
    assert time.time() - began < 45


def test_leases_of_the_dead_run_out(spark, tmp_path):
    first = Job(spark, str(tmp_path), "x", seconds=1).__enter__()
    time.sleep(1.1)
    with Job(spark, str(tmp_path), "x") as second:
        assert second.number == 1
        with pytest.raises(Busy):
            first.report(1, 2)
        second.report(1, 2)
    spark.sparkContext.removeJobTag(first.tag)


def test_prefixes(spark, tmp_path):
    assert [after_prefix(p) for p in ("a", "az", "퟿", "a\U0010ffff", "\U0010ffff", "")] == ["b", "a{", "", "b", None, None]
    rng, titles, now = random.Random(5), TitleDictionary(spark, str(tmp_path)), {}
    with pytest.raises(LookupError):
        titles.starting("a")
    for number in range(3):
        changed = {rng.randrange(60): rng.choice([None, *["".join(rng.choices("aAbé퟿￿😀", k=rng.randrange(1, 5))) for _ in range(3)]]) for _ in range(30)}
        gone = rng.sample(range(60), 6)
        titles.apply(spark.createDataFrame(list(changed.items()), "note_id long, title string"), number, spark.createDataFrame([(k,) for k in gone], "note_id long"))
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        for typed in ("a", " AB ", "é", "퟿", "😀", "zz", ""):
            want = sorted((t, k) for k, t in now.items() if t is not None and t.lower().startswith(typed.strip().lower()))
            assert sorted((r.title, r.note_id) for r in titles.starting(typed).collect()) == want
    plan = titles.starting("ab")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(folded,ab), LessThan(folded,ac)" in plan
    assert [r.title for r in titles.suggestions("", 3).collect()] == sorted((t for t in now.values() if t is not None), key=lambda t: t.encode("utf-8", "surrogatepass"))[:3]
