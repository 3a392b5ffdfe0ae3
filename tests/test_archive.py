import random
import struct

import pytest

from marginalia.sources import archive as zim

SCHEMA = "path string, title string, mime string, content binary, redirect string"


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(f"p{i:04d}é", rng.choice([f"Title {i}", f"p{i:04d}é"]), rng.choice(["text/html", "text/html; charset=utf-8", "image/png"]), rng.randbytes(rng.randrange(3)) * 5 + f"<p>{i} ü</p>".encode() * rng.randrange(40), None) for i in range(n)]
    return rows


@pytest.mark.parametrize("kind", [zim.PLAIN, zim.XZ, zim.ZSTD])
def test_archives_come_back(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(zim, "WINDOW", 7)
    rows = rows_of(60, kind) + [("r1", "R", "", None, "r2"), ("r2", "R", "", None, "r3"), ("r3", "R", "", None, "p0003é"), ("loop", "", "", None, "pool"), ("pool", "", "", None, "loop"), ("self", "", "", None, "self"), ("x" * 6000, "long", "text/html", b"", None)]
    assert zim.written(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/z", kind, 8) == len(rows)
    found = zim.entries(spark, f"file://{tmp_path}/z")
    got = zim.contents(found).collect()
    assert {r.path: (r.title, r.mime, bytes(r.content)) for r in got if r.redirect is None} == {p: (t, m, c) for p, t, m, c, to in rows if to is None}
    assert [r.path for r in sorted(got, key=lambda r: r.entry)] == sorted((r[0] for r in rows), key=str.encode)
    names = {r.entry: r.path for r in got}
    ends = {r.path: names[r.target] for r in zim.resolved(found).collect() if r.redirect is not None}
    assert ends == {k: "p0003é" for k in ("r1", "r2", "r3")}
    wanted = spark.createDataFrame([("r1",), ("p0003é",), ("loop",), ("none",)], "wanted string")
    answers = {r.wanted: (r.path, bytes(r.content)) for r in zim.read_paths(spark, f"file://{tmp_path}/z", wanted).collect()}
    assert answers == {w: ("p0003é", rows[3][3]) for w in ("r1", "p0003é")}


def test_windows_and_several_archives(spark, tmp_path):
    for seed in (1, 2):
        zim.written(spark.createDataFrame(rows_of(30, seed), SCHEMA).coalesce(1), f"file://{tmp_path}/z")
    (tmp_path / "z/readme.txt").write_text("no archive")
    whole = {(r.archive, r.page_id): (r.url, r.html) for r in zim.pages(spark, f"file://{tmp_path}/z").collect()}
    some = {(r.archive, r.page_id): (r.url, r.html) for r in zim.pages(spark, f"file://{tmp_path}/z", 10, 12).collect()}
    assert some == {k: v for k, v in whole.items() if 10 <= k[1] < 22} and len({a for a, _ in whole}) == 2
    one = next(iter(whole))[0]
    assert zim.entries(spark, one).count() == 30 and zim.entries(spark, one, 100, 5).count() == 0
    (tmp_path / "e").mkdir()
    assert zim.entries(spark, f"file://{tmp_path}/e").count() == 0


def test_what_is_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.zim").write_bytes(b"text" * 40)
    with pytest.raises(Exception, match="not a ZIM archive"):
        zim.entries(spark, f"file://{tmp_path}/a.zim").count()


def test_extended_and_unknown_clusters():
    parts = [b"one", b"", b"three"]
    at = [32, 35, 35, 40]
    assert zim.blobs_of(bytes([zim.PLAIN | zim.EXTENDED]) + struct.pack("<4Q", *at) + b"".join(parts)) == parts
    with pytest.raises(ValueError, match="unknown kind"):
        zim.blobs_of(bytes([3]) + b"xx")
