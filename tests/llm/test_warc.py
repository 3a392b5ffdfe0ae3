import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from marginalia.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def brute(rows, least=0):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(p, best.get(h or "", p))
    out = set()
    for p, _, h in rows:
        raw = (h or "").encode()
        twin = best[h or ""] if len(raw) >= least else p
        out.add((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if twin == p else "revisit", None if twin == p else twin))
    return out


ROWS = [(i, f"http://x/{i % 7}\r\nq", f"<p>é{i % 5}\r\n\r\n</p>" * (i % 5 * 40 + 1)) for i in range(60)] + [(70, None, None), (71, "u", ""), (72, "http://y", "x" * 3_000_000), (-1, "z", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip_matches_brute_force(spark, least):
    got = [tuple(r) for r in warc.round_trip(pages_of(spark, ROWS), least).collect()]
    assert set(got) == brute(ROWS, least) and len(got) == len(ROWS)


def test_archives_are_plain_warc_files(spark, tmp_path):
    index = warc.write(pages_of(spark, ROWS), f"file://{tmp_path}/w").collect()
    for f in (tmp_path / "w").glob("*.warc.gz"):
        text = gzip.open(io.BytesIO(f.read_bytes())).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith(b"\r\n\r\n")
    for r in index:
        fields, _ = warc.parse((tmp_path / "w" / r.archive).read_bytes()[r.offset : r.offset + r.length])
        assert fields["x-page-id"] == str(r.page_id) and fields["warc-payload-digest"] == f"sha1:{r.digest}"
    assert not list((tmp_path / "w").glob(".part*"))


def test_a_selection_is_read_with_its_payload(spark, tmp_path):
    index = warc.write(pages_of(spark, ROWS), f"file://{tmp_path}/w")
    got = warc.read(index.where("page_id IN (59, 72, 71, 3)"), f"file://{tmp_path}/w", with_payload=True).collect()
    want = {p: (h or "").encode() for p, _, h in ROWS}
    assert {r.page_id: r.payload and bytes(r.payload) for r in got} == {59: want[59], 72: want[72], 71: b"", 3: None}


def test_damage_is_noticed():
    member = warc.record("1", "u", b"payload", None, "2024-01-01T00:00:00Z")
    fields, payload = warc.parse(member)
    assert payload == b"payload" and fields["x-payload-length"] == "7"
    for broken in (member[:-9], b"junk", gzip.compress(gzip.decompress(member).replace(b"payload\r", b"pAyload\r"))):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)


def test_near_records_are_read_at_once():
    assert list(warc._runs([(0, 10), (10, 5), (20 + warc.GAP, 5), (30 + warc.GAP, 1)])) == [[(0, 10), (10, 5)], [(20 + warc.GAP, 5), (30 + warc.GAP, 1)]]


def test_defined_on_odd_tables(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0
    odd = pages_of(spark, [(None, "a", "same"), (None, "a", "same"), (4, "a", "same"), (4, "a", "same"), (4, "b", "other"), (None, "n", "lone"), (None, "m", "lone")]).withColumn("sha1", F.lit(1)).withColumn("best", F.lit("x"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect()), key=str)
    assert got == sorted([(4, 4, "response", None), (4, 4, "revisit", 4), (4, 5, "response", None), (None, 4, "revisit", 4), (None, 4, "revisit", 4), (None, 4, "response", None), (None, 4, "response", None)], key=str)
