import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import gif


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))


def slow_decode(data, size):
    """Textbook decoder, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, table, width, at, out, last = 1 << size, None, size + 1, 0, b"", None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out += entry
        last = entry


@pytest.mark.parametrize("n", [1, 2, 9, 576, 5000, 60_000])
@pytest.mark.parametrize("kind", ["same", "random", "text"])
def test_codes_agree_with_a_textbook_decoder(n, kind):
    rng = random.Random(n)
    data = {"same": b"a" * n, "random": rng.randbytes(n), "text": b" ".join(rng.choice([b"the", b"of", b"and", b"house"]) for _ in range(n))[:n]}[kind]
    codes = gif.lzw_encode(data)
    assert gif.lzw_decode(codes, 8) == data
    assert slow_decode(codes, 8) == data
    assert kind != "text" or n < 5000 or len(codes) < n / 2


def picture(blocks, wide=4, tall=4, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    head = b"GIF89a" + struct.pack("<HHBBB", wide, tall, 0x81 if palette else 1, 0, 0) + b"".join(bytes(c) for c in palette)
    return head + b"".join(blocks) + b";"


def image(pixels, box=(0, 0, 4, 4), flags=0, local=()):
    codes = gif.lzw_encode(bytes(pixels), 2)
    return struct.pack("<BHHHHB", 0x2C, *box, flags | (0x81 if local else 0)) + b"".join(bytes(c) for c in local) + b"\x02" + bytes([len(codes)]) + codes + b"\0"


def control(disposal=0, delay=0, clear=None):
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)


def test_disposal_transparency_and_times():
    data = picture([control(1, 5), image([1] * 16), control(2, 7), image([2] * 4, (0, 0, 2, 2)), control(3, 9, clear=0), image([3, 0, 0, 3], (2, 2, 2, 2)), control(0, 1), image([2], (3, 0, 1, 1))])
    got = list(gif.frames(data))
    assert [f.delay_cs for f in got] == [5, 7, 9, 1]
    show = [["".join("_" if p[3] == 0 else "krgb"[[(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)].index(tuple(int(x) for x in p[:3]))] for p in row) for row in f.canvas] for f in got]
    assert show[0] == ["rrrr"] * 4
    assert show[1] == ["ggrr", "ggrr", "rrrr", "rrrr"]
    assert show[2] == ["__rr", "__rr", "rrbr", "rrrb"]
    assert show[3] == ["__rg", "__rr", "rrrr", "rrrr"]
    assert gif.histogram(got[1])[0b110000] == 12 and gif.histogram(got[2]).sum() == 12


def test_local_palette_interlace_and_edges():
    rows = [0, 1, 2, 3, 0, 1, 2, 3]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    woven = image([rows[y] for y in order for _ in range(2)], (3, 0, 2, 8), 0x40, local=((9, 9, 9), (8, 8, 8), (7, 7, 7), (6, 6, 6)))
    (f,) = gif.frames(picture([woven], wide=4, tall=8))
    assert f.canvas[:, 3, 0].tolist() == [9, 8, 7, 6, 9, 8, 7, 6] and f.width == 1
    for broken in (b"", b"GIF89a", picture([])[:-1] + b"\x99", picture([image([1] * 16)], palette=())):
        with pytest.raises(gif.GifError):
            list(gif.frames(broken))


def test_texts_come_back(docs_of):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab é\n漢") for _ in range(n))) for i, n in enumerate([0, 1, 575, 576, 577, 9216, 9217, 30_000])] + [(50, None), (51, ""), (52, "x" * 400_000)]
    got = {r.doc_id: r for r in gif.text_media(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        p, r = payload_of(t), got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        media = gif.encode(p)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"frames={-(-len(p) // 9216)};") and sum(map(int, r.feature.split("grey=")[1].split(","))) == len(p)
    assert got[50].feature == got[51].feature
    # the timed frames of the query are those of the frame table
    table = defaultdict(list)
    for r in gif.frame_table(gif.stored_texts(docs_of(rows)), "doc_id", "gif").orderBy("doc_id", "frame").collect():
        table[r.doc_id].append((r.start_cs, r.delay_cs, r.histogram))
    assert {d: [tuple(f) for f in r.frames] for d, r in got.items()} == dict(table)


@pytest.mark.parametrize("kind", ["text", "lines", "bytes"])
def test_frames_with_transparent_runs_and_all_disposals_come_back(kind):
    """Against a plain simulation of what a viewer shows."""
    rng = random.Random(7)
    line = "the same line again and again!!\n"
    raw = {"text": " ".join(rng.choice("abc") * 60 for _ in range(1500)), "lines": line * 4000, "bytes": None}[kind]
    payload = payload_of(raw) if raw else rng.randbytes(576 * 120)
    media = gif.encode(payload)
    shown = list(gif.frames(media))
    assert b"".join(gif.samples(f) for f in shown) == payload
    canvas = np.zeros((96, 96, 4), np.uint8)
    for k, f in enumerate(shown):
        part = np.frombuffer(payload[k * 9216 : (k + 1) * 9216], np.uint8).reshape(-1, 96)
        before = canvas.copy()
        canvas[: len(part)] = np.dstack([part, part, part, np.full_like(part, 255)])
        assert np.array_equal(f.canvas, canvas)
        canvas = {1: canvas, 3: before}.get((1, 3, 2)[k % 3], canvas)
        if (1, 3, 2)[k % 3] == 2:
            canvas[: len(part)] = 0
    controls = [media[m.start() + 3] for m in re.finditer(rb"\x21\xf9\x04.\x04\x00.\x00\x2c", media, re.S)]
    assert {c >> 2 & 7 for c in controls} == {1, 2, 3} and any(c & 1 for c in controls) == (kind != "bytes")


def test_hostile_sizes_are_errors(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6) + b";"
    wide = picture([image([1] * 16, (0, 0, 65535, 65535))])
    rows = gif.frame_table(spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(wide))], "media_id int, gif binary")).collect()
    assert all("65535 x 65535" in r.error for r in rows) and len(rows) == 2


def test_frame_table(docs_of, spark):
    stored = gif.stored_texts(docs_of([(1, "q" * 10_000), (2, None)]))
    extra = spark.createDataFrame([(3, None, 0), (4, bytearray(b"GIF89a bad"), 0)], "doc_id long, gif binary, n_bytes long").select("doc_id", "n_bytes", "gif")
    got = gif.frame_table(stored.unionByName(extra), "doc_id", "gif").orderBy("doc_id", "frame").collect()
    assert [(r.doc_id, r.frame, r.start_cs, r.height, r.error is None) for r in got] == [(1, 0, 0, 96, True), (1, 1, 4, 12, True), (2, 0, 0, 6, True), (4, None, 0, None, False)]
    assert np.frombuffer(got[0].canvas, np.uint8).reshape(96, 96, 4)[0, 0].tolist() == [113, 113, 113, 255]


def test_defined_on_odd_tables(docs_of):
    assert gif.text_media(docs_of([])).count() == 0
    odd = docs_of([(None, "a"), (7, "a"), (7, "a")]).withColumn("gif", F.lit(1)).withColumn("feature", F.lit("x"))
    assert len({r.media_sha256 for r in gif.text_media(odd).collect()}) == 1
