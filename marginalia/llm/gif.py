"""GIF as a column: LZW code streams, palettes, disposal and transparency rules, timed frames, colour histograms.

Between two clear codes the n-th code's width depends on n alone, so all codes of a run are cut out of
the bits at once; only the growing of the string table is a loop, one step for each code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the format.
_TRAILER, _IMAGE, _EXTENSION, _CONTROL, _TABLE = 0x3B, 0x2C, 0x21, 0xF9, 4096
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
#: Frames of stored bytes: 96 wide, up to 96 tall, in steps of 6 rows (576 samples).
WIDTH, UNIT, ROWS = 96, 576, 96
#: Hundredths of a second that each frame of stored bytes is shown, and the disposals that they have in turn.
DELAY, DISPOSALS = 4, (1, 3, 2)
#: Pixels that a run equal to what is on the canvas has at least, to be left out as transparent.
_RUN = 8
#: Most pixels of a canvas or an image that are decoded, and bytes of canvases that are held at once.
MOST_PIXELS, _HELD = 1 << 24, 1 << 25


class GifError(ValueError):
    """The bytes are no GIF that can be decoded."""


@dataclass
class Frame:
    """One composed frame: the whole canvas as RGBA, the rectangle that it drew, and its time."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_cs: int


@lru_cache(maxsize=16)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a minimum code size: width, first bit and mask of the n-th code after a clear code, up to a full table and beyond."""
    n = np.arange(2 * _TABLE)
    following = (1 << size) + 2 + np.maximum(n - 1, 0)
    width = np.minimum(12, np.maximum(size + 1, np.frexp(np.minimum(following, _TABLE - 1))[1])).astype(np.int64)
    return width, np.concatenate([[0], np.cumsum(width)]), (1 << width) - 1


def lzw_codes(data: bytes, size: int) -> Iterator[list[int]]:
    """Runs of codes between clear codes, up to the end code or the end of the data."""
    width, first, mask = _layout(size)
    clear, end, bits = 1 << size, (1 << size) + 1, len(data) * 8
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    at, carried = 0, []
    while at + width[0] <= bits:
        here = int(np.searchsorted(first, bits - at, "right")) - 1
        here = min(here, len(width))
        places = first[:here] + at
        low = places >> 3
        codes = (padded[low] | padded[low + 1] << 8 | padded[low + 2] << 16) >> (places & 7) & mask[:here]
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else here
        run = carried + codes[:stop].tolist()
        if not len(stops) and here == len(width):
            # a full table that is never cleared: 12 bits from here on
            rest = data[(at + int(first[here])) // 8 :]
            run += _flat(rest, (at + int(first[here])) % 8, clear, end)
            yield run
            return
        if run:
            yield run
        carried = []
        if not len(stops) or codes[stop] == end:
            return
        at += int(first[stop + 1])


def _flat(data: bytes, skip: int, clear: int, end: int) -> list[int]:
    """12-bit codes up to the end code; a clear code after so many codes is an error here."""
    value, out = int.from_bytes(data, "little") >> skip, []
    for k in range((len(data) * 8 - skip) // 12):
        code = value >> 12 * k & 4095
        if code == end:
            break
        if code == clear:
            raise GifError("clear code long after the table was full")
        out.append(code)
    return out


def lzw_decode(data: bytes, size: int) -> bytes:
    """Colour indices of an image's code stream."""
    out: list[bytes] = []
    start = [bytes([i]) for i in range(1 << size)] + [b"", b""]
    for run in lzw_codes(data, size):
        table = start.copy()
        grow, put = table.append, out.append
        if run[0] >= 1 << size:
            raise GifError("a run starts with a code that stands for nothing")
        last = table[run[0]]
        put(last)
        room = _TABLE - len(table)
        for code in run[1 : room + 1]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise GifError("code beyond the table") from None
                entry = last + last[:1]
            grow(last + entry[:1])
            put(entry)
            last = entry
        out += [table[code] for code in run[room + 1 :]]
    return b"".join(out)


def lzw_encode(pixels: bytes, size: int = 8) -> bytes:
    """Code stream of colour indices; the table is cleared when it is full."""
    clear = 1 << size
    runs: list[list[int]] = []
    codes, table, following = [], {}, clear + 2
    get, put = table.get, codes.append
    prefix = pixels[0]
    for pixel in pixels[1:]:
        key = prefix << 8 | pixel
        found = get(key)
        if found is None:
            put(prefix)
            if following == _TABLE:
                runs.append(codes)
                codes, table, following = [], {}, clear + 2
                get, put = table.get, codes.append
            else:
                table[key] = following
                following += 1
            prefix = pixel
        else:
            prefix = found
    put(prefix)
    runs.append(codes)
    # a run ends with the next clear code, or the end code
    every = [clear]
    place = [0]
    for k, run in enumerate(runs):
        every += run
        every.append(clear if k + 1 < len(runs) else clear + 1)
        place += range(len(run) + 1)
    width = _layout(size)[0][place]
    first = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(int(first[-1]) + 12, np.uint8)
    value = np.array(every)
    for k in range(12):
        inside = width > k
        bits[first[:-1][inside] + k] = value[inside] >> k & 1
    return np.packbits(bits[: int(first[-1])], bitorder="little").tobytes()


def _unused_index(part: np.ndarray) -> int | None:
    """The largest sample that a frame does not have; None if it has all."""
    free = np.flatnonzero(np.bincount(part, minlength=256) == 0)
    return int(free[-1]) if len(free) else None


def encode(payload: bytes, delay_cs: int = DELAY) -> bytes:
    """A lossless animation of 8-bit samples: grey palette, frames of whole rows of 96, in order.

    The payload's length is a positive multiple of 576. Each frame shows its own samples in its rectangle: runs that
    are on the canvas already are left out as transparent, where a sample is free to stand for that. When its time
    is over a frame stays, gives back what was there before, or is cleared, in turn.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {UNIT}")
    step = WIDTH * ROWS
    tall = min(len(payload), step) // WIDTH
    grey = bytes(x for i in range(256) for x in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, tall, 0xF7, 0, 0), grey, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    canvas = np.full(tall * WIDTH, -1, np.int16)
    for number, at in enumerate(range(0, len(payload), step)):
        part = np.frombuffer(payload, np.uint8, min(step, len(payload) - at), at)
        disposal, free, pixels = DISPOSALS[number % len(DISPOSALS)], None, part
        if number:
            same = canvas[: len(part)] == part
            # where runs of equal pixels begin and end
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            runs = edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= _RUN]
            free = _unused_index(part) if len(runs) else None
            if free is not None:
                pixels = part.copy()
                for first, end in runs:
                    pixels[first:end] = free
        out.append(struct.pack("<BBBBHBB", _EXTENSION, _CONTROL, 4, disposal << 2 | (free is not None), delay_cs, free or 0, 0))
        out.append(struct.pack("<BHHHHBB", _IMAGE, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        codes = lzw_encode(pixels.tobytes())
        out += [bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)]
        out.append(b"\0")
        if disposal != 3:
            canvas[: len(part)] = part if disposal == 1 else -1
    out.append(bytes([_TRAILER]))
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("data ends within a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("data ends within a palette")
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return colours, at + 3 * n


def frames(data: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF, one at a time; canvases and images of over ``MOST_PIXELS`` are an error.

    Local palettes go before the global one; indices of the transparent colour leave what is there.
    When a frame's time is over, disposal 2 clears its rectangle and 3 puts back what was there before.
    """
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    wide, tall, flags = struct.unpack_from("<HHB", data, 6)
    if wide * tall > MOST_PIXELS:
        raise GifError(f"canvas of {wide} x {tall}")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((tall, wide, 4), np.uint8)
    disposal, delay, clear = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == _TRAILER:
            return
        if kind == _EXTENSION:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == _CONTROL and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None
            continue
        if kind != _IMAGE:
            raise GifError(f"unknown block {kind}")
        left, top, width, height, own = struct.unpack_from("<HHHHB", data, at + 1)
        if width * height > MOST_PIXELS:
            raise GifError(f"image of {width} x {height}")
        at += 10
        colours = shared
        if own & 0x80:
            colours, at = _palette(data, at, own)
        if colours is None:
            raise GifError("no palette")
        size = data[at]
        if not 1 <= size <= 11:
            raise GifError(f"code size {size}")
        codes, at = _blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(codes, size)[: width * height].ljust(width * height, b"\0" if clear is None else bytes([clear])), np.uint8).reshape(height, width)
        if own & 0x40:
            order = [y for first, step in _PASSES for y in range(first, height, step)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        shown = indices[: max(0, tall - top), : max(0, wide - left)]
        place = canvas[top : top + height, left : left + width]
        drawn = np.dstack([colours[shown], np.full(shown.shape, 255, np.uint8)])
        if clear is None:
            place[:] = drawn
        else:
            place[shown != clear] = drawn[shown != clear]
        yield Frame(canvas.copy(), left, top, shown.shape[1], shown.shape[0], delay)
        if disposal == 2:
            place[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None


def histogram(frame: Frame, bits: int = 2, drawn: bool = False) -> np.ndarray:
    """Pixels of what the frame shows, or of the rectangle it drew, by the upper ``bits`` of red, green and blue; transparent ones are left out."""
    shown = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width] if drawn else frame.canvas
    rgb = (shown[..., :3] >> (8 - bits)).astype(np.int64)
    cell = (rgb[..., 0] << 2 * bits) | (rgb[..., 1] << bits) | rgb[..., 2]
    return np.bincount(cell[shown[..., 3] > 0], minlength=1 << 3 * bits)


def timed(data: bytes) -> Iterator[tuple[int, int, Frame]]:
    """Number, start in hundredths of a second, and frame."""
    start = 0
    for number, frame in enumerate(frames(data)):
        yield number, start, frame
        start += frame.delay_cs


def samples(frame: Frame) -> bytes:
    """The stored bytes of one of :func:`encode`'s frames."""
    return frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width, 0].tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with bytes 255 up to a positive multiple of 576, and its length without them."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def frame_table(media: DataFrame, id_col: str = "media_id", data_col: str = "gif") -> DataFrame:
    """One row per frame of the GIFs in ``media``: id, frame number, start and delay in hundredths of a
    second, the drawn rectangle, the canvas (RGBA bytes, row by row) and its 64-colour histogram.

    Null media have no rows. Broken media, and such with a canvas of over ``MOST_PIXELS``, have the frames before
    the fault and then a row with ``error``.
    """
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, frame int, start_cs long, delay_cs int, left int, top int, width int, height int, canvas binary, histogram array<long>, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch[id_col], batch[data_col], strict=True):
                if data is None:
                    continue
                rows, end, held, error = [], 0, 0, None
                try:
                    for k, start, f in timed(bytes(data)):
                        rows.append((key, k, start, f.delay_cs, f.left, f.top, f.width, f.height, f.canvas.tobytes(), histogram(f).tolist(), None))
                        end, held = start + f.delay_cs, held + f.canvas.nbytes
                        if held >= _HELD:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                except (GifError, struct.error, IndexError) as fault:
                    error = str(fault) or "data ends too early"
                if error:
                    rows.append((key, None, end, *[None] * 7, error))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:8]})

    names = [id_col, "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "canvas", "histogram", "error"]
    return media.select(id_col, data_col).mapInPandas(read, schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, gif``: each text's bytes as a GIF animation (null text: empty, one frame of padding)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch[at : at + 200]
                made = [padded(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [n for _, n in made], "gif": [encode(p) for p, _ in made]})

    return docs.select("doc_id", "text").mapInPandas(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, gif binary")


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF and read back: digests of payload and media, a feature, and the timed frames.

    Columns: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    frames``. All but ``n_bytes`` come from the stored form: the payload is what its composed frames show in their
    rectangles. ``feature`` has the number of frames, the time and the payload's histogram of grey (four cells);
    ``frames`` has start and delay in hundredths of a second and the 64-colour histogram of all that each frame
    shows, as :func:`frame_table` has. Null texts are stored as empty; ids that are null or repeat stay rows of
    their own; other columns are ignored; an empty table gives no rows.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, sizes, starts, delays, cells = [], [0], [], [], []
            for text in batch.column(1):
                *one, shown = _described(text.as_py())
                told.append(one)
                sizes.append(sizes[-1] + len(shown))
                for start, delay, counts in shown:
                    starts.append(start)
                    delays.append(delay)
                    cells.append(counts)
            ends = pa.array(range(0, 64 * len(cells) + 1, 64), pa.int32())
            histograms = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cells) if cells else [], pa.int64()))
            every = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(delays, pa.int32()), histograms], ["start_cs", "delay_cs", "histogram"])
            columns = [pa.array(values, pa.string() if isinstance(values[0], str) else pa.int64()) for values in zip(*told, strict=True)] if told else []
            if told:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), every)], ["doc_id", *names, "frames"])

    kinds = ["long", "long", "string", "long", "long", "string", "string"]
    frame = T.StructType([T.StructField("start_cs", T.LongType()), T.StructField("delay_cs", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
    columns = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.StringType() if k == "string" else T.LongType()) for n, k in zip(names, kinds, strict=True)], T.StructField("frames", T.ArrayType(frame))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(columns))


def _described(text: str | None) -> tuple:
    payload, n = padded(text)
    media = encode(payload)
    digest, total, tail, end, colours, shown = hashlib.sha256(), 0, b"", 0, np.zeros(64, np.int64), []
    for _, start, frame in timed(media):
        got = samples(frame)
        digest.update(got)
        total, tail, end = total + len(got), (tail + got[-32:])[-32:], start + frame.delay_cs
        drawn = histogram(frame, drawn=True)
        colours += drawn
        # the first frame draws the whole canvas
        shown.append((start, frame.delay_cs, histogram(frame) if shown else drawn))
    grey = ",".join(map(str, colours[[0, 21, 42, 63]].tolist()))
    return n, total, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(shown)};cs={end};grey={grey}", shown
