"""Best-fit packing of token sequences with a bounded number of open bins.

A partition is packed in one pass while it is tokenised, so token ids are never shuffled. Open bins
are kept in a bitset keyed by free space: the lowest set bit at or above a piece's length is the best
fit. When more than ``open_bins`` are open, the fullest closes first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small letters that no normalising changes, and the punctuation after them, which is a unit of its own.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)").fullmatch
#: ASCII punctuation as commas, for a look at what stands beside it; what is left of a text of these bytes is nothing.
_SIGNS = bytes.maketrans(b"!\"#$%&'()*+-./:;<=>?@[\\]^_`{|}~", b"," * 31)
_LATIN = bytes(range(128)) + b"\xc3" + bytes(b for b in range(0x80, 0xC0))
#: Stands between words that are tokenised together; one token.
_MARK = "\x01"
#: Words a worker remembers in each of two generations.
_CACHE = 200_000
#: Bytes of text that are tokenised together.
_LOT = 4 << 20
#: Longer words are forgotten.
_LONG = 64


def _parted(raw: bytes) -> bytes:
    """The text with blanks around full stops and commas, where that parts no run of signs and no other word.

    That is so if all bytes are ASCII or Latin letters and no two signs stand side by side.
    """
    if raw.translate(None, _LATIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw or b",," in raw.translate(_SIGNS):
        return raw
    return raw.replace(b".", b" . ").replace(b",", b" , ")


#: Text that tells whether a tokenizer has the rules that tokenising by words relies on: small letters, blanks, signs, digits, accents, marks.
_PROBE = "The  quick Brown-fox\tjumped, over 12 dogs' 3.5 tails... it's DON'T x!?y éÀß ñandú naïve a\u0301 e\u200bf 漢字かな 🙂 a_b #tag @you (p) [q] 100% <b> z\n\n end."


class BestFit:
    """Bounded-space online best-fit over bins of ``size``."""

    def __init__(self, size: int, open_bins: int = 512) -> None:
        self.size, self.limit = size, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def _put(self, free: int, number: int) -> None:
        if not free:
            return
        if self.open >= self.limit:
            fullest = (self.bits & -self.bits).bit_length() - 1
            if free <= fullest:
                return
            self._take(fullest)
        self.bins.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to ``size`` units."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
        self._put(free - length, number)
        return number, self.size - free


class _Words:
    """Ids of words in two generations: when the young is full it becomes the old, whose words return as they are met."""

    def __init__(self, room: int) -> None:
        self.room, self.young, self.old = room, {}, {}

    def missing(self, words: set[bytes]) -> list[bytes]:
        """Makes room, and takes words of the old generation over; those that neither has are returned."""
        lacking = words.difference(self.young)
        if len(self.young) + len(lacking) > self.room:
            self.old, self.young = self.young, {}
            lacking = words
        old = self.old
        kept = {w: old[w] for w in lacking if w in old}
        self.young.update(kept)
        return [w for w in lacking if w not in kept]


class Encoder:
    """Token ids as little-endian 32-bit bytes, each distinct word tokenised once while a worker remembers it.

    The tokenizer drops white space and parts letters from punctuation, so what stands between blanks is
    tokenised on its own, and so is the punctuation that ends it; Capitals A-Z may be lowered beforehand,
    as the tokenizer lowers them itself. Words of plain small letters are a single unit to it: its merges
    run on them without normalising, and each such word ends at the one token that is marked as a word's end.
    Whether a tokenizer is like that is tried out on a text that has all this; with any other, texts are tokenised whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        for own in (self.tokenizer, self.plain):
            own.model._resize_cache(0)  # distinct words only
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words, self.mark = _Words(_CACHE), self._ids(self.tokenizer, _MARK)[0]
        # another tokenizer may have other rules: then texts go whole
        self.by_word = bool(self.ends.any())
        self.by_word = self.by_word and self.encode([_PROBE]) == [self._ids(self.tokenizer, _PROBE).tobytes()]
        self.words = _Words(_CACHE)

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    @staticmethod
    def _cut(ids: np.ndarray, upto: np.ndarray, skip: int) -> list[bytes]:
        """Bytes of the ids between the places ``upto``, leaving out ``skip`` ids after each."""
        data, places = ids.tobytes(), (upto * 4).tolist()
        return [data[a:b] for a, b in zip([0, *[x + 4 * skip for x in places]], [*places, len(data)], strict=True)]

    def _learn(self, fresh: list[bytes]) -> None:
        known = self.words.young
        cores, other, tailed = [], [], []
        for word in fresh:
            found = _PLAIN(word)
            if not found:
                other.append(word)
            elif found.end(1) == len(word):
                cores.append(word)
            else:
                tailed.append(found)
        # a core that is a word of this lot too is learnt once
        cores += {found[1] for found in tailed}.difference(known).difference(cores)
        for at in range(0, len(cores), 5000):
            part = cores[at : at + 5000]
            ids = self._ids(self.plain, b" ".join(part).decode())
            known.update(zip(part, self._cut(ids, np.flatnonzero(self.ends[ids])[:-1] + 1, 0), strict=True))
        other += {found[2] for found in tailed}.difference(known).difference(other)
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            ids = self._ids(self.tokenizer, f" {_MARK} ".encode().join(part).decode())
            known.update(zip(part, self._cut(ids, np.flatnonzero(ids == self.mark), 1), strict=True))
        for found in tailed:
            known[found[0]] = known[found[1]] + known[found[2]]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            raw = text.encode()
            # special tokens are matched with their capitals and the mark has a use here: those texts go whole
            whole = not self.by_word or b"<|" in raw or _MARK.encode() in raw
            split.append(None if whole else _parted(raw.lower()).split())
        fresh = self.words.missing(set().union(*[s for s in split if s]))
        self._learn(fresh)
        ids = self.words.young.__getitem__
        out = [self._ids(self.tokenizer, t).tobytes() if s is None else b"".join(map(ids, s)) for t, s in zip(texts, split, strict=True)]
        for word in [w for w in fresh if len(w) > _LONG]:
            del self.words.young[word]
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, open_bins: int = 512) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and then ``end_id``; only one longer than ``size`` is cut, into pieces
    of ``size`` and a rest. A null or empty text is the end id alone. Ids that are null or repeat are
    kept as they are, each row packed by itself. Columns besides ``doc_id`` and ``text`` are ignored;
    an empty table gives no rows. Sequence numbers hold the partition's number and the bin's, so a
    task that runs again on the same rows gives the same packing, and no bin spans two tasks.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bins, encoder, end = BestFit(size, open_bins), _encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in _lots(pc.binary_length(texts).to_pylist()):
                docs_, pieces, starts, lengths, crcs, bins_, offsets = ([] for _ in range(7))
                for k, data in enumerate(encoder.encode(texts.slice(first, last - first).to_pylist()), first):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        number, offset = bins.place(len(part) // 4)
                        docs_.append(k)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        bins_.append(base + number)
                        offsets.append(offset)
                columns = [ids.take(pa.array(docs_, pa.int64())), pa.array(pieces, pa.int32()), *[pa.array(c, pa.int64()) for c in (starts, lengths, crcs, bins_, offsets)]]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(packed, schema)


def _lots(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are tokenised together: up to ``_LOT`` bytes, one text at least."""
    first, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > _LOT:
            yield first, k
            first, held = k, 0
        held += n
    if lengths:
        yield first, len(lengths)
