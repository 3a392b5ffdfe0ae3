import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß'1.-") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 30, 300, 3000]))) for _ in range(40)]
    odd = [None, "", " ", "It's  they'll go\x1c here　there \x0b \x0c x\r\ny", "<|endoftext|> a<|startoftext|>b", "é ́x İstanbul", "z" * 5000]
    return list(enumerate(texts + odd))


def test_pieces_are_the_tokenizers_ids(docs_of):
    rows, tok = corpus(), Tokenizer.from_file(PATH)
    got = packing.pack(docs_of(rows), PATH).collect()
    want = set()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((d, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


def test_sequences_have_no_gap_and_are_few(docs_of):
    got = packing.pack(docs_of(corpus()), PATH).collect()
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= sum(r.length for r in got) / 4096 * 1.1 + 3


@pytest.mark.parametrize("limit", [1, 4, 64])
def test_best_fit_takes_the_fullest_that_fits(limit):
    rng, bins, free = random.Random(limit), packing.BestFit(100, limit), {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        fits = [f for f in free.values() if f >= n]
        number, offset = bins.place(n)
        assert offset == (100 - min(fits) if fits else 0)
        left = 100 - offset - n
        free.pop(number, None)
        if left:
            if len(free) >= limit:
                fullest = min(free, key=lambda b: free[b])
                if left <= free[fullest]:
                    continue
                # of bins as full, any may close
                fullest = next(b for b in free if free[b] == free[fullest] and b not in bins.bins.get(free[b], []))
                del free[fullest]
            free[number] = left
        assert bins.open == len(free) <= limit


def test_defined_on_odd_tables(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0
    odd = docs_of([(None, "a"), (2**60 + 1, "a"), (2**60 + 1, "a")]).withColumn("offset", F.lit("x")).withColumn("piece", F.lit(1))
    assert sorted((r.doc_id or 0 for r in packing.pack(odd, PATH).collect())) == [0, 2**60 + 1, 2**60 + 1]


def test_tokenizers_of_other_rules_get_whole_texts():
    words, other = (packing.Encoder(public_tokenizers.path(f"{name}.json")) for name in ("word_bpe_49k", "byte_bpe_50k"))
    assert words.by_word and not other.by_word
    texts = ["Hello  World, it's", "x" * 300, "", "a.b"]
    assert other.encode(texts) == [np.array(other.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
