import hashlib

import numpy as np
import pandas as pd
import pytest

from marginalia.operators import ingest as ing


@pytest.mark.parametrize("dims", [1, 8, 768])
def test_words_are_hashed_once(monkeypatch, dims):
    texts = [None, "", " ", "one Two one\nthree ß é", "two " * 500, *(f"word{i % 7} and word{i % 3} one" for i in range(300))]

    def plain(t):
        v = np.zeros(dims)
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dims] += 1 if h >> 63 else -1
        return (v / (np.linalg.norm(v) or 1)).tolist()

    want, calls, inner = [plain(t) for t in texts], [], hashlib.blake2b
    monkeypatch.setattr(ing.hashlib, "blake2b", lambda *a, **k: calls.append(a) or inner(*a, **k))
    run = lambda: [v for part in ing.hashing_embedder(dims)(iter([pd.Series(texts[:9], dtype=object), pd.Series(texts[9:], dtype=object)])) for v in part]
    assert run() == want
    assert len(calls) == len({w for t in texts for w in (t or "").lower().split()})
    monkeypatch.setattr(ing, "_WORDS", 2)
    assert run() == want
