import hashlib
import random
import re

import pytest

from marginalia.llm import infill

TEXTS = ["", None, "one two  three", "Zażółć gęślą jaźń 42", "a <P> b", "<M>", "x", "\n\t ", "tail <", "<S", "S>", "mixed<P", ">M> and", "\x00nul\x00", "é 👩‍💻 'quoted' \"text\" $seed"]


def brute(doc_id, text, seed=1, plain=10, spm=20, marks=infill.MARKS):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    p, s, m = marks
    out = s + c + p + a + m + b if h[3] % 100 < spm else p + a + s + c + m + b
    return n, "spm" if h[3] % 100 < spm else "psm", len(a), len(b), out


def corpus():
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    rows += [(1000 + k, " ".join("".join(rng.choices("abçdé.,1 <>PSM", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    return rows + [(5000, None), (5000, None), (None, "no id"), (None, "no id")]


def test_matches_brute_force(docs_of):
    rows = corpus()
    got = infill.restored(infill.fill_in_middle(docs_of(rows))).collect()
    known = {}
    for doc_id, text in rows:
        known.setdefault((doc_id, text), brute(doc_id, text))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == known[r.doc_id, r.text]
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_seeds_shares_and_marks(docs_of):
    rows = [(k, f"text number {k} <P> é") for k in range(200)]
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    got = infill.restored(infill.fill_in_middle(docs_of(rows), seed=9, plain_percent=0, spm_percent=100, marks=marks), marks).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, 9, 0, 100, marks) and r.restored == r.text for r in got)
    assert {r.form for r in got} == {"spm"}


def test_marks_that_could_be_mistaken_are_refused(docs_of):
    for marks in [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "<P>>", "<M>")]:
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs_of([(1, "x")]), marks=marks)


def test_empty_tables_clashing_names_and_long_texts(spark, docs_of, monkeypatch):
    assert infill.fill_in_middle(docs_of([]).where("doc_id = 0")).count() == 0
    assert infill.digests(docs_of([(1, "x")]).where("doc_id = 0")).count() == 0
    odd = spark.createDataFrame([(1, "some text here", 7, "f", "mine", "r")], "doc_id long, text string, N int, form string, Output string, restored string")
    row = infill.restored(infill.fill_in_middle(odd), output_col="_output", form_col="_form").first()
    assert (row.N, row.form, row.Output, row.restored) == (7, "f", "mine", "r")
    assert (row["_n"], row["_form"], row.prefix_chars, row.middle_chars, row["_output"]) == brute(1, "some text here") and row["_restored"] == "some text here"
    rng = random.Random(1)
    long = [(11, "word and " * 400_000), (12, "".join(rng.choices("aé \n.", k=3_000_000))), (13, "x" * 5_000_000), (14, "short")]
    for r in infill.restored(infill.fill_in_middle(docs_of(long))).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text) and r.restored == r.text


def test_lots_cover_all_rows_within_their_bytes():
    assert list(infill._lots([])) == []
    assert list(infill._lots([0, 0, 0])) == [(0, 3)]
    assert list(infill._lots([infill.LOT + 1, 5, infill.LOT - 5, 1])) == [(0, 1), (1, 2), (3, 1)]
