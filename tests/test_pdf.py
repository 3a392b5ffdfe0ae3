import random
import zlib

import duckdb
import pytest

from marginalia.functions import pdf as pdf_module
from marginalia.functions.pdf import glyph, pdf_text
from marginalia.plans.domain import pdf_file
from marginalia.plans.queries import SQL
from marginalia.plans.store_queries import src8_pdf_text
from marginalia.sources import files as fi


def plain(objects, extra=b"", trailer=b""):
    """A file of these objects with a table of references."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    at = len(out)
    return bytes(out) + b"xref\n0 1\n0000000000 65535 f \n1 %d\n" % len(objects) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer <</Size %d /Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, trailer, at) + extra


def stream(data, head=b""):
    return b"<</Length %d%s>>\nstream\n" % (len(data), head) + data + b"\nendstream"


def page(content, font=b"<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>", more=()):
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</X 6 0 R>>>>>>", content if content.endswith(b"endstream") else stream(content), font]
    return [*objects, *more]


TEXTS = ["one two\nthree\n\nfour", "é 日本 𝄞 x", "a" * 70_000, "\n".join(f"line {i} of many" for i in range(200)), "tab\there (brackets) <and> \\ [more]"]


@pytest.mark.parametrize("streams", [True, False])
def test_generated_files_come_back(streams):
    for text in TEXTS:
        got = pdf_text(pdf_file(text, streams))
        assert "\n".join(x for x in got.split("\n") if x) == "\n".join(x for x in text.split("\n") if x)
    assert pdf_text(pdf_file(" \n ", streams)) == "" and pdf_file(None) is None


@pytest.mark.parametrize("streams", [True, False])
def test_objects_are_found_without_tables(streams):
    whole = pdf_file(TEXTS[0], streams)
    want = pdf_text(whole)
    assert pdf_text(whole.replace(b"startxref", b"startxxxx")) == want
    assert pdf_text(b"junk before\n" + whole) == want
    at = whole.rindex(b"startxref\n")
    assert pdf_text(whole[:at] + b"startxref\n7\n%%EOF") == want


def test_placement_makes_words_and_lines():
    shown = b"BT /F 10 Tf 14 TL 10 700 Td (one) Tj 40 0 Td (two) Tj T* (three) Tj (four) ' [(fi) -50 (ve) -400 (six)] TJ 1 0 0 1 10 600 Tm (s\\(ev\\)en \\351\\\n!) Tj ET"
    assert pdf_text(plain(page(shown))) == "one two\nthree\nfourfive six\ns(ev)en é!"


def test_widths_tell_gaps():
    font = b"<</Type/Font/Subtype/Type1/FirstChar 97/Widths[500 500 500]/FontDescriptor<<>>>>"
    assert pdf_text(plain(page(b"BT /F 10 Tf (abc) Tj 15 0 Td (abc) Tj 18 0 Td (abc) Tj ET", font))) == "abcabc abc"


def test_matrices_saved_states_and_forms():
    form = stream(b"BT /F 5 Tf 0 -20 Td (inner) Tj ET", b"/Subtype/Form/Matrix[1 0 0 1 0 0]")
    shown = b"q 2 0 0 2 0 0 cm BT /F 5 Tf (outer) Tj ET Q q 1 0 0 1 0 -9 cm /X Do Q BI /W 1 ID \x00(Tj) EI BT /F 5 Tf 0 -90 Td (last) Tj ET"
    assert pdf_text(plain(page(shown, more=[form]))) == "outer\ninner\nlast"
    looped = stream(b"BT /F 5 Tf (x) Tj ET /X Do", b"/Subtype/Form/Resources<</Font<</F 5 0 R>>/XObject<</X 6 0 R>>>>")
    assert pdf_text(plain(page(b"/X Do", more=[looped]))) == "x"


def test_ranges_differences_and_filters():
    cmap = stream(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <41> <43> <0430> <50> <51> [<00660069> <0031>] endbfrange")
    font = b"<</Type/Font/Subtype/TrueType/ToUnicode 6 0 R>>"
    assert pdf_text(plain(page(b"BT /F 1 Tf (ABCPQz) Tj ET", font, [cmap]))) == "абвfi1z"
    named = b"<</Type/Font/Subtype/Type1/Encoding<</Differences[1/eacute/comma 65/uni0416/germandbls]>>>>"
    packed = zlib.compress(b"BT /F 1 Tf <0102 41 42 43> Tj ET").hex().encode() + b">"
    assert pdf_text(plain(page(stream(packed, b"/Filter[/ASCIIHexDecode/FlateDecode]"), named))) == "é,ЖßC"
    assert [glyph(x) for x in ("Aring", "three", "space", "colon", "nothing.alt", "a.sc")] == ["Å", "3", " ", ":", "", "a"]


def test_arrays_are_shown_whole_as_string_by_string(monkeypatch):
    cmap = stream(b"1 begincodespacerange <00> <ff> endcodespacerange 3 beginbfchar <41> <0430> <42> <00660069> <43> <0020> endbfchar 1 beginbfrange <50> <5f> <0440> endbfrange")
    font = b"<</Type/Font/Subtype/TrueType/ToUnicode 6 0 R/FirstChar 65/Widths[500 250 0 700]/FontDescriptor<<>>>>"
    rng = random.Random(7)
    for _ in range(60):
        parts = [rng.choice([f"<{''.join(rng.choice(['41', '42', '43', '44', '50', '5a', '20', '7a']) for _ in range(rng.randrange(5)))}>", str(rng.choice([-400, -100, 90, 2000, -2.5]))]) for _ in range(rng.randrange(1, 30))]
        row = lambda between, parts=parts: f"2 0 .5 1 10 600 Tm [{between.join(parts)}] TJ (x) Tj 0 -3 Td [{between.join(parts[::-1])}]TJ T* (y) Tj"
        at = "BT /F 10 Tf 14 TL 1 Tc 3 Tw 90 Tz "
        # a comment keeps a row from being taken whole
        assert pdf_text(plain(page((at + row(" ")).encode(), font, [cmap]))) == pdf_text(plain(page((at + row(" %-\n")).encode(), font, [cmap]))), parts
    counts = []
    for words in (50, 5000):
        seen, inner = [], pdf_module.values
        with monkeypatch.context() as m:
            m.setattr(pdf_module, "values", lambda *a, seen=seen, inner=inner: (seen.append(1) or x for x in inner(*a)))
            assert pdf_text(pdf_file("some words " * words)).count("some words") == words
        counts.append(len(seen))
    assert counts[0] == counts[1]  # what is read token by token does not grow with the words of a line


def test_updates_hide_what_they_replace():
    base = plain(page(b"BT /F 1 Tf (old) Tj ET"))
    at, body = len(base) + 1, b"4 0 obj\n" + stream(b"BT /F 1 Tf (new) Tj ET") + b"\nendobj\n"
    first = base.rindex(b"xref\n0 1")
    more = b"\n" + body + b"xref\n4 1\n%010d 00000 n \ntrailer <</Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, first, at + len(body))
    assert pdf_text(base + more) == "new"


def test_damage_has_no_text():
    assert pdf_text(None) is None and pdf_text(b"") is None and pdf_text(b"%PDF-1.4") is None
    assert pdf_text(plain(page(b"BT /F 1 Tf (x) Tj ET"), trailer=b"/Encrypt<</V 1>>")) is None
    loop = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[2 0 R 3 0 R]>>", b"<</Type/Pages/Kids[2 0 R]>>"]
    assert pdf_text(plain(loop)) == ""
    rng = random.Random(5)
    for streams in (True, False):
        whole = pdf_file("some words\nand lines", streams)
        for _ in range(150):
            cut = bytearray(whole)
            for _ in range(rng.randrange(1, 12)):
                cut[rng.randrange(len(cut))] = rng.randrange(256)
            got = pdf_text(bytes(cut[: rng.randrange(len(cut))] if rng.random() < 0.3 else cut))
            assert got is None or isinstance(got, str)
    assert pdf_text(plain(page(b"[" * 100_000 + b"(x) Tj"))) is not None


def test_files_by_format(spark):
    rows = [("/a.pdf", bytearray(pdf_file("so it is"))), ("/blank.pdf", bytearray(pdf_file(" "))), ("/bad.PDF", bytearray(b"%PDF-1.4 no")), ("/none.pdf", None), ("/e.pdf", bytearray()), ("/t.txt", bytearray(b"%PDF-1.4 text"))]
    files = spark.createDataFrame(rows, "path string, content binary").selectExpr("path", "'m' AS mime", "0 AS mtime", "content")
    got = {r.path: (r.content, r.error) for r in fi.extracted(files).collect()}
    assert got == {"/a.pdf": ("so it is", None), "/blank.pdf": ("", "no text"), "/bad.PDF": (None, "no text"), "/none.pdf": (None, "not readable"), "/e.pdf": (None, "no text"), "/t.txt": ("%PDF-1.4 text", None)}


def test_the_query_gives_odd_documents_as_its_sql(spark, tmp_path):
    odd = [f"{c} a{c} b {c}\n{c} {c}  c{c}\nd" for c in "\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000"]
    rows = [*enumerate([None, "", " ", " \n \n", "\t", "x", *odd, *odd]), (-3, "below \t zero"), (-4, None), (-5, "a b"), (None, "no number")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in src8_pdf_text(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(SQL["src8_pdf_text"]).fetchall(), key=repr)
