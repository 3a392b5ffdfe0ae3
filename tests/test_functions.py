import json
import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import documents as doc
from marginalia.functions import text as tx
from marginalia.functions import vectors as vx
from marginalia.functions.markdown import readable


@pytest.fixture(scope="module")
def ev(spark):
    """Evaluate a column function on literal values."""

    def run(make, *values):
        df = spark.createDataFrame([(0, *values)], "k int, " + ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
        return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x

    return run


def test_tokens_and_fold(ev):
    assert ev(tx.tokens, "Crème BRÛLÉE foo_bar, straße ²x 漢字 don't") == ["creme", "brulee", "foo", "bar", "straße", "²x", "漢字", "don", "t"]


def test_tags_and_links(ev):
    assert ev(tx.parse_tags, "#One two#no #tWo-3 (#x) #one #a_b") == ["one", "two-3", "a_b"]
    assert ev(tx.parse_wiki_links, "[[ A|B ]] [[]] [[C]] [[A|B]] [[open") == ["A|B", "C"]


def test_sentences_and_chunks(ev):
    long = " ".join(["word"] * 30)
    assert ev(tx.sentences, "  \n ") == []
    assert ev(tx.sentences, "One. Two here\n\n  next ") == ["One. Two here", "next"]
    assert ev(tx.sentences, f"{long} end. Then more! 9 no? Yes") == [f"{long} end.", "Then more! 9 no?", "Yes"]
    parts = ["a", "b", "c", "d"]
    assert ev(lambda c: tx.chunks(c, 2, 1), parts) == ["a b", "b c", "c d"]
    assert ev(lambda c: tx.chunks(c, 5, 0), parts) == ["a b c d"]
    assert ev(lambda c: tx.chunks(c, 3, 1), parts) == ["a b c", "c d"]
    assert ev(lambda c: tx.chunks(c, 0, 9), []) == [""]


def test_chunks_cover_all_sentences(ev):
    rng = random.Random(1)
    for _ in range(12):
        parts = [str(i) for i in range(rng.randrange(1, 30))]
        per, overlap = rng.randrange(1, 6), rng.randrange(0, 6)
        got = ev(lambda c, per=per, overlap=overlap: tx.chunks(c, per, overlap), parts)
        assert {w for g in got for w in g.split()} == set(parts) and all(len(g.split()) <= per for g in got)


def test_row_blocks(ev):
    rows = ["x" * 250, "y" * 250, "z" * 10, "é" * 500]
    assert ev(lambda c: tx.row_blocks(c, 400), rows) == ["x" * 250, "y" * 250 + "\n" + "z" * 10, "é" * 500]
    assert ev(lambda c: tx.row_blocks(c, 400), []) == []


def test_small_texts(ev):
    assert ev(lambda c: tx.excerpt(c, 3), "abcd") == "abc…" and ev(lambda c: tx.excerpt(c, 4), "abcd") == "abcd"
    assert ev(lambda c: tx.preview(c, 5), " \n\n  hello world") == "hello…"
    assert ev(tx.wiki_path, "./././A/Foo#bar") == "Foo#bar" and ev(tx.wiki_path, "../A/../wiki/x") == "wiki/x"
    assert ev(tx.path_candidates, "A/x") == ["A/x", "x"] and ev(tx.path_candidates, "x") == ["x", "A/x"]
    assert ev(tx.path_component, ' a/b:c*d?. ') == "a-b-c-d-." and ev(tx.path_component, "  ") == ""
    assert ev(tx.display_date, "2024-03-09") == "09-03-2024" and ev(lambda c: tx.display_date(c, "MDY"), "2024-03-09") == "03-09-2024" and ev(tx.display_date, "x") == "x"
    assert ev(tx.title_to_iso, "09-03-2024") == "2024-03-09" and ev(tx.title_to_iso, "note") is None
    assert [ev(lambda c, f=f: tx.title_to_iso(c, f), "2024-03-09") for f in ("DMY", "MDY", "ISO")] == ["2024-03-09"] * 3
    assert [ev(lambda c, f=f: tx.title_to_iso(c, f), "09-03-2024") for f in ("DMY", "MDY", "ISO")] == ["2024-03-09", "2024-09-03", "09-03-2024"]
    assert ev(tx.like_escape, r"a%b_c\d'e") == r"a\%b\_c\\d''e"
    assert ev(tx.query_value, "a b&é~*") == "a%20b%26%C3%A9~%2A"
    assert ev(tx.sanitised_snippet, '<b class="x">a</b><i>b</i><script>c') == "<b>a</b>bc"
    assert ev(tx.escaped_html, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert ev(tx.iso_utc, 1_704_067_199) == "2023-12-31T23:59:59Z" and str(ev(tx.utc_day, -1)) == "1969-12-31"
    assert ev(tx.model_matches, "nomic:latest", "nomic") and not ev(tx.model_matches, "nomic:v1", "nomic:v2")


@pytest.mark.parametrize("text, want, words", [
    ("# Trip plan", "Trip plan", 2), ("[[Other Page|see here]] [[Other Page]]", "see here Other Page", 4), ("Go ![[A Long Page]] on", "Go A Long Page on", 5),
    ("```py\nx = 42;\n```\n~~~\nselect * from t;\n~~~", "x = 42; select * from t;", 5), ("Use `[[A|B]]` and ``**b`c**`` so.", "Use [[A|B]] and **b`c** so.", 7),
    ("[Read](https://e.org) ![a map](m.png) <https://e.org>", "Read a map", 3), ("[Read][g] ![map][i]\n\n[g]: https://e.org\n[i]: m.png", "Read map", 2),
    ("Seen <!-- not these --> <span>inline</span>", "Seen inline", 2), ("*** ~~ ---", None, 0), ("one/two three-four five,six seven—eight", None, 8),
    ("```\nopen # end", "open # end", 2), ("Title\n=====\n<script>a b</script><style>c</style>ok", "Title ok", 2), ("%% kept %%", "%% kept %%", 1),
    ("- [x] *one* **two**\n> quote\n1. ~~old~~ __it__", "one two quote old it", 5), ("don't e.g 3.14 1,000 a_b x.y. 3.a", None, 8), ("", "", 0), ("```js\n```\nafter", "after", 1), ("    ```\nnot code `", None, 2),
])
def test_readable_text(ev, text, want, words):
    assert want is None or ev(doc.UDFS["readable"], text) == want
    assert ev(lambda c: tx.readable_words(doc.UDFS["readable"](c)), text) == words


@pytest.mark.parametrize("text, want", [
    ("a snake_case_name and _so_ __on__, 2*3*4 * 5", "a snake_case_name and so on, 234 * 5"), ("***both*** *one **two** three*", "both one two three"), ("*open and **open", "*open and **open"),
    ("[![alt *x*](pic.png)](http://e.org/(a)) [no link] [t][r] [t]", "alt x [no link] t [t]"), ("![[P|]] [[ | ]] [[A|b|c]] [[open", "P b|c [[open"),
    ("> > 1. # deep\n>\n+ [ ] task", "deep task"), ("#tag stays, #### gone", "#tag stays, #### gone"), ("a\n---\nb\n***", "a b ***"),
    ("`` a ` b `` `c", "a ` b `c"), ("~~~~\n~~~\n``` *x*\n~~~~ \n*y*", "~~~ ``` *x* y"), ("``` x\n~~~\n```", "~~~"),
    ("1 < 2 > 1 <b>bold</b> <!-- open", "1 < 2 > 1 bold <!-- open"), ("<SCRIPT>x</script > y <style>never closed", "y never closed"), ("[x]: http://e.org title\n  [y]: z\n[z] : w", "[z] : w"),
    ("line\u00a0one \u2003 two\r\nthree", "line one two three"), ("~a~ ~~b~~ ~~~c", "~a~ b ~~~c"),
])
def test_what_a_reader_sees(text, want):
    assert readable(text) == want


def test_long_and_odd_texts_are_read_in_proportion():
    for unit in ("*a ", "_a_ ", "`a ", "[a](", "[[a ", "<a ", "**a*", "~~a", "![", "<!-- ", "<script>", "> ", "a*b_"):
        began = time.process_time()
        readable(unit * 60_000)
        assert time.process_time() - began < 6, unit
    assert readable(None) is None and readable("") == "" and readable("\n`\n") == "`"


def test_reading_minutes(ev):
    assert [ev(lambda c, w=w: tx.reading_minutes(c, w), 401) for w in (200, 1, 9999, None, 0)] == [3, 9, 1, 3, 9]


def test_heat_levels(ev):
    assert [ev(lambda c: tx.heat_level(c, F.lit(8)), n) for n in (0, 2, 3, 6, 8)] == [0, 1, 2, 3, 4]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(vx.norm(F.col("a")), vx.normalised(F.col("a")), vx.normalised(F.col("b")), vx.squared_l2(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (5.0, [0.6, 0.8], None, 25.0)


def test_html():
    page = "<html><head><title> A  b</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><h2>Top [edit]</h2><p>one <b>two</b><p>three<script>var a='</p>'</script><ul><li>x<li><p>y</p></ul><table><tr><td>c<td>d</table>&amp; end</body></html>"
    assert doc.html_structured(page) == "- menu\n\n## Top [edit]\n\none two\n\nthree\n- x\n- y\n\ny\nc\nd"
    assert doc.html_flat(page).split("\n") == ["Top [edit]", "one two", "three", "x", "ycd& end"]
    assert "menu" in doc.html_flat(page, leaky=True) and "var a" in doc.html_flat(page, leaky=True)
    assert doc.html_title(page) == "A b" and doc.html_outline(page) == [{"level": 2, "text": "Top"}]
    assert doc.html_structured(None) is None and doc.html_flat("") == ""
    assert doc.rewrite_hrefs('<a class="q" href="http://x">a</a><a href="#f">b</a><a href=\'../A/Y\'>c</a>') == '<a class="q" data-external="http://x" href="#">a</a><a href="#f">b</a><a data-wiki-path=\'../A/Y\' href=\'#\'>c</a>'


@pytest.mark.parametrize(("text", "want"), [
    ("on 2024-02-30 and 2024-02-29", ["2024-02-29"]), ("31-12-2023, 2024-01-01", ["2023-12-31", "2024-01-01"]), ("the 3rd of March 2021", ["2021-03-03"]),
    ("March 3rd, 2021", ["2021-03-03"]), ("May be March 3, 2021 or 4 June 2022", ["2021-03-03"]), ("sept 5 1999", ["1999-09-05"]), ("2024-01-01 2024-01-01", ["2024-01-01"]), ("12-2024", []), ("March 3, 1850", []),
])
def test_dates_in_text(text, want):
    assert doc.dates_in_text(text) == want


def test_line_diff():
    assert doc.line_diff("a\nb", "a\nb") == [{"type": "unchanged", "lines": ["a", "b"]}]
    hunks = doc.line_diff("a\nb\nc", "a\nx\nc\nd")
    assert [(h["type"], h["lines"]) for h in hunks] == [("unchanged", ["a"]), ("remove", ["b"]), ("add", ["x"]), ("unchanged", ["c"]), ("add", ["d"])]
    assert doc.apply_hunks(hunks, {1, 2, 4}) == "a\nx\nc\nd" and doc.apply_hunks(hunks, set()) == "a\nb\nc"
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("\n".join(rng.choice("xyz") for _ in range(rng.randrange(8))) for _ in range(2))
        hunks = doc.line_diff(a, b)
        assert doc.apply_hunks(hunks, set(range(len(hunks)))) == b and doc.apply_hunks(hunks, set()) == a


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out, i, j = [a[i - 1], *out], i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_common_subsequences_of_all_sizes_follow_one_rule():
    rng = random.Random(3)
    for size in (0, 1, 3, 9, 40, 130):
        for _ in range(12):
            a, b = ([rng.choice("wxyz") for _ in range(rng.randrange(size + 1))] for _ in range(2))
            assert doc.common(a, b) == brute_common(a, b)


def test_single_changed_lines_have_segments():
    got = doc.coalesced(doc.line_diff("a\nthe old  word here\nz", "a\nthe new  word there\nz\nend"))
    assert [h["type"] for h in got] == ["unchanged", "modified", "unchanged", "add"]
    assert got[1]["old"] == [{"type": "equal", "text": "the "}, {"type": "remove", "text": "old"}, {"type": "equal", "text": "  word "}, {"type": "remove", "text": "here"}]
    assert got[1]["new"][1] == {"type": "add", "text": "new"} and got[1]["new"][-1] == {"type": "add", "text": "there"}
    two = doc.line_diff("p\nq", "r\ns")
    assert [h["type"] for h in doc.coalesced(two)] == ["remove", "add"]


def test_versions():
    order = ["1.0.0-1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.0.1", "v1.1.0", "2.0.0"]
    assert all(doc.is_newer(b, a) and not doc.is_newer(a, b) for a, b in zip(order, order[1:], strict=False))
    assert not doc.is_newer("1.0.0+x", "1.0.0+y") and doc.is_newer("odd", "1.0.0") and not doc.is_newer("odd", "odd") and not doc.is_newer("", "1.0.0")


def test_embeds_and_mentions():
    assert doc.embed_segments("a ![[ T ]] b\n```\n![[no]]\n```\n![[open") == [{"kind": "text", "value": "a "}, {"kind": "embed", "value": "T"}, {"kind": "text", "value": " b\n```\n![[no]]\n```\n![[open"}]
    assert doc.link_first_mention("[[T]] and T, T", "T") == "[[T]] and [[T]], T"
    assert doc.link_first_mention("[[T x", "T") == "[[[[T]] x" and doc.link_first_mention("none", "T") == "none"


def test_snippets():
    text = "start " + "pad " * 50 + "needle Needles. tail " + "pad " * 50
    got = doc.best_snippet(text, ["needle"])
    assert "<b>needle</b> <b>Needles</b>." in got and got.startswith("...") and got.endswith("...")
    assert doc.best_snippet("no hit here", ["zz"]) == "no hit here" and doc.best_snippet("Crème brûlée", ["creme"]) == "<b>Crème</b> brûlée"


def test_decoding_and_office_files(tmp_path):
    import io
    import zipfile

    assert [doc.decode_text(x) for x in (b"\xef\xbb\xbfa", "é".encode("utf-16"), "é".encode(), b"\xe9", b"", None)] == ["a", "é", "é", "é", "", None]

    def archive(name, xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    assert doc.docx_text(archive("word/document.xml", f'<w:d xmlns:w="{w}"><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:d>')) == "ab\nc"
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    assert doc.odt_text(archive("content.xml", f'<o xmlns:text="{t}"><text:h text:outline-level="2">H</text:h><text:p>p <text:span>q</text:span></text:p></o>')) == "## H\n\np q"
    assert doc.docx_text(b"junk") is None and doc.odt_text(None) is None


def test_column_forms_take_nulls(spark):
    df = spark.createDataFrame([("<p>x</p>", "a"), (None, None)], "h string, t string")
    rows = df.select(doc.UDFS["html_flat"](F.col("h")), doc.UDFS["dates_in_text"](F.col("t")), doc.UDFS["line_diff"](F.col("t"), F.col("t"))).collect()
    assert rows[0][0] == "x" and rows[1] == (None, None, None)
    assert json.dumps(rows[0][1]) == "[]"
