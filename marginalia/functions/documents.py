"""Functions that no column expression can state: HTML, dates in prose, line diffs, versions, embeds, office files.

Each is a plain function on one value and, in :data:`UDFS`, an Arrow-batched column function of the same name.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .markdown import readable
from .pdf import pdf_text

#: Elements whose text is kept, whose start ends a paragraph, that break lines, that are dropped.
_KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th"}
_ENDS_P = _KEPT | {"ul", "ol", "dl", "table", "div", "section", "article", "nav", "header", "footer", "pre", "blockquote", "form", "tr"}
_BREAKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "br"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "nav"}
_MONTHS = "january february march april may june july august september october november december".split()


#: A comment, declaration or tag; quoted attribute values may hold ``>``.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)>""", re.S)
_RAW_END = {tag: re.compile(f"</{tag}\\b", re.I) for tag in ("script", "style")}
_TOC = re.compile(r"""\b(?:id\s*=\s*["']?toc(?=["'\s/>]|$)|class\s*=\s*(?:"(?:[^"]*\s)?toc[\s"]|'(?:[^']*\s)?toc[\s']|toc(?=[\s/>]|$)))""", re.I)
#: Elements that a new one of their kind ends, and those within which it does not look further out.
_LIKE = {tag: (frozenset(like), frozenset(stop)) for like, stop in ((("li",), ("ul", "ol")), (("td", "th"), ("tr", "table")), (("tr",), ("table",)), (("dt", "dd"), ("dl",))) for tag in like}


def _events(html: str) -> list[tuple]:
    """``("start", tag, is a table of contents)``, ``("end", tag)`` and ``("text", data)`` in order.

    One pass of a tag pattern keeps the open elements by the rules for implied ends: a new block ends ``p``,
    and ``li td th tr dt dd`` end their like. Scripts and styles are text up to their end tag.
    """
    out: list[tuple] = []
    open_: list[str] = []
    put, at, size = out.append, 0, len(html)

    def close(depth: int) -> None:
        while len(open_) > depth:
            put(("end", open_.pop()))

    def last(tags) -> int:
        for depth in range(len(open_) - 1, -1, -1):
            if open_[depth] in tags:
                return depth
        return -1

    while at < size:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            put(("text", unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in open_:
                close(last((tag,)))
            continue
        if tag in _ENDS_P and "p" in open_:
            close(last(("p",)))
        if tag in _LIKE:
            like, stop = _LIKE[tag]
            depth = last(like | stop)
            if depth >= 0 and open_[depth] in like:
                close(depth)
        attributes = m[3]
        put(("start", tag, "toc" in attributes.lower() and bool(_TOC.search(attributes))))
        if tag in _VOID:
            continue
        open_.append(tag)
        if attributes.endswith("/"):
            close(len(open_) - 1)
        elif tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            stop_at = end.start() if end else size
            if stop_at > at:
                put(("text", html[at:stop_at]))
            at = stop_at
    close(0)
    return out


def html_structured(html: str | None) -> str | None:
    """Headings, paragraphs, items and cells in document order as marked plain text; nested ones come twice."""
    if html is None:
        return None
    blocks: list[list] = []
    open_: list[int] = []
    depth_dropped = 0
    for event in _events(html):
        kind, what = event[0], event[1]
        if what in ("script", "style") and kind != "text":
            depth_dropped += 1 if kind == "start" else -1
        elif kind == "start" and what in _KEPT:
            open_.append(len(blocks))
            blocks.append([what, []])
        elif kind == "end" and what in _KEPT and open_:
            open_.pop()
        elif kind == "text" and not depth_dropped:
            for i in open_:
                blocks[i][1].append(what)
    out = []
    for tag, parts in blocks:
        text = " ".join(" ".join(parts).split())
        if text:
            lead = f"\n\n{'#' * int(tag[1])} " if tag[0] == "h" else {"li": "\n- ", "p": "\n\n"}.get(tag, "\n")
            out.append(lead + text)
    return re.sub(r"\n{3,}", "\n\n", "".join(out).strip())


def html_flat(html: str | None, leaky: bool = False) -> str | None:
    """Text of the body, a line for each block. ``leaky`` keeps what scripts, styles and navigation hold."""
    if html is None:
        return None
    events = _events(html)
    whole = not any(e[0] == "start" and e[1] == "body" for e in events)
    out, inside, dropped = [], whole, 0
    stack: list[bool] = []
    for event in events:
        kind, what = event[0], event[1]
        if kind == "start":
            drop = what in _DROPPED or event[2]
            if what not in _VOID:
                stack.append(drop)
                dropped += drop
            inside = inside or what == "body"
            if what in _BREAKS and inside:
                out.append("\n")
        elif kind == "end":
            dropped -= stack.pop()
            if what == "body":
                inside = whole
        elif inside and (leaky or not dropped):
            out.append(what)
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def html_title(html: str | None) -> str | None:
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    return " ".join(found[1].split()) if found else None


def html_article(html: str | None) -> dict | None:
    """Title and flat text."""
    return None if html is None else {"title": html_title(html), "flat": html_flat(html)}


def html_outline(html: str | None) -> list[dict] | None:
    """Headings h1 to h4 in order, without ``[edit]``."""
    if html is None:
        return None
    out, level, parts = [], 0, []
    for event in _events(html):
        if event[0] == "start" and re.fullmatch("h[1-4]", event[1]):
            level, parts = int(event[1][1]), []
        elif event[0] == "end" and level and event[1] == f"h{level}":
            text = " ".join("".join(parts).replace("[edit]", "").split())
            if text:
                out.append({"level": level, "text": text})
            level = 0
        elif event[0] == "text" and level:
            parts.append(event[1])
    return out


def rewrite_hrefs(html: str | None) -> str | None:
    """External links lose their target, fragments stay, internal ones move to a data attribute."""

    def swap(m: re.Match) -> str:
        quote, target = m[2], m[3]
        if re.match(r"(?i)(?:[a-z][a-z0-9+.-]*:|//)", target):
            return f"{m[1]}data-external={quote}{target}{quote} href={quote}#{quote}"
        if target.startswith("#"):
            return m[0]
        return f"{m[1]}data-wiki-path={quote}{target}{quote} href={quote}#{quote}"

    return None if html is None else re.sub(r"""(?is)(<a\s(?:[^>]*?\s)?)href=(["'])(.*?)\2""", swap, html)


def dates_in_text(text: str | None, form: str = "DMY") -> list[str] | None:
    """ISO dates, dates in the configured form and one date in words, in order of place, without repeats."""
    if text is None:
        return None
    found: list[tuple[int, str]] = []

    def add(at: int, y: int, m: int, d: int, bound: bool = True) -> None:
        if bound and not 1900 <= y <= 2100:
            return
        try:
            found.append((at, datetime.date(y, m, d).isoformat()))
        except ValueError:
            pass

    for at in range(len(text) - 9):
        w = text[at : at + 10]
        if w[4] == w[7] == "-" and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", w):
            add(at, int(w[:4]), int(w[5:7]), int(w[8:]), False)
    order = {"DMY": (2, 1, 0), "MDY": (2, 0, 1)}.get(form)
    if order:
        for m in re.finditer(r"[0-9-]+", text):
            parts = m[0].split("-")
            if len(parts) == 3 and all(parts) and len(parts[2]) == 4 and len(parts[0]) <= 2 and len(parts[1]) <= 2:
                add(m.start(), *(int(parts[i]) for i in order))
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W_]+", text)]
    for k, (at, word) in enumerate(words):
        low = word.lower()
        month = next((i for i, name in enumerate(_MONTHS, 1) if low == name or len(low) >= 3 and low in (name[:3], "sept" if name == "september" else name[:3])), 0)
        if not month:
            continue
        number = lambda w: int(n[1]) if (n := re.fullmatch(r"([0-9]{1,2})(?:st|nd|rd|th)?", w.lower())) else None
        year = lambda w: int(w) if re.fullmatch("[0-9]{4}", w) and 1900 <= int(w) <= 2100 else None
        before, after = [w for _, w in words[:k]], [w for _, w in words[k + 1 :]]
        day = next((number(w) for w in reversed(before) if w[0].isdigit()), None)
        n = len(found)
        if day and after and year(after[0]):
            add(at, year(after[0]), month, day)
        elif len(after) > 1 and number(after[0]) and year(after[1]):
            add(at, year(after[1]), month, number(after[0]))
        if len(found) > n:
            break
    return list(dict.fromkeys(iso for _, iso in sorted(found, key=lambda x: x[0])))


def common(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence of two lists: of equally long ones that which matches from the end, passing over ``b`` first.

    Only every so many rows of the table of lengths are kept, and the rows between are made again on the way
    back, so memory grows with the shorter way to look at it: the root of one list's length times the other's.
    """
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(v, len(numbers)) for v in part], np.int64) for part in (a, b))
    every = max(1, int(len(a) ** 0.5))

    def below(row: np.ndarray, i: int) -> np.ndarray:
        new = row.copy()
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == x[i])))
        return new

    row = np.zeros(len(b) + 1, np.int32)
    kept = [row]
    for i in range(len(a)):
        row = below(row, i)
        if (i + 1) % every == 0:
            kept.append(row)
    out, i, j, rows, first = [], len(a), len(b), [], -1
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
            continue
        if not first <= i - 1 < i < first + len(rows):
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            while len(rows) <= i - first:
                rows.append(below(rows[-1], first + len(rows) - 1))
        if rows[i - 1 - first][j] > rows[i - first][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _runs(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """``unchanged``, ``remove`` and ``add`` runs: each common item is matched where it comes next, removed ones come before added ones."""
    out: list[tuple[str, list[str]]] = []

    def put(kind: str, items: list[str]) -> None:
        if items and out and out[-1][0] == kind:
            out[-1][1].extend(items)
        elif items:
            out.append((kind, list(items)))

    i = j = 0
    for item in common(a, b):
        at, to = a.index(item, i), b.index(item, j)
        put("remove", a[i:at])
        put("add", b[j:to])
        put("unchanged", [item])
        i, j = at + 1, to + 1
    put("remove", a[i:])
    put("add", b[j:])
    return out


def line_diff(old: str | None, new: str | None) -> list[dict] | None:
    """Hunks ``{type, lines}`` of a longest common subsequence of lines; the same rule for texts of any size."""
    if old is None or new is None:
        return None
    return [{"type": kind, "lines": lines} for kind, lines in _runs(old.split("\n"), new.split("\n"))]


def coalesced(hunks: list[dict] | None) -> list[dict] | None:
    """The hunks with a removed line and an added one after it as one ``modified`` hunk, whose ``old`` and ``new`` are segments
    ``{type: equal, remove or add, text}`` of words and blanks."""
    if hunks is None:
        return None
    out: list[dict] = []
    for hunk in hunks:
        last = out[-1] if out else None
        if last and (last["type"], hunk["type"]) == ("remove", "add") and len(last["lines"]) == len(hunk["lines"]) == 1:
            one, two = ([t for t in re.split(r"(\s+)", part["lines"][0]) if t] for part in (last, hunk))
            runs = [("equal" if kind == "unchanged" else kind, "".join(items)) for kind, items in _runs(one, two)]
            old, new = ([{"type": k, "text": t} for k, t in runs if k in ("equal", own)] for own in ("remove", "add"))
            out[-1] = {"type": "modified", "lines": last["lines"] + hunk["lines"], "old": _joined(old), "new": _joined(new)}
        else:
            out.append(hunk | {"old": [], "new": []})
    return out


def _joined(segments: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in segments:
        if out and out[-1]["type"] == s["type"]:
            out[-1]["text"] += s["text"]
        else:
            out.append(dict(s))
    return out


def apply_hunks(hunks: list[dict], accepted: set[int]) -> str:
    """The text in which the hunks with these numbers are applied and the others are not."""
    lines: list[str] = []
    for i, hunk in enumerate(hunks):
        if hunk["type"] == "unchanged" or (hunk["type"] == "add") == (i in accepted):
            lines += hunk["lines"]
    return "\n".join(lines)


def _version(text: str) -> tuple | None:
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text.strip())
    if not m:
        return None
    # a release comes after its prereleases; numbers before words
    pre = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split(".")) if m[4] else ()
    return int(m[1]), int(m[2]), int(m[3]), not m[4], pre


def is_newer(latest: str | None, current: str | None) -> bool | None:
    """Whether a version comes after another; where one cannot be read, whether they differ."""
    if latest is None or current is None:
        return None
    a, b = _version(latest), _version(current)
    return a > b if a and b else bool(latest) and latest != current


def embed_segments(text: str | None) -> list[dict] | None:
    """``{kind: text or embed, value}`` parts at ``![[title]]``; fenced code and unclosed marks are text."""
    if text is None:
        return None
    out: list[dict] = []

    def put(kind: str, value: str) -> None:
        if kind == "text" and out and out[-1]["kind"] == "text":
            out[-1]["value"] += value
        elif value:
            out.append({"kind": kind, "value": value})

    fenced = False
    for line in text.splitlines(keepends=True):
        if re.match(r"\s*(?:```|~~~)", line):
            fenced = not fenced
            put("text", line)
            continue
        at = 0
        for m in () if fenced else re.finditer(r"!\[\[([^\[\]\n]*)\]\]", line):
            if m[1].strip():
                put("text", line[at : m.start()])
                put("embed", m[1].strip())
                at = m.end()
        put("text", line[at:])
    return out


def link_first_mention(text: str | None, title: str | None) -> str | None:
    """The text with the first occurrence of the title that is not within both brackets made a link."""
    if not text or not title:
        return text
    at = text.find(title)
    while at >= 0:
        end = at + len(title)
        if not (text[max(0, at - 2) : at] == "[[" and text[end : end + 2] == "]]"):
            return f"{text[:at]}[[{title}]]{text[end:]}"
        at = text.find(title, end)
    return text


def decode_text(data: bytes | None) -> str | None:
    """By byte-order mark, else UTF-8, else Windows-1252; what is blank so, lossily as UTF-8."""
    if data is None:
        return None
    data = bytes(data)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    for name in ("utf-8", "cp1252"):
        try:
            if (text := data.decode(name)).strip():
                return text
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def csv_text(text: str | None) -> str | None:
    """The rows of a CSV text, one a line, trimmed cells joined by tabs; quoted cells may hold commas, quotes and line ends, which become blanks."""
    if text is None:
        return None
    csv.field_size_limit(1 << 30)
    rows = ([" ".join(cell.split("\n")).strip() for cell in row] for row in csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""), skipinitialspace=True))
    return "\n".join("\t".join(row) for row in rows if any(row))


def _xml_of(data: bytes, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(data))).read(name))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def docx_text(data: bytes | None) -> str | None:
    """Paragraphs of a DOCX file, a line each; null for other bytes."""
    root = _xml_of(data, "word/document.xml") if data is not None else None
    if root is None:
        return None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join(t for p in root.iter(f"{w}p") if (t := "".join(x.text or "" for x in p.iter(f"{w}t")).strip()))


def odt_text(data: bytes | None) -> str | None:
    """Headings (``#`` by level, after a blank line) and paragraphs of an ODT file; null for other bytes."""
    root = _xml_of(data, "content.xml") if data is not None else None
    if root is None:
        return None
    ns = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    out = []
    for node in root.iter():
        if node.tag in (f"{ns}h", f"{ns}p") and (text := "".join(node.itertext()).strip()):
            level = min(6, max(1, int(node.get(f"{ns}outline-level") or 1)))
            out.append(f"\n{'#' * level} {text}\n" if node.tag == f"{ns}h" else text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def best_snippet(text: str | None, terms: list[str], size: int = 32) -> str | None:
    """The run of up to ``size`` tokens with most that begin with a term, those in ``<b>``; the start without any."""
    if text is None:
        return None
    import unicodedata

    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    hit = [any(fold(text[a:b]).startswith(t) for t in terms) for a, b in spans]
    # hits of each run from those of the one before
    counts = [sum(hit[:size])]
    for i in range(len(spans) - size):
        counts.append(counts[-1] - hit[i] + hit[i + size])
    first = counts.index(max(counts))
    part = spans[first : first + size]
    if not part:
        return text
    start, end = (0 if first == 0 else part[0][0]), (len(text) if first + size >= len(spans) else part[-1][1])
    out, at = ["..." if start else ""], start
    for (a, b), h in zip(part, hit[first : first + size], strict=True):
        if h:
            out += [text[at:a], "<b>", text[a:b], "</b>"]
            at = b
    return "".join([*out, text[at:end], "..." if end < len(text) else ""])


#: Values whose results a task holds as Python objects at once.
PIECE = 256


def _udf(function, kind, *fixed):
    if isinstance(kind, str):
        kind = T.DataType.fromDDL(kind)
    of = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        # values become objects one by one, and results Arrow's again piece by piece: a batch of long texts is not held as objects as well
        pieces = []
        for start in range(0, len(columns[0]), PIECE):
            values = zip(*(c.slice(start, PIECE) for c in columns), strict=True)
            pieces.append(pa.array([function(*(v.as_py() for v in row), *fixed) for row in values], of))
        return pa.concat_arrays(pieces) if pieces else pa.array([], of)

    return run


def column_function(function, kind):
    """A column function that is computed where it stands: filters on its result are not moved below it, which would compute it twice."""
    return _udf(function, kind).asNondeterministic()


def _string(function, *fixed):
    return lambda *columns: _udf(function, T.StringType(), *fixed)(*columns)


#: Column functions by name.
UDFS = {f.__name__: _string(f) for f in (html_structured, html_flat, html_title, rewrite_hrefs, link_first_mention, decode_text, csv_text, docx_text, odt_text, pdf_text, readable)} | {
    "html_article": lambda c: column_function(html_article, "title string, flat string")(c),
    "coalesced": lambda a, b: _udf(lambda old, new: coalesced(line_diff(old, new)), "array<struct<type:string,lines:array<string>,old:array<struct<type:string,text:string>>,new:array<struct<type:string,text:string>>>>")(a, b),
    "html_outline": lambda c: _udf(html_outline, "array<struct<level:int,text:string>>")(c),
    "dates_in_text": lambda c, form="DMY": _udf(dates_in_text, "array<string>", form)(c),
    "line_diff": lambda a, b: _udf(line_diff, "array<struct<type:string,lines:array<string>>>")(a, b),
    "is_newer": lambda a, b: _udf(is_newer, "boolean")(a, b),
    "embed_segments": lambda c: _udf(embed_segments, "array<struct<kind:string,value:string>>")(c),
    "best_snippet": lambda c, terms: _udf(best_snippet, T.StringType(), terms)(c),
}
