"""What a reader sees of Markdown: one pass over the lines for blocks, one over each stretch of prose for spans.

Blocks: the lines of fenced code are shown as they are, without the fences; marks of quotes, lists, tasks and headings
go, and lines that only underline, part or define a link are not shown. Spans: code is shown as it is; of a link its
text, of a page link its label or else its title; marks of emphasis and strike-through go where they come in
pairs; comments, scripts, styles and tags are not shown. Anything that is not closed is text.
"""

from __future__ import annotations

import re

#: A line's marks, one after another: quotes, headings, list items and tasks.
_MARK = re.compile(r" {0,3}(?:>[ \t]?|#{1,6}(?=[ \t]|$)[ \t]*|(?:[-+*]|\d{1,9}[.)])[ \t]+|\[[ xX]\][ \t]+)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
#: Lines that underline a title or part sections, and definitions of links.
_UNSEEN = re.compile(r"\s*(?:=+|-+)\s*$| {0,3}\[[^\]]+\]:\s+\S")
_SPECIAL = re.compile(r"[`<\[\]*_~]")
#: Where a link leads: in round brackets, which may hold pairs of them, or by a reference.
_TARGET = re.compile(r"\((?:[^()\\]|\\.|\([^()]*\))*\)|\[[^\]\n]*\]", re.S)
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_HIDDEN = re.compile(r"<(script|style)\b", re.I)


def readable(text: str | None) -> str | None:
    """The visible words of a Markdown text, with one blank between them."""
    if text is None:
        return None
    shown: list[str] = []
    prose: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                fence = ""
            else:
                shown.append(line)
        elif mark:
            shown.append(_spans("\n".join(prose)))
            prose, fence = [], mark[1]
        elif not _UNSEEN.match(line):
            at = 0
            while found := _MARK.match(line, at):
                at = found.end()
            prose.append(line[at:])
    shown.append(_spans("\n".join(prose)))
    return " ".join(" ".join(shown).split())


def _brackets(text: str) -> dict[int, int]:
    """Of each square bracket that is closed where its partner is."""
    open_, found = [], {}
    for m in re.finditer(r"[\[\]]", text):
        if m[0] == "[":
            open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.start()
    return found


def _closers(text: str) -> dict[tuple[str, int], list[int]]:
    """By mark and length, where runs of it may close a span, the last first: behind something that is no blank, and underlines not within a word."""
    found: dict[tuple[str, int], list[int]] = {}
    for m in reversed([*re.finditer(r"`+|\*+|_+|~+", text)]):
        behind = m[0][0] == "`" or (m.start() and not text[m.start() - 1].isspace())
        within = m[0][0] == "_" and text[m.end() : m.end() + 1].isalnum()
        if behind and not within:
            found.setdefault((m[0][0], len(m[0])), []).append(m.start())
    return found


def _spans(text: str) -> str:
    """A stretch of prose without what its reader does not see.

    The text is walked once. What opens a span finds its end and leaves word there of how much to skip (``ends``), so what is within
    is walked as any other text.
    """
    pair, closers, out, ends, at = _brackets(text), _closers(text), [], {}, 0
    missing: set[str] = set()

    def end_of(what: str, pattern: str, after: int) -> int:
        """Where the next match of a pattern ends, or -1; what is not there is looked for once."""
        found = None if what in missing else re.compile(pattern, re.I).search(text, after)
        if not found:
            missing.add(what)
        return found.end() if found else -1

    while m := _SPECIAL.search(text, at):
        here, c = m.start(), m[0]
        out.append(text[at:here])
        at = here + 1
        if here in ends:
            at = here + ends[here]
        elif c == "<":
            hidden = _HIDDEN.match(text, here)
            if text.startswith("<!--", here):
                end = end_of("comment", "-->", here)
                at = end if end >= 0 else at
            elif hidden:
                end = end_of(hidden[1].lower(), rf"</{hidden[1]}\s*>", here)
                tag = _TAG.match(text, here)
                at = end if end >= 0 else tag.end() if tag else at
            elif tag := _TAG.match(text, here):
                at = tag.end()
            out.append("<" if at == here + 1 else " ")
        elif c == "[":
            embed = out and out[-1].endswith("!")
            end = end_of("page", r"\]\]", here + 2) - 2 if text.startswith("[[", here) else -1
            close = pair.get(here)
            target = _TARGET.match(text, close + 1) if close is not None else None
            if (end >= 0 or target) and embed:
                out[-1] = out[-1][:-1]
            if end >= 0:
                title, _, label = text[here + 2 : end].partition("|")
                out.append(label.strip() or title.strip() or " ")
                at = end + 2
            elif target:
                ends[close] = target.end() - close
            else:
                out.append(c)
        elif c == "]":
            out.append(c)
        else:
            length = len(re.compile(re.escape(c) + "+").match(text, here)[0])
            at = here + length
            within = c == "_" and here > 0 and text[here - 1].isalnum()
            opens = c == "`" or (at < len(text) and not text[at].isspace() and not within and (length == 2 if c == "~" else length <= 3))
            waiting = closers.get((c, length), [])
            while waiting and waiting[-1] <= here:
                waiting.pop()
            end = waiting[-1] if opens and waiting else None
            if end is None:
                out.append(text[here:at])
            elif c == "`":
                out.append(text[at:end])
                at = end + length
            else:
                ends[end] = length
    return "".join([*out, text[at:]])
