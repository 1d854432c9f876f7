"""Inline Markdown to plain text, with the spans that came from code and the places in the source that are prose."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from typing import NamedTuple

# The inline constructs of Markdown.
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9][\w.-]*)>")
RAW_HTML = re.compile(r"<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--(?:>|->|[\s\S]*?--)|\?[\s\S]*?\?|![A-Za-z][^>]*|!\[CDATA\[[\s\S]*?\]\])>")
TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
#: A component's tag: closing mark, name, attributes, mark of an empty element.
TAG = re.compile(r"<(/?)\s*([A-Za-z_$][\w.:$-]*)?((?:\s+[A-Za-z_$][\w.:$-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?|\s*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\s*(/?)>")
BRACES = re.compile(r"\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}")
ATTRIBUTE = re.compile(r"\s([A-Za-z_$][\w.:$-]*)\s*=\s*(\"[^\"]*\"|'[^']*')")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: White space that is more than one space: single spaces are not replaced by themselves.
_WIDE = re.compile(r" [ \t\n\r\f\v]+|[\t\n\r\f\v][ \t\n\r\f\v]*")

_SPECIAL = re.compile(r"[\\&`<\[\]!*_~{]")


class Unbalanced(ValueError):
    """Components or expressions of an MDX text that do not close."""


class Source(NamedTuple):
    """Text joined from pieces of a source, with the place of each piece in both."""

    text: str
    starts: list[int]
    places: list[int]

    @classmethod
    def of(cls, parts: list[tuple[int, str]]) -> Source:
        starts, at = [], 0
        for _, text in parts:
            starts.append(at)
            at += len(text) + 1
        return cls("\n".join(t for _, t in parts), starts, [p for p, _ in parts])

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]


class Tag(NamedTuple):
    name: str
    attributes: str
    start: int
    end: int


class Rendered(NamedTuple):
    """``nodes`` are links, images and code, as (kind, address or code, start, end) in the source."""

    text: str
    code_spans: list[tuple[int, int]]
    fix_ranges: list[tuple[int, int]]
    tags: list[Tag]
    nodes: list[tuple[str, str, int, int]]


def _flanks(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of delimiters can open and can close."""
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    mark = lambda c: not c.isalnum() and not c.isspace()
    left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
    right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
    if text[start] == "_":
        return left and (not right or mark(before)), right and (not left or mark(after))
    return left, right


class _Run:
    """A run of delimiters in the output: how many are left, what it may do."""

    __slots__ = ("at", "char", "closes", "left", "opens", "size")

    def __init__(self, at: int, text: str, start: int, end: int):
        self.at, self.char, self.size = at, text[start], end - start
        self.left = self.size
        self.opens, self.closes = _flanks(text, start, end)


def _pair(runs: list[_Run]) -> None:
    """Takes out of each run the delimiters that pair; the rest are letters."""
    floor: dict[tuple, int] = {}
    i = 0
    while i < len(runs):
        closer = runs[i]
        if not closer.closes or not closer.left:
            i += 1
            continue
        key = (closer.char, closer.opens, closer.size % 3)
        j = i - 1
        while j >= floor.get(key, 0):
            opener = runs[j]
            odd = (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
            if opener.left and opener.opens and opener.char == closer.char and not odd and (closer.char != "~" or opener.size == closer.size):
                break
            j -= 1
        if j < floor.get(key, 0):
            floor[key] = i
            i += 1
            continue
        used = closer.left if closer.char == "~" else 2 if opener.left >= 2 and closer.left >= 2 else 1
        opener.left -= used
        closer.left -= used
        for between in runs[j + 1 : i]:
            between.opens = False


def render(source: Source, labels: frozenset[str] = frozenset(), mdx: bool = False) -> Rendered:
    """The text a reader sees, white space collapsed: links and emphasis keep their text; images, raw HTML, components'
    tags, expressions and footnote marks go.  Code spans are (start, end) in that text; fix ranges are source ranges of
    prose, and of MDX every opening tag is listed."""
    text, i, n = source.text, 0, len(source.text)
    out: list[tuple[str, int, int, bool]] = []  # text, source start and end in ``text``, from code
    runs: list[_Run] = []
    brackets: list[tuple[int, bool, int, int]] = []  # output place, image, place after the bracket, runs before
    tags: list[Tag] = []
    nodes: list[tuple[str, str, int, int]] = []
    opened: list[str] = []
    absent: set[int] = set()

    def node(kind: str, value: str, start: int, end: int) -> None:
        nodes.append((kind, value, source.place(start), source.place(end - 1) + 1))

    def put(piece: str, start: int, end: int) -> None:
        if piece:
            out.append((piece, start, end, False))

    while i < n:
        found = _SPECIAL.search(text, i)
        if not found:
            put(text[i:], i, n)
            break
        at = found.start()
        put(text[i:at], i, at)
        i, c = at, text[at]
        if c == "\\":
            match = ESCAPE.match(text, i)
            if match:
                put(match[1], i, i + 2)
                i += 2
            else:
                put("" if text[i + 1 : i + 2] == "\n" else c, i, i + 1)
                i += 1
            continue
        if c == "&" and (match := ENTITY.match(text, i)):
            put(html.unescape(match[0]), i, match.end())
            i = match.end()
            continue
        if c == "`":
            end = i
            while end < n and text[end] == "`":
                end += 1
            size, close = end - i, None
            if size not in absent:
                close = re.compile(rf"(?<!`)`{{{size}}}(?!`)").search(text, end)
            if not close:
                absent.add(size)
                put(text[i:end], i, end)
                i = end
                continue
            inner = text[end : close.start()].replace("\n", " ")
            lead = 1 if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip(" ") else 0
            out.append((inner[lead : len(inner) - lead], end + lead, close.start() - lead, True))
            node("inlineCode", inner[lead : len(inner) - lead], i, close.end())
            i = close.end()
            continue
        if c == "<":
            if mdx and (match := TAG.match(text, i)):
                name = match[2] or "fragment"
                if match[1]:
                    if not opened or opened.pop() != name:
                        raise Unbalanced(name)
                else:
                    tags.append(Tag(name, match[3], match.start(3), match.end()))
                    if not match[4]:
                        opened.append(name)
                i = match.end()
                continue
            if mdx:
                raise Unbalanced("<")
            if match := AUTOLINK.match(text, i):
                node("link", match[1], i, match.end())
                put(match[1], match.start(1), match.end(1))
                i = match.end()
                continue
            if match := RAW_HTML.match(text, i):
                i = match.end()
                continue
        if c == "{" and mdx:
            match = BRACES.match(text, i)
            if not match:
                raise Unbalanced("{")
            i = match.end()
            continue
        if c in "*_~":
            end = i
            while end < n and text[end] == c:
                end += 1
            if c != "~" or end - i <= 2:
                runs.append(_Run(len(out), text, i, end))
            put(text[i:end], i, end)
            i = end
            continue
        if c == "[" or (c == "!" and text[i + 1 : i + 2] == "["):
            image = c == "!"
            note = None if image else LABEL.match(text, i)
            if note and note[1].startswith("^") and _label(note[1]) in labels:
                i = note.end()
                continue
            brackets.append((len(out), image, i + 1 + image, len(runs)))
            put(text[i : i + 1 + image], i, i + 1 + image)
            i += 1 + image
            continue
        if c == "]" and brackets:
            place, image, inside, before = brackets.pop()
            target = TARGET.match(text, i + 1) if place >= 0 else None
            end = target.end() if target else None
            if place >= 0 and not end:
                name = LABEL.match(text, i + 1)
                if name and name[1] and _label(name[1]) in labels:
                    end = name.end()
                elif _label(text[inside:i]) in labels and not (name and name[1]):
                    end = name.end() if name else i + 1
            if end:
                if target:
                    node("image" if image else "link", _address(target[0]), inside - 1 - image, end)
                _pair(runs[before:])
                for run in runs[before:]:
                    run.opens = run.closes = False
                if image:
                    # An image is not read.
                    out[place:] = []
                    del runs[before:]
                else:
                    out[place] = ("", 0, 0, False)
                    # No link inside a link.
                    brackets = [b if b[1] else (-1, False, b[2], b[3]) for b in brackets]
                i = end
                continue
        put(c, i, i + 1)
        i += 1
    if opened:
        raise Unbalanced(opened[-1])
    _pair(runs)
    for run in runs:
        if run.left < run.size:
            piece = out[run.at]
            out[run.at] = (piece[0][: run.left], piece[1], piece[1] + run.left, False)
    return _collapsed(out, source, tags, nodes)


def _address(target: str) -> str:
    """The address of a link's target, without brackets, title and escapes."""
    found = re.match(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))", target)
    return html.unescape(ESCAPE.sub(r"\1", found[1] if found[1] is not None else found[2]))


def _label(text: str) -> str:
    return SPACE.sub(" ", text).strip().casefold()


def _collapsed(out: list[tuple[str, int, int, bool]], source: Source, tags: list[Tag], nodes: list[tuple[str, str, int, int]]) -> Rendered:
    """Joins the pieces with one space for each run of white space, spans following their letters."""
    made: list[str] = []
    size, pending, spans, ranges = 0, False, [], []
    for piece, start, end, code in out:
        if not piece:
            continue
        begin, words = None, piece.strip(" \t\n\r\f\v")
        if not words or piece[0] != words[0]:
            pending = size > 0
        if words:
            if pending:
                made.append(" ")
                size += 1
            begin, words, pending = size, _WIDE.sub(" ", words), piece[-1] != words[-1]
            made.append(words)
            size += len(words)
        if code:
            if begin is not None:
                spans.append((begin, size))
            continue
        first, last, seen = source.place(start), source.place(end - 1) + 1, begin is not None
        if ranges and ranges[-1][1] == first:
            first, _, before = ranges.pop()
            seen = seen or before
        ranges.append((first, last, seen))
    return Rendered("".join(made), spans, [(a, b) for a, b, seen in ranges if seen], tags, nodes)
