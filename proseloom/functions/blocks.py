"""Markdown blocks: one pass over lines with a stack of containers, every piece with its place in the source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from proseloom.functions.inline import BRACES, TAG, Tag, Unbalanced, _label

# The block constructs of Markdown.
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
ATX = re.compile(r"(#{1,6})(?=[ \t]|$)")
FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r"\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
NOTE = re.compile(r"\[(\^[^\]\s]+)\]:")
#: (start, end) of raw HTML; without an end it ends at a blank line.
HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (
        re.compile(
            r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe"
            r"|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
    ),
    (re.compile(r"(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$"), None),
)
_MODULE = re.compile(r"(?:import|export)\b")


class Block(NamedTuple):
    """A paragraph, heading, cell, component's tag, code or definition; ``parts`` are its lines as (place in the source, text).

    Code has the words after its fence as first part, a definition its address.
    """

    kind: str
    role: str
    level: int
    start: int
    end: int
    parts: list[tuple[int, str]]
    components: tuple[str, ...]
    tag: Tag | None = None


class _Container(NamedTuple):
    kind: str  # quote, item or note
    width: int = 0


def frontmatter_end(lines: list[str]) -> int:
    """Lines of the frontmatter, its fences included; 0 without one."""
    if lines and lines[0].lstrip("\ufeff").strip() == "---":
        for i, line in enumerate(lines[1:], 2):
            if line.strip() == "---":
                return i
    return 0


def _indent(line: str, i: int, column: int) -> tuple[int, int]:
    """Columns of white space from place i, and the place behind it; a tab goes to the next multiple of four."""
    at = column
    while i < len(line) and line[i] in " \t":
        at += 1 if line[i] == " " else 4 - at % 4
        i += 1
    return at - column, i


def _cells(line: str, place: int) -> list[tuple[int, int, int, str]]:
    """(start, end, place of the text, text) of a table row's cells; each starts at its bar."""
    bars = [m.start() for m in re.finditer(r"(?<!\\)\|", line)]
    body = line.rstrip()
    edges = [b for b in bars if b < len(body)]
    if not edges or edges[0] != 0:
        edges.insert(0, -1)
    last = edges.pop() if len(edges) > 1 and edges[-1] == len(body) - 1 else None
    out = []
    for k, edge in enumerate(edges):
        stop = edges[k + 1] if k + 1 < len(edges) else (last if last is not None else len(body))
        inner = line[edge + 1 : stop]
        lead = len(inner) - len(inner.lstrip())
        end = stop if k + 1 < len(edges) else len(body)
        out.append((place + max(edge, 0), place + end, place + edge + 1 + lead, inner.strip()))
    return out


class _Scanner:
    def __init__(self, source: str, mdx: bool):
        self.source, self.mdx = source, mdx
        self.stack: list[_Container] = []
        self.open: list[str] = []  # components
        self.paragraph: list[tuple[int, str]] = []
        self.fence: tuple[str, int, int] | None = None
        self.code: list[tuple[int, str]] = []
        self.html: tuple[re.Pattern | None, int] | None = None
        self.columns = 0
        self.labels: set[str] = set()
        self.out: list[Block] = []

    def role(self) -> str:
        return "list-item" if any(c.kind == "item" for c in self.stack) else "body"

    def emit(self, kind: str, role: str, start: int, end: int, parts: list[tuple[int, str]], level: int = 0, tag: Tag | None = None) -> None:
        if not any(c.kind == "note" for c in self.stack):
            self.out.append(Block(kind, role, level, start, end, parts, tuple(self.open), tag))

    def close_paragraph(self, level: int = 0, end: int | None = None) -> None:
        parts, self.paragraph = self.paragraph, []
        while parts and (match := DEFINITION.match(parts[0][1])):
            self.labels.add(_label(match[1]))
            place, address = parts[0][0], match[2] if match[2] is not None else match[3]
            self.emit("definition", "unknown", place, place + len(parts[0][1].rstrip()), [(place, address)])
            parts = parts[1:]
        if parts:
            place, text = parts[-1]
            parts = [*parts[:-1], (place, text.rstrip())]
            stop = end if end is not None else place + len(text.rstrip())
            self.emit("heading" if level else "paragraph", "heading" if level else self.role(), parts[0][0], stop, parts, level)

    def close(self, depth: int) -> None:
        """Ends the paragraph, table and containers above a depth."""
        self.close_paragraph()
        self.columns = 0
        del self.stack[depth:]

    def end_fence(self, end: int) -> None:
        self.emit("code", "unknown", self.code[0][0], end, self.code)
        self.fence = None

    def starts_block(self, rest: str, indent: int) -> bool:
        if indent >= 4:
            return False
        item = ITEM.match(rest)
        return bool(
            rest[:1] == ">"
            or ATX.match(rest)
            or FENCE.match(rest)
            or RULE.match(rest)
            or (item and rest[item.end() :].strip() and item[2] in (None, "1"))
            or (not self.mdx and any(start.match(rest) for start, _ in HTML[:6]))
        )

    def module(self, line: str) -> bool:
        return self.mdx and not self.stack and not self.paragraph and bool(_MODULE.match(line))

    def components(self, place: int, matched: int) -> int | None:
        """Flow tags and expressions from a place on, where they fill whole lines; the place behind them."""
        at, events = place, []
        while True:
            gap = re.compile(r"[ \t]*").match(self.source, at)
            at = gap.end()
            if at >= len(self.source) or self.source[at] == "\n":
                break
            match = TAG.match(self.source, at)
            if match:
                events.append(match)
            else:
                match = BRACES.match(self.source, at) if self.source[at] == "{" else None
                if not match:
                    return None
            at = match.end()
        # An element that opens and closes on one line is part of a paragraph.
        inner = [m for m in events if not m[4]]
        if len(inner) > 1 and any(m[1] for m in inner) and any(not m[1] for m in inner):
            return None
        self.close(matched)
        for match in events:
            name = match[2] or "fragment"
            if match[1]:
                if not self.open or self.open.pop() != name:
                    raise Unbalanced(name)
                continue
            self.emit("tag", "caption", match.start(), match.end(), [], tag=Tag(name, match[3], match.start(3), match.end()))
            if not match[4]:
                self.open.append(name)
        return at

    def line(self, place: int, line: str) -> int:
        """Takes a line; returns the place up to which the source is done."""
        i = matched = column = 0
        for container in self.stack:
            indent, j = _indent(line, i, column)
            if container.kind == "quote":
                if indent > 3 or line[j : j + 1] != ">":
                    break
                i, column = j + 1, column + indent + 1
                if line[i : i + 1] in (" ", "\t"):
                    i, column = i + 1, column + 1
            elif line[i:].strip():
                if indent < container.width:
                    break
                taken = 0
                while taken < container.width:
                    step = 1 if line[i] == " " else 4 - (column + taken) % 4
                    i, taken = i + 1, taken + step
                column += taken
            matched += 1
        blank = not line[i:].strip()
        if self.fence:
            char, size, depth = self.fence
            if matched >= depth:
                _, j = _indent(line, i, column)
                rest = line[j:].rstrip()
                if rest and set(rest) == {char} and len(rest) >= size:
                    self.end_fence(place + len(line))
                else:
                    self.code.append((place + i, line[i:]))
                return place + len(line)
            self.end_fence(place - 1)
        if self.html:
            end, depth = self.html
            if matched >= depth and not (end is None and blank):
                if end and end.search(line, i):
                    self.html = None
                return place + len(line)
            self.html = None
        if blank:
            self.close_paragraph()
            self.columns = 0
            if matched < len(self.stack):
                self.close(matched)
            return place + len(line)
        while True:
            behind = matched < len(self.stack)
            indent, j = _indent(line, i, column)
            rest = line[j:]
            if indent >= 4 and not self.mdx and not self.paragraph:
                self.close(matched)
                return place + len(line)
            if indent >= 4 and not self.mdx:
                break
            if rest[:1] == ">":
                self.close(matched)
                self.stack.append(_Container("quote"))
                i, column = j + 1, column + indent + 1
                if line[i : i + 1] in (" ", "\t"):
                    i, column = i + 1, column + 1
                matched = len(self.stack)
                continue
            note = NOTE.match(rest)
            if note and not (self.paragraph and not behind):
                self.labels.add(_label(note[1]))
                self.close(matched)
                self.stack.append(_Container("note", 4))
                matched, i, column = len(self.stack), j + note.end(), column + indent + note.end()
                continue
            if self.paragraph and not behind and SETEXT.match(rest):
                self.close_paragraph(1 if rest[0] == "=" else 2, place + j + len(rest.rstrip()))
                return place + len(line)
            item = None if RULE.match(rest) else ITEM.match(rest)
            if item and self.paragraph and not behind and (not rest[item.end() :].strip() or item[2] not in (None, "1")):
                item = None
            if not item:
                break
            self.close(matched)
            i, column = j + item.end(), column + indent + item.end()
            spaces, j = _indent(line, i, column)
            taken = 1 if spaces > 4 or j >= len(line) else spaces
            self.stack.append(_Container("item", indent + item.end() + taken))
            i, column = (i + 1, column + 1) if spaces > 4 else (j, column + spaces)
            matched = len(self.stack)
            if not line[i:].strip():
                return place + len(line)
        return self.leaf(place, line, matched, j, indent, rest)

    def leaf(self, place: int, line: str, matched: int, j: int, indent: int, rest: str) -> int:
        behind, done = matched < len(self.stack), place + len(line)
        if indent < 4 or self.mdx:
            if match := ATX.match(rest):
                self.close(matched)
                inner = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", rest[match.end() :])
                lead = len(inner) - len(inner.lstrip())
                at = place + j + match.end() + lead
                self.emit("heading", "heading", place + j, place + j + len(rest.rstrip()), [(at, inner.strip())], len(match[1]))
                return done
            if match := FENCE.match(rest):
                self.close(matched)
                self.fence = (match[1][0], len(match[1]), matched)
                self.code = [(place + j, rest[match.end() :].strip())]
                return done
            if RULE.match(rest):
                self.close(matched)
                return done
            if self.mdx and rest[0] in "<{":
                end = self.components(place + j, matched)
                if end is not None:
                    return end
            if not self.mdx:
                for start, end in HTML[: 6 if self.paragraph else 7]:
                    if start.match(rest):
                        self.close(matched)
                        if not (end and end.search(rest)):
                            self.html = (end, matched)
                        return done
        if self.columns and not behind:
            for start, end, at, text in _cells(rest, place + j)[: self.columns]:
                self.emit("cell", "cell", start, end, [(at, text)])
            return done
        if len(self.paragraph) == 1 and not behind and "|" in self.paragraph[0][1] and DELIMITERS.match(rest):
            head, size = self.paragraph[0], len(_cells(rest, 0))
            cells = _cells(head[1], head[0])
            if len(cells) == size:
                self.paragraph, self.columns = [], size
                for start, end, at, text in cells:
                    self.emit("cell", "cell", start, end, [(at, text)])
                return done
        if not self.paragraph or (behind and self.columns):
            self.close(matched)
        self.paragraph.append((place + j, rest))
        return done


def blocks(source: str, mdx: bool = False) -> tuple[Iterator[Block], frozenset[str]]:
    """The blocks of a Markdown text in order, and the labels that links and notes may name.

    Raw HTML, rules, notes, modules and frontmatter have no blocks.  With ``mdx`` components' tags are
    blocks, and ``Unbalanced`` is raised where one does not close.  A tab that a container's edge cuts counts whole.
    """
    scan, place, done = _Scanner(source, mdx), 0, 0
    lines = source.split("\n")
    skip, module = frontmatter_end(lines), False
    for number, line in enumerate(lines):
        line, size = line.removesuffix("\r"), len(line) + 1
        if place >= done and number >= skip:
            if number == 0 and line.startswith("\ufeff"):
                line = " " + line[1:]
            module = (module or scan.module(line)) and bool(line.strip())
            if not module:
                done = scan.line(place, line)
        place += size
    if scan.fence:
        scan.end_fence(len(source))
    scan.close(0)
    if scan.open:
        raise Unbalanced(scan.open[-1])
    return iter(scan.out), frozenset(scan.labels)
