"""Elements, their attributes and text, and copy in objects, out of component sources: one pass with a nesting stack."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

# Names that decide what is copy and what are classes.
COPY_KEYS = ("message", "title", "description", "label", "placeholder", "error", "hint", "cta", "what", "fix", "summary")
CLASS_FUNCTIONS = ("cn", "clsx", "cva", "twMerge", "classNames", "tw")
SKIPPED_CALLS = ("console", "Sentry", "logger", "log", "t", "i18n", "invariant", "assert")

_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.:-][\w$]+)*")
_ATTRIBUTE = re.compile(r"\s*([A-Za-z_$][\w$]*(?:[:-][\w$]+)*)")
#: What may stand before an element or a regular expression, as both begin like operators.
_BEFORE_VALUE = re.compile(r"(?:^|[(\[{,;=?:&|!>}]|=>|\b(?:return|default|case|yield|await|typeof|in|of))\s*$")
_CALLEE = re.compile(r"([A-Za-z_$][\w$]*)(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*\s*$")
_THROWN = re.compile(r"\bthrow\s+[\w$.\s]*$")
_KEY = re.compile(r"(?:([A-Za-z_$][\w$]*)|[\"']([\w$-]+)[\"'])\s*:\s*$")
_STATIC = re.compile(r"\s*(?:\(\s*)*(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`)\s*(?:(?:as|satisfies)\s+[\w$.<>\[\]\s|\"']+)?(?:\)\s*)*$")
_ESCAPE = re.compile(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r?\n|.)", re.S)
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


class Broken(ValueError):
    """A source that does not parse."""


class Piece(NamedTuple):
    """A child of an element: text with its source place, the number of an element, or neither (a value made at run time).

    ``literal`` text comes from a string in braces, and may be fixed where that has quotes; ``empty`` braces hold nothing.
    """

    text: str | None
    start: int
    end: int
    element: int = -1
    literal: bool = False
    fixable: bool = True
    empty: bool = False


class Attribute(NamedTuple):
    """``text`` is null where the value is made at run time; ``inner`` is the place between its quotes."""

    name: str
    text: str | None
    start: int
    end: int
    inner: tuple[int, int] | None
    code: str


@dataclass
class Element:
    name: str
    parent: int
    start: int
    open_end: int = 0
    end: int = 0
    skipped: bool = False
    child: bool = True
    attributes: list[Attribute] = field(default_factory=list)
    pieces: list[Piece] = field(default_factory=list)


class Copy(NamedTuple):
    key: str
    text: str
    start: int
    end: int


def unescaped(body: str) -> str:
    def one(match: re.Match) -> str:
        x = match[1]
        if x[0] == "u" or x[0] == "x":
            return chr(int(x.strip("ux{}"), 16)) if len(x) > 1 else x
        return "" if x[-1] == "\n" else _LETTERS.get(x, x)

    return _ESCAPE.sub(one, body)


def static_text(code: str) -> tuple[str, int, int] | None:
    """(text, start, end) of a string, a cast one or a template without values; the places are those of its inside."""
    match = _STATIC.match(code)
    return (unescaped(match[1][1:-1]), match.start(1) + 1, match.end(1) - 1) if match else None


class Scanner:
    def __init__(self, source: str):
        self.source, self.n = source, len(source)
        self.elements: list[Element] = []
        self.copies: list[Copy] = []
        self.script(0, "", -1, False)

    def string(self, i: int) -> int:
        match = re.compile(r"\"(?:[^\"\\\n]|\\.|\\\n)*\"|'(?:[^'\\\n]|\\.|\\\n)*'").match(self.source, i)
        if not match:
            raise Broken(f"unterminated string at {i}")
        return match.end()

    def template(self, i: int, parent: int, skipped: bool) -> int:
        i += 1
        while i < self.n:
            c = self.source[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif self.source.startswith("${", i):
                i = self.script(i + 2, "}", parent, skipped)
            else:
                i += 1
        raise Broken("unterminated template")

    def script(self, i: int, closing: str, parent: int, skipped: bool) -> int:
        """Reads script up to its closing mark; elements in it belong to ``parent``.  Returns the place behind the mark."""
        source, skips, depth = self.source, [skipped], []
        last = i
        while i < self.n:
            c = source[i]
            if c in "\"'":
                end = self.string(i)
                key = _KEY.search(source, max(0, i - 80), i)
                after = re.compile(r"\s*(.?)").match(source, end)[1]
                name = key and (key[1] or key[2])
                if name in COPY_KEYS and not skips[-1] and after in ("", ",", "}") and re.search(r"[{,]\s*$", source[max(0, key.start() - 80) : key.start()]):
                    self.copies.append(Copy(name, unescaped(source[i + 1 : end - 1]), i, end))
                i = last = end
            elif c == "`":
                i = last = self.template(i, parent, skips[-1])
            elif source.startswith("//", i):
                i = source.find("\n", i)
                i = self.n if i < 0 else i
            elif source.startswith("/*", i):
                end = source.find("*/", i + 2)
                if end < 0:
                    raise Broken("unterminated comment")
                i = end + 2
            elif c == "/" and _BEFORE_VALUE.search(source, max(0, last - 40), i):
                match = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(source, i)
                i = last = match.end() if match else i + 1
            elif c == "<" and self.opens(i, last):
                i = last = self.element(i, parent, skips[-1], False)[0]
            elif c in "([{":
                skip = skips[-1]
                if c == "(":
                    callee = _CALLEE.search(source, max(0, i - 120), i)
                    skip = skip or bool(callee and callee[1] in SKIPPED_CALLS) or bool(_THROWN.search(source, max(0, i - 120), i))
                skips.append(skip)
                depth.append({"(": ")", "[": "]", "{": "}"}[c])
                i += 1
                last = i
            elif c in ")]}":
                if not depth:
                    if c == closing:
                        return i + 1
                    raise Broken(f"unexpected {c} at {i}")
                if depth.pop() != c:
                    raise Broken(f"unexpected {c} at {i}")
                skips.pop()
                i += 1
                last = i
            else:
                i += 1
                if not c.isspace():
                    last = i
        if closing or depth:
            raise Broken(f"missing {depth[-1] if depth else closing}")
        return i

    def opens(self, i: int, last: int) -> bool:
        """Whether a ``<`` in script opens an element: a value may stand there, and no type parameter follows."""
        if not _BEFORE_VALUE.search(self.source, max(0, last - 40), i):
            return False
        match = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*)(\s*,|\s+extends\b)?)").match(self.source, i)
        return bool(match) and not match[2]

    def element(self, i: int, parent: int, skipped: bool, child: bool) -> tuple[int, int]:
        """Reads an element or fragment; returns the place behind it and its number."""
        source, number = self.source, len(self.elements)
        name = _NAME.match(source, i + 1)
        element = Element(name[0] if name else "", parent, i, skipped=skipped, child=child)
        self.elements.append(element)
        i = name.end() if name else i + 1
        if name and source[i : i + 1] == "<":
            i = source.find(">", i) + 1 or self.n
        while True:
            gap = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*\n)*").match(source, i)
            i = gap.end()
            if i >= self.n:
                raise Broken(f"unterminated <{element.name}>")
            if source.startswith("/>", i):
                element.open_end = element.end = i + 2
                return i + 2, number
            if source[i] == ">":
                element.open_end = i + 1
                return self.children(i + 1, number, skipped), number
            if source[i] == "{":
                i = self.script(i + 1, "}", number, skipped)
                continue
            match = _ATTRIBUTE.match(source, i)
            if not match:
                raise Broken(f"unexpected {source[i]} in <{element.name}>")
            i = self.attribute(match, element, number, skipped)

    def attribute(self, match: re.Match, element: Element, number: int, skipped: bool) -> int:
        source, start, i = self.source, match.start(1), match.end()
        value = re.compile(r"\s*=\s*").match(source, i)
        if not value:
            element.attributes.append(Attribute(match[1], None, start, i, None, ""))
            return i
        i = value.end()
        if source[i : i + 1] in ('"', "'"):
            end = source.find(source[i], i + 1) + 1
            if not end:
                raise Broken(f"unterminated value of {match[1]}")
            element.attributes.append(Attribute(match[1], source[i + 1 : end - 1], start, end, (i + 1, end - 1), source[i:end]))
            return end
        if source[i : i + 1] == "{":
            end = self.script(i + 1, "}", number, skipped)
            code = source[i + 1 : end - 1]
            found = static_text(code)
            quoted = found and source[i + found[1]] != "`"
            element.attributes.append(Attribute(match[1], found[0] if found else None, start, end, (i + 1 + found[1], i + 1 + found[2]) if quoted else None, code))
            return end
        if source[i : i + 1] == "<":
            end, _ = self.element(i, number, skipped, False)
            element.attributes.append(Attribute(match[1], None, start, end, None, source[i:end]))
            return end
        raise Broken(f"no value of {match[1]}")

    def children(self, i: int, number: int, skipped: bool) -> int:
        source, element = self.source, self.elements[number]
        while True:
            match = re.compile(r"[^<{]*").match(source, i)
            if match[0]:
                element.pieces.append(Piece(match[0], i, match.end()))
            i = match.end()
            if i >= self.n:
                raise Broken(f"unterminated <{element.name}>")
            if source[i] == "{":
                end = self.script(i + 1, "}", number, skipped)
                found = static_text(source[i + 1 : end - 1])
                bare = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", source[i + 1 : end - 1]).strip()
                if found:
                    quoted = source[i + found[1]] != "`"
                    place = (i + 1 + found[1], i + 1 + found[2]) if quoted else (i, end)
                    element.pieces.append(Piece(found[0], *place, literal=True, fixable=quoted))
                else:
                    element.pieces.append(Piece(None, i, end, empty=not bare))
                i = end
                continue
            closing = re.compile(r"</\s*([\w$.:-]*)\s*>").match(source, i)
            if closing:
                if closing[1] != element.name:
                    raise Broken(f"</{closing[1]}> closes <{element.name}>")
                element.end = closing.end()
                return closing.end()
            end, inner = self.element(i, number, skipped, True)
            element.pieces.append(Piece(None, i, end, inner))
            i = end


class Classes(NamedTuple):
    names: list[str]
    dynamic: bool = False
    interpolated: bool = False


def _parts(code: str) -> list[str]:
    """Arguments of a call, cut at commas outside brackets, strings and templates."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(code):
        c = code[i]
        if c in "\"'`":
            end = i + 1
            while end < len(code) and code[end] != c:
                end += 2 if code[end] == "\\" else 1
            i = end
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(code[at:i])
            at = i + 1
        i += 1
    return [x for x in [*out, code[at:]] if x.strip()]


def class_names(code: str) -> Classes:
    """The class names that an attribute's code fixes: of a string, a template's whole words, or a class function's arguments."""
    code = code.strip()
    found = static_text(code)
    if found:
        return Classes(found[0].split())
    if code[:1] == "`" and code[-1:] == "`":
        names: list[str] = []
        quasis = re.split(r"\$\{(?:[^{}]|\{[^{}]*\})*\}", code[1:-1])
        for i, quasi in enumerate(quasis):
            words = unescaped(quasi).split()
            # A word that touches a value is a piece of a name.
            if i + 1 < len(quasis) and words and not quasi[-1:].isspace():
                words.pop()
            if i and words and not quasi[:1].isspace():
                words.pop(0)
            names += words
        return Classes(names, True, True)
    call = re.match(r"(?:[\w$]+\s*\.\s*)*([\w$]+)\s*\(", code)
    if not call or call[1] not in CLASS_FUNCTIONS or code[-1] != ")":
        return Classes([], True)
    names, dynamic, interpolated = [], False, False
    for part in _parts(code[call.end() : -1]):
        inner = class_names(part)
        names += inner.names
        dynamic, interpolated = dynamic or inner.dynamic, interpolated or inner.interpolated
    return Classes(names, dynamic, interpolated)
