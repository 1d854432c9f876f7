"""Units of component sources (.tsx, .jsx): text, text attributes, class lists and copy in objects.

One map over files gives a row for each element; each row's texts, attributes and class list become units by one
projection, and what stands beside an element comes from windows over the children of one parent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import globs, inline, jsx
from proseloom.operators import tailwind
from proseloom.operators.units import unit_id

# Attributes that a reader sees or hears, and roles by tag and component.
ATTRIBUTES = ("aria-label", "aria-description", "placeholder", "title", "alt", "label", "description", "helperText", "errorMessage")
ROLES = {
    "a": "link", "button": "button", "caption": "caption", "figcaption": "caption", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "label": "label", "legend": "label",
    "li": "list-item", "option": "label", "p": "body", "span": "body", "summary": "heading", "td": "cell", "th": "heading",
    "Button": "button", "CardDescription": "body", "CardTitle": "heading", "DialogDescription": "body", "DialogTitle": "heading", "Label": "label", "Link": "link",
}
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "hellip": "…", "laquo": "«", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "middot": "·", "nbsp": " ", "ndash": "–", "quot": '"', "raquo": "»", "rdquo": "”", "rsquo": "’", "times": "×"}
_REGION = re.compile(r"(?:section|form|dialog|Card|Alert|Command|CommandDialog)$|.*(?:DialogContent|PopoverContent|MenuContent|MenuSubContent|SelectContent|\.Popup)$")
_REGION_ROLES = ("dialog", "alertdialog", "alert", "search", "listbox", "menu")

#: Characters of source in a batch of rows, and the columns that hold them.
BATCH_CHARS, _LONG = 4 << 20, ("opening", "parent_opening", "region", "text")
_ATTRIBUTE = "struct<name:string,text:string,line:long,column:long,start:long,end:long,inner_start:long,inner_end:long>"
SCHEMA = (
    "file string, element_no int, parent_no int, child_no int, element string, opening string, parent_opening string, region string, text string, dynamic boolean, line long, column long, start long, end long, fix_ranges array<struct<start:long,end:long>>, "
    f"attributes array<{_ATTRIBUTE}>, classes array<string>, class_dynamic boolean, interpolated boolean, class_line long, class_column long, class_start long, class_end long, copy_key string, parse_error string"
)


def decoded(text: str) -> str:
    """Numeric and the named character references that copy uses, once; others stay as written."""

    def one(match: re.Match) -> str:
        ref = match[1]
        if ref[0] != "#":
            return ENTITIES.get(ref, match[0])
        code = int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:])
        return chr(code) if code <= 0x10FFFF else match[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]+|#\d+|[A-Za-z][A-Za-z0-9]*);", one, text)


class _File:
    """What is worked out once for each element of a file."""

    def __init__(self, source: str):
        self.scan = jsx.Scanner(source)
        self.source, self.elements = source, self.scan.elements
        self.texts: dict[int, tuple | None] = {}
        # Inner elements have larger numbers, so each finds the texts of those inside it.
        for number in range(len(self.elements) - 1, -1, -1):
            self.texts[number] = self._direct(self.elements[number])
        self.moving = [False] * len(self.elements)
        for number in range(len(self.elements) - 1, -1, -1):
            pieces = self.elements[number].pieces
            self.moving[number] = any(self.moving[p.element] if p.element >= 0 else p.text is None and not p.empty for p in pieces)

    def _direct(self, element: jsx.Element) -> tuple[str, int, int, list[tuple[int, int]]] | None:
        """(text, start, end, fix ranges) of an element's own text, with that of inline children inside it."""
        text, start, end, inner, ranges = "", -1, -1, [], []
        for piece in element.pieces:
            if piece.text is not None:
                said = piece.text if piece.literal else decoded(piece.text)
                text += said
                if said.strip():
                    lead, trail = (0, 0) if piece.literal else (len(piece.text) - len(piece.text.lstrip()), len(piece.text) - len(piece.text.rstrip()))
                    first, last = piece.start + lead, piece.end - trail
                    start, end = first if start < 0 else start, last
                    if piece.fixable:
                        ranges.append((first, last))
            elif piece.element >= 0:
                found = self.texts[piece.element]
                if found:
                    text += found[0]
                    inner.append((piece.start, piece.end))
            else:
                text += " "
        text = inline.SPACE.sub(" ", text).strip()
        if not text or start < 0:
            return None
        return text, min([start, *(a for a, _ in inner)]), max([end, *(b for _, b in inner)]), ranges

    def region(self, number: int) -> str:
        """The source around an element that tells its task: the nearest section, form, dialog or the like, or what is two levels up."""
        at = fallback = number
        for depth in range(5):
            if depth <= 2:
                fallback = at
            element = self.elements[at]
            role = next((a.text for a in element.attributes if a.name == "role"), None)
            if element.name == "Empty":
                at = element.parent if element.parent >= 0 else at
                break
            if _REGION.match(element.name) or role in _REGION_ROLES or element.parent < 0:
                break
            at = element.parent
        else:
            at = fallback
        return self.source[self.elements[at].start : self.elements[at].end]


def _rows(file: str, source: str, around: bool, regions: bool) -> Iterator[dict]:
    try:
        made = _File(source)
    except (jsx.Broken, RecursionError) as wrong:
        yield {"file": file, "element_no": -1, "parse_error": str(wrong) or "nested too deeply", "line": 1, "column": 1, "start": 0, "end": len(source)}
        return
    starts, at = [0], source.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = source.find("\n", at + 1)

    def place(i: int, prefix: str = "") -> dict:
        line = bisect_right(starts, i)
        return {f"{prefix}line": line, f"{prefix}column": i - starts[line - 1] + 1, f"{prefix}start": i}

    def opening(number: int) -> str:
        return source[made.elements[number].start : made.elements[number].open_end]

    children: dict[int, int] = {}
    for number, e in enumerate(made.elements):
        row = {"file": file, "element_no": number, "parent_no": e.parent, "element": e.name or "fragment"}
        if around:
            row["opening"] = opening(number)
        if e.child and e.name:
            row["child_no"] = children[e.parent] = children.get(e.parent, 0) + 1
        text = made.texts[number]
        seen = [a for a in e.attributes if a.name in ATTRIBUTES and a.text and a.text.strip()]
        if regions and e.name and (text or seen):
            row["region"] = made.region(number)
        if text and e.name:
            row |= {"text": text[0], "dynamic": made.moving[number], "end": text[2], "fix_ranges": [{"start": a, "end": b} for a, b in text[3]], **place(text[1])}
        if e.skipped and "start" in row:
            # What is said to a log is no copy; its classes still are.
            row |= {"line": None, "start": None}
        row["attributes"] = [{"name": a.name, "text": inline.SPACE.sub(" ", a.text).strip(), "end": a.end, "inner_start": a.inner[0] if a.inner else None, "inner_end": a.inner[1] if a.inner else None, **place(a.start)} for a in seen]
        classed = next((a for a in e.attributes if a.name == "className"), None)
        if classed:
            found = jsx.class_names(classed.code)
            if found.names or found.interpolated:
                row |= {"classes": found.names, "class_dynamic": found.dynamic, "interpolated": found.interpolated, "class_end": classed.end, **place(classed.start, "class_")}
                if around and e.parent >= 0:
                    row["parent_opening"] = opening(e.parent)
        yield row
    for c in made.scan.copies:
        if text := inline.SPACE.sub(" ", c.text).strip():
            yield {"file": file, "element_no": -1, "copy_key": c.key, "text": text, "end": c.end, "fix_ranges": [{"start": c.start + 1, "end": c.end - 1}], **place(c.start)}


def element_rows(files: DataFrame, file_col: str = "file", text_col: str = "text", around: bool = True, regions: bool = True) -> DataFrame:
    """One row for each element of component sources, and for each text under a copy key or file that does not parse.

    A region is as long as the source around an element, so a file's regions together grow as the square of its length, and
    openings hold the elements in them: without ``around`` or ``regions`` these columns are null, for who reads neither.
    """

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in _rows(batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py() or "", around, regions):
                    rows.append(row)
                    held += sum(len(row.get(x) or "") for x in _LONG)
                    if len(rows) >= 2000 or held > BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(F.col(file_col), F.col(text_col)).mapInArrow(read, SCHEMA)


def _arrow() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attribute = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), *((x, pa.int64()) for x in ("line", "column", "start", "end", "inner_start", "inner_end"))]))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "fix_ranges": span, "attributes": attribute}
    names = [part.split(" ") for part in re.split(r", (?=\w+ \w)", SCHEMA)]
    return pa.schema([(name, kinds.get(kind) or kinds[name]) for name, kind in names])


_ARROW = _arrow()


def _role(element: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(known[element], F.when(element.rlike("^[a-z]"), "body").otherwise("unknown"))


def beside(elements: DataFrame) -> DataFrame:
    """Adds, to child elements, the text-bearing children before and after them (prev, next), and nearby: opening and text
    of up to two children on each side; of other elements these are null.  Windows over the children of a parent.

    What follows is what was last in falling order: a frame that ends with the group would be gone through for each row.
    """
    child = F.col("child_no").isNotNull()
    group = Window.partitionBy("file", "parent_no", child)
    order, back = group.orderBy("child_no"), group.orderBy(F.desc("child_no"))
    said = F.when(F.col("text").isNotNull(), F.struct("element", "text", "classes"))
    near = F.struct("opening", F.coalesce("text", F.lit("")).alias("text"))
    nearby = F.array_compact(F.array(*(F.lag(near, k).over(order) for k in (2, 1)), *(F.lead(near, k).over(order) for k in (1, 2))))
    before = lambda w: F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = elements.withColumns({"prev": before(order), "next": before(back), "nearby": nearby})
    return rows.withColumns({x: F.when(child, F.col(x)) for x in ("prev", "next", "nearby")})


#: Columns of a unit besides its id and doc type; those that a kind lacks are null.
_UNIT = {
    "file": "string", "element_no": "int", "kind": "string", "role": "string", "line": "long", "column": "long", "start": "long", "end": "long", "text": "string", "element": "string", "attr": "string", "dynamic": "boolean",
    "interpolated": "boolean", "classes": "array<string>", "fix_ranges": "array<struct<start:long,end:long>>", "section": "string", "next_text": "string", "next_classes": "array<string>", "parse_error": "string",
}
KINDS = ("jsx-text", "attr-string", "class-list", "file")


def _unit(kind: str, **columns: Column | str) -> Column:
    """A unit of a row as a struct; the row's file, number and element need not be given."""
    given = {"file": "file", "element_no": "element_no", "element": "element", "kind": F.lit(kind), "dynamic": F.lit(False), "interpolated": F.lit(False), **columns}
    of = lambda name: F.lit(None) if name not in given else F.col(given[name]) if isinstance(given[name], str) else given[name]
    return F.struct(*(of(name).cast(kind).alias(name) for name, kind in _UNIT.items()))


def component_units(files: DataFrame, file_col: str = "file", text_col: str = "text", doc_types: list[tuple[str, str]] = (("**", "ui"),), kinds: tuple[str, ...] = KINDS, context: bool = True) -> DataFrame:
    """Units of component sources: jsx-text, attr-string, class-list, and file for a source that does not parse.

    Texts are an element's own with that of inline children; ``dynamic`` ones hold values made at run time.  ``section`` is
    the source of the region around, of class lists a JSON object of the element, its parent and up to two children on
    each side; ``next_text`` and ``next_classes`` are of the next child with text.  Null and empty sources have no units.
    Each file is read once.  Only class lists' surroundings are met by file and parent, so the largest group is one parent's
    children.  ``kinds`` are those that are made; without ``context`` section, next_text and next_classes are null, and
    nothing is shuffled.
    """
    around = context and "class-list" in kinds
    rows = element_rows(files, file_col, text_col, around, context and not {"jsx-text", "attr-string"}.isdisjoint(kinds))
    a, role, made = F.col("a"), _role(F.col("element")), {}
    copied = F.col("copy_key").isNotNull()
    if around:
        rows = beside(rows)
    own = lambda when, unit: F.when(when, F.array(unit)).otherwise(F.array().cast(_UNITS))
    made["jsx-text"] = own(F.col("text").isNotNull() & F.col("start").isNotNull(), _unit("jsx-text", role=F.when(copied, "literal-copy").otherwise(role), line="line", column="column", start="start", end="end", text="text", attr="copy_key", dynamic=F.coalesce("dynamic", F.lit(False)), fix_ranges="fix_ranges", section="region"))

    def spoken(a: Column) -> Column:
        inner = F.when(a["inner_start"].isNotNull(), F.array(F.struct(a["inner_start"].alias("start"), a["inner_end"].alias("end")))).otherwise(F.array().cast(_UNIT["fix_ranges"]))
        how = F.when(a["name"] == "placeholder", "placeholder").when(a["name"].startswith("aria-"), "aria").otherwise("label")
        return _unit("attr-string", role=how, line=a["line"], column=a["column"], start=a["start"], end=a["end"], text=a["text"], attr=a["name"], fix_ranges=inner, section="region")

    made["attr-string"] = F.coalesce(F.transform("attributes", spoken), F.array().cast(_UNITS))
    given = {}
    if around:
        target = F.struct("opening", F.coalesce("text", F.lit("")).alias("text"), tailwind.literal_values(F.col("classes")).alias("candidates"))
        parent = F.when(F.col("parent_opening").isNotNull(), F.struct(F.col("parent_opening").alias("opening")))
        section = F.to_json(F.struct(F.coalesce("nearby", F.array().cast("array<struct<opening:string,text:string>>")).alias("nearby"), parent.alias("parent"), target.alias("target")))
        given = {"section": section, "next_text": F.col("next.text"), "next_classes": F.col("next.classes")}
    made["class-list"] = own(F.col("class_start").isNotNull(), _unit("class-list", role=role, line="class_line", column="class_column", start="class_start", end="class_end", text=F.coalesce("text", F.lit("")), dynamic="class_dynamic", interpolated="interpolated", classes="classes", **given))
    made["file"] = own(F.col("parse_error").isNotNull(), _unit("file", role=F.lit("unknown"), line="line", column="column", start="start", end="end", text=F.lit(""), parse_error="parse_error"))
    units = rows.select(F.explode(F.concat(*(made[kind] for kind in kinds))).alias("u")).select("u.*")
    return units.withColumn("unit_id", unit_id(F.col("file"), F.col("kind"), F.col("start"))).withColumn("doc_type", globs.first_match(F.col("file"), list(doc_types), "unknown"))


_UNITS = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in _UNIT.items()) + ">>"
