"""Units of Markdown and MDX files: headings, paragraphs, list items, cells and components' text attributes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import globs, inline
from proseloom.functions.blocks import Block, blocks
from proseloom.operators.units import DOC_TYPES, unit_id

#: Fixed value: attributes of components whose text a reader sees.
ATTRIBUTES = ("title", "caption", "label", "alt", "description", "placeholder")
#: Characters of a heading that units below it carry.
HEADING_CHARS = 120

_SPAN = "array<struct<start:long,end:long>>"
SCHEMA = (
    "file string, seq long, kind string, role string, level int, section_no long, line long, column long, end_line long, end_column long, start long, end long, "
    f"text string, code_spans {_SPAN}, fix_ranges {_SPAN}, heading_above string, component string, attr string, mdx_fallback boolean"
)
_NAMES = [x.split()[0] for x in SCHEMA.replace("struct<start:long,end:long>", "s").split(", ")]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<s>": _ARROW_SPANS}
_TYPES = [_ARROW[x.split()[1]] for x in SCHEMA.replace("struct<start:long,end:long>", "s").split(", ")]


def _attributes(tag: inline.Tag) -> Iterator[tuple[str, str, int, int, tuple[int, int] | None]]:
    """(name, text, start, end, inside of the quotes) of a tag's text attributes; places count from the tag's first attribute."""
    for match in inline.ATTRIBUTE.finditer(tag.attributes):
        if match[1] in ATTRIBUTES:
            inside = (match.start(2) + 1, match.end(2) - 1)
            yield match[1], inline.SPACE.sub(" ", match[2][1:-1]).strip(), match.start(1), match.end(2), inside if inside[0] < inside[1] else None


def _drafts(block: Block, labels: frozenset[str], mdx: bool, skip: frozenset[str], unwrap: frozenset[str]) -> Iterator[tuple]:
    """(kind, role, level, start, end, text, code spans, fix ranges, component, attribute) of a block."""
    if block.kind in ("code", "definition") or skip.intersection(block.components):
        return
    named = [c for c in block.components if c not in unwrap]
    component = named[-1] if named else None

    def attributes(tag: inline.Tag, place, owner: str) -> Iterator[tuple]:
        for name, text, start, end, inside in _attributes(tag):
            if text:
                ranges = [(place(tag.start + inside[0]), place(tag.start + inside[1] - 1) + 1)] if inside else []
                yield "attr-string", "caption", 0, place(tag.start + start), place(tag.start + end - 1) + 1, text, [], ranges, owner, name

    if block.tag:
        if block.tag.name not in skip:
            yield from attributes(block.tag, lambda i: i, block.tag.name)
        return
    source = inline.Source.of(block.parts)
    made = inline.render(source, labels, mdx)
    for tag in made.tags:
        if tag.name not in skip:
            yield from attributes(tag, source.place, component or tag.name)
    if made.text:
        kind = "paragraph" if block.kind == "cell" else block.kind
        yield kind, block.role, block.level, block.start, block.end, made.text, made.code_spans, made.fix_ranges, component, None


def _line_starts(source: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", source))]


def _parsed(file: str, source: str) -> tuple[list[Block], frozenset[str], bool]:
    """The blocks and labels of a file, and whether MDX had to be read as Markdown."""
    if file.endswith(".mdx"):
        try:
            found, labels = blocks(source, True)
            return list(found), labels, False
        except inline.Unbalanced:
            found, labels = blocks(source)
            return list(found), labels, True
    found, labels = blocks(source)
    return list(found), labels, False


def _node_rows(file: str, source: str) -> list[tuple]:
    parsed, labels, fallback = _parsed(file, source)
    mdx, rows = file.endswith(".mdx") and not fallback, []
    for block in parsed:
        if block.kind == "code":
            info = block.parts[0][1].split()
            rows.append(("code", "\n".join(t for _, t in block.parts[1:]), info[0] if info else None, block.start, block.end))
        elif block.kind == "definition":
            rows.append(("definition", block.parts[0][1], None, block.start, block.end))
        elif not block.tag:
            try:
                found = inline.render(inline.Source.of(block.parts), labels, mdx).nodes
            except inline.Unbalanced:
                found = inline.render(inline.Source.of(block.parts), labels).nodes
            rows += [(kind, value, None, start, end) for kind, value, start, end in found]
    starts = _line_starts(source)
    return [(file, *row, bisect_right(starts, row[3])) for row in sorted(rows, key=lambda r: r[3])]


def document_nodes(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, node, value, lang, start, end, line): links, images and definitions with their address, code and inline code
    with its text, of Markdown files.  Null and empty texts have none."""

    def read(batches):
        for batch in batches:
            rows = [r for i in range(batch.num_rows) for r in _node_rows(batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py() or "")]
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file", "node", "value", "lang", "start", "end", "line"])

    return files.select(F.col(file_col), F.col(text_col)).mapInArrow(read, "file string, node string, value string, lang string, start long, end long, line long")


def _file_rows(file: str, source: str, skip: frozenset[str], unwrap: frozenset[str]) -> list[tuple]:
    parsed, labels, fallback = _parsed(file, source)
    mdx = file.endswith(".mdx") and not fallback
    try:
        drafts = [d for b in parsed for d in _drafts(b, labels, mdx, skip, unwrap)]
    except inline.Unbalanced:
        fallback = True
        parsed, labels = blocks(source)
        drafts = [d for b in parsed for d in _drafts(b, labels, False, skip, unwrap)]
    starts = _line_starts(source)

    def position(place: int) -> tuple[int, int]:
        line = bisect_right(starts, place)
        return line, place - starts[line - 1] + 1

    rows, heading, section = [], None, 0
    for seq, (kind, role, level, start, end, text, spans, ranges, component, attr) in enumerate(drafts):
        section += kind == "heading"
        rows.append((file, seq, kind, role, level, section, *position(start), *position(end), start, end, text, spans, ranges, heading, component, attr, fallback))
        if kind == "heading":
            heading = text[:HEADING_CHARS]
    return rows


def markdown_units(files: DataFrame, file_col: str = "file", text_col: str = "text", doc_types: list[tuple[str, str]] = DOC_TYPES, skip: tuple[str, ...] = (), unwrap: tuple[str, ...] = ()) -> DataFrame:
    """Units of Markdown files (.mdx: with components), in one map over the scan.

    Each heading, paragraph, list item's paragraph and table cell is a unit with its rendered text, the code spans in it,
    the source ranges that a fix may change, line, column and source span (code points), the heading above and the number
    of its section in the file; each text attribute of a component is a unit too.  ``skip`` are components that are not
    read, ``unwrap`` those whose content belongs to what is around them.  MDX that does not close is read as Markdown and
    marked.  Null and empty texts have no units; a null file name counts as "".  Repeated files give their units again.
    """
    passed, opened = frozenset(skip), frozenset(unwrap)

    def extract(batches):
        for batch in batches:
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                rows += _file_rows(batch.column(0)[row].as_py() or "", batch.column(1)[row].as_py() or "", passed, opened)
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    made = files.select(F.col(file_col), F.col(text_col)).mapInArrow(extract, SCHEMA)
    return made.withColumn("unit_id", unit_id(F.col("file"), F.col("kind"), F.col("start"))).withColumn("doc_type", globs.first_match(F.col("file"), doc_types, "unknown"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    spans = lambda values: [[{"start": a, "end": b} for a, b in v] for v in values]
    return pa.RecordBatch.from_arrays([pa.array(spans(c) if t is _ARROW_SPANS else list(c), t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def sections(units: DataFrame) -> DataFrame:
    """(file, section_no, section_text): the texts of a section's units, a line each; a section goes from heading to heading."""
    inside = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return units.groupBy("file", "section_no").agg(F.array_join(F.transform(inside, lambda u: u["text"]), "\n").alias("section_text"))


def outline(units: DataFrame) -> DataFrame:
    """Headings with the level before them in the file, whether they jump a level, and whether no unit follows up to the next heading.

    One window over the units of a file tells all, so that files are read once.
    """
    order = Window.partitionBy("file").orderBy("seq")
    head = F.col("kind") == "heading"
    rows = units.select("file", "unit_id", "seq", "line", "level", F.when(head, F.col("text")).alias("text"), head.alias("_head"))
    before = F.last(F.when(F.col("_head"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = rows.withColumns({"level_before": before, "empty": F.coalesce(F.lead("_head").over(order), F.lit(True))}).where("_head")
    return heads.select("file", "unit_id", "line", "level", "text", "level_before", F.coalesce(F.col("level") > F.col("level_before") + 1, F.lit(False)).alias("jumps"), "empty")
