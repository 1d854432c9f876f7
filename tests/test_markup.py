"""Markdown and MDX units: the blocks, spans and places that rules and fixes rest on."""

import pytest

from proseloom import markup_queries
from proseloom.operators import markdown

LESSON = """---
title: A lesson
---

# Make text feel right

A "strong" platform for teams.

<Callout type="rule">
  Fix in order: copy, type, spacing.
</Callout>

## Measure

Body reads well; the spot is 66. Use `"straight"` quotes only in code.

```css
p { font-size: "16px"; }
```

- Keep the first item short
- The second item repeats an idea

<Exercise>
  <Inner {...given["one"]} title="never read" />
</Exercise>

<Figure caption="A caption with 'straight' quotes" />

| Name | Size |
| ---- | ---- |
| Body | 18px |

Text with an {expression} inside it.
"""


def units_of(spark, *files, **options):
    df = spark.createDataFrame(list(files), "file string, text string").selectExpr("*", "'x' AS kind", "1 AS line")
    return markdown.markdown_units(df, **options).orderBy("file", "seq").collect()


def test_a_lesson_with_components(spark):
    units = units_of(spark, ("lesson.mdx", LESSON), skip=("Exercise",), unwrap=("Callout",))
    assert [u.line for u in units if u.kind == "heading"] == [5, 13]
    first = next(u for u in units if u.text.startswith('A "strong"'))
    assert (first.line, first.column, first.role, first.heading_above) == (7, 1, "body", "Make text feel right")
    assert next(u for u in units if u.text.startswith("Fix in order")).component is None
    assert [u.text for u in units if u.role == "list-item"] == ["Keep the first item short", "The second item repeats an idea"]
    assert [u.text for u in units if u.role == "cell"] == ["Name", "Size", "Body", "18px"]
    assert not any("font-size" in u.text or "given" in u.text or "never" in u.text for u in units)
    caption = next(u for u in units if u.kind == "attr-string")
    assert (caption.text, caption.attr, caption.component) == ("A caption with 'straight' quotes", "caption", "Figure")
    assert [LESSON[a:b] for a, b in caption.fix_ranges] == [caption.text]
    measure = next(u for u in units if u.text.startswith("Body reads"))
    assert [measure.text[a:b] for a, b in measure.code_spans] == ['"straight"']
    assert [LESSON[a:b] for a, b in measure.fix_ranges] == ["Body reads well; the spot is 66. Use ", " quotes only in code."]
    assert units[-1].text == "Text with an inside it."
    assert not any(u.mdx_fallback for u in units)
    assert len({u.unit_id for u in units}) == len(units)


def test_attributes_of_inline_components_come_before_their_paragraph(spark):
    units = units_of(spark, ("x.mdx", "Inline <Kbd label=\"Press 'Ctrl'\" /> element with an attribute.\n"))
    assert [(u.kind, u.text) for u in units] == [("attr-string", "Press 'Ctrl'"), ("paragraph", "Inline element with an attribute.")]


@pytest.mark.parametrize("text", ["<Callout>\n\nThis paragraph is fine.\n", "This paragraph is fine.\n\n</Callout>\n", "This paragraph is fine.\n\nopen { here\n"])
def test_components_that_do_not_close_are_read_as_markdown(spark, text):
    units = units_of(spark, ("broken.mdx", text))
    assert next(u for u in units if u.text == "This paragraph is fine.").mdx_fallback


def test_places_are_those_of_the_source(spark):
    source = '﻿A "bom" line \U0001f600 `x`.\r\n\r\n> two\r\nlazy\r\n'
    one, two = units_of(spark, ("b.md", source))
    assert source[one.start : one.end] == 'A "bom" line \U0001f600 `x`.' and [one.text[a:b] for a, b in one.code_spans] == ["x"]
    assert (two.text, two.line, two.column, two.end_line) == ("two lazy", 3, 3, 4)


CASES = {
    "Title *one*\n===": [("heading", "heading", 1, "Title one")],
    "Title\n---\n": [("heading", "heading", 2, "Title")],
    "### ATX ##\n#no": [("heading", "heading", 3, "ATX"), ("paragraph", "body", 0, "#no")],
    "> - a\n>   b\n\n1) x\n   > y": [("paragraph", "list-item", 0, "a b"), ("paragraph", "list-item", 0, "x"), ("paragraph", "list-item", 0, "y")],
    "- a\n  - b\n\n    c\n- d": [("paragraph", "list-item", 0, x) for x in "abcd"],
    "text\n1. one starts, 2. does not\n": [("paragraph", "body", 0, "text"), ("paragraph", "list-item", 0, "one starts, 2. does not")],
    "text\n2. goes on\n": [("paragraph", "body", 0, "text 2. goes on")],
    "    code\n\ntext\n    goes on": [("paragraph", "body", 0, "text goes on")],
    "~~~\n```\n~~~\na\n````\n```\nb": [("paragraph", "body", 0, "a")],
    "<div>\nraw\n\nseen <b>bold</b>\n<!-- c\n\nd -->\nend": [("paragraph", "body", 0, "seen bold"), ("paragraph", "body", 0, "end")],
    "***\n---\n_ _ _\n- - -": [],
    "a|b\n-|:-:\nc \\| d|`e`|f\ng\n\nh": [("paragraph", "cell", 0, x) for x in ("a", "b", "c | d", "e", "g")] + [("paragraph", "body", 0, "h")],
    "a\\*b\\* &amp; &copy; &nope; <http://a.b> x_y_z 2 * 3": [("paragraph", "body", 0, "a*b* & © &nope; http://a.b x_y_z 2 * 3")],
    "**a *b* c** ***d*** ~~e~~ ~~~f ~~~ *g": [("paragraph", "body", 0, "a b c d e ~~~f ~~~ *g")],
    "![no](i.png) [a [b](u) c](v) [r] [s][R] [t] [x]\n\n[r]: <u> 'v'": [("paragraph", "body", 0, "[a b c](v) r s [t] [x]")],
    "see[^1] end\n\n[^1]: note\n    more\n": [("paragraph", "body", 0, "see end")],
    "``a ` b`` `c": [("paragraph", "body", 0, "a ` b `c")],
    "one  \ntwo\\\nthree": [("paragraph", "body", 0, "one two three")],
    "": [],
    " \n\n\t\n": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_blocks_and_spans(text):
    rows = markdown._file_rows("x.md", text, frozenset(), frozenset())
    assert [(r[2], r[3], r[4], r[12]) for r in rows] == [("heading", "heading", *x[2:]) if x[0] == "heading" else x for x in CASES[text]]


def test_modules_and_expressions_of_mdx_are_not_read():
    text = "import A from 'a'\nexport const x = 1\n\n# T\n\n{/* note */}\n\n<A>\ntext\n</A>\n"
    assert [(r[2], r[12], r[16]) for r in markdown._file_rows("x.mdx", text, frozenset(), frozenset())] == [("heading", "T", None), ("paragraph", "text", "A")]


def test_null_and_empty_files_have_no_units(spark):
    assert units_of(spark, ("a.md", None), ("b.md", ""), (None, None)) == []
    assert markdown.markdown_units(spark.createDataFrame([], "file string, text string")).count() == 0


def test_long_files_take_no_square_of_time():
    for text in ("*a " * 20_000, "[" * 20_000, "`" * 5000 + " `a", "> " * 500 + "x", "a\n" * 20_000, "<a " * 5000, "[a](" * 5000, "&" * 20_000):
        markdown._file_rows("x.md", text, frozenset(), frozenset())


def test_sections_and_outline(spark):
    df = spark.createDataFrame([("a.md", "x\n\n# A\n\ny\n\n### B\n\n## C\n\nz\n")], "file string, text string")
    units = markdown.markdown_units(df)
    assert {(r.section_no, r.section_text) for r in markdown.sections(units).collect()} == {(0, "x"), (1, "A\ny"), (2, "B"), (3, "C\nz")}
    assert {(r.text, r.level_before, r.jumps, r.empty) for r in markdown.outline(units).collect()} == {("A", None, False, False), ("B", 1, True, True), ("C", 3, False, False)}


def test_made_files_hold_all_kinds(spark):
    units = markup_queries.markdown_units(spark, "/root/testdata/sf0.001")
    assert {r.role for r in units.select("role").distinct().collect()} == {"heading", "body", "list-item", "cell", "caption"}
