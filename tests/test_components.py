"""Component sources: elements, texts, class lists, what stands beside them, and the checks of their classes."""

import json

import pytest
from pyspark.sql import functions as F

from proseloom.functions import jsx
from proseloom.operators import class_rules, component_units, planning, tailwind

SOURCE = """import a from "b";
const f = <T,>(x: T) => x < 3 && y > 2;
console.log({ title: "no" }); throw new Error({ message: "no" });
const o = { title: "Yes it is", 'label': 'L\\'x', other: "z", hint: cond ? "a" : "b" };
const r = /<b>["']/.test(x);
export default () => (
  <Card className={cn("p-4 text-sm", x && "no", `bg-${c} flex`)}>
    Hello <b>big</b> {"world"} {name} {/* note */}
    {ok ? <Button title="Go" onClick={() => a < b}>Go &amp; on</Button> : null}
    <input placeholder={'Na' as string} className="w-1" disabled {...p} icon={<I aria-label="icon"/>} />
    <><p>in fragment</p></>
    <ul><li>one</li><li className="x">two</li><li/><li>four</li></ul>
  </Card>
);
"""


def made(spark, *files):
    df = spark.createDataFrame(list(files), "file string, text string").selectExpr("*", "'x' AS kind", "1 AS element")
    return component_units.component_units(df).orderBy("file", "start", "kind").collect()


def test_units_of_a_component(spark):
    units = made(spark, ("a.tsx", SOURCE))
    assert [(u.kind, u.element, u.role, u.attr, u.text, u.dynamic) for u in units] == [
        ("jsx-text", None, "literal-copy", "title", "Yes it is", False),
        ("jsx-text", None, "literal-copy", "label", "L'x", False),
        ("class-list", "Card", "unknown", None, "Hello big world", True),
        ("jsx-text", "Card", "unknown", None, "Hello big world", True),
        ("jsx-text", "b", "body", None, "big", False),
        ("attr-string", "Button", "label", "title", "Go", False),
        ("jsx-text", "Button", "button", None, "Go & on", False),
        ("attr-string", "input", "placeholder", "placeholder", "Na", False),
        ("class-list", "input", "body", None, "", False),
        ("attr-string", "I", "aria", "aria-label", "icon", False),
        ("jsx-text", "p", "body", None, "in fragment", False),
        ("jsx-text", "li", "list-item", None, "one", False),
        ("class-list", "li", "list-item", None, "two", False),
        ("jsx-text", "li", "list-item", None, "two", False),
        ("jsx-text", "li", "list-item", None, "four", False),
    ]
    by = {(u.kind, u.text): u for u in units}
    card = by["jsx-text", "Hello big world"]
    assert SOURCE[card.start : card.end].startswith("Hello") and [SOURCE[a:b] for a, b in card.fix_ranges] == ["Hello", "world"]
    assert (card.line, card.column) == (8, 5) and card.section.startswith("<Card")
    classes = by["class-list", "Hello big world"]
    assert classes.classes == ["p-4", "text-sm", "flex"] and classes.interpolated
    two = by["class-list", "two"]
    around = json.loads(two.section)
    assert [n["text"] for n in around["nearby"]] == ["one", "", "four"] and around["parent"] == {"opening": "<ul>"} and two.next_text == "four"
    assert [SOURCE[a:b] for a, b in by["attr-string", "Na"].fix_ranges] == ["Na"]


@pytest.mark.parametrize("text", ["const x = (", "<a>", "<a></b>", "<a b=>", "'open", "`open", "/* open", "<a b={", "x = )"])
def test_sources_that_do_not_parse_are_one_file_unit(spark, text):
    (unit,) = made(spark, ("a.tsx", text))
    assert unit.kind == "file" and unit.parse_error


def test_null_empty_and_deep_sources(spark):
    assert made(spark, ("a.tsx", None), ("b.tsx", ""), (None, "const a = 1;")) == []
    deep = "x = " + "<a>" * 400 + "t" + "</a>" * 400
    units = made(spark, ("d.tsx", deep))
    assert [u.kind for u in units] in (["file"], ["jsx-text"])
    jsx.Scanner("x = " + "<p>a</p>;\nx = " * 5000 + "1")


@pytest.mark.parametrize(
    ("code", "names", "dynamic", "interpolated"),
    [
        ('"a  b"', ["a", "b"], False, False), ("'a' as const", ["a"], False, False), ("`a b`", ["a", "b"], False, False), ("`a b-${x} c`", ["a", "c"], True, True), ("`${x}a b${y}`", [], True, True), ("`${x} a ${y}`", ["a"], True, True),
        ("cn('a', 'b, c')", ["a", "b,", "c"], False, False), ("cn('a', x && 'b')", ["a"], True, False), ("styles.cva(`a ${x}`, clsx('b'))", ["a", "b"], True, True), ("other('a')", [], True, False), ("x", [], True, False),
    ],
)
def test_class_names(code, names, dynamic, interpolated):
    assert jsx.class_names(code) == (names, dynamic, interpolated)


def resolved(spark, classes, theme=None):
    df = spark.createDataFrame([(classes,)], "classes array<string>")
    return df.select(tailwind.resolve(F.col("classes"), theme).alias("t")).first().t.asDict()


@pytest.mark.parametrize(
    ("classes", "theme", "expected"),
    [
        (["text-sm"], None, {"size_px": 14.0, "line_height": 1.429}),
        (["text-sm", "text-lg"], None, {"size_px": 18.0, "line_height": 1.556}),
        (["leading-tight", "text-sm"], None, {"size_px": 14.0, "line_height": 1.25}),
        (["text-sm", "leading-7"], None, {"size_px": 14.0, "line_height": 2.0}),
        (["text-sm/6", "text-lg"], None, {"size_px": 18.0, "line_height": 1.333}),
        (["text-sm/[1.4]"], None, {"size_px": 14.0, "line_height": 1.4}),
        (["text-sm", "text-[13px]"], None, {"size_px": 13.0}),
        (["text-[1.5rem]/none"], None, {"size_px": 24.0, "line_height": 1.0}),
        (["text-[length:12px]"], None, {"size_px": 12.0}),
        (["text-sm", "text-[calc(1px)]"], None, {"unresolved": ["text-[calc(1px)]"]}),
        (["text-huge"], None, {"unresolved": ["text-huge"]}),
        (["text-note"], {"note": "13px"}, {"size_px": 13.0}),
        (["text-red-500", "text-[#fff]", "text-center", "text-muted-foreground"], None, {"colours": ["text-red-500", "text-[#fff]", "text-muted-foreground"]}),
        (["md:text-lg", "hover:font-bold", "dark:text-sm"], None, {"size_px": 14.0, "line_height": 1.429}),
        (["tracking-wide", "tracking-[2px]"], None, {"spacing_em": 0.125}),
        (["tracking-[x]", "font-odd", "leading-odd"], None, {"unresolved": ["tracking-[x]", "font-odd", "leading-odd"]}),
        (["font-bold", "font-[450]", "font-mono"], None, {"weight": 450.0, "family": "mono"}),
        (["uppercase", "italic"], None, {"uppercase": True, "italic": True}),
        (["uppercase", "normal-case"], None, {"uppercase": False}),
        ([], None, {}),
    ],
)
def test_typography(spark, classes, theme, expected):
    empty = {"size_px": None, "line_height": None, "spacing_em": None, "weight": None, "family": None, "uppercase": None, "italic": None, "colours": [], "unresolved": []}
    assert resolved(spark, classes, theme) == empty | expected


def test_literal_values_and_near_sizes(spark):
    classes = ["w-[13px]", "hover:bg-[#fff]", "p-[var(--x)]", "[&>svg]:m-1", "text-[length:2rem]", "w-[calc(1px)]", "bg-[rgb(0,0,0)]/50", "-mt-[.5em]!", "grid-cols-[1fr_2fr]"]
    df = spark.createDataFrame([(classes, ["md:text-[13.5px]", "text-[16px]", "text-[2px]", "p-[13px]", "text-[9px]"])], "c array<string>, d array<string>")
    assert df.select(tailwind.literal_values(F.col("c"))).first()[0] == ["w-[13px]", "hover:bg-[#fff]", "text-[length:2rem]", "bg-[rgb(0,0,0)]/50", "-mt-[.5em]!"]
    matches, unresolved = tailwind.near_scale(F.col("d"), {"b": "14px", "a": "13px", "c": "1rem"})
    row = df.select(matches.alias("m"), unresolved.alias("u")).first()
    assert [tuple(m) for m in row.m] == [("md:text-[13.5px]", "md:text-a", 13.0, 0.5)]
    assert row.u == ["text-[16px]: declared font scale contains unresolved values", "p-[13px]: p scale family is unsupported", "text-[9px]: declared font scale contains unresolved values"]
    assert df.select(tailwind.near_scale(F.col("d"))[1]).first()[0][0] == "md:text-[13.5px]: no explicitly declared font scale"


CHECKED = [
    # rule, classes, text, role, more, outcome
    ("typography-body-below-15px", ["text-sm"], "six words are in this text", "body", {}, "job"),
    ("typography-body-below-15px", ["text-sm"], "five words are in this", "body", {}, "negative"),
    ("typography-body-below-15px", ["text-base"], "six words are in this text", "body", {}, "negative"),
    ("typography-body-below-15px", ["text-odd"], "x", "heading", {}, "unknown"),
    ("typography-letterspaced-body", ["text-sm", "tracking-wide"], "x", "body", {}, "job"),
    ("typography-letterspaced-body", ["text-sm", "tracking-wide", "uppercase"], "x", "body", {}, "negative"),
    ("typography-letterspaced-body", ["text-odd", "tracking-wide"], "x", "heading", {}, "negative"),
    ("typography-light-weight-small-body", ["text-lg", "font-light"], "x", "body", {}, "finding"),
    ("typography-light-weight-small-body", ["text-xl", "font-light"], "x", "body", {}, "negative"),
    ("typography-line-height-out-of-band", ["text-base", "leading-none"], "a b c d e f g h", "body", {}, "finding"),
    ("typography-line-height-out-of-band", ["text-4xl", "leading-snug"], "x", "heading", {}, "finding"),
    ("typography-line-height-out-of-band", ["text-sm"], "a b c d e f g h", "body", {}, "negative"),
    ("typography-hierarchy-size-only", ["text-base"], "x", "body", {"next_classes": ["text-sm"], "next_text": "y"}, "job"),
    ("typography-hierarchy-size-only", ["text-base", "font-bold"], "x", "body", {"next_classes": ["text-sm"], "next_text": "y"}, "negative"),
    ("typography-hierarchy-size-only", ["text-base"], "x", "body", {"next_classes": ["text-odd"], "next_text": "y"}, "unknown"),
    ("typography-numeric-cell-proportional-figures", ["p-1"], "12", "cell", {}, "finding"),
    ("typography-numeric-cell-proportional-figures", ["md:tabular-nums"], "12", "cell", {}, "negative"),
    ("typography-stacked-emphasis", ["font-bold", "italic", "text-red-500"], "x", "body", {}, "finding"),
    ("typography-stacked-emphasis", ["font-bold", "italic", "text-muted"], "x", "body", {}, "negative"),
    ("typography-uppercase-without-tracking", ["uppercase"], "x", "body", {}, "finding"),
    ("typography-uppercase-without-tracking", ["uppercase", "tracking-wide"], "x", "body", {}, "negative"),
    ("motion-ease-in-on-transition", ["hover:ease-in", "transition"], "", "body", {}, "finding"),
    ("motion-ease-in-on-transition", ["ease-in", "transition-none"], "", "body", {}, "negative"),
    ("motion-linear-easing-on-transition", ["ease-linear", "duration-100"], "", "body", {}, "finding"),
    ("motion-linear-easing-on-transition", ["ease-linear", "animate-spin"], "", "body", {}, "negative"),
    ("motion-duration-over-300ms", ["transition", "duration-[.5s]", "duration-[0.5s]"], "", "body", {}, "finding"),
    ("motion-duration-over-300ms", ["duration-500"], "", "body", {}, "negative"),
    ("motion-transition-all", ["md:transition-all"], "", "body", {}, "finding"),
    ("motion-scale-from-zero", ["scale-0", "transition"], "", "body", {}, "finding"),
    ("motion-scale-from-zero", ["scale-0"], "", "body", {}, "negative"),
    ("motion-animate-without-reduced-motion", ["animate-pulse"], "", "body", {}, "finding"),
    ("motion-animate-without-reduced-motion", ["motion-safe:animate-pulse"], "", "body", {}, "negative"),
    ("motion-animate-without-reduced-motion", ["animate-pulse", "motion-reduce:animate-none"], "", "body", {}, "negative"),
    ("craft-raw-colour-class", ["hover:bg-pink-500/50"], "", "body", {}, "finding"),
    ("craft-raw-colour-class", ["bg-primary"], "", "body", {"file": "src/components/ui/a.tsx"}, "out_of_scope"),
    ("craft-arbitrary-value-class", ["w-[3px]"], "", "body", {"section": "{}"}, "job"),
    ("craft-arbitrary-value-class", ["w-[3px]"], "", "body", {}, "unknown"),
    ("craft-arbitrary-value-class", ["w-[3px]"], "", "body", {"section": "{}", "dynamic": True}, "unknown"),
    ("craft-interpolated-class-string", ["a"], "", "body", {"interpolated": True}, "finding"),
    ("craft-near-duplicate-scale", ["text-[13px]"], "", "body", {}, "finding"),
    ("craft-near-duplicate-scale", ["text-[13px]"], "", "body", {"dynamic": True}, "unknown"),
    ("craft-near-duplicate-scale", ["p-[13px]"], "", "body", {}, "unknown"),
    ("craft-near-duplicate-scale", ["text-[99px]"], "", "body", {}, "negative"),
    ("motion-reduced-motion-animation", ["motion-reduce:animate-spin"], "", "body", {}, "finding"),
    ("typography-justify-without-hyphens", ["text-justify", "hyphens-none"], "", "body", {}, "finding"),
    ("typography-disabled-kerning", ["[font-kerning:none]"], "x", "body", {}, "finding"),
    ("typography-disabled-kerning", ["[font-kerning:none]"], " ", "body", {}, "negative"),
    ("typography-stretched-glyphs", ["scale-x-110"], "x", "label", {}, "finding"),
    ("typography-stretched-glyphs", ["scale-x-110"], "x", "button", {}, "negative"),
    ("motion-layout-property-transition", ["md:transition-[opacity,width]"], "", "body", {}, "finding"),
    ("motion-layout-property-transition", ["transition-[opacity]"], "", "body", {}, "negative"),
]


def test_class_checks(spark):
    names = "file string, unit_id string, kind string, role string, doc_type string, line long, start long, text string, classes array<string>, dynamic boolean, interpolated boolean, section string, next_text string, next_classes array<string>, element string, attr string"
    base = {"file": "a.tsx", "kind": "class-list", "doc_type": "ui", "line": 1, "start": 0, "dynamic": False, "interpolated": False, "section": None, "next_text": None, "next_classes": None, "element": "p", "attr": None}
    keys = [c.split()[0] for c in names.split(", ")]
    rows = [{**base, "unit_id": str(i), "classes": c, "text": t, "role": r, **more} for i, (_, c, t, r, more, _) in enumerate(CHECKED)]
    theme = {"note": "13px", "lead": "20px"}
    units = class_rules.with_typography(spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], names), theme)
    planned = planning.plan(units, class_rules.CLASS_RULES, checks=class_rules.checks(theme)).collect()
    got = {(r.unit_id, o.rule_id): o for r in planned for o in r.outcomes}
    wrong = [(x[0], x[1], x[5], got[str(i), x[0]]) for i, x in enumerate(CHECKED) if got[str(i), x[0]].outcome != x[5]]
    assert wrong == []
    assert {x[0] for x in CHECKED} == {r.id for r in class_rules.CLASS_RULES}
    said = {x[0]: got[str(i), x[0]].evidence for i, x in enumerate(CHECKED) if x[5] in ("finding", "job")}
    assert said["typography-stacked-emphasis"] == ["3 emphasis axes at once (weight 700, text-red-500)"]
    assert said["craft-near-duplicate-scale"] == ["text-[13px] is 0px from text-note (13px)"]
    assert said["typography-hierarchy-size-only"] == ["16px, leading 1.5 over 14px, leading 1.429, ratio 1.14"]
