"""Edits of prose ranges: composed, apart from each other, and applied once."""

import pytest
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import fixer, markdown
from proseloom.plans.catalogue import RULES, Rule
from proseloom.plans.lint import run_lint

FOUND = "file string, rule_id string, band string, suppressed boolean, fix_ranges array<struct<start:long,end:long>>"
FIXING = (Rule("a-dots", "c", "x", fix="ellipsis"), Rule("a-quotes", "c", "x", fix="smartQuotes"), Rule("a-none", "c", "x"))


def test_edits_compose_and_never_overlap(spark):
    found = spark.createDataFrame(
        [
            ("a", "a-dots", "act", False, [(0, 9), (20, 30)]), ("a", "a-quotes", "act", False, [(0, 9)]), ("a", "a-quotes", "act", False, [(0, 9), (5, 12), (40, 40)]), ("a", "a-quotes", "review", False, [(50, 60)]),
            ("a", "a-quotes", "act", True, [(50, 60)]), ("b", "a-none", "act", False, [(0, 9)]), ("c", "a-dots", "act", False, []), ("d", "a-dots", "act", False, None),
        ],
        FOUND,
    )
    got = [tuple(r) for r in fixer.edits(found, FIXING).orderBy("file", "start").collect()]
    assert got == [("a", 0, 9, ["ellipsis", "smartQuotes"]), ("a", 20, 30, ["ellipsis"])]
    assert {r.file for r in fixer.left_for_hands(found, FIXING).collect()} == {"c", "d"}
    assert fixer.edits(found, FIXING[2:]).count() == fixer.edits(found.where("false"), FIXING).count() == 0


def test_edits_are_applied_in_place(spark):
    files = spark.createDataFrame([("a", 'é "x"... | "y"... \U0001f600 z...'), ("b", "none..."), ("c", None)], "file string, text string").selectExpr("*", "1 AS start")
    changes = spark.createDataFrame([("a", 11, 17, ["ellipsis", "smartQuotes"]), ("a", 2, 8, ["smartQuotes"]), ("a", 20, 24, ["ellipsis"])], "file string, start long, end long, fixes array<string>")
    assert [tuple(r) for r in fixer.apply_edits(files, changes).collect()] == [("a", "é “x”... | “y”… \U0001f600 z…", 3)]


def test_code_and_attributes_are_left_alone(spark):
    source = 'He said "hi" and `"code"`...\n\n```\n"fenced"...\n```\n\n<Figure caption="it\'s"/> "end"\n'
    files = spark.createDataFrame([("docs/src0/a.mdx", source)], "file string, text string")
    found = run_lint(files, unit=markdown.markdown_units(files)).findings
    made = fixer.apply_edits(files, fixer.edits(found, RULES)).first().text
    assert made == 'He said “hi” and `"code"`…\n\n```\n"fenced"...\n```\n\n<Figure caption="it’s"/> “end”\n'


@pytest.mark.parametrize(
    ("before", "after"),
    [("Color and colors", "Colour and colours"), ("COLOR", "COLOR"), ("see a/color/b and color.", "see a/color/b and colour."), ("  gray\n(organized)", "  grey\n(organised)"), ("discolored", "discolored"), ("", "")],
)
def test_spelling(spark, before, after):
    assert spark.range(1).select(text.fix_spelling(F.lit(before))).first()[0] == after
