"""Outcomes of rules on units, the questions that are left, and the pass that tells which rules can match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proseloom.functions.literals import Prefilter, required, without_literals
from proseloom.operators import findings as reduce
from proseloom.operators import mechanical, planning
from proseloom.plans.catalogue import RULES, Rule
from proseloom.plans.lint import run_lint

COLUMNS = "file string, unit_id string, kind string, role string, doc_type string, line long, start long, text string, section string, dynamic boolean, next_text string, heading_above string, in_code boolean"


def units(spark, *rows):
    keys = [c.split()[0] for c in COLUMNS.split(", ")]
    base = {"file": "a.md", "kind": "paragraph", "role": "body", "doc_type": "ui", "line": 1, "start": 0, "text": "", "section": None, "dynamic": False, "next_text": None, "heading_above": None, "in_code": False}
    made = [{**base, "unit_id": str(i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in keys) for r in made], COLUMNS)


def outcomes(spark, rows, rules, abstain=None):
    planned = planning.plan(units(spark, *rows), rules, abstain)
    return {(r.unit_id, o.rule_id): (o.outcome, o.reason) for r in planned.collect() for o in r.outcomes}


RULE_SET = (
    Rule("a-mechanical", "c", r"\bword\b", doc_types=("ui",)),
    Rule("a-both", "c", r"\bword\b", asks=("docType",)),
    Rule("a-judged", "d", asks=("headingAbove",), min_words=2),
    Rule("a-section", "d", phrases=("none",), asks=("section",), kinds=("paragraph", "jsx-text")),
    Rule("a-pair", "d", asks=("neighbours",)),
    Rule("a-source", "e", r"word", asks=(), kinds=("source",), include=("**/*.ts",)),
    Rule("a-code", "e", r"it\.only\(", kinds=("source",), code_only=True),
)


def test_every_outcome(spark):
    rows = [
        {"text": "a word here", "next_text": "x"},
        {"text": "nothing here at all", "doc_type": "plan", "next_text": "x"},
        {"text": "None", "section": "s"},
        {"text": "none", "kind": "jsx-text", "section": "s", "dynamic": True},
        {"text": "word " * 2000, "next_text": ""},
        {"text": "word", "kind": "source", "file": "a.ts"},
        {"text": "word " * 9000, "kind": "source", "file": "b.ts"},
        {"text": "x = 'it.only(' // it.only(\n", "kind": "source", "file": "c.js"},
        {"text": "y\nit.only(`it.only(${z}`)", "kind": "source", "file": "c.js"},
    ]
    got = outcomes(spark, rows, RULE_SET)
    out = lambda i: {r.id[2:]: got[str(i), r.id] for r in RULE_SET}
    assert out(0) == {"mechanical": ("finding", None), "both": ("job", None), "judged": ("job", None), "section": ("negative", None), "pair": ("job", None), "source": ("out_of_scope", None), "code": ("out_of_scope", None)}
    assert out(1)["mechanical"] == ("precondition", None) and out(1)["both"] == ("negative", None)
    assert out(2)["judged"] == ("precondition", None) and out(2)["section"] == ("job", None) and out(2)["pair"] == ("unknown", "Missing comparison neighbour")
    assert out(3)["section"] == ("unknown", "Dynamic text may supply the missing explanation or action")
    too_much = ("unknown", "Text comparison exceeds the context budget")
    assert out(4)["mechanical"] == ("finding", None) and out(4)["both"] == out(4)["judged"] == too_much and out(4)["section"] == ("negative", None)
    assert out(5)["source"] == ("job", None) and out(5)["mechanical"] == ("out_of_scope", None)
    assert out(6)["source"] == ("unknown", "Source exceeds the semantic context budget")
    assert out(7)["code"] == ("negative", None) and out(8)["code"] == ("finding", None) and out(8)["source"] == ("out_of_scope", None)
    missing = outcomes(spark, [{"text": "none"}], RULE_SET)
    assert missing["0", "a-section"] == ("unknown", "Missing section context")


def test_reasons_of_a_run_are_kept_once(spark):
    rows = [{"text": "word", "file": f, "start": s} for f, s in (("b.md", 0), ("a.md", 7), ("a.md", 3), ("c.md", 0))]
    rules = (RULE_SET[0], Rule("b-x", "c", "word"))
    abstain = {"a-mechanical": (F.when(F.col("file") != "c.md", F.lit("no report")), True), "b-x": (F.when(F.col("file") == "b.md", F.lit("unresolved")), False)}
    got = outcomes(spark, rows, rules, abstain)
    assert [got[str(i), "a-mechanical"] for i in range(4)] == [("precondition", None), ("precondition", None), ("unknown", "no report"), ("finding", None)]
    assert [got[str(i), "b-x"][0] for i in range(4)] == ["unknown", "finding", "finding", "finding"]
    assert planning.plan(units(spark), rules, abstain).count() == 0


def test_jobs_share_a_request_unless_a_section_or_the_budget_parts_them(spark):
    rules = (*RULE_SET[:4], Rule("b-role", "c", asks=("role", "earlier")), Rule("b-head", "c", asks=("headingAbove",)))
    rows = [
        {"text": "a word, none", "section": "all of it", "heading_above": "Top"},
        {"text": "word " + "w" * 5100, "heading_above": "h" * 110},
        {"text": "no", "kind": "file"},
    ]
    made = planning.jobs(planning.plan(units(spark, *rows), rules), rules).collect()
    got = {(r.unit_id, tuple(sorted(r.rule_ids))): (r.state, r.truncated) for r in made}
    assert got["0", ("a-both", "a-judged", "b-head", "b-role")] == ("TEXT: a word, none\nHEADING: Top\nDOC TYPE: ui\nROLE: body", False)
    assert got["0", ("a-section",)] == ("TEXT: a word, none\nSECTION: all of it", False)
    alone = {ids for unit, ids in got if unit == "1"}
    assert alone <= {("a-both",), ("a-judged",), ("b-head",), ("b-role",), ("a-both", "a-judged", "b-head", "b-role")} and not any(t for _, t in got.values())


def test_states_are_cut_at_what_is_left(spark):
    rows = [{"text": "x" * 5000, "heading_above": "h" * 400}, {"text": "x" * 6000}, {"text": "a", "next_text": "b"}]
    made = units(spark, *rows).select("unit_id", planning.build_state(units(spark), lambda key: key in ("headingAbove", "neighbours")).alias("s")).orderBy("unit_id").collect()
    room = 1500 - -(-5006 * 2 // 7) - 3
    assert made[0].s.truncated and made[0].s.state == "TEXT: " + "x" * 5000 + "\nHEADING: " + "h" * int(room * 3.5) + " [truncated]"
    assert made[1].s.state == "TEXT: " + "x" * 5243 + " [truncated]"
    assert made[2].s == ("FIRST: a\nSECOND: b", False)


def test_coverage_counts_answers(spark):
    planned = planning.plan(units(spark, {"text": "a word"}, {"text": "b word"}, {"text": "c"}, {"text": "word " * 2000}), RULE_SET[:3])
    answered = spark.createDataFrame([("0", "a-both"), ("0", "a-both"), ("9", "a-both")], "unit_id string, rule_id string")
    got = {r.rule_id: tuple(r)[2:] for r in planning.coverage(planned, RULE_SET[:3], answered).collect()}
    assert got == {"a-mechanical": (4, 3, 1, 0, 0), "a-both": (4, 1, 1, 1, 1), "a-judged": (3, 0, 0, 2, 1)}
    assert {r.rule_id: r.reason for r in planning.unknowns(planned).collect()} == {"a-both": "Text comparison exceeds the context budget", "a-judged": "Text comparison exceeds the context budget"}


def test_questions_are_no_findings(spark):
    files = spark.createDataFrame([("docs/src0/1.md", "This is really very simple.\nWait...")], "file string, text string")
    result = run_lint(files)
    assert {r.rule_id for r in result.findings.collect()} == {"typography-ellipsis"}
    assert "copywriting-filler-words" in {i for r in result.jobs.collect() for i in r.rule_ids}
    assert all(r.probability == 1.0 and r.offset == 4 for r in planning.findings(result.plan).where("rule_id = 'typography-ellipsis'").collect())


def test_source_findings_name_the_line_of_the_match(spark):
    rule = Rule("x-y", "c", r"bad\(", kinds=("source",))
    rows = units(spark, {"text": "one\ntwo\n  bad(1)\nbad(2)", "kind": "source", "file": "a.ts"})
    assert [(r.line, r.n_matches, r.offset) for r in mechanical.hits(rows, (rule,)).collect()] == [(3, 2, 10)]
    assert [r.line for r in planning.findings(planning.plan(rows, (rule,))).collect()] == [3]


def test_findings_are_listed_by_band_and_severity(spark):
    rows = [("b", 1, "act", "minor", 0.9, "r", "u"), ("a", 2, "review", "major", 1.0, "r", "u"), ("a", 2, "act", "minor", 0.8, "s", "u"), ("a", 2, "act", "major", 0.7, "r", "u"), ("a", 2, "act", "minor", 0.9, "t", "u"), ("a", 1, "review", "minor", 0.4, "r", "u")]
    df = spark.createDataFrame(rows, "file string, line long, band string, severity string, probability double, rule_id string, unit_id string")
    order = [(r.file, r.line, r.band, r.severity, r.probability) for r in reduce.ordered(df).collect()]
    assert order == [("a", 1, "review", "minor", 0.4), ("a", 2, "act", "major", 0.7), ("a", 2, "act", "minor", 0.9), ("a", 2, "act", "minor", 0.8), ("a", 2, "review", "major", 1.0), ("b", 1, "act", "minor", 0.9)]
    assert {(r.file, r.place) for r in reduce.places(df).collect()} == {("a", i) for i in range(1, 6)} | {("b", 1)}


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"\bword\b", {"word"}), (r"(?:one|two) (?:three)?", {"one", "two"}), (r"a+bc*d", {"b", "a", "d"}), (r"[xy]\d", set("0123456789")), (r"[xy] ", {"x", "y"}), (r"\w+", None), (r"(?:a|\w)z?", None), (r"(?<=Q)r", {"q", "r"}),
        (r"(?!no)yes", {"yes"}), (r"[^a]", None), (r"x{0,3}", None), (r"\u{1F300}", None), (r"ſo", {"so"}), (r"Ab|aC", {"ab", "ac"}), (r"\p{L}in", {"in"}),
    ],
)
def test_literals_of_patterns(pattern, literals):
    found = required(pattern)
    assert found is None if literals is None else found and found <= literals


def test_the_prefilter_names_every_rule_that_matches():
    searched = [r for r in RULES if mechanical.searched(r)]
    may = Prefilter([(r.pattern, r.phrases) for r in searched])
    rnd = random.Random(2)
    words = [w for r in searched for w in (*r.phrases, *re.findall(r"[A-Za-z]{2,}", r.pattern))] + ["İ", "ſimply", "...", "--", '"', " "]
    hit = 0
    for _ in range(3000):
        text = " ".join(rnd.choice((str.upper, str.lower, str.title, str))(rnd.choice(words)) for _ in range(rnd.randrange(1, 9)))
        named = set(may(text))
        for i, r in enumerate(searched):
            plain = "(?<![^\\W_])(?:" + "|".join(map(re.escape, r.phrases)) + ")(?![^\\W_])" if r.phrases else r.pattern
            try:
                found = re.search(re.sub(r"\\p\{L\}", r"\\w", plain), text, re.I if r.phrases or "i" in r.flags else 0)
            except re.error:
                continue
            hit += bool(found)
            assert not found or i in named, (r.id, text)
    assert hit > 500


def test_scripts_without_strings_and_comments_keep_their_length():
    text = "a('b\\'c', \"d\") // e\n/* f\ng */ `h ${i + 'j'} k`"
    bare = without_literals(text)
    assert len(bare) == len(text) and "a('" in bare and "${i" in bare
    assert not set("bcdefghk") & set(bare)


def test_the_catalogue_is_whole():
    assert len(RULES) == len({r.id for r in RULES}) == 152
    assert {t: sum(r.tier == t for r in RULES) for t in ("mechanical", "both", "judged")} == {"mechanical": 77, "both": 63, "judged": 12}
    assert all(r.include for r in RULES)
