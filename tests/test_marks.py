"""The plan as sets of rules: what is read off them is what the plan's outcomes say."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseloom import component_queries, plan_queries
from proseloom.functions import text
from proseloom.operators import class_rules, planning, tailwind
from proseloom.plans.catalogue import RULES

ABSTAIN = {
    "typography-ellipsis": ("CASE WHEN role = 'heading' THEN 'unresolved level' END", False),
    "typography-midpoint-separators": ("CASE WHEN file < 'd' THEN 'no pages' WHEN file < 'g' THEN 'no sizes' END", True),
    "copywriting-filler-words": ("CASE WHEN start % 2 = 0 THEN 'not today' END", True),
}
WORDS = ["Simply", "really", "just", "click", "here", "...", "wait", "to", "and", "a", "·", "Save", "Loading", "error", "very", "“it”", "not", "only", "w" * 1700]


def reasons():
    return {i: (F.expr(sql), run) for i, (sql, run) in ABSTAIN.items()}


@pytest.fixture(scope="module")
def units(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        kind = rnd.choice(("paragraph", "paragraph", "heading", "jsx-text", "file"))
        said = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 12)))
        rows.append((f"{rnd.choice('abcdefgh')}.md", str(i), kind, "heading" if kind == "heading" else rnd.choice(("body", "cell")), rnd.choice(("ui", "howto", "explanation")), i + 1, i, said, rnd.choice((None, "Top")), rnd.choice((None, "all of it"))))
    return spark.createDataFrame(rows, "file string, unit_id string, kind string, role string, doc_type string, line long, start long, text string, heading_above string, section string").cache()


@pytest.fixture(scope="module")
def planned(units):
    made = planning.plan(units, RULES, reasons()).cache()
    assert len(RULES) > 2 * 63 and made.count() > 100
    return made


@pytest.fixture(scope="module")
def outcomes(planned):
    return [(r.unit_id, r.file, o.rule_id, o.outcome, o.reason) for r in planned.select("unit_id", "file", "outcomes").collect() for o in r.outcomes]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    said = "\n".join(f"line {'abcdef'[n % 6]} of the text, with some words in it" for n in range(40))
    spark.createDataFrame([(i, said, f"src{i % 3}") for i in range(4)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_classes_are_taken_apart_once(spark, folder):
    lists = spark.createDataFrame([(["text-sm", "font-bold"],)], "classes array<string>")
    plan = plan_of(lists.select(tailwind.resolve(F.col("classes"), {"note": "13px"})))
    assert plan.count(r"\[[^\]]*\]") < 5 and len(plan) < 40_000
    whole = plan_of(component_queries.class_rule_outcomes(spark, folder))
    assert whole.count("MapInArrow") == 1 and "Window" not in whole


def test_long_class_names_and_chains_of_hyphens_are_gone_through_in_a_loop(spark):
    # 100,000 rounds of a group that calls itself need more stack than there is.
    df = spark.createDataFrame([("hover:" * 20_000 + "p-[a:b]", "x" + "-x" * 100_000 + " y"), ("md:[&:hover]:text-sm", "a-b--c’d")], "c string, t string")
    assert [tuple(r) for r in df.select(text.strip_variants(F.col("c")), text.prose_words(F.col("t"))).collect()] == [("p-[a:b]", 2), ("text-sm", 2)]


def test_long_titles_do_not_overflow_the_stack(spark):
    title = "The" + " and Of to" * 30_000
    rows = [("a.md", str(i), "heading", "heading", "ui", 1, i, t, None, None) for i, t in enumerate((title + "?", title + " x", title + "??"))]
    units = spark.createDataFrame(rows, "file string, unit_id string, kind string, role string, doc_type string, line long, start long, text string, heading_above string, section string")
    rules = tuple(r for r in RULES if r.id == "typography-title-case-heading")
    assert {r.unit_id: r.outcome for r in planning.marks(units, rules).told(("unit_id",), *planning.OUTCOMES).collect()} == {"0": "unknown", "1": "negative", "2": "negative"}


def test_loops_match_what_the_pattern_matches():
    rnd, n = random.Random(7), 0
    for pattern in (r"^(?:[A-Z][a-z]+|of|a|an|and)(?: (?:[A-Z][a-z]+|of|a|an|and)){2,}[?!:.]?$", r"x(?:-(?:a|ab|abc?))*[.]?$", r"(?:,[a-c0-2]+)+[?][!]?$"):
        loop = text.portable(pattern)
        assert loop != pattern and re.search(r"(?:\*|\+|\})\+", loop)
        for _ in range(20_000):
            said = "".join(rnd.choice((" ", "-", ",", "a", "ab", "abc", "an", "and", "of", "Foo", "F", "1", "x", "?", "!", ".", "\n")) for _ in range(rnd.randrange(1, 9)))
            one, two = re.search(pattern, said), re.search(loop, said)
            assert (one and one.span()) == (two and two.span()), said
            n += bool(one)
    assert n > 300
    for other in (r"(?: a| b)+$", r"(?: a|b)+$", r"(?: \w+)+$", r"(?:-a)+b$", r"(?:-a)+[-.]?$", r"((?:-a)+)$", r"(?:-a)+", r"(?:-a-b)+$"):
        assert text.portable(other) == other


def test_coverage_is_that_of_the_plan_in_one_pass(spark, folder, units, planned):
    marks = planning.marks(units, RULES, reasons())
    got, want = ({tuple(r) for r in x.collect()} for x in (marks.coverage(), planning.coverage(planned, RULES)))
    assert got == want and len(got) == len(RULES) and any(r[6] for r in got)
    plan = plan_of(plan_queries.plan_coverage(spark, folder))
    assert plan.count("MapInArrow") == 2 and "broadcast" not in plan.lower()


def test_jobs_are_those_of_the_plan_and_need_no_first_units(spark, folder, units, planned):
    rows = lambda df: sorted((r.unit_id, sorted(r.rule_ids), r.state, r.truncated) for r in df.collect())
    made = planning.marks(units, RULES, reasons()).jobs(*units.columns)
    got = rows(made)
    assert got == rows(planning.jobs(planned, RULES)) and len(got) > 50
    plan = plan_of(plan_queries.plan_jobs(spark, folder))
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_decisions_are_those_of_the_plan_and_units_are_read_once(spark, folder, units, outcomes):
    made = planning.marks(units, RULES, reasons()).first_of_run()
    got = Counter(tuple(r) for r in made.told(("unit_id",), "finding", "job", "unknown").collect())
    assert got == Counter((u, r, o, why) for u, _, r, o, why in outcomes if o in ("finding", "job", "unknown"))
    assert {why for _, _, o, why in got if o == "unknown"} >= {"unresolved level", "no pages", "no sizes", "not today"}
    assert "MapInArrow" not in plan_of(plan_queries.plan_decisions(spark, folder))


def test_counts_of_outcomes_are_those_of_the_plan_and_units_are_read_once(spark, folder, units, outcomes):
    got = {(r.rule_id, r.outcome): (r.n_units, r.n_files) for r in planning.marks(units, RULES, reasons()).first_of_run().counted().collect()}
    n_units = Counter((r, o) for _, _, r, o, _ in outcomes)
    n_files = Counter((r, o) for _, r, o in {(f, r, o) for _, f, r, o, _ in outcomes})
    assert got == {k: (n, n_files[k]) for k, n in n_units.items()} and {o for _, o in got} == set(planning.OUTCOMES)
    plan = plan_of(plan_queries.plan_outcomes(spark, folder))
    assert "MapInArrow" not in plan and "Expand" not in plan


def test_checks_of_classes_are_told_as_the_plan_tells_them(spark):
    rnd = random.Random(3)
    pool = ["text-sm", "text-huge", "uppercase", "font-bold", "italic", "transition-all", "duration-500", "ease-in", "animate-spin", "w-[13px]", "text-[13px]", "text-red-500", "tracking-wide", "leading-9"]
    rows = [("a.tsx", str(i), "class-list", rnd.choice(("body", "heading", "cell")), "ui", 1, i, "some words " * rnd.randrange(5), [rnd.choice(pool) for _ in range(rnd.randrange(5))], "p") for i in range(60)]
    lists = spark.createDataFrame(rows, "file string, unit_id string, kind string, role string, doc_type string, line long, start long, text string, classes array<string>, element string")
    theme = {"note": "13px"}
    typed, checks = class_rules.with_typography(lists, theme), class_rules.checks(theme)
    whole = planning.plan(typed, class_rules.CLASS_RULES, checks=checks).collect()
    want = Counter((r.unit_id, o.rule_id, o.outcome, o.reason) for r in whole for o in r.outcomes)
    assert Counter(tuple(r) for r in planning.marks(typed, class_rules.CLASS_RULES, checks=checks).told(("unit_id",), *planning.OUTCOMES).collect()) == want
    assert {o for _, _, o, _ in want} >= {"finding", "negative", "unknown"}
