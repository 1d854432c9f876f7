"""Steps that once went through their input more often, or longer, than their result needs."""

import random

from pyspark.sql import functions as F

from proseloom import queries
from proseloom.functions.literals import required
from proseloom.operators import fixer, judge, markdown, mechanical, planning, units
from proseloom.plans.catalogue import RULES, Rule


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outline_reads_files_once(spark):
    units = markdown.markdown_units(spark.createDataFrame([("a.md", "x\n\n# A\n\n### B\n\ny\n\n# C")], "file string, text string"))
    made = markdown.outline(units)
    assert plan_of(made).count("MapInArrow") == 1
    assert [(r.text, r.level_before, r.jumps, r.empty) for r in made.orderBy("line").collect()] == [("A", None, False, True), ("B", 1, True, False), ("C", 3, False, True)]


def test_ends_of_questions_soon_meet():
    rnd, limit = random.Random(1), 2000
    sizes = [rnd.randrange(0, 300) for _ in range(3000)]
    ends = judge.Ends(limit)
    for t in sizes:
        ends.add(t)
    assert len(ends.sums) < 50
    sums, added = ends.table()
    for begin in (0, 1, 777, limit, limit + 1):
        total, chunk = begin, 0
        for t in sizes:
            total, chunk = (t, chunk + 1) if total > 0 and total + t > limit else (total + t, chunk)
        assert (sums[begin], added[begin]) == (total, chunk)


def test_first_units_of_a_run_do_not_need_the_plan(spark):
    units = markdown.markdown_units(spark.createDataFrame([("a.md", "a word\n\nb word")], "file string, text string"))
    rules = (Rule("a-x", "c", phrases=("word",)), Rule("b-x", "c", phrases=("b",)))
    planned = planning.plan(units, rules, {"a-x": (F.lit("no report"), True)})
    assert plan_of(planned).count("MapInArrow") == 2
    assert sorted(r.outcomes[0].outcome for r in planned.collect()) == ["precondition", "unknown"]


def test_hits_search_each_unit_once(spark):
    rules = tuple(Rule(f"{x}-x", "c", pattern=f"zebra {x}", kinds=("paragraph",)) for x in "abcdef")
    files = spark.createDataFrame([("a.md", "zebra a\n\nzebra b zebra a zebra b"), ("b.md", "none")], "file string, text string")
    made = mechanical.hits(units.line_units(files), rules)
    assert plan_of(made.select("file", "rule_id")).count("zebra a") == 1
    got = sorted((r.file, r.line, r.rule_id, r.n_matches, r.evidence, r.offset) for r in made.collect())
    assert got == [("a.md", 1, "a-x", 1, ["zebra a"], 0), ("a.md", 3, "a-x", 1, ["zebra a"], 8), ("a.md", 3, "b-x", 2, ["zebra b", "zebra b"], 0)]
    assert mechanical.hits(units.line_units(files), ()).count() == 0


def test_files_are_cut_by_place_and_not_counted_through_for_each_edit(spark):
    text = "é\U0001f600 x..." * 3000
    files = spark.createDataFrame([("a", text), ("b", None)], "file string, text string")
    changes = spark.createDataFrame([("a", 7 * i + 3, 7 * i + 7, ["ellipsis"]) for i in range(3000)] + [("b", 0, 1, ["ellipsis"])], "file string, start long, end long, fixes array<string>")
    made = fixer.apply_edits(files, changes)
    assert [tuple(r) for r in made.orderBy("file").collect()] == [("a", text.replace("...", "…"), 3000), ("b", None, 1)]
    assert "substring" not in plan_of(made).lower()


def test_sets_and_groups_within_a_literal_are_written_out():
    assert required(r"(?:it|this)(?:['’]s| is)(?: not|n['’]t)") == {" not", "n't", "n’t"}
    assert required(r"\bnot (?:just|only) (?:a )?\w") == {"not just ", "not just a ", "not only ", "not only a "}
    assert required(r"ab[c-e]?f") == {"abf", "abcf", "abdf", "abef"}


def test_scorecard_by_rule_judges_every_rule_with_a_pattern():
    sql = queries.oracle_sql()["scorecard_by_rule"]
    judged = [r.id for r in RULES if mechanical.searched(r) and mechanical.meeting((r,), {"paragraph"}, {"body"})]
    assert len(judged) == 43 and all(f"'{i}' AS rule_id" in sql for i in judged)
