"""Rule engine: each operator against rows worked out by hand or by a plain loop."""

import datetime  # noqa: F401

import pytest
from pyspark.sql import functions as F

from proseloom.functions import globs, stats, text
from proseloom.operators import evaluation, judge, mechanical, repetition, structure, units
from proseloom.operators import findings as reduce
from proseloom.plans.catalogue import RULES, Rule
from proseloom.plans.lint import run_lint
from proseloom.sources import files as sources


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_borders_see_ascii_only(spark):
    assert one(spark, F.regexp_count(F.col("t"), F.lit(text.portable(r"\ba"))), t="éa a") == 2


@pytest.mark.parametrize("glob,path,hit", [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("a/**", "a/b/c", True), ("x.{ts,js}", "x.js", True), ("x.{ts,js}", "x.jsx", False), ("a?c", "abc", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.col("p").rlike(globs.glob_pattern(glob)), p=path) is hit


def test_selected_paths_leave_out_excluded_folders(spark):
    rows = spark.createDataFrame([("a/x.md",), ("node_modules/a/x.md",), ("b/dist/x.md",), ("a/x.png",)], ["file"])
    assert [r.file for r in rows.where(sources.selected(F.col("file"), ["**/*.md"])).collect()] == ["a/x.md"]


def test_fixes(spark):
    assert one(spark, text.fix_quotes(F.col("t")), t="\"a\" it's ('b')") == "“a” it’s (‘b’)"
    assert one(spark, text.fix_multiplication(F.col("t")), t="3 x 4 and 0x1F and 3.5x 2") == "3×4 and 0x1F and 3.5x 2"
    assert one(spark, text.fix_unit_space(F.col("t")), t="5 px 5 pxs 10 %") == "5 px 5 pxs 10 %"
    assert one(spark, text.fix_referral(F.col("t")), t="u?utm_source=chatgpt.com&a=1 v?utm_source=chatgpt.com") == "u?a=1 v"
    assert one(spark, text.strip_variants(F.col("t")), t="md:hover:[&>a:x]:p-2") == "p-2"


def fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def draw(seed):
    imul = lambda a, b: (a * b) & 0xFFFFFFFF
    a = (seed + 0x6D2B79F5) & 0xFFFFFFFF
    t = imul(a ^ (a >> 15), 1 | a)
    t = ((t + imul(t ^ (t >> 7), 61 | t)) & 0xFFFFFFFF) ^ t
    return (t ^ (t >> 14)) / 4294967296


def test_split_is_the_seeded_generator(spark):
    keys = [f"item-{i}" for i in range(200)] + ["", "é", "a😀"]
    got = {r.k: (r.h, r.d) for r in spark.createDataFrame([(k,) for k in keys], ["k"]).select("k", stats.fnv1a(F.col("k")).alias("h"), stats.first_draw(stats.fnv1a(F.col("k"))).alias("d")).collect()}
    assert got == {k: (fnv(k), draw(fnv(k))) for k in keys}


def test_wilson_without_trials_is_the_whole_range(spark):
    low, high = stats.wilson(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (5, 10)], ["s", "n"]).select(low, high).collect()
    assert tuple(rows[0]) == (0.0, 1.0) and rows[1][0] == pytest.approx(0.2366, abs=1e-4) and rows[1][1] == pytest.approx(0.7634, abs=1e-4)


def test_equal_discordant_pairs_are_no_difference(spark):
    pairs = spark.createDataFrame([("r", True, False)] * 3 + [("r", False, True)] * 3, ["rule_id", "a_correct", "b_correct"])
    assert evaluation.paired_test(pairs, ["rule_id"]).first().p_value == pytest.approx(1.0, abs=1e-6)


def test_units_have_lines_and_offsets(spark):
    files = spark.createDataFrame([("docs/src0/1.md", "a  b\n\n\tc 😀d"), ("x.md", None), ("y.md", "")], "file string, text string")
    assert [(r.line, r.start, r.text, r.doc_type) for r in units.line_units(files).orderBy("line").collect()] == [(1, 0, "a b", "howto"), (3, 6, "c 😀d", "howto")]


def test_rules_fire_and_are_reduced(spark):
    files = spark.createDataFrame([("docs/src0/1.md", "The app wants a file.\nfoo -- bar, it's -\n5 px a--b")], "file string, text string")
    result = run_lint(files, pragmas=spark.createDataFrame([("docs/src0/1.md", 2, "all")], "file string, line int, rule_id string"))
    got = {(r.line, r.rule_id, r.suppressed) for r in result.findings.collect()}
    assert got == {(1, "copywriting-anthropomorphism", False), (2, "typography-straight-quotes", True), (3, "typography-nbsp-value-unit", True), (3, "typography-dashes", True)}
    assert reduce.exit_summary(result.findings).first().exit_code == 1


def test_absent_pattern_vetoes(spark):
    rule = Rule("x-y", "c", r"a", absent="b", least=2)
    row = spark.createDataFrame([("f", "1", "paragraph", 1, 0, "a a", "ui"), ("f", "2", "paragraph", 2, 4, "a a b", "ui"), ("f", "3", "paragraph", 3, 4, "a", "ui")], ["file", "unit_id", "kind", "line", "start", "text", "doc_type"])
    assert [r.fired for r in mechanical.outcomes(row, (rule,)).orderBy("unit_id").collect()] == [True, False, False]


def test_first_of_equals_wins(spark):
    rows = spark.createDataFrame([("u", "r", "c", 0.9, 2, "act"), ("u", "r", "c", 0.9, 1, "act"), ("u", "s", "c", 0.95, 3, "review")], ["unit_id", "rule_id", "category", "probability", "seq", "band"])
    assert [r.seq for r in reduce.dedupe_exact(rows).orderBy("seq").collect()] == [1, 3]
    merged = reduce.merge_categories(reduce.dedupe_exact(rows)).first()
    assert (merged.rule_id, merged.also) == ("r", ["s"])


def test_chunks_of_large_groups_cross_blocks(spark):
    from proseloom import queries

    sizes = [(None if i % 11 == 0 else "large" if i % 5 else f"s{i % 3}", i, i * i * 7919 % 60 if i % 97 else 300) for i in range(6000)]
    want, state = {}, {}
    for g, i, t in sizes:
        total, chunk = state.get(g, (0, 0))
        over = total > 0 and total + t > 100
        state[g] = (t, chunk + 1) if over else (total + t, chunk)
        want[i] = (g, state[g][1])
    df = spark.createDataFrame(sizes, "source string, doc_id long, tokens long").repartition(7)
    got = judge.chunk_rows(df, "source", "doc_id", "tokens", 100).collect()
    assert len(got) == len(want) and {r.doc_id: (r.source, r.chunk) for r in got} == want
    made = queries.queries()["question_chunks"](spark, "/root/testdata/sf0.001")
    assert made.columns == ["source", "doc_id", "chunk"] and made.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_chunks_start_anew_above_the_limit(spark):
    assert one(spark, judge.chunk_numbers(F.col("t"), 10), t=[4, 5, 3, 12, 1, 9]) == [0, 0, 1, 2, 3, 3]


def test_cached_answers_are_not_asked_again(spark):
    requests = spark.createDataFrame([("a" * 64, "s", 1), ("b" * 64, "s", 1), ("c" * 64, "s", 1)], ["key", "state", "tokens"])
    cache = spark.createDataFrame([("a" * 64, 0.25, 1), ("b" * 64, 7.0, 1)], ["key", "probability", "written"])
    cached = judge.with_cache(requests, cache)
    assert judge.cost(cached).first().requests == 2
    got = judge.answers(cached, lambda asked: asked.select("key", F.lit(0.5).alias("probability")))
    assert {r.key[0]: r.probability for r in got.collect()} == {"a": 0.25, "b": 0.5, "c": 0.5}
    jobs = spark.createDataFrame([("u", "r", "a" * 64), ("v", "r", "a" * 64), ("w", "r", "d" * 64)], ["unit_id", "rule_id", "key"])
    back = judge.answered_jobs(jobs, got)
    assert {r.unit_id: r.probability for r in back.collect()} == {"u": 0.25, "v": 0.25, "w": None}
    assert [tuple(r) for r in judge.unknown_of(back).collect()] == [("r", "w", "request-failed")]


def test_earlier_sentences(spark):
    rows = [("f", 0, "The parser keeps tables of known symbols."), ("f", 1, "Nothing common here at all."), ("f", 2, "Known symbols live in parser tables."), ("g", 0, "Known symbols live in parser tables.")]
    got = {(r.file, r.unit): r.earlier for r in repetition.earlier_sentences(spark.createDataFrame(rows, ["file", "unit", "text"])).collect()}
    assert got == {("f", 2): "The parser keeps tables of known symbols."}


def test_repeated_blocks_and_comment_runs(spark):
    block = [f"const value{i} = compute({i}, other);" for i in range(8)]
    lines = block + ["x"] + block
    rows = [("f", i + 1, t) for i, t in enumerate(lines)] + [("g", i + 1, t) for i, t in enumerate(["// const a = 1;", "// run(a);", "// return a;", "// TODO later", "// prose", "text"])]
    df = spark.createDataFrame(rows, ["file", "line", "text"])
    assert [tuple(r) for r in repetition.repeated_blocks(df).collect()] == [("f", 1, 10)]
    assert [tuple(r) for r in repetition.comment_runs(df).collect()] == [("g", 1, 3, 3)]


def test_structure(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>x</p><h3>B</h3><h3>C</h3>")], ["page_id", "html"])
    rows = structure.with_headings(structure.blocks(pages)).orderBy("at").collect()
    assert [(r.level, r.text, r.heading_above, r.section) for r in rows] == [(1, "A", None, 1), (0, "x", "A", 1), (3, "B", "A", 2), (3, "C", "B", 3)]
    assert [r.text for r in structure.heading_jumps(structure.blocks(pages)).collect()] == ["B"]
    assert sorted(r.text for r in structure.empty_sections(structure.blocks(pages)).collect()) == ["B", "C"]


def test_changed_ranges(spark):
    df = spark.createDataFrame([("f", "@@ -1 +2,3 @@\n+x\n@@ -9,2 +7 @@\n@@ -5,2 +4,0 @@")], ["file", "patch"])
    assert sorted((r.start, r.end) for r in structure.changed_ranges(df).collect()) == [(2, 4), (7, 7)]


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("hi")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "y.md").write_text("no")
    assert [tuple(r) for r in sources.read_tree(spark, str(tmp_path)).collect()] == [("a/x.md", "hi")]


def test_stream_judges_each_key_once(spark, tmp_path):
    from proseloom.streaming.incremental import judged_once

    source, known = str(tmp_path / "in"), str(tmp_path / "known")
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    for batch in (rows("a", "b", "a"), rows("b", "c")):
        batch.coalesce(1).write.mode("append").parquet(source)
        judged_once(spark.readStream.schema("key string").parquet(source), known, lambda df: df.withColumn("p", F.lit(1.0)), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(known).collect()) == ["a", "b", "c"]


def test_catalogue_ids_are_unique():
    assert len({r.id for r in RULES}) == len(RULES)


def test_preconditions_and_masked_code(spark):
    rule = Rule("x-y", "c", r"\bword\b", kinds=("paragraph", "element"), include=("docs/**",), exclude=("**/README.md",), doc_types=("ui",), roles=("body",), not_in_code=True, not_generated=True)
    base = {"file": "docs/a.md", "unit_id": "0", "kind": "paragraph", "line": 1, "start": 0, "text": "a word", "doc_type": "ui", "role": "body", "in_code": False, "generated": False, "code_spans": []}
    changes = [{}, {"file": "docs/README.md"}, {"file": "src/a.md"}, {"file": "http://x", "kind": "element"}, {"kind": "heading"}, {"doc_type": "howto"}, {"role": "cell"}, {"in_code": True}, {"generated": True}, {"code_spans": [(2, 6)]}]
    rows = [tuple((base | c | {"unit_id": str(i)}).values()) for i, c in enumerate(changes)]
    units_ = spark.createDataFrame(rows, "file string, unit_id string, kind string, line long, start long, text string, doc_type string, role string, in_code boolean, generated boolean, code_spans array<struct<s: int, e: int>>").withColumn("code_spans", F.expr("transform(code_spans, x -> struct(x.s AS start, x.e AS end))"))
    assert [r.unit_id for r in mechanical.hits(units_, (rule,)).orderBy("unit_id").collect()] == ["0", "3"]
    assert tuple(mechanical.counts(units_, (rule,)).first()) == ("x-y", 3, 2, 1)


def test_phrases_count_and_ignore_case(spark):
    rule = Rule("x-y", "c", phrases=("very", "it's", "kind of"), least=2)
    lines = ["Very very", "very", "every veryx", "IT'S kind of", "it’s Kind of", "ſ very, VERY"]
    rows = spark.createDataFrame([("f", str(i), "paragraph", 1, 0, t, "ui") for i, t in enumerate(lines)], ["file", "unit_id", "kind", "line", "start", "text", "doc_type"])
    assert [r.unit_id for r in mechanical.hits(rows, (rule,)).orderBy("unit_id").collect()] == ["0", "3", "5"]


def test_suppressed_findings_hide_no_live_one(spark):
    rows = [("u", "r", "c", 0.9, 1, "act", True), ("u", "s", "c", 0.5, 2, "review", False), ("u", "t", "c", 0.4, 3, "review", False)]
    df = spark.createDataFrame(rows, ["unit_id", "rule_id", "category", "probability", "seq", "band", "suppressed"])
    assert sorted((r.rule_id, r.also) for r in reduce.merge_categories(df).collect()) == [("r", []), ("s", ["t"])]


def test_runs_without_units_or_unfinished_fail(spark):
    result = run_lint(spark.createDataFrame([("x.md", "")], "file string, text string"))
    code = lambda **k: reduce.exit_summary(result.findings, units=result.units, **k).first().exit_code
    assert (code(), code(strict=False), code(strict=False, complete=False)) == (2, 0, 2)


def test_every_rule_with_a_pattern_hits_where_no_judge_is_asked(spark, tmp_path):
    from proseloom import queries

    text = "This is really very simple.\nWait..."
    spark.createDataFrame([(1, text, "src0")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    known = queries.queries()
    assert {(r.rule_id, r.band) for r in known["rule_hits"](spark, str(tmp_path)).collect()} >= {("copywriting-filler-words", "review"), ("typography-ellipsis", "act")}
    assert known["exit_summary"](spark, str(tmp_path)).first().findings == known["rule_hits"](spark, str(tmp_path)).count() == known["top_rules"](spark, str(tmp_path)).agg({"n": "sum"}).first()[0]
    assert known["coverage_by_rule"](spark, str(tmp_path)).where("rule_id = 'copywriting-filler-words' and answered = 1").count() == 1
    assert known["scorecard_by_rule"](spark, str(tmp_path)).where("rule_id = 'copywriting-filler-words' and review = 1").count() == 1
    assert known["scorecard_by_category"](spark, str(tmp_path)).agg({"review": "sum"}).first()[0] == known["scorecard_by_domain"](spark, str(tmp_path)).agg({"review": "sum"}).first()[0] > 0
    assert {r.suppressed for r in known["suppression"](spark, str(tmp_path)).where("rule_id = 'copywriting-filler-words'").collect()} == {True}
    assert known["changed_line_filter"](spark, str(tmp_path)).where("line = 2").count() == 1
