"""Queries over the plan of a run on Markdown files: outcomes, jobs, unknowns and coverage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom import markup_queries
from proseloom.functions.globs import glob_pattern
from proseloom.operators import fixer, markdown, mechanical, planning
from proseloom.plans.catalogue import RULES, Rule
from proseloom.plans.lint import run_lint
from proseloom.registry import read, register
from proseloom.sources.shared import spread

_KINDS = {"paragraph", "heading", "attr-string"}
_ROLES = {"body", "list-item", "cell", "heading", "caption"}
_PLANNED = mechanical.meeting(RULES, _KINDS, _ROLES)
#: Rules that abstain here: SQL of the reason, and whether it holds for the whole run.
_ABSTAIN = {
    "typography-ellipsis": ("CASE WHEN kind = 'heading' AND level = 3 THEN 'unresolved level' END", False),
    "typography-midpoint-separators": ("CASE WHEN file LIKE 'docs/src1%' THEN 'no measured pages' END", True),
}

#: Look-around as characters beside the match, for SQL.
_BESIDE = (
    ("""(?<!["“‘'])""", """(?:^|[^"“‘'])"""),
    (r"(?<=\S)--(?=\S)|(?<=\p{L}) - (?=\p{L})", r"\S--\S|\p{L} - \p{L}"),
    (r"(?<![\w.])", r"(?:^|[^\w.])"),
    (r"(?![\w.%])", r"(?:[^\w.%]|$)"),
    (r"(?![\p{L}\d])", r"(?:[^\p{L}\d]|$)"),
    (r"(?<=\p{L})'(?=\p{L})|(?<=\s)'(?=\d)", r"\p{L}'\p{L}|\s'\d"),
    (r"\p{Extended_Pictographic}", "[\U0001f300-\U0001faff☀-➿]"),
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(values) -> str:
    return ", ".join(map(_quoted, values))


def _found(rule: Rule) -> str:
    """SQL that is true where a rule's pattern matches ``seen`` often enough; look-around becomes characters beside it."""
    edge = r"[^\p{L}\p{N}]"
    if rule.phrases:
        doubled = "|".join("".join(c if c.isalnum() else c + c for c in p) for p in rule.phrases)
        wide = f"regexp_replace(seen, '({edge})', '\\1\\1', 'g')"
        return f"len(regexp_extract_all({wide}, {_quoted(f'(?i)(?:^|{edge})(?:{doubled})(?:{edge}|$)')})) >= {rule.least}"
    plain = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", rule.pattern)
    for look, beside in _BESIDE:
        plain = plain.replace(look, beside)
    return f"regexp_matches(seen, {_quoted(('(?i)' if 'i' in rule.flags else '') + plain)})"


def _outcome(rule: Rule) -> str:
    inside = " OR ".join(f"regexp_matches(file, {_quoted(glob_pattern(g))})" for g in rule.include)
    outside = " OR ".join(f"regexp_matches(file, {_quoted(glob_pattern(g))})" for g in rule.exclude) or "false"
    tests = [f"doc_type IN ({_listed(rule.doc_types)})"] * bool(rule.doc_types) + [f"role IN ({_listed(rule.roles)})"] * bool(rule.roles)
    if rule.min_words:
        tests.append(f"len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)*')) >= {rule.min_words}")
    steps = [(f"NOT (kind IN ({_listed(rule.kinds)}) AND ({inside}) AND NOT ({outside}))", "out_of_scope", "NULL"), (f"NOT ({' AND '.join(tests) or 'true'})", "precondition", "NULL")]
    if rule.id in _ABSTAIN:
        steps.append((f"({_ABSTAIN[rule.id][0]}) IS NOT NULL", "unknown", _ABSTAIN[rule.id][0]))
    if mechanical.searched(rule):
        steps.append((f"NOT ({_found(rule)})", "negative", "NULL"))
    if rule.asks is not None:
        if "section" in rule.asks:
            steps.append(("true", "unknown", "'Missing section context'"))
        over = "ceil(length(text) / 3.5) > 1498"
        if "headingAbove" in rule.asks:
            over += " OR coalesce(ceil(length(heading_above) / 3.5) > greatest(0, 1497 - ceil((length(text) + 6) / 3.5)), false)"
        steps.append((over, "unknown", "'Text comparison exceeds the context budget'"))
    last = "finding" if rule.asks is None else "job"
    name = "CASE " + " ".join(f"WHEN {test} THEN {_quoted(out)}" for test, out, _ in steps) + f" ELSE '{last}' END"
    reason = "CASE " + " ".join(f"WHEN {test} THEN {why}" for test, _, why in steps) + " END"
    return f"SELECT unit_id, file, start, {_quoted(rule.id)} AS rule_id, {name} AS outcome, {reason} AS reason FROM seen_units"


#: Units with an id that both sides know, file, line and column, and outcomes of all rules before and after reasons of a run.
_PLAN = (
    markup_queries.UNITS
    + """, seen_units AS (SELECT *, file || ':' || line || ':' || col AS unit_id, line * 100000 + col AS start, coalesce(masked, text) AS seen, CASE WHEN file LIKE 'docs/src0/%' THEN 'howto' WHEN file LIKE 'docs/src1%' THEN 'ui' ELSE 'explanation' END AS doc_type FROM units),
raw AS ("""
    + " UNION ALL ".join(map(_outcome, _PLANNED))
    + f"""), ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id, reason ORDER BY file, start) AS nth FROM raw),
planned AS (SELECT unit_id, file, rule_id, CASE WHEN nth > 1 AND outcome = 'unknown' AND rule_id IN ({_listed(i for i, (_, run) in _ABSTAIN.items() if run)}) THEN 'precondition' ELSE outcome END AS outcome, reason FROM ranked)"""
)


#: What rules, reasons and questions read of a unit here; nothing else goes through the search.
_READ = ("file", "start", "line", "column", "kind", "role", "level", "doc_type", "text", "code_spans", "heading_above")


def _marks(spark: SparkSession, d: str) -> planning.Marks:
    units = markdown.markdown_units(markup_queries.files(spark, d)).select(*_READ)
    units = units.withColumn("unit_id", F.concat_ws(":", "file", "line", "column"))
    return planning.marks(units, _PLANNED, {i: (F.expr(sql), run) for i, (sql, run) in _ABSTAIN.items()})


@register(_PLAN + " SELECT rule_id, outcome, count(*) AS n_units, count(DISTINCT file) AS n_files FROM planned GROUP BY rule_id, outcome")
def plan_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).first_of_run().counted()


@register(_PLAN + " SELECT unit_id, rule_id, outcome, reason FROM planned WHERE outcome IN ('finding', 'job', 'unknown')")
def plan_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).first_of_run().told(("unit_id",), "finding", "job", "unknown")


@register(
    _PLAN
    + ", jobs AS (SELECT unit_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM planned WHERE outcome = 'job' GROUP BY unit_id) "
    + "SELECT unit_id, rules, 6 + length(text) + CASE WHEN heading_above IS NOT NULL AND ("
    + " OR ".join(f"contains(',' || rules || ',', ',{r.id},')" for r in _PLANNED if r.asks and "headingAbove" in r.asks)
    + ") THEN 10 + length(heading_above) ELSE 0 END + CASE WHEN "
    + " OR ".join(f"contains(',' || rules || ',', ',{r.id},')" for r in _PLANNED if r.asks and "docType" in r.asks)
    + " THEN 11 + length(doc_type) ELSE 0 END + CASE WHEN "
    + " OR ".join(f"contains(',' || rules || ',', ',{r.id},')" for r in _PLANNED if r.asks and "role" in r.asks)
    + " THEN 7 + length(role) ELSE 0 END AS state_chars FROM jobs JOIN seen_units USING (unit_id)"
)
def plan_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Requests of units, each with its questions and the length of its state; no unit here needs two requests."""
    made = _marks(spark, d).jobs("unit_id", "kind", "role", "doc_type", "text", "heading_above")
    return made.select("unit_id", F.array_join(F.array_sort("rule_ids"), ",").alias("rules"), F.length("state").cast("long").alias("state_chars"))


_RULE_ROWS = ", ".join(f"({_quoted(r.id)}, {_quoted(r.category)})" for r in _PLANNED)


@register(
    _PLAN
    + f", rules(rule_id, category) AS (VALUES {_RULE_ROWS}) SELECT r.rule_id, r.category, count(*) FILTER (outcome NOT IN ('out_of_scope', 'precondition')) AS eligible, count(*) FILTER (outcome = 'finding') AS answered, "
    + "count(*) FILTER (outcome = 'negative') AS negative, count(*) FILTER (outcome = 'job') AS pending, count(*) FILTER (outcome = 'unknown') AS unknown FROM rules r LEFT JOIN planned p USING (rule_id) GROUP BY r.rule_id, r.category"
)
def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d).coverage()


def _mendable(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): each line of a document as a paragraph with quotes, dots, a product and a size, and code with the same."""
    plain = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z]+", " "))
    lines = F.filter(F.transform(F.split("text", "\n", -1), plain), lambda x: x != "")
    made = F.transform(lines, lambda t: F.concat(F.lit('He said "'), t, F.lit("\"... it's 3 x 4 `\"code\"...` in 10 px.")))
    return spread(read(spark, d, "documents")).select(F.concat(F.lit("docs/src0/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.array_join(made, "\n\n").alias("text"))


@register(
    """WITH texts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL)
SELECT 'docs/src0/' || doc_id || '.md' AS file, CAST(2 * len(lines) AS INTEGER) AS n_edits, array_to_string(list_transform(lines, lambda t: 'He said “' || t || '”… it’s 3×4 `"code"...` in 10' || chr(160) || 'px.'), chr(10) || chr(10)) AS text
FROM texts WHERE len(lines) > 0"""
)
def fixed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files after the fixes of all findings that act; code in them stays as it is."""
    files = _mendable(spark, d)
    # Only what rules and fixes read of a unit goes on to the rules.
    units = markdown.markdown_units(files).select("file", "kind", "role", "doc_type", "line", "text", "code_spans", "fix_ranges")
    found = run_lint(files, rules=fixer.mending(RULES), unit=units).findings
    return fixer.apply_edits(files, fixer.edits(found, RULES)).select("file", "n_edits", "text")
