"""Registered queries of the rule engine, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom import component_queries, markup_queries, plan_queries, reference_queries  # noqa: F401  they register their queries
from proseloom.functions import globs, stats, text
from proseloom.operators import evaluation, judge, mechanical, repetition, structure, units
from proseloom.operators import findings as reduce
from proseloom.plans.catalogue import RULES, Rule
from proseloom.plans.lint import LintResult, run_lint
from proseloom.registry import QUERIES, SQL, Query
from proseloom.registry import read as _read
from proseloom.registry import register as _register
from proseloom.sources.shared import spread

def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files docs/<source>/<id>.md."""
    return spread(_read(spark, d, "documents")).select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")


_FILES = "SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, doc_id, text FROM documents"
_LINES = f"SELECT file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({_FILES}) WHERE text IS NOT NULL"
_UNITS = f"""
WITH lines AS ({_LINES}),
placed AS (SELECT *, CAST(sum(length(raw) + 1) OVER (PARTITION BY file ORDER BY line) - length(raw) - 1 AS BIGINT) AS start FROM lines),
units AS (
  SELECT file, substr(sha256(file || chr(0) || 'paragraph' || chr(0) || CAST(start AS VARCHAR)), 1, 16) AS unit_id, line, start,
    trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text,
    CASE WHEN file LIKE 'docs/src0/%' THEN 'howto' WHEN file LIKE 'docs/src1%' THEN 'ui' ELSE 'explanation' END AS doc_type
  FROM placed WHERE regexp_matches(raw, '[^ \\t\\n\\r\\f\\v]'))
"""
#: Patterns without look-around that fire on the same units; those of the other rules serve as they are.
_FIRES = {
    "typography-dashes": r"\S--\S|\p{L} - \p{L}",
    "typography-multiplication-sign": r"(?:^|[^\w.])[1-9]\d*\s?x\s?\d+(?:[^\w.%]|$)",
    "typography-nbsp-value-unit": r"\d (?:px|pt|em|rem|ms|min|KB|MB|GB|TB|kg|km|cm|mm|fps|%)(?:[^\p{L}\d]|$)",
    "typography-straight-quotes": r"""\"|\p{L}'\p{L}|\s'\d""",
}
_BY_ID = {r.id: r for r in RULES}
_PASSIVE, _MIDPOINTS = _BY_ID["copywriting-passive-voice"], _BY_ID["typography-midpoint-separators"]


def _re2(rule: Rule) -> str:
    """The rule's pattern for DuckDB."""
    plain = _FIRES.get(rule.id) or rule.pattern.replace("""(?<!["“‘'])""", """(?:^|[^"“‘'])""")
    return "(?i)" + plain if "i" in rule.flags else plain


def _fires(rule: Rule) -> str:
    """SQL that is true where the rule fires on ``text``."""
    if not rule.phrases:
        return f"regexp_matches(text, {_quoted(_re2(rule))})"
    edge = r"[^\p{L}\p{N}]"
    if rule.least == 1:
        return f"regexp_matches(text, {_quoted(f'(?i)(?:^|{edge})(?:{chr(124).join(rule.phrases)})(?:{edge}|$)')})"
    # Characters between words are doubled, so that phrases with one of them in common both count.
    doubled = "|".join("".join(c if c.isalnum() else c + c for c in p) for p in rule.phrases)
    wide = f"regexp_replace(text, '({edge})', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({wide}, {_quoted(f'(?i)(?:^|{edge})(?:{doubled})(?:{edge}|$)')})) >= {rule.least}"


def _meets_lines(rule: Rule) -> bool:
    """Whether a line of a document, a paragraph in the body of a text, can be eligible."""
    return "paragraph" in rule.kinds and (not rule.roles or "body" in rule.roles)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _outcomes_sql(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in filter(_meets_lines, rules):
        where = f" WHERE doc_type IN ({', '.join(map(_quoted, r.doc_types))})" if r.doc_types else ""
        parts.append(f"SELECT file, unit_id, line, {_quoted(r.id)} AS rule_id, {_quoted(r.category)} AS category, {_quoted(r.area)} AS domain, {'TRUE' if r.review_only else 'FALSE'} AS review_only, {_fires(r)} AS fired FROM units{where}")
    return _UNITS + ", outcomes AS (" + " UNION ALL ".join(parts) + "), findings AS (SELECT *, CASE WHEN review_only THEN 'review' ELSE 'act' END AS band FROM outcomes WHERE fired)"


_RULE_ROWS = ", ".join(f"({_quoted(r.id)}, {_quoted(r.category)}, {_quoted(r.area)}, {_quoted(r.tier)})" for r in RULES)
_RULES_SQL = f", rules(rule_id, category, domain, tier) AS (VALUES {_RULE_ROWS})"
#: Outcomes of the rules that their pattern decides, and of all rules with a pattern.
_OUTCOMES = _outcomes_sql(mechanical.decided(RULES)) + _RULES_SQL
_HITS = _outcomes_sql(tuple(filter(mechanical.searched, RULES))) + _RULES_SQL


@_register(_UNITS + "SELECT file, unit_id, line, start, text, doc_type FROM units")
def units_from_text(spark: SparkSession, d: str) -> DataFrame:
    return units.line_units(_files(spark, d)).select("file", "unit_id", "line", "start", "text", "doc_type")


def _hits(files: DataFrame, pragmas: DataFrame | None = None) -> LintResult:
    """A run of every rule with a pattern; those with a question are for review, as no judge is asked."""
    return run_lint(files, pragmas=pragmas, nominated=True)


@_register(_HITS + "SELECT file, unit_id, line, rule_id, category, band FROM findings")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_files(spark, d)).findings.select("file", "unit_id", "line", "rule_id", "category", "band")


@_register(_UNITS + f"SELECT unit_id, len(regexp_extract_all(text, {_quoted(_re2(_PASSIVE))})) AS passive, len(regexp_extract_all(text, {_quoted(_re2(_MIDPOINTS))})) AS midpoints FROM units")
def rule_match_counts(spark: SparkSession, d: str) -> DataFrame:
    count = lambda r: F.size(mechanical.matches(r)).cast("long")
    return units.line_units(_files(spark, d)).select("unit_id", count(_PASSIVE).alias("passive"), count(_MIDPOINTS).alias("midpoints"))


@_register(_UNITS + f", hits AS (SELECT unit_id, regexp_extract_all(text, {_quoted(_re2(_MIDPOINTS))}) AS found FROM units) SELECT unit_id, array_to_string(found[1:3], ',') AS evidence FROM hits WHERE len(found) > 0")
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    return mechanical.hits(units.line_units(_files(spark, d)), (_MIDPOINTS,)).select("unit_id", F.array_join("evidence", ",").alias("evidence"))


def _scorecard(by: str) -> Query:
    def card(spark: SparkSession, d: str) -> DataFrame:
        result = _hits(_files(spark, d))
        return reduce.scorecard(result.findings, result.rules, by)

    card.__name__ = f"scorecard_by_{by.removesuffix('_id')}"
    return card


for _by in ("category", "domain", "rule_id"):
    _register(_HITS + f"SELECT r.{_by}, count(*) FILTER (WHERE band = 'act') AS act, count(*) FILTER (WHERE band = 'review') AS review, CAST(0 AS BIGINT) AS suppressed FROM (SELECT DISTINCT {_by} FROM rules) r LEFT JOIN findings f ON r.{_by} = f.{_by} GROUP BY r.{_by}")(_scorecard(_by))


@_register(_HITS + "SELECT r.rule_id, count(o.unit_id) AS eligible, count(*) FILTER (WHERE o.fired) AS answered, count(*) FILTER (WHERE NOT o.fired) AS negative FROM rules r LEFT JOIN outcomes o ON r.rule_id = o.rule_id GROUP BY r.rule_id")
def coverage_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_files(spark, d)).counts


@_register(_HITS + "SELECT rule_id, count(*) AS n FROM findings GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5")
def top_rules(spark: SparkSession, d: str) -> DataFrame:
    return reduce.top_rules(_hits(_files(spark, d)).findings, 5)


@_register(_HITS + "SELECT count(*) AS findings, count(*) FILTER (WHERE band = 'act') AS failing, CASE WHEN count(*) FILTER (WHERE band = 'act') > 0 THEN 1 ELSE 0 END AS exit_code FROM findings")
def exit_summary(spark: SparkSession, d: str) -> DataFrame:
    return reduce.exit_summary(_hits(_files(spark, d)).findings)


@_register("SELECT CAST(0 AS BIGINT) AS findings, CAST(0 AS BIGINT) AS failing, 2 AS exit_code FROM range(1)")
def exit_of_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A strict run whose selection is empty fails with code 2."""
    result = run_lint(_files(spark, d).where("file like '%.none'"))
    return reduce.exit_summary(result.findings, units=result.units)


@_register(_OUTCOMES + "SELECT count(*) AS findings, count(*) FILTER (WHERE band = 'act') AS failing, 2 AS exit_code FROM findings WHERE file LIKE '%/src1/%'")
def exit_of_unfinished_run(spark: SparkSession, d: str) -> DataFrame:
    """A run that was stopped fails with code 2, whatever it found."""
    result = run_lint(_files(spark, d).where("file like '%/src1/%'"))
    return reduce.exit_summary(result.findings, units=result.units, complete=False)


@_register(_OUTCOMES + """SELECT file, rule_id, line, row_number() OVER (PARTITION BY file ORDER BY line, CASE band WHEN 'act' THEN 0 ELSE 1 END, CASE WHEN rule_id IN (SELECT rule_id FROM major) THEN 0 ELSE 1 END, rule_id, unit_id) AS place
  FROM findings""".replace("SELECT file", ", major(rule_id) AS (VALUES " + ", ".join(f"({_quoted(r.id)})" for r in RULES if r.severity == "major") + ") SELECT file", 1))
def finding_order(spark: SparkSession, d: str) -> DataFrame:
    return reduce.places(run_lint(_files(spark, d)).findings).select("file", "rule_id", "line", "place")


@_register(_HITS + ", pragmas AS (SELECT DISTINCT file, line FROM lines WHERE line % 5 = 1) SELECT f.file, f.line, f.rule_id, p.file IS NOT NULL AS suppressed FROM findings f LEFT JOIN (SELECT DISTINCT file, line + k AS line FROM pragmas, (VALUES (0), (1)) AS t(k)) p ON f.file = p.file AND f.line = p.line")
def suppression(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).where("text is not null")
    pragmas = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).select("file", (F.col("at") + 1).alias("line")).where("line % 5 = 1").withColumn("rule_id", F.lit("all"))
    return _hits(files, pragmas).findings.select("file", "line", "rule_id", "suppressed")


@_register(_HITS + "SELECT file, line, rule_id FROM findings WHERE line BETWEEN 2 AND 4")
def changed_line_filter(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    changed = structure.changed_ranges(files.select("file", F.lit("@@ -1,2 +2,3 @@ x").alias("patch")))
    return reduce.on_changed_lines(_hits(files).findings, changed).select("file", "line", "rule_id")


# Findings for dedupe: order lines as units, suppliers as rules, return flags as categories.
_CANDIDATES = "SELECT CAST(l_orderkey AS VARCHAR) AS unit_id, 'rule-' || (l_suppkey % 3) AS rule_id, l_returnflag AS category, CAST(l_discount AS DOUBLE) * 10 AS probability, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS seq, CASE WHEN CAST(l_discount AS DOUBLE) * 10 >= 0.5 THEN 'act' ELSE 'review' END AS band, l_suppkey % 5 = 0 AS suppressed FROM lineitem"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_discount").cast("double") * 10
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"), F.concat(F.lit("rule-"), (F.col("l_suppkey") % 3).cast("string")).alias("rule_id"), F.col("l_returnflag").alias("category"), p.alias("probability"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("seq"), F.when(p >= 0.5, "act").otherwise("review").alias("band"), (F.col("l_suppkey") % 5 == 0).alias("suppressed"))


@_register(f"SELECT unit_id, rule_id, probability, seq FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, rule_id ORDER BY probability DESC, seq) AS n FROM ({_CANDIDATES})) WHERE n = 1")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return reduce.dedupe_exact(_candidates(spark, d)).select("unit_id", "rule_id", "probability", "seq")


@_register(f"WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, category ORDER BY CASE band WHEN 'act' THEN 0 ELSE 1 END, probability DESC, seq) AS n FROM c WHERE NOT suppressed) SELECT unit_id, category, max(CASE WHEN n = 1 THEN rule_id END) AS rule_id, max(CASE WHEN n = 1 THEN band END) AS band, max(CASE WHEN n = 1 THEN seq END) AS seq, FALSE AS suppressed, coalesce(string_agg(CASE WHEN n > 1 THEN rule_id END, ',' ORDER BY n), '') AS also FROM r GROUP BY unit_id, category UNION ALL SELECT unit_id, category, rule_id, band, seq, suppressed, '' AS also FROM c WHERE suppressed")
def dedupe_category(spark: SparkSession, d: str) -> DataFrame:
    return reduce.merge_categories(_candidates(spark, d)).select("unit_id", "category", "rule_id", "band", "seq", "suppressed", F.array_join("also", ",").alias("also"))


# Labelled pairs: quality as the label, a function of the length as the probability, the source as the rule.
_PAIRS = "SELECT d.doc_id, d.source AS rule_id, l.quality = 1 AS label, (d.n_chars % 101) / 100.0::DOUBLE AS probability FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_WILSON = "(({s} / {n}::DOUBLE + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) {sign} 1.96 / (1 + 1.96 * 1.96 / {n}) * sqrt({s} / {n}::DOUBLE * (1 - {s} / {n}::DOUBLE) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n})))"


def _low(s: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {_WILSON.format(s=s, n=n, sign='-')}) END"


def _high(s: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, {_WILSON.format(s=s, n=n, sign='+')}) END"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    joined = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", F.col("source").alias("rule_id"), (F.col("quality") == 1).alias("label"), (F.col("n_chars") % 101 / 100.0).alias("probability"))


@_register(f"""WITH c AS (SELECT rule_id, count(*) FILTER (WHERE label AND probability >= 0.7) AS tp, count(*) FILTER (WHERE NOT label AND probability >= 0.7) AS fp, count(*) FILTER (WHERE label AND probability < 0.7) AS fn, count(*) FILTER (WHERE NOT label AND probability < 0.7) AS tn FROM ({_PAIRS}) GROUP BY rule_id),
r AS (SELECT *, tp + fp AS pp, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall FROM c)
SELECT rule_id, tp, fp, fn, tn, precision, recall, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END AS tnr, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_pairs(spark, d), ["rule_id"], 0.7).drop("precision_low", "precision_high")


@_register(f"WITH c AS (SELECT rule_id, count(*) FILTER (WHERE label) AS s, count(*) AS n FROM ({_PAIRS}) GROUP BY rule_id) SELECT rule_id, round({_low('s', 'n')}, 9) AS low, round({_high('s', 'n')}, 9) AS high FROM c")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = _pairs(spark, d).groupBy("rule_id").agg(F.count_if("label").alias("s"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return c.select("rule_id", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@_register(f"WITH p AS (SELECT *, {' + '.join(f'CASE WHEN probability >= {i / 10} THEN 1 ELSE 0 END' for i in range(1, 10))} AS bucket FROM ({_PAIRS})) SELECT CAST(b AS INTEGER) AS bucket, count(p.doc_id) AS n, round(coalesce(avg(probability), 0), 9) AS mean_probability, round(coalesce(avg(CASE WHEN label THEN 1.0 WHEN NOT label THEN 0.0 END), 0), 9) AS positive_rate FROM range(10) t(b) LEFT JOIN p ON p.bucket = b GROUP BY b")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_pairs(spark, d)).select("bucket", "n", F.round("mean_probability", 9).alias("mean_probability"), F.round("positive_rate", 9).alias("positive_rate"))


@_register(f"""WITH p AS ({_PAIRS}), g AS (SELECT t FROM (VALUES {', '.join(f'({t})' for t in evaluation.GRID)}) x(t)),
n AS (SELECT rule_id, count(*) AS n, count(*) FILTER (WHERE label) AS pos FROM p GROUP BY rule_id),
c AS (SELECT p.rule_id, g.t, count(*) FILTER (WHERE label AND probability >= g.t) AS tp, count(*) FILTER (WHERE probability >= g.t) AS pp FROM p, g GROUP BY p.rule_id, g.t),
f AS (SELECT rule_id, min(t) AS t FROM c WHERE pp > 0 AND {_low('tp', 'pp')} >= 0.8 GROUP BY rule_id)
SELECT n.rule_id, n.n, CASE WHEN n.n >= 10 THEN CAST(f.t AS DOUBLE) END AS chosen, CASE WHEN n.n < 10 THEN 'insufficient' WHEN f.t IS NULL THEN 'demote' WHEN f.t = 0.7 THEN 'keep' WHEN f.t > 0.7 THEN 'raise' ELSE 'lower' END AS action FROM n LEFT JOIN f ON n.rule_id = f.rule_id""")
def threshold_tuning(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.choose_thresholds(_pairs(spark, d)).select("rule_id", "n", "chosen", "action")


_PAIRED = f"SELECT rule_id, label = (probability >= 0.5) AS a_correct, label = (probability >= 0.2) AS b_correct FROM ({_PAIRS})"


def _erfc_sql(x: str) -> str:
    poly = str(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        poly = f"({c} + (1 / (1 + 0.5 * {x})) * {poly})"
    return f"(1 / (1 + 0.5 * {x})) * exp(-{x} * {x} + {poly})"


@_register(f"WITH c AS (SELECT rule_id, count(*) FILTER (WHERE NOT a_correct AND b_correct) AS n01, count(*) FILTER (WHERE a_correct AND NOT b_correct) AS n10 FROM ({_PAIRED}) GROUP BY rule_id), z AS (SELECT *, CASE WHEN n01 + n10 = 0 THEN 0.0::DOUBLE ELSE sqrt(power(greatest(0.0, abs(n01 - n10) - 1.0), 2)::DOUBLE / (n01 + n10) / 2) END AS x FROM c) SELECT rule_id, n01, n10, round(CASE WHEN n01 + n10 = 0 THEN 1.0 ELSE {_erfc_sql('x')} END, 6) AS p_value FROM z")
def paired_test(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("rule_id", (F.col("label") == (F.col("probability") >= 0.5)).alias("a_correct"), (F.col("label") == (F.col("probability") >= 0.2)).alias("b_correct"))
    return evaluation.paired_test(p, ["rule_id"]).withColumn("p_value", F.round("p_value", 6))


@_register(None)
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The seeded 80/20 split; its 32-bit arithmetic is tested against a plain version."""
    return _read(spark, d, "documents").select("doc_id", stats.split_of(F.concat(F.lit("item-"), F.col("doc_id").cast("string"))).alias("split"))


@_register("SELECT source, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT source, CASE WHEN doc_id % 7 = 0 THEN 'holdout' ELSE 'dev' END AS split FROM documents) GROUP BY source HAVING count(*) > 1")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    items = _read(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 7 == 0, "holdout").otherwise("dev"))
    return evaluation.split_leaks(items, "source")


@_register(f"SELECT rule_id, count(*) FILTER (WHERE label) AS positive, count(*) FILTER (WHERE NOT label) AS negative FROM ({_PAIRS}) GROUP BY rule_id")
def label_balance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.label_balance(_pairs(spark, d), ["rule_id"])


@_register(f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE (probability >= 0.7) <> (1 - probability >= 0.7)) AS flips FROM ({_PAIRS})) SELECT n, flips, flips / n::DOUBLE AS rate, round({_low('flips', 'n')}, 9) AS low, round({_high('flips', 'n')}, 9) AS high FROM c")
def flip_rate(spark: SparkSession, d: str) -> DataFrame:
    a = _pairs(spark, d)
    return evaluation.flip_rate(a, a.withColumn("probability", 1 - F.col("probability")), ["doc_id"]).withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


@_register("SELECT d.source, count(*) AS n, count(*) FILTER (WHERE (l.quality = 1) = (l.toxic = 0)) AS agreed, count(*) FILTER (WHERE (l.quality = 1) = (l.toxic = 0)) / count(*)::DOUBLE AS rate, count(*) >= 20 AND count(*) FILTER (WHERE (l.quality = 1) = (l.toxic = 0)) / count(*)::DOUBLE >= 0.9 AS trusted FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL GROUP BY d.source")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    labels = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluation.agreement(labels.select("doc_id", "source", (F.col("quality") == 1).alias("label")), labels.select("doc_id", "source", (F.col("toxic") == 0).alias("label")), ["doc_id", "source"], "source")


@_register("SELECT source, quality, doc_id, n AS place FROM (SELECT d.source, l.quality, l.doc_id, CAST(row_number() OVER (PARTITION BY d.source, l.quality ORDER BY l.doc_id) AS INTEGER) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id) WHERE n <= 3")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    items = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluation.stratified_sample(items, ["source", "quality"], "doc_id").select("source", "quality", "doc_id", "place")


@_register(f"WITH c AS (SELECT rule_id, 0 AS leaks, count(*) AS expected, count(*) AS n, count(*) FILTER (WHERE label) AS positives, count(*) FILTER (WHERE NOT label) AS negatives FROM ({_PAIRS}) GROUP BY rule_id), w AS (SELECT *, {_low('positives', 'n')} AS low FROM c) SELECT rule_id, CASE WHEN n < 10 THEN 'too few' WHEN positives = 0 OR negatives = 0 THEN 'one class' WHEN low < 0.8 THEN 'precision' ELSE 'clear' END AS reason, n >= 10 AND positives > 0 AND negatives > 0 AND low >= 0.8 AS eligible FROM w")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    c = _pairs(spark, d).groupBy("rule_id").agg(F.lit(0).alias("leaks"), F.count("*").alias("expected"), F.count("*").alias("n"), F.count_if("label").alias("positives"), F.count_if(~F.col("label")).alias("negatives"))
    return evaluation.promotion(c.withColumn("precision_low", stats.wilson(F.col("positives"), F.col("n"))[0])).select("rule_id", "reason", "eligible")


_WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@_register(f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT {_WORDS.format(x='text')} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT id, array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 4)) AS i FROM w)),
a AS (SELECT DISTINCT array_to_string(w[i:i+5], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM q))
SELECT id, gram FROM g WHERE gram IN (SELECT gram FROM a)""")
def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return repetition.ngram_overlap(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@_register(None)
def idea_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Earlier sentences that say the same, conversations as files and turns as units; tested against a plain version."""
    turns = _read(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    return repetition.earlier_sentences(turns)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


@_register(None)
def repeated_blocks(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_blocks(_lines(spark, d))


@_register(None)
def comment_runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files: every third line commented out, by rule; tested on code fixtures."""
    return repetition.comment_runs(_lines(spark, d).withColumn("text", F.concat(F.lit("// const "), "text", F.lit(";"))))


_HTML = """WITH b AS (SELECT page_id AS file, unnest(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>|<p\\b[^>]*>.*?</p>')) AS raw, CAST(generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>|<p\\b[^>]*>.*?</p>'), 1) - 1 AS INTEGER) AS "at" FROM pages), r AS (SELECT file, "at", CASE WHEN lower(raw[2]) = 'p' THEN 0 ELSE CAST(raw[3] AS INTEGER) END AS level, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^<[^>]*>', ''), '</[^>]*>$', ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM b)"""


@_register(_HTML + """ SELECT file, "at", level, text, last_value(CASE WHEN level > 0 THEN substr(text, 1, 120) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_above, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "at") AS BIGINT) AS section FROM r""")
def heading_carry(spark: SparkSession, d: str) -> DataFrame:
    return structure.with_headings(structure.blocks(_read(spark, d, "pages")))


@_register(_HTML + """ SELECT file, "at", last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_text, first_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY "at" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_text FROM r""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return structure.neighbours(structure.blocks(_read(spark, d, "pages"))).select("file", "at", "previous_text", "next_text")


@_register(_HTML + """ SELECT file, "at", level, text FROM (SELECT *, lead(level) OVER (PARTITION BY file ORDER BY "at") AS nl FROM r) WHERE level > 0 AND (nl IS NULL OR (nl > 0 AND nl <= level))""")
def empty_sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.empty_sections(structure.blocks(_read(spark, d, "pages"))).select("file", "at", "level", "text")


@_register(_HTML.replace("FROM pages)", "FROM (SELECT page_id, regexp_replace(html, '<p><b>(.*?)</p>', '<h4>\\1</h4>') AS html FROM pages))") + """ SELECT file, "at", level, text FROM (SELECT *, lag(level) OVER (PARTITION BY file ORDER BY "at") AS before FROM r WHERE level > 0) WHERE level > before + 1""")
def heading_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose first paragraph in bold is made a fourth-level heading, as each has a single heading."""
    html = F.col("html")
    first = F.regexp_extract(html, r"<p><b>(.*?)</p>", 0)
    made = F.concat(F.lit("<h4>"), F.regexp_extract(html, r"<p><b>(.*?)</p>", 1), F.lit("</h4>"))
    at = F.position(first, html)
    pages = _read(spark, d, "pages").withColumn("html", F.when(first == "", html).otherwise(F.concat(F.substring(html, F.lit(1), at - 1), made, F.substring(html, at + F.length(first), F.length(html)))))
    return structure.heading_jumps(structure.blocks(pages)).select("file", "at", "level", "text")


_STATE = "substr('TEXT: ' || text, 1, 5250)"
_JOBS = f"SELECT doc_id, sha256('q' || chr(10) || 'm' || chr(10) || {_STATE}) AS key, {_STATE} AS state FROM documents WHERE text IS NOT NULL AND text <> ''"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").where("text is not null and text <> ''").withColumn("state", judge.state_of(("TEXT", F.col("text"))))
    return docs.select("doc_id", judge.answer_key(F.lit("q"), F.lit("m"), F.col("state")).alias("key"), "state")


@_register(f"SELECT key, count(*) AS consumers, count(*) - 1 AS shared, CAST(ceil(length(min(state)) / 3.5) AS BIGINT) AS tokens FROM ({_JOBS}) GROUP BY key")
def request_grouping(spark: SparkSession, d: str) -> DataFrame:
    return judge.shared_requests(_jobs(spark, d)).drop("state")


@_register(f"WITH r AS (SELECT key, min(state) AS state FROM ({_JOBS}) GROUP BY key), c AS (SELECT DISTINCT key FROM ({_JOBS}) WHERE doc_id % 2 = 0) SELECT count(*) FILTER (WHERE c.key IS NOT NULL) AS hits, count(*) FILTER (WHERE c.key IS NULL) AS misses FROM r LEFT JOIN c ON r.key = c.key")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    cache = jobs.where("doc_id % 2 = 0").select("key", F.lit(0.5).alias("probability"), F.lit(1).alias("written"))
    return judge.with_cache(judge.shared_requests(jobs), cache).agg(F.count_if(F.col("probability").isNotNull()).alias("hits"), F.count_if(F.col("probability").isNull()).alias("misses"))


@_register(f"SELECT count(*) AS requests, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(t) AS BIGINT) / 1e6 * 0.042 AS dollars FROM (SELECT ceil(length(min(state)) / 3.5) AS t FROM ({_JOBS}) GROUP BY key)")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return judge.cost(judge.shared_requests(_jobs(spark, d)).withColumn("probability", F.lit(None).cast("double")))


@_register(f"SELECT DISTINCT key, (('0x' || substr(key, 1, 8))::BIGINT) / 4294967295.0::DOUBLE AS probability FROM ({_JOBS})")
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """The way of a request through an injected judge; this one is a fixture, whose answer is read off the key."""
    fixture = lambda asked: asked.select("key", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / 0xFFFFFFFF).alias("probability"))
    return judge.answers(judge.shared_requests(_jobs(spark, d)).withColumn("probability", F.lit(None).cast("double")), fixture)


@_register(None)
def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chunks of each source's questions, a row for each document; tested against a plain loop."""
    sizes = _read(spark, d, "documents").withColumn("tokens", F.ceil(F.col("n_chars") / 3.5).cast("long"))
    return judge.chunk_rows(sizes, "source", "doc_id", "tokens")


@_register("SELECT doc_id, replace(text, '...', '…') AS ellipsis, regexp_replace(text, '(\\d) (px|pt|em|rem|ms|min|KB|MB|GB|TB|kg|km|cm|mm|fps|%)([^\\p{L}\\d]|$)', '\\1' || chr(160) || '\\2\\3', 'g') AS spaced, replace(regexp_replace(replace(regexp_replace(text, '(^|[\\s(\\[{—–-])\"', '\\1“', 'g'), '\"', '”'), '(^|[\\s(\\[{])''([^\\s\\d])', '\\1‘\\2', 'g'), '''', '’') AS quoted FROM documents")
def text_fixes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", text.fix_ellipsis(t).alias("ellipsis"), text.fix_unit_space(t).alias("spaced"), text.fix_quotes(t).alias("quoted"))


@_register("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*')) AS prose_words, len(list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s) <> '')) AS sentences, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", text.count_words(t).cast("long").alias("words"), text.prose_words(t).cast("long").alias("prose_words"), F.size(text.sentences(t)).cast("long").alias("sentences"), text.token_estimate(t).alias("tokens"))


@_register("SELECT CASE WHEN file LIKE 'docs/src0/%' THEN 'howto' WHEN file LIKE 'docs/src1%' THEN 'ui' ELSE 'explanation' END AS doc_type, count(*) AS files FROM (SELECT 'docs/' || source || '/' || doc_id || '.md' AS file FROM documents) GROUP BY 1")
def docs_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(globs.first_match(F.col("file"), units.DOC_TYPES, "unknown").alias("doc_type")).agg(F.count("*").alias("files"))


@_register("SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, CASE WHEN source LIKE 'src1%' THEN 'docs/' || source ELSE 'docs' END AS folder FROM documents")
def nearest_manifest(spark: SparkSession, d: str) -> DataFrame:
    marks = _read(spark, d, "documents").where("source like 'src1%'").select(F.concat(F.lit("docs/"), "source").alias("folder")).distinct().union(spark.createDataFrame([("docs",)], "folder string")).withColumn("value", F.col("folder"))
    return structure.nearest_ancestor(_files(spark, d), marks).select("file", "folder")


def queries() -> dict[str, Query]:
    from proseloom import stream_queries  # noqa: F401  it registers its query, over the SQL of this module

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
