"""Rules compiled to columns over units: one pass tells which can match, and only those are searched for."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.functions import globs, text
from proseloom.functions.literals import Prefilter, without_literals
from proseloom.plans.catalogue import Rule

#: What a unit is taken to have where its table lacks the column.
DEFAULTS = {"role": "unknown", "in_code": False, "generated": False, "own_quotes": False}
_EVERYWHERE = ("**", "**/*")
#: Texts that the prefilter holds as Python strings at a time.
_SLICE = 1024


def pattern_of(rule: Rule) -> str:
    return text.phrase_pattern(list(rule.phrases)) if rule.phrases else text.portable(rule.pattern, rule.flags)


def searched(rule: Rule) -> bool:
    return bool(rule.pattern or rule.phrases)


def decides(rule: Rule) -> bool:
    """Whether a pattern or a check says if a rule has anything to report."""
    return searched(rule) or rule.check


def decided(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules that their pattern decides; the others ask a question."""
    return tuple(r for r in rules if r.tier == "mechanical")


def _scope(rule: Rule) -> tuple:
    return rule.kinds, *rule.scope


def _demands(rule: Rule) -> tuple:
    return rule.doc_types, rule.roles, rule.not_in_code, rule.not_generated, rule.own_quotes, rule.min_words


def scope_number(rule: Rule, rules: tuple[Rule, ...]) -> int:
    return list(dict.fromkeys(map(_scope, rules))).index(_scope(rule))


def demand_number(rule: Rule, rules: tuple[Rule, ...]) -> int:
    return list(dict.fromkeys(map(_demands, rules))).index(_demands(rule))


def _in_scope(kinds: tuple[str, ...], include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether a unit has a kind and a file that a rule is about; elements of rendered pages have an address, not a path."""
    inside = F.lit(True) if set(include) & set(_EVERYWHERE) else globs.matches_any(F.col("file"), list(include))
    return F.col("kind").isin(*kinds) & ((F.col("kind") == "element") | (inside & ~globs.matches_any(F.col("file"), list(exclude))))


def _meets(doc_types: tuple[str, ...], roles: tuple[str, ...], not_in_code: bool, not_generated: bool, own_quotes: bool, min_words: int) -> Column:
    """Whether a unit meets a rule's preconditions; cheap tests first."""
    out = F.lit(True)
    if doc_types:
        out &= F.col("doc_type").isin(*doc_types)
    if roles:
        out &= F.col("role").isin(*roles)
    if not_in_code:
        out &= ~F.col("in_code")
    if not_generated:
        out &= ~F.col("generated")
    if not own_quotes:
        out &= ~(F.col("own_quotes") & F.col("kind").isin("paragraph", "heading") & F.col("file").rlike(r"\.mdx?$"))
    if min_words:
        out &= text.prose_words(F.col("text")) >= min_words
    return F.coalesce(out, F.lit(False))


def completed(units: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Units with every column that a condition reads, and what many rules share, worked out once: ``_seen``, the text with
    spaces over its code spans; ``_scopes`` and ``_demands``, which of the rules' distinct scopes and preconditions hold."""
    for name, value in DEFAULTS.items():
        if name not in units.columns:
            units = units.withColumn(name, F.lit(value))
    seen = F.col("text") if "code_spans" not in units.columns else F.when(F.size("code_spans") > 0, text.mask_spans(F.col("text"), F.col("code_spans"))).otherwise(F.col("text"))
    none = F.array().cast("array<boolean>")
    scopes, demands = dict.fromkeys(map(_scope, rules)), dict.fromkeys(map(_demands, rules))
    return units.withColumns({"_seen": seen, "_scopes": F.array(*(_in_scope(*x) for x in scopes)) if rules else none, "_demands": F.array(*(_meets(*x) for x in demands)) if rules else none})


def eligible(rule: Rule, rules: tuple[Rule, ...]) -> Column:
    """Whether a unit of ``completed(units, rules)`` is in a rule's scope and meets its preconditions."""
    return F.get("_scopes", F.lit(scope_number(rule, rules))) & F.get("_demands", F.lit(demand_number(rule, rules)))


def matches(rule: Rule, seen: str = "text") -> Column:
    """All matches of a rule in order; none where its ``absent`` pattern occurs."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(seen, F.lit(pattern_of(rule)), F.lit(0))
    return F.when(F.col(seen).rlike(text.portable(rule.absent, rule.flags)), none).otherwise(found) if rule.absent else found


def meeting(rules: tuple[Rule, ...], kinds: set[str], roles: set[str]) -> tuple[Rule, ...]:
    """The rules that units of these kinds and roles can be eligible for; a plan holds no column for the others."""
    return tuple(r for r in rules if kinds & set(r.kinds) and (not r.roles or roles & set(r.roles)))


def _nominated(units: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``_may``, the numbers of the rules whose literals a unit's text holds, and ``_code``, a script's text without
    its strings and comments, where a rule needs it: one pass of one automaton for all rules."""
    searches = [(r.pattern, r.phrases) for r in rules]
    code = any(r.code_only for r in rules)
    columns = units.columns
    seen, kind = columns.index("_seen"), columns.index("kind")

    def find(batches):
        may = Prefilter(searches)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = part.column(seen).to_pylist()
                arrays = [*part.columns, pa.array([may(t or "") for t in texts], pa.list_(pa.int32()))]
                if code:
                    arrays.append(pa.array([without_literals(t) if k == "source" and t else t for t, k in zip(texts, part.column(kind).to_pylist())], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "_may", *(["_code"] if code else [])])

    schema = T.StructType([*units.schema.fields, T.StructField("_may", T.ArrayType(T.IntegerType()))])
    return units.mapInArrow(find, schema.add("_code", T.StringType()) if code else schema)


def _by_rule(number: Column, rules: tuple[Rule, ...], of) -> Column:
    """The column ``of`` a rule, by its number among the rules."""
    return reduce(lambda out, pair: out.when(number == pair[0], of(pair[1])), enumerate(rules[1:], 1), F.when(number == 0, of(rules[0])))


def scanned(units: DataFrame, rules: tuple[Rule, ...], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Units with ``hits``: (rule_id, n_matches, evidence, offset) of every rule with a pattern or check that fires on them.

    ``checks`` has, by rule id, the evidence of rules that a check decides, null where they do not fire.
    Evidence is the first three matches, 80 characters each, and offset where the first begins (UTF-16 units, from 0).
    Of all rules only those that the prefilter names are searched for, in the unit's own row; nothing is shuffled.
    """
    rows = with_hits(judged(units, rules, checks), rules, checks)
    return rows.drop("_fired", "_said", "_may", "_code")


def with_hits(rows: DataFrame, rules: tuple[Rule, ...], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Units of ``judged(units, rules, checks)`` with the ``hits`` of ``scanned``."""
    found = tuple(r for r in rules if searched(r))
    kind = "array<struct<rule_id:string,n_matches:int,evidence:array<string>,offset:int>>"
    said = lambda k: F.get("_said", F.lit(k))
    proven = [F.when(said(k).isNotNull(), F.struct(F.lit(r.id), F.lit(1), F.array(said(k)), F.lit(None).cast("int"))) for k, r in enumerate(checked(rules, checks))]
    proven = (F.array_compact(F.array(*proven)) if proven else F.array()).cast(kind)
    if not found:
        return rows.withColumn("hits", proven)
    matched = F.transform("_fired", lambda i: F.struct(i.alias("i"), _by_rule(i, found, _matches).alias("m")))
    hit = lambda h: F.struct(*(c.alias(name) for name, c in _told(h["i"], h["m"], found).items()))
    return rows.withColumn("hits", F.concat(F.transform(matched, hit).cast(kind), proven))


def checked(rules: tuple[Rule, ...], checks: Mapping[str, Column] | None) -> list[Rule]:
    """The rules that one of the checks decides."""
    return [r for r in rules if r.check and checks and r.id in checks]


def judged(units: DataFrame, rules: tuple[Rule, ...], checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Units of ``completed(units, rules)`` with ``_fired``, the numbers among the rules with a pattern of those that fire, and
    ``_said``, the evidence of each of ``checked(rules, checks)`` that fires."""
    found = tuple(r for r in rules if searched(r))
    base = completed(units, rules)
    rows = _fired(base, found, rules) if found else base.withColumn("_fired", F.array().cast("array<int>"))
    said = [F.when(eligible(r, rules), checks[r.id]) for r in checked(rules, checks)]
    return rows.withColumn("_said", F.array(*said) if said else F.array().cast("array<string>"))


def _searched_in(rule: Rule) -> str:
    return "_code" if rule.code_only else "_seen"


def _matches(rule: Rule) -> Column:
    return matches(rule, _searched_in(rule))


def _fires(rule: Rule) -> Column:
    """Whether a rule matches often enough; where one match does, the search ends there."""
    if rule.least > 1:
        return F.size(_matches(rule)) >= rule.least
    seen = F.col(_searched_in(rule))
    once = seen.rlike(pattern_of(rule))
    return once & ~seen.rlike(text.portable(rule.absent, rule.flags)) if rule.absent else once


def _fired(base: DataFrame, found: tuple[Rule, ...], rules: tuple[Rule, ...]) -> DataFrame:
    """Units of ``completed(units, rules)`` with ``_fired``, the numbers among ``found`` of the rules that fire on them."""
    return _nominated(base, found).withColumn("_fired", F.filter("_may", lambda i: _by_rule(i, found, lambda r: eligible(r, rules) & _fires(r))))


def _told(i: Column, m: Column, found: tuple[Rule, ...]) -> dict[str, Column]:
    """What is told of the matches ``m`` of the i-th rule."""
    ids = F.array(*(F.lit(r.id) for r in found))
    # A match with look-around is found again where it was: of several places only the first counts.
    place = lambda r: F.regexp_instr(F.col(_searched_in(r)), F.lit(pattern_of(r)), F.lit(0)) - 1
    evidence = F.transform(F.slice(m, 1, 3), lambda x: F.substring(text.normalise(x), 1, 80))
    return {"rule_id": F.element_at(ids, i + 1), "n_matches": F.size(m), "evidence": evidence, "offset": _by_rule(i, found, place)}


def hits(units: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each unit and rule that fires on it: the unit's columns, rule_id, n_matches, evidence, offset.

    In a source unit the line is that of the first match.
    """
    found = tuple(r for r in rules if searched(r))
    if not found:
        return units.select(*units.columns, F.lit("").alias("rule_id"), F.lit(0).alias("n_matches"), F.array().cast("array<string>").alias("evidence"), F.lit(0).alias("offset")).where("false")
    # Outer, as Spark works out what an inner explode is given again to leave out empty ones; what is told of a match are
    # columns of its row, so that only those that are read are worked out.
    rows = _fired(completed(units, rules), found, rules).withColumn("_i", F.explode_outer("_fired")).where("_i is not null")
    rows = rows.withColumn("_m", _by_rule(F.col("_i"), found, _matches))
    told = _told(F.col("_i"), F.col("_m"), found)
    line = F.when(F.col("kind") == "source", F.col("line") + text.line_of(F.col("text"), told["offset"]) - 1).otherwise(F.col("line"))
    return rows.select(*(line.cast("long").alias(c) if c == "line" else c for c in units.columns), *(c.alias(name) for name, c in told.items()))


def outcomes(units: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each unit and eligible rule with a pattern: rule_id, n_matches, fired, evidence."""
    rows = scanned(units, rules)
    able = F.array_compact(F.array(*(F.when(eligible(r, rules), F.lit(r.id)) for r in rules if searched(r))))
    rows = rows.withColumn("rule_id", F.explode(able))
    rows = rows.withColumn("h", F.get(F.filter("hits", lambda h: h["rule_id"] == F.col("rule_id")), F.lit(0)))
    return rows.select(*units.columns, "rule_id", F.coalesce("h.n_matches", F.lit(0)).alias("n_matches"), F.col("h").isNotNull().alias("fired"), F.coalesce("h.evidence", F.array().cast("array<string>")).alias("evidence"))


def counts(units: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule_id, eligible, answered and negative units of each rule with a pattern, in one aggregation over units."""
    found = tuple(r for r in rules if searched(r))
    has = lambda r: F.exists("hits", lambda h: h["rule_id"] == r.id)
    sums = [F.struct(F.lit(r.id).alias("rule_id"), F.count_if(eligible(r, rules)).alias("eligible"), F.count_if(has(r)).alias("answered")) for r in found]
    rows = scanned(units, rules).agg(F.array(*sums).alias("rules")).select(F.explode("rules").alias("r")).select("r.*")
    return rows.withColumn("negative", F.col("eligible") - F.col("answered"))
