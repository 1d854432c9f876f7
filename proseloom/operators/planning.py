"""The plan of a run: what each rule makes of each unit, and the questions that a judge is left with.

One row a unit holds the outcomes of all rules; findings, jobs, unknowns, negatives and coverage are read from it.  The
outcomes are worked out as sets of rules, words of bits, and written out for those rules and units that somebody reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.functions.columns import let
from proseloom.operators import mechanical
from proseloom.plans.catalogue import Rule
from proseloom.sources.shared import settle

OUTCOMES = ("out_of_scope", "precondition", "unknown", "negative", "finding", "job")
#: Tokens of a state, of that of a source unit, and characters a token of dense units and of others.
STATE_TOKENS, SOURCE_TOKENS, DENSE, PLAIN = 1500, 6000, 3.0, 3.5
#: Context that a question may need, in the order of a state's lines: key, label, column of the unit, whether it is clipped.
CONTEXT = (
    ("headingAbove", "HEADING", "heading_above", True),
    ("docType", "DOC TYPE", "doc_type", False),
    ("element", "ELEMENT", "element", False),
    ("role", "ROLE", "role", False),
    ("brief", "BRIEF", "brief", True),
    ("earlier", "EARLIER", "earlier", True),
    ("section", "SECTION", "section", True),
)
_OUTCOME = "struct<rule_id:string,outcome:string,reason:string,n_matches:int,evidence:array<string>,offset:int>"


def _held(units: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in units.columns else F.lit(None).cast("string")


def _kind_budget(per_token: float | None = None) -> tuple[Column, Column]:
    """Tokens of a unit's state and characters a token: those given, or fewer for dense kinds."""
    chars = F.when(F.col("kind").isin("class-list", "element"), DENSE).otherwise(PLAIN) if per_token is None else F.lit(per_token)
    return F.when(F.col("kind") == "source", SOURCE_TOKENS).otherwise(STATE_TOKENS), chars


def build_state(units: DataFrame, wanted: Callable[[str], Column | bool], per_token: float | None = None) -> Column:
    """(state, truncated): the labelled lines that are wanted, by key, within the budget of tokens.

    Each line gets what the lines before it left; one that is too long is cut there and marked.  Where ``neighbours`` are
    wanted the text and the next unit's are compared.  A state has few lines, so the fold over them is short.
    """
    budget, per_token = _kind_budget(per_token)
    want = lambda key: F.lit(x) if isinstance(x := wanted(key), bool) else x
    line = lambda label, value, clip, when: F.when(when & value.isNotNull() & (value != ""), F.struct(F.lit(f"{label}: ").alias("label"), value.alias("value"), F.lit(clip).alias("clip")))
    following = _held(units, "next_text")
    pair = want("neighbours") & following.isNotNull() & (following != "")
    own = F.coalesce(F.col("text"), F.lit(""))
    lines = [line("FIRST", own, True, pair), line("SECOND", following, True, pair), line("TEXT", own, True, ~pair)]
    for key, label, column, clip in CONTEXT:
        value = _held(units, column)
        if key == "element":
            attr = _held(units, "attr")
            value = F.concat(value, F.when(attr.isNotNull(), F.concat(F.lit(" ("), attr, F.lit(")"))).otherwise(""))
        lines.append(line(label, value, clip, want(key)))
    tokens = lambda c: F.ceil(F.length(c) / per_token)

    def add(state: Column, x: Column) -> Column:
        room = F.greatest(F.lit(0), budget - tokens(state["text"]) - tokens(x["label"]))
        over = x["clip"] & (tokens(x["value"]) > room)
        value = F.when(over, F.concat(F.substring(x["value"], F.lit(1), F.floor(room * per_token).cast("int")), F.lit(" [truncated]"))).otherwise(x["value"])
        joined = F.concat(state["text"], F.when(state["text"] == "", "").otherwise("\n"), x["label"], value)
        return F.struct(joined.alias("text"), (state["truncated"] | over).alias("truncated"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("truncated"))
    return F.aggregate(F.array_compact(F.array(*lines)), start, add, lambda s: F.struct(s["text"].alias("state"), s["truncated"].alias("truncated")))


def missing_evidence(units: DataFrame, keys: tuple[str, ...], chars: float | None = None) -> Column:
    """Why a unit cannot answer a question that needs these keys: no section or neighbour, text made at run time, or too much."""
    out = F.when(F.lit(False), F.lit(""))
    if "section" in keys:
        section = _held(units, "section")
        dynamic = F.coalesce(F.col("dynamic"), F.lit(False)) if "dynamic" in units.columns else F.lit(False)
        out = out.when(section.isNull() | (section == ""), "Missing section context").when(dynamic & F.col("kind").isin("jsx-text", "attr-string"), "Dynamic text may supply the missing explanation or action")
    if "neighbours" in keys:
        following = _held(units, "next_text")
        out = out.when(following.isNull() | (following == ""), "Missing comparison neighbour")
    too_much = F.lit("Section comparison exceeds the context budget") if "section" in keys else F.when(F.col("kind") == "source", "Source exceeds the semantic context budget").otherwise("Text comparison exceeds the context budget")
    # A state well below the budget is not built to see that it fits.
    budget, per_token = _kind_budget(chars)
    used = [F.length("text"), *(F.length(_held(units, column)) for key, _, column, _ in CONTEXT if key in keys), *([F.length(_held(units, "next_text"))] if "neighbours" in keys else [])]
    total = sum((F.coalesce(x, F.lit(0)) for x in used), F.lit(20 * (len(used) + 1)))
    return out.when(F.when(total > budget * per_token - 2 * per_token * (len(used) + 1), build_state(units, lambda key: key in keys, chars)["truncated"]).otherwise(False), too_much)


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plan(units: DataFrame, rules: tuple[Rule, ...], abstentions: Mapping[str, tuple[Column, bool]] | None = None, checks: Mapping[str, tuple[Column, Column | None]] | None = None, per_token: float | None = None) -> DataFrame:
    """Units with ``outcomes``: for each rule one of ``OUTCOMES``, and a reason, the matches and the first one's place.

    A rule of another kind of unit or file is out of scope; a unit that fails a precondition is not asked.  A pattern that
    finds nothing is negative.  What it finds is a finding, or a job where the rule has a question; a question whose
    evidence is missing is unknown.  ``abstentions`` maps a rule's id to a reason column and whether the reason holds for
    the whole run: such a reason is kept for the first unit (by file and start) and a precondition for all others.
    ``checks`` has the evidence of rules that a check decides, and why the check abstains, both over the units' columns.
    ``per_token`` are the characters that the judge's tokens have on units of every kind, where they do not go by kind.
    Files that did not parse have no outcomes.  Everything is read off one row a unit: no shuffle but for reasons of a run,
    whose first units are written when the plan is made.
    """
    abstentions, checks = abstentions or {}, checks or {}
    once = {i: reason for i, (reason, run) in abstentions.items() if run}
    made = marks(units, rules, abstentions, checks, per_token, found=True)
    rows = made.rows.withColumn("outcomes", made.outcomes()).select(*units.columns, "outcomes")
    return _first_of_run(rows, _firsts(units, tuple(r for r in rules if r.id in once), once), once) if once else rows


#: Rules whose outcomes a word holds, a bit each.
_WORD = 63


def _union(parts) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(0).cast("long"))


@dataclass(frozen=True)
class Marks:
    """Units with the set of rules of each outcome, in ``rows``: words of bits, the i-th rule being bit i % 63 of word i // 63.

    ``rows`` also has the reasons of rules that abstain (``_abstained``, by ``held_back``), why evidence is missing
    (``_evidence``, by ``needs``), and ``_run``, the (rule_id, reason) of rules that are unknown for a reason of the run:
    one unit is unknown by it and for the others it is a precondition, which ``first_of_run`` settles.
    """

    rows: DataFrame
    rules: tuple[Rule, ...]
    held_back: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...]

    @property
    def width(self) -> int:
        return -(-len(self.rules) // _WORD)

    def words(self, *outcomes: str) -> list[str]:
        return [f"_{x}_{w}" for x in outcomes or OUTCOMES for w in range(self.width)]

    def mask(self, w: int, test: Callable[[Rule], bool]) -> Column:
        return F.lit(sum(1 << i for i, r in enumerate(self.rules[w * _WORD : (w + 1) * _WORD]) if test(r))).cast("long")

    def _table(self, *outcomes: str) -> Column:
        """The rules with each of the outcomes: their word among ``words(*outcomes)``, their bit, and places of their reasons."""
        rows = [
            {"rule_id": r.id, "outcome": x, "word": k * self.width + i // _WORD, "bit": 1 << i % _WORD, "abstains": self.held_back.index(r.id) if r.id in self.held_back else -1, "needs": self.needs.index(r.asks) if r.asks is not None else -1}
            for k, x in enumerate(outcomes)
            for i, r in enumerate(self.rules)
        ]
        value = lambda k, v: f"{v}L" if k == "bit" else _literal(v)
        return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {value(k, v)}" for k, v in x.items()) + ")" for x in rows) + ")")

    def members(self, *outcomes: str) -> Column:
        """Rules of a unit with one of the outcomes, in the order of rules for each: (rule_id, outcome, and places)."""

        def inside(x: str) -> Column:
            table, words = self._table(x), self.words(x)
            held = let(F.array(*words), lambda held: F.filter(table, lambda r: F.get(held, r["word"]).bitwiseAND(r["bit"]) != 0))
            return F.when(_union(map(F.col, words)) != 0, held).otherwise(F.filter(table, lambda _: F.lit(False)))

        return F.concat(*map(inside, outcomes))

    def told(self, columns: tuple[str, ...], *outcomes: str) -> DataFrame:
        """A row for each unit and rule with one of the outcomes: the columns, rule_id, outcome and reason."""
        # Outer, as Spark works out what an inner explode is given again to leave out empty ones.
        rows = self.rows.withColumn("_m", F.explode_outer(self.members(*outcomes))).where("_m is not null")
        why = F.when(F.col("_m.outcome") == "unknown", F.coalesce(F.get("_abstained", F.col("_m.abstains")), F.get("_evidence", F.col("_m.needs"))))
        return rows.select(*columns, F.col("_m.rule_id").alias("rule_id"), F.col("_m.outcome").alias("outcome"), why.alias("reason"))

    def outcomes(self) -> Column:
        """The outcome of every rule with its matches, in the order of rules; of ``rows`` with ``hits``."""
        shared = F.struct(F.array(*self.words()).alias("words"), F.col("hits").alias("hits"), F.col("_abstained").alias("abstained"), F.col("_evidence").alias("evidence"))

        def of(u: Column, r: Column) -> Column:
            bit = lambda k: F.get(u["words"], r["word"] + k * self.width).bitwiseAND(r["bit"]) != 0
            name = F.lit(OUTCOMES[-1])
            for k in range(len(OUTCOMES) - 2, -1, -1):
                name = F.when(bit(k), OUTCOMES[k]).otherwise(name)
            return let(name, lambda said: let(F.get(F.filter(u["hits"], lambda h: h["rule_id"] == r["rule_id"]), F.lit(0)), lambda hit: told(u, r, said, hit)))

        def told(u: Column, r: Column, said: Column, hit: Column) -> Column:
            # A reason is the rule's own, or that of its question; only what was found has matches.
            abstained = F.get(u["abstained"], r["abstains"])
            why = F.when(said == "unknown", F.coalesce(abstained, F.get(u["evidence"], r["needs"])))
            kept = said.isin("finding", "job") | (said == "unknown") & abstained.isNull()
            return F.struct(r["rule_id"], said, why, *(F.when(kept, hit[x]) for x in ("n_matches", "evidence", "offset")))

        if not self.rules:
            return F.array().cast(f"array<{_OUTCOME}>")
        return let(shared, lambda u: F.transform(self._table(OUTCOMES[0]), lambda r: of(u, r))).cast(f"array<{_OUTCOME}>")

    def first_of_run(self, *columns: str) -> Marks:
        """The marks with each reason of a run at its first unit, by file and start.

        The units' words, reasons and the ``columns`` are written once, and first units and the result are read from there.
        """
        rows = settle(self.rows.select(*dict.fromkeys(("file", "start", "unit_id", *columns)), *self.words(), "_abstained", "_evidence", "_run"), "marks")
        named = rows.where(F.size("_run") > 0).select("file", "start", "unit_id", F.explode("_run").alias("o"))
        first = named.groupBy("o.rule_id", "o.reason").agg(F.min(F.struct("file", "start", "unit_id"))["unit_id"].alias("unit_id"))
        kept = first.agg(F.collect_list(F.struct("rule_id", "reason", "unit_id")).alias("_firsts"))
        later = F.filter("_run", lambda o: ~F.exists("_firsts", lambda f: (f["rule_id"] == o["rule_id"]) & (f["reason"] == o["reason"]) & (f["unit_id"] == F.col("unit_id"))))
        rows = rows.join(F.broadcast(kept)).withColumn("_later", F.when(F.size("_run") > 0, F.transform(later, lambda o: o["rule_id"])).otherwise(F.array().cast("array<string>")))
        gone = {w: _union(F.when(F.array_contains("_later", i), self.mask(w, lambda r, i=i: r.id == i)).otherwise(F.lit(0).cast("long")) for i in self.held_back) for w in range(self.width)}
        rows = rows.withColumns({f"_gone_{w}": x for w, x in gone.items()})
        moved = {f"_{x}_{w}": how(F.col(f"_{x}_{w}"), F.col(f"_gone_{w}")) for w in range(self.width) for x, how in (("unknown", lambda a, b: a.bitwiseAND(F.bitwise_not(b))), ("precondition", lambda a, b: a.bitwiseOR(b)))}
        return replace(self, rows=rows.withColumns(moved).drop("_firsts", "_later", *(f"_gone_{w}" for w in gone)))

    def counted(self, *outcomes: str) -> DataFrame:
        """(rule_id, outcome, n_units, n_files) of the rules with units of an outcome; units of one kind are written out once."""
        one = lambda rows, n: replace(self, rows=rows.withColumns({x: F.array().cast("array<string>") for x in ("_abstained", "_evidence")})).told((n,), *outcomes or OUTCOMES)
        words = self.words(*outcomes)
        units = one(self.rows.groupBy(*words).agg(F.count("*").alias("_n")), "_n").groupBy("rule_id", "outcome").agg(F.sum("_n").alias("n_units"))
        files = one(self.rows.groupBy("file").agg(*(F.bit_or(x).alias(x) for x in words)).groupBy(*words).agg(F.count("*").alias("_n")), "_n").groupBy("rule_id", "outcome").agg(F.sum("_n").alias("n_files"))
        return units.join(files, ["rule_id", "outcome"])

    def coverage(self) -> DataFrame:
        """As ``coverage`` of the plan; units of one kind are counted first, so that few are written out."""
        names = ("negative", "finding", "job", "unknown")
        alike = self.rows.groupBy(*self.words(*names), "_run").agg(F.count("*").alias("_n"))
        plain = lambda o: F.struct(o["rule_id"].alias("rule_id"), o["outcome"].alias("outcome"), F.lit(None).cast("string").alias("reason"))
        run = lambda o: F.struct(o["rule_id"].alias("rule_id"), F.lit("run").alias("outcome"), o["reason"].alias("reason"))
        rows = alike.select("_n", F.explode_outer(F.concat(F.transform(self.members(*names), plain), F.transform("_run", run))).alias("o")).where("o is not null")
        rows = rows.groupBy("o.rule_id", "o.outcome", "o.reason").agg(F.sum("_n").alias("n"))
        # Each reason of a run is unknown at one unit.
        rows = rows.withColumn("n", F.when(F.col("outcome") == "run", 1 - F.col("n")).otherwise(F.col("n")))
        of = lambda *x: F.coalesce(F.sum(F.when(F.col("outcome").isin(*x), F.col("n"))), F.lit(0))
        counts = rows.groupBy("rule_id").agg(of(*names, "run").alias("eligible"), of("finding").alias("answered"), of("negative").alias("negative"), of("job").alias("pending"), of("unknown", "run").alias("unknown"))
        return _for_rules(counts, self.rules)

    def jobs(self, *columns: str) -> DataFrame:
        """As ``jobs`` of the plan."""
        rows = self.rows.where(_union(map(F.col, self.words("job"))) != 0)
        return _requests(rows.select(*columns, F.transform(self.members("job"), lambda o: o["rule_id"]).alias("asked")), self.rules)


def marks(units: DataFrame, rules: tuple[Rule, ...], abstentions: Mapping[str, tuple[Column, bool]] | None = None, checks: Mapping[str, tuple[Column, Column | None]] | None = None, per_token: float | None = None, found: bool = False) -> Marks:
    """The marks of a plan with the arguments of ``plan``; with ``hits`` if what was ``found`` is wanted."""
    checks = checks or {}
    abstentions = {i: (reason, False) for i, (_, reason) in checks.items() if reason is not None} | dict(abstentions or {})
    needs = tuple(dict.fromkeys(r.asks for r in rules if r.asks is not None))
    held_back = tuple(r.id for r in rules if r.id in abstentions)
    evidence = {i: said for i, (said, _) in checks.items()}
    searched, checked = [r for r in rules if mechanical.searched(r)], mechanical.checked(rules, evidence)
    rows = mechanical.judged(units.where("kind <> 'file'"), rules, evidence)
    rows = mechanical.with_hits(rows, rules, evidence) if found else rows
    texts = lambda columns: F.array(*columns) if columns else F.array().cast("array<string>")
    rows = rows.withColumns({"_evidence": texts([missing_evidence(units, keys, per_token) for keys in needs]), "_abstained": texts([abstentions[i][0] for i in held_back])})
    made = Marks(rows, rules, held_back, needs)
    none, at = F.lit(0).cast("long"), lambda name, k: F.get(name, F.lit(k))
    scopes, demands = {mechanical.scope_number(r, rules) for r in rules}, {mechanical.demand_number(r, rules) for r in rules}

    def fired(mask) -> Column:
        bits = F.array(*(mask(lambda r, f=f: r is f) for f in searched))
        return F.aggregate("_fired", none, lambda s, i: s.bitwiseOR(F.get(bits, i))) if searched else none

    sets = {}
    for w in range(made.width):
        mask = lambda test, w=w: made.mask(w, test)
        sets |= {
            f"_in_{w}": _union(F.when(~at("_scopes", k), none).otherwise(mask(lambda r, k=k: mechanical.scope_number(r, rules) == k)) for k in scopes),
            f"_able_{w}": _union(F.when(at("_demands", k), mask(lambda r, k=k: mechanical.demand_number(r, rules) == k)).otherwise(none) for k in demands),
            f"_back_{w}": _union(F.when(at("_abstained", k).isNotNull(), mask(lambda r, i=i: r.id == i)).otherwise(none) for k, i in enumerate(held_back)),
            f"_lacks_{w}": _union(F.when(at("_evidence", k).isNotNull(), mask(lambda r, x=x: r.asks == x)).otherwise(none) for k, x in enumerate(needs)),
            f"_shown_{w}": fired(mask).bitwiseOR(_union(F.when(at("_said", k).isNotNull(), mask(lambda r, c=c: r is c)).otherwise(none) for k, c in enumerate(checked))),
        }
    rows = rows.withColumns(sets)
    both, less = lambda a, b: a.bitwiseAND(b), lambda a, b: a.bitwiseAND(F.bitwise_not(b))
    for steps in (
        lambda x, m: {"out_of_scope": less(m(lambda r: True), x("in")), "precondition": less(x("in"), x("able")), "held": both(both(x("in"), x("able")), x("back")), "rest": less(both(x("in"), x("able")), x("back"))},
        lambda x, m: {"negative": less(both(x("rest"), m(mechanical.decides)), x("shown"))},
        lambda x, m: {"finding": less(less(x("rest"), x("negative")), m(lambda r: r.asks is not None)), "asked": both(less(x("rest"), x("negative")), m(lambda r: r.asks is not None))},
        lambda x, m: {"unknown": x("held").bitwiseOR(both(x("asked"), x("lacks"))), "job": less(x("asked"), x("lacks"))},
    ):
        rows = rows.withColumns({f"_{name}_{w}": c for w in range(made.width) for name, c in steps(lambda n, w=w: F.col(f"_{n}_{w}"), lambda test, w=w: made.mask(w, test)).items()})
    run = [(k, i) for k, i in enumerate(held_back) if abstentions[i][1]]
    kept = lambda i: _union(both(F.col(f"_held_{w}"), made.mask(w, lambda r: r.id == i)) for w in range(made.width)) != 0
    reasons = [F.when(kept(i), F.struct(F.lit(i).alias("rule_id"), at("_abstained", k).alias("reason"))) for k, i in run]
    rows = rows.withColumn("_run", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<struct<rule_id:string,reason:string>>"))
    return replace(made, rows=rows.select(*units.columns, *(["hits"] if found else []), "_abstained", "_evidence", "_run", *made.words()))


def _firsts(units: DataFrame, rules: tuple[Rule, ...], once: dict[str, Column]) -> DataFrame:
    """(rule_id, reason, unit_id): the first unit that each reason of a run holds for.

    Scope, preconditions and the reason tell it, so nothing is searched for; it is written before the plan is run, as a
    broadcast that had to wait for a pass over all units would run out of time.
    """
    able = mechanical.completed(units.where("kind <> 'file'"), rules)
    held = F.array_compact(F.array(*(F.when(mechanical.eligible(r, rules) & once[r.id].isNotNull(), F.struct(F.lit(r.id).alias("rule_id"), once[r.id].alias("reason"))) for r in rules)))
    first = able.select("file", "start", "unit_id", F.explode(held).alias("o")).groupBy("o.rule_id", "o.reason").agg(F.min(F.struct("file", "start", "unit_id"))["unit_id"].alias("unit_id"))
    return settle(first.coalesce(1), "firsts")


def _first_of_run(rows: DataFrame, first: DataFrame, once: dict[str, Column]) -> DataFrame:
    """Keeps a run's reason at its first unit.  One row for each rule and reason is broadcast."""

    def abstains(o: Column) -> Column:
        return (o["outcome"] == "unknown") & reduce(lambda out, x: out | ((o["rule_id"] == x[0]) & x[1].isNotNull()), once.items(), F.lit(False))

    firsts = first.agg(F.collect_list(F.struct("rule_id", "reason", "unit_id")).alias("_firsts"))

    def kept(o: Column) -> Column:
        later = abstains(o) & ~F.exists("_firsts", lambda f: (f["rule_id"] == o["rule_id"]) & (f["reason"] == o["reason"]) & (f["unit_id"] == F.col("unit_id")))
        return F.when(later, F.struct(o["rule_id"], F.lit("precondition"), F.lit(None).cast("string"), o["n_matches"], o["evidence"], o["offset"]).cast(_OUTCOME)).otherwise(o)

    return rows.join(F.broadcast(firsts)).withColumn("outcomes", F.transform("outcomes", kept)).drop("_firsts")


def _rows(planned: DataFrame, outcome: str) -> DataFrame:
    columns = [c for c in planned.columns if c != "outcomes"]
    return planned.select(*columns, F.explode(F.filter("outcomes", lambda o: o["outcome"] == outcome)).alias("o"))


def findings(planned: DataFrame) -> DataFrame:
    """A row for each finding of a mechanical rule, with its matches; its probability is 1, which says only that it matched."""
    rows = _rows(planned, "finding")
    columns = [c for c in planned.columns if c != "outcomes"]
    line = F.when(F.col("kind") == "source", F.col("line") + text.line_of(F.col("text"), F.col("o.offset")) - 1).otherwise(F.col("line")).cast("long")
    return rows.select(*(line.alias(c) if c == "line" else c for c in columns), "o.rule_id", "o.n_matches", "o.evidence", "o.offset", F.lit(1.0).alias("probability"))


def unknowns(planned: DataFrame) -> DataFrame:
    return _rows(planned, "unknown").select("file", "line", "unit_id", "o.rule_id", "o.reason")


def jobs(planned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each request of a unit: its columns, rule_ids, state and truncated.

    Questions that need a section are asked one by one; the others of a unit share a request, unless what they need
    together would be cut, when they are asked one by one too.
    """
    columns = [c for c in planned.columns if c != "outcomes"]
    asked = F.transform(F.filter("outcomes", lambda o: o["outcome"] == "job"), lambda o: o["rule_id"])
    return _requests(planned.select(*columns, asked.alias("asked")).where(F.size("asked") > 0), rules)


def _requests(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Requests of units with ``asked``, the rules that are jobs."""
    asking = [r for r in rules if r.asks is not None]
    columns = [c for c in rows.columns if c != "asked"]
    apart = [r.id for r in asking if "section" in r.asks]
    alone = F.filter("asked", lambda i: i.isin(*apart)) if apart else F.array().cast("array<string>")
    local = F.filter("asked", lambda i: ~i.isin(*apart)) if apart else F.col("asked")
    rows = rows.withColumn("alone", alone).withColumn("local", local).drop("asked")
    asked = lambda ids: lambda key: F.exists(ids, lambda i: i.isin(*named)) if (named := [r.id for r in asking if key in r.asks]) else False
    rows = rows.withColumn("_over", build_state(rows, asked("local"))["truncated"])
    empty = F.array().cast("array<array<string>>")
    one_by_one = F.transform(F.concat("alone", F.when(F.col("_over"), F.col("local")).otherwise(F.array().cast("array<string>"))), lambda i: F.array(i))
    together = F.when((F.size("local") > 0) & ~F.col("_over"), F.array("local")).otherwise(empty)
    rows = rows.select(*columns, F.explode(F.concat(together, one_by_one)).alias("rule_ids"))
    return rows.withColumn("_s", build_state(rows, asked("rule_ids"))).select(*columns, "rule_ids", "_s.state", "_s.truncated")


def coverage(planned: DataFrame, rules: tuple[Rule, ...], answered: DataFrame | None = None) -> DataFrame:
    """eligible, answered, negative, pending and unknown units of each rule, distinct units counted once.

    What a pattern decided is answered or negative; a job is pending until ``answered``, rows (unit_id, rule_id) of jobs
    with an answer, has it.  One aggregation over the planned rows.
    """
    rows = planned.select("unit_id", F.explode("outcomes").alias("o")).select("unit_id", "o.rule_id", "o.outcome").where(~F.col("outcome").isin("out_of_scope", "precondition"))
    if answered is not None:
        rows = rows.join(answered.select("unit_id", "rule_id").distinct().withColumn("_answered", F.lit(True)), ["unit_id", "rule_id"], "left")
        rows = rows.withColumn("outcome", F.when((F.col("outcome") == "job") & F.col("_answered"), "finding").otherwise(F.col("outcome")))
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    counted = rows.groupBy("rule_id").agg(F.count("*").alias("eligible"), of("finding").alias("answered"), of("negative").alias("negative"), of("job").alias("pending"), of("unknown").alias("unknown"))
    return _for_rules(counted, rules)


def _for_rules(counted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule with its category, nothing being counted of those without a row.  No broadcast is asked for, as it
    would have to wait for the pass over all units."""
    table = counted.sparkSession.createDataFrame([(r.id, r.category) for r in rules], "rule_id string, category string")
    return table.join(counted, "rule_id", "left").na.fill(0)
