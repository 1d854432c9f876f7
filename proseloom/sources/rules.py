"""Rules from folders of rule files, their tuning, and the choice of rules for a run."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import SparkSession

from proseloom.functions.text import phrase_pattern, portable
from proseloom.plans.catalogue import ACT, INCLUDE_BY_KIND, REVIEW, STATUSES, Rule, filed

# What the fields of rule files may hold.
KINDS = tuple(INCLUDE_BY_KIND)
SEVERITIES = ("major", "minor")
DOC_TYPES = ("tutorial", "howto", "reference", "explanation", "agent-instructions", "lesson", "marketing", "ui", "readme", "skill", "plan", "unknown")
ROLES = ("heading", "body", "list-item", "cell", "button", "link", "label", "placeholder", "aria", "literal-copy", "caption", "unknown")
CONTEXT_KEYS = ("section", "headingAbove", "docType", "element", "role", "neighbours", "earlier", "brief")
FIXES = ("ellipsis", "smartQuotes", "multiplicationSign", "nbspValueUnit", "auSpelling", "stripUtm")
_FIELDS = ("id", "title", "categoryId", "source", "scope", "unit", "mechanical", "question", "thresholds", "severity", "fix", "preconditions", "status", "handWritten", "review")
_EM_DASH = "—"


class RuleError(ValueError):
    """A rule file, a tuning file or a choice of rules that is wrong; ``code`` is INVALID_RULE, DUPLICATE_RULE or INVALID_CONFIG."""

    def __init__(self, message: str, code: str = "INVALID_RULE"):
        super().__init__(message)
        self.code = code


class _Fields:
    """A mapping of a rule file whose fields are taken with their checks; the place of a wrong one is named."""

    def __init__(self, place: str, value, known: Iterable[str]):
        if not isinstance(value, dict):
            raise RuleError(f"{place} must be a mapping")
        unknown = sorted(set(map(str, value)) - set(known))
        if unknown:
            raise RuleError(f"{place} has unknown keys: {', '.join(unknown)}")
        self.place, self.value = place, value

    def wrong(self, key: str, what: str) -> RuleError:
        return RuleError(f"{self.place}.{key} {what}")

    def has(self, key: str) -> bool:
        return self.value.get(key) is not None

    def text(self, key: str, dashes: bool = True) -> str:
        found = self.value.get(key)
        if not isinstance(found, str) or not found.strip():
            raise self.wrong(key, "must be a nonempty string")
        if not dashes and _EM_DASH in found:
            raise self.wrong(key, "contains an em dash; use a comma, colon or period")
        return found

    def one_of(self, key: str, allowed: Iterable[str], default: str | None = None) -> str:
        found = self.value.get(key, default)
        if found not in tuple(allowed):
            raise self.wrong(key, f"must be one of {', '.join(allowed)}")
        return found

    def texts(self, key: str, allowed: Iterable[str] | None = None) -> tuple[str, ...]:
        found = self.value.get(key)
        if found is None:
            return ()
        if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
            raise self.wrong(key, "must be a list of strings")
        if allowed is not None and (bad := [x for x in found if x not in tuple(allowed)]):
            raise self.wrong(key, f"holds {bad[0]}; must be one of {', '.join(allowed)}")
        return tuple(found)

    def count(self, key: str, default: int) -> int:
        found = self.value.get(key, default)
        if isinstance(found, bool) or not isinstance(found, int) or found < default:
            raise self.wrong(key, "must be a positive integer")
        return found

    def flag(self, key: str, only: bool = True) -> bool:
        if key in self.value and self.value[key] is not only:
            raise self.wrong(key, f"may only be {str(only).lower()}")
        return key in self.value

    def number(self, key: str, default: float) -> float:
        found = self.value.get(key, default)
        if isinstance(found, bool) or not isinstance(found, (int, float)):
            raise self.wrong(key, "must be a number")
        return float(found)

    def inner(self, key: str, known: Iterable[str]) -> _Fields:
        return _Fields(f"{self.place}.{key}", self.value[key], known)


def _searches(rule: _Fields) -> dict:
    found = rule.inner("mechanical", ("regex", "flags", "phrases", "minMatches", "absent", "codeOnly"))
    out: dict = {"least": found.count("minMatches", 1), "code_only": found.flag("codeOnly")}
    if found.has("regex"):
        out["pattern"] = found.text("regex")
        out["flags"] = found.text("flags") if found.has("flags") else "gu"
        if set(out["flags"]) - set("dgimsuvy"):
            raise found.wrong("flags", "holds an unknown flag")
    if "phrases" in found.value:
        out["phrases"] = found.texts("phrases")
        if not out["phrases"]:
            raise found.wrong("phrases", "must not be empty")
        if any(_EM_DASH in p for p in out["phrases"]):
            raise found.wrong("phrases", "contains an em dash; use a comma, colon or period")
    if found.has("absent"):
        out["absent"] = found.text("absent")
        if "pattern" not in out:
            raise found.wrong("absent", "needs a regex to pair with")
    if "pattern" not in out and "phrases" not in out:
        raise rule.wrong("mechanical", "needs regex or phrases")
    return out


def _asks(rule: _Fields) -> dict:
    found = rule.inner("question", ("instructions", "criteria", "context"))
    out = {"question": found.text("instructions", dashes=False), "asks": found.texts("context", CONTEXT_KEYS)}
    if found.has("criteria"):
        # A YAML reader may take the names of the sides for truth values.
        sides = {str(k).lower(): v for k, v in found.value["criteria"].items()} if isinstance(found.value["criteria"], dict) else None
        criteria = _Fields(f"{found.place}.criteria", sides, ("true", "false"))
        for side in ("true", "false"):
            if side not in criteria.value:
                raise criteria.wrong(side, "must be a mapping with what and examples")
            one = criteria.inner(side, ("what", "examples"))
            one.text("what", dashes=False)
            if not one.texts("examples"):
                raise one.wrong("examples", "needs at least one example")
    return out


def rule_of(value, place: str, expected_id: str, domain: str | None = None, categories: dict[str, str] | None = None) -> Rule:
    """A checked rule of a file's mapping.  ``categories`` maps category ids to domains, where the caller has them."""
    rule = _Fields(place, value, _FIELDS)
    name = rule.text("id")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", name):
        raise rule.wrong("id", "must be kebab-case")
    if name != expected_id:
        raise rule.wrong("id", f"{name} does not match filename {expected_id}")
    rule.text("title", dashes=False)
    category = rule.text("categoryId")
    if categories is not None and category not in categories:
        raise rule.wrong("categoryId", f"{category} is unknown")
    owner = categories[category] if categories else domain
    if owner and not name.startswith(f"{owner}-"):
        raise rule.wrong("id", f"must start with {owner}-")
    source = rule.inner("source", ("repo", "path", "line", "ruleId")) if "source" in rule.value else None
    if source is None:
        raise rule.wrong("source", "must be a mapping")
    source.text("repo"), source.text("path")
    kinds = rule.texts("unit", KINDS)
    if not kinds:
        raise rule.wrong("unit", "needs at least one kind")
    scope = rule.inner("scope", ("include", "exclude")) if rule.has("scope") else _Fields(place, {}, ())
    if "source" in kinds and not scope.has("include"):
        raise rule.wrong("scope", "of a source rule needs include (which file types)")
    made: dict = {"kinds": kinds, "include": scope.texts("include"), "exclude": scope.texts("exclude")}
    if rule.has("mechanical"):
        made |= _searches(rule)
    if rule.has("question"):
        made |= _asks(rule)
    if "source" in kinds and ("pattern" not in made and "phrases" not in made or len(kinds) > 1):
        raise rule.wrong("unit", "source needs a mechanical candidate section and no other unit kind")
    made["status"] = rule.one_of("status", STATUSES, "active")
    if not rule.has("mechanical") and not rule.has("question") and made["status"] != "draft":
        raise RuleError(f"{place} needs a mechanical section or a question unless status is draft")
    limits = rule.inner("thresholds", ("act", "review")) if rule.has("thresholds") else _Fields(place, {}, ())
    made["review"], made["act"] = limits.number("review", REVIEW), limits.number("act", ACT)
    if not 0 <= made["review"] < made["act"] <= 1:
        raise rule.wrong("thresholds", "need 0 <= review < act <= 1")
    made["severity"] = rule.one_of("severity", SEVERITIES)
    fix = rule.inner("fix", ("hint", "function")) if rule.has("fix") else None
    if fix is None:
        raise rule.wrong("fix", "must be a mapping")
    fix.text("hint", dashes=False)
    if fix.has("function"):
        made["fix"] = fix.one_of("function", FIXES)
    if rule.has("preconditions"):
        before = rule.inner("preconditions", ("notInCode", "docType", "role", "smartQuotesAtBuild", "minWords", "notGenerated"))
        made |= {"not_in_code": before.flag("notInCode"), "not_generated": before.flag("notGenerated"), "own_quotes": not before.flag("smartQuotesAtBuild", False)}
        made |= {"doc_types": before.texts("docType", DOC_TYPES), "roles": before.texts("role", ROLES)}
        if before.has("minWords"):
            made["min_words"] = before.count("minWords", 1)
    if rule.has("review"):
        steps = rule.inner("review", ("applicability", "exceptions", "evidence", "verification", "sourceHash"))
        for step in ("applicability", "exceptions", "evidence", "verification"):
            steps.text(step, dashes=False)
        if steps.has("sourceHash") and not re.fullmatch("[a-f0-9]{64}", steps.text("sourceHash")):
            raise steps.wrong("sourceHash", "must be a SHA-256 digest")
    elif "source" in kinds and not rule.has("question") and made["status"] != "draft":
        raise rule.wrong("review", "of a source candidate needs applicability, exceptions, evidence and verification")
    return filed(name, category, **made)


def _read(path: str):
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError as gone:
        raise RuleError("rule files in YAML need the yaml module; JSON files do not", "INVALID_CONFIG") from gone
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as wrong:
        raise RuleError(f"Invalid rule {path}: YAML did not parse ({wrong})") from wrong


def rules_of_folder(folder: str, categories: dict[str, str] | None = None) -> tuple[Rule, ...]:
    """Rules of <folder>/<domain>/<id>.yaml (or .json), by domain and file name; the first wrong one stops the run."""
    out = []
    for domain in sorted(d.name for d in os.scandir(folder) if d.is_dir() and d.name != "schema"):
        for name in sorted(os.listdir(os.path.join(folder, domain))):
            stem, ending = os.path.splitext(name)
            if ending in (".yaml", ".json"):
                path = os.path.join(folder, domain, name)
                out.append(rule_of(_read(path), path, stem, domain, categories))
    return tuple(out)


def read_tuning(folder: str) -> dict[str, dict]:
    """The checked entries of <folder>/tuning.json by rule id: act, status, precisionLower, n, ts; none without the file."""
    path = os.path.join(folder, "tuning.json")
    if not os.path.exists(path):
        return {}
    entries = _read(path)
    if not isinstance(entries, dict):
        raise RuleError(f"Invalid tuning file {path}: must be an object", "INVALID_CONFIG")
    for name, value in entries.items():
        entry = _Fields(f"{path}: {name}", value, ("act", "status", "precisionLower", "n", "ts"))
        if "act" in entry.value and not 0 < entry.number("act", 0) <= 1:
            raise entry.wrong("act", "must be a number in (0, 1]")
        if "status" in entry.value:
            entry.one_of("status", STATUSES)
        if "precisionLower" in entry.value:
            entry.number("precisionLower", 0)
        if "n" in entry.value:
            entry.count("n", 0)
        if "ts" in entry.value:
            entry.text("ts")
    return entries


def check_patterns(spark: SparkSession, rules: Iterable[Rule]) -> None:
    """Compiles every pattern as the executors will; a wrong one is named with its rule."""
    compiler = spark._jvm.java.util.regex.Pattern
    for rule in rules:
        for what, pattern in (("regex", portable(rule.pattern, rule.flags)), ("phrases", phrase_pattern(list(rule.phrases)) if rule.phrases else ""), ("absent", portable(rule.absent, rule.flags))):
            try:
                compiler.compile(pattern)
            except Exception as wrong:
                raise RuleError(f"Invalid rule {rule.id}: mechanical.{what} does not compile: {getattr(wrong, 'java_exception', wrong)}") from wrong


def unique(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    """The rules, unless two have one id."""
    out: dict[str, Rule] = {}
    for rule in rules:
        if rule.id in out:
            raise RuleError(f"Rule id {rule.id} is defined twice; rename one.", "DUPLICATE_RULE")
        out[rule.id] = rule
    return tuple(out.values())


def tuned(rules: Iterable[Rule], tuning: dict[str, dict]) -> tuple[Rule, ...]:
    """Rules with their tuned act thresholds and statuses; entries of unknown rules, and raw searches made active, are wrong."""
    rules = tuple(rules)
    strange = sorted(set(tuning) - {r.id for r in rules})
    if strange:
        raise RuleError(f"tuning names unknown rule {strange[0]}", "INVALID_CONFIG")
    out = []
    for rule in rules:
        entry = tuning.get(rule.id, {})
        candidate = rule.tier == "mechanical" and "source" in rule.kinds
        if candidate and "active" in (rule.status, entry.get("status")):
            raise RuleError(f"Candidate-only rule {rule.id} cannot be active; add an evidence-based check before promotion.")
        if "act" in entry and not rule.review < entry["act"] <= 1:
            raise RuleError(f"Invalid tuning for {rule.id}: act must be above review and at most 1", "INVALID_CONFIG")
        out.append(replace(rule, act=float(entry.get("act", rule.act)), status=entry.get("status", rule.status)))
    return tuple(out)


def chosen(rules: Iterable[Rule], only: Iterable[str] | None = None, drafts: bool = False, domains: Iterable[str] | None = None) -> tuple[Rule, ...]:
    """The rules of a run: no drafts unless asked for, those named by id, or else those of the profile's domains."""
    rules = tuple(rules)
    wanted = None if only is None else set(only)
    missing = sorted((wanted or set()) - {r.id for r in rules})
    if missing:
        raise RuleError(f"Unknown rule ids: {', '.join(missing)}")
    out = tuple(r for r in rules if drafts or r.status != "draft")
    if wanted is not None:
        return tuple(r for r in out if r.id in wanted)
    return out if domains is None else tuple(r for r in out if r.area in set(domains))


def load_rules(folder: str, extra: Iterable[str] = (), only: Iterable[str] | None = None, drafts: bool = False, domains: Iterable[str] | None = None, spark: SparkSession | None = None) -> tuple[Rule, ...]:
    """Rules of a folder and of further ones, tuned by the first folder's tuning.json, and chosen.

    An extra folder without rules, a wrong rule, two rules of one id and a tuning of an unknown rule stop the run; with a
    session, so do patterns that do not compile.
    """
    found = list(rules_of_folder(folder))
    for other in extra:
        more = rules_of_folder(other)
        if not more:
            raise RuleError(f"rules entry {other} holds no rules; put rule files in a domain folder", "INVALID_CONFIG")
        found += more
    out = chosen(tuned(unique(found), read_tuning(folder)), only, drafts, domains)
    if spark is not None:
        check_patterns(spark, out)
    return out
