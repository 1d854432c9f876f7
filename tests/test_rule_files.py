"""Rule folders: what is loaded, what is refused, tuning and the choice of rules."""

import json

import pytest

from proseloom.plans.catalogue import RULES
from proseloom.sources import rules

BASE = {
    "id": "copywriting-x",
    "title": "A rule",
    "categoryId": "machine-prose",
    "source": {"repo": "r", "path": "p", "line": 1},
    "unit": ["heading", "jsx-text", "attr-string"],
    "mechanical": {"regex": r"\bx\b"},
    "severity": "minor",
    "fix": {"hint": "Do not."},
}


def written(folder, *values, name=None):
    for value in values:
        path = folder / value.get("id", "x").split("-")[0]
        path.mkdir(exist_ok=True)
        (path / f"{name or value['id']}.json").write_text(json.dumps(value))
    return str(folder)


def with_(**changes):
    return {k: v for k, v in {**BASE, **changes}.items() if v is not None}


def test_scope_comes_from_the_kinds(tmp_path):
    (rule,) = rules.load_rules(written(tmp_path, with_(scope={"exclude": ["**/README.md"]})))
    assert rule.include == ("**/*.md", "**/*.mdx", "**/*.tsx", "**/*.jsx")
    assert {"**/README.md", "**/*.test.*"} <= set(rule.exclude) and (rule.review, rule.act, rule.tier) == (0.35, 0.7, "mechanical")
    about = rules.rule_of(with_(scope={"include": ["**/*.test.ts"]}), "x", "copywriting-x")
    assert "**/*.test.*" not in about.exclude and "**/*.stories.*" in about.exclude


def test_all_fields(tmp_path):
    side = {"what": "w", "examples": ["e"]}
    value = with_(
        mechanical={"phrases": ["a b"], "minMatches": 2}, question={"instructions": "Is it?", "criteria": {"true": side, "false": side}, "context": ["docType", "section"]}, thresholds={"review": 0.4, "act": 0.75},
        preconditions={"notInCode": True, "notGenerated": True, "docType": ["ui"], "role": ["body"], "minWords": 3, "smartQuotesAtBuild": False}, status="review-only", severity="major",
    )
    (r,) = rules.load_rules(written(tmp_path, value))
    assert (r.phrases, r.least, r.asks, r.question, r.review, r.act, r.tier) == (("a b",), 2, ("docType", "section"), "Is it?", 0.4, 0.75, "both")
    assert (r.not_in_code, r.not_generated, r.doc_types, r.roles, r.min_words, r.own_quotes, r.status, r.severity) == (True, True, ("ui",), ("body",), 3, False, "review-only", "major")


@pytest.mark.parametrize(
    ("changes", "says"),
    [
        ({"id": "Copy"}, "kebab"), ({"id": "copywriting-y"}, "filename"), ({"title": "a — b"}, "em dash"), ({"extra": 1}, "unknown keys: extra"), ({"unit": ["page"]}, "one of"), ({"unit": []}, "at least one kind"),
        ({"mechanical": {}}, "regex or phrases"), ({"mechanical": {"absent": "x", "phrases": ["y"]}}, "pair with"), ({"mechanical": {"regex": "x", "minMatches": 0}}, "positive"), ({"mechanical": {"regex": "x", "codeOnly": False}}, "only be true"),
        ({"mechanical": None}, "needs a mechanical"), ({"thresholds": {"review": 0.8}}, "review < act"), ({"severity": "high"}, "one of"), ({"fix": {"hint": ""}}, "nonempty"), ({"fix": {"hint": "h", "function": "none"}}, "one of"),
        ({"unit": ["source"]}, "include"), ({"unit": ["source", "heading"], "scope": {"include": ["*.ts"]}}, "no other unit kind"), ({"unit": ["source"], "scope": {"include": ["*.ts"]}}, "review"), ({"preconditions": {"docType": ["blog"]}}, "one of"),
        ({"question": {"instructions": "q", "context": ["all"]}}, "one of"), ({"question": {"instructions": "q", "criteria": {"true": {"what": "w", "examples": ["e"]}}}}, "false"), ({"source": None}, "source"), ({"status": "on"}, "one of"),
    ],
)
def test_wrong_rules_are_named(tmp_path, changes, says):
    with pytest.raises(rules.RuleError, match=says) as wrong:
        rules.load_rules(written(tmp_path, with_(**changes), name="copywriting-x") if changes.get("id") != "Copy" else written(tmp_path, with_(id="copywriting-x") | {"id": "Copy"}, name="Copy"))
    assert wrong.value.code == "INVALID_RULE"


def test_patterns_that_do_not_compile_are_named(spark, tmp_path):
    folder = written(tmp_path, with_(mechanical={"regex": "(x"}))
    with pytest.raises(rules.RuleError, match="copywriting-x: mechanical.regex does not compile"):
        rules.load_rules(folder, spark=spark)
    rules.check_patterns(spark, RULES)


def test_tuning_drafts_and_choice(tmp_path):
    folder = written(tmp_path, BASE, with_(id="copywriting-y", status="draft"), with_(id="craft-z"))
    assert [r.id for r in rules.load_rules(folder)] == ["copywriting-x", "craft-z"]
    assert [r.id for r in rules.load_rules(folder, drafts=True, domains=["copywriting"])] == ["copywriting-x", "copywriting-y"]
    assert [r.id for r in rules.load_rules(folder, only=["craft-z"], domains=["copywriting"])] == ["craft-z"]
    with pytest.raises(rules.RuleError, match="Unknown rule ids: nope"):
        rules.load_rules(folder, only=["nope"])
    tuning = tmp_path / "tuning.json"
    tuning.write_text(json.dumps({"copywriting-x": {"act": 0.9, "status": "review-only", "n": 3}}))
    tuned = rules.load_rules(folder)[0]
    assert (tuned.act, tuned.status, tuned.review) == (0.9, "review-only", 0.35)
    for entry, says in (({"nope": {"act": 0.9}}, "unknown rule nope"), ({"craft-z": {"status": "activ"}}, "one of"), ({"craft-z": {"act": 0.2}}, "above review"), ({"craft-z": {"acts": 1}}, "unknown keys"), ({"craft-z": {"act": 2}}, "0, 1"), ([], "object")):
        tuning.write_text(json.dumps(entry))
        with pytest.raises(rules.RuleError, match=says):
            rules.load_rules(folder)


def test_ids_are_unique_and_extra_folders_hold_rules(tmp_path):
    one, two, empty = (tmp_path / x for x in "abc")
    for folder in (one, two, empty):
        folder.mkdir()
    written(one, BASE)
    written(two, BASE)
    with pytest.raises(rules.RuleError, match="defined twice") as wrong:
        rules.load_rules(str(one), extra=[str(two)])
    assert wrong.value.code == "DUPLICATE_RULE"
    with pytest.raises(rules.RuleError, match="holds no rules"):
        rules.load_rules(str(one), extra=[str(empty)])


def test_raw_searches_of_source_never_become_active(tmp_path):
    steps = dict.fromkeys(("applicability", "exceptions", "evidence", "verification"), "s")
    value = with_(id="craft-x", unit=["source"], scope={"include": ["**/*.ts"]}, review=steps, status="review-only")
    folder = written(tmp_path, value)
    assert rules.load_rules(folder)[0].review_only
    (tmp_path / "tuning.json").write_text('{"craft-x": {"status": "active"}}')
    with pytest.raises(rules.RuleError, match="cannot be active"):
        rules.load_rules(folder)


def test_yaml_files(tmp_path):
    pytest.importorskip("yaml")
    folder = tmp_path / "copywriting"
    folder.mkdir()
    (folder / "copywriting-x.yaml").write_text("id: copywriting-x\ntitle: T\ncategoryId: c\nsource: {repo: r, path: p}\nunit: [paragraph]\nquestion:\n  instructions: >-\n    Is it?\n  criteria:\n    true: {what: w, examples: [e]}\n    false: {what: w, examples: [e]}\nseverity: minor\nfix: {hint: h}\n")
    (rule,) = rules.load_rules(str(tmp_path))
    assert (rule.tier, rule.asks, rule.question) == ("judged", (), "Is it?")
    (folder / "copywriting-y.yaml").write_text("id: [")
    with pytest.raises(rules.RuleError, match="did not parse"):
        rules.load_rules(str(tmp_path))
