"""The main query: files to units to outcomes to findings to reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.operators import findings as reduce
from proseloom.operators import mechanical, planning, units
from proseloom.plans.catalogue import RULES, Rule


@dataclass
class LintResult:
    """Tables of one run; each is planned when it is asked for."""

    units: DataFrame
    rules: DataFrame
    findings: DataFrame
    evaluated: tuple[Rule, ...]
    nominated: bool = False

    @cached_property
    def plan(self) -> DataFrame:
        """A row for each unit with the outcome of every rule."""
        return planning.plan(self.units, self.evaluated)

    @cached_property
    def jobs(self) -> DataFrame:
        """The requests that rules with a question leave for a judge."""
        return planning.jobs(self.plan, self.evaluated)

    @cached_property
    def outcomes(self) -> DataFrame:
        """A row for each unit and eligible rule with a pattern."""
        return mechanical.outcomes(self.units, self.evaluated)

    @cached_property
    def counts(self) -> DataFrame:
        """Eligible, answered and negative units of each rule that its pattern decides, or of all rules where what nominates counts."""
        table = self.rules if self.nominated else self.rules.where("tier = 'mechanical'")
        found = self.evaluated if self.nominated else mechanical.decided(self.evaluated)
        return table.select("rule_id").join(F.broadcast(mechanical.counts(self.units, found)), "rule_id", "left").na.fill(0)


def run_lint(files: DataFrame, rules: tuple[Rule, ...] = RULES, pragmas: DataFrame | None = None, unit: DataFrame | None = None, nominated: bool = False) -> LintResult:
    """Mechanical lint of files (file, text), or of units that another extractor made.

    Only rules that their pattern decides give findings; what nominates a question is a job of the plan, and with
    ``nominated``, for runs without a judge, a finding too.  A unit meets a rule once, so there is nothing to dedupe within
    a rule, and findings need no shuffle.
    """
    table = reduce.rule_table(files.sparkSession, rules)
    if unit is None:
        unit, rules = units.line_units(files), mechanical.meeting(rules, {"paragraph"}, {"body"})
    fired = mechanical.hits(unit, rules if nominated else mechanical.decided(rules)).withColumn("probability", F.lit(1.0)).withColumn("seq", F.lit(0))
    found = reduce.findings(fired, table)
    found = reduce.suppress(found, pragmas) if pragmas is not None else found.withColumn("suppressed", F.lit(False))
    return LintResult(unit, table, found, rules, nominated)
