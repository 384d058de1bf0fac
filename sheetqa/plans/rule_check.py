"""Rule check, then cross-check, over one sheet of rule rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.crosscheck import cross_check
from ..operators.rules import extract_rules, missing_combinations, rule_check_summary


class RuleCheck(NamedTuple):
    rules: DataFrame
    missing: DataFrame
    summary: DataFrame
    findings: DataFrame


def check_rules(
    original: DataFrame,
    translated: DataFrame | None = None,
    answers: DataFrame | None = None,
) -> RuleCheck:
    """Translated rows if there are any, else the originals."""
    rules = extract_rules(original if translated is None else translated)
    return RuleCheck(
        rules,
        missing_combinations(rules),
        rule_check_summary(rules),
        cross_check(rules, answers=answers),
    )
