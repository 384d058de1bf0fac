"""Clinical rules: extraction, template coverage, missing combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clinical import parse_conditions, severity
from ..functions.library import TEMPLATES, Indicator, Template
from ..functions.text import WS, let
from ..schema import doc_keys

# Header names, first present wins (severity and id: first that is not empty).
DESCRIPTION_KEYS = ["Rule", "组合", "条件", "触发条件", "逻辑", "Combination"]
EXPLANATION_KEYS = ["Conclusion", "结论", "解读", "Result", "解释", "Interpretation"]
ID_KEYS = ["id", "ID", "编号"]
SEVERITY_KEYS = ["severity", "级别", "等级"]


def _named(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that are columns, compared with case."""
    return [n for n in names if n in df.columns]


def _quoted(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def _as_text(df: DataFrame, name: str) -> Column:
    """A value as text; whole floating numbers print without a fraction."""
    c = _quoted(df, name)
    text = c.cast("string")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        text = F.regexp_replace(text, r"\.0\z", "")
    return text


def _first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """First column that is not NULL: an empty text is present and ends the search."""
    return F.coalesce(*[_as_text(df, n) for n in _named(df, names)], F.lit(None).cast("string"))


def _first_truthy(df: DataFrame, names: Sequence[str]) -> Column:
    """First column that is neither NULL, empty, zero nor false."""
    options = []
    for name in _named(df, names):
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            falsy = (_quoted(df, name) == 0) | F.isnan(_quoted(df, name).cast("double"))
        elif isinstance(kind, T.BooleanType):
            falsy = ~_quoted(df, name)
        else:
            falsy = _as_text(df, name) == ""
        options.append(F.when(~falsy, _as_text(df, name)))
    return F.coalesce(*options, F.lit(None).cast("string"))


def extract_rules(wide: DataFrame, sheet: str | None = None) -> DataFrame:
    """``rules`` from one-column-per-header rows with ``row_idx``.

    A column that is absent from a row is NULL; a blank cell is ``''``. The difference
    matters: a blank still ends the search for the description or explanation.
    """
    keys = [k for k in doc_keys(wide) if not (k == "sheet" and sheet is not None)]
    explanation = _first_present(wide, EXPLANATION_KEYS)
    description = _first_present(wide, DESCRIPTION_KEYS)
    number = F.concat(F.lit("rule-"), (F.col("row_idx") + 1).cast("string"))
    label = [F.lit(sheet).alias("sheet")] if sheet is not None else []
    return wide.select(
        *keys,
        *label,
        "row_idx",
        F.coalesce(_first_truthy(wide, ID_KEYS), number).alias("rule_id"),
        F.coalesce(description, F.lit("")).alias("description"),
        F.coalesce(explanation, F.lit("")).alias("explanation"),
        severity(_first_truthy(wide, SEVERITY_KEYS), explanation).alias("severity"),
        parse_conditions(description).alias("conditions"),
    )


def rule_keys(rules: DataFrame) -> list[str]:
    return [*doc_keys(rules), "rule_id", "row_idx"]


def rule_conditions(rules: DataFrame) -> DataFrame:
    """One row per condition, ``pos`` from 0."""
    keys = rule_keys(rules)
    return rules.select(*keys, F.posexplode("conditions").alias("pos", "c")).select(
        *keys, "pos", "c.indicator", "c.operator", "c.value"
    )


def active(templates: Sequence[Template]) -> list[Template]:
    return [t for t in templates if t.status != "discarded"]


def rule_text(collapse: bool = True) -> Column:
    """Description and explanation, lower-cased; runs of white space as one space."""
    text = F.lower(
        F.concat(
            F.coalesce(F.col("description"), F.lit("")),
            F.lit(" "),
            F.coalesce(F.col("explanation"), F.lit("")),
        )
    )
    return F.regexp_replace(text, f"[{WS}]+", " ") if collapse else text


def any_contained(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word.lower())
    return hit


def template_match(
    text: Column, conditions: Column, template: Template, strict_operators: bool = False
) -> Column:
    """Does a rule cover a template?

    Every indicator has an alias in the text, and some keyword is in the text if there are
    keywords. The operator of a condition never decides: an alias found in a condition is in
    the text already. ``strict_operators`` asks for a condition with the agreeing operator
    instead.
    """

    def agreeing(item: Indicator) -> Column:
        return F.exists(
            conditions,
            lambda c: any_contained(F.lower(c["indicator"]), item.aliases)
            & (F.lit(True) if item.op is None else c["operator"] == item.op),
        )

    hit = F.lit(True)
    for item in template.indicators:
        hit = hit & (agreeing(item) if strict_operators else any_contained(text, item.aliases))
    return hit & any_contained(text, template.keywords) if template.keywords else hit


def _match_flags(
    rules: DataFrame, templates: Sequence[Template], strict_operators: bool
) -> Column:
    """One boolean per active template in a struct, from one look at the rule."""
    return let(
        rule_text(),
        lambda t: F.struct(
            *[
                template_match(t, F.col("conditions"), template, strict_operators).alias(f"t{i}")
                for i, template in enumerate(active(templates))
            ]
        ),
    )


def template_matches(
    rules: DataFrame, templates: Sequence[Template] = TEMPLATES, strict_operators: bool = False
) -> DataFrame:
    """Pairs ``(rule_id, row_idx, template_id)`` of rules and the active templates they cover.

    The library is a Python constant, so it is compiled into the scan: no join at all.
    """
    keys = rule_keys(rules)
    flags = rules.select(*keys, _match_flags(rules, templates, strict_operators).alias("m"))
    ids = [
        F.when(F.col(f"m.t{i}"), F.lit(t.template_id)) for i, t in enumerate(active(templates))
    ]
    return flags.select(*keys, F.explode(F.array_compact(F.array(*ids))).alias("template_id"))


def _coverage(
    rules: DataFrame, templates: Sequence[Template], strict_operators: bool, by: Sequence[str]
) -> DataFrame:
    """Per group: ``n_rules`` and ``c0``, ``c1`` … saying which active template is covered.

    One aggregate over one scan; the flags combine before the shuffle, so a group may hold any
    share of the rules.
    """
    flags = rules.select(*by, _match_flags(rules, templates, strict_operators).alias("m"))
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rules"),
        *[
            F.coalesce(F.bool_or(f"m.t{i}"), F.lit(False)).alias(f"c{i}")
            for i in range(len(active(templates)))
        ],
    )


def missing_combinations(
    rules: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    strict_operators: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Active templates covered by no rule, over all rules or per ``by`` group."""
    gaps = []
    for i, t in enumerate(active(templates)):
        evidence = F.lit(list(t.evidence)).cast("array<string>")
        gap = F.struct(
            F.lit(templates.index(t)).alias("ord"),
            F.lit(f"missing-{t.template_id}").alias("missing_id"),
            F.lit(t.template_id).alias("template_id"),
            F.lit(t.title).alias("indicator"),
            F.lit(t.summary).alias("suggestion"),
            F.lit(t.severity).alias("severity"),
            F.lit("suggested").alias("status"),
            evidence.alias("basis"),
        )
        gaps.append(F.when(~F.col(f"c{i}"), gap))
    covered = _coverage(rules, templates, strict_operators, by)
    return covered.select(*by, F.explode(F.array_compact(F.array(*gaps))).alias("g")).select(
        *by, "g.*"
    )


def first_gaps(missing: DataFrame, n: int) -> DataFrame:
    """The first gaps in library order, as a report shows them; of one gap in several groups by the group."""
    own = ("ord", "missing_id", "indicator", "suggestion", "severity", "status", "basis")
    return missing.orderBy("ord", *(c for c in missing.columns if c not in own)).limit(n)


def rule_check_summary(
    rules: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    strict_operators: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Number of rules and of coverage gaps, one row or one per ``by`` group."""
    gaps = F.lit(0).cast("bigint")
    for i in range(len(active(templates))):
        gaps = gaps + (~F.col(f"c{i}")).cast("bigint")
    return _coverage(rules, templates, strict_operators, by).select(
        *by, "n_rules", gaps.alias("n_gaps")
    )
