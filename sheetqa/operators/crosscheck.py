"""Cross-checking rule interpretations from the template library and model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import (
    aggregate_summary,
    confidence,
    conflicts,
    prompt_text,
    theme,
)
from ..functions.library import TEMPLATES, Template
from ..functions.text import has_text, js_trim, let
from ..schema import doc_keys
from .rules import active, any_contained, rule_keys, rule_text

# Answering models in report order, confidences and wording.
MODELS = ["OpenRouter", "Deepseek"]
KB_CONFIDENCE = (0.82, 0.55)
NO_TEXT = "尚无解读，请补充对应资料。"
NO_TEMPLATE = "建议补充临床解释或参考 AI 建议。"


def _first_template(templates: Sequence[Template]) -> Column:
    """Position of the first active template, in library order, all of whose indicators occur.

    Keywords play no part here, so this may disagree with the coverage check.
    """

    def first(text: Column) -> Column:
        hits = []
        for i, template in enumerate(active(templates)):
            every = F.lit(True)
            for item in template.indicators:
                every = every & any_contained(text, item.aliases)
            hits.append(F.when(every, F.lit(i)))
        return F.coalesce(*hits, F.lit(None).cast("int"))

    return let(rule_text(collapse=False), first)


def kb_conclusion(rules: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Add ``kb_template`` (its summary), ``kb_text``, ``kb_confidence``, ``kb_theme``,
    ``kb_recommendation``."""
    live = active(templates)
    summaries = F.array(*[F.lit(t.summary) for t in live])
    titles = F.array(*[F.lit(t.title) for t in live])
    hit = F.col("_hit")
    blank = F.lit("")
    base = F.coalesce(
        F.get(summaries, hit),
        F.nullif("explanation", blank),
        F.nullif("description", blank),
        F.lit(NO_TEXT),
    )
    advice = F.concat(
        F.lit("建议依据「"), F.get(titles, hit), F.lit("」模板提示："), F.get(summaries, hit)
    )
    return (
        rules.withColumn("_hit", _first_template(templates))
        .withColumn("_base", base)
        .withColumn("kb_template", F.get(summaries, hit))
        .withColumn("kb_text", F.concat(F.lit("知识库："), F.col("_base")))
        .withColumn("kb_confidence", F.when(hit.isNotNull(), KB_CONFIDENCE[0]).otherwise(KB_CONFIDENCE[1]))
        .withColumn("kb_theme", theme(F.col("_base")))
        .withColumn("kb_recommendation", F.coalesce(advice, F.lit(NO_TEMPLATE)))
        .drop("_hit", "_base")
    )


def prompt_rows(rules: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """What each rule's question to a model contains."""
    return kb_conclusion(rules, templates).select(
        *rule_keys(rules),
        prompt_text(F.col("description"), F.col("explanation"), F.col("kb_template")).alias(
            "prompt"
        ),
    )


def answers_by_rule(answers: DataFrame) -> DataFrame:
    """One row per rule with a column per model from ``answers([doc keys,] rule_id, model, text)``.

    Blank answers are ignored. A maximum per model combines before the shuffle, so a rule with
    very many answer rows does not become one large group.
    """
    text = js_trim(F.col("text"))
    keys = [*doc_keys(answers), "rule_id"]
    return answers.filter(has_text(F.col("text"))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, text)).alias(m) for m in MODELS]
    )


def _conclusion(model: Column, text: Column, score: Column) -> Column:
    return F.struct(
        model.alias("model"), text.alias("text"), score.cast("double").alias("confidence")
    )


def cross_check(
    rules: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Per rule: conclusions in model order, conflicts, summary and recommendation.

    Rows with the same ``rule_id`` in one sheet share its answers.
    """
    checked = kb_conclusion(rules, templates)
    if answers is None:
        for m in MODELS:
            checked = checked.withColumn(m, F.lit(None).cast("string"))
    else:
        keys = [*doc_keys(answers), "rule_id"]
        checked = checked.join(answers_by_rule(answers), keys, "left")

    said = [
        F.when(F.col(m).isNotNull(), _conclusion(F.lit(m), F.col(m), confidence(F.col(m))))
        for m in MODELS
    ]
    own = _conclusion(F.lit("Heuristic"), F.col("kb_text"), F.col("kb_confidence"))

    def conflicts_of(model: str) -> Column:
        return let(theme(F.col(model)), lambda t: conflicts(F.col("kb_theme"), t, model))

    none = F.expr("cast(array() as array<string>)")
    found = [F.when(F.col(m).isNotNull(), conflicts_of(m)).otherwise(none) for m in MODELS]
    n = F.size("conflicts")
    review = F.concat(
        F.lit("检测到 "),
        n.cast("string"),
        F.lit(" 个冲突，请人工复核（"),
        F.array_join("conflicts", "；"),
        F.lit("）。"),
    )
    return (
        checked.withColumn("conclusions", F.array_compact(F.array(own, *said)))
        .withColumn("conflicts", F.flatten(F.array(*found)))
        .select(
            *rule_keys(rules),
            aggregate_summary(F.col("conclusions")).alias("summary"),
            F.when(n > 0, review).otherwise(F.col("kb_recommendation")).alias("recommendation"),
            "conclusions",
            "conflicts",
        )
    )


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first findings by document, row and rule, as a report shows them; ties have equal keys."""
    order = [*doc_keys(findings), *(c for c in ("row_idx", "rule_id") if c in findings.columns)]
    return findings.orderBy(*order).limit(n)
