"""Clinical rule text: severity, conditions, theme, confidence, conflicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, has_text, js_trim, let

# Severity, theme and confidence word lists; the first match wins.
SEVERITY_WORDS = [("危|critical|严重", "critical"), ("警|warning|需关注", "warning")]
THEME_WORDS = [
    ("感染|infection|细菌", "infection"),
    ("贫血|anemia", "anemia"),
    ("过敏|allergy|嗜酸", "allergy"),
    ("出血|thrombocytopenia|血小板", "bleeding"),
    ("正常|无异常|stable", "normal"),
]
CONFIDENCE_WORDS = [("建议|需|should|recommended", 0.78), ("可能|suspect", 0.65)]
CONDITION_SEPARATOR = "[,;；、]"
CONDITION = rf"^([A-Za-z一-龥]+)[{WS}]*(↑|↓|高|低|异常|=|正常)?"


def _first(text: Column, words: list, default) -> Column:
    hits = [F.when(text.rlike(pattern), F.lit(value)) for pattern, value in words]
    return F.coalesce(*hits, F.lit(default))


def severity(c: Column, explanation: Column) -> Column:
    """Severity from the severity text, or from the explanation where that is empty."""
    text = F.lower(F.coalesce(F.nullif(c, F.lit("")), explanation, F.lit("")))
    return let(text, lambda t: _first(t, SEVERITY_WORDS, "normal"))


def normalise_op(c: Column) -> Column:
    """↑/高 -> ``>``, ↓/低 -> ``<``, =/正常 -> ``=``, anything else -> ``status``."""
    return (
        F.when((c == "↑") | c.contains("高"), ">")
        .when((c == "↓") | c.contains("低"), "<")
        .when((c == "=") | c.contains("正常"), "=")
        .otherwise("status")
    )


def parse_conditions(c: Column) -> Column:
    """``array<struct<indicator,operator,value>>`` from a rule description.

    The indicator class takes in CJK letters, so ``WBC高`` is one indicator with status
    while ``WBC 高`` and ``WBC↑`` parse; ``，`` and ``+`` do not separate conditions.
    """

    def condition(segment: Column) -> Column:
        def with_symbol(symbol: Column) -> Column:
            return F.struct(
                F.regexp_extract(segment, CONDITION, 1).alias("indicator"),
                normalise_op(symbol).alias("operator"),
                F.coalesce(F.nullif(symbol, F.lit("")), F.lit("status")).alias("value"),
            )

        return let(F.regexp_extract(segment, CONDITION, 2), with_symbol)

    segments = F.transform(F.split(F.coalesce(c, F.lit("")), CONDITION_SEPARATOR), js_trim)
    return F.transform(F.filter(segments, lambda s: s.rlike(CONDITION)), condition)


def theme(c: Column) -> Column:
    return let(F.lower(c), lambda t: _first(t, THEME_WORDS, "unknown"))


def confidence(c: Column) -> Column:
    return let(F.lower(c), lambda t: _first(t, CONFIDENCE_WORDS, 0.5))


def conflicts(kb_theme: Column, model_theme: Column, name: str) -> Column:
    """Messages where a model's theme contradicts the knowledge base's."""
    # Message texts.
    messages = [
        ((kb_theme == "infection") & (model_theme == "normal"), " 判定“正常”，与感染提示不一致"),
        ((kb_theme == "anemia") & (model_theme == "normal"), " 未提示贫血，结果需人工确认"),
        ((kb_theme == "bleeding") & (model_theme != "bleeding"), " 未强调出血风险"),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name + text)) for hit, text in messages]))


def aggregate_summary(conclusions: Column) -> Column:
    """``model: text`` per line, in the order of the conclusions."""
    return F.array_join(
        F.transform(conclusions, lambda x: F.concat(x["model"], F.lit(": "), x["text"])), "\n"
    )


def prompt_text(description: Column, explanation: Column, template: Column) -> Column:
    """The three facts a model is asked about, with defaults for blanks."""

    def fact(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    # Labels and defaults.
    return F.concat(
        F.lit("- 组合描述："),
        fact(description, "未提供"),
        F.lit("\n- 已有解读："),
        fact(explanation, "暂无"),
        F.lit("\n- 模板参考："),
        fact(template, "无"),
    )


def is_blank(c: Column) -> Column:
    return ~F.coalesce(has_text(c), F.lit(False))
