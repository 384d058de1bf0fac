"""Text rewrites of the abnormal-indicator sheet update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values. These patterns use Unicode word boundaries and white space.
_U = "(?iuU)"
ENGLISH_STEPS = [
    (rf"{_U}\bHematology System abnormalities\b", "hematological abnormalities"),
    (rf"{_U}\banti[- ]?metabolic\b", "antimetabolite"),
    (rf"{_U}\batypical granulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
    (rf"{_U}\bimmature granulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
    (rf"{_U}\bgranulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
    (rf"{_U}\be\s*\.\s*g\s*\.\s*,", "e.g.,"),
    (rf"{_U}\be\s*\.\s*g\s*\.\b", "e.g."),
]
# Every pattern above needs one of these, and one of these two letters.
ENGLISH_WORDS = rf"{_U}abnormalities|metabolic|granulocytes|g\s*\."
ENGLISH_LETTERS = "[gGmM]"
_KIND = "(?:abnormal|atypical|unclassified|immature|degenerated|reactive|early)"
_CELLS = (
    r"(?:granulocytes?|white\s+blood\s+cells?|wbc(?:s)?|monocytes?|nucleated\s+cells?"
    r"|cells?|components?)"
)
_KINDS = rf"{_KIND}(?:\s+{_KIND})*\s+"
QUALIFIER_STEPS = [
    (rf"{_U}\b(ALY#?)\s*\(\s*{_KINDS}{_CELLS}\s*\)", "$1 (atypical lymphocytes)"),
    (rf"{_U}\b(ALY#?)\s*\(\s*{_CELLS}\s*\)", "$1 (atypical lymphocytes)"),
    (rf"{_U}\b{_KINDS}{_CELLS}\s*\(\s*(ALY#?)\s*\)", "atypical lymphocytes ($1)"),
    (rf"{_U}\b{_CELLS}\s*\(\s*(ALY#?)\s*\)", "atypical lymphocytes ($1)"),
]


def cleanup_punct(c: Column) -> Column:
    """``。；`` -> ``；``, then ``；；`` -> ``；``."""
    return F.replace(F.replace(c, F.lit("。；"), F.lit("；")), F.lit("；；"), F.lit("；"))


def _chain(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def cleanup_english(c: Column) -> Column:
    """Five phrase fixes and two ``e.g.`` fixes; most cells hold none of their words."""
    relevant = c.rlike(ENGLISH_LETTERS) & c.rlike(ENGLISH_WORDS)
    return F.when(relevant, _chain(c, ENGLISH_STEPS)).otherwise(c)


def fix_qualifier(c: Column) -> Column:
    """``ALY# (atypical granulocytes)`` and its variants -> atypical lymphocytes."""
    return F.when(c.rlike("[aA][lL][yY]"), _chain(c, QUALIFIER_STEPS)).otherwise(c)


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in keywords:
        hit = hit | c.contains(word)
    return F.coalesce(hit, F.lit(False))


def prefix_text(c: Column, prefix: str, keywords: Sequence[str], sep: str) -> Column:
    """Put ``prefix`` in front unless a keyword is there already; an empty cell becomes it."""
    text = F.coalesce(c, F.lit(""))
    return (
        F.when(contains_any(text, keywords), text)
        .when(text == "", F.lit(prefix))
        .otherwise(cleanup_punct(F.concat(F.lit(prefix + sep), text)))
    )


def insert_disease(slots: Column, config: dict) -> Column:
    """Insert a finding into three ``struct<name,probability,analysis>`` slots.

    Priority 1 shifts the slots down and appends the analysis that falls out to the third;
    priority 2 takes the first slot without a name, else appends to the third analysis.
    Nothing happens when a *name* holds a keyword. The white-cell finding's own name holds
    none of its keywords, so a second run inserts it again.
    """
    new = F.struct(
        F.lit(config["name"]).alias("name"),
        F.lit(config["probability"]).alias("probability"),
        F.lit(config["analysis"]).alias("analysis"),
    )

    def joined(tail: Column, extra: Column) -> Column:
        """Analysis of slot three with ``extra`` appended."""
        return (
            F.when(F.coalesce(extra, F.lit("")) == "", tail)
            .when(F.coalesce(tail, F.lit("")) == "", extra)
            .otherwise(cleanup_punct(F.concat(tail, F.lit("；"), extra)))
        )

    def with_analysis(slot: Column, extra: Column) -> Column:
        return F.struct(
            slot["name"].alias("name"),
            slot["probability"].alias("probability"),
            joined(slot["analysis"], extra).alias("analysis"),
        )

    def shifted(s: Column) -> Column:
        return F.array(new, F.get(s, 0), with_analysis(F.get(s, 1), F.get(s, 2)["analysis"]))

    def first_free(s: Column) -> Column:
        free = [~F.coalesce(F.get(s, i)["name"].rlike(r"(?U)\S"), F.lit(False)) for i in range(3)]
        kept = [F.get(s, i) for i in range(3)]
        return (
            F.when(free[0], F.array(new, kept[1], kept[2]))
            .when(free[1], F.array(kept[0], new, kept[2]))
            .when(free[2], F.array(kept[0], kept[1], new))
            .otherwise(
                F.array(kept[0], kept[1], with_analysis(kept[2], F.lit(config["analysis"])))
            )
        )

    present = F.exists(slots, lambda x: contains_any(x["name"], config["keywords"]))
    place = shifted if config["priority"] == 1 else first_free
    return F.when(F.coalesce(present, F.lit(False)), slots).otherwise(let(slots, place))
