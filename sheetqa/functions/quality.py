"""Per-cell quality tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import has_cjk, is_locked
from .text import B_END, B_START, WORD, WS

# The four spacing faults and the placeholder form.
PLACEHOLDER = r"__(?:TKN|ID|FMT)_[0-9]+__"
# A pattern starts with its rarest character and looks back, which spares most positions.
BROKEN_EG = rf"[eE](?<![{WORD}][eE])[{WS}]*\.[{WS}]*[gG][{WS}]*\."
SPACE_RUN = "  "
SPACE_BEFORE_PUNCT = rf"[,.;:!?](?<=[{WS}][,.;:!?])"
SPLIT_CODE = (
    rf"[A-Za-z](?<![{WORD}][A-Za-z])[{WS}]+[0-9]{{1,3}}{B_END}"
    rf"|{B_START}[0-9]{{1,3}}[{WS}]+[A-Za-z]{B_END}"
)


def spacing_issue(c: Column) -> Column:
    """Broken or correct ``e.g.``, a run of spaces, space before punctuation, ``T 4``."""
    return (
        c.contains(SPACE_RUN)
        | c.rlike(SPACE_BEFORE_PUNCT)
        | (c.contains(".") & c.rlike(BROKEN_EG))
        | (c.rlike("[0-9]") & c.rlike(SPLIT_CODE))
    )


def placeholder_leak(c: Column) -> Column:
    return c.contains("__") & c.rlike(PLACEHOLDER)


def cjk_residue(c: Column) -> Column:
    return has_cjk(c)


def id_mismatch(key: Column, original: Column, translated: Column) -> Column:
    """A locked original that changed; the lock looks at the original only."""
    return is_locked(key, original) & F.coalesce(translated != original, F.lit(True))
