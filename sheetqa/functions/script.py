"""Cell classification by script and shape: CJK, code, identifier, locked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B_END, B_START, WS, has_text, js_trim

# The character classes and patterns that define each kind of cell.
CJK = r"[一-鿿]"
CYRILLIC = r"[Ѐ-ӿ]"
CJK_OR_CYRILLIC = r"[一-鿿Ѐ-ӿ]"
LATIN = r"[A-Za-zÀ-ɏ]"
ANY_SCRIPT = r"[A-Za-zÀ-ɏ一-鿿Ѐ-ӿ]"
SYMBOLS_ONLY = rf"^[{WS}\-–—=+<>↑↓*·•.()（）【】\[\]{{}}\\/]+\z"
CODE_WITH_ARROW = r"^[A-Z]{1,6}[#%]?[↑↓]?\z"
SHORT_CODE = r"^[A-Z0-9#%+_.\-/]{1,6}\z"
LONGEST_CODE = 8
LOCKED_KEY = rf"(?i)(?:uuid|(?:^|[_{WS}-])id\z|编号|序号|唯一标识)"
ID_WORD = r"(?i)^(?:id|uuid)\z"
UUID = rf"{B_START}[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}{B_END}"
HYPHEN_CODE = (
    rf"{B_START}(?=[0-9A-Za-z-]*[A-Za-z])(?=[0-9A-Za-z-]*[0-9])"
    rf"[0-9A-Za-z]+(?:-[0-9A-Za-z]+)+{B_END}"
)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def has_cyrillic(c: Column) -> Column:
    return c.rlike(CYRILLIC)


def has_latin(c: Column) -> Column:
    return c.rlike(LATIN)


def is_code(t: Column) -> Column:
    """An upper-case code with an optional arrow, or a code of up to 6, in trimmed text."""
    return (F.length(t) <= LONGEST_CODE) & (t.rlike(CODE_WITH_ARROW) | t.rlike(SHORT_CODE))


def is_neutral_trimmed(t: Column) -> Column:
    """``is_neutral`` for text that is already trimmed."""
    return t.rlike(SYMBOLS_ONLY) | is_code(t)


def is_neutral(c: Column) -> Column:
    """Only symbols or arrows, an upper-case code with an optional arrow, or a code of up to 6."""
    return is_neutral_trimmed(js_trim(c))


def is_identifier(c: Column) -> Column:
    """Contains a UUID, or a hyphenated alphanumeric with a letter and a digit."""
    # Both shapes need a hyphen: a plain substring search spares most cells the two patterns.
    return c.contains("-") & (c.rlike(UUID) | c.rlike(HYPHEN_CODE))


def is_locked_key(key: Column) -> Column:
    return key.rlike(LOCKED_KEY)


def is_locked(key: Column, value: Column) -> Column:
    """A non-blank cell without CJK that sits in an id column or holds an identifier."""
    locked = has_text(value) & ~has_cjk(value) & (is_locked_key(key) | is_identifier(value))
    return F.coalesce(locked, F.lit(False))
