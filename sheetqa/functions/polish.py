"""Wording and spacing repair of translated text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .glossary import GLOSSARY, GlossaryEntry, enforce_glossary
from .text import B_END, B_START, WORD, WS, WS_INLINE, is_ascii, let, utf16_length

# White space inside a line: a carriage return counts unless it belongs to a line break.
_ANY_SPACE = rf"(?:[{WS_INLINE}]|\r(?!\n))"
_ASCII_SPACE = r"[\t\x0B\f ]"
# White space beyond ASCII, and the carriage return.
RARE_SPACE = r"[\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def spacing_steps(space: str) -> list[tuple[str, str]]:
    """The nine spacing rewrites, in order.

    Every rewrite works line by line; the patterns never reach across a line break, so one
    pass over the whole text is the same.
    """
    not_closed = rf"(?!{space}|[\"')\]}}])"
    return [
        (rf"([eE])(?<![{WORD}][eE]){space}*\.{space}*g{space}*\.", "$1.g."),
        (rf"{space}+([,.;:!?])", "$1"),
        (rf"([,.;!?]){not_closed}", "$1 "),
        (rf":(?!//){not_closed}", ": "),
        (r"([.!?])([A-Z])", "$1 $2"),
        (r"([a-z])([A-Z][a-z])", "$1 $2"),
        (r"([0-9])([A-Za-z])", "$1 $2"),
        (r"([A-Za-z])([0-9])", "$1 $2"),
        (r"(?<=[^\n ]) {2,}", " "),
    ]


def _spacing_signs(space: str) -> dict[int, Callable[[Column], Column]]:
    """Tests without which a spacing rewrite, by its place, changes nothing.

    They look for what is rare (a mark, an upper-case letter, a digit) where the rewrite itself
    has to try every letter or space.
    """
    return {
        0: lambda t: t.contains(".") & t.rlike(rf"\.{space}*g{space}*\."),
        1: lambda t: t.rlike(rf"[,.;:!?](?<={space}[,.;:!?])"),
        3: lambda t: t.contains(":"),
        5: lambda t: t.rlike("[A-Z](?<=[a-z][A-Z])[a-z]"),
        7: lambda t: t.rlike("[0-9](?<=[A-Za-z][0-9])"),
        8: lambda t: t.contains("  "),
    }


LONG_FORM_LENGTH = 60


def _word(pattern: str, flags: str = "(?i)") -> str:
    # The first letters come first: they spare most positions the look back.
    first = "sm" if pattern.startswith("(slight|mild)") else pattern[0]
    return f"{flags}(?=[{first}]){B_START}{pattern}{B_END}"


_GAP = f"[{WS}]+"
# Wording of status terms inside sentences, in order. Where the first letter
# decides the case of the result there is one pattern per case.
STATUS_STEPS = [
    (_word("Elevated fever"), "high fever"),
    (_word("An Elevated"), "An increase"),
    (_word("A Decreased"), "A decrease"),
    (_word("An Decreased"), "A decrease"),
    (_word(f"(slight|mild){_GAP}Elevated"), "$1 increase"),
    (_word(f"(slight|mild){_GAP}Decreased"), "$1 decrease"),
    (_word("E(?i:levated in)", ""), "Increase in"),
    (_word("e(?i:levated in)", ""), "increase in"),
    (_word("D(?i:ecreased in)", ""), "Decrease in"),
    (_word("d(?i:ecreased in)", ""), "decrease in"),
    (
        _word(f"Elevated total (spherocytes|ghost cells|reticulocytes){_GAP}is"),
        "Elevated total $1 are",
    ),
]


def _chain(
    c: Column, steps: Sequence[tuple[str, str]], signs: dict[int, Callable[[Column], Column]]
) -> Column:
    """The rewrites in order; one with a sign only where its text shows it."""

    def step(i: int, pattern: str, replacement: str) -> Callable[[Column], Column]:
        def rewritten(t: Column) -> Column:
            return F.when(signs[i](t), F.regexp_replace(t, pattern, replacement)).otherwise(t)

        return rewritten

    for i, (pattern, replacement) in enumerate(steps):
        c = let(c, step(i, pattern, replacement)) if i in signs else F.regexp_replace(c, pattern, replacement)
    return c


def fix_spacing(c: Column) -> Column:
    """Spacing repair; text without Latin letters is left alone.

    Contract quirks: a closing ``.`` gains a space (``Done.`` -> ``Done. ``), decimals are
    split (``3.5`` -> ``3. 5``) and ``e.g.,`` ends as ``e. g. ,``.
    """
    rare = F.when(is_ascii(c), c.contains("\r")).otherwise(c.rlike(RARE_SPACE))
    return (
        F.when(~c.rlike("[A-Za-z]"), c)
        .when(rare, _chain(c, spacing_steps(_ANY_SPACE), _spacing_signs(_ANY_SPACE)))
        # With ASCII spaces only, the patterns need just a few characters to test.
        .otherwise(_chain(c, spacing_steps(_ASCII_SPACE), _spacing_signs(_ASCII_SPACE)))
    )


def long_form_status(c: Column) -> Column:
    """Status wording in sentences: more than 60 characters, or any of ``.;:!?``."""
    is_long = (F.length(c) > LONG_FORM_LENGTH) | c.rlike("[.;:!?]")
    # Only text of 31 to 60 characters can change sides when counted in UTF-16 units.
    is_long = is_long | ((F.length(c) > LONG_FORM_LENGTH // 2) & (utf16_length(c) > LONG_FORM_LENGTH))
    # Every rewrite needs one of the two status words.
    relevant = c.rlike("(?i)elevated|decreased")
    return F.when(relevant & is_long, _chain(c, STATUS_STEPS, {})).otherwise(c)


def polish(
    original: Column, c: Column, glossary: Sequence[GlossaryEntry] = GLOSSARY
) -> Column:
    """``fix_spacing``, then ``enforce_glossary``, then ``long_form_status``."""
    return let(
        fix_spacing(c),
        lambda spaced: let(
            enforce_glossary(F.coalesce(original, F.lit("")), spaced, glossary), long_form_status
        ),
    )


def string_autofix(c: Column) -> Column:
    """``fix_spacing``, then rejoin a single letter and its number: ``T 4`` -> ``T4``."""
    return F.regexp_replace(
        fix_spacing(c), f"{B_START}([A-Za-z])[{WS}]+([0-9]{{1,3}}){B_END}", "$1$2"
    )
