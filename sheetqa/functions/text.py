"""Small building blocks shared by every Column function.

The contract these functions follow treats the no-break space, the ideographic space and
the byte-order mark as white space and counts string length in UTF-16 units. Spark's
``\\s``, ``trim`` and ``length`` do not, so the explicit forms below are used instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space: as code points, and as members of a regex character class (no brackets).
_SPACES = [0x9, 0xB, 0xC, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029]
_SPACES += [0x202F, 0x205F, 0x3000, 0xFEFF]
WS_INLINE = "".join(f"\\x{{{code:X}}}" for code in _SPACES)
WS = r"\n\r" + WS_INLINE
WS_CHARS = "\n\r" + "".join(map(chr, _SPACES))

# ASCII word boundaries; Spark's own \b is not ASCII-only on every Java release.
WORD = "0-9A-Za-z_"
B_START = f"(?<![{WORD}])"
B_END = f"(?![{WORD}])"

PAIRS_TYPE = "array<struct<k:string,v:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Repeating a Column in an expression repeats its evaluation once it sits in a branch of
    ``when`` (Spark shares only subexpressions that are always evaluated). A lambda
    variable over a one-element array is evaluated exactly once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words that tells them apart letter by letter, longer ones first."""
    words = sorted(set(words))
    by_first: dict[str, list[str]] = {}
    for word in words:
        if word:
            by_first.setdefault(word[0], []).append(word[1:])
    branches = [re.escape(first) + (any_of(rest) if any(rest) else "") for first, rest in by_first.items()]
    return f"(?:{'|'.join(branches)}){'?' if '' in words else ''}"


def empty_pairs() -> Column:
    return F.expr(f"cast(array() as {PAIRS_TYPE})")


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def has_text(c: Column) -> Column:
    """At least one character that is not white space."""
    return c.rlike(f"[^{WS}]")


def is_ascii(c: Column) -> Column:
    """Byte count against character count: no regex, no decoding."""
    return F.octet_length(c) == F.length(c)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def replace_each(
    text: Column, pattern: Column | str, fill: Callable[[Column, Column], Column]
) -> Column:
    """Replace the i-th match ``m`` of ``pattern`` by ``fill(m, i)``.

    Stays in the JVM: the matches and the gaps between them are extracted and interleaved.
    ``text`` and ``pattern`` are evaluated twice, so bind costly expressions with ``let``.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    filled = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), fill)
    gaps = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(gaps, filled, lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))), ""
    )


def json_quote(c: Column) -> Column:
    """A string as a JSON string literal."""
    return let(F.to_json(F.array(c)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
