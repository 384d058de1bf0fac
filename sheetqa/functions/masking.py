"""Masking of codes, identifiers and format tokens, and putting them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import HYPHEN_CODE, UUID, has_cjk
from .text import WS, empty_pairs, let, replace_each

# What counts as an inline token and as a format token.
INLINE_TOKEN = r"[A-Za-z][A-Za-z0-9_\-/:+()#.]+"
FORMAT_TOKEN = (
    rf"%(?:[0-9]+\$)?[-+#0{WS}]*(?:[0-9]+)?(?:\.[0-9]+)?[a-zA-Z%]|\{{[0-9]+\}}"
)


def _token(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(f"__{prefix}_"), i.cast("string"), F.lit("__"))


def _state(text: Column, pairs: Column) -> Column:
    return F.struct(text.alias("sanitized"), pairs.alias("pairs"))


def _mask(text: Column, pattern: str, prefix: str, start: Column | None = None) -> Column:
    """One masking pass over bound ``text``: ``struct<sanitized, pairs>``."""

    def number(i: Column) -> Column:
        return i if start is None else i + start

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _state(
        replace_each(text, pattern, lambda m, i: _token(prefix, number(i))),
        F.transform(
            found, lambda m, i: F.struct(_token(prefix, number(i)).alias("k"), m.alias("v"))
        ),
    )


def _mask_more(state: Column, pattern: str, prefix: str, offset: bool) -> Column:
    """A further pass over the sanitized text, its pairs appended."""

    def more(s: Column) -> Column:
        start = F.size(s["pairs"]) if offset else None
        return let(
            _mask(s["sanitized"], pattern, prefix, start),
            lambda n: _state(n["sanitized"], F.concat(s["pairs"], n["pairs"])),
        )

    # Without a match the pass changes nothing, and most cells have none.
    return let(state, lambda s: F.when(s["sanitized"].rlike(pattern), more(s)).otherwise(s))


def _unmasked(c: Column) -> Column:
    return _state(F.coalesce(c, F.lit("")), empty_pairs())


def mask_inline(c: Column) -> Column:
    """Mask ASCII tokens inside CJK text as ``__TKN_i__``; other text is left alone."""
    return F.when(has_cjk(c), _mask(c, INLINE_TOKEN, "TKN")).otherwise(_unmasked(c))


def mask_translation(c: Column) -> Column:
    """``mask_inline``, then UUIDs and hyphenated codes as ``__ID_i__``, numbers continuing."""
    return _mask_more(_mask_more(mask_inline(c), UUID, "ID", True), HYPHEN_CODE, "ID", True)


def mask_format(c: Column) -> Column:
    """Mask ``%1$s``, ``%d``, ``{0}`` … as ``__FMT_i__``."""
    return F.when(c.rlike(FORMAT_TOKEN), _mask(c, FORMAT_TOKEN, "FMT")).otherwise(_unmasked(c))


def mask_string(c: Column) -> Column:
    """``mask_format``, then ``mask_inline``.

    In CJK text the second pass also masks the ``FMT_0__`` part of a ``__FMT_0__`` token,
    so masks nest; ``restore_tolerant`` undoes them in reverse order.
    """
    return let(
        mask_format(c),
        lambda s: F.when(
            has_cjk(s["sanitized"]), _mask_more(s, INLINE_TOKEN, "TKN", False)
        ).otherwise(s),
    )


def restore(c: Column, pairs: Column) -> Column:
    """Replace every placeholder by its text, in the order they were made."""
    return F.aggregate(pairs, c, lambda text, p: F.replace(text, p["k"], p["v"]))


def _repair(text: Column, key: Column, guard: str) -> Column:
    core = F.btrim(key, F.lit("_"))
    return F.regexp_replace(text, F.concat(F.lit("_{0,2}"), core, F.lit(guard + "_{0,2}")), key)


def restore_tolerant(c: Column, pairs: Column, compat: bool = False) -> Column:
    """``restore`` that first repairs lost underscores around a placeholder.

    Placeholders come back in reverse order, which undoes nested masks. ``compat=True``
    repairs all and restores in forward order instead: nested masks then leak, and the
    repair of number 1 also damages numbers 10 to 19.
    """
    if compat:
        repaired = F.aggregate(pairs, c, lambda text, p: _repair(text, p["k"], ""))
        return restore(repaired, pairs)
    return F.aggregate(
        F.reverse(pairs),
        c,
        lambda text, p: F.replace(_repair(text, p["k"], "(?![0-9])"), p["k"], p["v"]),
    )
