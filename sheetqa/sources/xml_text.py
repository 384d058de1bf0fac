"""Text nodes of XML or HTML held in a string column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, replace_each

_REFERENCE = r"&(?:lt|gt|quot|apos|amp|#[0-9]+|#[xX][0-9A-Fa-f]+);"
# The predefined entities.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
# Comments and CDATA sections; while tags are matched, one mark with its number stands for each,
# and another for the character that begins a mark.
_SPECIAL = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
_MARK = "\ufdd0"
_OWN_MARK = "\ufdd0#\ufdd1"
_MARKED = "\ufdd0([0-9]+|#)\ufdd1"
_MARK_REFERENCE = "&#(?:0*64976|[xX]0*[fF][dD][dD]0);"
_ATTRIBUTES = r"""(?:\s(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*+)?"""

_MARKUP = r"""<(?:[^>"']++|"[^"]*"|'[^']*')*+>|<[^>]*>"""


def _tag_pattern(tags: list[str]) -> str:
    names = "|".join(map(re.escape, tags))
    return rf"(?s)<(?:{names}){_ATTRIBUTES}/?>|</(?:{names})\s*>"


def _totals(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of a list, by doubling: a pass per bit of its length, none of which copies it more than once."""
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1))

    def doubled(so_far: Column, k: Column) -> Column:
        return let(
            F.call_function("shiftleft", F.lit(1), k),
            lambda d: F.transform(so_far, lambda x, i: F.when(i >= d, combine(x, F.get(so_far, i - d))).otherwise(x)),
        )

    return F.when(F.size(values) > 1, F.aggregate(passes, values, doubled)).otherwise(values)


def outermost(spans: Column) -> Column:
    """Those of the sorted spans ``struct<open, close, …>`` that lie in no other; spans nest or part."""
    ends = _totals(F.transform(spans, lambda x: x["close"]), lambda x, y: F.greatest(x, y))
    return let(ends, lambda e: F.filter(spans, lambda x, i: (i == 0) | (F.get(e, i - 1) < x["open"])))


def _spans(tags: Column, name: str) -> Column:
    """Elements ``name`` as ``struct<open, close>`` of places in ``tags``, in document order.

    An opening tag's level is the depth behind it, a closing tag's the depth before it. On one
    level, an element's end is what follows its beginning. Where the tags do not balance there is no
    nesting to go by: an element then ends at the first closing tag, whatever lies between.
    """
    own = F.filter(
        F.transform(tags, lambda t, i: F.struct(i.alias("at"), t.alias("tag"))),
        lambda x: F.regexp_extract(x["tag"], r"^</?([^\s/>]+)", 1) == name,
    )

    def step(tag: Column) -> Column:
        return F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1)

    def from_own(o: Column) -> Column:
        depths = _totals(F.transform(o, lambda x: step(x["tag"])), lambda x, y: x + y)

        def from_depths(d: Column) -> Column:
            placed = F.zip_with(
                o,
                d,
                lambda x, depth: F.struct(
                    (depth + F.when(x["tag"].startswith("</"), 1).otherwise(0)).alias("level"),
                    x["at"].alias("at"),
                    step(x["tag"]).alias("step"),
                ),
            )
            # Empty elements are whole and take no part in the pairing.
            empty = F.transform(
                F.filter(placed, lambda x: x["step"] == 0), lambda x: F.struct(x["at"].alias("open"), x["at"].alias("close"))
            )

            def paired(p: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    after = F.get(p, i + 1)
                    ends = (x["step"] == 1) & (after["step"] == -1) & (after["level"] == x["level"])
                    return F.when(ends, F.struct(x["at"].alias("open"), after["at"].alias("close")))

                return F.array_sort(F.concat(empty, F.array_compact(F.transform(p, one))))

            def by_first_end(p: Column) -> Column:
                """Of tags that do not balance: the first of each run of opening and of closing ones."""
                runs = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["step"], F.lit(-1)) != x["step"])

                def pairs(r: Column) -> Column:
                    found = F.transform(
                        r, lambda x, i: F.when(x["step"] == 1, F.struct(x["at"].alias("open"), F.get(r, i + 1)["at"].alias("close")))
                    )
                    return F.filter(found, lambda x: x["close"].isNotNull())

                return let(F.array_sort(F.concat(empty, let(runs, pairs))), outermost)

            rest = F.filter(placed, lambda x: x["step"] != 0)
            balanced = F.coalesce((F.get(d, F.size(d) - 1) == 0) & (F.array_min(d) >= 0), F.lit(True))
            return F.when(balanced, let(F.array_sort(rest), paired)).otherwise(let(rest, by_first_end))

        return let(depths, from_depths)

    return let(own, from_own)


def _elements(df: DataFrame, col: str, tags: list[str]) -> DataFrame:
    """Add ``_gaps`` and ``_tags``, the text cut at all tags, and ``_nodes``, the elements of each of ``tags`` in turn."""
    pattern = F.lit(_tag_pattern(tags))
    cut = df.withColumns(
        {"_tags": F.regexp_extract_all(col, pattern, F.lit(0)), "_gaps": F.split(col, pattern, -1)}
    )
    return cut.withColumn("_nodes", F.concat(*(_spans(F.col("_tags"), tag) for tag in tags)))


def _between(first: Column, last: Column) -> Column:
    """The text behind tag ``first`` up to tag ``last``: gaps, and the tags that lie between."""
    gaps = F.slice("_gaps", first + 2, last - first)
    inner = F.slice("_tags", first + 2, F.greatest(last - first - 1, F.lit(0)))
    return F.array_join(F.zip_with(gaps, inner, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def _has_special(c: Column) -> Column:
    return c.contains("<!--") | c.contains("<![CDATA[")


def _plain(c: Column) -> Column:
    """The text with its own mark characters as marks."""
    return F.replace(c, F.lit(_MARK), F.lit(_OWN_MARK))


def _marked(c: Column) -> Column:
    """The text with a numbered mark for each comment and CDATA section."""
    marks = let(
        _plain(c),
        lambda t: replace_each(
            t, _SPECIAL, lambda _, i: F.concat(F.lit(_MARK), i.cast("string"), F.lit("\ufdd1"))
        ),
    )
    return F.when(_has_special(c), marks).otherwise(_plain(c))


def _unmarked(c: Column, specials: Column, inner: bool) -> Column:
    """Marks replaced: by their sections as they were, or (``inner``) by what they mean as text."""

    def back(mark: Column, _: Column) -> Column:
        section = F.get(specials, F.regexp_extract(mark, "[0-9]+", 0).try_cast("int"))
        meant = F.when(section.startswith("<![CDATA["), F.substr(section, F.lit(10), F.length(section) - 12))
        return F.when(mark == _OWN_MARK, F.lit(_MARK)).otherwise(
            F.coalesce(meant, F.lit("")) if inner else section
        )

    return F.when(c.contains(_MARK), let(c, lambda t: replace_each(t, _MARKED, back))).otherwise(c)


def _specials(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(_SPECIAL), F.lit(0))
    return F.when(_has_special(c), found).otherwise(F.array().cast("array<string>"))


def unescape(c: Column) -> Column:
    """Entities and character references decoded, each once."""

    def character(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def decode(m: Column) -> Column:
        named = F.coalesce(*[F.when(m == k, F.lit(v)) for k, v in _ENTITIES.items()])
        # Leading zeros add nothing; over seven digits is beyond every character.
        digits = F.regexp_extract(m, "#[xX]?0*([0-9A-Fa-f]+);", 1)
        digits = F.when(F.length(digits) <= 7, digits)
        base = F.when(m.rlike("^&#[xX]"), 16).otherwise(10)
        code = F.conv(digits, 16, 10).cast("bigint")
        code = F.when(base == 16, code).otherwise(digits.try_cast("bigint"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(named, F.when(valid, character(code)), m)

    return F.when(
        c.contains("&"), let(c, lambda t: replace_each(t, _REFERENCE, lambda m, _: decode(m)))
    ).otherwise(c)


def _mark_references(c: Column) -> Column:
    """References to the mark character as marks, so that they do not become part of one."""
    return F.when(c.contains("&#"), F.regexp_replace(c, _MARK_REFERENCE, _OWN_MARK)).otherwise(c)


def escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _held(node: Column) -> Column:
    """What lies between the tags of an element; an empty element holds nothing."""
    return F.when(node["open"] == node["close"], F.lit("")).otherwise(_between(node["open"], node["close"]))


def _meant(raw: Column) -> Column:
    """The text of what an element holds, its sections still as marks."""
    return unescape(_mark_references(F.regexp_replace(raw, _MARKUP, "")))


def xml_text_nodes(
    df: DataFrame, col: str, tags: str | list[str] = ("w:t", "t"), by: list[str] | None = None
) -> DataFrame:
    """``(by…, node_idx, value)``: text of the given elements in document order.

    All nodes of the first tag come before those of the next. An element inside another of its
    name is a node of its own, and its text is part of the outer one's as well. Markup inside a node
    is dropped, references are decoded, CDATA counts as text; nodes inside comments do not count.
    A name whose tags do not balance has no nesting: its nodes end at their first closing tag.
    """
    tags = [tags] if isinstance(tags, str) else list(tags)
    by = [c for c in df.columns if c != col] if by is None else by
    marked = df.select(*by, _marked(F.col(col)).alias("_marked"), _specials(F.col(col)).alias("_specials"))
    raw = _held(F.col("_node"))
    return (
        _elements(marked, "_marked", tags)
        .select(*by, "_specials", "_gaps", "_tags", F.posexplode("_nodes").alias("node_idx", "_node"))
        .select(*by, "node_idx", "_specials", raw.alias("_raw"))
        .select(*by, "node_idx", "_specials", _meant(F.col("_raw")).alias("_text"))
        .select(*by, "node_idx", _unmarked(F.col("_text"), F.col("_specials"), True).alias("value"))
    )


def write_xml_text(
    df: DataFrame,
    col: str,
    tags: str | list[str],
    nodes: DataFrame,
    by: list[str],
    value: str = "value",
) -> DataFrame:
    """Put new texts ``nodes(by…, node_idx, value)`` into the elements of ``col``.

    ``tags`` and the numbers are those of ``xml_text_nodes``: a tag's nodes are numbered after
    those of the tags before it. A node's new text replaces all it held, other nodes too; new texts
    of these are then without effect. A document's nodes are collected next to its own text,
    which already is one value. Nodes without a new text stay, and so does one whose text is the new
    one already, unless it holds tags: the same text may be written in many ways (``&quot;``, ``&#65;``).
    """
    tags = [tags] if isinstance(tags, str) else list(tags)
    new = F.array_sort(F.collect_list(F.struct("node_idx", F.col(value).alias("text"))))
    texts = nodes.where(F.col(value).isNotNull()).groupBy(*by).agg(new.alias("_texts"))
    joined = df.join(texts, by, "left").withColumns({"_marked": _marked(F.col(col)), "_specials": _specials(F.col(col))})

    def filled(x: Column) -> Column:
        start = F.regexp_replace(F.get("_tags", x["open"]), r"\s*/?>$", ">")
        name = F.regexp_extract(start, r"^<([^\s>]+)", 1)
        return F.concat(start, _plain(escape(x["text"])), F.lit("</"), name, F.lit(">"))

    def rebuilt(chosen: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(chosen, i - 1)["close"], F.lit(-1))
            return F.concat(_between(before, x["open"]), filled(x))

        last = F.coalesce(F.get(chosen, F.size(chosen) - 1)["close"], F.lit(-1))
        return F.concat(F.array_join(F.transform(chosen, piece), ""), _between(last, F.size("_tags")))

    def same(raw: Column, text: Column) -> Column:
        return ~raw.contains("<") & F.coalesce(_unmarked(_meant(raw), F.col("_specials"), True) == text, F.lit(False))

    # Numbers that name no element are passed over, and texts that are there already.
    placed = F.filter(
        F.transform(
            "_texts",
            lambda x: F.struct(
                F.get("_nodes", x["node_idx"].cast("int"))["open"].alias("open"),
                F.get("_nodes", x["node_idx"].cast("int"))["close"].alias("close"),
                x["text"].alias("text"),
            ),
        ),
        lambda x: x["open"].isNotNull() & ~let(_held(x), lambda raw: same(raw, x["text"])),
    )
    out = _elements(joined, "_marked", tags).withColumn(
        # New texts inside an element that gets one itself are left out.
        "_marked",
        let(F.array_sort(placed), lambda p: let(outermost(p), rebuilt)),
    )
    changed = _unmarked(F.col("_marked"), F.col("_specials"), False)
    return out.withColumn(
        col, F.when(F.col("_texts").isNull(), F.col(col)).otherwise(changed)
    ).drop("_texts", "_marked", "_specials", "_tags", "_gaps", "_nodes")
