"""SQL fragments for DuckDB: the operators' rules written again for another engine.

RE2 has no lookaround; where a rule needs one, the text is marked, the marks that do not
count are removed, and the rest is replaced.
"""

from __future__ import annotations

from .expected import GLOSSARY, LANGUAGE_HINTS, LANGUAGE_MARKS

WS = (
    r"\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
CJK = "[一-鿿]"
MARK = "\x01"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def sub(c: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(replacement)}, 'g')"


def trim(c: str) -> str:
    return sub(c, rf"^[{WS}]+|[{WS}]+$", "")


def text(c: str) -> str:
    return like(c, f"[^{WS}]")


def neutral(t: str) -> str:
    """For trimmed text."""
    symbols = rf"^[{WS}\-–—=+<>↑↓*·•.()（）【】\[\]{{}}\\/]+$"
    return (
        f"({like(t, symbols)} or {like(t, '^[A-Z]{1,6}[#%]?[↑↓]?$')} "
        f"or {like(t, '^[A-Z0-9#%+_.\\-/]{1,6}$')})"
    )


def identifier(c: str) -> str:
    uuid = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
    code = r"\b[0-9A-Za-z]+(?:-[0-9A-Za-z]+)+\b"
    return (
        f"({like(c, uuid)} or len(list_filter(regexp_extract_all({c}, {q(code)}), "
        f"lambda m: {like('m', '[A-Za-z]')} and {like('m', '[0-9]')})) > 0)"
    )


def locked_key(k: str) -> str:
    return like(k, rf"(?i)(uuid|(^|[_{WS}\-])id$|编号|序号|唯一标识)")


def locked(k: str, v: str) -> str:
    return f"({text(v)} and not {like(v, CJK)} and ({locked_key(k)} or {identifier(v)}))"


def scored(src: str, col: str, code: str) -> str:
    """CTEs over ``src`` that end in ``lg``: ``t`` trimmed, ``sc`` scores, ``is_target``."""
    scores = []
    for lang, words in LANGUAGE_HINTS.items():
        listed = ",".join(q(w) for w in words)
        marks = f"(?i)[{LANGUAGE_MARKS[lang]}]"
        scores.append(
            f"len(list_filter(tk, lambda w: w in ({listed}))) + "
            f"case when {like('t', marks)} then 2 else 0 end"
        )
    langs = ",".join(q(x) for x in LANGUAGE_HINTS)
    return f"""
lg0 as (select *, {trim(col)} as t from ({src}) s0),
lg1 as (select *, string_split_regex(strip_accents(lower(t)), '[^a-z]+') as tk from lg0),
lg2 as (select *, [{', '.join(scores)}] as sc from lg1),
lg3 as (select *, list_max(sc) as best, list_sort(sc, 'DESC')[2] as second,
        [{langs}][list_position(sc, list_max(sc))] as best_lang, {code} as code from lg2),
lg as (select *, case
        when t = '' or {neutral('t')} or not {like('t', '[A-Za-zÀ-ɏ一-鿿Ѐ-ӿ]')} then true
        when code = 'zh' then {like('t', CJK)}
        when code = 'ru' then {like('t', '[Ѐ-ӿ]')}
        when {like('t', '[一-鿿Ѐ-ӿ]')} then false
        when best = 0 or best_lang = code then true
        else not (best >= 2 and best >= second + 1) end as is_target from lg3)"""


def untranslated(key: str) -> str:
    """Over ``lg``."""
    return (
        f"(t <> '' and not {locked_key(key)} and not {like('t', '(?i)^(id|uuid)$')} "
        f"and not {neutral('t')} and not {identifier('t')} and not is_target)"
    )


def spacing_issue(c: str) -> str:
    return (
        f"({like(c, rf'(?i)\be[{WS}]*\.[{WS}]*g[{WS}]*\.')} or {like(c, ' {2,}')} "
        f"or {like(c, rf'[{WS}][,.;:!?]')} "
        f"or {like(c, rf'\b[A-Za-z][{WS}]+[0-9]{{1,3}}\b|\b[0-9]{{1,3}}[{WS}]+[A-Za-z]\b')})"
    )


def placeholder(c: str) -> str:
    return like(c, r"__TKN_\d+__|__ID_\d+__|__FMT_\d+__")


def _line_spacing(s: str) -> str:
    closing = rf"[{WS}\"')\]}}]"
    s = sub(s, rf"\b([eE])[{WS}]*\.[{WS}]*g[{WS}]*\.", r"\1.g.")
    s = sub(s, rf"[{WS}]+([,.;:!?])", r"\1")
    s = sub(s, r"([,.;!?])", r"\1" + MARK)
    s = sub(sub(s, f"{MARK}({closing})", r"\1"), MARK, " ")
    s = sub(s, ":", ":" + MARK)
    s = sub(sub(s, f"{MARK}(//|{closing})", r"\1"), MARK, " ")
    s = sub(s, "([.!?])([A-Z])", r"\1 \2")
    s = sub(s, "([a-z])([A-Z][a-z])", r"\1 \2")
    s = sub(s, "([0-9])([A-Za-z])", r"\1 \2")
    s = sub(s, "([A-Za-z])([0-9])", r"\1 \2")
    return sub(s, "([^ ]) {2,}", r"\1 ")


def spacing(c: str) -> str:
    """Line by line (the given texts break lines with a plain line feed)."""
    return (
        f"case when {like(c, '[A-Za-z]')} then array_to_string(list_transform("
        f"string_split({c}, chr(10)), lambda s: {_line_spacing('s')}), chr(10)) else {c} end"
    )


def status(c: str) -> str:
    s = c
    for pattern, new in (
        (r"(?i)\bElevated fever\b", "high fever"),
        (r"(?i)\bAn Elevated\b", "An increase"),
        (r"(?i)\bA Decreased\b", "A decrease"),
        (r"(?i)\bAn Decreased\b", "A decrease"),
        (rf"(?i)\b(slight|mild)[{WS}]+Elevated\b", r"\1 increase"),
        (rf"(?i)\b(slight|mild)[{WS}]+Decreased\b", r"\1 decrease"),
        (r"\bE(?i:levated in)\b", "Increase in"),
        (r"\be(?i:levated in)\b", "increase in"),
        (r"\bD(?i:ecreased in)\b", "Decrease in"),
        (r"\bd(?i:ecreased in)\b", "decrease in"),
        (
            rf"(?i)\bElevated total (spherocytes|ghost cells|reticulocytes)[{WS}]+is\b",
            r"Elevated total \1 are",
        ),
    ):
        s = sub(s, pattern, new)
    return f"case when length({c}) > 60 or {like(c, '[.;:!?]')} then {s} else {c} end"


def splice(c: str, pattern: str, fill: str) -> str:
    """Every match ``m`` (number ``i`` from 1) replaced by ``fill``; ``pattern`` is SQL."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({c}, {pattern}), "
        f"list_transform(regexp_extract_all({c}, {pattern}), lambda m, i: {fill})), "
        f"lambda z: concat(z[1], coalesce(z[2], ''))), '')"
    )


def pairs_text(c: str, pattern: str, token: str) -> str:
    """``token=match`` pairs of a mask, joined by ``|``."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, {q(pattern)}), "
        f"lambda m, i: concat({token}, '=', m)), '|')"
    )


def glossary_ctes(src: str, original: str) -> str:
    """CTE ``gp(original, pattern)`` for the distinct originals of ``src`` that fire an entry."""
    keys, variants = [], []
    for i, e in enumerate(GLOSSARY):
        keys += [f"({i}, {q(k)})" for k in e.keywords]
        spelled = dict.fromkeys([*e.keywords, *e.variants, e.preferred])
        seen = set()
        for v in spelled:
            if v.lower() in seen:
                continue
            seen.add(v.lower())
            quoted = "".join("\\" + ch if ch in "-/\\^$*+?.()|[]{}" else ch for ch in v)
            word = all(ch.isascii() and (ch.isalnum() or ch == " ") for ch in v)
            variants.append(f"({i}, {q(rf'\b{quoted}\b' if word else quoted)}, {len(v)})")
    return f"""
gk(ord, kw) as (values {', '.join(keys)}),
gv(ord, pat, n) as (values {', '.join(variants)}),
go as (select distinct {original} as original from ({src}) g0),
gf as (select distinct original, ord from go join gk on contains(original, kw)),
gp as (select original, '(?i)' || string_agg(pat, '|' order by n desc, pat) as pattern
       from gf join gv using (ord) group by original)"""


def glossary_map() -> str:
    entries = {}
    for e in GLOSSARY:
        for v in (*e.keywords, *e.variants, e.preferred):
            entries.setdefault(v.lower(), e.preferred)
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in entries.items()) + "}"


def enforced(c: str, pattern: str = "pattern") -> str:
    """``c`` with the glossary of its row's ``pattern`` (NULL: none fires)."""
    return (
        f"case when {pattern} is null then {c} else "
        f"{splice(c, pattern, f'coalesce({glossary_map()}[lower(m)], m)')} end"
    )


def polished(src: str, original: str, c: str, out: str = "polished") -> str:
    """CTEs from ``src`` to ``pl``: all its columns and the polished ``c``."""
    return f"""
{glossary_ctes(src, original).strip()},
pl1 as (select s.*, {spacing('s.' + c)} as sp, gp.pattern from ({src}) s
        left join gp on gp.original = s.{original}),
pl2 as (select *, {enforced('sp')} as gl from pl1),
pl as (select * exclude (sp, gl, pattern), {status('gl')} as {out} from pl2)"""
