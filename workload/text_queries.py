"""Queries over masking, restoring, polishing and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetqa.functions import masking as M
from sheetqa.functions import polish as P
from sheetqa.functions import quality as Q
from sheetqa.functions.glossary import enforce_glossary as enforce
from sheetqa.operators import merge as MG
from sheetqa.operators import quality as QT
from sheetqa.operators.classify import untranslated_cells
from sheetqa.sources import string_resources as SR

from . import duck as D
from . import expected as E
from .catalog import query
from .cells_queries import _GROUPED, CELLS_SQL, PARSED_LINES, _wide_rows, lang_cells
from .derived import CELLS, LANG_LINES, LINES, NOTES, derive, duck, table

TKN = r"[A-Za-z][A-Za-z0-9_\-/:+()#.]+"
FMT = rf"%(?:\d+\$)?[-+#0{D.WS}]*(?:\d+)?(?:\.\d+)?[a-zA-Z%]|\{{\d+\}}"
UUID = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"

# Cells with all kinds of tokens: CJK around codes, plain codes, UUIDs, words and dates.
TOKENS = """
select o_orderkey as row_idx, case o_orderkey % 7
    when 0 then concat('白细胞升高，见BA-', o_custkey, ' 和 START (v1.2)')
    when 1 then concat('id e32456ad-e862-4eb8-88b0-38a7ac9e10f4 or BA-', o_custkey, '-X')
    when 2 then concat('12-ab-', o_custkey, ' then 2024-01-02 and x-y')
    when 3 then concat('编号 12-ab', o_custkey, '，', o_orderkey, '-7c')
    when 4 then '血小板减少'
    when 5 then concat('共%1$s条 {0} 100%% of ', o_custkey)
    else concat('plain text ', o_custkey) end as text
from orders
"""
TOKENS_SQL = duck(TOKENS)


def _shown(c):
    """A mask as plain columns."""
    listed = F.transform(c["pairs"], lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return [c["sanitized"].alias("sanitized"), F.array_join(listed, "|").alias("pairs")]


_INLINE = f"""i as (select *, {D.like('text', D.CJK)} as cjk from s),
  m1 as (select *, case when cjk then {D.splice('text', D.q(TKN), "concat('__TKN_', i - 1, '__')")} else text end as a,
    case when cjk then {D.pairs_text('text', TKN, "concat('__TKN_', i - 1, '__')")} else '' end as pa,
    case when cjk then len(regexp_extract_all(text, {D.q(TKN)})) else 0 end as na from i)"""


@query(f"with s as ({TOKENS_SQL}), {_INLINE} select row_idx, a as sanitized, pa as pairs from m1")
def mask_inline(spark, sf):
    return derive(spark, sf, TOKENS).select("row_idx", M.mask_inline(F.col("text")).alias("m")).select(
        "row_idx", *_shown(F.col("m"))
    )


_CODE = r"\b[0-9A-Za-z]+(?:-[0-9A-Za-z]+)+\b"
_IS_CODE = f"({D.like('m', '[A-Za-z]')} and {D.like('m', '[0-9]')})"
_CODES = f"list_filter(regexp_extract_all(b, {D.q(_CODE)}), lambda m: {_IS_CODE})"
# A hyphenated run without letter or digit keeps its place: only real codes are numbered.
_NTH = f"len(list_filter(regexp_extract_all(b, {D.q(_CODE)})[1:i], lambda x: {_IS_CODE.replace('(m,', '(x,')}))"


@query(
    f"""with s as ({TOKENS_SQL}), {_INLINE},
    m2 as (select *, {D.splice('a', D.q(UUID), "concat('__ID_', na + i - 1, '__')")} as b,
      {D.pairs_text('a', UUID, "concat('__ID_', na + i - 1, '__')")} as pb,
      na + len(regexp_extract_all(a, {D.q(UUID)})) as nb from m1),
    m3 as (select *, {D.splice('b', D.q(_CODE), f"case when {_IS_CODE} then concat('__ID_', nb + {_NTH} - 1, '__') else m end")} as c,
      array_to_string(list_transform({_CODES}, lambda m, i: concat('__ID_', nb + i - 1, '__=', m)), '|') as pc from m2)
    select row_idx, c as sanitized, concat_ws('|', nullif(pa, ''), nullif(pb, ''), nullif(pc, '')) as pairs from m3"""
)
def mask_translation(spark, sf):
    masked = derive(spark, sf, TOKENS).select("row_idx", M.mask_translation(F.col("text")).alias("m"))
    return masked.select("row_idx", *_shown(F.col("m")))


@query(
    f"""with s as (select doc_id, text from documents)
    select doc_id, md5({D.splice('text', D.q(FMT), "concat('__FMT_', i - 1, '__')")}) as sanitized,
      {D.pairs_text('text', FMT, "concat('__FMT_', i - 1, '__')")} as pairs from s"""
)
def mask_format(spark, sf):
    masked = table(spark, sf, "documents").select("doc_id", M.mask_format(F.col("text")).alias("m"))
    sanitized, pairs = _shown(F.col("m"))
    return masked.select("doc_id", F.md5(sanitized).alias("sanitized"), pairs)


_STRING = f"""{PARSED_LINES},
  f as (select *, {D.splice('content', D.q(FMT), "concat('__FMT_', i - 1, '__')")} as a,
    {D.pairs_text('content', FMT, "concat('__FMT_', i - 1, '__')")} as pa from e),
  g as (select *, case when {D.like('a', D.CJK)} then {D.splice('a', D.q(TKN), "concat('__TKN_', i - 1, '__')")} else a end as b,
    case when {D.like('a', D.CJK)} then {D.pairs_text('a', TKN, "concat('__TKN_', i - 1, '__')")} else '' end as pb from f)"""


@query(
    f"""with {_STRING} select line_no, b as sanitized,
    concat_ws('|', nullif(pa, ''), nullif(pb, '')) as pairs from g"""
)
def mask_string(spark, sf):
    lines = SR.parse_string_lines(derive(spark, sf, LINES))
    return lines.select("line_no", M.mask_string(F.col("content")).alias("m")).select(
        "line_no", *_shown(F.col("m"))
    )


@query(f"select row_idx, text as restored from ({TOKENS_SQL}) s")
def restore(spark, sf):
    masked = derive(spark, sf, TOKENS).select("row_idx", M.mask_translation(F.col("text")).alias("m"))
    return masked.select("row_idx", M.restore(F.col("m.sanitized"), F.col("m.pairs")).alias("restored"))


@query(
    f"""with {PARSED_LINES} select line_no, content as restored,
    case when {D.like('content', D.CJK)} and {D.like('content', FMT)}
      then regexp_replace(content, {D.q(FMT)}, '__FMT_0__') else content end as leaked from e"""
)
def restore_tolerant(spark, sf):
    """Every placeholder lost its closing underscores on the way."""
    lines = SR.parse_string_lines(derive(spark, sf, LINES))
    masked = lines.select("line_no", M.mask_string(F.col("content")).alias("m"))
    damaged = F.regexp_replace("m.sanitized", "(TKN_[0-9]+)__", "$1_")
    return masked.select(
        "line_no",
        M.restore_tolerant(damaged, F.col("m.pairs")).alias("restored"),
        M.restore_tolerant(damaged, F.col("m.pairs"), compat=True).alias("leaked"),
    )


# --- polishing ---


@query(f"select doc_id, md5({D.spacing('text')}) as fixed from documents")
def fix_spacing(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(P.fix_spacing(F.col("text"))).alias("fixed")
    )


@query(
    f"""with {D.glossary_ctes(CELLS_SQL, 'original')}
    select row_idx, {D.enforced('translated')} as enforced from ({CELLS_SQL}) s left join gp using (original)"""
)
def enforce_glossary(spark, sf):
    cells = derive(spark, sf, CELLS)
    return cells.select("row_idx", enforce(F.col("original"), F.col("translated")).alias("enforced"))


@query(
    f"""with {D.glossary_ctes(CELLS_SQL, 'original')}
    select row_idx, {D.enforced('translated')} as enforced from ({CELLS_SQL}) s left join gp using (original)"""
)
def enforce_glossary_from_table(spark, sf):
    """The glossary as a table among many entries that fire for nothing."""
    from sheetqa.operators.terms import enforce_glossary_table, glossary_table

    cells = derive(spark, sf, CELLS)
    others = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1000).alias("entry_no"),
        F.array(F.concat(F.lit("无"), "o_orderkey"), F.concat(F.lit("none "), "o_orderkey")).alias("keywords"),
        F.lit("nothing").alias("preferred"),
        F.array(F.lit("count"), F.lit("White Blood")).alias("variants"),
    )
    glossary = glossary_table(spark).unionByName(others)
    done = enforce_glossary_table(cells, ["row_idx", "col_key"], "original", "translated", glossary)
    return done.select("row_idx", F.col("translated").alias("enforced"))


@query(f"select row_idx, {D.status('text')} as adjusted from ({duck(NOTES)}) s")
def long_form_status(spark, sf):
    return derive(spark, sf, NOTES).select(
        "row_idx", P.long_form_status(F.col("text")).alias("adjusted")
    )


@query(f"with {D.polished(CELLS_SQL, 'original', 'translated')} select row_idx, polished from pl")
def polish(spark, sf):
    cells = derive(spark, sf, CELLS)
    return cells.select("row_idx", P.polish(F.col("original"), F.col("translated")).alias("polished"))


@query(
    f"""with {D.polished(CELLS_SQL, 'original', 'translated')}
    select row_idx, case when {D.locked('col_key', 'original')} then translated else polished end as translated from pl"""
)
def postprocess_cells(spark, sf):
    return MG.postprocess_cells(derive(spark, sf, CELLS)).select("row_idx", "translated")


@query(
    f"""with {D.polished(CELLS_SQL, 'original', 'translated')},
    q1 as (select row_idx, col_key, original, case when {D.locked('col_key', 'original')} then translated else polished end as tr from pl),
    q2 as (select q1.*, gp.pattern, {D.spacing('tr')} as sp from q1 left join gp using (original)),
    q3 as (select *, {D.enforced('sp')} as gl from q2)
    select row_idx, case when {D.locked('col_key', 'original')} then original
      when {D.spacing_issue('tr')} then {D.status('gl')} else tr end as translated from q3"""
)
def quality_fixes(spark, sf):
    return MG.apply_quality_fixes(derive(spark, sf, CELLS)).select("row_idx", "translated")


@query(
    f"""with s as (select conv_id, turn, {D.spacing('text')} as f from conversations)
    select conv_id, turn, md5({D.sub('f', rf'\b([A-Za-z])[{D.WS}]+(\d{{1,3}})\b', r'\1\2')}) as fixed from s"""
)
def string_autofix(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(P.string_autofix(F.col("text"))).alias("fixed")
    )


# --- quality ---

_WHO = "select doc_id, text from documents union all select -row_idx - 1, translated from ({}) c"


def _texts(spark, sf):
    cells = derive(spark, sf, CELLS)
    return table(spark, sf, "documents").select("doc_id", "text").unionAll(
        cells.select(-F.col("row_idx") - 1, "translated")
    )


@query(f"select doc_id from ({_WHO.format(CELLS_SQL)}) s where {D.spacing_issue('text')}")
def spacing_issues(spark, sf):
    return _texts(spark, sf).filter(Q.spacing_issue(F.col("text"))).select("doc_id")


@query(f"select doc_id from ({_WHO.format(CELLS_SQL)}) s where {D.placeholder('text')}")
def placeholder_leaks(spark, sf):
    return _texts(spark, sf).filter(Q.placeholder_leak(F.col("text"))).select("doc_id")


@query(f"select doc_id from ({_WHO.format(CELLS_SQL)}) s where {D.like('text', D.CJK)}")
def cjk_residue(spark, sf):
    return _texts(spark, sf).filter(Q.cjk_residue(F.col("text"))).select("doc_id")


@query(
    f"""select row_idx, original, translated from ({CELLS_SQL}) s
    where {D.locked('col_key', 'original')} and original <> translated"""
)
def id_mismatches(spark, sf):
    cells = derive(spark, sf, CELLS)
    hit = Q.id_mismatch(F.col("col_key"), F.col("original"), F.col("translated"))
    return cells.filter(hit).select("row_idx", "original", "translated")


def _sides(spark, sf):
    """The two tables a report compares; returned orders lack an original, urgent ones a translation."""
    cells = _wide_rows(derive(spark, sf, CELLS))
    missing = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 4).alias("row_idx"), (F.col("o_orderkey") % 4).alias("k"), "o_orderpriority"
    )
    at = cells.withColumn("k", F.substring("col_key", -1, 1).cast("bigint")).join(missing, ["row_idx", "k"])
    orig = at.filter("o_orderpriority <> '1-URGENT'").select("row_idx", "col_key", F.col("original").alias("value"))
    trans = at.filter("o_orderpriority <> '5-LOW'").select("row_idx", "col_key", F.col("translated").alias("value"))
    return orig, trans


_SIDES = f"""c as (select o_orderkey // 4 as row_idx, concat(col_key, ' ', o_orderkey % 4) as col_key,
      case when o_orderpriority <> '1-URGENT' then original end as original,
      case when o_orderpriority <> '5-LOW' then translated end as translated
    from ({CELLS_SQL}) x join orders on o_orderkey = x.row_idx),
  fl as (select *, translated is not null as scanned,
      coalesce({D.like('translated', D.CJK)}, false) as zh, coalesce({D.placeholder('translated')}, false) as ph,
      coalesce({D.spacing_issue('translated')}, false) as spc,
      coalesce({D.locked('col_key', 'original')} and original <> translated, false) as idm from c)"""


@query(
    f"""with {_SIDES} select row_idx, col_key, type, translated as value, coalesce(original, '') as original from (
      select *, 'chinese' as type from fl where zh union all select *, 'placeholder' from fl where ph
      union all select *, 'spacing' from fl where spc union all select *, 'idMismatch' from fl where idm) u"""
)
def quality_issues(spark, sf):
    return QT.quality_issues(*_sides(spark, sf))


@query(
    f"""with {_SIDES} select count(*) filter (scanned) as cells_scanned,
      greatest(count(distinct row_idx) filter (original is not null), count(distinct row_idx) filter (scanned)) as rows_scanned,
      count(*) filter (zh) as chinese_cells, count(distinct row_idx) filter (zh) as chinese_rows,
      count(*) filter (ph) as placeholder_cells, count(distinct row_idx) filter (ph) as placeholder_rows,
      count(*) filter (idm) as id_mismatches, count(distinct row_idx) filter (idm) as id_mismatch_rows,
      count(*) filter (spc) as spacing_issues, count(distinct row_idx) filter (spc) as spacing_rows from fl"""
)
def quality_totals(spark, sf):
    return QT.quality_totals(*_sides(spark, sf))


# Whole documents with a glossary term in the source and one of its variants, in order of the entries.
_TERMS = [(k, v) for e in E.GLOSSARY for k in e.keywords for v in (k, *e.variants)]


def _termed(names: str) -> str:
    return f"""select doc_id, concat({names}, '：', text) as original, concat('see ', variant, ' ,', text) as translated
      from (select doc_id, text, doc_id % {len(_TERMS)} as k from documents) d join terms using (k)"""


@query(
    f"""with terms(k, keyword, variant) as (values {', '.join(f"({i}, {D.q(k)}, {D.q(v)})" for i, (k, v) in enumerate(_TERMS))}),
    {D.polished(_termed('keyword'), 'original', 'translated')} select doc_id, md5(polished) as digest from pl"""
)
def polish_documents(spark, sf):
    """All glossary entries and variants, in front of whole texts of four languages."""
    at = (F.col("doc_id") % len(_TERMS)).cast("int")
    keyword = F.get(F.lit([k for k, _ in _TERMS]), at)
    variant = F.get(F.lit([v for _, v in _TERMS]), at)
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(keyword, F.lit("："), F.col("text")).alias("original"),
        F.concat(F.lit("see "), variant, F.lit(" ,"), F.col("text")).alias("translated"),
    )
    return docs.select("doc_id", F.md5(P.polish(F.col("original"), F.col("translated"))).alias("digest"))


_CODES_BY_NAME = (
    "case lang when 'English' then 'en' when 'Spanish' then 'es' when 'French' then 'fr' "
    "when 'German' then 'de' when 'Italian' then 'it' when 'Russian' then 'ru' else 'pt' end"
)


@query(
    f"""with {D.scored(duck(LANG_LINES), 'content', _CODES_BY_NAME)}
    select lang, count(*) filter ({D.untranslated("'content'")}) as untranslated,
      count(*) filter ({D.placeholder('content')}) as placeholders,
      count(*) filter ({D.spacing_issue('content')}) as spacing from lg group by lang"""
)
def quality_by_lang(spark, sf):
    return QT.quality_by_lang(derive(spark, sf, LANG_LINES))


def _ranges_sql(src: str, by: str, limit: int) -> str:
    """Gaps and islands with plain windows; a repeated index starts an island of its own."""
    return f"""with d as (select {by}, row_idx, case when row_idx = lag(row_idx) over w + 1 then 0 else 1 end as new
        from ({src}) s window w as (partition by {by} order by row_idx)),
      n as (select *, sum(new) over (partition by {by} order by row_idx rows unbounded preceding) as isl from d),
      r as (select {by}, isl, min(row_idx) as a, max(row_idx) as b from n group by {by}, isl),
      p as (select *, isl as pos, count(*) over (partition by {by}) as total from r)
      select {by}, concat(string_agg(case when a = b then cast(a + 1 as varchar) else concat(a + 1, '-', b + 1) end, ', ' order by pos),
        case when max(total) > {limit} then '...' else '' end) as ranges
      from p where pos <= {limit} group by {by}"""


_LATE = "select o_orderpriority, o_orderkey // 2 as row_idx from orders"


@query(_ranges_sql(_LATE, "o_orderpriority", 40))
def row_ranges(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderpriority", F.floor(F.col("o_orderkey") / 2).alias("row_idx")
    )
    return QT.row_ranges(rows, 40, "row_idx", ["o_orderpriority"])


def _runs_sql(src: str, by: str) -> str:
    """A run ends where the next index is not one higher, repetitions included."""
    return f"""s as ({src}), g as (select *, case when row_idx = lag(row_idx) over w + 1 then 0 else 1 end as new
        from s window w as (partition by {by} order by row_idx)),
      n as (select *, sum(new) over (partition by {by} order by row_idx rows unbounded preceding) as seq from g)
      select {by}, cast(seq as bigint) as seq, min(row_idx) + 1 as first_row, max(row_idx) + 1 as last_row from n group by {by}, seq"""


@query("with " + _runs_sql(_LATE, "o_orderpriority"))
def row_runs(spark, sf):
    """All runs, of indices that occur up to twice."""
    rows = table(spark, sf, "orders").select(
        "o_orderpriority", F.floor(F.col("o_orderkey") / 2).alias("row_idx")
    )
    return QT.row_runs(rows, "row_idx", ["o_orderpriority"])


@query("with " + _runs_sql("select 0 as g, o_orderkey * 7919 % 1000003 as row_idx from orders", "g"))
def row_runs_of_scattered_indices(spark, sf):
    """The same without groups, of indices that lie far apart."""
    rows = table(spark, sf, "orders").select(((F.col("o_orderkey") * 7919) % 1000003).alias("row_idx"))
    return QT.row_runs(rows).select(F.lit(0).alias("g"), "seq", "first_row", "last_row")


@query(
    f"""with {lang_cells('en')}, u as (select row_idx, col_key from lg where {D.untranslated('col_key')}),
    p as (select row_idx, col_key from u order by row_idx limit 6)
    select concat(string_agg(concat('R', row_idx + 2, '/', col_key), ', ' order by row_idx),
      case when (select count(*) from u) > 6 then ', ...' else '' end) as preview from p"""
)
def location_preview(spark, sf):
    return QT.location_preview(untranslated_cells(derive(spark, sf, CELLS), "English"), 6)


@query(
    f"""with {lang_cells('en')} select row_idx, col_key, concat('R', row_idx + 2, '/', col_key) as place
    from lg where {D.untranslated('col_key')}"""
)
def places(spark, sf):
    """The place of every untranslated cell."""
    return QT.places(untranslated_cells(derive(spark, sf, CELLS), "English")).select("row_idx", "col_key", "place")


@query(
    """with r as (select o_custkey % 3 as g, o_orderstatus from orders)
    select concat('f', g) as doc_id, count(*) filter (o_orderstatus = 'F') as done_rows, count(*) as total_rows,
      count(*) filter (o_orderstatus = 'O') as missing_rows, count(*) filter (o_orderstatus = 'P') as write_failed_rows,
      cast(floor(count(*) filter (o_orderstatus = 'F') / count(*)::double * 100 + 0.5) as bigint) as percent,
      count(*) filter (o_orderstatus <> 'F') as remaining_rows from r group by g"""
)
def progress_figures(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("doc_id"),
        F.col("o_orderkey").alias("row_idx"),
        (F.col("o_orderstatus") == "F").alias("done"),
        (F.col("o_orderstatus") == "O").alias("missing"),
        (F.col("o_orderstatus") == "P").alias("write_failed"),
    )
    return QT.progress(rows)


@query(
    """select concat('f', o_custkey % 3) as doc_id, count(*) as pending_rows, min(o_orderkey) + 1 as resume_row
    from orders where o_orderstatus <> 'F' group by 1"""
)
def resume_point(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("doc_id"),
        F.col("o_orderkey").alias("row_idx"),
        "o_orderstatus",
    )
    return QT.resume_point(rows.drop("o_orderstatus"), rows.filter("o_orderstatus = 'F'"))


@query(
    """select concat('s', o_custkey % 5) as sheet, max(l_orderkey) - min(l_orderkey) + 1 as n_rows,
    cast(max(l_linenumber) - min(l_linenumber) + 1 as bigint) as n_cols
    from lineitem join orders on l_orderkey = o_orderkey group by 1"""
)
def sheet_profile(spark, sf):
    cells = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("sheet"),
        F.col("l_orderkey").alias("row_idx"),
        F.col("l_linenumber").cast("bigint").alias("col_idx"),
    )
    return QT.sheet_profile(cells)


@query(
    f"""with {_SIDES}, u as (
      select *, 'chinese' as type from fl where zh union all select *, 'placeholder' from fl where ph
      union all select *, 'spacing' from fl where spc union all select *, 'idMismatch' from fl where idm)
    select type, row_idx, col_key, translated as value,
      row_number() over (partition by type order by row_idx, col_key) as pos from u qualify pos <= 3"""
)
def issue_samples(spark, sf):
    samples = QT.issue_samples(QT.quality_issues(*_sides(spark, sf)), 3)
    return samples.select("type", "row_idx", "col_key", "value", "pos")


@query(
    f"""with {_SIDES}, u as (
      select *, 'chinese' as type from fl where zh union all select *, 'placeholder' from fl where ph
      union all select *, 'spacing' from fl where spc union all select *, 'idMismatch' from fl where idm)
    select type, row_idx, col_key, row_number() over (partition by type order by row_idx, col_key) as pos from u"""
)
def issue_list(spark, sf):
    """All issues in sheet order."""
    return QT.issue_list(QT.quality_issues(*_sides(spark, sf))).select("type", "row_idx", "col_key", "pos")


@query(
    f"""with c as ({_GROUPED}), d as (select *, dense_rank() over (order by row_idx desc) as pos from c)
    select row_idx, col_key, pos, {D.trim('original')} is distinct from {D.trim('translated')} as changed from d where pos <= 10"""
)
def latest_rows(spark, sf):
    rows = QT.latest_rows(_wide_rows(derive(spark, sf, CELLS)), 10)
    return rows.select("row_idx", "col_key", "pos", "changed")
