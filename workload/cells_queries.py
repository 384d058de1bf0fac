"""Queries over sources, reshaping and cell classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetqa.functions import language as L
from sheetqa.functions import script as S
from sheetqa.operators import classify as C
from sheetqa.sources import reshape as R
from sheetqa.sources import sheets as SH
from sheetqa.sources import string_resources as SR
from sheetqa.sources import xml_text as X
from sheetqa.store import written

from . import duck as D
from .catalog import query
from .derived import CELLS, HEADERS, LINES, WIDE, derive, duck, table

ES = "Spanish"
CELLS_SQL = duck(CELLS)


@query(
    f"""with h as (select *, case when header = '' then '__EMPTY' else header end as base
        from ({duck(HEADERS)}) s),
    n as (select *, row_number() over (partition by doc_id, base order by col_idx) as seen from h)
    select doc_id, col_idx, case when seen = 1 then base else concat(base, '_', seen - 1) end as col_key from n"""
)
def header_keys(spark, sf):
    return R.header_keys(derive(spark, sf, HEADERS)).select("doc_id", "col_idx", "col_key")


_RAW_VALUE = "min(case when l_quantity > 40 then '' when l_quantity > 20 then 'WBC' else concat('c', l_linenumber) end)"
_RAW = f"""select l_returnflag as doc_id, l_orderkey as sheet_row, l_linenumber - 1 as col_idx, {_RAW_VALUE} as value
  from lineitem group by 1, 2, 3"""


@query(
    f"""with raw as ({_RAW}), lay as (select doc_id, min(sheet_row) as h, max(sheet_row) as z, min(col_idx) as a, max(col_idx) as b from raw group by doc_id),
    cols as (select doc_id, h, z, unnest(generate_series(a, b)) as col_idx from lay),
    hd as (select cols.*, case when coalesce(value, '') = '' then '__EMPTY' else value end as base from cols left join raw on raw.doc_id = cols.doc_id and sheet_row = h and raw.col_idx = cols.col_idx),
    ks as (select *, row_number() over (partition by doc_id, base order by col_idx) - 1 as seen from hd),
    grid as (select doc_id, h, col_idx, case when seen = 0 then base else concat(base, '_', seen) end as col_key, unnest(generate_series(h + 1, z)) as sheet_row from ks)
    select grid.doc_id, grid.sheet_row - h - 1 as row_idx, grid.col_idx, col_key, coalesce(value, '') as value
    from grid left join raw using (doc_id, sheet_row, col_idx)"""
)
def parse_sheet(spark, sf):
    """Order lines as sparse cells: a sheet per return flag, a row per order."""
    lines = table(spark, sf, "lineitem")
    place = ["l_returnflag", "l_orderkey", "l_linenumber"]
    # A minimum of strings sorts what a task holds, so the tasks grow with the lines.
    raw = (
        lines.repartition(SH.tasks_for(spark, lines.count()), *place)
        .groupBy(*place)
        .agg(F.expr(_RAW_VALUE).alias("value"))
        .select(
            F.col("l_returnflag").alias("doc_id"),
            F.col("l_orderkey").alias("sheet_row"),
            (F.col("l_linenumber") - 1).alias("col_idx"),
            "value",
        )
    )
    # Stored once, as a reader leaves it.
    return SH.parse_sheet(written(raw, "raw-cells")).drop("value_type")


_WIDE = ["id", "wbc", "n", "flag", "note"]
_UNPIVOT = " union all ".join(
    f"select row_idx, {i} as col_idx, '{c}' as col_key, coalesce(cast({c} as varchar), '') as value, "
    f"case when {c} is null then 'string' else '{t}' end as value_type from w"
    for i, (c, t) in enumerate(zip(_WIDE, ["string", "string", "number", "boolean", "string"]))
)


@query(f"with w as ({duck(WIDE)}) {_UNPIVOT}")
def rows_to_cells(spark, sf):
    return R.to_cells(derive(spark, sf, WIDE), _WIDE)


@query(
    f"""with w as ({duck(WIDE)}) select row_idx, id, coalesce(wbc, '') as wbc, n, flag, note from w"""
)
def cells_to_rows(spark, sf):
    cells = R.to_cells(derive(spark, sf, WIDE), _WIDE)
    return R.to_rows(cells, _WIDE, "value", {"n": "bigint", "flag": "boolean"})


def _written(spark, sf, overwrite):
    """Formula cells by row; updates for the text cells, some NULL, some beyond the range."""
    base = derive(spark, sf, CELLS).select(
        "row_idx", "col_key", F.col("original").alias("value"), (F.col("row_idx") % 6 == 0).alias("is_formula")
    )
    updates = derive(spark, sf, CELLS).filter("col_key = 'Interpretation'").select(
        F.when(F.col("row_idx") % 11 == 0, -F.col("row_idx")).otherwise(F.col("row_idx")).alias("row_idx"),
        "col_key",
        F.when(F.col("row_idx") % 7 != 0, F.col("translated")).alias("value"),
    )
    return R.write_back(base, updates, overwrite)


_WRITTEN = f"""with c as (select *, row_idx % 6 = 0 as f,
    col_key = 'Interpretation' and (row_idx % 11 <> 0 or row_idx = 0) as given from ({CELLS_SQL}) s),
  v as (select *, case when row_idx % 7 <> 0 then translated else '' end as new from c)"""


@query(
    f"""{_WRITTEN} select row_idx, col_key, case when given and not f then new else original end as value,
    f as is_formula, given and f as skipped_formula, false as overwritten_formula from v"""
)
def write_back(spark, sf):
    return _written(spark, sf, False)


@query(
    f"""{_WRITTEN} select count(*) filter (given and f) as overwritten_formulas,
    cast(0 as bigint) as skipped_formulas from v"""
)
def write_back_counts(spark, sf):
    return R.write_back_counts(_written(spark, sf, True))


_ENTRY = r"^\s*<string\b[^>]*>"
PARSED_LINES = f"""p as (select line_no, line, regexp_extract(line, '^(\\s*<string\\b[^>]*>)', 1) as prefix,
    regexp_extract(line, '(</string>\\s*)$', 1) as suffix from ({duck(LINES)}) s),
  e as (select line_no, line, prefix, substr(line, length(prefix) + 1, length(line) - length(prefix) - length(suffix)) as content,
    suffix from p)"""


@query(
    f"""with {PARSED_LINES} select line_no, prefix, content, suffix,
    {D.like('content', D.CJK)} as needs_translation from e"""
)
def parse_string_lines(spark, sf):
    return SR.parse_string_lines(derive(spark, sf, LINES)).drop("line")


@query(
    f"""with s as (select doc_id, case when contains(text, chr(10)) then text else concat(text, chr(10)) end as text from documents),
    l as (select doc_id, unnest(string_split(text, chr(10))) as line from s)
    select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars,
      count(*) filter ({D.like('line', D.CJK)}) as n_send from l group by doc_id"""
)
def split_string_lines(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("text").contains("\n"), F.col("text"))
        .otherwise(F.concat("text", F.lit("\n")))
        .alias("text"),
    )
    lines = SR.parse_string_lines(SR.split_string_lines(docs, "text", ["doc_id"]))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
        F.count_if("needs_translation").alias("n_send"),
    )


@query(
    """with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
      unnest(string_split(text, chr(10))) as line from documents),
    z as (select doc_id, max(line_no) as last_no, arg_max(line, line_no) as last_line from l group by doc_id),
    b as (select doc_id, line_no // 1000 as block_no, string_agg(line, chr(10) order by line_no) as body, max(line_no) as end_no
      from l group by all)
    select doc_id, block_no, md5(case when end_no < last_no or last_line = '' then concat(body, chr(10)) else body end) as digest
    from b join z using (doc_id)"""
)
def join_string_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = SR.split_string_lines(docs, "text", ["doc_id"])
    joined = SR.join_string_lines(lines, ["doc_id"], "line")
    return joined.select("doc_id", "block_no", F.md5("text").alias("digest"))


_NODES = r"(?s)<TAG(?:\s[^>]*?)?(?:/>|>(.*?)</TAG\s*>)"


def _entities(c: str) -> str:
    named = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")]
    for k, v in named:
        c = f"replace({c}, '{k}', '{v}')"
    return c


@query(
    f"""with t as (select page_id, unnest(regexp_extract_all(html, '{_NODES.replace("TAG", "title")}', 1)) as raw,
      unnest(generate_series(0, len(regexp_extract_all(html, '{_NODES.replace("TAG", "title")}')) - 1)) as i from pages),
    nt as (select page_id, len(regexp_extract_all(html, '{_NODES.replace("TAG", "title")}')) as n from pages),
    p as (select page_id, unnest(regexp_extract_all(html, '{_NODES.replace("TAG", "p")}', 1)) as raw,
      unnest(generate_series(0, len(regexp_extract_all(html, '{_NODES.replace("TAG", "p")}')) - 1)) as i from pages),
    a as (select page_id, i, raw from t union all select page_id, i + n, raw from p join nt using (page_id))
    select page_id, i as node_idx, md5({_entities("regexp_replace(raw, '<[^>]*>', '', 'g')")}) as digest from a"""
)
def xml_text_nodes(spark, sf):
    nodes = X.xml_text_nodes(table(spark, sf, "pages"), "html", ["title", "p"], ["page_id"])
    return nodes.select("page_id", "node_idx", F.md5("value").alias("digest"))


@query(
    rf"""select page_id, md5(regexp_replace(html, '(?s)<li((?:\s[^>]*?)?)>(.*?)</li\s*>', '<li\1>item</li>', 'g')) as digest
    from pages"""
)
def write_xml_text(spark, sf):
    pages = table(spark, sf, "pages")
    nodes = X.xml_text_nodes(pages, "html", "li", ["page_id"])
    new = nodes.withColumn("value", F.lit("item"))
    out = X.write_xml_text(pages, "html", "li", new, ["page_id"])
    return out.select("page_id", F.md5("html").alias("digest"))


_MARKS = """(select page_id, concat('<w:t xml:space="preserve" a="p>q">', page_id, ' &amp; x</w:t><!-- <t>no</t> --><t>', url,
  '</t><t/><w:t><![CDATA[<b>', page_id, ']]></w:t>', '&#0000000065;<t>&#00000065;</t>') as doc, page_id from pages) m"""


@query(
    f"""select page_id, unnest([0, 1, 2, 3, 4]) as node_idx,
    unnest([concat(page_id, ' & x'), concat('<b>', page_id), url, '', 'A']) as value from pages"""
)
def xml_marked_nodes(spark, sf):
    """Two tags, attributes with ``>``, comments, CDATA and references with leading zeros."""
    return X.xml_text_nodes(_marked_pages(spark, sf), "doc", ["w:t", "t"], ["page_id"])


@query(
    """select page_id, concat('<w:t xml:space="preserve" a="p>q">0</w:t><!-- <t>no</t> --><t>2</t><t>3</t><w:t>1</w:t>',
    '&#0000000065;<t>4</t>') as doc from pages"""
)
def write_xml_two_tags(spark, sf):
    """Every node of two tags gets its number."""
    docs = _marked_pages(spark, sf)
    nodes = X.xml_text_nodes(docs, "doc", ["w:t", "t"], ["page_id"])
    new = nodes.withColumn("value", F.col("node_idx").cast("string"))
    return X.write_xml_text(docs, "doc", ["w:t", "t"], new, ["page_id"])


def _marked_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return spark.sql("select page_id, doc from " + _MARKS.replace("from pages", "from {pages}"), pages=pages)


@query("select page_id, md5(html) as digest from pages")
def xml_read_then_write(spark, sf):
    """Writing back what was read changes nothing; list items and titles hold no markup."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    tags = ["title", "h1"]
    nodes = X.xml_text_nodes(pages, "html", tags, ["page_id"])
    return X.write_xml_text(pages, "html", tags, nodes, ["page_id"]).select("page_id", F.md5("html").alias("digest"))


# --- classification ---


@query(
    f"""select row_idx, {D.like('original', D.CJK)} as cjk, {D.like('translated', '[A-Za-zÀ-ɏ]')} as latin,
    {D.like('translated', '[Ѐ-ӿ]')} as cyrillic from ({CELLS_SQL}) s"""
)
def script_flags(spark, sf):
    return derive(spark, sf, CELLS).select(
        "row_idx",
        S.has_cjk(F.col("original")).alias("cjk"),
        S.has_latin(F.col("translated")).alias("latin"),
        S.has_cyrillic(F.col("translated")).alias("cyrillic"),
    )


@query(
    f"""select neutral, count(*) as n from (
      select {D.neutral(D.trim('w'))} as neutral from
        (select unnest(string_split_regex(text, '[ \n]')) as w from documents) s
      union all select {D.neutral(D.trim('original'))} from ({CELLS_SQL}) c) u group by neutral"""
)
def neutral_tokens(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    cells = derive(spark, sf, CELLS).select(F.col("original").alias("w"))
    return (
        words.unionAll(cells)
        .groupBy(S.is_neutral(F.col("w")).alias("neutral"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    f"""select source, count(*) filter ({D.identifier('text')}) as n_ids, count(*) as n from (
      select source, text from documents union all
      select 'cells' as source, original as text from ({CELLS_SQL}) c) u group by source"""
)
def identifiers(spark, sf):
    cells = derive(spark, sf, CELLS).select(F.lit("cells").alias("source"), F.col("original").alias("text"))
    return (
        table(spark, sf, "documents")
        .select("source", "text")
        .unionAll(cells)
        .groupBy("source")
        .agg(F.count_if(S.is_identifier(F.col("text"))).alias("n_ids"), F.count(F.lit(1)).alias("n"))
    )


@query(f"select row_idx, col_key, {D.locked('col_key', 'original')} as locked from ({CELLS_SQL}) s")
def locked_cells(spark, sf):
    return derive(spark, sf, CELLS).select(
        "row_idx", "col_key", S.is_locked(F.col("col_key"), F.col("original")).alias("locked")
    )


@query(
    f"""with {D.scored(CELLS_SQL, 'translated', "'es'")}
    select row_idx, t <> '' and not {D.neutral('t')} as full_mode,
      t <> '' and not {D.neutral('t')} and not is_target as selective_mode from lg"""
)
def should_translate(spark, sf):
    value = F.col("translated")
    return derive(spark, sf, CELLS).select(
        "row_idx",
        L.should_translate(value, "full", ES).alias("full_mode"),
        L.should_translate(value, "selective", ES).alias("selective_mode"),
    )


@query(
    f"""with {D.scored(f"select * replace (row_idx // 4 as row_idx) from ({CELLS_SQL}) x", 'translated', "'en'")}
    select row_idx, bool_or(t <> '' and not is_target) as needs_translation from lg group by row_idx"""
)
def rows_needing_translation(spark, sf):
    cells = derive(spark, sf, CELLS).withColumn("row_idx", F.floor(F.col("row_idx") / 4))
    return C.rows_needing_translation(cells, "English", "translated")


@query(
    f"""with {D.scored('select doc_id, text from documents', 'text', "'es'")}
    select doc_id, sc[1] as en, sc[2] as es, sc[3] as fr, sc[4] as de, sc[5] as it, sc[6] as pt, best_lang from lg"""
)
def language_scores(spark, sf):
    scored = table(spark, sf, "documents").select(
        "doc_id", L.language_scores(F.col("text")).alias("s")
    )
    by_lang = F.map_from_entries("s")
    return scored.select(
        "doc_id",
        *[by_lang[k].cast("bigint").alias(k) for k in L.LANGUAGE_HINTS],
        F.get("s", 0)["lang"].alias("best_lang"),
    )


def _detected(t: str) -> str:
    return (
        f"case when {D.like(t, D.CJK)} then 'zh' when {D.like(t, '[Ѐ-ӿ]')} then 'ru' "
        f"when not {D.like(t, '[A-Za-zÀ-ɏ]')} or best = 0 or best = second then 'unknown' else best_lang end"
    )


@query(
    f"""with {D.scored(f"select 'doc' as kind, text from documents union all select 'cell', original from ({CELLS_SQL}) c union all select 'cell', translated from ({CELLS_SQL}) c", 'text', "'es'")}
    select kind, {_detected('text')} as detected, count(*) as n from lg group by all"""
)
def detect_language(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), "text")
    cells = derive(spark, sf, CELLS)
    for side in ("original", "translated"):
        docs = docs.unionAll(cells.select(F.lit("cell"), side))
    return docs.groupBy("kind", L.detect_language(F.col("text")).alias("detected")).agg(
        F.count(F.lit(1)).alias("n")
    )


_NAMES = """case o_custkey % 9 when 0 then 'English (US)' when 1 then 'Simplified CHINESE'
  when 2 then 'Spanish' when 3 then 'french' when 4 then 'German' when 5 then 'Italian'
  when 6 then 'Brazilian Portuguese' when 7 then 'Russian' else 'Klingon' end"""


@query(
    f"""with n as (select o_orderkey, lower({_NAMES}) as name from orders)
    select o_orderkey, case when contains(name, 'chinese') then 'zh' when contains(name, 'english') then 'en'
      when contains(name, 'spanish') then 'es' when contains(name, 'french') then 'fr'
      when contains(name, 'german') then 'de' when contains(name, 'italian') then 'it'
      when contains(name, 'portuguese') then 'pt' when contains(name, 'russian') then 'ru'
      else 'unknown' end as code from n"""
)
def target_code(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", L.target_code(F.expr(_NAMES)).alias("code")
    )


@query(
    f"""with {D.scored('select role, text from conversations', 'text', "'en'")}
    select role, count(*) filter (is_target) as in_english, count(*) as n from lg group by role"""
)
def target_language_by_role(spark, sf):
    return (
        table(spark, sf, "conversations")
        .groupBy("role")
        .agg(
            F.count_if(L.is_target_language(F.col("text"), "English")).alias("in_english"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query(
    f"""with {D.scored("select lang, text, doc_id from documents", 'text', "'en'")}
    select lang, count(*) filter ({D.untranslated("'text'")}) as untranslated, count(*) as n_docs
    from lg group by lang"""
)
def untranslated_by_lang(spark, sf):
    """The flagship: per language, documents that are not in English."""
    docs = table(spark, sf, "documents")
    flag = L.is_untranslated(F.lit("text"), F.col("text"), "English")
    return docs.groupBy("lang").agg(
        F.count_if(flag).alias("untranslated"), F.count(F.lit(1)).alias("n_docs")
    )


def lang_cells(code: str) -> str:
    return D.scored(CELLS_SQL, "translated", f"'{code}'")


@query(
    f"""with {lang_cells('en')} select row_idx, col_key, t as value from lg
    where {D.untranslated('col_key')}"""
)
def untranslated_cells(spark, sf):
    return C.untranslated_cells(derive(spark, sf, CELLS), "English")


def _wide_rows(cells):
    """Several cells per row, so that rows and cells differ."""
    return cells.withColumn("col_key", F.concat("col_key", F.lit(" "), (F.col("row_idx") % 4).cast("string"))).withColumn(
        "row_idx", F.floor(F.col("row_idx") / 4)
    )


_GROUPED = f"""select row_idx // 4 as row_idx, concat(col_key, ' ', row_idx % 4) as col_key, original, translated
  from ({CELLS_SQL}) c"""


@query(
    f"""with {D.scored(_GROUPED, 'translated', "'en'")}
    select count(*) as cells, count(distinct row_idx) as rows from lg where {D.untranslated('col_key')}"""
)
def untranslated_summary(spark, sf):
    return C.summarize_untranslated(_wide_rows(derive(spark, sf, CELLS)), "English")


@query(
    f"""with {D.scored(CELLS_SQL, 'original', "'en'")} select row_idx, t <> '' and not is_target as needs from lg"""
)
def wide_rows_needing_translation(spark, sf):
    """The same flag over a wide table's columns, without cells."""
    wide = derive(spark, sf, CELLS).select("row_idx", "original", F.lit("12").alias("code"))
    return wide.select("row_idx", C.wide_needs_translation(wide, ["original", "code"], "English").alias("needs"))


_RETRY = f"{D.untranslated('col_key')} and not {D.locked('col_key', 'original')} and not {D.neutral('t')}"


@query(
    f"""with {lang_cells('en')} select row_idx, col_key, translated as value from lg where {_RETRY}"""
)
def retryable_cells(spark, sf):
    return C.retryable_cells(derive(spark, sf, CELLS), "English")


@query(
    f"""with {D.scored(_GROUPED, 'translated', "'en'")}
    select count(*) as cells, count(distinct row_idx) as rows from lg where {_RETRY}"""
)
def retryable_summary(spark, sf):
    return C.retryable_summary(_wide_rows(derive(spark, sf, CELLS)), "English")


@query(
    f"""with {D.scored('select doc_id, text from documents', 'text', "'fr'")}
    select doc_id from lg where not is_target"""
)
def audit_units(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return C.audit_units(docs, "French", "text").select("doc_id")


@query(
    f"""with {lang_cells('en')} select distinct row_idx from lg
    where {D.untranslated('col_key')} and row_idx in (select l_orderkey from lineitem where l_returnflag = 'R')"""
)
def refresh_write_failed(spark, sf):
    """Orders with a returned item stand for the rows whose write failed."""
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    failed = returned.select(F.col("l_orderkey").alias("row_idx"))
    return C.refresh_write_failed(failed, derive(spark, sf, CELLS), "English")


@query(
    f"""with t as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply,
      lead(turn) over (partition by conv_id order by turn) as next_turn, role from conversations)
    select conv_id, turn from t where role = 'user' and
      {D.trim('text')} is distinct from {D.trim('case when next_turn = turn + 1 then reply end')}"""
)
def changed_turns(spark, sf):
    """User turns whose reply differs from them; a turn without reply differs."""
    turns = table(spark, sf, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    pairs = turns.filter("role = 'user'").withColumnRenamed("text", "original").join(
        replies, ["conv_id", "turn"], "left"
    )
    return C.changed_cells(pairs).select("conv_id", "turn")


@query(f"select row_idx, col_key from ({CELLS_SQL}) s where {D.trim('original')} <> {D.trim('translated')}")
def changed_cells(spark, sf):
    return C.changed_cells(derive(spark, sf, CELLS)).select("row_idx", "col_key")
