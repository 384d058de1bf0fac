"""Queries over whole workflows and over a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetqa.functions.language import is_untranslated
from sheetqa.functions.quality import spacing_issue
from sheetqa.plans import resources as RP
from sheetqa.plans import translation as TP
from sheetqa.plans import units as UP
from sheetqa.sources import string_resources as SR
from sheetqa.store import scratch_path
from sheetqa.streaming.available import read_cells, run_pass

from . import duck as D
from .catalog import query
from .cells_queries import _GROUPED, _RETRY, CELLS_SQL, PARSED_LINES, _wide_rows, lang_cells
from .derived import CELLS, LANG_LINES, LINES, derive, duck, table
from .loop_queries import EN
from .text_queries import _CODES_BY_NAME, TKN

# The model stand-in echoes each request in a code fence; batches of a multiple of 6 are cut off.
_ECHO = f"""g as ({_GROUPED}),
  t as (select *, {D.trim('original')} as ot, (row_idx // 5) % 6 <> 0 as answered from g),
  e as (select *, answered and ot <> '' and not {D.neutral('ot')} and not {D.locked('col_key', 'original')} as use,
    case when {D.like('original', D.CJK)} then {D.splice('original', D.q(TKN), "concat('__TKN_', i - 1, '__')")}
      when {D.identifier('original')} then '__ID_0__' else original end as echo from t),
  {D.polished('select * from e', 'original', 'echo')},
  m as (select *, case when use then replace(replace(polished, '__TKN_0__', regexp_extract(original, {D.q(TKN)})), '__ID_0__', original)
    else original end as merged from pl)"""


def _round(spark, sf):
    cells = _wide_rows(derive(spark, sf, CELLS)).drop("translated")
    batches = TP.prepare(cells, EN)
    fence = F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))
    cut = F.expr("substring(payload, 1, length(payload) - 3)")
    responses = batches.select(
        "batch_id", F.when(F.col("batch_id") % 6 == 0, cut).otherwise(fence).alias("text")
    )
    return TP.finish(cells, batches, responses, EN)


@query(f"with {_ECHO} select row_idx, col_key, merged as translated from m")
def translation_round(spark, sf):
    return _round(spark, sf).cells.select("row_idx", "col_key", "translated")


@query(
    f"""with {_ECHO}, {D.scored('select * from m', 'merged', "'en'")},
    r as (select row_idx, bool_or({D.untranslated('col_key')}) as missing, not bool_or(answered) as write_failed from lg group by row_idx)
    select row_idx, missing, write_failed, not write_failed and not missing as done from r"""
)
def translation_round_status(spark, sf):
    return _round(spark, sf).status


@query(
    f"""with {PARSED_LINES}, l as (select unnest(['English','Spanish','French','German','Italian','Russian','Portuguese']) as lang),
    a as (select e.*, lang, concat('[', lang, '] ', content) as ans from e cross join l),
    f as (select *, {D.spacing('ans')} as s1 from a),
    g as (select *, {D.sub('s1', rf'\b([A-Za-z])[{D.WS}]+(\d{{1,3}})\b', r'\1\2')} as s2 from f),
    h as (select *, {D.spacing('s2')} as s3 from g),
    m as (select lang, line_no, case when {D.like('content', D.CJK)} then concat(prefix, {D.status('s3')}, suffix) else line end as merged from h),
    pp as (select lang, line_no // 1000 as block_no, string_agg(merged, chr(10) order by line_no) as body, max(line_no) as last_no from m group by all),
    z as (select max(line_no) as z, arg_max(line, line_no) as zl from e)
    select lang, block_no, md5(case when last_no < z or zl = '' then concat(body, chr(10)) else body end) as digest from pp cross join z"""
)
def resource_round(spark, sf):
    """Each language's answer is the masked content behind the language's name."""
    from sheetqa.sources.string_resources import parse_string_lines

    lines = derive(spark, sf, LINES).withColumn("line_break", F.lit("\n"))
    entries = parse_string_lines(lines)
    sent = RP.per_language(entries.filter("needs_translation"))
    answers = sent.select(
        "line_no",
        "lang",
        F.concat(F.lit("["), "lang", F.lit("] "), RP.mask_string(F.col("content"))["sanitized"]).alias("answer"),
    )
    files = RP.finish_resources(entries, answers, [])
    return files.select("lang", "block_no", F.md5("text").alias("digest"))


# Cells worth a retry are numbered in order and sent in fives; every seventh batch is cut off.
_RETRIED = f"""{lang_cells('en')}, re as (select row_idx, col_key from lg where {_RETRY}),
  num as (select *, (row_number() over (order by row_idx) - 1) // 5 as batch_id from re),
  ans as (select c.*, n.batch_id, case when n.batch_id % 7 <> 0 then 'A Decreased count ,see.Next' end as answer
    from ({CELLS_SQL}) c left join num n using (row_idx)),
  {D.polished('select * from ans', 'translated', 'answer')},
  m as (select *, case when answer is not null then polished else translated end as merged from pl)"""


def _retry_round(spark, sf):
    cells = derive(spark, sf, CELLS)
    batches = TP.prepare_retry(cells, EN)
    record = F.transform("columns", lambda k: F.concat(F.lit('{"'), k, F.lit('":"A Decreased count ,see.Next"}')))
    columns = F.transform(
        F.from_json("payload", "array<map<string,string>>"), lambda r: F.get(F.map_keys(r), 0)
    )
    text = F.concat(F.lit("["), F.array_join(record, ","), F.lit("]"))
    cut = F.when(F.col("batch_id") % 7 == 0, F.lit("[{")).otherwise(F.col("text"))
    responses = batches.withColumn("columns", columns).withColumn("text", text).select("batch_id", cut.alias("text"))
    status = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        (F.col("o_orderstatus") == "F").alias("done"),
        (F.col("o_orderstatus") == "P").alias("write_failed"),
    )
    return TP.finish_retry(cells, batches, responses, status, EN)


@query(f"with {_RETRIED} select row_idx, col_key, merged as translated from m")
def retry_round(spark, sf):
    """Audit, payload, batches, answers and merge on top of the current translation."""
    return _retry_round(spark, sf).cells.select("row_idx", "col_key", "translated")


@query(
    f"""with {_RETRIED.replace('lg', 'la').replace('sc0', 'sa0')}, {D.scored('select * from m', 'merged', "'en'")},
    s as (select o_orderkey as row_idx, o_orderstatus as st from orders)
    select row_idx, st = 'F' or answer is not null as done, {D.untranslated('col_key')} as missing,
      st = 'P' and {D.untranslated('col_key')} as write_failed from lg join s using (row_idx)"""
)
def retry_round_status(spark, sf):
    """Flags after the retry round."""
    return _retry_round(spark, sf).status


@query(
    f"""with g as (select row_idx, original as value, {D.trim('original')} as t from ({CELLS_SQL}) s),
    sent as (select *, t <> '' and not {D.neutral('t')} as send from g),
    num as (select *, case when send then (row_number() over (partition by send order by row_idx) - 1) // 20 end as batch_id from sent),
    a as (select *, case when send and batch_id % 6 <> 0 then concat('the ', value, ' ,x') else value end as answer from num),
    {D.polished('select * from a', 'value', 'answer')} select row_idx, polished as merged from pl"""
)
def unit_round(spark, sf):
    """Units are masked, sent in twenties and echoed; every sixth batch fails."""
    units = derive(spark, sf, CELLS).select("row_idx", F.col("original").alias("value"))
    batches = UP.prepare_units(units, EN)
    records = F.from_json("payload", "array<struct<content:string>>")
    echo = F.transform(records, lambda r: F.struct(F.concat(F.lit("the "), r["content"], F.lit(" ,x")).alias("content")))
    text = F.when(F.col("batch_id") % 6 == 0, F.lit("none")).otherwise(F.to_json(echo))
    return UP.finish_units(units, batches, batches.select("batch_id", text.alias("text"))).select("row_idx", "merged")


@query(
    f"""with {D.polished(CELLS_SQL, 'original', 'translated')}
    select row_idx, col_key, case when row_idx % 9 = 0 then concat('=', row_idx) else polished end as value,
      row_idx % 9 <> 0 and row_idx % 5 = 0 as overwritten_formula from pl"""
)
def export_round(spark, sf):
    """Every fifth cell holds a formula; every ninth row is not among the finished cells."""
    cells = derive(spark, sf, CELLS)
    base = cells.select(
        "row_idx", "col_key", F.concat(F.lit("="), "row_idx").alias("value"), (F.col("row_idx") % 5 == 0).alias("is_formula")
    )
    out = TP.export_sheet(base, cells.filter("row_idx % 9 <> 0"))
    return out.select("row_idx", "col_key", "value", "overwritten_formula")


@query(
    f"""with {D.scored(duck(LANG_LINES), 'content', _CODES_BY_NAME)}
    select lang, count(*) filter ({D.untranslated("'content'")}) as untranslated,
      count(*) filter ({D.placeholder('content')}) as placeholders,
      count(*) filter ({D.spacing_issue('content')}) as spacing from lg group by lang"""
)
def resource_quality(spark, sf):
    """Quality of translated files, given as blocks of lines inside their markup."""
    lines = derive(spark, sf, LANG_LINES).withColumn(
        "merged", F.concat(F.lit('<string name="k">'), "content", F.lit("</string>"))
    )
    files = SR.join_string_lines(
        lines.withColumns({"line": F.col("merged"), "line_break": F.lit("\n")}), ["lang"], "merged"
    )
    # A block that others follow ends with the break before them.
    texts = files.withColumn("text", F.regexp_replace("text", "\n$", ""))
    return RP.resource_quality(texts, ["block_no"])


@query(
    f"""with {D.scored('select doc_id, text from documents', 'text', "'en'")}
    select doc_id, {D.untranslated("'text'")} as untranslated, {D.spacing_issue('text')} as spacing from lg"""
)
def stream_audit(spark, sf):
    """The audit of ``documents`` as a stream that stops when all has been read."""
    schema = table(spark, sf, "documents").schema
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    # A pattern fits the table as one file and as a folder of files.
    stream = read_cells(spark, f"{sf}/documents.parque[t]", schema)

    def audit(df):
        text = F.col("text")
        return df.select(
            "doc_id",
            is_untranslated(F.lit("text"), text, EN).alias("untranslated"),
            spacing_issue(text).alias("spacing"),
        )

    run_pass(stream, audit, out, state)
    return spark.read.parquet(out)
