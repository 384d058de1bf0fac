"""Queries around the external model: batches, answers, merges, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetqa.operators import batches as B
from sheetqa.operators import merge as MG
from sheetqa.plans import translation as TP
from sheetqa.sources import history as H
from sheetqa.sources import progress as PR
from sheetqa.sources import responses as RS
from sheetqa.sources import string_resources as SR
from sheetqa.store import scratch_path

from . import duck as D
from .catalog import query
from .cells_queries import _GROUPED, CELLS_SQL, PARSED_LINES, _wide_rows
from .expected import GLOSSARY
from .derived import BODIES, CELLS, LANG_LINES, LINES, ODD_OUTPUTS, RAW_OUTPUTS, RESPONSES, derive, duck, table
from .text_queries import TKN

EN = "English"
RESPONSES_SQL = duck(RESPONSES)

# In these cells every original that is not locked or neutral is sent; only CJK text is masked.
_SENT = f"""sent as (select *, {D.trim('original')} as ot from ({_GROUPED}) g),
  san as (select *, case when ot <> '' and not {D.neutral('ot')} and not {D.locked('col_key', 'original')} and {D.like('original', D.CJK)}
      then {D.splice('original', D.q(TKN), "concat('__TKN_', i - 1, '__')")}
    when ot <> '' and not {D.neutral('ot')} and not {D.locked('col_key', 'original')} and {D.identifier('original')} then '__ID_0__'
    else original end as sanitized from sent),
  rec as (select row_idx, '{{' || string_agg('"' || col_key || '":"' || sanitized || '"', ',' order by col_key) || '}}' as record
    from san group by row_idx)"""


def _payload_sql(batch: str, src: str = "rec") -> str:
    return f"""select {batch} as batch_id, count(*) as n_records, min(row_idx) as first_row,
      '[' || string_agg(record, ',' order by row_idx) || ']' as payload from {src} group by 1"""


def _grouped(spark, sf):
    return _wide_rows(derive(spark, sf, CELLS))


@query(
    f"""with {_SENT}, pend as (select distinct o_orderkey // 4 as row_idx from orders where o_orderstatus = 'O'),
    keep as (select * from rec semi join pend using (row_idx)) {_payload_sql('row_idx // 5', 'keep')}"""
)
def sheet_request_batches(spark, sf):
    """Rows with an open order are pending; batches stay aligned to all rows."""
    todo = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.floor(F.col("o_orderkey") / 4).alias("row_idx")
    )
    return B.pending_requests(_grouped(spark, sf), todo, EN).drop("rows")


@query(
    f"""with {_SENT}, num as (select *, row_number() over (order by row_idx) - 1 as k from rec)
    {_payload_sql('k // 5', 'num')}"""
)
def retry_request_batches(spark, sf):
    cells = B.sanitize_cells(_grouped(spark, sf), EN)
    return B.make_request_batches(cells, B.RETRY_BATCH, align=False).drop("rows")


@query(
    """with num as (select doc_id, text, row_number() over (order by doc_id) - 1 as k from documents)
    select k // 20 as batch_id, count(*) as n_records, min(doc_id) as first_row, cast(sum(length(text)) as bigint) as n_chars
    from num group by 1"""
)
def unit_request_batches(spark, sf):
    units = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_idx"), F.lit("content").alias("col_key"), F.col("text").alias("sanitized")
    )
    batches = B.make_request_batches(units, B.UNIT_BATCH, align=False)
    records = F.from_json("payload", "array<struct<content:string>>")
    n_chars = F.aggregate(records, F.lit(0).cast("bigint"), lambda a, r: a + F.length(r["content"]))
    return batches.select("batch_id", "n_records", "first_row", n_chars.alias("n_chars"))


_PROMPT = "\n".join(f"{e.keywords[0]} -> {e.preferred}" for e in GLOSSARY) + "\n\nINPUT:\n"


@query(
    f"""with {_SENT}, b as ({_payload_sql('row_idx // 5')})
    select batch_id, md5({D.q(_PROMPT)} || payload) as digest from b"""
)
def request_prompts(spark, sf):
    cells = B.sanitize_cells(_grouped(spark, sf), EN)
    prompts = B.request_prompts(B.make_request_batches(cells, B.SHEET_BATCH, align=True))
    return prompts.select("batch_id", F.md5("prompt").alias("digest"))


@query(
    f"""with {_SENT} select row_idx // 5 as batch_id, row_idx, cast(row_number() over (partition by row_idx // 5 order by row_idx) - 1 as int) as seq,
    md5(record) as digest from rec"""
)
def placed_rows(spark, sf):
    placed = B.place_rows(B.sanitize_cells(_grouped(spark, sf), EN), B.SHEET_BATCH, align=True)
    return placed.select("batch_id", "row_idx", "seq", F.md5("record").alias("digest"))


_KIND = "(select o_orderkey as batch_id, o_orderkey % 7 as kind, o_custkey from orders) k"


@query(
    f"""select batch_id, kind not in (4, 6) as ok, 0 as seq, concat('a', o_custkey) as content from {_KIND} where kind not in (4, 6)
    union all select batch_id, true, 1, case kind when 1 then 'b，c' when 5 then '[b]' else 'b' end from {_KIND} where kind not in (4, 6)
    union all select batch_id, false, -1, '' from {_KIND} where kind in (4, 6)"""
)
def parse_responses(spark, sf):
    parsed = RS.parse_responses(derive(spark, sf, RAW_OUTPUTS))
    rows = parsed.select(
        "batch_id", (F.col("error") == "").alias("ok"), F.posexplode_outer("records").alias("seq", "r")
    )
    return rows.select(
        "batch_id",
        "ok",
        F.coalesce("seq", F.lit(-1)).alias("seq"),
        F.coalesce(F.col("r")["content"], F.lit("")).alias("content"),
    )


@query(
    f"""select batch_id, kind not in (4, 6) and o_custkey % 3 <> 0 as ok, case kind when 4 then 'Failed to parse model JSON'
      when 6 then 'API returned empty response.' else case when o_custkey % 3 = 0 then 'Translation returned 2 records (expected 3).'
      else '' end end as error from {_KIND}"""
)
def validate_responses(spark, sf):
    """Every third customer's batch asked for three records and got two."""
    orders = table(spark, sf, "orders")
    requests = orders.select(
        F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_custkey") % 3 == 0, 3).otherwise(2).alias("n_records")
    )
    parsed = RS.parse_responses(derive(spark, sf, RAW_OUTPUTS))
    return B.validate_responses(requests, parsed).select("batch_id", "ok", "error")


@query(
    f"""with r as (select distinct concat(engine, '-', batch_id) as batch_id, seq, row_idx, error from ({RESPONSES_SQL}) x),
    n as (select batch_id, count(*) as n from r group by batch_id)
    select concat(batch_id, case when seq < ceil(n / 2.0) then '.0' else '.1' end) as batch_id,
      cast(case when seq < ceil(n / 2.0) then seq else seq - ceil(n / 2.0) end as int) as seq, row_idx
    from r join n using (batch_id) where error <> '' and n > 1"""
)
def bisect_failed_batches(spark, sf):
    """Each engine's failed batches are split for themselves."""
    rows = derive(spark, sf, RESPONSES).withColumn("batch_id", F.concat_ws("-", "engine", "batch_id"))
    status = rows.select("batch_id", "error").distinct()
    return B.bisect_failed_batches(rows.select("batch_id", "seq", "row_idx"), status).select(
        "batch_id", "seq", "row_idx"
    )


_ODD = "(select o_orderkey as batch_id, o_orderkey % 6 as kind, o_custkey from orders) k"


@query(
    f"""select batch_id, 0 as seq, true as is_object, concat('a', o_custkey) as content from {_ODD} where kind <> 4
    union all select batch_id, 1, false, '' from {_ODD} where kind in (1, 2, 5)"""
)
def parse_odd_answers(spark, sf):
    """Of repeated members the last counts; items that are no objects stay as NULL."""
    rows = RS.response_rows(RS.parse_responses(derive(spark, sf, ODD_OUTPUTS)), ["batch_id"])
    record = F.col("record")
    return rows.select(
        "batch_id", "seq", record.isNotNull().alias("is_object"), F.coalesce(record["content"], F.lit("")).alias("content")
    )


@query(
    f"""select batch_id, case when kind in (1, 2, 5) then 'Translation returned invalid record data.'
    when kind = 4 then 'Translation returned 0 records (expected 1).' else '' end as error from {_ODD}"""
)
def validate_odd_answers(spark, sf):
    """Counts fit for all but empty answers; items that are no objects fail their batch."""
    wanted = derive(spark, sf, ODD_OUTPUTS).select(
        "batch_id", F.when((F.col("batch_id") % 6).isin(1, 2, 5), 2).otherwise(1).alias("n_records")
    )
    parsed = RS.parse_responses(derive(spark, sf, ODD_OUTPUTS))
    return B.validate_responses(wanted, parsed).select("batch_id", "error")


_REQUESTS = """select o_orderkey as id, o_orderpriority as lang, concat('[', o_custkey, ']') as payload,
  case o_orderstatus when 'F' then 'gemini' when 'O' then '' end as model, 'direct' as mode"""


def _requests(spark, sf):
    return derive(spark, sf, _REQUESTS + " from orders")


def _memory(spark, sf):
    """Finished orders' requests are known."""
    done = _requests(spark, sf).filter("model = 'gemini'")
    key = B.request_key(F.col("lang"), F.col("payload"), F.col("model"), F.col("mode"))
    results = done.select(key.alias("request_key"), F.concat("lang", "payload").alias("result"))
    empty = results.limit(0)
    return B.memory_append(empty, results)


@query(
    f"""with r as ({_REQUESTS} from orders), k as (select distinct lang, payload from r where model = 'gemini')
    select id, case when model = 'gemini' then concat(lang, payload) else '' end as result, coalesce(model = 'gemini', false) as hit from r"""
)
def memory_lookup(spark, sf):
    found = B.memory_lookup(_requests(spark, sf), _memory(spark, sf))
    return found.select("id", F.coalesce("result", F.lit("")).alias("result"), "hit")


@query(f"with r as ({_REQUESTS} from orders) select id from r where model is distinct from 'gemini'")
def memory_misses(spark, sf):
    return B.memory_misses(_requests(spark, sf), _memory(spark, sf)).select("id")


@query(
    f"""with r as ({RESPONSES_SQL}), ok as (select batch_id, row_idx, min(priority) as p from r where error = '' group by all)
    select d.row_idx, coalesce(r.engine, '') as engine, coalesce(r.answer, '') as text, ok.p is null as write_failed
    from (select distinct row_idx from r) d left join ok using (row_idx) left join r on r.row_idx = d.row_idx and r.priority = ok.p"""
)
def pick_engine(spark, sf):
    responses = derive(spark, sf, RESPONSES).select(
        "row_idx", "engine", (F.col("error") == "").alias("ok"), F.col("answer").alias("text")
    )
    return B.pick_engine(responses, ["row_idx"]).fillna("", ["engine", "text"])


@query(
    f"""select o_orderkey as batch_id, case o_orderkey % 6 when 0 then concat('[a', o_custkey, ']')
      when 1 then concat('a', o_custkey, chr(10), 'b', chr(10), '') else concat('[{{"content":"a', o_custkey, '"}}]') end as content
    from orders"""
)
def flatten_content(spark, sf):
    return derive(spark, sf, BODIES).select(
        "batch_id", RS.flatten_content(F.col("body")).alias("content")
    )


# --- merges ---

# Answers keep the tokens that were sent; every fourth customer's answer is missing.
_ANSWER = """case when o_custkey % 4 = 0 then null
  when row_idx % 8 = 0 then 'White Blood Cell is A Decreased ,see __TKN_0__.'
  when row_idx % 8 = 4 then 'reticulocyte count of 网织红细胞' else concat('the mild answer.Case', o_custkey) end"""


def _keyed_answers(spark, sf):
    cells = derive(spark, sf, CELLS).join(
        table(spark, sf, "orders"), F.col("row_idx") == F.col("o_orderkey")
    )
    return cells.select("row_idx", "col_key", F.expr(_ANSWER).alias("answer"), "o_orderstatus")


_SEND = f"""not {D.locked('col_key', 'original')} and {D.trim('original')} <> '' and not {D.neutral(D.trim('original'))}"""
_MERGED = f"""a as (select c.*, {_ANSWER} as answer, o_orderstatus from ({CELLS_SQL}) c join orders on o_orderkey = row_idx),
  {D.polished('select * from a', 'original', 'answer')},
  m as (select *, case when answer is not null and {_SEND} then
      replace(polished, '__TKN_0__', regexp_extract(original, {D.q(TKN)})) else original end as merged from pl)"""


@query(
    f"""with a as (select *, 'the mild answer.Case' as answer from ({CELLS_SQL}) c), {D.polished('select * from a', 'original', 'answer')}
    select row_idx, col_key, case when {_SEND} then polished else original end as translated from pl"""
)
def merge_repeated_answers(spark, sf):
    """Every answer names its member twice; the table keeps its cells."""
    cells = derive(spark, sf, CELLS)
    requests = cells.select(
        F.col("row_idx").alias("batch_id"), F.lit(1).alias("n_records"), F.array("row_idx").alias("rows")
    )
    twice = F.concat(F.lit('[{"'), "col_key", F.lit('":"no","'), "col_key", F.lit('":"the mild answer.Case"}]'))
    parsed = RS.parse_responses(cells.select(F.col("row_idx").alias("batch_id"), twice.alias("text")))
    answers = B.answer_cells(B.validate_responses(requests, parsed))
    merged = MG.merge_translations(cells.drop("translated"), answers, EN)
    return merged.select("row_idx", "col_key", "translated")


@query(f"with {_MERGED} select row_idx, col_key, merged as translated from m")
def merge_translations(spark, sf):
    cells = derive(spark, sf, CELLS).drop("translated")
    merged = MG.merge_translations(cells, _keyed_answers(spark, sf), EN)
    return merged.select("row_idx", "col_key", "translated")


def _detected(src: str, col: str) -> str:
    return D.scored(src, col, "'en'")


@query(
    f"""with {_MERGED}, {_detected('select * from m', 'merged')}
    select row_idx, {D.untranslated('col_key')} as missing, o_orderstatus = 'P' as write_failed,
      case when o_orderstatus = 'P' then false else not {D.untranslated('col_key')} end as done from lg"""
)
def row_status(spark, sf):
    """Rows of partly shipped orders count as write-failed."""
    cells = derive(spark, sf, CELLS).drop("translated")
    merged = MG.merge_translations(cells, _keyed_answers(spark, sf), EN)
    outcome = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"), (F.col("o_orderstatus") != "P").alias("ok")
    )
    return MG.row_status(merged, EN, outcome=outcome)


@query(
    f"""with a as (select c.*, {_ANSWER} as answer, o_orderstatus from ({CELLS_SQL}) c join orders on o_orderkey = row_idx),
    {D.polished('select * from a', 'translated', 'answer')}
    select row_idx, col_key, case when o_orderstatus = 'O' and answer is not null and not {D.locked('col_key', 'original')}
      then polished else translated end as translated from pl"""
)
def merge_retries(spark, sf):
    """Open orders' cells were retried from their current text, which holds no CJK tokens."""
    answers = _keyed_answers(spark, sf)
    keys = answers.filter("o_orderstatus = 'O'")
    return MG.merge_retries(derive(spark, sf, CELLS), answers, keys).select("row_idx", "col_key", "translated")


@query(
    f"""with {_MERGED} select row_idx, col_key, case when {D.placeholder('translated')} and answer is not null and {_SEND}
      then merged else translated end as translated from m"""
)
def retry_cells(spark, sf):
    """Cells with a leaked placeholder are asked for again, from their original."""
    from sheetqa.functions.quality import placeholder_leak

    cells = derive(spark, sf, CELLS)
    keys = cells.filter(placeholder_leak(F.col("translated")))
    return MG.retry_cells(cells, _keyed_answers(spark, sf), keys, EN).select(
        "row_idx", "col_key", "translated"
    )


_UNIT_ANSWER = "case when doc_id % 3 = 0 then null else concat(text, ' A Decreased count ,see.Next') end"


@query(
    f"""with s as (select doc_id, text, coalesce({_UNIT_ANSWER}, text) as answer from documents),
    f as (select doc_id, {D.spacing('answer')} as sp from s)
    select doc_id, md5({D.status('sp')}) as digest from f"""
)
def merge_units(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))
    answers = table(spark, sf, "documents").select("doc_id", F.expr(_UNIT_ANSWER).alias("answer"))
    merged = MG.merge_units(docs, answers, "doc_id")
    return merged.select("doc_id", F.md5("merged").alias("digest"))


_LINE_ANSWER = """case when o_custkey % 4 = 0 then null when line_no % 4 = 2 then 'note , T 4'
  else concat('total __TKN_0_ items,__TKN_1__ ', o_custkey) end"""


@query(
    f"""with {PARSED_LINES}, a as (select e.*, {_LINE_ANSWER} as answer from e join orders on o_orderkey = line_no),
    r as (select *, coalesce(case when line_no % 4 = 0 then replace(replace(replace(answer, '__TKN_0_ ', '__TKN_0__ '), '__TKN_0__', '%1$s'), '__TKN_1__', 'START') else answer end, content) as text from a),
    f as (select *, {D.spacing('text')} as s1 from r),
    g as (select *, {D.sub('s1', rf'\b([A-Za-z])[{D.WS}]+(\d{{1,3}})\b', r'\1\2')} as s2 from f),
    h as (select *, {D.spacing('s2')} as s3 from g)
    select line_no, case when {D.like('content', D.CJK)} then concat(prefix, {D.status('s3')}, suffix) else line end as merged from h"""
)
def merge_string_lines(spark, sf):
    """Answers come back with a damaged first placeholder."""
    entries = SR.parse_string_lines(derive(spark, sf, LINES))
    answers = entries.join(table(spark, sf, "orders"), F.col("line_no") == F.col("o_orderkey")).select(
        "line_no", F.expr(_LINE_ANSWER).alias("answer")
    )
    return MG.merge_string_lines(entries, answers).select("line_no", "merged")


# --- stores ---


@query(
    f"""with {_detected(CELLS_SQL, 'translated')}, l as (select 'English' as target_lang union all select 'Spanish')
    select concat('f', o_custkey % 3) as file_id, target_lang, row_idx, record,
      case when target_lang = 'English' then not {D.untranslated('col_key')} else true end as done,
      case when target_lang = 'English' then {D.untranslated('col_key')} else false end as missing, false as write_failed
    from (select lg.*, concat('{{"text":"', translated, '"}}') as record, o_custkey from lg join orders on o_orderkey = row_idx) cross join l"""
)
def progress_store(spark, sf):
    """English progress saved twice with flags, Spanish in the older form without."""
    from sheetqa.functions.language import is_untranslated

    path = scratch_path(spark, "progress")
    files = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file_id"),
    )
    rows = derive(spark, sf, CELLS).join(files, "row_idx").withColumn(
        "record", F.concat(F.lit('{"text":"'), F.col("translated"), F.lit('"}'))
    )
    missing = is_untranslated(F.col("col_key"), F.col("translated"), EN)
    english = rows.select(
        "file_id", F.lit(EN).alias("target_lang"), "row_idx", "record",
        (~missing).alias("done"), missing.alias("missing"), F.lit(False).alias("write_failed"),
    )
    PR.save_progress(english.withColumn("done", F.lit(False)), path)
    PR.save_progress(
        rows.select("file_id", F.lit("Spanish").alias("target_lang"), "row_idx", "record"), path
    )
    PR.save_progress(english, path)
    return PR.load_progress(spark, path).drop("updated_at")


@query(
    """select concat('f', o_custkey % 3) as file_id, lang as target_lang, o_orderkey as row_idx
    from orders cross join (select 'English' as lang union all select 'Spanish') l
    where o_custkey % 3 = 1 or (o_custkey % 3 = 2 and lang = 'Spanish')"""
)
def progress_cleared(spark, sf):
    """All of the first file is cleared, and the English snapshot of the last."""
    path = scratch_path(spark, "progress")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file_id"),
        F.explode(F.array(F.lit(EN), F.lit("Spanish"))).alias("target_lang"),
        F.col("o_orderkey").alias("row_idx"),
        F.lit("{}").alias("record"),
    )
    PR.save_progress(rows, path)
    PR.clear_progress(spark, path, "f0")
    PR.clear_progress(spark, path, "f2", EN)
    return PR.load_progress(spark, path).select("file_id", "target_lang", "row_idx")



@query(
    f"""with n as (select *, row_number() over (order by epoch_ms(o_orderdate), cast(o_orderkey as varchar)) as record_no from orders)
    select record_no, md5(concat(case when record_no > 1 then repeat('=', 80) || chr(10) else '' end, 'Record ', record_no, chr(10), 'Timestamp: ',
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), chr(10), chr(10), '[Original]', chr(10), o_orderpriority, chr(10), chr(10), '[English]', chr(10), o_custkey,
      {", ".join(f"chr(10), chr(10), '[{lang}]', chr(10), ''" for lang in SR.STRING_LANGS[1:])})) as digest from n"""
)
def history_export(spark, sf):
    """Appended in two parts, numbered over the whole table."""
    path = scratch_path(spark, "history")
    entries = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.col("o_orderpriority").alias("source"),
        F.create_map(F.lit(EN), F.col("o_custkey").cast("string")).alias("outputs"),
        "o_orderstatus",
    )
    H.append_history(entries.filter("o_orderstatus = 'F'"), path)
    H.append_history(entries.filter("o_orderstatus <> 'F'"), path)
    export = H.export_history(H.load_history(spark, path))
    return export.select("record_no", F.md5("text").alias("digest"))


@query(
    f"""with n as (select *, row_number() over (order by epoch_ms(o_orderdate), cast(o_orderkey as varchar)) as record_no from orders),
    t as (select unnest(string_split(concat(case when record_no > 1 then repeat('=', 80) || chr(10) else '' end, 'Record ', record_no, chr(10), 'Timestamp: ',
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), chr(10), chr(10), '[Original]', chr(10), o_orderpriority, chr(10), chr(10), '[English]', chr(10), o_custkey,
      {", ".join(f"chr(10), chr(10), '[{lang}]', chr(10), ''" for lang in SR.STRING_LANGS[1:])}), chr(10))) as line from n)
    select line, count(*) as n from t group by line"""
)
def history_text(spark, sf):
    """The lines of the stored text export, and how often each occurs."""
    path, out = scratch_path(spark, "history"), scratch_path(spark, "history-text")
    entries = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.col("o_orderpriority").alias("source"),
        F.create_map(F.lit(EN), F.col("o_custkey").cast("string")).alias("outputs"),
    )
    H.append_history(entries, path)
    H.write_history_text(H.export_history(H.load_history(spark, path)), out)
    return spark.read.text(out).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# --- answers that come more than once, and split batches ---

# Three answers to a batch, two to every fifth; invalid where batch and attempt add up so, all of every seventh.
_TRIES = """(select b, max(k) as k from (select distinct row_idx // 5 as b from g) x, (select unnest([1, 2, 3]) as k) y
  where (k < 3 or b % 5 <> 0) and (b + k) % 3 <> 0 and b % 7 <> 0 group by b)"""
_AGAIN = f"""g as ({_GROUPED}), tries as {_TRIES},
  e as (select g.*, k is not null as answered, k is not null and {_SEND} as use, concat('the mild answer ', k, ' .Next') as echo
    from g left join tries on row_idx // 5 = b),
  {D.polished('select * from e', 'original', 'echo')},
  m as (select *, case when use then polished else original end as merged from pl)"""


def _answered_again(spark, sf):
    """Late answers stand before early ones, and each first attempt arrives once more at the end."""
    cells = _grouped(spark, sf).drop("translated")
    batches = TP.prepare(cells, EN)
    b = F.col("batch_id")
    tries = batches.select("batch_id", "payload", F.explode(F.array(*map(F.lit, (3, 2, 1, 1)))).alias("attempt"))
    tries = tries.where((F.col("attempt") < 3) | (b % 5 != 0))
    text = F.to_json(
        F.transform(
            F.from_json("payload", "array<map<string,string>>"),
            lambda r: F.transform_values(r, lambda _, v: F.concat(F.lit("the mild answer "), F.col("attempt"), F.lit(" .Next"))),
        )
    )
    broken = ((b + F.col("attempt")) % 3 == 0) | (b % 7 == 0)
    answers = tries.select(
        "batch_id",
        "attempt",
        (100 - F.col("attempt")).alias("arrived"),
        F.when(broken, F.lit("[{")).otherwise(text).alias("text"),
    )
    return TP.finish(cells, batches, answers, EN)


@query(f"with {_AGAIN} select row_idx, col_key, merged as translated from m")
def cells_answered_again(spark, sf):
    """Every cell of a batch comes from its newest valid answer."""
    return _answered_again(spark, sf).cells.select("row_idx", "col_key", "translated")


@query(
    f"""with {_AGAIN}, {_detected('select * from m', 'merged')},
    r as (select row_idx, bool_or({D.untranslated('col_key')}) as missing, not bool_or(answered) as write_failed from lg group by row_idx)
    select row_idx, missing, write_failed, not write_failed and not missing as done from r"""
)
def status_answered_again(spark, sf):
    """One status per row, however often its batch was answered."""
    return _answered_again(spark, sf).status


@query(
    f"""with g as (select row_idx, original as value, {D.trim('original')} as t from ({CELLS_SQL}) s),
    sent as (select *, t <> '' and not {D.neutral('t')} as send from g),
    num as (select *, case when send then (row_number() over (partition by send order by row_idx) - 1) // 20 end as b from sent),
    a as (select *, case when not send or b % 6 = 0 then value when b % 3 = 1 then concat('first ', value, ' ,x') else concat('last ', value, ' ,x') end as answer from num),
    {D.polished('select * from a', 'value', 'answer')} select row_idx, polished as merged from pl"""
)
def units_answered_again(spark, sf):
    """Two answers to a batch; the second is cut off for every third, both for every sixth."""
    from sheetqa.plans import units as UP

    units = derive(spark, sf, CELLS).select("row_idx", F.col("original").alias("value"))
    batches = UP.prepare_units(units, EN)
    tries = batches.select("batch_id", "payload", F.explode(F.array(F.lit("last"), F.lit("first"))).alias("word"))
    records = F.from_json("payload", "array<struct<content:string>>")
    echo = F.transform(records, lambda r: F.struct(F.concat("word", F.lit(" "), r["content"], F.lit(" ,x")).alias("content")))
    late = F.col("word") == "last"
    broken = (F.col("batch_id") % 6 == 0) | (late & (F.col("batch_id") % 3 == 1))
    answers = tries.select(
        "batch_id", F.when(late, 2).otherwise(1).alias("arrived"), F.when(broken, F.lit("none")).otherwise(F.to_json(echo)).alias("text")
    )
    return UP.finish_units(units, batches, answers).select("row_idx", "merged")


@query(
    f"""with {PARSED_LINES}, a as (select e.*, case when o_custkey % 4 = 0 then null else concat('newest ', o_custkey) end as answer
      from e join orders on o_orderkey = line_no),
    f as (select *, coalesce(answer, content) as text from a),
    s as (select *, {D.spacing('text')} as s1 from f),
    g as (select *, {D.sub('s1', rf'\b([A-Za-z])[{D.WS}]+(\d{{1,3}})\b', r'\1\2')} as s2 from s),
    h as (select *, {D.spacing('s2')} as s3 from g)
    select line_no, case when {D.like('content', D.CJK)} then concat(prefix, {D.status('s3')}, suffix) else line end as merged from h"""
)
def lines_answered_again(spark, sf):
    """Three answers per line: the newest is the greatest for no one, and a later NULL is none."""
    entries = SR.parse_string_lines(derive(spark, sf, LINES))
    keyed = entries.join(table(spark, sf, "orders"), F.col("line_no") == F.col("o_orderkey"))
    given = F.col("o_custkey") % 4 != 0
    answer = (
        F.when(given & (F.col("attempt") == 2), F.concat(F.lit("newest "), "o_custkey"))
        .when(given & (F.col("attempt") == 1), F.lit("zzz oldest"))
    )
    tries = keyed.withColumn("attempt", F.explode(F.array(*map(F.lit, (3, 2, 1)))))
    answers = tries.select("line_no", "attempt", answer.alias("answer"))
    return MG.merge_string_lines(entries, answers).select("line_no", "merged")


# A batch's node fails while its level is below the batch's remainder by four.
_TREE = """with recursive b as (select o_orderkey // 8 as b, count(*) as n from orders group by 1),
  nodes(b, path, lo, hi, depth) as (
    select b, b::varchar, 0, n::int, 0 from b
    union all
    select b, path || s.side, case when s.side = '.0' then lo else lo + (hi - lo + 1) // 2 end,
      case when s.side = '.0' then lo + (hi - lo + 1) // 2 else hi end, depth + 1
    from nodes, (select unnest(['.0', '.1']) as side) s where depth < b % 4 and hi - lo > 1),
  leaves as (select * from nodes where depth >= b % 4 or hi - lo = 1),
  r as (select o_orderkey // 8 as b, o_orderkey as row_idx, row_number() over (partition by o_orderkey // 8 order by o_orderkey) - 1 as seq from orders),
  tree as (select n.path as batch_id, n.b, n.lo, n.hi, count(*)::int as n_leaves, bool_and(l.depth >= l.b % 4) as ok
    from nodes n join leaves l on n.b = l.b and (l.path = n.path or starts_with(l.path, n.path || '.')) group by all)"""


def _split_answers(spark, sf):
    """Batches of eight records, and the answers of three levels of splits."""
    from sheetqa.operators import splits as SP

    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_idx"), F.lit("content").alias("col_key"), F.col("o_orderkey").cast("string").alias("sanitized")
    )
    batches = B.make_request_batches(rows, 8, align=True)
    level, sent = batches.withColumn("batch_id", F.col("batch_id").cast("string")), []
    for depth in range(4):
        number = F.substring_index("batch_id", ".", 1).cast("long")
        text = F.when(F.lit(depth) < number % 4, F.lit("[{")).otherwise(F.col("payload"))
        sent.append(level.select("batch_id", text.alias("text")))
        level = SP.halves(level)
    answers = sent[0]
    for more in sent[1:]:
        answers = answers.unionByName(more)
    return batches, answers


@query(
    f"""{_TREE} select batch_id, (hi - lo)::bigint as n_records, n_leaves, ok, case when ok then '' else 'Failed to parse model JSON' end as error,
      (select string_agg(row_idx, ',' order by seq) from r where r.b = t.b and seq >= lo and seq < hi) as rows,
      case when ok then (select string_agg(row_idx, ',' order by seq) from r where r.b = t.b and seq >= lo and seq < hi) else '' end as contents
    from tree t"""
)
def split_trees(spark, sf):
    """Every node of each batch's tree of splits, put together from its leaves."""
    from sheetqa.operators import splits as SP

    leaves = SP.split_rounds(*_split_answers(spark, sf))
    contents = F.array_join(F.transform("records", lambda r: r["content"]), ",")
    return SP.roll_up(leaves, roots_only=False).select(
        "batch_id", "n_records", "n_leaves", "ok", "error",
        F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"),
        F.coalesce(contents, F.lit("")).alias("contents"),
    )


@query(
    f"""{_TREE} select row_idx, ok, case when ok then row_idx::varchar else '' end as answer
    from tree t join r on r.b = t.b where t.batch_id = t.b::varchar"""
)
def split_batch_cells(spark, sf):
    """Rows of batches that were split: their answers if the whole batch came through."""
    from sheetqa.operators import splits as SP

    checked = SP.resolve_splits(*_split_answers(spark, sf))
    answers = B.answer_cells(checked).select("row_idx", "answer")
    return B.row_outcome(checked).join(answers.hint("merge"), "row_idx", "left").fillna("", ["answer"]).select("row_idx", "ok", "answer")


# --- stores of many files, of a stream, and of results ---


@query(
    """with l as (select 'English' as lang union all select 'Spanish'),
    r as (select concat('f', o_custkey) as file_id, lang as target_lang, o_orderkey as row_idx, o_custkey as c,
      case when lang = 'English' and o_custkey % 5 = 0 and bool_or(o_orderkey % 2 = 1) over (partition by o_custkey)
        then case when o_orderkey % 2 = 1 then 'third' end
        when o_custkey in (7, 14) or (o_custkey = 11 and lang = 'Spanish') then null
        when lang = 'English' and o_custkey % 3 = 0 then 'second' else 'first' end as record from orders, l)
    select file_id, target_lang, row_idx, record from r where record is not null"""
)
def progress_of_many_files(spark, sf):
    """A file per customer: saved, partly saved again, cleared, compacted, and saved once more."""
    path = scratch_path(spark, "progress")
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), "o_custkey").alias("file_id"),
        F.explode(F.array(F.lit(EN), F.lit("Spanish"))).alias("target_lang"),
        F.col("o_orderkey").alias("row_idx"),
        "o_custkey",
    )
    english = rows.where(F.col("target_lang") == EN)
    PR.save_progress(rows.withColumn("record", F.lit("first")), path)
    PR.save_progress(english.where("o_custkey % 3 = 0").withColumn("record", F.lit("second")), path)
    PR.clear_progress(spark, path, "f7")
    PR.clear_progress(spark, path, "f14")
    PR.clear_progress(spark, path, "f11", "Spanish")
    PR.compact_progress(spark, path)
    last = english.where("o_custkey % 5 = 0 and row_idx % 2 = 1").withColumn("record", F.lit("third"))
    PR.save_progress(last, path, key="third")
    # A save that is repeated under its key changes nothing.
    PR.save_progress(last.withColumn("record", F.lit("again")), path, key="third")
    return PR.load_progress(spark, path).select("file_id", "target_lang", "row_idx", "record")


@query(
    """select concat('f', o_custkey % 40) as file_id, 'English' as target_lang, count(*) as total,
    count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'O') as missing,
    count(*) filter (o_orderstatus = 'P') as write_failed from orders group by 1"""
)
def progress_of_a_stream(spark, sf):
    """Orders arrive as a stream; then the first batch runs once more."""
    from sheetqa.streaming.available import read_cells
    from sheetqa.streaming.progress import batch_saver, run_progress, running_figures

    path, state = scratch_path(spark, "stream-progress"), scratch_path(spark, "stream-state")
    orders = table(spark, sf, "orders")

    def to_rows(df):
        status = F.col("o_orderstatus")
        return df.select(
            F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("file_id"),
            F.lit(EN).alias("target_lang"),
            F.col("o_orderkey").alias("row_idx"),
            F.lit("{}").alias("record"),
            (status == "F").alias("done"),
            (status == "O").alias("missing"),
            (status == "P").alias("write_failed"),
        )

    run_progress(read_cells(spark, f"{sf}/orders.parque[t]", orders.schema), to_rows, path, "orders", state)
    batch_saver(path, "orders", to_rows)(orders, 0)
    return running_figures(spark, path)


@query(
    f"""with r as ({_REQUESTS} from orders)
    select id, case when model = 'gemini' then concat(lang, payload) else '' end as result, coalesce(model = 'gemini', false) as hit from r"""
)
def memory_stored(spark, sf):
    """Results are appended twice, the second time with others for known keys; requests meet the stored table."""
    import uuid

    from sheetqa.sources import memory as M

    name = M.open_memory(spark, f"memory_{uuid.uuid4().hex}", scratch_path(spark, "memory"))
    done = B.keyed_requests(_requests(spark, sf).filter("model = 'gemini'"))
    M.remember(done.select("request_key", F.concat("lang", "payload").alias("result")), name)
    M.remember(done.select("request_key", F.lit("later").alias("result")), name)
    found = M.look_up(_requests(spark, sf), name)
    return found.select("id", F.coalesce("result", F.lit("")).alias("result"), "hit")
