"""Queries over clinical rules, their cross-check and the indicator sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetqa.functions import clinical as CL
from sheetqa.functions import sheet_text as ST
from sheetqa.functions import library as LB
from sheetqa.operators import crosscheck as X
from sheetqa.operators import rules as R
from sheetqa.operators import sheet_update as U

from . import duck as D
from . import expected as E
from .catalog import query
from .derived import ANSWERS, RULE_ROWS, RULES, SHEET, derive, duck, table

RULES_SQL, SHEET_SQL = duck(RULES), duck(SHEET)


def _theme(c: str) -> str:
    whens = " ".join(f"when {D.like(f'lower({c})', p)} then '{v}'" for p, v in E.THEME_WORDS)
    return f"case {whens} else 'unknown' end"


def _severity(c: str) -> str:
    return (
        f"case when {D.like(c, '危|critical|严重')} then 'critical' "
        f"when {D.like(c, '警|warning|需关注')} then 'warning' else 'normal' end"
    )


_CONDITION = rf"^([A-Za-z\x{{4e00}}-\x{{9fa5}}]+)[{D.WS}]*(↑|↓|高|低|异常|=|正常)?"


def _conditions(src: str) -> str:
    """CTE ``cond(rule_id, row_idx, pos, indicator, operator, value)``."""
    return f"""seg as (select rule_id, row_idx, list_filter(list_transform(string_split_regex(description, '[,;；、]'),
        lambda s: {D.trim('s')}), lambda s: {D.like('s', _CONDITION)}) as segs from ({src}) r0),
      one as (select rule_id, row_idx, unnest(segs) as s, generate_subscripts(segs, 1) - 1 as pos from seg),
      sym as (select *, regexp_extract(s, {D.q(_CONDITION)}, 1) as indicator, regexp_extract(s, {D.q(_CONDITION)}, 2) as symbol from one),
      cond as (select rule_id, row_idx, pos, indicator, case symbol when '↑' then '>' when '高' then '>' when '↓' then '<' when '低' then '<'
        when '=' then '=' when '正常' then '=' else 'status' end as operator, coalesce(nullif(symbol, ''), 'status') as value from sym)"""


@query(
    f"""with r as ({duck(RULE_ROWS)}), d as (select *, coalesce("Rule", "条件") as description, "Interpretation" as explanation,
      lower(coalesce(nullif("级别", ''), "Interpretation", '')) as sev,
      coalesce(nullif(id, ''), cast(nullif("编号", 0) as varchar), concat('rule-', row_idx + 1)) as rule_id from r)
    select row_idx, rule_id, coalesce(description, '') as description, coalesce(explanation, '') as explanation,
      {_severity('sev')} as severity, case when description = 'WBC↑' then 'WBC>' when description = 'PLT 低' then 'PLT<' else '' end as conditions from d"""
)
def extract_rules(spark, sf):
    rules = R.extract_rules(derive(spark, sf, RULE_ROWS))
    joined = F.array_join(F.transform("conditions", lambda c: F.concat(c["indicator"], c["operator"])), ",")
    return rules.withColumn("conditions", joined)


def _rules(spark, sf):
    return R.extract_rules(
        derive(spark, sf, RULES).select(
            "row_idx", F.col("rule_id").alias("id"), F.col("description").alias("Rule"), F.col("explanation").alias("解读")
        )
    )


@query(f"select rule_id, {_severity('lower(explanation)')} as severity from ({RULES_SQL}) r")
def rule_severity(spark, sf):
    return _rules(spark, sf).select("rule_id", "severity")


@query(f"with {_conditions(RULES_SQL)} select rule_id, row_idx, pos, indicator, operator, value from cond")
def rule_conditions(spark, sf):
    return R.rule_conditions(_rules(spark, sf))


@query(f"with {_conditions(RULES_SQL)} select value, operator, count(*) as n from cond group by all")
def normalise_op(spark, sf):
    values = R.rule_conditions(_rules(spark, sf)).select("value")
    return values.groupBy("value", CL.normalise_op(F.col("value")).alias("operator")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _library(templates=E.TEMPLATES) -> str:
    """CTEs with the library as tables: template, its indicators' aliases, its keywords."""
    rows, aliases, words = [], [], []
    for i, t in enumerate(templates):
        rows.append(f"({i}, {D.q(t.template_id)}, {D.q(t.title)}, {D.q(t.summary)}, {D.q(t.severity)}, {D.q(t.status)})")
        for j, item in enumerate(t.indicators):
            aliases += [f"({i}, {j}, {D.q(a.lower())})" for a in item.aliases]
        words += [f"({i}, {D.q(w.lower())})" for w in t.keywords]
    return f"""tp(ord, template_id, title, summary, severity, status) as (values {', '.join(rows)}),
      al(ord, item, alias) as (values {', '.join(aliases)}), kw(ord, word) as (values {', '.join(words)}),
      need as (select ord, count(distinct item) as n from al group by ord)"""


def _matches(src: str, keywords: bool = True, templates=E.TEMPLATES) -> str:
    """CTE ``hit(rule_id, row_idx, ord)`` by joins with the library tables."""
    word = "semi join (select rule_id, ord from tx join kw on contains(txt, word)) w using (rule_id, ord)" if keywords else ""
    return f"""{_library(templates)},
      tx as (select *, regexp_replace(lower(concat(description, ' ', explanation)), '[{D.WS}]+', ' ', 'g') as txt from ({src}) r1),
      ind as (select distinct rule_id, row_idx, ord, item from tx join al on contains(txt, alias)),
      full_ind as (select rule_id, row_idx, ord from ind join need using (ord) group by rule_id, row_idx, ord, n having count(*) = n),
      hit as (select f.* from full_ind f {word} semi join (select ord from tp where status <> 'discarded') live using (ord))"""


@query(f"with {_matches(RULES_SQL)} select rule_id, row_idx, template_id from hit join tp using (ord)")
def template_matches(spark, sf):
    return R.template_matches(_rules(spark, sf))


@query(f"with {_matches(RULES_SQL)} select rule_id, row_idx, template_id from hit join tp using (ord)")
def template_matches_from_tables(spark, sf):
    """The library as tables, with a template per order that no rule covers in full."""
    from sheetqa.operators.terms import template_matches_table, template_tables

    aliases, words = template_tables(spark)
    first = F.when(F.col("o_orderkey") % 1000 == 0, F.lit("WBC")).otherwise(F.concat(F.lit("marker "), "o_orderkey"))
    more = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), "o_orderkey").alias("template_id"),
        F.posexplode(F.array(first, F.concat(F.lit("indicator "), "o_custkey"))).alias("item", "alias"),
    )
    return template_matches_table(_rules(spark, sf), aliases.unionByName(more), words)


_OPS = [(i, j, item.op) for i, t in enumerate(E.TEMPLATES) for j, item in enumerate(t.indicators)]


@query(
    f"""with {_matches(RULES_SQL)}, {_conditions(RULES_SQL)},
    op(ord, item, op) as (values {', '.join(f"({i}, {j}, '{o}')" for i, j, o in _OPS)}),
    ci as (select distinct rule_id, row_idx, ord, item from cond join al on contains(lower(indicator), alias) join op using (ord, item) where operator = op),
    full_ci as (select rule_id, row_idx, ord from ci join need using (ord) group by rule_id, row_idx, ord, n having count(*) = n),
    w as (select rule_id, ord from tx join kw on contains(txt, word))
    select rule_id, row_idx, template_id from full_ci semi join w using (rule_id, ord) join tp using (ord)"""
)
def strict_template_matches(spark, sf):
    return R.template_matches(_rules(spark, sf), strict_operators=True)


def _discarded(templates):
    return [t._replace(status="discarded") if t.template_id == "combo-mono-high" else t for t in templates]


def _missing(templates) -> str:
    return f"""with {_matches(RULES_SQL, templates=templates)}
    select ord, concat('missing-', template_id) as missing_id, title as indicator, summary as suggestion, severity, 'suggested' as status
    from tp anti join hit using (ord) where status <> 'discarded'"""


_COLUMNS = ["ord", "missing_id", "indicator", "suggestion", "severity", "status"]


@query(_missing(E.TEMPLATES))
def missing_combinations(spark, sf):
    return R.missing_combinations(_rules(spark, sf)).select(*_COLUMNS)


@query(_missing(_discarded(E.TEMPLATES)))
def missing_without_discarded(spark, sf):
    return R.missing_combinations(_rules(spark, sf), _discarded(LB.TEMPLATES)).select(*_COLUMNS)


@query(
    f"""with r as (select 'all' as doc_id, * from ({RULES_SQL}) a union all select concat('d', row_idx % 3), * from ({RULES_SQL}) b),
    {_matches('select concat(doc_id, chr(9), rule_id) as rule_id, row_idx, description, explanation, doc_id from r')},
    got as (select distinct split_part(rule_id, chr(9), 1) as doc_id, ord from hit),
    need_all as (select doc_id, ord, template_id from (select distinct doc_id from r) d cross join tp)
    select doc_id, ord, template_id from need_all anti join got using (doc_id, ord)"""
)
def missing_by_document(spark, sf):
    """One document holds half of the rules."""
    rules = _rules(spark, sf)
    third = F.concat(F.lit("d"), (F.col("row_idx") % 3).cast("string"))
    both = rules.withColumn("doc_id", F.lit("all")).unionByName(rules.withColumn("doc_id", third))
    return R.missing_combinations(both, by=["doc_id"]).select("doc_id", "ord", "template_id")


@query(_missing(E.TEMPLATES).replace("select ord, concat", "select ord, template_id, concat") + " order by ord limit 5")
def gap_samples(spark, sf):
    """The report's first five gaps."""
    found = R.first_gaps(R.missing_combinations(_rules(spark, sf)), 5)
    return found.select("template_id", *_COLUMNS)


@query(
    f"""with {_matches(RULES_SQL)} select (select count(*) from tx) as n_rules,
    (select count(*) from tp) - count(distinct ord) as n_gaps from hit"""
)
def rule_check_summary(spark, sf):
    return R.rule_check_summary(_rules(spark, sf))


# --- cross-check ---

_KB = f"""{_matches(RULES_SQL, keywords=False)},
  first_hit as (select rule_id, min(ord) as ord from hit group by rule_id),
  kb as (select tx.rule_id, tx.row_idx, description, explanation, tp.summary as template,
    coalesce(tp.summary, nullif(explanation, ''), nullif(description, ''), {D.q(E.NO_TEXT)}) as base,
    case when tp.ord is null then {D.q(E.NO_TEMPLATE)} else concat('建议依据「', title, '」模板提示：', summary) end as advice,
    case when tp.ord is null then 0.55 else 0.82 end as score
    from tx left join first_hit using (rule_id) left join tp on tp.ord = first_hit.ord)"""


@query(
    f"""with {_KB} select rule_id, concat('知识库：', base) as kb_text, cast(score * 100 as int) as percent,
    {_theme('base')} as kb_theme, advice as kb_recommendation from kb"""
)
def kb_conclusions(spark, sf):
    return X.kb_conclusion(_rules(spark, sf)).select(
        "rule_id",
        "kb_text",
        F.round(F.col("kb_confidence") * 100).cast("int").alias("percent"),
        "kb_theme",
        "kb_recommendation",
    )


ANSWERS_SQL = duck(ANSWERS)


@query(f"select rule_id, model, {_theme('text')} as theme from ({ANSWERS_SQL}) a")
def themes(spark, sf):
    return derive(spark, sf, ANSWERS).select("rule_id", "model", CL.theme(F.col("text")).alias("theme"))


def _score(c: str) -> str:
    return (
        f"case when {D.like(f'lower({c})', '建议|需|should|recommended')} then 78 "
        f"when {D.like(f'lower({c})', '可能|suspect')} then 65 else 50 end"
    )


@query(f"select rule_id, model, {_score('text')} as percent from ({ANSWERS_SQL}) a")
def confidences(spark, sf):
    return derive(spark, sf, ANSWERS).select(
        "rule_id", "model", F.round(CL.confidence(F.col("text")) * 100).cast("int").alias("percent")
    )


_ANSWERED = f"""{_KB}, an as (select rule_id, model, {D.trim('text')} as text from ({ANSWERS_SQL}) a where {D.text('text')}),
  th as (select kb.rule_id, model, text, {_theme('base')} as kt, {_theme('text')} as mt from kb join an using (rule_id)),
  cf as (select rule_id, model, case when kt = 'infection' and mt = 'normal' then concat(model, ' 判定“正常”，与感染提示不一致')
    when kt = 'anemia' and mt = 'normal' then concat(model, ' 未提示贫血，结果需人工确认')
    when kt = 'bleeding' and mt <> 'bleeding' then concat(model, ' 未强调出血风险') end as conflict from th)"""


@query(f"with {_ANSWERED} select rule_id, model, coalesce(conflict, '') as conflict from cf")
def conflicts(spark, sf):
    kb = X.kb_conclusion(_rules(spark, sf)).select("rule_id", "kb_theme")
    answers = derive(spark, sf, ANSWERS).filter(~CL.is_blank(F.col("text")))
    both = answers.join(kb, "rule_id").withColumn("theme", CL.theme(F.col("text")))
    messages = [
        F.when(F.col("model") == m, F.array_join(CL.conflicts(F.col("kb_theme"), F.col("theme"), m), ""))
        for m in X.MODELS
    ]
    return both.select("rule_id", "model", F.coalesce(*messages).alias("conflict"))


@query(
    f"""with {_ANSWERED}, agg as (select rule_id, string_agg(conflict, '；' order by model desc) as cs, count(conflict) as n from cf group by rule_id),
    said as (select rule_id, string_agg(concat(chr(10), model, ': ', text), '' order by model desc) as lines,
      string_agg(concat(',', {_score('text')}), '' order by model desc) as scores from an group by rule_id)
    select rule_id, row_idx, concat('Heuristic: 知识库：', base, coalesce(lines, '')) as summary,
      case when coalesce(n, 0) > 0 then concat('检测到 ', n, ' 个冲突，请人工复核（', cs, '）。') else advice end as recommendation,
      concat(cast(score * 100 as int), coalesce(scores, '')) as scores, coalesce(n, 0) as n_conflicts
    from kb left join agg using (rule_id) left join said using (rule_id)"""
)
def cross_check(spark, sf):
    checked = X.cross_check(_rules(spark, sf), answers=derive(spark, sf, ANSWERS))
    scores = F.transform("conclusions", lambda c: F.round(c["confidence"] * 100).cast("int").cast("string"))
    return checked.select(
        "rule_id",
        "row_idx",
        "summary",
        "recommendation",
        F.array_join(scores, ",").alias("scores"),
        F.size("conflicts").alias("n_conflicts"),
    )


@query(f"with {_KB} select rule_id, row_idx, advice as recommendation from kb order by row_idx limit 5")
def finding_samples(spark, sf):
    """The report's first five findings."""
    found = X.first_findings(X.cross_check(_rules(spark, sf)), 5)
    return found.select("rule_id", "row_idx", "recommendation")


@query(
    f"""with {_KB} select rule_id, row_idx, concat('- 组合描述：', coalesce(nullif(description, ''), '未提供'), chr(10), '- 已有解读：',
    coalesce(nullif(explanation, ''), '暂无'), chr(10), '- 模板参考：', coalesce(template, '无')) as prompt from kb"""
)
def prompt_rows(spark, sf):
    return X.prompt_rows(_rules(spark, sf))


# --- indicator sheet ---

WHITE, SICKLE = E.WHITE_V2, E.SICKLE_V2
OWN_WHITE, OWN_SICKLE = LB.profile("v2")
COLUMNS = {
    "white": ["awbc", "awbc_prompt", "awbc_basis"],
    "sickle": ["srbc"],
    "summary1": "summary1",
    "diseases": [f"disease{i}_{f}" for i in (1, 2, 3) for f in ("name", "prob", "analysis")],
}


@query(
    f"""select row_idx, case when awbc = '↑' and trim(awbc_prompt) = '' then {D.q(WHITE['prompt'])} else awbc_prompt end as awbc_prompt,
    case when awbc = '↑' then {D.q(WHITE['basis'])} else '' end as awbc_basis from ({SHEET_SQL}) s"""
)
def fill_prompt(spark, sf):
    filled = U.fill_prompt(derive(spark, sf, SHEET), COLUMNS["white"], OWN_WHITE)
    return filled.select("row_idx", "awbc_prompt", "awbc_basis")


def _tidy(c: str) -> str:
    return f"replace(replace({c}, '。；', '；'), '；；', '；')"


def _prefixed(c: str, prefix: str, words: list[str], sep: str = "；") -> str:
    has = " or ".join(f"contains({c}, {D.q(w)})" for w in words)
    return f"case when {has} then {c} when {c} = '' then {D.q(prefix)} else {_tidy(f'concat({D.q(prefix + sep)}, {c})')} end"


@query(
    f"""select row_idx, {_prefixed('summary1', WHITE['short'], WHITE['disease']['keywords'])} as short,
    {_prefixed('summary1', SICKLE['interpretation'], SICKLE['disease']['keywords'], ' ')} as interpretation from ({SHEET_SQL}) s"""
)
def prefix_text(spark, sf):
    c = F.col("summary1")
    return derive(spark, sf, SHEET).select(
        "row_idx",
        ST.prefix_text(c, OWN_WHITE["short"], OWN_WHITE["disease"]["keywords"], "；").alias("short"),
        ST.prefix_text(c, OWN_SICKLE["interpretation"], OWN_SICKLE["disease"]["keywords"], " ").alias("interpretation"),
    )


_SLOT_COLUMNS = [f"disease{i}_{f}" for i in (1, 2, 3) for f in ("name", "prob", "analysis")]


def _appended(tail: str, extra: str) -> str:
    return f"case when {extra} = '' then {tail} when {tail} = '' then {extra} else {_tidy(f'concat({tail}, {D.q('；')}, {extra})')} end"


def _insert_sql(src: str, config: dict, raised: str) -> str:
    """Select over ``src`` with the nine slot columns after an insert where ``raised``."""
    d = {f: D.q(config[k]) for f, k in (("name", "name"), ("prob", "probability"), ("analysis", "analysis"))}
    present = " or ".join(f"contains(disease{i}_name, {D.q(w)})" for i in (1, 2, 3) for w in config["keywords"])
    go = f"({raised}) and not ({present})"
    out = []
    for i in (1, 2, 3):
        for f in ("name", "prob", "analysis"):
            c = f"disease{i}_{f}"
            if config["priority"] == 1:
                new = d[f] if i == 1 else f"disease{i - 1}_{f}"
                if (i, f) == (3, "analysis"):
                    new = _appended("disease2_analysis", "disease3_analysis")
            else:
                taken = " and ".join(f"trim(disease{j}_name) <> ''" for j in range(1, i)) or "true"
                new = f"case when {taken} and trim({c[:8]}_name) = '' then {d[f]} else {c} end"
                if (i, f) == (3, "analysis"):
                    full = " and ".join(f"trim(disease{j}_name) <> ''" for j in (1, 2, 3))
                    new = f"case when {full} then {_appended(c, d[f])} else {new} end"
            out.append(f"case when {go} then {new} else {c} end as {c}")
    return f"select * replace ({', '.join(out)}) from ({src}) i"


def _slot_text(cols: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(cols) + ")"


@query(
    f"""with w as ({_insert_sql(SHEET_SQL, WHITE['disease'], 'true')}), k as ({_insert_sql(SHEET_SQL, SICKLE['disease'], 'true')})
    select 'white' as finding, row_idx, {_slot_text(_SLOT_COLUMNS)} as slots from w
    union all select 'sickle', row_idx, {_slot_text(_SLOT_COLUMNS)} from k"""
)
def insert_disease(spark, sf):
    sheet = derive(spark, sf, SHEET)
    slots = U._slots(_SLOT_COLUMNS)

    def after(name, config):
        filled = ST.insert_disease(slots, config["disease"])
        flat = F.flatten(F.transform(filled, lambda s: F.array(s["name"], s["probability"], s["analysis"])))
        return sheet.select(F.lit(name).alias("finding"), "row_idx", F.array_join(flat, "|").alias("slots"))

    return after("white", OWN_WHITE).unionByName(after("sickle", OWN_SICKLE))


@query(f"select row_idx, {_tidy('concat(summary1, disease1_analysis, chr(65307), chr(65307), note_en)')} as text from ({SHEET_SQL}) s")
def cleanup_punct(spark, sf):
    joined = F.concat("summary1", "disease1_analysis", F.lit("；；"), "note_en")
    return derive(spark, sf, SHEET).select("row_idx", ST.cleanup_punct(joined).alias("text"))


def _english(c: str) -> str:
    for pattern, new in (
        (r"(?i)\bHematology System abnormalities\b", "hematological abnormalities"),
        (r"(?i)\banti[- ]?metabolic\b", "antimetabolite"),
        (r"(?i)\batypical granulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
        (r"(?i)\bimmature granulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
        (r"(?i)\bgranulocytes\s*\(ALY#\)", "atypical lymphocytes (ALY#)"),
        (r"(?i)\be\s*\.\s*g\s*\.\s*,", "e.g.,"),
        (r"(?i)\be\s*\.\s*g\s*\.\b", "e.g."),
    ):
        c = D.sub(c, pattern, new)
    return c


@query(f"select row_idx, {_english('note_en')} as note_en from ({SHEET_SQL}) s")
def cleanup_english(spark, sf):
    return derive(spark, sf, SHEET).select("row_idx", ST.cleanup_english(F.col("note_en")).alias("note_en"))


def _qualified(c: str) -> str:
    kind = "(?:abnormal|atypical|unclassified|immature|degenerated|reactive|early)"
    cells = r"(?:granulocytes?|white\s+blood\s+cells?|wbc(?:s)?|monocytes?|nucleated\s+cells?|cells?|components?)"
    kinds = rf"{kind}(?:\s+{kind})*\s+"
    s = c
    for pattern, new in (
        (rf"(?i)\b(ALY#?)\s*\(\s*{kinds}{cells}\s*\)", r"\1 (atypical lymphocytes)"),
        (rf"(?i)\b(ALY#?)\s*\(\s*{cells}\s*\)", r"\1 (atypical lymphocytes)"),
        (rf"(?i)\b{kinds}{cells}\s*\(\s*(ALY#?)\s*\)", r"atypical lymphocytes (\1)"),
        (rf"(?i)\b{cells}\s*\(\s*(ALY#?)\s*\)", r"atypical lymphocytes (\1)"),
    ):
        s = D.sub(s, pattern, new)
    return f"case when contains(upper({c}), 'ALY') then {s} else {c} end"


@query(f"select row_idx, {_qualified('note_en')} as note_en from ({SHEET_SQL}) s")
def fix_qualifier(spark, sf):
    return derive(spark, sf, SHEET).select("row_idx", ST.fix_qualifier(F.col("note_en")).alias("note_en"))


def _updated_sql() -> str:
    """White cells, then sickle cells on the result, from row 1; then both text cleanups."""
    white = "awbc = '↑' and row_idx >= 1"
    sickle = "srbc = '↑' and row_idx >= 1"
    one = f"""select * replace (
      case when {white} and trim(awbc_prompt) = '' then {D.q(WHITE['prompt'])} else awbc_prompt end as awbc_prompt,
      case when {white} then {D.q(WHITE['basis'])} else awbc_basis end as awbc_basis,
      case when {white} then {_prefixed('summary1', WHITE['prompt'], WHITE['disease']['keywords'])} else summary1 end as summary1)
      from ({SHEET_SQL}) a"""
    two = _insert_sql(one, WHITE["disease"], white)
    three = f"""select * replace (case when {sickle} then {_prefixed('summary1', SICKLE['prompt'], SICKLE['disease']['keywords'])} else summary1 end as summary1) from ({two}) b"""
    four = _insert_sql(three, SICKLE["disease"], sickle)
    return f"select * replace ({_qualified('note_en')} as note_en) from (select * replace ({_english('note_en')} as note_en) from ({four}) c) d"


@query(
    f"""with u as ({_updated_sql()}) select row_idx, awbc, awbc_prompt, awbc_basis, srbc, summary1,
    {_slot_text(_SLOT_COLUMNS)} as slots, note_en from u"""
)
def update_sheet(spark, sf):
    out = U.update_sheet(derive(spark, sf, SHEET), "v2", U.STEPS, COLUMNS)
    return out.select(
        "row_idx", "awbc", "awbc_prompt", "awbc_basis", "srbc", "summary1",
        F.concat_ws("|", *_SLOT_COLUMNS).alias("slots"), "note_en",
    )


# All column groups, under the headers by which a sheet is recognised.
FULL_SHEET = f"""
select row_idx, awbc, awbc_prompt, case when row_idx % 8 = 0 then '旧' else '' end as awbc_basis, srbc,
       case when row_idx % 9 = 0 then '旧' else ' ' end as srbc_prompt, '' as srbc_basis, summary1,
       case row_idx % 4 when 0 then '' when 1 then '镰刀型待查' when 2 then '说明。' else 'AWBC见上' end as summary2,
       case row_idx % 3 when 0 then '' when 1 then '异常白细胞已述' else '其他' end as interpretation,
       {", ".join(f"disease{i}_{f}" for i in (1, 2, 3) for f in ("name", "prob", "analysis"))}, note_en
from ({SHEET}) sheet
"""
HEADERS = {
    "awbc": "AWBC#", "awbc_prompt": "提示A", "awbc_basis": "依据A", "srbc": "SRBC#", "srbc_prompt": "提示S",
    "srbc_basis": "依据S", "summary1": "总结1", "summary2": "总结2", "interpretation": "解读", "disease1_name": "可能疾病1",
}
FULL_COLUMNS = ["awbc_prompt", "awbc_basis", "srbc_prompt", "srbc_basis", "summary1", "summary2", "interpretation"]


def _fully_updated(white: dict, sickle: dict) -> str:
    """One indicator after the other over all column groups, from row 1."""
    src = duck(FULL_SHEET)
    for config, mark, prompt, basis in (
        (white, "awbc", "awbc_prompt", "awbc_basis"), (sickle, "srbc", "srbc_prompt", "srbc_basis"),
    ):
        raised, words = f"{mark} = '↑' and row_idx >= 1", config["disease"]["keywords"]
        src = f"""select * replace (
          case when {raised} and trim({prompt}) = '' then {D.q(config['prompt'])} else {prompt} end as {prompt},
          case when {raised} and trim({basis}) = '' then {D.q(config['basis'])} else {basis} end as {basis},
          case when {raised} then {_prefixed('summary1', config['prompt'], words)} else summary1 end as summary1,
          case when {raised} then {_prefixed('summary2', config['short'], words)} else summary2 end as summary2,
          case when {raised} then {_prefixed('interpretation', config['interpretation'], words, ' ')} else interpretation end as interpretation)
          from ({src}) f"""
        src = _insert_sql(src, config["disease"], raised)
    return f"select row_idx, {', '.join(FULL_COLUMNS)}, {_slot_text(_SLOT_COLUMNS)} as slots from ({src}) u"


def _by_header(spark, sf, profile):
    sheet = derive(spark, sf, FULL_SHEET).withColumnsRenamed(HEADERS)
    out = U.update_sheet(sheet, profile).withColumnsRenamed({v: k for k, v in HEADERS.items()})
    return out.select("row_idx", *FULL_COLUMNS, F.concat_ws("|", *_SLOT_COLUMNS).alias("slots"))


@query(_fully_updated(E.WHITE_V1, E.SICKLE_V1))
def update_sheet_v1(spark, sf):
    """Profile v1; columns are found by their headers."""
    return _by_header(spark, sf, "v1")


@query(_fully_updated(E.WHITE_V2, E.SICKLE_V2))
def update_sheet_v2(spark, sf):
    """Profile v2; columns are found by their headers."""
    return _by_header(spark, sf, "v2")


@query(
    f"""with u as ({_updated_sql()}), s as ({SHEET_SQL})
    select row_idx, 'note_en' as col_key, s.note_en as original, u.note_en as translated from s join u using (row_idx) where s.note_en <> u.note_en
    union all select row_idx, 'disease3_name', s.disease3_name, u.disease3_name from s join u using (row_idx) where s.disease3_name <> u.disease3_name"""
)
def change_audit(spark, sf):
    """The third name and the note are left out of the allowed columns, so their changes show."""
    before = derive(spark, sf, SHEET)
    after = U.update_sheet(before, "v2", U.STEPS, COLUMNS)
    allowed = [*COLUMNS["white"], "summary1", *[c for c in _SLOT_COLUMNS if c != "disease3_name"]]
    return U.change_audit(before, after, allowed, [c for c in before.columns if c != "row_idx"])
