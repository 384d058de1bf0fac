"""Inputs derived from the given tables by SQL that Spark and DuckDB both run.

The given tables hold no CJK text, identifiers or rules, so the sheet, rule and resource
tables are computed from all rows of ``orders``.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

CELLS = """
select o_orderkey as row_idx,
       case when o_orderkey % 5 = 0 then 'sample_id' else 'Interpretation' end as col_key,
       case o_orderkey % 8
         when 0 then concat('白细胞升高，见BA-', o_custkey)
         when 1 then concat('BA-', o_custkey, '-X')
         when 2 then '血小板减少'
         when 3 then '血红蛋白'
         when 4 then '网织红细胞计数'
         when 5 then '↑'
         when 6 then ''
         else '葡萄糖轻度升高' end as original,
       case o_orderkey % 8
         when 0 then concat('White Blood Cell elevated, see BA-', o_custkey)
         when 1 then case when o_custkey % 3 = 0 then concat('ba-', o_custkey, '-x') else concat('BA-', o_custkey, '-X') end
         when 2 then 'Platelet decreased , see  note'
         when 3 then '血红蛋白'
         when 4 then '__TKN_0__ Reticulocyte count'
         when 5 then '↑'
         when 6 then ''
         else 'el aumento de la glucosa con leve' end as translated
from orders
"""

RULES = """
select o_orderkey as row_idx,
       concat('r', o_orderkey) as rule_id,
       concat(case o_custkey % 4 when 0 then 'WBC' when 1 then 'PLT' when 2 then 'LYM' else 'EOS' end,
              case o_orderkey % 3 when 0 then '↑' when 1 then '↓' else '' end,
              '、',
              case o_custkey % 4 when 0 then 'NEU ' when 1 then 'HGB ' when 2 then 'RBC ' else 'HCT ' end,
              case o_orderkey % 3 when 0 then '高' when 1 then '低' else '正常' end) as description,
       case o_orderkey % 6
         when 0 then '提示细菌感染，建议复查'
         when 1 then '严重出血风险'
         when 2 then '可能贫血，需关注'
         when 3 then 'Suspect viral infection'
         when 4 then '未见异常，正常'
         else '' end as explanation
from orders
"""

SHEET = """
select o_orderkey as row_idx,
       case when o_custkey % 3 = 0 then '↑' else '-' end as awbc,
       case when o_orderkey % 4 = 0 then '已有提示' else '' end as awbc_prompt,
       '' as awbc_basis,
       case when o_custkey % 7 = 0 then '↑' else '-' end as srbc,
       case o_orderkey % 5 when 0 then '' when 1 then '无明显异常。' when 2 then 'AWBC偏高' else '轻度炎症。' end as summary1,
       case when o_orderkey % 2 = 0 then '感染' else '' end as disease1_name,
       case when o_orderkey % 2 = 0 then '较高' else '' end as disease1_prob,
       case when o_orderkey % 2 = 0 then '需复查。' else '' end as disease1_analysis,
       case when o_orderkey % 6 = 0 then '贫血' else '' end as disease2_name,
       case when o_orderkey % 6 = 0 then '中等' else '' end as disease2_prob,
       case when o_orderkey % 6 = 0 then '查铁' else '' end as disease2_analysis,
       case when o_orderkey % 12 = 0 then '镰刀型贫血' when o_orderkey % 18 = 0 then '骨髓瘤' else '' end as disease3_name,
       case when o_orderkey % 12 = 0 or o_orderkey % 18 = 0 then '低' else '' end as disease3_prob,
       case when o_orderkey % 12 = 0 or o_orderkey % 18 = 0 then '电泳' else '' end as disease3_analysis,
       case o_orderkey % 3 when 0 then 'ALY# (atypical granulocytes)' when 1 then 'immature granulocytes (ALY#)' else 'anti-metabolic drugs, e . g . , x' end as note_en
from orders
"""

LINES = """
select o_orderkey as line_no,
       case o_orderkey % 4
         when 0 then concat('<string name="k', o_orderkey, '">共%1$s条 START</string>')
         when 1 then concat('  <string name="k', o_orderkey, '">Login</string>')
         when 2 then '<!-- 注释 -->'
         else '' end as line
from orders
"""

RESPONSES = """
select cast(floor(o_orderkey / 5) as bigint) as batch_id,
       o_orderkey % 5 as seq,
       o_orderkey as row_idx,
       engine, priority,
       case when floor(o_orderkey / 5) % 6 = 0 or (floor(o_orderkey / 5) + priority) % 3 = 0
            then 'failed to parse model json' else '' end as error,
       concat('answer ', o_orderkey, ' by ', engine) as answer
from (select o_orderkey, engine, case engine when 'openrouter' then 1 when 'deepseek' then 2 else 3 end as priority
      from (select o_orderkey, explode(array('openrouter', 'deepseek', 'gemini')) as engine from orders) n) e
"""

# Status wording inside sentences and short cells.
NOTES = """
select o_orderkey as row_idx,
       concat(case o_orderkey % 10
         when 0 then 'A Decreased count of cells; check '
         when 1 then 'mild  Elevated glucose, seen in '
         when 2 then 'Elevated in the number of cells. '
         when 3 then 'There is elevated in HGB and Decreased in '
         when 4 then 'Elevated total spherocytes is high: '
         when 5 then 'An Elevated value with Elevated fever! '
         when 6 then 'Elevated in '
         when 7 then 'an decreased level or slight Decreased trend, case '
         when 8 then 'Severely elevated in a very long remark without any punctuation marks '
         else 'reElevated innate value; ' end, o_custkey) as text
from orders
"""

# Header cells; one sheet holds a third of all columns.
HEADERS = """
select case when o_orderkey % 3 = 0 then 'wide' else concat('s', o_custkey % 40) end as doc_id,
       o_orderkey as col_idx,
       case o_orderkey % 7 when 0 then '' when 1 then 'WBC' when 2 then 'WBC' when 3 then 'NEU#'
         when 4 then '总结1' else concat('H', o_orderkey % 11) end as header
from orders
"""

# Wide rows with string, number, boolean and missing cells.
WIDE = """
select o_orderkey as row_idx,
       concat('BA-', o_orderkey) as id,
       case when o_custkey % 4 = 0 then '↑' when o_custkey % 4 = 1 then null else '-' end as wbc,
       o_custkey as n,
       o_orderkey % 2 = 0 as flag,
       case o_orderkey % 3 when 0 then '白细胞升高' when 1 then '' else 'normal' end as note
from orders
"""

# Rule rows as a sheet has them: a blank Rule cell is present, a NULL one is absent.
RULE_ROWS = """
select o_orderkey as row_idx,
       case o_orderkey % 4 when 0 then '' when 1 then null else concat('c', o_custkey) end as id,
       case o_orderkey % 5 when 0 then null else o_custkey % 3 end as `编号`,
       case o_orderkey % 3 when 0 then null when 1 then '' else 'WBC↑' end as `Rule`,
       case o_custkey % 2 when 0 then 'PLT 低' else null end as `条件`,
       case o_custkey % 5 when 0 then '危急' when 1 then 'Warning' when 2 then '' else null end as `级别`,
       case o_orderkey % 6 when 0 then '严重出血' when 1 then '需关注' when 2 then null else 'stable' end as `Interpretation`
from orders
"""

# Model texts about rules: blank ones, and rules without any.
ANSWERS = """
select concat('r', o_orderkey) as rule_id, 'OpenRouter' as model,
       case o_orderkey % 5 when 0 then '正常范围' when 1 then ' 提示感染，建议复查 ' when 2 then '' when 3 then '可能出血' else 'stable, suspect nothing' end as text
from orders
union all
select concat('r', o_orderkey) as rule_id, 'Deepseek' as model,
       case o_custkey % 4 when 0 then ' ' when 1 then '无异常' when 2 then '血小板减少，should recheck' else '贫血' end as text
from orders
"""

# Raw model outputs, one per batch of five order keys; the last kind is cut off.
RAW_OUTPUTS = """
select o_orderkey as batch_id,
       case o_orderkey % 7
         when 0 then concat('```json\n[{"content":"a', o_custkey, '"},{"content":"b"}]\n```')
         when 1 then concat('[{"content"：“a', o_custkey, '"}，{"content":"b，c"}]')
         when 2 then concat('{"records":[{"content":"a', o_custkey, '"},{"content":"b"}]}')
         when 3 then concat('Here you are: [{"content":"a', o_custkey, '"},{"content":"b"}] done')
         when 4 then concat('[{"content":"a', o_custkey, '"},{"cont')
         when 5 then concat('[{"content":"a', o_custkey, '"},{"content":"[b]"}]')
         else '' end as text
from orders
"""

# Answers with repeated members, items that are no objects, and none at all.
ODD_OUTPUTS = """
select o_orderkey as batch_id,
       case o_orderkey % 6
         when 0 then concat('[{"content":"one","content":"a', o_custkey, '"}]')
         when 1 then concat('[{"content":"a', o_custkey, '"},3]')
         when 2 then concat('[{"content":"a', o_custkey, '"},null]')
         when 3 then concat('{"records":[{"content":"a', o_custkey, '"}]}')
         when 4 then '[]'
         else concat('[{"content":"x","k":"1","content":"a', o_custkey, '"},"text"]') end as text
from orders
"""

# Service bodies around the same records.
BODIES = """
select o_orderkey as batch_id,
       case o_orderkey % 6
         when 0 then concat('{"choices":[{"message":{"content":"[a', o_custkey, ']"}}]}')
         when 1 then concat('{"choices":[{"message":{"content":[{"text":"a', o_custkey, '"},{"content":"b"},{"type":"x"}]}}]}')
         when 2 then concat('{"records":[{"content":"a', o_custkey, '"}]}')
         when 3 then concat('{"engine":"gemini","data":[{"content":"a', o_custkey, '"}]}')
         when 4 then concat('{"records":null,"result":[{"content":"a', o_custkey, '"}]}')
         else concat('[{"content":"a', o_custkey, '"}]') end as body
from orders
"""

# Translated resource contents per language.
LANG_LINES = """
select lang, o_orderkey as line_no,
       case o_orderkey % 6
         when 0 then '共三条'
         when 1 then 'el aumento de la glucosa con leve'
         when 2 then '__FMT_0__ items'
         when 3 then 'the mild increase , seen in  cells'
         when 4 then 'Хорошо'
         else 'die Zunahme und der Abnahme mit T 4' end as content
from (select o_orderkey, explode(array('English', 'Spanish', 'French', 'German', 'Italian', 'Russian', 'Portuguese')) as lang
      from orders) l
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it is; the session's split size decides on the number of tasks."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts above over the table it names."""
    view = "orders_" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(sql.replace("from orders", f"from {view}"))


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"explode\(array\((.*?)\)\)", r"unnest([\1])", sql.replace("`", '"'))
