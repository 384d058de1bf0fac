"""Glossaries and rule libraries as tables."""

import random

from pyspark.sql import functions as F

from sheetqa.functions.glossary import GLOSSARY, enforce_glossary
from sheetqa.functions.library import TEMPLATES
from sheetqa.operators import rules as R
from sheetqa.operators import terms as TM

ENTRY = "entry_no long, keywords array<string>, preferred string, variants array<string>"


def test_contained_terms_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abA白血😀 ") for _ in range(rng.randrange(12))) for _ in range(150)] + [None, "", "aaaa"]
    terms = ["".join(rng.choice("abA白血😀 ") for _ in range(rng.randrange(6))) for _ in range(150)] + [None, "", "aaaa", "ab", "ab"]
    left = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    right = spark.createDataFrame([*enumerate(terms)], "no int, term string")
    got = sorted((r.id, r.no) for r in TM.contained_terms(left, ["id"], "text", right).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(terms) if t and w and w in t)


def test_a_large_glossary_equals_the_compiled_one(spark):
    rng = random.Random(2)
    words = [w for e in GLOSSARY for w in (*e.keywords, *e.variants, e.preferred)]
    rows = []
    for i in range(120):
        chosen = rng.choices(words, k=rng.randrange(4))
        text = " ".join(rng.choice([w, w.lower(), w.upper(), f"x{w}", "count"]) for w in rng.choices(words, k=rng.randrange(6)))
        rows.append((i, "、".join(chosen) if i % 7 else None, text if i % 11 else None))
    df = spark.createDataFrame(rows, "id int, original string, translated string")
    more = spark.range(50_000).select(
        (F.col("id") + 1000).alias("entry_no"), F.array(F.concat(F.lit("詞"), "id")).alias("keywords"),
        F.concat(F.lit("term "), "id").alias("preferred"), F.array(F.lit("count"), F.concat(F.lit("v"), "id")).alias("variants"),
    )
    table = TM.glossary_table(spark).unionByName(more)
    done = TM.enforce_glossary_table(df, ["id"], "original", "translated", table)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "血液" not in plan and "NestedLoop" not in done._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.t for r in df.select("id", enforce_glossary(F.col("original"), F.col("translated")).alias("t")).collect()}
    assert {r.id: r.translated for r in done.collect()} == want


def test_a_large_library_equals_the_compiled_one(spark):
    rng = random.Random(3)
    words = [a for t in TEMPLATES for i in t.indicators for a in i.aliases] + [w for t in TEMPLATES for w in t.keywords]
    rows = [
        (i, f"r{i % 50}", rng.choice(["", None, "  ", " ".join(rng.choices(words, k=rng.randrange(8)))]), " ".join(rng.choices(words, k=rng.randrange(5))))
        for i in range(200)
    ]
    rules = spark.createDataFrame(rows, "row_idx int, rule_id string, description string, explanation string").withColumn(
        "conditions", F.array().cast("array<struct<indicator:string,operator:string,value:string>>")
    )
    aliases, keywords = TM.template_tables(spark)
    more = spark.range(10_000).select(
        F.concat(F.lit("t"), "id").alias("template_id"),
        F.posexplode(F.array(F.concat(F.lit("alpha"), "id"), F.concat(F.lit("beta"), "id"))).alias("item", "alias"),
    )
    out = TM.template_matches_table(rules, aliases.unionByName(more), keywords)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.rule_id, r.row_idx, r.template_id) for r in out.collect())
    want = sorted((r.rule_id, r.row_idx, r.template_id) for r in R.template_matches(rules).collect())
    assert got == want and want


def test_terms_are_never_sent_to_the_driver(spark):
    """A table of terms may be of any size, whatever its files' size."""
    texts = spark.createDataFrame([(1, "白细胞升高", "white blood cell"), (2, "x", "y")], "id int, original string, translated string")
    table = TM.glossary_table(spark)
    plans = [
        TM.enforce_glossary_table(texts, ["id"], "original", "translated", table),
        TM.contained_terms(texts, ["id"], "original", table.select(F.explode("keywords").alias("term"))),
    ]
    rules = texts.select(F.col("id").alias("row_idx"), F.lit("r").alias("rule_id"), F.col("original").alias("description"), F.lit("").alias("explanation"))
    plans.append(TM.template_matches_table(rules, *TM.template_tables(spark)))
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_common_alias_meets_only_templates_that_can_match(spark):
    """An alias of all rules in thousands of templates, each with an item that no rule has."""
    rules = spark.range(2000).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("r"), "id").alias("rule_id"), F.concat(F.lit("wbc high "), "id").alias("description"), F.lit("").alias("explanation")
    )
    never = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("template_id"), F.posexplode(F.array(F.lit("WBC"), F.concat(F.lit("none "), "id"))).alias("item", "alias"))
    one = spark.createDataFrame([("real", 0, "WBC"), ("real", 1, "high 7")], "template_id string, item int, alias string")
    words = spark.createDataFrame([("real", "HIGH")], "template_id string, word string")
    out = TM.template_matches_table(rules, never.unionByName(one), words)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r.row_idx for r in rows) == [i for i in range(2000) if str(i).startswith("7")] and {r.template_id for r in rows} == {"real"}
