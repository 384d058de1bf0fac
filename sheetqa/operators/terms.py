"""Glossaries and rule libraries given as tables, of any number of terms.

Which of many terms are contained in which of many texts is a join on a term's first characters:
a text meets the terms that begin with one of its own character runs, and what meets is then
held against the whole text. No term becomes part of a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glossary import GLOSSARY, GlossaryEntry, rewrite_terms
from ..functions.library import TEMPLATES, Template
from ..functions.text import B_END, B_START
from ..store import written
from .rules import active, rule_keys, rule_text

#: First characters of a term by which it meets a text.
HEAD = 3


def contained_terms(texts: DataFrame, by: Sequence[str], text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """``by…`` and all columns of ``terms``: each row of ``terms`` whose ``term`` stands in the row's ``text``.

    Case counts. NULL and empty terms are contained in nothing here, NULL texts contain nothing.
    Every ``by`` names one row of ``texts``. A text meets a head once, however often it has it. Terms are
    shuffled like texts, never sent to the driver: their number is not known from their files' size.
    """
    by = list(by)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.lit([*range(1, HEAD + 1)]), lambda n: F.substring(text, i, n))))
    heads = texts.where(F.col(text).isNotNull()).select(*by, F.col(text).alias("_text"), F.explode(F.array_distinct(runs)).alias("_head"))
    keyed = terms.where(F.length(term) > 0).withColumn("_head", F.substring(term, 1, HEAD))
    return heads.join(keyed.hint("merge"), "_head").where(F.col("_text").contains(F.col(term))).drop("_head", "_text")


# --- glossary ---


def glossary_table(spark: SparkSession, glossary: Sequence[GlossaryEntry] = GLOSSARY) -> DataFrame:
    """A glossary as ``entry_no, keywords, preferred, variants``."""
    rows = [(i, list(e.keywords), e.preferred, list(e.variants)) for i, e in enumerate(glossary)]
    return spark.createDataFrame(rows, "entry_no long, keywords array<string>, preferred string, variants array<string>")


def _spellings(words: Column) -> Column:
    """Distinct spellings whatever their case, the first of each, as ``neg, low, pattern``."""
    lows = F.transform(words, lambda w: F.lower(w))
    firsts = F.filter(words, lambda w, i: F.array_position(lows, F.lower(w)) == i + 1)

    def one(w: Column) -> Column:
        escaped = F.regexp_replace(w, r"([-/\\^$*+?.()|\[\]{}])", r"\\$1")
        bounded = F.concat(F.lit(B_START), escaped, F.lit(B_END))
        return F.struct(
            (-F.length(w)).alias("neg"),
            F.lower(w).alias("low"),
            F.when(w.rlike("^[A-Za-z0-9 ]+$"), bounded).otherwise(escaped).alias("pattern"),
        )

    return F.transform(firsts, one)


def enforce_glossary_table(
    df: DataFrame, by: Sequence[str], original: str, translated: str, glossary: DataFrame
) -> DataFrame:
    """``df`` with the variants in ``translated`` normalised for every entry of ``glossary`` that fires.

    Equal to ``enforce_glossary`` for a glossary in a table (``glossary_table``). ``by`` names each row
    of ``df``; entries count in order of ``entry_no``. An entry fires if one of its keywords is in
    ``original``. Rows where none fires stay as they are; of the others only the fired entries, with
    spellings that are in the text at all, become part of the row's expression.
    """
    by = list(by)
    words = F.filter(
        F.concat("keywords", F.coalesce("variants", F.array().cast("array<string>")), F.array("preferred")),
        lambda w: F.coalesce(w != "", F.lit(False)),
    )
    entries = glossary.select("entry_no", "keywords", "preferred", _spellings(words).alias("variants"))
    keywords = entries.select("entry_no", F.explode("keywords").alias("term"))
    fired = contained_terms(df.select(*by, original), by, original, keywords).select(*by, "entry_no").distinct()
    entry = F.struct("entry_no", "preferred", "variants")
    per_row = fired.join(entries.drop("keywords").hint("merge"), "entry_no").groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_fired"))
    joined = df.join(per_row.hint("merge"), by, "left")
    changed = rewrite_terms(F.col(translated), F.col("_fired"))
    enforced = F.when(F.col("_fired").isNull() | F.col(translated).isNull(), F.col(translated)).otherwise(changed)
    return joined.withColumn(translated, enforced).drop("_fired")


# --- rule library ---


def template_tables(spark: SparkSession, templates: Sequence[Template] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Active templates as ``(template_id, item, alias)`` and ``(template_id, word)``; ``item`` counts the indicators."""
    aliases = [(t.template_id, i, a) for t in active(templates) for i, item in enumerate(t.indicators) for a in item.aliases]
    words = [(t.template_id, w) for t in active(templates) for w in t.keywords]
    return (
        spark.createDataFrame(aliases, "template_id string, item int, alias string"),
        spark.createDataFrame(words, "template_id string, word string"),
    )


def template_matches_table(rules: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pairs ``(rule keys, template_id)`` of rules and the templates of two tables that they cover.

    Relational division: a rule covers a template if it has an alias of every indicator that
    ``aliases`` lists for it, counted as distinct ``item``; and one of its keywords, if it has any. Equal to
    ``template_matches`` for a library as ``template_tables`` gives it. Indicators need an alias.

    A common alias may be in many templates and in many rules. Texts and terms are therefore matched
    as distinct texts and distinct terms first; only templates of which every item is met somewhere
    in the rules, and only these templates' terms, meet the texts again.
    """
    keys = rule_keys(rules)
    texts = rules.select(*keys, rule_text().alias("_rule")).distinct()
    terms = aliases.select("template_id", "item", F.lower("alias").alias("term")).unionByName(
        keywords.select("template_id", F.lit(-1).alias("item"), F.lower("word").alias("term"))
    )
    words = terms.select("term").distinct()
    # One index for aliases and keywords; a keyword is an item of its own, met by any of them.
    met = written(contained_terms(texts.select("_rule").distinct(), ["_rule"], "_rule", words), "met-terms")
    items = terms.select("template_id", "item").distinct()
    needed = items.groupBy("template_id").agg(F.count(F.lit(1)).alias("needed"))
    live = terms.join(met.select("term").distinct().hint("merge"), "term", "left_semi").distinct()
    possible = (
        live.select("template_id", "item").distinct().groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
        .join(needed.hint("merge"), "template_id").where("n = needed").select("template_id", "needed")
    )
    known = live.join(possible.hint("merge"), "template_id")
    found = (
        met.join(known.hint("merge"), "term").select("_rule", "template_id", "item", "needed").distinct()
        .groupBy("_rule", "template_id", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
    )
    return texts.join(found.hint("merge"), "_rule").select(*keys, "template_id")
