"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    filter_audit,
    hash_tree,
    lexical_search,
    license_scan,
    mixing,
    ngram_ratio,
    personal_data,
    positive_unlabelled,
    revisits,
    sentencepiece_bpe,
    simhash,
    spotsigs,
    subword_toxicity,
)
from .common import documents, labels

SHARDS = 40


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, and where they go with one shard more."""
    return hash_tree.shard_documents(
        documents(spark, sf_dir), hash_tree.shard_tree(SHARDS), hash_tree.shard_tree(SHARDS + 1)
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return spotsigs.fingerprint_documents(documents(spark, sf_dir))


def op3_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixing.mix_documents(documents(spark, sf_dir)).drop("source")


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, from trusted and unlabelled texts."""
    return positive_unlabelled.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the quality rules, and which documents are kept."""
    return ngram_ratio.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    return subword_toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each not-modified revisit of the given pages stands for."""
    return revisits.revisited_pages(spark, sf_dir)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: counts, digest and spans."""
    return personal_data.figures(documents(spark, sf_dir))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of each document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def tokenizer_path() -> str:
    """The public BPE model of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    coded = sentencepiece_bpe.round_trip(F.col("text"), tokenizer_path())
    return documents(spark, sf_dir).select("doc_id", coded.alias("coded")).select("doc_id", "coded.*")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, per language."""
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), items)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases in each document, and the licenses whose notices it holds."""
    return license_scan.scan(documents(spark, sf_dir))


OP3_SQL = r"""
with sized as (
  select doc_id, source, text,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sized group by source),
-- In order of cap per weight, the first level that caps all sources before it and no other.
steps as (
  select source_size * 3 as cap, weight, source_size * 3.0 / weight as ratio,
         sum(weight) over w as weight_left, coalesce(sum(source_size * 3) over before, 0) as capped
  from sources
  window w as (order by source_size * 3.0 / weight, source nulls last rows between current row and unbounded following),
         before as (order by source_size * 3.0 / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select max(((select sum(size) from sized) - capped)::double / weight_left::double) as level
  from steps where ((select sum(size) from sized) - capped)::double / weight_left::double <= ratio),
targets as (
  select source, source_size,
         least((source_size * 3)::double, weight * (select level from level)) as target from sources),
placed as (
  select doc_id, size, s.source, source_size, target,
         case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
         coalesce(sum(size) over (partition by s.source order by md5(concat('20240501:', coalesce(doc_id::varchar, '')))
                                  rows between unbounded preceding and 1 preceding), 0) as before_
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - before_)) as bigint) as taken
from placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree,
        op2_spotsigs,
        op3_water_filling,
        op4_positive_unlabelled,
        op5_ngram_ratio,
        op6_subword_toxicity,
        op7_revisits,
        op8_personal_data,
        op9_simhash_pivots,
        op10_sentencepiece,
        op11_filter_audit,
        op12_lexical_search,
        op13_license_scan,
    )
}
ORACLES: dict[str, str] = {
    "op3_water_filling": OP3_SQL,
    "op7_revisits": revisits.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
