"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetqa.llm import mixing, personal_data, positive_unlabelled, sentencepiece_bpe, simhash
from sheetqa.llm.common import documents, hash_filter, labels, long_hashes, may_be_among
from sheetqa.llm.queries import tokenizer_path
from sheetqa.store import written

#: Rows that go to a Python worker at once: texts may be long, and workers share an executor's memory.
ROWS_AT_ONCE = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose session hands Python workers few rows at a time."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good ones; the others go."""
    judged = positive_unlabelled.classify(docs, labels(spark, sf_dir), carry=REST)
    return judged.where("predicted = 1").select(*COLUMNS)


@bounded
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts alike in five-word shingles the row with the smallest id.

    Rows without id come last; of rows that share the id the first by a hash of the row stays.
    Rows are told apart by 128 bits of all columns, NULLs included. A row whose hash cannot be
    among those of classes with several rows stays where it is; only the others meet their verdict.
    """
    names = [c.alias(n) for c, n in zip(long_hashes(*map(F.col, COLUMNS)), ("r0", "r1"))]
    classed = simhash.similar_documents(docs, carry=names)
    rows = classed.groupBy("root", "r0", "r1").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    first = F.struct(F.isnull("doc_id"), "doc_id", "r0", "r1")
    classes = rows.groupBy("root").agg(F.min(first).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    stays = (F.col("first.r0") == F.col("r0")) & (F.col("first.r1") == F.col("r1"))
    judged = written(rows.join(classes, "root").select("r0", "r1", "copies", stays.alias("stays")), "copies")
    named = docs.select(*COLUMNS, *names)
    among = may_be_among(F.col("r0"), hash_filter(judged.select("r0")).scalar())
    met = named.where(among).join(judged, ["r0", "r1"], "left").where("stays is null or stays")
    again = F.coalesce(F.col("stays") & (F.col("copies") > 1), F.lit(False))
    return (
        named.where(~among).select(*COLUMNS)
        .union(met.where(~again).select(*COLUMNS))
        .union(met.where(again).select(*COLUMNS).distinct())
    )


@bounded
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    found = personal_data.all_spans(docs, carry=REST)
    text = personal_data.redacted(F.col("text"), F.col("spans"))
    clean = found.select("doc_id", text.alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@bounded
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them, partial ones cut."""
    mix = mixing.repeated(mixing.mix_documents(docs, carry=REST))
    return mix.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@bounded
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to."""
    coded = sentencepiece_bpe.round_trip(F.col("text"), tokenizer_path(), with_ids=True)
    return docs.select("doc_id", "source", coded.alias("coded")).select("doc_id", "source", "coded.*")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

# The classifier's fit and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
