"""From raw documents to packed training sequences: quality, rules, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read as the next
stage's documents. The first four return the columns of their input; the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from rallyframe.llm.common import table, written

#: Documents that share so many of 100 runs of five words are near duplicates here; op10 has a limit of its own.
NEAR = 80


def free_name(docs: DataFrame, name: str) -> str:
    """The name, longer if a column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def without(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Documents that are not among `rows` (doc_id, `key`: a hash of the text)."""
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(rows["doc_id"]) & (keyed[key] == rows[key])
    return keyed.join(rows, same, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade is high enough. Null or empty text is scored as such, a text of any
    length whole; an empty table gives no rows. Further columns pass through, whatever their names (so in all stages but the last)."""
    return quality_classifier.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and are not depleted by their hosts' boilerplate, without its lines. Null or empty
    text fails the rules; null source is a host of its own; texts of any length; an empty table gives no rows."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at NEAR of 100: that of the smallest doc_id; of repeated rows the first stays. Documents
    without a word, and rows without a doc_id, are alike to none and stay. Texts of any length are compared whole. An empty table gives no rows."""
    key = free_name(docs, "_text_key")
    gone = written(near_dedup.cluster(docs, NEAR).where("not kept").select("doc_id").distinct(), "near-duplicates")
    keyed = docs.join(gone, "doc_id", "left_anti").withColumn(key, F.xxhash64("text"))
    again = keyed.where("doc_id is not null").groupBy("doc_id", key).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", key)
    again = written(again, "repeated-rows")
    once = keyed.join(again, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(docs.columns)
    return without(docs.join(gone, "doc_id", "left_anti"), again, key).unionByName(once)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mixture takes. Null source: a source of its own; null text: size 0. Rows without a doc_id
    are mixed like others; a text of any length has the size of its words; an empty table gives no rows."""
    return mixing.emit(mixing.mix(docs)).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. Null or empty text: one piece of one token; long texts: several pieces; further
    columns are not looked at; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: Regression, sketches and tokenizers are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
