"""The corpus pipeline: five stages over the documents table, each written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbook.llm import bpe, linededup, mixing, neardup, quality
from cinderbook.llm.common import documents, saved
from cinderbook.llm.queries import MAX_REPEATS, TOKENIZER, trusted_ids

NEAR = 80  # percent
LONG_LINE = 50  # words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the likelihood ratio."""
    return quality.passing(docs, "text", "doc_id", trusted_ids(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines, and lines of LONG_LINE words, that stand earlier; one of which no line is left
    goes, n_chars follows the text."""
    cut = linededup.without_repeats(docs, "text", "doc_id", long_words=LONG_LINE)
    return cut.where((F.col("n_removed") == 0) | (F.col("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each group of near-copies (similarity NEAR percent or more)."""
    linked = neardup.linked(docs, "text", "doc_id", NEAR)
    gone = linked.where("NOT kept").select(F.col("id").alias("__id"))
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources more than once, up to MAX_REPEATS times."""
    return mixing.mixed(docs, "text", "doc_id", "source", max_repeats=MAX_REPEATS).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    decoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), "text", TOKENIZER)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


# Sketches, hashes and vocabulary merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
