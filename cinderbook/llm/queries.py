"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbook.llm import bpe, cws, langid, linededup, mixing, neardup, packing, pii, quality, sharding, sql, vectorcodes, whitening, wordpiece
from cinderbook.llm.common import documents, saved

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = (1.0,) * 8
ENTROPY = 0.95  # of the largest possible
MAX_REPEATS = 2.0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every document."""
    starts, goes_on = wordpiece.vocabulary(TOKENIZER)
    counted = wordpiece.token_counts(documents(spark, sf_dir).select("doc_id", "text"), "text", starts, goes_on)
    return counted.drop("text")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base kinds, and all spans with those that bootstrapping adds."""
    found = pii.spans_of(documents(spark, sf_dir), "text", "doc_id")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *map(n, pii.KINDS),
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stand earlier in the table."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.without_repeats(docs, "text", "doc_id").select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training run of as many tokens as there are, its sources flattened to an entropy of 95 % of the largest."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    mixed = mixing.mixed(docs, "text", "doc_id", "source", entropy=ENTROPY, whole_corpus=True)
    return mixed.select("doc_id", "source", "epoch", "block", F.round("at", 9).alias("at"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    langs, logs = langid.learn(langid.training_rows(docs.where(~held_out), "text", "lang"))
    asked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.predict(asked, "text", langs, logs).drop("text")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.judged(docs, "text", "doc_id", trusted_ids(spark, sf_dir)).drop("text")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), "text", TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-copies every document belongs to."""
    return neardup.linked(documents(spark, sf_dir), "text", "doc_id").withColumnRenamed("id", "doc_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards by rendezvous hashing of doc_id, and where a ninth would take rows from them."""
    docs = documents(spark, sf_dir)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    rows = rows.withColumn("law", F.lit("key")).withColumn("shard", sharding.shard_of(F.col("doc_id"), SHARDS))
    rows = rows.withColumn("grown_shard", sharding.shard_of(F.col("doc_id"), (*SHARDS, 1.0)))
    rows = rows.withColumn("place", F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string"))))
    return sharding.with_slots(rows, "shard", "place").drop("place")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = cws.fingerprints(documents(spark, sf_dir), "text", "doc_id")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        cws.as_text(F.col("signature")).alias("fingerprint"),
        cws.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        cws.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        cws.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its table's four leading components."""
    return whitening.whitened(embeddings(spark, sf_dir).select("vec_id", "embedding"), "embedding")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row for each piece."""
    pieces = packing.packed(documents(spark, sf_dir).select("doc_id", "text"), "text", WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as four bytes, with the error by vector and by label."""
    rows, books = vectorcodes.coded(embeddings(spark, sf_dir).select("vec_id", "embedding", "label"), "embedding", "vec_id")
    rows = saved(rows.drop("embedding"), "vector-codes")
    found = vectorcodes.with_label_errors(rows, "label", "error").select("vec_id", "code", "error", "label_error")
    return found.withColumn("codebooks_sha256", F.lit(hashlib.sha256(vectorcodes.listed(books).encode()).hexdigest()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_personal_data,
        op3_line_dedup,
        op4_mixing,
        op5_language,
        op6_quality,
        op7_bpe,
        op8_near_duplicates,
        op9_sharding,
        op10_fingerprints,
        op11_whitening,
        op12_packing,
        op13_vector_codes,
    )
}
SQL: dict[str, str] = dict(sql.SQL)
