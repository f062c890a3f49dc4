"""Document fingerprints by consistent weighted sampling (built-in expressions only).

A text is a set of words weighted by how often they occur. For each of SAMPLES samples and each word, hashes of the word
give two Gamma(2, 1) variables r, c and a uniform b; with t = floor(ln(weight) / r + b) the word's value is
ln c - r (t - b) - r, and the word with the smallest value is the sample, together with t. Two texts share a sample with
a chance equal to their generalised Jaccard similarity (sum of smaller over sum of larger weights).

Defined results: a null text counts as empty; a text without words has the fingerprint of ones only; equal texts have
equal fingerprints; documents are ordered by id (null first), then by text; other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbook.llm.common import saved, words_of

SAMPLES = 32
BLOCK = 512  # consecutive ids that are ordered together
EMPTY = -1


def _sample(j: int) -> Column:
    """Value (31 bits) over sample (32 bits) of one `term` with log weight `lw`: the smallest decides."""
    low, wide = (1 << 21) - 1, (1 << 31) - 1
    a, b = f"xxhash64(term, {j})", f"xxhash64(term, {j + 100_000})"
    r = f"-ln((({a} & {low}) + 0.5D) / {low + 1} * ((shiftrightunsigned({a}, 21) & {low}) + 0.5D) / {low + 1})"
    c = f"-ln((({b} & {wide}) + 0.5D) / {wide + 1} * ((shiftrightunsigned({b}, 31) & {wide}) + 0.5D) / {wide + 1})"
    beta = f"(shiftrightunsigned({a}, 43) + 0.5D) / {low + 1}"
    t = f"floor(lw / ({r}) + {beta})"
    value = f"ln({c}) - ({r}) * ({t} - {beta}) - ({r})"
    place = f"CAST(least(greatest((({value}) + 64D) * {1 << 24}, 0D), {wide}D) AS BIGINT)"
    return F.expr(f"shiftleft({place}, 32) | (xxhash64(term, {t}) & {(1 << 32) - 1})")


def signatures(terms: DataFrame, *by: str, samples: int = SAMPLES) -> DataFrame:
    """by..., signature: the samples of each group of `term` (a hash, null where the text has no word) and `weight`."""
    weighted = terms.withColumn("lw", F.log(F.col("weight").cast("double")))
    mins = [F.min(_sample(j)).alias(f"s{j}") for j in range(samples)]
    ids = [F.coalesce(F.col(f"s{j}").bitwiseAND((1 << 32) - 1), F.lit(EMPTY)) for j in range(samples)]
    return weighted.groupBy(*by).agg(*mins).select(*by, F.array(*ids).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each sample."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND((1 << 32) - 1))), 8, "0"))
    return F.array_join(digits, "")


def _block(doc_id: Column) -> Column:
    return F.coalesce(F.floor(doc_id / BLOCK), F.lit(-(1 << 62)))


def _next_blocks(docs: DataFrame) -> DataFrame:
    """block, first, before: every block with its first id and the block before it (before the first: the last).

    Blocks are ordered by range partitions; a window takes the blocks of one partition, another the partitions' ends.
    """
    blocks = docs.groupBy(_block(F.col("id")).alias("block")).agg(F.min("id").alias("first"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(blocks.repartitionByRange(parts, "block").withColumn("part", F.spark_partition_id()), "blocks")
    ends = ranged.groupBy("part").agg(F.max("block").alias("end"))  # a row for each partition
    whole = Window.orderBy("part")
    ends = ends.select(
        "part",
        F.coalesce(
            F.lag("end").over(whole), F.last("end").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ).alias("end"),
    )
    within = F.lag("block").over(Window.partitionBy("part").orderBy("block"))
    return saved(
        ranged.withColumn("inside", within)
        .join(ends, "part")
        .select("block", "first", F.coalesce("inside", "end").alias("before")),
        "block-order",
    )


def followed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """block, place, id, text, next, own: every document with the text of the next one by id (after the last: the first).

    Blocks of consecutive ids are sorted apart. A copy of the document that follows a block stands at its end with own =
    false, so that the texts are shuffled once.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    order = _next_blocks(docs)
    heads = docs.join(order, docs["id"].eqNullSafe(order["first"])).where(_block(F.col("id")) == F.col("block"))
    heads = heads.groupBy("before", "first").agg(F.min("text").alias("text"))
    rows = docs.select(_block(F.col("id")).alias("block"), "id", "text", F.lit(True).alias("own")).unionByName(
        heads.select(F.col("before").alias("block"), F.col("first").alias("id"), "text", F.lit(False).alias("own"))
    )
    ordered = Window.partitionBy("block").orderBy(F.desc("own"), F.asc_nulls_first("id"), "text")
    return rows.withColumn("place", F.row_number().over(ordered)).withColumn("next", F.lead("text").over(ordered))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by the first as many characters of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(df: DataFrame, text: str, doc_id: str, samples: int = SAMPLES) -> DataFrame:
    """id, n_chars, edited_sha256, signature, edited_signature, next_signature for every document.

    Everything after the one shuffle by block (weights, samples, neighbours) happens inside the blocks' partitions; only
    digests and signatures are joined in the end. `followed` and `edited` give the edited texts themselves.
    """
    rows = followed(df, text, doc_id).withColumn("edited", F.when(F.col("own"), edited(F.col("text"), F.col("next"))))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"))
    )
    texts = rows.select("block", "place", F.explode(versions).alias("v")).select("block", "place", "v.version", "v.text")
    terms = texts.where("text IS NOT NULL").select("block", "place", "version", F.explode_outer(words_of(F.col("text"))).alias("word"))
    # xxhash64 of a null word would be a number; a text without words keeps its row with a null term.
    terms = terms.withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    weights = terms.groupBy("block", "place", "version", "term").agg(F.count(F.lit(1)).alias("weight"))
    signed = signatures(weights.withColumn("weight", F.when(F.col("term").isNotNull(), F.col("weight"))), "block", "place", "version", samples=samples)
    both = signed.groupBy("block", "place").agg(
        *(F.max(F.when(F.col("version") == v, F.col("signature"))).alias(name) for v, name in enumerate(("signature", "edited_signature")))
    )
    both = both.withColumn("next_signature", F.lead("signature").over(Window.partitionBy("block").orderBy("place")))
    kept = rows.where("own").select("block", "place", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return kept.join(both, ["block", "place"]).drop("block", "place")
