"""Quality rules: plain text measures, and a hashed n-gram log-likelihood ratio (built-in expressions only).

The ratio compares two multinomials over hashed word unigrams and bigrams, BUCKETS buckets for each kind: one of trusted
documents, one of the whole raw corpus, which is also the prior of the first. A document's score is the mean of the log
ratios of its n-grams, so that length plays no part, less the cut: the score that a share LOST of the held-out trusted
documents falls short of. A document is kept if it passes the plain rules and scores at least THRESHOLD. One trusted document
in HELD_OUT is held out, the others are fitted, however many they are. The n-grams of all documents are counted, each task
sending a row a bucket at most. The ratios of a kind are one array of BUCKETS integers, whose size does not depend on the
data, in a table of one row; it is read by position while the measures are computed, so texts are split twice in all.

Defined results: a null or blank text has no words, fails the plain rules and has the ratio 0; with no trusted document all
ratios and the cut are 0; if no held-out one has MIN_WORDS words, the cut is taken over those that were fitted; a score at
the threshold is kept; repeated rows and ids count as often as they occur; texts of any length are scored whole; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.llm.common import SPACE_CHARS, beside, fresh, let, pieces_of, saved, words_of
from cinderbook.operators.sizes import broadcast_if_small

BUCKETS = 1 << 18  # of each kind
PART = 1 << 11  # buckets in a row on the way to the driver
HELD_OUT = 10
LOST = 0.01
THRESHOLD = 0.0  # nats per n-gram above the cut
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def pair_hashes(words: str) -> Column:
    """A hash of each word with its successor, from word hashes; the last word alone."""
    w = F.col(words)
    return F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))


def with_repeated_words(df: DataFrame, words: str, pairs: str, column: str) -> DataFrame:
    """The rows with the number of words inside 3-word windows that occur twice or more, first occurrences included.

    Each window becomes one long: its hash in the high bits, its place in as many low bits as the number of words takes.
    Sorted, equal windows are neighbours; each pair of neighbours is compared once, and equal ones give both their places, in
    the halves of a long. The steps are columns of their own, so that each is computed once.
    """
    low, high, packed, places = fresh(df, "__low", "__high", "__packed", "__places")
    n, whole = F.size(words), F.lit(0).cast("bigint")
    df = df.withColumn(low, F.call_function("shiftleft", whole + 1, F.length(F.bin(n.cast("bigint"))).cast("int")) - 1)
    df = df.withColumn(high, F.bitwise_not(low))
    windows = F.slice(
        F.zip_with(pairs, F.slice(words, F.lit(3), n), lambda h, c: F.xxhash64(h, c)), F.lit(1), F.greatest(n - 2, F.lit(0))
    )
    df = df.withColumn(packed, F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.col(high)).bitwiseOR(i.cast("bigint")))))
    following = F.slice(F.col(packed), F.lit(2), F.greatest(F.size(packed), F.lit(1)))
    both = lambda x, y: F.shiftleft(x.bitwiseAND(F.col(low)), 32).bitwiseOR(y.bitwiseAND(F.col(low)))
    equal = F.zip_with(packed, following, lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(F.col(high)) == 0, both(x, y)))
    df = df.withColumn(places, F.array_compact(equal))
    at = F.concat(F.transform(places, lambda x: F.shiftright(x, 32)), F.transform(places, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))
    df = df.withColumn(places, F.sort_array(at))
    # A place that stands twice adds nothing.
    at = F.col(places)
    steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("bigint"))
    return df.withColumn(column, F.aggregate(steps, whole, lambda x, y: x + y)).drop(low, high, packed, places)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def with_measures(df: DataFrame, text: str, pieces: str) -> DataFrame:
    """The rows with the measures that take no word hashes. pieces: as from `pieces_of`, one more than there are blanks."""
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("word_chars", (F.length(value) - F.size(pieces) + 1).cast("bigint"))
    df = df.withColumn("n_symbols", F.regexp_count(value, F.lit(SYMBOLS)).cast("bigint"))
    return df.withColumn("n_dup_lines", repeated_lines(value))


def counted(df: DataFrame, text: str, doc_id: str, fitted: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of the fitted ones; buckets of bigrams come after those of unigrams.

    fitted: one column of distinct ids.
    """
    ids = fitted.select(F.col(fitted.columns[0]).alias("__id"), F.lit(1).alias("__trusted"))
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(broadcast_if_small(ids), "__id", "left")
    rows = rows.select("__trusted", word_hashes(F.col("__text")).alias("__w"))
    grams = F.posexplode(F.concat("__w", pair_hashes("__w"))).alias("at", "hash")
    place = F.col("hash").bitwiseAND(buckets - 1) + F.when(F.col("at") >= F.col("n"), buckets).otherwise(0)
    exploded = rows.withColumn("n", F.size("__w")).select("__trusted", "n", grams).select("__trusted", place.alias("bucket"))
    return exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("target"))


def ratios(counts: DataFrame, buckets: int) -> DataFrame:
    """unigrams, bigrams: one row with the log-likelihood ratios in thousandths, as arrays by bucket; 0 for a bucket not in use.
    The driver holds 2 * buckets small numbers."""
    n = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = (n["target"] or 0) / (n["raw"] or 1)
    milli = F.round(F.log((F.col("target") + 1) / (F.col("raw") * share + 1)) * 1000).cast("int")
    part, at = F.floor(F.col("bucket") / PART), (F.col("bucket") % PART).cast("int")
    rows = counts.where(milli != 0).groupBy(part.alias("part")).agg(F.collect_list(at).alias("at"), F.collect_list(milli).alias("milli"))
    found, told = np.zeros(2 * buckets, np.int32), rows.toArrow()
    # One job; fetched partition by partition, the rows would take one each.
    for part, at, milli in zip(told["part"].to_pylist(), told["at"], told["milli"], strict=True):
        found[part * PART + at.values.to_numpy()] = milli.values.to_numpy()
    arrays = [pa.FixedSizeListArray.from_arrays(pa.array(kind), buckets).cast(pa.list_(pa.int32())) for kind in found.reshape(2, buckets)]
    return saved(counts.sparkSession.createDataFrame(pa.table(arrays, names=["unigrams", "bigrams"])), "quality-ratios")


def with_mean(df: DataFrame, words: str, pairs: str, table: DataFrame, buckets: int, column: str) -> DataFrame:
    """The rows with the mean ratio of their n-grams, 0 without words. table: as from `ratios`.

    The arrays are scalar subqueries, so that no plan holds their numbers. They are columns below the sums, as none may stand
    in a lambda; each is used once, so Spark moves it back into the sum and no row carries it. The number of n-grams beside
    them, a second use of the pairs, keeps Spark from moving them further down instead.
    """
    names = fresh(df, "__unigrams", "__bigrams", "__n")
    one, two, n = map(F.col, names)
    columns = [*map(F.col, df.columns), (F.size(words) + F.size(pairs)).alias(names[2])]
    rows = df.select(*columns, *[table.select(k).scalar().alias(c) for k, c in zip(("unigrams", "bigrams"), names, strict=False)])

    def total(hashes: str, ratios: Column) -> Column:
        # Whole numbers add up to the same sum in any order.
        at = lambda kind, h: F.get(kind, h.bitwiseAND(buckets - 1).cast("int"))
        return let(ratios, lambda kind: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda so_far, h: so_far + at(kind, h)))

    mean = F.coalesce(F.try_divide(total(words, one) + total(pairs, two), n) / 1000, F.lit(0.0))
    return rows.select(*df.columns, mean.alias(column))


def asked_means(df: DataFrame, text: str, doc_id: str, asked: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """mean: the mean ratios of the asked documents, null for one of fewer than MIN_WORDS words.

    A filter on the number of words would be moved below the join, where the words of all documents would be taken for it.
    """
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(broadcast_if_small(asked), "__id")
    rows = rows.select(word_hashes(F.col("__text")).alias("__w"))
    found = with_mean(rows.withColumn("__p", pair_hashes("__w")), "__w", "__p", table, buckets, "__mean")
    return found.select(F.when(F.size("__w") >= MIN_WORDS, F.col("__mean")).alias("mean"))


def cut_of(df: DataFrame, text: str, doc_id: str, asked: DataFrame, table: DataFrame, buckets: int) -> float | None:
    """The mean ratio that a share LOST of the asked documents of MIN_WORDS words or more falls short of."""
    return asked_means(df, text, doc_id, asked, table, buckets).agg(F.percentile_approx("mean", LOST, 100_000)).first()[0]


def passing(df: DataFrame, text: str, doc_id: str, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, with their own columns.

    The task number in the condition keeps the verdict's long expressions from being moved into the scan's filter, where
    each would be computed again at every use.
    """
    (task, kept) = fresh(df, "__task", "kept")
    out = judged(df, text, doc_id, trusted, threshold).withColumn(task, F.spark_partition_id())
    return out.where(F.col(kept) & (F.col(task) >= 0)).select(*df.columns)


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept"]


def judged(
    df: DataFrame, text: str, doc_id: str, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """The rows with the plain measures, base_failed, llr_score and kept. buckets: a power of two, PART at least."""
    return beside(df, ADDED, lambda rows: _judged(rows, text, doc_id, trusted, threshold, buckets))


def _judged(df: DataFrame, text: str, doc_id: str, trusted: DataFrame, threshold: float, buckets: int) -> DataFrame:
    pieces, words, pairs, mean = fresh(df, "__pieces", "__words", "__pairs", "__mean")
    ids = trusted.select(F.col(trusted.columns[0]).alias("__id")).where("__id IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64(F.col("__id"), F.lit("held out")), F.lit(HELD_OUT)) == 0
    counts = saved(counted(df, text, doc_id, ids.where(~held), buckets), "quality-counts")
    table = ratios(counts, buckets)
    cuts = (cut_of(df, text, doc_id, ids.where(part), table, buckets) for part in (held, ~held))
    cut = next((c for c in cuts if c is not None), 0.0)
    # The text and its pieces go no further than the first steps; from there on only word hashes do.
    out = with_measures(df.withColumn(pieces, pieces_of(F.col(text))), text, pieces)
    out = out.withColumn(words, F.transform(F.array_remove(pieces, ""), lambda w: F.xxhash64(w))).drop(pieces).withColumn(pairs, pair_hashes(words))
    out = with_mean(out, words, pairs, table, buckets, mean)
    out = with_repeated_words(out, words, pairs, "n_repeat_words").withColumn("n_words", F.size(words).cast("bigint"))
    out = out.withColumn("llr_score", F.col(mean) - F.lit(cut)).drop(words, pairs, mean)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= threshold))
