"""Line dedup by winnowing over line hashes (built-in expressions only).

The lines with a word form a document's sequence. Of every WINDOW consecutive line hashes the smallest is selected (the
last of equal ones): any run of WINDOW lines or more that two places share then holds a selected line in both. Selected
lines whose hash occurs once are dropped; the others are joined by hash and extended to both sides, by their neighbours'
hashes, into all runs of WINDOW lines around them. Of each such run the first place (by document, then line) stays, and
every later place is deleted; overlapping deletions merge into longer runs.

With long_words, a line of that many words or more is a run of its own as well, whatever stands beside it.

The result is exact: a line goes if and only if it lies in WINDOW consecutive lines that also stand at an earlier place, or
is a long line that does.

Defined results: a null text stays null; lines without a word belong to no run and stay; rows equal in id and text are one
document and get the same result; null ids come first; documents are ordered by id, then by a hash of the text; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.llm.common import SPACE_CHARS, fresh, let, saved, words_of

WINDOW = 2


def _lines(text: Column, long_words: int | None) -> Column:
    """Lines with a word, as structs of line number `at`, hash `h` and, with long_words, whether they are `long`."""

    def line(x: Column, i: Column) -> Column:
        fields = [i.alias("at"), F.xxhash64(x).alias("h")]
        if long_words is not None:
            # n words take 2 n - 1 characters at least.
            fields.append(((F.length(x) >= 2 * long_words - 1) & (F.size(words_of(x)) >= long_words)).alias("long"))
        return F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", F.struct(*fields))

    all_lines = F.transform(F.split(text, "\n"), line)
    return F.filter(all_lines, lambda x: x.isNotNull())


def _selected(lines: Column, window: int, alone: bool) -> Column:
    """The minima of all windows, each once: place, hash, and the hashes and line numbers up to window - 1 to both sides.

    With alone, each long line as well, as a run of one line.
    """

    def of(line: Column) -> Column:
        n, hashes = F.size(line), F.transform(line, lambda x: x["h"])

        def minimum(h: Column, i: Column) -> Column:
            inside = F.slice(h, i + 1, window)
            return i + F.lit(window) - F.array_position(F.reverse(inside), F.array_min(inside)).cast("int")

        def around(p: Column) -> Column:
            first = F.greatest(p - (window - 1), F.lit(0))
            near = F.slice(line, first + 1, p - first + window)
            return F.struct(F.get(line, p)["h"].alias("h"), F.lit(window).alias("window"), near.alias("near"))

        def single(x: Column) -> Column:
            return F.struct(x["h"].alias("h"), F.lit(1).alias("window"), F.array(x).alias("near"))

        starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
        places = let(hashes, lambda h: F.array_distinct(F.transform(starts, lambda i: minimum(h, i))))
        marks = F.transform(places, around)
        return F.concat(marks, F.transform(F.filter(line, lambda x: x["long"]), single)) if alone else marks

    return let(lines, of)


def repeated_lines(df: DataFrame, text: str, doc_id: str, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """id, hash, gone: the line numbers to delete of every document (id and text hash) that has any."""
    lines = _lines(F.col(text), long_words)
    docs = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), lines.alias("lines"))
    found = _selected(F.col("lines"), window, long_words is not None)
    marks = saved(docs.select("id", "hash", F.explode(found).alias("mark")).select("id", "hash", "mark.*"), "line-marks")
    shared = marks.groupBy("h", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "window")

    # Extend each shared line to both sides: every run of `window` lines that holds it.
    def runs(near: Column, n: Column) -> Column:
        starts = F.when(F.size(near) >= n, F.sequence(F.lit(1), F.size(near) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(near, i, n))

    # Two passes of a 64-bit hash over the run's line hashes name it.
    placed = (
        marks.join(shared, ["h", "window"])
        .select("id", "hash", "window", F.explode(runs(F.col("near"), F.col("window"))).alias("run"))
        .select(
            "id",
            "hash",
            F.transform("run", lambda x: x["at"]).alias("lines"),
            F.struct(
                "window",
                F.xxhash64(F.transform("run", lambda x: x["h"])).alias("a"), F.hash(F.reverse(F.transform("run", lambda x: x["h"]))).alias("b")
            ).alias("name"),
        )
        .withColumn("at", F.struct("id", "hash", F.element_at("lines", 1).alias("line")))
    )
    first = placed.groupBy("name").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    later = placed.join(first, "name").where("first < at")
    return later.groupBy("id", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))


def without_repeats(df: DataFrame, text: str, doc_id: str, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """The rows with the repeated lines taken out of their text, and n_removed, the number of lines taken out."""
    key, gone, removed = fresh(df, "__hash", "__gone", "n_removed")
    found = repeated_lines(df, text, doc_id, window, long_words).select(F.col("id").alias("__id"), F.col("hash").alias(key), F.col("gone").alias(gone))
    rows = df.withColumn(key, F.xxhash64(text))
    joined = rows.join(found.withColumnRenamed(key, "__of"), F.expr(f"`{doc_id}` <=> __id AND `{key}` = __of"), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cut = F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(F.split(text, "\n"), rest))
    out = joined.withColumn(removed, F.coalesce(F.size(gone), F.lit(0)).cast("bigint")).withColumn(text, cut)
    return out.select(*df.columns, removed)
