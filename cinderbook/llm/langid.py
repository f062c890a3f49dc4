"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning takes at most about TRAIN_DOCS labelled documents a language (chosen by a hash of their text, whole texts), counts
their hashed n-grams in Spark, and smooths the counts into a matrix of log-probabilities: BUCKETS rows, one column per
language, at most MAX_LANGUAGES columns. The matrix is broadcast; texts are scored batch by batch: the rows of all n-grams
of a text are gathered and summed up.

Defined results: null text or text without a letter gives `und` with score 0; with nothing to learn from every text is
`und`; ties go to the language first in order; documents of any length are scored whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.llm.common import fresh, mapped, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_DOCS = 20_000  # labelled documents to learn a language from, about
MAX_LANGUAGES = 1_000  # bound of the broadcast matrix: 4 bytes x BUCKETS x languages
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def _codes(text: str) -> np.ndarray:
    """Lower-cased characters, every run without a letter as one blank, blanks around."""
    words = regex.sub(r"\P{L}+", " ", text.lower()).strip()
    return np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of the n-grams of a text, by order."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
    return out


def training_rows(df: DataFrame, text: str, lang: str, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text, lang: about train_docs labelled documents of each language, all of them where there are fewer."""
    labelled = df.where(df[lang].isNotNull() & df[text].isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(train_docs)) / F.col("n")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(sizes, "lang").where(place < share).select("text", "lang")


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (BUCKETS x languages) from columns text, lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in found.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
            found.clear()

        for batch in slices(batches, 0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in found and len(found) >= 64:
                    yield from out()
                n = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for at in _buckets(_codes(text)):
                    n += np.bincount(at, minlength=BUCKETS)
        yield from out()

    counted = mapped(training.select("text", "lang"), count, "lang string, bucket long, n long")
    total = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if total.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Bounded collect: BUCKETS x languages at most.
    rows = total.toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((BUCKETS, len(langs)), 0.5)
    column = {lang: i for i, lang in enumerate(langs)}
    places = np.array([column[lang] for lang in rows.column("lang").to_pylist()], np.int64)
    counts[rows.column("bucket").to_numpy(), places] += rows.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predict(df: DataFrame, text: str, langs: list[str], logs: np.ndarray) -> DataFrame:
    """The rows with lang_pred and score: the posterior of the language from the mean log-probability of an n-gram times
    the square root of their number, so that long texts are surer than short ones without all ending at 1."""
    names = fresh(df, "lang_pred", "score")
    sent = df.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs)))
    place = df.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = sent.value
        for batch in slices(batches, place):
            preds, scores = [], []
            for value in batch.column(place).to_pylist():
                if not value or not langs or not _LETTER.search(value):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.concatenate(_buckets(_codes(value)))
                sums = np.zeros(len(langs))
                for part in range(0, len(at), 1 << 14):
                    sums += logs.take(at[part : part + (1 << 14)], axis=0).sum(axis=0, dtype=np.float64)
                odds = np.exp((sums - sums.max()) / np.sqrt(len(at)))
                best = int(sums.argmax())
                preds.append(langs[best])
                scores.append(float(odds[best] / odds.sum()))
            yield pa.record_batch([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return mapped(df, score, T.StructType([*df.schema.fields, *added]))
