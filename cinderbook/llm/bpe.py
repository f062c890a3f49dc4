"""Byte-level BPE by a distinct-word table.

Texts are split into words by the tokenizer's own pattern; no merge crosses a word. Spark counts the words of the whole
table, each distinct word is encoded once (by the ranks of its pieces, where that is the same), and the ids go back to the places where the word stands. The part of the
word table that all tasks need is bounded: the HEAD most frequent words are sent to every task. Every other word is rare
by construction; it is encoded once per batch of documents, in the task that meets it, which saves shuffling each
occurrence of it to a join and back (see the README for the figures). Decoding joins ids with the table of pieces,
which is as long as the vocabulary.

Defined results: a null text counts as empty and has no ids; a special token in a text is that token; unknown ids cannot
occur, as every byte is a piece; an empty table gives an empty result; other columns pass through, in their order.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from cinderbook.llm import packing
from cinderbook.llm.common import fresh, mapped, saved, slices

# Fixed value: the pattern of byte-level BPE words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters that the library and the pattern here sort alike; elsewhere their tables are of different Unicode versions.
SAME = "\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3"

HEAD = 1 << 17  # words of the distinct-word table sent to every task
KEPT = 1 << 18  # words a task counts or keeps at a time
LONG = 64  # characters of the longest word in that part


@functools.cache
def _tokenizer(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return Tokenizer.from_str(definition)


@functools.cache
def _splitter(definition: str):
    """Words and special tokens of a text, in order. Parts with other than SAME characters are split by the library itself."""
    special = [t.content for t in _tokenizer(definition).get_added_tokens_decoder().values()]
    apart = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
    plain, library = regex.compile(WORD).findall, ByteLevel(add_prefix_space=False, use_regex=True)
    strange = re.compile(f"[^{SAME}]").search
    known = set(special)

    def words(text: str) -> list[str]:
        if text.isascii() or not strange(text):
            return plain(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if apart is None or not any(s in text for s in known):
            return words(text)
        return [w for part in apart.split(text) for w in ([part] if part in known else words(part))]

    return split


def _flat(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def ranks_of(definition: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, where merging by rank gives the same ids (see `packing.ranks_of`), else None."""
    told = json.loads(definition)
    model = told["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    plain = not any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "ignore_merges"))
    if told.get("normalizer") or not plain or made != sorted(set(made)):
        return None
    rank, pieces = {pair: i for i, pair in enumerate(pairs)}, _pieces(definition)
    special = {t["content"] for t in told["added_tokens"]}
    return {bytes(pieces[i]): i for piece, i in model["vocab"].items() if piece not in special and packing.occurs(list(piece), rank)}


_BY_RANK: dict[str, tiktoken.Encoding] = {}


def _encode(sent: tuple[str, dict[bytes, int] | None], words: list[str]) -> list[list[int]]:
    """Ids of words of the splitter, each by itself; special tokens are left to the library."""
    definition, ranks = sent
    if not ranks:
        return [e.ids for e in _tokenizer(definition).encode_batch_fast(words, add_special_tokens=False)]
    if definition not in _BY_RANK:
        _BY_RANK[definition] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    one, special = _BY_RANK[definition].encode_ordinary, _special(definition)
    return [[special[w]] if w in special else one(w) for w in words]


@functools.cache
def _special(definition: str) -> dict[str, int]:
    return {t.content: i for i, t in _tokenizer(definition).get_added_tokens_decoder().items()}


@functools.cache
def _pieces(definition: str) -> np.ndarray:
    """Bytes of each id. Pieces are written in printable characters that stand for bytes. Read without the library, whose
    tokenizer the driver does not need."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    told = json.loads(definition)
    special = {t["id"]: t["content"] for t in told["added_tokens"]}
    ids = {i: piece for piece, i in told["model"]["vocab"].items()} | special
    out = np.empty(max(ids) + 1, dtype=object)
    out[:] = b""
    for i, piece in ids.items():
        out[i] = piece.encode() if i in special else bytes(byte[c] for c in piece)
    return out


def _load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return json.dumps(json.load(f) | {"truncation": None, "padding": None}, ensure_ascii=False)


def _sent(df: DataFrame, path: str):
    """The tokenizer's definition and ranks, sent to the tasks."""
    definition = _load(path)
    return df.sparkSession.sparkContext.broadcast((definition, ranks_of(definition)))


def word_table(df: DataFrame, text: str, path: str) -> DataFrame:
    """word, n, ids: every distinct word of the table with its number of occurrences, encoded once."""
    sent = _sent(df, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = _splitter(sent.value[0]), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in slices(batches, 0):
            for value in batch.column(0).to_pylist():
                if value:
                    found.update(split(value))
                if len(found) > KEPT:
                    yield flush()
        if found:
            yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _encode(sent.value, batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    counted = mapped(df.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return mapped(counted, encode, "word string, n long, ids array<int>")


def _frequent(words: DataFrame, head: int) -> pa.Table:
    """word, ids of the most frequent words of at most LONG characters: at most `head`, by a cut in the counts.

    The cut comes from a histogram of counts in eighths of powers of two, a few hundred rows at any size; no task sorts
    the words.
    """
    short = words.where(F.length("word") <= LONG).withColumn("size", F.floor(8 * F.log2("n")))
    cut, total = 1 << 60, 0
    for row in sorted(short.groupBy("size").count().collect(), reverse=True):
        total += row["count"]
        if total > head:
            break
        cut = row["size"]
    return short.where(F.col("size") >= cut).select("word", "ids").toArrow()


def encode(df: DataFrame, text: str, path: str, column: str = "ids", head: int = HEAD) -> DataFrame:
    """The rows with the token ids of their whole text."""
    (column,) = fresh(df, column)
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    return mapped(df, _encoding(df, text, path, column, head), schema)


def round_trip(
    df: DataFrame, text: str, path: str, column: str = "ids", decoded: str = "decoded", head: int = HEAD
) -> DataFrame:
    """The rows with their ids and the text of these, both made by the same worker."""
    column, decoded = fresh(df, column, decoded)
    encoding = _encoding(df, text, path, column, head)
    decoding = _decoding(df, len(df.columns), path, decoded)
    ids, back = T.StructField(column, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())
    return mapped(df, lambda batches: decoding(encoding(batches)), T.StructType([*df.schema.fields, ids, back]))


def _encoding(df: DataFrame, text: str, path: str, column: str, head: int):
    """The function of a task's batches that adds the ids; counts and encodes the words of the table first."""
    spark = df.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(saved(word_table(df, text, path), "words"), head))
    definition = _sent(df, path)
    place = df.columns.index(text)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(definition.value[0])
        sent, sent_ids = (frequent.value.column(c).combine_chunks() for c in ("word", "ids"))
        table: dict[str, int] = {}
        for batch in slices(batches, place):
            rows = [split(value) if value else [] for value in batch.column(place).to_pylist()]
            words = list(chain.from_iterable(rows))
            if not table or len(table) > len(sent) + KEPT:
                table = {w: i for i, w in enumerate(sent.to_pylist())}
                ids = [_flat(sent_ids).astype(np.int32)]
                sizes = [pc.list_value_length(sent_ids).to_numpy(zero_copy_only=False)]
            # Words that the table lacks are encoded once and added to it.
            new = list(set(words).difference(table))
            if new:
                encoded = _encode(definition.value, new)
                table.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                ids.append(np.fromiter(chain.from_iterable(encoded), np.int32))
                sizes.append(np.fromiter(map(len, encoded), np.int64, len(new)))
                ids, sizes = [np.concatenate(ids)], [np.concatenate(sizes)]
            at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
            long = sizes[0][at].astype(np.int64)
            starts = (np.cumsum(sizes[0]) - sizes[0])[at]
            ends = np.cumsum(long)
            flat = ids[0][np.repeat(starts - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, column])

    return ids_of


def _short(batches: Iterator[pa.RecordBatch], place: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about `most` ids (one row at least)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def decode(df: DataFrame, ids: str, path: str, column: str = "decoded") -> DataFrame:
    """The rows with the text of their token ids; null ids give null. Bytes that are no UTF-8 become U+FFFD."""
    (column,) = fresh(df, column)
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.StringType())])
    return mapped(df, _decoding(df, df.columns.index(ids), path, column), schema)


def _decoding(df: DataFrame, place: int, path: str, column: str):
    """The function of a task's batches that adds the text of the ids in column `place`."""
    definition = df.sparkSession.sparkContext.broadcast(_load(path))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(definition.value)
        for batch in _short(batches, place):
            lists = batch.column(place)
            flat = pieces[_flat(lists)]
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))])
            known = lists.is_valid().to_pylist()
            texts = [
                b"".join(flat[a:b]).decode("utf-8", "replace") if k else None
                for a, b, k in zip(bounds[:-1], bounds[1:], known, strict=True)
            ]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return texts_of
