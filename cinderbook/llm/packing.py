"""Packing of documents into token sequences by cutting-stock column generation.

A document's ids are cut into pieces of LENGTH tokens from the front, which are sequences of their own, and a rest.  The rests
are the stock: their histogram, in steps of GRAIN tokens, is all that the driver sees (LENGTH / GRAIN classes at most, for
any number of documents).  A pattern says how many rests of each class go into one sequence.  The linear program over patterns
(least number of sequences for the histogram) is solved by the simplex method: it starts from patterns that each use up a
class, and a knapsack by dynamic programming over the classes' prices finds the columns that enter, until none is worth it or
the bound on what is left to gain is below GAP.  Full patterns are rounded down, then up as far as rests are left.

Rests are ranked within their class: the task that encodes them numbers its own, and sums of counts by class and task give the
number before each task's first.  Ranks below a class's share of the rounded patterns say which sequence a rest goes to.  The
others, a fraction of a sequence for each pattern, stand one behind another on a line that is cut wherever a sequence is full;
its end goes into sequences of powers of two, which need no padding.  So padding is only what rounding lengths up to GRAIN
leaves, and only pieces on the line are cut.

Defined results: a null or empty text is one piece, the closing id alone; a piece's ids are its little-endian unsigned 32-bit
numbers; texts of any length are encoded part by part between blanks; repeated rows are documents of their own, whatever their
ids; an empty table gives an empty result; other columns than the text pass through, added ones get a name of their own where
the table has it already.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cinderbook.llm.common import fresh, mapped, saved, shipped, slices
from cinderbook.operators.sizes import broadcast_if_small

LENGTH = 2048
GRAIN = 4
CLOSING = 1  # the id after each document
GAP = 1e-3
COLUMNS = 256  # columns that one knapsack offers at most
PIVOTS = 20_000
KEPT = 1 << 19  # words of which a task remembers the ids

# How the vocabulary writes a word's end, and its pattern of words.
SUFFIX = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

END = b"\0"
PARTS = regex.compile(PATTERN).findall
# Characters that are no blanks beyond ASCII, and of which every Unicode version knows the class and the lower case.
PLAIN = re.compile("[\x01-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]*").fullmatch


# --- encoding -------------------------------------------------------------------------------
@functools.cache
def _tokenizer(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return Tokenizer.from_str(definition)


def definition_of(path: str) -> str:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer.to_str()


def ranks_of(definition: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, a word's end written as END; None for tokenizers of another make.

    Merging by rank gives the ids that merging by the list of pairs gives, if ids follow the list: the two pieces that meet in
    a piece are then those of the piece encoded by itself.  Pieces whose own encoding ends otherwise can never occur and are
    left out.
    """
    told = json.loads(definition)
    model, normal, split = told["model"], told.get("normalizer") or {}, (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = [n["type"] for n in normal.get("normalizers", [])]
    patterns = [p["pattern"].get("Regex") for p in split if p["type"] == "Split"]
    if model.get("end_of_word_suffix") != SUFFIX or steps != ["NFC", "Replace", "Lowercase"] or patterns != [PATTERN]:
        return None
    vocabulary, special = model["vocab"], {t["content"] for t in told["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(pairs)}
    made = [vocabulary[a + b] for a, b in pairs]
    if made != sorted(set(made)) or len(vocabulary.keys() - special) - len(made) != 512:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    out = {}
    for piece, i in vocabulary.items():
        core = piece.removesuffix(SUFFIX)
        if piece not in special and occurs([*core[:-1], core[-1] + piece[len(core) :]], rank):
            out[bytes(byte[c] for c in core) + (END if core != piece else b"")] = i
    return out


def occurs(symbols: list[str], rank: dict[tuple[str, str], int]) -> bool:
    """Whether merging joins all symbols to one piece."""
    while len(symbols) > 1:
        places = [(rank[pair], k) for k, pair in enumerate(itertools.pairwise(symbols)) if pair in rank]
        if not places:
            return False
        _, k = min(places)
        symbols[k : k + 2] = ["".join(symbols[k : k + 2])]
    return True


class Encoder:
    """Ids of texts.  No token spans a blank, so a text's ids are those of its words; a word's ids are kept for later texts.

    Once KEPT words or their characters are kept, further ones are encoded once a batch.
    """

    def __init__(self, definition: str, ranks: dict[bytes, int] | None):
        self.tokenizer, self.table = _tokenizer(definition), _Numbers()
        self.fast = ranks and tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        if ranks:
            self.last = np.zeros(max(ranks.values()) + 1, bool)
            self.last[[i for piece, i in ranks.items() if piece.endswith(END) and len(piece) > 1]] = True
        self.ids, self.sizes, self.characters = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and how many each has."""
        joined = "\n".join(words)
        if not self.fast:
            able = [False] * len(words)
        elif PLAIN(joined) and "<|" not in joined:
            return self._ranked(joined.lower().split("\n"))
        else:
            able = [bool(PLAIN(w)) and "<|" not in w for w in words]
        ranked = self._ranked([w.lower() for w, a in zip(words, able, strict=True) if a])
        rest = [w for w, a in zip(words, able, strict=True) if not a]
        others = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        able, sizes = np.array(able, bool), np.zeros(len(words), np.int64)
        sizes[able], sizes[~able] = ranked[1], [len(o) for o in others]
        own, flat = np.repeat(able, sizes), np.zeros(sizes.sum(), np.int64)
        flat[own], flat[~own] = ranked[0], np.fromiter(chain.from_iterable(others), np.int64)
        return flat, sizes

    def _ranked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of PLAIN characters in lower case."""
        parts = [[w] if w.isalpha() else PARTS(w) for w in words]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        if not counts.sum():
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        found = self.fast.encode_to_numpy("\0".join(chain.from_iterable(parts)) + "\0").astype(np.int64)
        ends = np.append(0, np.flatnonzero(self.last[found]) + 1)[np.cumsum(counts)]
        return found, np.diff(ends, prepend=0)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) in order, and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.values.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        numbers = np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))
        ids, sizes = self.ids, self.sizes
        new, self.table.new = self.table.new, []
        if new:
            flat, counts = self._encoded(new)
            ids, sizes = np.concatenate([ids, flat]), np.concatenate([sizes, counts])
            if len(self.table) <= KEPT and self.characters <= 32 * KEPT:
                self.ids, self.sizes = ids, sizes
                self.characters += sum(map(len, new))
            else:
                for word in new:
                    del self.table[word]
        starts = np.cumsum(sizes) - sizes
        at = numbers[words.indices.to_numpy()]
        counts = sizes[at]
        ends = np.append(0, np.cumsum(counts))
        out = ids[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return out, np.diff(ends[offsets])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(definition: str, ranks: dict[bytes, int] | None) -> Encoder:
    """One for all tasks of a worker."""
    if definition not in _ENCODERS:
        _ENCODERS[definition] = Encoder(definition, ranks)
    return _ENCODERS[definition]


class _Numbers(dict):
    """Numbers words in the order they come up; `new` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


# --- the linear program ---------------------------------------------------------------------
def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest worth in each capacity, any number of each size, and the item added there last (-1: none)."""
    value, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if fitting[c]:
            offers = value[c - sizes[: fitting[c]]] + worth[: fitting[c]]
            best = int(offers.argmax())
            if offers[best] > value[c]:
                value[c], item[c] = offers[best], best
    return value, item


def _filled(sizes: np.ndarray, item: np.ndarray, first: int, capacity: int) -> np.ndarray:
    """The pattern of item `first` and the best use of the room beside it."""
    pattern = np.zeros(len(sizes), np.int64)
    pattern[first], room = 1, capacity - sizes[first]
    while room > 0:
        if item[room] < 0:
            room -= 1
        else:
            pattern[item[room]] += 1
            room -= sizes[item[room]]
    return pattern


def _start(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis: patterns as full as can be around the largest size left, each used until it has used up a size."""
    m = len(sizes)
    left, basis, use, alive = counts.astype(float), np.zeros((m, m)), np.zeros(m), np.arange(m)
    while len(alive):
        own = sizes[alive]
        _, item = knapsack(own, own + 1e-3 * own * own / capacity, capacity)
        pattern = _filled(own, item, len(alive) - 1, capacity)
        used = np.flatnonzero(pattern)
        share = left[alive[used]] / pattern[used]
        row = alive[used[share.argmin()]]
        basis[row, alive], use[row] = pattern, share.min()
        left[alive[used]] -= share.min() * pattern[used]
        left[row] = 0
        alive = alive[alive != row]
    return basis, use


def patterns_of(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, in fractions: the linear program's solution up to GAP."""
    basis, use = _start(sizes, counts, capacity)
    inverse = np.linalg.inv(basis.T)
    prices, least, pivots = inverse.sum(axis=0), float((sizes * counts).sum()) / capacity, 0
    while use.sum() * (1 - GAP) > least and pivots < PIVOTS:
        value, item = knapsack(sizes, prices, capacity)
        worth = prices + value[capacity - sizes]
        if worth.max() <= 1 + 1e-9 or use.sum() * (1 - GAP) <= use.sum() / value[capacity]:
            break
        offered = np.argsort(-worth)[:COLUMNS]
        columns = np.unique([_filled(sizes, item, j, capacity) for j in offered[worth[offered] > 1 + 1e-9]], axis=0)
        while pivots < PIVOTS:
            gains = columns @ prices
            best = int(gains.argmax())
            if gains[best] <= 1 + 1e-9:
                break
            some = np.flatnonzero(columns[best])
            direction = inverse[:, some] @ columns[best][some]
            able = np.flatnonzero(direction > 1e-9)
            row = able[(use[able] / direction[able]).argmin()]
            step = use[row] / direction[row]
            use = np.maximum(use - step * direction, 0)
            use[row], basis[row] = step, columns[best]
            turned = inverse[row] / direction[row]
            prices = prices + (1 - gains[best]) * turned
            direction[row] = 0
            inverse -= np.outer(direction, turned)
            inverse[row] = turned
            pivots += 1
    return basis.astype(np.int64), use


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Full patterns and whole numbers of uses that the counts allow."""
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, use = patterns_of(sizes, counts, capacity)
    full = patterns @ sizes == capacity
    patterns, use = patterns[full], use[full]
    times = np.floor(use + 1e-7).astype(np.int64)
    left = counts - times @ patterns
    while (left < 0).any():  # a fraction that was taken for a whole
        over = int(np.flatnonzero((patterns[:, left < 0].sum(axis=1) > 0) & (times > 0))[0])
        times[over] -= 1
        left = left + patterns[over]
    for p in np.argsort(times - use, kind="stable"):
        some = patterns[p] > 0
        more = int((left[some] // patterns[p][some]).min())
        times[p] += more
        left = left - more * patterns[p]
    return patterns[times > 0], times[times > 0]


# --- placing --------------------------------------------------------------------------------
@dataclass
class Layout:
    """Where a rest goes by its class and rank: intervals of ranks, sorted by class << 48 | first rank."""

    keys: np.ndarray
    each: np.ndarray  # rests of the class in one sequence
    sequence: np.ndarray  # first sequence of the pattern
    slot: np.ndarray  # place of the class within the sequence
    taken: dict[int, int]  # ranks of each class that have a place
    sequences: int

    @classmethod
    def of(cls, sizes: np.ndarray, patterns: np.ndarray, times: np.ndarray, first: int) -> Layout:
        rows, taken = [], dict.fromkeys(sizes.tolist(), 0)
        for pattern, n in zip(patterns, times.tolist(), strict=True):
            slot = 0
            for j in np.flatnonzero(pattern)[::-1]:
                size, each = int(sizes[j]), int(pattern[j])
                rows.append((size << 48 | taken[size], each, first, slot))
                taken[size] += each * n
                slot += each
            first += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*table.T, taken, first)

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of rests that have a place."""
        keys = size.astype(np.int64) << 48 | rank
        at = np.searchsorted(self.keys, keys, side="right") - 1
        within = keys - self.keys[at]
        return self.sequence[at] + within // self.each[at], self.slot[at] + within % self.each[at]


def _cut(start: int, length: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(from, to, sequence, offset) of a stretch of the line: sequences of the full capacity, then powers of two."""
    out, at, tail = [], start, total // capacity * capacity
    while at < start + length:
        if at < tail:
            sequence, offset, room = at // capacity, at % capacity, capacity - at % capacity
        else:
            sequence, begin = tail // capacity, tail
            while True:
                size = 1 << (total - begin).bit_length() - 1
                if at < begin + size:
                    break
                sequence, begin = sequence + 1, begin + size
            offset, room = at - begin, begin + size - at
        end = min(start + length, at + room)
        out.append((at - start, end - start, sequence, offset))
        at = end
    return out


ADDED = {"start": "bigint", "length": "bigint", "ids": "binary", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}


def _encoded(df: DataFrame, text: str, path: str, closing: int) -> DataFrame:
    """The pieces: other columns, start, length, ids (in the narrow type), tokens, class, task, number and rank within both."""
    definition = definition_of(path)
    sent = df.sparkSession.sparkContext.broadcast((definition, ranks_of(definition)))
    kind = _kind(path)
    place, kept = df.columns.index(text), [i for i, c in enumerate(df.columns) if c != text]
    extra = ["start", "length", "ids", "tokens", "class", "task", "number", "rank"]
    inner = fresh(df.drop(text), *[f"__{c}" for c in extra])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks, number = _encoder(*sent.value), np.zeros(LENGTH // GRAIN + 1, np.int64), 0
        task = TaskContext.get().partitionId()
        for batch in slices(batches, place):
            rows, columns = [], [[] for _ in extra]
            flat, sizes = encoder.texts(batch.column(place))
            for i, ids in enumerate(np.split(flat.astype(kind), np.cumsum(sizes)[:-1]) if len(sizes) else []):
                ids = np.append(ids, kind.type(closing))
                for at in range(0, len(ids), LENGTH):
                    piece = ids[at : at + LENGTH]
                    size = -(-len(piece) // GRAIN)
                    rows.append(i)
                    for column, value in zip(columns, (at, len(piece), piece.tobytes(), len(ids), size, task, number, int(ranks[size])), strict=True):
                        column.append(value)
                    ranks[size] += 1
                    number += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            again = pa.array(rows, pa.int64())
            arrays = [*[batch.column(i).take(again) for i in kept], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [*[df.columns[i] for i in kept], *inner]
    types = (T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType())
    schema = T.StructType([df.schema.fields[i] for i in kept])
    for name, kind_ in zip(inner, types, strict=True):
        schema = schema.add(name, kind_)
    return saved(mapped(df, pieces, schema), "pieces")


def _kind(path: str) -> np.dtype:
    return np.dtype("<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4")


def _wide(narrow: pa.Array, kind: np.dtype) -> pa.Array:
    """Binary values with every number of the narrow type as four bytes."""
    sizes = np.append(0, np.cumsum(pc.binary_length(narrow).to_numpy(zero_copy_only=False).astype(np.int64)))
    numbers = np.frombuffer(b"".join(narrow.to_pylist()), kind).astype("<u4")
    offsets = (sizes * 4 // kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(narrow), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def packed(df: DataFrame, text: str, path: str, closing: int = CLOSING) -> DataFrame:
    """A row for each piece: the document's other columns and those in ADDED."""
    spark, kind = df.sparkSession, _kind(path)
    pieces = _encoded(df, text, path, closing)
    own = [c for c in df.columns if c != text]
    start, length, ids, tokens, size, task, number, rank = pieces.columns[len(own) :]
    before, at, sequence, slot, offset = fresh(pieces, "__before", "__at", "__sequence", "__slot", "__offset")

    histogram = pieces.groupBy(F.col(size).alias("size")).count().collect()
    whole, counts = LENGTH // GRAIN, {r["size"]: r["count"] for r in histogram}
    alone = counts.pop(whole, 0)
    sizes = np.array(sorted(counts), np.int64)
    layout = Layout.of(sizes, *rounded(sizes, np.array([counts[s] for s in sizes.tolist()], np.int64), whole), alone)

    # The rank over all tasks: counts of the tasks before this one, within the class.
    by_task = pieces.groupBy(size, task).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(size).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select(size, task, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    ranked = pieces.join(broadcast_if_small(by_task), [size, task]).withColumn(rank, F.col(before) + F.col(rank)).drop(before)
    out = [*own, start, length, ids, tokens]

    singles = ranked.where(F.col(size) == whole).select(*out, F.col(rank).alias(sequence), F.lit(0).cast("bigint").alias(offset))

    taken = F.create_map(*[F.lit(x) for pair in layout.taken.items() for x in pair]) if layout.taken else F.create_map()
    has_place = F.col(rank) < F.coalesce(F.element_at(taken.cast("map<int,bigint>"), F.col(size)), F.lit(0))
    rests = ranked.where(F.col(size) != whole)

    shipped(spark)

    @F.pandas_udf("struct<sequence: bigint, slot: bigint>")
    def placed(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        where = layout.place(sizes.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence": where[0], "slot": where[1]})

    fitted = rests.where(has_place).withColumn(at, placed(size, rank))
    fitted = fitted.select(*out, F.col(f"{at}.sequence").alias(sequence), F.col(f"{at}.slot").alias(slot))
    within = Window.partitionBy(sequence).orderBy(slot)
    fitted = fitted.withColumn(offset, F.sum(length).over(within) - F.col(length)).select(*out, sequence, offset)

    # The line: tasks one behind another, each with its rests in order.
    loose = rests.where(~has_place)
    lengths = loose.groupBy(task).agg(F.sum(length).alias("n"))
    total = lengths.agg(F.sum("n")).first()[0] or 0
    lengths = lengths.select(task, (F.sum("n").over(Window.orderBy(task)) - F.col("n")).alias(before))
    along = Window.partitionBy(task).orderBy(number)
    line = loose.withColumn(at, F.sum(length).over(along) - F.col(length)).join(broadcast_if_small(lengths), task)
    line = line.select(*out, F.lit(None).cast("bigint").alias(sequence), (F.col(at) + F.col(before)).alias(offset))
    found = singles.unionByName(fitted).unionByName(line)
    first, n_own, names = layout.sequences, len(own), found.columns

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces without a sequence are those on the line, which are cut; ids get their full width. One function for all
        branches, so that a task needs one worker and its memory."""
        for batch in slices(batches, n_own + 2):
            columns = batch.columns
            if columns[n_own + 4].null_count:
                rows, cut = [], [[] for _ in range(6)]
                for i, row in enumerate(zip(*(c.to_pylist() for c in columns[n_own:]), strict=True)):
                    begins, n, data, doc, known, where = row
                    for a, b, seq, off in _cut(where, n, total, LENGTH) if known is None else [(0, n, known - first, where)]:
                        rows.append(i)
                        for column, value in zip(cut, (begins + a, b - a, data[a * kind.itemsize : b * kind.itemsize], doc, first + seq, off), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                again = pa.array(rows, pa.int64())
                columns = [*[c.take(again) for c in columns[:n_own]], *[pa.array(c, k) for c, k in zip(cut, kinds, strict=True)]]
            columns[n_own + 2] = _wide(columns[n_own + 2], kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = mapped(found, finished, found.schema)
    values = map(F.col, (start, length, ids, tokens, sequence, offset))
    return found.select(*own, *[v.cast(t).alias(n) for v, t, n in zip(values, ADDED.values(), fresh(df.drop(text), *ADDED), strict=True)])
