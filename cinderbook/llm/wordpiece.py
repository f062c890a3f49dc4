"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link (where matching goes on when no child fits, after the longest
pieces so far are taken off the front) and the number of pieces taken off on the way. A word is counted in one pass over
its characters: the sum of these numbers is the number of greedy longest-match pieces, and no piece is ever built.

Defined results: a null or blank text has no words and no tokens; a word that the vocabulary cannot cover is one unknown
token, as in word-piece encoding; words of any length are taken whole; an empty table gives an empty result; other
columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cinderbook.llm.common import fresh, mapped, slices

# A word is a run of letters, marks and digits, or one other character that is no space.
WORD = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"

KEPT = 1 << 18  # counts of distinct words a task remembers at a time
LONG = 64  # characters of the longest word worth remembering


class Automaton:
    """starts: pieces that begin a word; goes_on: pieces that follow inside one. Both plain strings."""

    def __init__(self, starts: Iterable[str], goes_on: Iterable[str]):
        # Node 0 begins a word, node 1 stands inside one with nothing pending.
        self.child: list[dict[str, int]] = [{}, {}]
        ends = {}
        for root, pieces in ((0, starts), (1, goes_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                    node = self.child[node][c]
                if piece:
                    ends[node] = True
        # Breadth first: fail[v] is reached after popped[v] pieces are taken off; -1 where none fits.
        self.fail, self.popped = [-1] * len(self.child), [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if v in ends:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word, or -1 if the vocabulary cannot cover it."""
        child, fail, popped = self.child, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            while c not in child[node]:
                if fail[node] < 0:
                    return -1
                n += popped[node]
                node = fail[node]
            node = child[node][c]
        while node > 1:
            if fail[node] < 0:
                return -1
            n += popped[node]
            node = fail[node]
        return n


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word starts and word insides from a byte-level BPE vocabulary file, as ordinary strings.

    In such a file a piece with the mark of a leading space starts a word; any other piece may stand inside one. Single
    characters may do both. Pieces that are no whole characters are left out.
    """
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)
    pieces = [t for t in texts if "\ufffd" not in t and t not in special]
    starts = {t[1:] for t in pieces if t[0] == " " and len(t) > 1} | {t for t in pieces if len(t) == 1}
    return sorted(starts - {" "}), sorted({t for t in pieces if t[0] != " "})


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, sent) -> Automaton:
    """Built once per worker process and vocabulary."""
    if key not in _BUILT:
        _BUILT[key] = Automaton(*sent.value)
    return _BUILT[key]


def token_counts(df: DataFrame, text: str, starts: list[str], goes_on: list[str], lower: bool = False) -> DataFrame:
    """The rows with n_words, n_tokens and n_unknown (words that are one unknown token each) of their whole text."""
    names = fresh(df, "n_words", "n_tokens", "n_unknown")
    sent = df.sparkSession.sparkContext.broadcast((starts, goes_on))
    key = hashlib.sha256(repr((starts, goes_on)).encode()).hexdigest()
    place = df.columns.index(text)
    find = regex.compile(WORD).findall

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, sent)

        class Known(dict):
            def __missing__(self, word: str) -> int:
                n = automaton.count(word)
                if len(word) <= LONG:
                    self[word] = n
                return n

        known = Known()
        for batch in slices(batches, place):
            if len(known) > KEPT:
                known.clear()
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, value in enumerate(batch.column(place).to_pylist()):
                words = find(value.lower() if lower else value) if value else []
                pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                unknown = int((pieces < 0).sum())
                out[:, row] = len(words), pieces.sum() + 2 * unknown, unknown
            yield pa.record_batch([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *names])

    added = [T.StructField(c, T.LongType()) for c in names]
    return mapped(df, counts, T.StructType([*df.schema.fields, *added]))
