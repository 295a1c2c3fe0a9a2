"""Encoding with a public byte-level BPE vocabulary, in batched numpy merge rounds.

Pre-tokens are found on flat code-point arrays, every distinct pre-token of a slice is encoded once, and all of them are
merged together: their symbols stand in one flat array, adjacent pairs are looked up by binary search over the sorted pair
keys, and each round merges the lowest-ranked pair of every word.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.arrowkit import char_classes, code_points, flat_bytes, slices

FOLDER = "/opt/tokenizers"
#: Words of more bytes are merged with a heap: the rounds' work grows with the square of a word's length.
LONG_WORD = 256
NONE = np.int64(1) << 40


class ByteBpe:
    """Vocabulary and merge table of a byte-level BPE file (library tokenizers)."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the vocabulary has no such merge."""
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's offsets into it."""
        size = np.diff(offsets)
        counts = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # word of each id, id
        long = np.flatnonzero(size > LONG_WORD)
        for w in long:
            ids = self._long(data[offsets[w] : offsets[w + 1]])
            done.append((np.full(len(ids), w), ids))
        keep = np.repeat(size <= LONG_WORD, size)
        symbol, word = self.byte_ids[data[keep]], np.repeat(np.arange(len(size)), size)[keep]
        while len(symbol):
            same = word[1:] == word[:-1]
            rank = np.full(len(symbol), NONE)
            rank[:-1][same] = self.rank(symbol[:-1][same], symbol[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.r_[first, len(symbol)])
            least_of = np.repeat(least, span)
            over = least_of == NONE
            if over.any():
                done.append((word[over], symbol[over]))
                symbol, word, rank, least_of = symbol[~over], word[~over], rank[~over], least_of[~over]
                if not len(symbol):
                    break
            hit = rank == least_of
            # of equal pairs that overlap (a run of one symbol), every other one merges, from the left
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                begins = np.r_[True, np.diff(at) != 1]
                run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, word = symbol[left], word[left]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        of, ids = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(of, kind="stable")
        np.add.at(counts, of, 1)
        return ids[order].astype(np.int32), np.r_[0, np.cumsum(counts)]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One long word: a heap of pairs over a linked list, n log n."""
        symbol = self.byte_ids[data].tolist()
        n = len(symbol)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        table = self._table()
        heap = [(table[k], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (k := (symbol[i], symbol[i + 1])) in table]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], alive[j], after[i] = int(self.made[rank]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) >= 0 and (k := (symbol[p], symbol[q])) in table:
                    heapq.heappush(heap, (table[k], p, *k))
        return np.array([s for s, x in zip(symbol, alive) if x], np.int64)

    @cache  # noqa: B019 - one vocabulary per worker
    def _table(self) -> dict[tuple[int, int], int]:
        return {(int(k) >> 20, int(k) & 0xFFFFF): int(r) for k, r in zip(self.keys, self.ranks)}


@cache
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin, texts being split by the vocabulary's public pattern.

    Contractions; letters, numbers or other signs with at most one space before them; white space, whose last sign belongs to
    the word after it if it is a space and stands alone else.
    """
    points, begins = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes(points)
    edge = np.zeros(n + 1, bool)  # first code point of a text
    firsts = offsets[:-1][np.diff(offsets) > 0]
    edge[firsts if begins is None else np.searchsorted(begins, firsts)] = True
    edge[n] = True
    change = np.r_[True, kind[1:] != kind[:-1]] | edge[:-1]
    start = change.copy()
    # the last white space before a word of the same text
    white = kind == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:-1])
    start[last] = True
    spaced = last[points[last] == 32] + 1
    start[spaced] = False
    # contractions
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~edge[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        in_text = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = in_text & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        start = np.r_[start, True, True, True]
        start[quote[short | pair] + 1] = False
        start[quote[short] + 2] = True
        start[quote[pair & ~short] + 3] = True
        start = start[:n]
    at = np.flatnonzero(start)
    return at if begins is None else begins[at]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and each text's n + 1 offsets into it."""
    data, offsets = flat_bytes(texts)
    at = pre_tokens(data, offsets)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    ends = np.r_[at, len(data)].astype(np.int64)
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    index, distinct = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary
    word_offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    ids, id_offsets = vocabulary(path).words(np.frombuffer(distinct.buffers()[2], np.uint8)[word_offsets[0] : word_offsets[-1]], word_offsets - word_offsets[0])
    size = np.diff(id_offsets)[index]
    total = np.r_[0, np.cumsum(size)]
    out = ids[np.repeat(id_offsets[:-1][index] - total[:-1], size) + np.arange(total[-1])]
    return out, total[np.searchsorted(at, offsets)]


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file on the driver: the given path, else the installed package's folder."""
    if path:
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(FOLDER, name)


def shipped(spark: SparkSession, name: str, path: str | None) -> Callable[[], str]:
    """Hands the vocabulary file to all executors; its place there, to be asked for in a task."""
    place = tokenizer_file(name, path)
    spark.sparkContext.addFile(place)
    base = os.path.basename(place)
    return lambda: SparkFiles.get(base)


def encode(df: DataFrame, key: str, text: str | Column, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text by a byte-level BPE vocabulary, special tokens' strings being ordinary text.

    A null or empty text has the empty list. Rows, repeated keys and null keys stay as they are; other columns are left out.
    """
    place = shipped(df.sparkSession, name, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode_texts(part.column("text"), place())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=[key, "ids"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("key"), _column(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, key: str, text: str | Column, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """(key, tokens): the number of ids of each text; 0 for a null or empty one."""
    place = shipped(df.sparkSession, name, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, offsets = encode_texts(part.column("text"), place())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(offsets))], names=[key, "tokens"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("key"), _column(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
