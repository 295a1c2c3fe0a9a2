"""Long exact spans that stand in more than one text, by relative Lempel-Ziv parsing over distributed reference blocks.

A text's q-grams of smallest hash in each window are its anchors; a span of LEAST characters holds a whole window, so that two
texts that share one have an anchor in common there. The reference of an anchor are the blocks around it, MARGIN characters to
either side, of all texts that have it. They are indexed by their runs of LEAST characters, and each block is parsed against
them greedily, from position to position: what is known there is extended to the longest match with each reference block, a
factor. The parse against that block goes on where a run of LEAST characters reaches beyond the factor, so that a span across
its boundary is seen too. Factors that touch or overlap at the boundaries of blocks are one span of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.arrowkit import code_points, flat_bytes, slices
from marlstone.llm.bloom import one_of
from marlstone.llm.pairing import pairs_within
from marlstone.session import settle

LEAST = 200
Q, W = 100, 101  # q-gram and window; Q + W - 1 may be LEAST at most
MARGIN = LEAST - Q  # characters to either side of the q-gram that decide
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Anchors in more texts are spread over tasks by their windows instead of gathered.
HOT = 5000


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.r_[np.uint64(1), np.full(n, x, np.uint64).cumprod(dtype=np.uint64)] for x in (BASE, inverse))


def window_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position."""
    n = len(points)
    if n < q:
        return np.zeros(0, np.uint64)
    up, down = powers(1 << (n - 1).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
    h = (sums[q:] - sums[:-q]) * down[: n - q + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of each window of w, in two passes over blocks of w."""
    n = len(x)
    padded = np.r_[x, np.full(-n % w, fill, x.dtype)].reshape(-1, w)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - w + 1], ahead[w - 1 : n])


def anchors_of(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all texts, which begin at starts[:-1] and end at starts[1:]."""
    h = window_hashes(points, Q)
    if len(h) < W:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # of equal hashes in a window the last is the smallest, so that runs of one sign have few anchors
    key = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64))
    most = np.iinfo(np.uint64).max
    least = _sliding(key, W, np.minimum, most)
    inside = np.zeros(len(least) + 1, np.int64)  # windows that lie in one text
    size = np.diff(starts)
    has = size >= Q + W - 1
    np.add.at(inside, starts[:-1][has], 1)
    np.add.at(inside, (starts[1:] - (Q + W - 1) + 1)[has], -1)
    ok = np.cumsum(inside[:-1]) > 0
    at = np.unique((np.uint64((1 << 24) - 1) - (least[ok] & np.uint64((1 << 24) - 1))).astype(np.int64))
    return at, h[at]


def _anchors(texts: DataFrame) -> DataFrame:
    """(tid, anchor, pos) of (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from _anchor_rows(part)

    return texts.mapInArrow(run, "tid bigint, anchor bigint, pos int")


def _anchor_rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = flat_bytes(part.column("text"))
    points, begins = code_points(data)
    starts = offsets if begins is None else np.searchsorted(begins, offsets)
    tid = part.column("tid").to_numpy(zero_copy_only=False)
    limit = (1 << 24) - 1
    for a, b in ([(0, len(tid))] if len(points) < limit else [(i, i + 1) for i in range(len(tid))]):
        p, s = points[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        # one text beyond the key's positions is anchored in overlapping stretches
        step = limit - LEAST
        for k in range(0, max(len(p), 1), step):
            q = p[k : k + step + LEAST]
            at, h = anchors_of(q, s if len(p) <= limit else np.array([0, len(q)]))
            doc = np.searchsorted(s, at + k, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(tid[a + doc]), pa.array(h.view(np.int64)), pa.array((at + k - s[doc]).astype(np.int32))], names=["tid", "anchor", "pos"])
            if len(p) <= limit:
                break


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: A run of characters that several texts have.
SEVERAL = object()


class Reference:
    """The distinct reference blocks of one anchor, and which text holds each from which place on."""

    def __init__(self) -> None:
        self.holders: dict[str, list[tuple[int, int]]] = {}

    def add(self, block: str, tid: int, begin: int) -> None:
        if len(block) >= LEAST:
            self.holders.setdefault(block, []).append((tid, begin))

    def factors(self) -> Iterator[tuple[str, str, int, int, int]]:
        """(block, reference block, place, its place in the reference, length) of all factors, each two blocks parsed once."""
        index: dict[str, list[tuple[str, int]]] = {}
        alone = len(self.holders) == 1
        for block in self.holders:
            yield block, block, 0, 0, len(block)
            if alone:
                return
            behind: dict[tuple[str, int], int] = {}  # where the factor of a reference block and shift ends
            for p in range(len(block) - LEAST + 1):
                for other, q in index.get(block[p : p + LEAST], ()):
                    if p + LEAST > behind.get((other, q - p), 0):
                        n = LEAST + _common(block[p + LEAST :], other[q + LEAST :])
                        behind[other, q - p] = p + n
                        yield block, other, p, q, n
            for p in range(len(block) - LEAST + 1):
                index.setdefault(block[p : p + LEAST], []).append((block, p))

    def pairs(self) -> Iterator[tuple[int, int]]:
        """The texts that share a factor, the smaller one first."""
        for a, b, *_ in self.factors():
            xs, ys = self.holders[a], self.holders[b]
            for n, (t, _) in enumerate(xs):
                for u, _ in xs[:n] if a == b else ys:
                    if t != u:
                        yield (t, u) if t < u else (u, t)

    def covered(self) -> Iterator[tuple[int, int, int]]:
        """(text, begin, end) of the factors each text has with any other, without naming the other.

        Each block is parsed once against all of the reference: a factor goes on as long as its last LEAST characters stand
        in another text. The work grows with the blocks, not with the pairs of their holders.
        """
        known: dict[str, object] = {}
        owners = {block: {t for t, _ in held} for block, held in self.holders.items()}
        for block, tids in owners.items():
            mine = SEVERAL if len(tids) > 1 else next(iter(tids))
            if mine is SEVERAL and len(owners) == 1:
                yield from ((t, b, b + len(block)) for t, b in self.holders[block])
                return
            for p in range(len(block) - LEAST + 1):
                gram = block[p : p + LEAST]
                if known.setdefault(gram, mine) != mine:
                    known[gram] = SEVERAL
        for block, held in self.holders.items():
            at = None
            for p in range(len(block) - LEAST + 2):
                if p <= len(block) - LEAST and known[block[p : p + LEAST]] is SEVERAL:
                    at = p if at is None else at
                elif at is not None:
                    yield from ((t, b + at, b + p - 1 + LEAST) for t, b in held)
                    at = None


def _blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool, DataFrame]:
    """(members: tid, key), whether an anchor is hot, and (blocks: anchor, hot, tid, begin, block) of the anchors that several texts have."""
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.length(text) >= LEAST))
    rows = rows.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text, F.length(text)).alias("tid"))
    members = rows.select("tid", "doc").distinct()
    heads = members.groupBy("tid").agg(F.min("doc").alias("doc"))
    found = settle(_anchors(rows.select("tid", "text")), "anchors")
    several = found.groupBy("anchor").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("n")).where("a <> b").select("anchor", (F.col("n") > HOT).alias("hot"))
    places = settle(found.join(several, "anchor").select("tid", "anchor", "hot", "pos").distinct().groupBy("tid").agg(F.collect_list(F.struct("anchor", "hot", "pos")).alias("places")), "places")
    any_hot = not places.where(F.exists("places", lambda p: p["hot"])).isEmpty()
    # only texts with a shared anchor travel
    rows = rows.where(one_of(places.select("tid"))("tid"))
    read = places.join(heads, "tid").join(rows.select("doc", "tid", "text"), ["doc", "tid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, places, text in zip(batch.column("tid").to_pylist(), batch.column("places").to_pylist(), batch.column("text").to_pylist()):
                pos = [max(p["pos"] - MARGIN, 0) for p in places]
                blocks = [text[b : p["pos"] + Q + MARGIN] for b, p in zip(pos, places)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["anchor"] for p in places]), pa.array([p["hot"] for p in places]), pa.array([tid] * len(pos), pa.int64()), pa.array(pos, pa.int32()), pa.array(blocks)],
                    names=["anchor", "hot", "tid", "begin", "block"],
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in cut(batches):
            kept.append(b)
            n += b.num_rows
            if n > 4096:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, n = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return members, any_hot, read.select("tid", "places", "text").mapInArrow(gathered, "anchor bigint, hot boolean, tid bigint, begin int, block string")


def _parsed(blocks: DataFrame, parse: Callable[[Reference], Iterator[tuple]], kinds: dict[str, pa.DataType], shape: str) -> DataFrame:
    """What `parse` gives for the reference of each anchor that isn't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, reference = None, Reference()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

        def close(r: Reference) -> Iterator[pa.RecordBatch]:
            for f in parse(r):
                out.append(f)
                if len(out) >= 20_000:
                    yield flush()

        for batch in batches:
            for a, t, p, block in zip(*(batch.column(c).to_pylist() for c in ("anchor", "tid", "begin", "block"))):
                if a != now:
                    yield from close(reference)
                    now, reference = a, Reference()
                reference.add(block, t, p)
        yield from close(reference)
        yield flush()

    cold = blocks.where("not hot").select("anchor", "tid", "begin", "block")
    return cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, shape)


def _windows(blocks: DataFrame) -> DataFrame:
    """(tid, begins, x, y, before): all runs of LEAST characters around the hot anchors by two hashes, and the hash of the run one place before."""
    at = F.explode(F.sequence(F.lit(0), F.length("block") - LEAST)).alias("s")
    rows = blocks.where(F.col("hot") & (F.length("block") >= LEAST)).select("tid", "begin", "block", at)
    gram, before = F.expr(f"substring(block, s + 1, {LEAST})"), F.when(F.col("s") > 0, F.xxhash64(F.expr(f"substring(block, s, {LEAST})"), F.lit(7)))
    return rows.select("tid", (F.col("begin") + F.col("s")).alias("begins"), F.xxhash64(gram, F.lit(7)).alias("x"), F.xxhash64(gram).alias("y"), before.alias("before"))


def met(blocks: DataFrame, any_hot: bool) -> DataFrame:
    """(tid, other), tid < other: the texts that have a factor in common.

    Anchors of very many texts are spread: their runs of LEAST characters meet by equality, where a common stretch begins, in
    as many tasks as their number asks for.
    """
    cold = _parsed(blocks, lambda r: iter(set(r.pairs())), {"tid": pa.int64(), "other": pa.int64()}, "tid bigint, other bigint")
    if not any_hot:
        return cold
    windows = _windows(blocks).drop("begins").distinct()
    hot = pairs_within(windows, ["x", "y"], "tid", "tid", "other", lambda a, b: a["before"].isNull() | b["before"].isNull() | (a["before"] != b["before"]))
    return cold.unionByName(hot.select("tid", "other"))


def covers(blocks: DataFrame, any_hot: bool) -> DataFrame:
    """(tid, begins, ends): the stretches of each text that other texts have too; no pair of texts is made."""
    cold = _parsed(blocks, Reference.covered, {"tid": pa.int64(), "begins": pa.int32(), "ends": pa.int32()}, "tid bigint, begins int, ends int")
    if not any_hot:
        return cold
    windows = _windows(blocks).select("tid", "begins", "x", "y").distinct()
    several = windows.groupBy("x", "y").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b").select("x", "y")
    return cold.unionByName(windows.join(several, ["x", "y"], "left_semi").select("tid", "begins", (F.col("begins") + LEAST).alias("ends")))


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_1, key_2), key_1 < key_2: texts that share at least LEAST characters in a row, exactly as stored.

    Null ids and null texts give no pair, nor do texts below LEAST characters; rows that repeat an id are one text each.
    Equal texts are parsed once and stand for each other at the end.
    """
    members, any_hot, blocks = _blocks(docs, key, text)
    pairs = met(blocks, any_hot).distinct()
    one, two = members.select("tid", F.col("doc").alias("a")), members.select(F.col("tid").alias("other"), F.col("doc").alias("b"))
    across = pairs.join(one, "tid").join(two, "other").select("a", "b")
    copies = pairs_within(members, ["tid"], "doc", "a", "b").select("a", "b")
    both = across.unionByName(copies).where("a <> b")
    return both.select(F.least("a", "b").alias(f"{key}_1"), F.greatest("a", "b").alias(f"{key}_2")).distinct()


def shared_part(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars, shared_share, spans): how much of each text stands in another one too.

    One row per row with a text; spans are the disjoint stretches (begins, ends), factors that touch or overlap at their boundaries being one. A text of
    which there are copies is shared from end to end if it has LEAST characters. Null texts are left out; empty texts share nothing.
    """
    _, any_hot, blocks = _blocks(docs, key, text)
    both = covers(blocks, any_hot).distinct()
    by = Window.partitionBy("tid").orderBy("begins", "ends")
    far = F.max("ends").over(by.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum((F.coalesce(far, F.lit(-1)) < F.col("begins")).cast("int")).over(by)
    spans = both.select("tid", "begins", "ends", group.alias("g")).groupBy("tid", "g").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends"))
    spans = spans.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("begins", "ends"))).alias("spans"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.length(text).alias("n_chars"), F.xxhash64(text, F.length(text)).alias("tid"))
    copies = rows.where(F.col("n_chars") >= LEAST).groupBy("tid").agg(F.countDistinct(key).alias("copies"))
    whole = F.array(F.struct(F.lit(0).alias("begins"), F.col("n_chars").alias("ends")))
    all_of = rows.join(copies, "tid", "left").join(spans, "tid", "left").withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<begins:int,ends:int>>"))))
    shared = F.aggregate("spans", F.lit(0), lambda s, x: s + x["ends"] - x["begins"])
    return all_of.select(key, "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars")), F.lit(0.0)).alias("shared_share"), "spans")
