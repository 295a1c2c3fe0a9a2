"""Records that share most of their word runs, by universe-partition pigeonhole.

A record is the set of its runs of successive words. Sets are told apart by size bands; in a band all possible runs are hashed
into a fixed number of segments. Two sets of similarity t differ in at most (1 - t) / (1 + t) of their summed sizes, H. If the
larger one is allotted more than H units on its segments, one unit for "this segment is equal", two for "equal, or one run
more or less", then a pair with more unmet units than H can't be similar. Segments are indexed as they are and with each one run
taken out (the one-deletion neighbourhood); the units go to the segments by their estimated cost, the number of strangers that
would be met there, so that frequent runs are probed in no or in large segments only.

With SLACK units beyond H + 1 a similar pair meets at least SLACK + 1 times, which few strangers do (fewer if a set has fewer
units to give). Pairs that do are
verified on the sets themselves. Only packed arrays travel. A bucket is of one table and band, so that a set is in few of them, and
gets what is told of a set (code, size, sketch) once; its signatures follow in slots that are met one after the other.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bloom import one_of
from marlstone.llm.canonical import canonical_array
from marlstone.llm.pairing import pairs_within
from marlstone.session import settle

RUN, THRESHOLD, LEAST_WORDS = 5, 0.8, 20
SLACK = 2
#: Sizes of band k are BAND * 4 ** k up to four times that; its segments are so many that the largest sets have LOAD runs in each.
BAND, LOAD = 16, 1.2
#: Costs are estimated from the run counts of sets chosen by hash, of about so many bytes together; every set is indexed.
SAMPLE_BYTES = 24 << 20
#: A bucket has the signatures of about so many bytes of runs, fewer where there would be fewer buckets than BUCKETS_A_CORE a core.
#: Its task holds what is told of its sets, and the signatures of one slot of about SLOT_BYTES at a time.
BUCKET_BYTES, SLOT_BYTES, BUCKETS_A_CORE = 96 << 20, 4 << 20, 2
#: Sketches of a bucket that take more bytes are in a file of the task.
HELD_BYTES = 32 << 20
#: Sets with too few units are compared with all sets in blocks of at most so many sets and bytes.
BLOCK_SETS, BLOCK_BYTES = 5000, 32 << 20
FAR = np.int16(32767)
#: A sketch has SKETCH bits a run at least: 64 * 2 ** width bits.
SKETCH = 2
WORD = re.compile(r"\w+")
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
CODE = (1 << 40) - 1
MASK40 = np.uint64(CODE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(29))


class WordCodes(dict):
    """A 64-bit code of each word, the same in all processes."""

    def __missing__(self, word: str) -> int:
        h = 0xCBF29CE484222325
        for b in word.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        if len(self) > 500_000:
            self.clear()
        self[word] = h
        return h


CODES = WordCodes()


def word_runs(texts: list[str], run: int, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, code of its word sequence, packed distinct 40-bit codes of its runs) of the texts long enough."""
    kept, words, many = [], [], []
    for i, text in enumerate(texts):
        if len(text) < 2 * least_words - 1:
            continue
        found = WORD.findall(text.lower())
        if len(found) >= max(least_words, run):
            kept.append(i)
            words += found
            many.append(len(found))
    if not kept:
        return
    n = np.array(many, np.int64)
    codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))
    ends = np.cumsum(n)
    h = codes[: len(codes) - run + 1].copy()
    for i in range(1, run):
        h = (h ^ (h >> np.uint64(31))) * M1 + codes[i : len(codes) - run + 1 + i]
    h = mix(h * M2)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) <= (ends - run)[owner[: len(h)]]
    h, owner, place = h[inside], owner[: len(h)][inside], (np.arange(len(h)) - (ends - n)[owner[: len(h)]])[inside]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    seq = np.bitwise_xor.reduceat(mix(h * M2 + mix((place + 1).astype(np.uint64) * M1)), first) ^ mix(n.astype(np.uint64) * M2)
    # distinct runs of each text, in order
    h &= MASK40
    order = np.argsort(owner.astype(np.uint64) << np.uint64(40) | h)
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    h, owner = h[new], owner[new]
    packed, cut = pack40(h), np.searchsorted(owner, np.arange(len(n) + 1)) * 5
    for k, i in enumerate(kept):
        yield i, int(seq[k].view(np.int64)), packed[cut[k] : cut[k + 1]]


def pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def pack28(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest 28 bits: three bytes each, and four bits of two in a byte. Within a bucket so many tell nearly all apart."""
    low = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :3].ravel()
    four = np.r_[(x >> np.uint64(24) & np.uint64(15)).astype(np.uint8), np.zeros(len(x) % 2, np.uint8)]
    return low, four[::2] | four[1::2] << 4


def unpack28(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    b = low.reshape(-1, 3).astype(np.uint32)
    four = np.stack([high & 15, high >> 4], axis=1).ravel()[: len(b)].astype(np.uint32)
    return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16 | four << 24


def _sets(recs: DataFrame, run: int, least_words: int) -> DataFrame:
    """kind 0: (tbl, id, seq) of every record long enough; kind 1: (tbl, seq, runs), once a task for equal word sequences."""
    names = ["kind", "tbl", "id", "seq", "runs"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            members, sets = [], []
            tbls, ids = batch.column("tbl").to_pylist(), batch.column("id").to_pylist()
            for k, seq, runs in word_runs(canonical_array(batch.column("text")).to_pylist(), run, least_words):
                members.append((0, tbls[k], ids[k], seq, None))
                if (tbls[k], seq) not in seen:
                    seen.add((tbls[k], seq))
                    sets.append((1, tbls[k], None, seq, runs))
            columns = list(zip(*members, *sets)) if members else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int8(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    return recs.where("text is not null and id is not null").mapInArrow(read, "kind tinyint, tbl string, id bigint, seq bigint, runs binary")


class Rows:
    """Signature rows of many sets: signature, set, units' places, kind (0 segment, 1 with a run taken out), indexed or not."""

    def __init__(self, costs: tuple[np.ndarray, np.ndarray], threshold: Fraction) -> None:
        self.known, self.logs = costs
        self.t = threshold

    def most_unlike(self, large: np.ndarray, small: np.ndarray) -> np.ndarray:
        """H of sets of these sizes."""
        a = self.t.denominator - self.t.numerator
        return (large + small) * a // (self.t.denominator + self.t.numerator)

    def make(self, runs: np.ndarray, owner: np.ndarray, size: np.ndarray, space: np.ndarray, band: np.ndarray, low: bool) -> tuple:
        """Rows of the sets in the segments of `band`; low: probing from the band above, for smaller sets than any of its own."""
        segments = np.maximum((BAND * 4.0 ** (band + 1) / LOAD).astype(np.int64), 2)
        at = np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)
        often = self.known[at] == runs
        # frequent and rare runs are in segments of their own
        seg = (mix(runs * M1) % segments[owner].astype(np.uint64)).astype(np.int64) * 2 + often
        order = np.argsort(owner << 40 | seg)
        runs, owner, seg, at, often = runs[order], owner[order], seg[order], at[order], often[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])])
        many = np.diff(np.r_[first, len(runs)])
        log = np.where(often, self.logs[at], self.logs.min() - 1.0)
        whole, rarest = np.add.reduceat(log, first), np.minimum.reduceat(log, first)
        one = whole
        two = np.maximum(np.logaddexp(whole - rarest, whole), one)
        of = owner[first]
        # units in the order of their cost; a second unit never comes before the first
        seconds = np.flatnonzero(many > 1)
        seg_of = np.concatenate([np.arange(len(first)), seconds])
        second = np.arange(len(seg_of)) >= len(first)
        cost = np.concatenate([one, two[seconds]])
        spread = (cost - cost.min()) / max(float(cost.max() - cost.min()), 1e-9) * ((1 << 30) - 1)
        unit_of = of[seg_of]
        order = np.argsort(unit_of << 32 | spread.astype(np.int64) << 1 | second)
        sorted_of = unit_of[order]
        start = np.searchsorted(sorted_of, np.arange(len(size) + 1))
        place = np.arange(len(order)) - start[sorted_of]
        capacity = np.diff(start)
        limit = (BAND * 4 ** (band + 1)).astype(np.int64)  # the band's sizes end below
        h = self.most_unlike(size, np.minimum(size, limit - 1) if low else size)
        wanted = place < (h + 1 + SLACK)[sorted_of]
        place1, place2 = np.full(len(first), FAR, np.int32), np.full(len(first), FAR, np.int32)
        one_of, two_of = wanted & ~second[order], wanted & second[order]
        place1[seg_of[order[one_of]]], place2[seg_of[order[two_of]]] = place[one_of], place[two_of]
        token = mix(runs * M2)
        total = np.add.reduceat(token, first)
        name = mix((space[of].astype(np.uint64) * M1 + band[of].astype(np.uint64)) * M2 + seg[first].astype(np.uint64) * M3)
        sig_s = mix(name + total * M1)
        inner = np.repeat(np.arange(len(first)), many)
        multi = (many[inner] > 1)
        sig_d = mix(name[inner[multi]] + (total[inner[multi]] - token[multi]) * M1)
        sig = np.concatenate([sig_s, sig_d])
        rec = np.concatenate([of, of[inner[multi]]])
        p1 = np.concatenate([place1, np.full(len(sig_d), FAR, np.int32)])
        p2 = np.concatenate([place2, place2[inner[multi]]])
        # a place that every partner's H reaches needn't be told from the first
        least = np.ceil(size * float(self.t)).astype(np.int64)
        surely = np.minimum(self.most_unlike(size, least) + 1, capacity)[rec]
        p1, p2 = np.where(p1 < surely, 0, p1), np.where(p2 < surely, 0, p2)
        kind = np.repeat(np.array([0, 1], np.uint8), [len(sig_s), len(sig_d)])
        if low:
            use = (p1 < FAR) | (p2 < FAR)
            sig, rec, p1, p2, kind = sig[use], rec[use], p1[use], p2[use], kind[use]
        return sig, rec, p1, p2, kind | np.uint8(0 if low else 2), np.flatnonzero(capacity <= h), capacity


def sketches(runs: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, width of each set's sketch, its first word): parities of each set's runs by hash, 2 ** width words of 64 bits.

    Two sets differ in at least as many runs as their parities in bits. The halves of a sketch, put together by exclusive or, are
    the sketch of half as many words.
    """
    width = np.maximum(np.ceil(np.log2(np.maximum(size, 1) * SKETCH / 64)), 0).astype(np.int64)
    first = np.cumsum(1 << width) - (1 << width)
    bit = (mix(runs * M3) & ((np.uint64(64) << width[owner].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    words = np.zeros(int((1 << width).sum()), np.uint64)
    np.bitwise_xor.at(words, first[owner] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return words, width, first


def words_of(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The 2 ** width words from each of the places in `first`, one row a place."""
    return words[first[:, None] + np.arange(1 << width)]


def apart(words: np.ndarray, x: np.ndarray, y: np.ndarray, wide_x: np.ndarray, wide_y: np.ndarray) -> np.ndarray:
    """In how many runs at least the sets differ whose sketches begin at x and y."""
    out = np.zeros(len(x), np.int64)
    for key in np.unique(wide_x << 8 | wide_y).tolist():
        v, w = key >> 8, key & 255
        of, least = np.flatnonzero((wide_x == v) & (wide_y == w)), min(v, w)
        step = max(1, (1 << 20) >> max(v, w))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            one, two = (np.bitwise_xor.reduce(words_of(words, at[part], n).reshape(len(part), -1, 1 << least), axis=1) for at, n in ((x, v), (y, w)))
            out[part] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def bands(size: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log2(np.maximum(size, 1) / BAND) / 2), 0).astype(np.int64)


def _allotted(sets: DataFrame) -> tuple[dict[tuple[int, int], tuple[int, int]], int, int, int]:
    """(first bucket and their number for each table and band, number of buckets, of slots, bytes of runs in all)."""
    size = F.length("runs") / 5
    band = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)) / BAND) / 2), F.lit(0)).cast("int")
    cells = sorted((table_code(r.tbl), r.band, r.n) for r in sets.groupBy("tbl", band.alias("band")).agg(F.sum(F.length("runs")).alias("n")).collect())
    total = sum(n for _, _, n in cells)
    most = max(min(BUCKET_BYTES, total // (BUCKETS_A_CORE * sets.sparkSession.sparkContext.defaultParallelism)), 1)
    allotted, buckets, room = {}, 0, 0
    for space, k, n in cells:
        if n <= room:  # small ones share a bucket
            allotted[space, k], room = (buckets - 1, 1), room - n
        else:
            many = -(-n // most)
            allotted[space, k] = (buckets, many)
            buckets, room = buckets + many, most - n if many == 1 else 0
    return allotted, max(buckets, 1), -(-most // SLOT_BYTES), total


def _signatures(sets: DataFrame, costs: tuple[np.ndarray, np.ndarray], threshold: Fraction, allotted: dict[tuple[int, int], tuple[int, int]], slots: int) -> DataFrame:
    """(bucket, slot, pack): what is told of the sets in slot -1, their signature rows in the others; bucket -1 names sets with too few units."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Rows(costs, threshold)
        press = zstandard.ZstdCompressor(level=3)

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            size = np.array([len(r) // 5 for _, _, r in held], np.int64)
            seq = np.array([s for _, s, _ in held], np.int64)
            space = np.array([table_code(t) for t, _, _ in held], np.int64)
            runs, owner = unpack40(b"".join(r for _, _, r in held)), np.repeat(np.arange(len(held)), size)
            band = bands(size)
            parts = [maker.make(runs, owner, size, space, band, False)]
            words, width, first = sketches(runs, owner, size)
            name = np.bitwise_xor.reduce(mix(seq.view(np.uint64) * M1 + mix(space.astype(np.uint64) * M2))).reshape(1)
            # smaller partners may be in the band below
            t = float(threshold)
            reach = np.flatnonzero((band > 0) & (np.ceil(size * t) < BAND * 4.0**band))
            if len(reach):
                index = np.full(len(held), -1)
                index[reach] = np.arange(len(reach))
                mine = index[owner] >= 0
                got = maker.make(runs[mine], index[owner[mine]], size[reach], space[reach], band[reach] - 1, True)
                # in the space below they are sets of their own, with their own units
                parts.append((got[0], got[1] + len(held), *got[2:5], reach[got[5]], got[6]))
                seq, size, space, band, width, first = (np.r_[x, x[reach]] for x in (seq, size, space, band, width, first))
                band[len(held) :] -= 1
            # units beyond those that any partner's H reaches needn't be told from them
            most = maker.most_unlike(size, size) + 1 + SLACK
            lacking = most - np.minimum(np.concatenate([p[6] for p in parts]), most)
            sig, rec, p1, p2, kind = (np.concatenate([p[i] for p in parts]) for i in range(5))
            cells, cell = np.unique(space << 8 | band, return_inverse=True)
            begin, many = np.array([allotted.get((c >> 8, c & 255), (0, 1)) for c in cells.tolist()], np.int64).T
            bucket = begin[cell][rec] + ((sig >> np.uint64(40)).astype(np.int64) % many[cell][rec])
            slot = ((sig & np.uint64((1 << 28) - 1)) * np.uint64(slots) >> np.uint64(28)).astype(np.int64)
            # by set and place, which packs well; the signatures' own order is found where they meet
            order = np.argsort((bucket * slots + slot) << 44 | rec << 17 | kind.astype(np.int64) << 15 | np.minimum(p1, p2).astype(np.int64) & 0x7FFF)
            sig, rec, p1, p2, kind, bucket, slot = (x[order] for x in (sig, rec, p1, p2, kind, bucket, slot))
            out = []
            fit = lambda x: x.astype(np.uint16 if x.max(initial=0) < 65536 else np.uint32)
            for k in np.unique(bucket).tolist():
                a, b = np.searchsorted(bucket, [k, k + 1])
                mark = np.zeros(len(size), bool)
                mark[rec[a:b]] = True
                own, local = np.flatnonzero(mark), np.cumsum(mark) - 1
                wide = width[own]
                # sketches of each width apart
                kinds = [words_of(words, first[own[wide == w]], w).ravel() for w in range(int(wide.max()) + 1)]
                codes = np.frombuffer(pack40(seq[own].view(np.uint64) & MASK40), np.uint8)
                out.append((k, -1, press.compress(freeze([name, codes, fit(size[own]), fit(lacking[own]), wide.astype(np.uint8), *kinds]))))
                cut = a + np.searchsorted(slot[a:b], np.arange(slots + 1))
                for j, (c, d) in enumerate(zip(cut, cut[1:])):
                    if d > c:
                        out.append((k, j, press.compress(freeze([name, *pack28(sig[c:d]), fit(local[rec[c:d]]), fit(p1[c:d]), fit(p2[c:d]), kind[c:d]]))))
            short = np.unique(np.concatenate([p[5] for p in parts]))
            if len(short):
                out.append((-1, 0, press.compress(freeze([seq[short] & CODE]))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "slot", "pack"])

        held, n = [], 0
        for batch in batches:
            for t, s, r in zip(batch.column("tbl").to_pylist(), batch.column("seq").to_pylist(), batch.column("runs").to_pylist()):
                held.append((t, s, r))
                n += len(r)
                if n > 5_000_000:  # a million runs at a time
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return sets.select("tbl", "seq", "runs").mapInArrow(make, "bucket int, slot int, pack binary")


def table_code(name: str) -> int:
    return CODES[name] & 0x7FFFFFFF


def freeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one string: dtype, shape, bytes of each."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        rows = a.shape[0] if a.ndim == 2 else 0
        out += [a.dtype.str.encode().ljust(4), rows.to_bytes(2, "little"), a.nbytes.to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def thaw(b: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(b[0]):
        kind, rows, n = b[at : at + 4].decode().strip(), int.from_bytes(b[at + 4 : at + 6], "little"), int.from_bytes(b[at + 6 : at + 14], "little")
        a = np.frombuffer(b, np.dtype(kind), n // np.dtype(kind).itemsize, at + 14)
        out.append(a.reshape(rows, -1) if rows else a)
        at += 14 + n
    return out


class Told:
    """What is told of the sets of a bucket."""

    def __init__(self, packs: list[bytes], threshold: Fraction) -> None:
        press, tables, n, m = zstandard.ZstdDecompressor(), [], 0, 0
        self.base: dict[int, int] = {}
        file, held, kept = None, [], 0
        for p in packs:
            name, codes, size, lacking, wide, *kinds = thaw(press.decompress(p))
            flat, first = np.concatenate(kinds), np.zeros(len(size), np.int64)
            for w, at in enumerate(np.cumsum([0, *map(len, kinds)])[:-1]):
                of = np.flatnonzero(wide == w)
                first[of] = at + (np.arange(len(of)) << w)
            self.base[int(name[0])] = n
            tables.append((unpack40(codes.tobytes()).astype(np.int64), size.astype(np.int32), lacking.astype(np.int32), wide, first + m))
            n, m = n + len(size), m + len(flat)
            held.append(flat)
            kept += flat.nbytes
            if kept > HELD_BYTES:
                file = file or tempfile.TemporaryFile()
                for x in held:
                    file.write(x)
                held, kept = [], 0
        self.code, self.size, lacking, self.wide, self.first = (np.concatenate(x) for x in zip(*tables))
        both = threshold.denominator + threshold.numerator
        self.capacity = 2 * self.size.astype(np.int64) * (threshold.denominator - threshold.numerator) // both + 1 + SLACK - lacking
        if file:
            for x in held:
                file.write(x)
            file.flush()
            self.words = np.memmap(file, np.uint64, "r", shape=(m,))
        else:
            self.words = np.concatenate(held)


def meet(told: Told, packs: list[bytes], threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(larger set, smaller set, units met, units to meet) of one slot of a bucket, in chunks."""
    press = zstandard.ZstdDecompressor()
    parts = []
    for p in packs:
        name, low, high, rec, p1, p2, kind = thaw(press.decompress(p))
        parts.append((unpack28(low, high), rec.astype(np.int32) + np.int32(told.base[int(name[0])]), p1.astype(np.int32), p2.astype(np.int32), kind))
    sig, rec, p1, p2, kind = (np.concatenate([p[i] for p in parts]) for i in range(5))
    del parts
    order = np.argsort(sig)
    sig = sig[order]
    # most signatures are one set's alone
    same = sig[1:] == sig[:-1]
    alone = ~(np.r_[False, same] | np.r_[same, False])
    order, sig = order[~alone], sig[~alone]
    if not len(sig):
        return
    order = order[np.lexsort((kind[order], told.size[rec[order]], told.code[rec[order]], sig))]
    sig, rec, p1, p2, kind = np.sort(sig), rec[order], p1[order], p2[order], kind[order]
    code, size = told.code[rec], told.size[rec].astype(np.int64)
    # equal word sequences read by several tasks are one set
    new = np.r_[True, (sig[1:] != sig[:-1]) | (code[1:] != code[:-1]) | (size[1:] != size[:-1]) | (kind[1:] != kind[:-1])]
    sig, rec, p1, p2, kind, code, size = (x[new] for x in (sig, rec, p1, p2, kind, code, size))
    capacity = told.capacity[rec]
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    length = np.diff(np.r_[begin, len(sig)])
    group = np.repeat(np.arange(len(begin)), length)
    probes = np.flatnonzero(((p1 < FAR) | (p2 < FAR)) & (length[group] > 1))
    work = np.cumsum(length[group[probes]])
    at = 0
    low, high = threshold.numerator, threshold.denominator
    while at < len(probes):
        # about a million comparisons at a time
        to = int(np.searchsorted(work, (work[at - 1] if at else 0) + 1_000_000, side="right"))
        to = max(to, at + 1)
        pr = probes[at:to]
        at = to
        n = length[group[pr]]
        r = np.repeat(pr, n)
        s = np.repeat(begin[group[pr]] - (np.cumsum(n) - n), n) + np.arange(len(r))
        ok = (kind[s] & 2 > 0) & (kind[r] & kind[s] & 1 == 0) & ((size[s] < size[r]) | (size[s] == size[r]) & (code[s] < code[r])) & (size[s] * high >= size[r] * low)
        r, s = r[ok], s[ok]
        h = (size[r] + size[s]) * (high - low) // (high + low)
        reach = np.minimum(h + 1 + SLACK, capacity[r])
        both = (kind[r] | kind[s]) & 1 == 0
        met = np.where(both, (p1[r] < reach).astype(np.int32) + (p2[r] < reach), (p2[r] < reach).astype(np.int32))
        hit = np.flatnonzero(met > 0)
        r, s, met, h, reach = r[hit], s[hit], met[hit], h[hit], reach[hit]
        x, y = rec[r], rec[s]
        ok = apart(told.words, told.first[x], told.first[y], told.wide[x].astype(np.int64), told.wide[y].astype(np.int64)) <= h
        yield code[r][ok], code[s][ok], met[ok].astype(np.int64), (reach - h)[ok]


def _candidates(signatures: DataFrame, threshold: Fraction, buckets: int) -> DataFrame:
    """(a, b): codes of pairs that met as many units as they have to; a = b names a set with too few units."""

    def gather(told: Told, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in meet(told, packs, threshold):
            held.append(part)
            n += len(part[0])
            if n > 1_000_000:
                yield listed(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield listed(*(np.concatenate(x) for x in zip(*held)))

    def listed(a: np.ndarray, b: np.ndarray, met: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        """One row a larger set: its partners, each as often as units were met."""
        order = np.lexsort((a, need))
        a, b, need, met = a[order], b[order], need[order], met[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (need[1:] != need[:-1])]) if len(a) else np.zeros(0, np.int64)
        many = np.add.reduceat(met, first) if len(a) else met
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(need[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(np.repeat(b, met)))], names=["a", "need", "bs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, told = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal told
            if now[0] == -1:
                for p in packs:
                    code = thaw(zstandard.ZstdDecompressor().decompress(p))[0]
                    yield listed(code, code, np.ones(len(code), np.int64), np.ones(len(code), np.int64))
            elif now[1] == -1:
                told = None
                told = Told(packs, threshold)
            else:
                yield from gather(told, packs)

        for batch in batches:
            # packs stay where Arrow has them
            for k, j, p in zip(batch.column("bucket").to_pylist(), batch.column("slot").to_pylist(), map(pa.BinaryScalar.as_buffer, batch.column("pack"))):
                if (k, j) != now and packs:
                    yield from done()
                    packs = []
                now = (k, j)
                packs.append(p)
        if packs:
            yield from done()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            a, need = batch.column("a").to_numpy(zero_copy_only=False), batch.column("need").to_numpy(zero_copy_only=False)
            lists = batch.column("bs")
            many = np.diff(lists.offsets.to_numpy())
            rows = (np.repeat(a, many), lists.flatten().to_numpy(zero_copy_only=False), np.repeat(need, many))
            if kept is not None:
                rows = tuple(np.concatenate(x) for x in zip(kept, rows))
            # the last set may go on in the next batch
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            kept = tuple(x[cut:] for x in rows)
            yield enough(*(x[:cut] for x in rows))
        if kept is not None:
            yield enough(*kept)

    def enough(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        ok = first[np.diff(np.r_[first, len(a)]) >= need[first]]
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    # a partition a bucket: the signatures that a task reads don't grow with the input
    met = signatures.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket", "slot").mapInArrow(run, "a bigint, need int, bs array<bigint>")
    return met.repartition("a").sortWithinPartitions("a").mapInArrow(count, "a bigint, b bigint")


def _costs(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that more than one set of a sample has, and the logarithm of their share; bounded by the sample's bytes."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    rows = sets.where(F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("tbl", "seq", "runs").toArrow()
    rows = list({(t, s): r.as_buffer() for t, s, r in zip(rows.column("tbl").to_pylist(), rows.column("seq").to_pylist(), rows.column("runs"))}.values())
    if not rows:
        return np.zeros(1, np.uint64), np.zeros(1)
    runs, counts = np.unique(unpack40(b"".join(rows)), return_counts=True)
    seen = counts > 1
    if not seen.any():
        return np.zeros(1, np.uint64), np.array([-np.log(len(rows) + 1.0)])
    return runs[seen], np.log(counts[seen] / len(rows))


def similar_sets(recs: DataFrame, run: int = RUN, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members: tbl, id, seq) and (pairs: tbl, a, b, similarity) of the distinct word sequences alike enough."""
    spark = recs.sparkSession
    t = Fraction(str(threshold))
    read = settle(_sets(recs, run, least_words), "runs")
    members, sets = read.where("kind = 0").select("tbl", "id", "seq").distinct(), read.where("kind = 1").select("tbl", "seq", "runs")
    allotted, buckets, slots, total = _allotted(sets)
    costs = _costs(sets, total)
    candidates = settle(_candidates(_signatures(sets, costs, t, allotted, slots), t, buckets), "candidates")
    wanted = candidates.where("a <> b").select("a", "b")
    code = F.col("seq").bitwiseAND(F.lit(CODE))
    # only the sets of candidates travel from here on
    needed = sets.withColumn("code", code).where(one_of(wanted.select(F.explode(F.array("a", "b")).alias("code")))("code")).repartition("code").groupBy("code", "tbl", "seq").agg(F.first("runs").alias("runs"))
    left, right = needed.select("tbl", F.col("code").alias("a"), F.col("seq").alias("seq_a"), F.col("runs").alias("x")), needed.select(F.col("tbl").alias("tbl_2"), F.col("code").alias("b"), F.col("seq").alias("seq_b"), F.col("runs").alias("y"))
    pairs = _verified(wanted.join(left, "a").join(right, "b").where("tbl = tbl_2").select("tbl", F.col("seq_a").alias("a"), F.col("seq_b").alias("b"), "x", "y"), threshold)
    if not (short := candidates.where("a = b").select(F.col("a").alias("code")).distinct()).isEmpty():
        pairs = pairs.unionByName(_against_all(sets, sets.withColumn("code", code).join(short, "code", "left_semi").select("seq").distinct(), threshold)).distinct()
    return members, pairs


def jaccard(x: bytes, y: bytes) -> float:
    a, b = unpack40(x), unpack40(y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            alike = np.array([jaccard(x, y) for x, y in zip(xs, ys)])
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            # the larger one first; of the same size, the one of the larger sequence
            turned = np.array([(len(y), j) > (len(x), i) for x, y, i, j in zip(xs, ys, a.tolist(), b.tolist())], bool)
            columns = [batch.column("tbl"), pa.array(np.where(turned, b, a)), pa.array(np.where(turned, a, b)), pa.array(alike)]
            yield pa.RecordBatch.from_arrays(columns, names=["tbl", "a", "b", "similarity"]).filter(pa.array(alike >= threshold))

    return pairs.mapInArrow(check, "tbl string, a bigint, b bigint, similarity double")


def _against_all(sets: DataFrame, short: DataFrame, threshold: float) -> DataFrame:
    """The sets whose runs crowd into too few segments, as a stated query set against all sets, block by block."""
    rare = settle(sets.join(short, "seq", "left_semi").groupBy("tbl", "seq").agg(F.first("runs").alias("runs")), "short")
    n, size = rare.agg(F.count("*"), F.coalesce(F.sum(F.length("runs")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_SETS), -(-size // BLOCK_BYTES), 1)

    def against(queries: list[tuple[str, int, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t, s, r in zip(batch.column("tbl").to_pylist(), batch.column("seq").to_pylist(), batch.column("runs").to_pylist()):
                    for qt, q, x in queries:
                        if t == qt and s != q and min(len(r), len(x)) >= threshold * max(len(r), len(x)) and (v := jaccard(x, r)) >= threshold:
                            a, b = ((q, s) if (len(x), q) > (len(r), s) else (s, q))
                            out.append((t, a, b, v))
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["tbl", "a", "b", "similarity"])

        return check

    found = None
    for k in range(blocks):
        block = rare.where(F.pmod(F.xxhash64("seq"), F.lit(blocks)) == k)
        queries = [(r.tbl, r.seq, bytes(r.runs)) for r in block.collect()]
        part = settle(sets.mapInArrow(against(queries), "tbl string, a bigint, b bigint, similarity double").distinct(), "block")
        found = part if found is None else found.unionByName(part)
    return found


def similar_pairs(recs: DataFrame, **how) -> DataFrame:
    """(tbl, id_1, id_2), id_1 < id_2: records of one table whose sets of word runs have at least the threshold's similarity.

    recs has tbl, id and text. Null texts and ids and texts below the least number of words never count; rows that repeat an
    id are one record; records of one word sequence are one set and stand for each other at the end. An empty table gives no row.
    """
    members, pairs = similar_sets(recs, **how)
    one, two = members.select("tbl", F.col("seq").alias("a"), F.col("id").alias("i")), members.select("tbl", F.col("seq").alias("b"), F.col("id").alias("j"))
    across = pairs.select("tbl", "a", "b").join(one, ["tbl", "a"]).join(two, ["tbl", "b"]).select("tbl", "i", "j")
    copies = pairs_within(members, ["tbl", "seq"], "id", "i", "j").select("tbl", "i", "j")
    both = across.unionByName(copies).where("i <> j")
    return both.select("tbl", F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2")).distinct()


def groups(recs: DataFrame, **how) -> DataFrame:
    """(tbl, id, class_id, links, group_id): every record long enough, with the class of its word sequence and its links.

    class_id is the smallest id of the records of one word sequence, links the number of other classes it is similar to, and
    group_id the smallest class in the chain of links. Chains are followed by alternating large-star and small-star steps on
    tables in the shared folder, in a number of rounds that grows with the logarithm of the longest chain.
    """
    members, pairs = similar_sets(recs, **how)
    members = settle(members, "members")
    classes = members.groupBy("tbl", "seq").agg(F.min("id").alias("class_id"))
    of = lambda side, name: classes.select("tbl", F.col("seq").alias(side), F.col("class_id").alias(name))
    links = settle(pairs.select("tbl", "a", "b").join(of("a", "u"), ["tbl", "a"]).join(of("b", "v"), ["tbl", "b"]).where("u <> v").select("tbl", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    degree = links.select("tbl", F.explode(F.array("u", "v")).alias("class_id")).groupBy("tbl", "class_id").agg(F.count("*").alias("links"))
    joined = components(links)
    out = members.join(classes, ["tbl", "seq"]).join(degree, ["tbl", "class_id"], "left").join(joined, ["tbl", "class_id"], "left")
    return out.select("tbl", "id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))


def components(links: DataFrame) -> DataFrame:
    """(tbl, class_id, group_id) of the links (tbl, u, v), v < u: each node's smallest node in its component."""
    edges, before = links.select("tbl", "u", "v"), None
    while True:
        both = edges.unionByName(edges.select("tbl", F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest neighbour
        least = both.groupBy("tbl", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["tbl", "u"]).where("v > u").select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        down = large.groupBy("tbl", "u").agg(F.min("v").alias("m"))
        small = large.join(down, ["tbl", "u"]).select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("tbl", "u", F.col("m").alias("v"))).distinct()
        edges = settle(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("tbl", "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("tbl", F.col("u").alias("class_id")).agg(F.min("v").alias("group_id"))
        before = now
