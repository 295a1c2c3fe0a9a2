"""Per-text statistics and the verdict whether a text is prose.

Texts are cut into chunks of CHUNK characters. Each chunk gives counts that add up, the state at its two edges (inside a word?),
the unfinished units before its first and after its last unit end, and the unfinished words at its edges; a unit is a line, or a
sentence within a line. Joining two neighbours adds the counts, corrects the word count where a word was cut, and judges the unit
and the word whose two pieces meet, whatever their length: the counts of a text don't depend on where it was cut. Partials are
joined in a tree of FAN branches a level; a text of one chunk never leaves its task. Finished units are judged many at a time on flat code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrowkit import char_classes, code_points, flat_bytes, slices, unmet
from marlstone.llm.canonical import canonical_array
from marlstone.session import settle

CHUNK = 1 << 15
FAN = 64
#: Least share of running sentences in prose.
PROSE_SHARE = 1 / 3
MOST_WORDS = 10_000
#: Characters that are counted together.
SLICE_CHARS = 1 << 20

COUNTS = ("n_chars", "n_space", "n_letters", "n_ascii_letters", "n_digits", "n_symbols", "n_words", "n_plain_words", "n_common_words", "n_lines", "n_closed_lines", "n_sentences", "sentence_chars", "bare_letters")
PARTIAL = ", ".join(f"{c} bigint" for c in COUNTS) + ", word_first boolean, word_last boolean, whole boolean, head string, tail string, first_token string, last_token string"

END = re.compile(r"\n|[.!?…]+[\"'”»)\]]*\s|[。！？]+[\"'”»」』）)\]]*\s?")
AROUND, INSIDE = "\"'“”„«»()[]*-–—•.,;:!?…", {ord(c): None for c in "'’-"}
HAN = re.compile(r"[㐀-鿿豈-﫿]")
CLOSED = re.compile(r"[.!?…。！？．][\"'”»)\]」』）]*\s*$")
# what a post may hold without saying anything: links, tags, addresses, figures with their signs and units
BARE = re.compile(r"(?:https?://|www\.)\S+|[$#@]\w+|[+-]?\d[\d.,]*(?:[kmb]|bn|mln|x|st|nd|rd|th|am|pm)?\b", re.IGNORECASE)
LETTER = re.compile(r"[^\W\d_]")


def common_words(words: DataFrame, column: str = "word") -> frozenset[str]:
    """The words of a fixed table of frequent function words, some hundred rows; more than MOST_WORDS are an error."""
    rows = words.where(F.col(column).isNotNull()).select(F.lower(F.trim(column)).alias("w")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return frozenset(r.w for r in rows if r.w)


def judge(unit: str, known: frozenset[str]) -> tuple[int, int, int, int]:
    """(plain words, common words, 1 if a running sentence, its characters) of one unit.

    A sentence has at least four words, half of them plain words, some of them small; a function word or a sentence end
    tells it from an enumeration, in which most words are followed by a comma. Han text is a sentence from six signs
    with an end or a comma.
    """
    size = len(unit.strip())
    if not unit.isascii() and (han := len(HAN.findall(unit))) >= 6 and han * 2 >= len(LETTER.findall(unit)):
        ok = CLOSED.search(unit) is not None or "," in unit
        return 0, 0, int(ok), size if ok else 0
    words = unit.split()
    plain = small = common = commas = 0
    for w in words:
        core = w.strip(AROUND)
        if not (core.isalpha() or core.translate(INSIDE).isalpha()):
            continue
        plain += 1
        common += core.lower() in known
        small += not core[0].isupper() or core.isupper()
        commas += w[-1] in ",;"
    n = len(words)
    ok = n >= 4 and plain * 2 >= n and small * 4 >= n and commas * 2 < n and (common > 0 or (small >= 3 and CLOSED.search(unit) is not None))
    return plain, common, int(ok), size if ok else 0


def units(text: str) -> list[str]:
    """The text cut behind every line end and sentence end; the last piece is unfinished.

    A sentence end at the very end of the text isn't final: what follows may belong to it.
    """
    out, start, n = [], 0, len(text)
    for m in END.finditer(text):
        e = m.end()
        if e == n and text[-1] != "\n":
            break
        out.append(text[start:e])
        start = e
    return [*out, text[start:]]


class Counts:
    """Counts of the finished units of one text."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known
        self.n = dict.fromkeys(UNIT_COUNTS, 0)

    def add(self, unit: str) -> None:
        if not unit:
            return
        for k, v in zip(("n_plain_words", "n_common_words", "n_sentences", "sentence_chars"), judge(unit, self.known)):
            self.n[k] += v
        if unit.endswith("\n"):
            self.n["n_lines"] += 1
            self.n["n_closed_lines"] += bool(CLOSED.search(unit))

    def onto(self, counts: dict) -> dict:
        return counts | {k: counts[k] + v for k, v in self.n.items()}


UNIT_COUNTS = ("n_plain_words", "n_common_words", "n_lines", "n_closed_lines", "n_sentences", "sentence_chars")


@lru_cache(maxsize=1 << 16)
def bare_letters(token: str) -> int:
    """Letters of a word that are no part of a link, a tag or a figure."""
    return len(LETTER.findall(BARE.sub(" ", token)))


BLANK, DECIMAL, LETTERISH, UPPER, LOWER, AROUND_IT, WITHIN, COMMA, NEAR_CLOSER, CLOSER, NEAR_MARK, FAR_MARK, MARK, ALPHA, HAN_SIGN = (1 << k for k in range(15))


class Traits:
    """Traits and small letters of code points, worked out where they are first met."""

    def __init__(self) -> None:
        self.kinds, self.small, self.met = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        self.signs = [(set(signs), trait) for signs, trait in ((AROUND, AROUND_IT), ("'’-", WITHIN), (",;", COMMA), ("\"'”»)]", NEAR_CLOSER), ("\"'”»)]」』）", CLOSER), (".!?…", NEAR_MARK), ("。！？", FAR_MARK), (".!?…。！？．", MARK))]

    def of(self, points: np.ndarray) -> np.ndarray:
        for i in unmet(points, self.met):
            c, kind = chr(i), 0
            if c.isspace():
                kind = BLANK
            elif c.isalnum():
                kind = (ALPHA * c.isalpha()) | (DECIMAL if c.isdecimal() else LETTERISH)
            kind |= (UPPER * c.isupper()) | (LOWER * (c.islower() or c.istitle() and not c.isupper())) | (HAN_SIGN * (0x3400 <= i <= 0x9FFF or 0xF900 <= i <= 0xFAFF))
            for signs, trait in self.signs:
                kind |= trait * (c in signs)
            self.kinds[i], self.met[i] = kind, True
            if len(low := c.lower()) == 1:
                self.small[i] = ord(low)
        return self.kinds[points]


@cache
def traits() -> Traits:
    return Traits()


def word_codes(points: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A 64-bit code of each word in small letters; 0 for one of more than `most` characters."""
    small = traits().small
    code = np.ones(len(first), np.uint64)
    for k in range(most):
        of = np.flatnonzero(size > k)
        code[of] = (code[of] ^ small[points[first[of] + k]]) * np.uint64(0x9E3779B97F4A7C15)
        code[of] ^= code[of] >> np.uint64(29)
    return np.where(size > most, np.uint64(0), code)


class Pieces:
    """Counts of many pieces of text, chunks or whole texts, on their flat code points."""

    def __init__(self, texts: list[str], known: frozenset[str]) -> None:
        self.texts = texts
        self.points = points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.cumsum([0, *map(len, texts)])
        self.kind = traits().of(points)
        # units end as END says, but at the very end of a text; each text's last unit is unfinished
        ends, text_of = self._ends()
        self.first_unit = np.r_[0, np.cumsum(np.bincount(text_of, minlength=len(texts)) + 1)]
        self.unit_at = np.r_[0, np.sort(np.concatenate([ends, self.at[1:]]), kind="stable")]
        self.cuts = self.unit_at[1:] - np.repeat(self.at[:-1], np.diff(self.first_unit))
        self.inked, self.closed, self.units = self._units(known)

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(ends of finished units, the text of each)."""
        kind, points, at, n = self.kind, self.points, self.at, len(self.points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.arange(n)
        found = [np.flatnonzero(points == 10) + 1]
        # a blank behind an end mark and what closes; any sign behind a far mark, a blank being taken in
        for closer, mark, far in ((NEAR_CLOSER, NEAR_MARK, False), (CLOSER, FAR_MARK, True)):
            if not (kind & mark).any():
                continue
            stop = np.r_[-1, np.maximum.accumulate(np.where(kind & closer == 0, place, -1))[:-1]]
            i = np.flatnonzero((kind & closer == 0 if far else kind & BLANK > 0) & (stop >= 0) & (kind[stop] & mark > 0))
            i = i[stop[i] >= at[np.searchsorted(at, i, side="right") - 1]]
            if far:
                i = i[(kind[i] & mark == 0) | (stop[i] < i - 1)]
            found.append(i + 1 if not far else i + (kind[i] & BLANK > 0))
        ends = np.unique(np.concatenate(found))
        of = np.searchsorted(at, ends - 1, side="right") - 1
        inner = (ends < at[of + 1]) | (points[ends - 1] == 10)
        return ends[inner], of[inner]

    def _sums(self, mask: np.ndarray) -> np.ndarray:
        return np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)]

    def _units(self, known: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(not blank, closed, UNIT_COUNTS as `judge` gives them) of each unit."""
        kind, points, at = self.kind, self.points, self.unit_at
        n, many = len(points), len(at) - 1
        if not n:
            return np.zeros(many, bool), np.zeros(many, bool), np.zeros((many, 6), np.int64)
        ink = kind & BLANK == 0
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(ink & (edge[:-1] | np.r_[True, ~ink[:-1]]))
        last = np.flatnonzero(ink & (edge[1:] | np.r_[~ink[1:], True]))
        unit = np.searchsorted(at, starts, side="right") - 1
        of_unit = lambda values: np.bincount(unit, values, minlength=many).astype(np.int64)
        # the core of each word: without the signs around it
        place = np.arange(n)
        core = ink & (kind & AROUND_IT == 0)
        if len(starts):
            a = np.minimum.reduceat(np.where(core, place, n), starts)
            b = np.maximum.reduceat(np.where(core, place, -1), starts)
        else:
            a = b = np.zeros(0, np.int64)
        has = b >= 0
        a, b = np.where(has, a, 0), np.where(has, b, -1)
        within = lambda sums: np.where(has, sums[b + 1] - sums[a], 0)
        odd = self._sums((kind & (ALPHA | WITHIN)) == 0)
        plain = has & (within(odd) == 0) & (within(self._sums(kind & ALPHA > 0)) > 0)
        of = np.flatnonzero(plain)
        small, common = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        small[of] = (kind[a[of]] & UPPER == 0) | (within(self._sums(kind & LOWER > 0))[of] == 0)
        most = max(map(len, known), default=0)
        if most:
            names = "".join(sorted(known))
            sizes = np.array([len(w) for w in sorted(known)])
            letters = np.frombuffer(names.encode("utf-32-le"), np.uint32)
            traits().of(letters)
            codes = np.unique(word_codes(letters, np.cumsum(sizes) - sizes, sizes, most))
            common[of] = np.isin(word_codes(points, a[of], (b - a + 1)[of], most), codes)
        words, n_plain, n_small, n_common = of_unit(None), of_unit(plain), of_unit(small), of_unit(common)
        commas = of_unit(plain & (kind[last] & COMMA > 0))
        # first and last sign of each unit, and whether it is closed
        inks = np.bincount(unit, minlength=many) > 0
        first, final = np.zeros(many, np.int64), np.full(many, -1, np.int64)
        first[unit[::-1]], final[unit] = starts[::-1], last
        size = np.where(inks, final - first + 1, 0)
        stop = np.maximum.accumulate(np.where(kind & CLOSER == 0, place, -1))
        mark = np.where(inks, stop[final], -1)
        closed = inks & (mark >= at[:-1]) & (kind[mark] & MARK > 0)
        ok = (words >= 4) & (n_plain * 2 >= words) & (n_small * 4 >= words) & (commas * 2 < words) & ((n_common > 0) | ((n_small >= 3) & closed))
        per = lambda mask: (lambda s: s[at[1:]] - s[at[:-1]])(self._sums(mask))
        han = per(kind & HAN_SIGN > 0)
        eastern = (han >= 6) & (han * 2 >= per(kind & LETTERISH > 0))
        ok = np.where(eastern, closed | (per(points == ord(",")) > 0), ok)
        line = np.zeros(many, bool)
        whole = at[1:] > at[:-1]
        line[whole] = points[at[1:][whole] - 1] == 10
        east = lambda x: np.where(eastern, 0, x)
        return inks, closed, np.stack([east(n_plain), east(n_common), line, line & closed, ok, np.where(ok, size, 0)], axis=1).astype(np.int64)

    def tokens(self, cut: bool) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """(words, bare letters, unfinished word at the start, at the end) of each piece; where pieces are cut, bare letters of the finished words."""
        kind, at, n, many = self.kind, self.at, len(self.points), len(self.texts)
        heads, tails = [""] * many, [""] * many
        if not n:
            return np.zeros(many, np.int64), np.zeros(many, np.int64), heads, tails
        ink = kind & BLANK == 0
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(ink & (edge[:-1] | np.r_[True, ~ink[:-1]]))
        ends = np.flatnonzero(ink & (edge[1:] | np.r_[~ink[1:], True])) + 1
        piece = np.searchsorted(at, starts, side="right") - 1
        words = np.bincount(piece, minlength=many)
        letters = self._sums(kind & LETTERISH > 0)
        bare = (letters[ends] - letters[starts]).astype(np.int64)
        # only words with letters and a sign of a link, a tag or a figure are asked for them
        p, low = self.points, traits().small[self.points]
        told = (kind & DECIMAL > 0) | (p == ord("$")) | (p == ord("#")) | (p == ord("@"))
        told[1:] |= ((p[:-1] == ord(":")) & (p[1:] == ord("/"))) | ((low[:-1] == ord("w")) & (p[1:] == ord(".")))
        told = self._sums(told)
        for i in np.flatnonzero((told[ends] > told[starts]) & (bare > 0)).tolist():
            t = int(piece[i])
            bare[i] = bare_letters(self.texts[t][starts[i] - at[t] : ends[i] - at[t]])
        begins, closes = np.searchsorted(piece, np.arange(many)), np.searchsorted(piece, np.arange(many), side="right") - 1
        for t in range(many) if cut else ():
            if words[t]:
                i, k = int(begins[t]), int(closes[t])
                if starts[i] == at[t]:
                    heads[t], bare[i] = self.texts[t][: ends[i] - at[t]], 0
                if ends[k] == at[t + 1] and (k > i or not heads[t]):
                    tails[t], bare[k] = self.texts[t][starts[k] - at[t] :], 0
        return words, np.bincount(piece, bare, minlength=many).astype(np.int64), heads, tails

    def partials(self) -> list[dict]:
        """The partial counts of each piece."""
        chars = char_counts(pa.array(self.texts, pa.large_string()))
        words, bare, heads, tails = self.tokens(True)
        sums = np.r_[np.zeros((1, 6), np.int64), np.cumsum(self.units, axis=0)]
        out = []
        for i, text in enumerate(self.texts):
            a, b = int(self.first_unit[i]), int(self.first_unit[i + 1])
            whole, c = b - a == 1, self.cuts[a:b].tolist()
            inner = dict(zip(UNIT_COUNTS, (sums[max(b - 1, a + 1)] - sums[a + 1]).tolist()))
            row = {k: int(v[i]) for k, v in chars.items()} | inner | {"n_words": int(words[i]), "bare_letters": int(bare[i]), "word_first": bool(text) and not text[0].isspace(), "word_last": bool(text) and not text[-1].isspace(), "whole": whole}
            out.append(row | {"head": text[: c[0]], "tail": "" if whole else text[c[-2] :], "first_token": heads[i], "last_token": tails[i]})
        return out

    def finished(self) -> dict[str, np.ndarray]:
        """The counts of each piece as a text of its own, as `close` gives them."""
        words, bare, _, _ = self.tokens(False)
        sums = np.r_[np.zeros((1, 6), np.int64), np.cumsum(self.units, axis=0)]
        per = dict(zip(UNIT_COUNTS, (sums[self.first_unit[1:]] - sums[self.first_unit[:-1]]).T))
        # the line that no line end closes
        last, none = self.first_unit[1:] - 1, per["n_lines"] == 0
        blank = ~self.inked[last] & (np.diff(self.first_unit) > 1) & none
        opened = self.inked[last] & (self.units[last, 2] == 0)
        per["n_lines"] = per["n_lines"] + (opened | blank)
        per["n_closed_lines"] = per["n_closed_lines"] + (opened & self.closed[last] | blank)
        return char_counts(pa.array(self.texts, pa.large_string())) | per | {"n_words": words, "bare_letters": bare}


def char_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of single characters, over all texts at once."""
    data, offsets = flat_bytes(texts)
    points, begins = code_points(data)
    kind = char_classes(points)
    at = offsets if begins is None else np.searchsorted(begins, offsets)
    total = lambda mask: np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][at])
    low = points | 32
    return {"n_chars": np.diff(at), "n_space": total(kind == 3), "n_letters": total(kind == 1), "n_ascii_letters": total((low >= 97) & (low <= 122) & (points < 128)), "n_digits": total(kind == 2), "n_symbols": total(kind == 0)}


def partial(text: str, known: frozenset[str]) -> dict:
    """The partial counts of one chunk."""
    return Pieces([text], known).partials()[0]


def _seam(left: str) -> int:
    """Where a unit end that goes on behind `left` would begin, left having none inside."""
    return len(left.rstrip().rstrip("\"'”»)]」』）").rstrip(".!?…。！？"))


def _meeting(left: str, right: str) -> list[str]:
    """units(left + right); left has no finished unit, right has at most one, which ends it."""
    text, out, start = left + right, [], 0
    for m in END.finditer(text, _seam(left)):
        if m.end() == len(text) and text[-1] != "\n":
            break
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]]


def join(a: dict, b: dict, known: frozenset[str]) -> dict:
    """Partial counts of two neighbours, a before b."""
    out = {k: a[k] + b[k] for k in COUNTS}
    out["n_words"] -= a["word_last"] and b["word_first"]
    c = Counts(known)
    # the cut may stand right behind a unit's end, or inside it
    pieces = _meeting(a["head"] if a["whole"] else a["tail"], b["head"])
    if not b["whole"] and len(pieces) > 1 and not pieces[-1]:
        pieces.pop()  # b's head was a finished unit
    closed = pieces if not b["whole"] else pieces[:-1]
    rest = b["tail"] if not b["whole"] else pieces[-1]
    head, whole = a["head"], False
    if a["whole"]:
        if closed:
            head, closed = closed[0], closed[1:]
        else:
            head, rest, whole = rest, "", True
    for u in closed:
        c.add(u)
    first, last, bare = _tokens(a, b)
    out["bare_letters"] += bare
    return c.onto(out) | {"word_first": a["word_first"] if a["n_chars"] else b["word_first"], "word_last": b["word_last"] if b["n_chars"] else a["word_last"], "whole": whole, "head": head, "tail": rest, "first_token": first, "last_token": last}


def _tokens(a: dict, b: dict) -> tuple[str, str, int]:
    """(unfinished word at the start, at the end, bare letters of the words that are finished now) of two neighbours."""
    if not a["n_chars"] or not b["n_chars"]:
        return a["first_token"] or b["first_token"], a["last_token"] or b["last_token"], 0
    one_a, one_b = len(a["first_token"]) == a["n_chars"], len(b["first_token"]) == b["n_chars"]
    left = a["first_token"] if one_a else a["last_token"]
    met = left + b["first_token"]
    if one_a and one_b:
        return met, "", 0
    if one_a:
        return met, b["last_token"], 0
    if one_b:
        return a["first_token"], met, 0
    return a["first_token"], b["last_token"], bare_letters(met)


def close(p: dict, known: frozenset[str]) -> dict:
    """The counts of a whole text: what is left at its two ends is judged."""
    c = Counts(known)
    c.add(p["head"])
    c.add(p["tail"])
    out = c.onto({k: p[k] for k in COUNTS})
    out["bare_letters"] += bare_letters(p["first_token"]) + bare_letters(p["last_token"])
    return _last_line(out, p["head"] if p["whole"] else p["tail"], p["whole"])


def _last_line(counts: dict, last: str, whole: bool) -> dict:
    """The line that no line end closes, `last` being what stands behind the last unit end."""
    if last.strip() and not last.endswith("\n"):
        counts["n_lines"] += 1
        counts["n_closed_lines"] += bool(CLOSED.search(last))
    elif not last.strip() and not whole and counts["n_lines"] == 0:
        counts["n_lines"] += 1
        counts["n_closed_lines"] += 1
    return counts


def whole_text(text: str, known: frozenset[str]) -> dict:
    return {k: int(v[0]) for k, v in Pieces([text], known).finished().items()}


def text_statistics(recs: DataFrame, keys: list[str], known: frozenset[str], text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(keys, counts, ratios, is_prose, is_bare): one row per row of recs that has a text.

    Ratios are english_ratio (ASCII letters and white space by all characters), digit_ratio, symbol_ratio (by characters that
    aren't white space), mean_word_length, closed_line_share, common_word_share (by plain words) and sentence_share. is_prose:
    running sentences make up at least a third of the text. is_bare: there are no letters besides links, tags and figures.
    `known` are the common words. Null and blank texts are left out; a row that repeats its keys gives a row each time; other
    columns are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in recs.select(*keys).schema}
    ks = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = recs.where(F.col(text).rlike(r"(?U)\S")).select(*keys, F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_row"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t", SLICE_CHARS):
                texts = canonical_array(part.column("_t")).to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                long = [(i, k) for i, t in enumerate(texts) if len(t) > chunk for k in range(-(-len(t) // chunk))]
                if short:
                    counts = Pieces([texts[i] for i in short], known).finished()
                    none = [pa.nulls(len(short), ARROW[c]) for c in EDGES]
                    yield batch_of(part, short, [0] * len(short), [0] * len(short), [*(pa.array(counts[c], pa.int64()) for c in COUNTS), *none])
                if long:
                    parts = Pieces([texts[i][k * chunk : (k + 1) * chunk] for i, k in long], known).partials()
                    yield batch_of(part, [i for i, _ in long], [(len(texts[i]) - 1) // chunk for i, _ in long], [k for _, k in long], [pa.array([p[c] for p in parts], t) for c, t in ARROW.items()])

    def batch_of(part: pa.RecordBatch, rows: list[int], last: list[int], number: list[int], counts: list[pa.Array]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int32())
        return pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in (*keys, "_row")), pa.array(last, pa.int32()), pa.array(number, pa.int32()), *counts], names=[*keys, "_row", "_last", "_part", *ARROW])

    partials = settle(rows.mapInArrow(count, f"{ks}, _row bigint, _last int, _part int, {PARTIAL}"))
    single = partials.where("_last = 0").select(*keys, *COUNTS)
    level = partials.where("_last > 0").select(*keys, "_last", "_row", "_part", *ARROW)
    by, shape = ("_row", "_part"), f"{ks}, _last int, _row bigint, _part int, {PARTIAL}"
    for _ in range(3):  # FAN ** 3 chunks are more than a string can hold

        def merge(pdf):
            pdf = pdf.sort_values("_from")
            rows = pdf[list(ARROW)].to_dict("records")
            done = rows[0]
            for r in rows[1:]:
                done = join(done, r, known)
            out = pdf.iloc[:1].drop(columns=["_from"]).copy()
            for k, v in done.items():
                out[k] = v
            return out[[*keys, "_last", "_row", "_part", *ARROW]]

        level = level.withColumn("_from", F.col("_part")).withColumn("_part", (F.col("_part") / FAN).cast("int")).groupBy(*by).applyInPandas(merge, shape)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [close(r, known) for r in batch.select(list(ARROW)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r[c] for r in rows], pa.int64()) for c in COUNTS)], names=[*keys, *COUNTS])

    several = level.mapInArrow(finish, f"{ks}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return single.unionByName(several).select(*keys, *COUNTS, *ratios())


EDGES = ("word_first", "word_last", "whole", "head", "tail", "first_token", "last_token")
ARROW = {c: pa.int64() for c in COUNTS} | {"word_first": pa.bool_(), "word_last": pa.bool_(), "whole": pa.bool_(), "head": pa.string(), "tail": pa.string(), "first_token": pa.string(), "last_token": pa.string()}


def ratios() -> list[Column]:
    """Ratios and verdicts from the counts."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ink = F.col("n_chars") - F.col("n_space")
    return [
        share(F.col("n_ascii_letters") + F.col("n_space"), F.col("n_chars")).alias("english_ratio"),
        share(F.col("n_digits"), F.col("n_chars")).alias("digit_ratio"),
        share(F.col("n_symbols"), ink).alias("symbol_ratio"),
        share(ink, F.col("n_words")).alias("mean_word_length"),
        share(F.col("n_closed_lines"), F.col("n_lines")).alias("closed_line_share"),
        share(F.col("n_common_words"), F.col("n_plain_words")).alias("common_word_share"),
        share(F.col("sentence_chars"), F.col("n_chars")).alias("sentence_share"),
        (share(F.col("sentence_chars"), F.col("n_chars")) >= PROSE_SHARE).alias("is_prose"),
        (F.col("bare_letters") == 0).alias("is_bare"),
    ]
