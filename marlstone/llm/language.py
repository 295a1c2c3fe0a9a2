"""Languages of texts and of their segments, by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the character n-grams of all languages: every cell is a mask with a bit a language, and the
masks at an n-gram's cells, and-ed, name all languages that have it. A sentence's evidence for a language is the number of its
n-grams with that bit, less the expected number of false positives, each n-gram shared out among the languages named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.arrowkit import slices
from marlstone.llm.canonical import canonical_array
from marlstone.llm.quality import END, PROSE_SHARE, common_words, judge

LANGUAGES = ("en", "de", "fr", "es", "pt", "zh")
# Other spellings of a language's name (before any - or _).
SPELLINGS = {
    "en": "en eng english englisch anglais inglés ingles inglês englisch",
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao",
    "fr": "fr fra fre french französisch français francais francés frances francês",
    "es": "es spa esp spanish spanisch espagnol español espanol castellano espanhol",
    "pt": "pt por ptbr portuguese portugiesisch portugais portugués portugues português",
    "zh": "zh zho chi cmn chinese mandarin chinesisch chinois chino chinês chines 中文 汉语 漢語",
}
#: The classifier is fitted on at most so many sample sentences.
SAMPLE_ROWS = 10_000
CELLS_LOG2, GRAM = 21, 4
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A sentence needs so much evidence, and this lead of the first language over the second, to have a language.
LEAST_EVIDENCE, LEAST_LEAD = 3.0, 0.1
HAN_RANGE = (0x3400, 0x9FFF)


def grams(text: str) -> np.ndarray:
    """A 64-bit code of the n-gram that begins at each character: four characters, or one Han sign; 0 for none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(len(c), np.uint64)
    if len(c) >= GRAM:
        k = c[: len(c) - GRAM + 1].copy()
        for i in range(1, GRAM):
            k = k * np.uint64(0x100000001B3) + c[i : len(c) - GRAM + 1 + i]
        out[: len(k)] = k
        plain = (c < 48) & (c != 39) | (c >= 48) & (c < 65) | (c > 0x2000) & (c < 0x3000)
        edge = plain & (c != 32)  # figures and signs are in no n-gram
        spoilt = edge.copy()
        for i in range(1, GRAM):
            spoilt[:-i] |= edge[i:]
        out[spoilt] = 0
        out[:-1][(c[:-1] == 32) & (c[1:] == 32)] = 0
    han = (c >= HAN_RANGE[0]) & (c <= HAN_RANGE[1])
    if han.any():
        spoilt = han.copy()
        for i in range(1, GRAM):
            spoilt[:-i] |= han[i:]
        out[spoilt & ~han] = 0
        out[han] = c[han] | np.uint64(1 << 40)
    return out


@dataclass
class Filters:
    """The bit-sliced filters, the share of false positives of each language, and the common words that tell sentences."""

    cells: np.ndarray
    false: np.ndarray
    common: frozenset[str] = frozenset()

    @staticmethod
    def places(codes: np.ndarray) -> list[np.ndarray]:
        mixed = codes ^ (codes >> np.uint64(29))
        return [(mixed * m) >> np.uint64(64 - CELLS_LOG2) for m in MULTIPLIERS]

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], common: frozenset[str] = frozenset()) -> Filters:
        cells = np.zeros(1 << CELLS_LOG2, np.uint8)
        for bit, lang in enumerate(LANGUAGES):
            texts = [t for known, t in samples if known == lang]
            codes = [grams(prepared(" " + t + " ")) for t in texts]
            if lang == "zh":
                codes.append(np.arange(HAN_RANGE[0], HAN_RANGE[1] + 1, dtype=np.uint64) | np.uint64(1 << 40))
            codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
            for p in cls.places(codes[codes > 0]):
                cells[p] |= np.uint8(1 << bit)
        fill = np.array([np.mean(cells >> b & 1) for b in range(len(LANGUAGES))])
        return cls(cells, fill ** len(MULTIPLIERS), common)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """All languages that have each n-gram."""
        out = np.full(len(codes), 0xFF, np.uint8)
        for p in self.places(codes):
            out &= self.cells[p]
        out[codes == 0] = 0
        return out

    def evidence(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pieces of text between bounds: corrected evidence by language, and the number of n-grams."""
        codes = grams(text)
        masks = self.masks(codes)
        n = len(bounds) - 1
        piece = np.repeat(np.arange(n), np.diff(bounds))
        counts = np.bincount(piece * 64 + masks[bounds[0] : bounds[-1]], minlength=n * 64).reshape(n, 64)
        asked = np.bincount(piece[codes[bounds[0] : bounds[-1]] > 0], minlength=n)
        return np.maximum(counts @ SHARES - asked[:, None] * self.false[None, :], 0) / (1 - self.false)[None, :], asked


SHARES = np.array([[(m >> b & 1) / max(m.bit_count(), 1) for b in range(len(LANGUAGES))] for m in range(64)])


def prepared(text: str) -> str:
    """Lower case of the same length, every white space a blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("\n", " ").replace("\t", " ").replace("\r", " ")


@dataclass
class Sentences:
    """The sentences of many texts: where they are, whose they are and what they speak (-1: not told)."""

    text: str
    bounds: np.ndarray
    doc: np.ndarray
    lang: np.ndarray
    scores: np.ndarray


def read(filters: Filters, texts: list[str]) -> Sentences:
    joined = "\n".join(texts) + "\n"
    ends = np.fromiter((m.end() for m in END.finditer(joined)), np.int64)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.union1d(np.r_[0, ends], starts)
    scores, asked = filters.evidence(prepared(joined), bounds)
    order = np.sort(scores, axis=1)
    first, second = order[:, -1], order[:, -2]
    told = (first >= LEAST_EVIDENCE) & (first - second >= LEAST_LEAD * (first + second)) & (first >= 0.15 * asked)
    lang = np.where(told, scores.argmax(axis=1), -1)
    return Sentences(joined, bounds, np.searchsorted(starts, bounds[:-1], side="right") - 1, lang, scores)


def runs(lang: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(doc, language, first sentence, sentences) of the stretches of one language; sentences not told are passed over."""
    at = np.flatnonzero(lang >= 0)
    if not len(at):
        return []
    new = np.r_[True, (lang[at][1:] != lang[at][:-1]) | (doc[at][1:] != doc[at][:-1])]
    begin = np.flatnonzero(new)
    return list(zip(doc[at][begin].tolist(), lang[at][begin].tolist(), at[begin].tolist(), np.diff(np.r_[begin, len(at)]).tolist()))


def fit_filters(samples: DataFrame, words: DataFrame | None = None) -> Filters:
    """Filters from (lang, text) sample sentences and (lang, word) common words, at most SAMPLE_ROWS of each."""
    rows = [(r.lang, r.text) for r in samples.where("lang is not null and text is not null").select("lang", "text").limit(SAMPLE_ROWS).collect()]
    if words is not None:
        rows += [(r.lang, r.word) for r in words.where("lang is not null and word is not null").select("lang", "word").limit(SAMPLE_ROWS).collect()]
    return Filters.fit(rows, frozenset() if words is None else common_words(words))


def label_language(label: Column) -> Column:
    """The language a label names, in any known spelling; null if it names none of ours."""
    name = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"(?U)^\s*([\p{L}]*)", 1))
    out = F.lit(None).cast("string")
    for lang, known in SPELLINGS.items():
        out = F.when(name.isin(known.split()), lang).otherwise(out)
    return out


def segments(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, segment, begins, ends, sentences, lang, confidence): the stretches of one language of each text.

    begins and ends are characters of the one spelling of the text. Confidence is the evidence for the language by that for
    all. Texts without told sentence, null and blank ones give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, s = part.column("id").to_pylist(), read(filters, pc.fill_null(canonical_array(part.column("text")), "").to_pylist())
                found = runs(s.lang, s.doc)
                total = np.r_[np.zeros((1, len(LANGUAGES))), np.cumsum(s.scores, axis=0)]
                first_of = np.searchsorted(s.doc, np.arange(len(ids)))
                out, number = [], {}
                for k, (d, lang, at, n) in enumerate(found):
                    end = found[k + 1][2] if k + 1 < len(found) and found[k + 1][0] == d else int(np.searchsorted(s.doc, d, side="right"))
                    sums = total[end] - total[at]
                    number[d] = number.get(d, -1) + 1
                    base = int(s.bounds[first_of[d]])
                    out.append((ids[d], number[d], int(s.bounds[at]) - base, int(s.bounds[end]) - base, n, LANGUAGES[lang], float(sums[lang] / max(sums.sum(), 1e-9))))
                columns = list(zip(*out)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=[key, "segment", "begins", "ends", "sentences", "lang", "confidence"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} bigint, segment int, begins bigint, ends bigint, sentences int, lang string, confidence double")


def document_languages(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, lang, confidence, label_lang, languages, mixed, prose): one row per text whose language can be told.

    languages are those with at least two successive sentences, in the order of their evidence; mixed: there are two or more.
    prose is judged where it matters, for texts that are mixed or whose label names another language or none, and true else.
    A sentence that is no running sentence isn't counted in those texts. Null and blank texts give no row; a null label names
    no language; repeated keys give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(canonical_array(part.column("text")), "").to_pylist()
                s = read(filters, texts)
                n, labels = len(texts), part.column("label").to_pylist()
                ids = part.column("id").to_pylist()
                sums = np.zeros((n, len(LANGUAGES)))
                np.add.at(sums, s.doc, s.scores)
                spoken: dict[int, set[int]] = {}
                for d, lang, _, many in runs(s.lang, s.doc):
                    if many >= 2:
                        spoken.setdefault(d, set()).add(lang)
                first_of, last_of = np.searchsorted(s.doc, np.arange(n)), np.searchsorted(s.doc, np.arange(n), side="right")
                out = []
                for d in np.flatnonzero(sums.max(axis=1) >= LEAST_EVIDENCE).tolist():
                    best, prose, langs = int(sums[d].argmax()), True, spoken.get(d, set())
                    if len(langs) > 1 or labels[d] != LANGUAGES[best]:
                        a, b = int(first_of[d]), int(last_of[d])
                        judged = [judge(s.text[s.bounds[k] : s.bounds[k + 1]], filters.common) for k in range(a, b)]
                        prose = sum(j[3] for j in judged) >= PROSE_SHARE * max(len(texts[d]), 1)
                        real = np.array([j[2] for j in judged]) > 0
                        if real.any():
                            langs = {x for _, x, _, many in runs(np.where(real, s.lang[a:b], -1), s.doc[a:b]) if many >= 2}
                            best = int(s.scores[a:b][real].sum(axis=0).argmax())
                    order = sorted(langs, key=lambda x: -sums[d][x])
                    out.append((ids[d], LANGUAGES[best], float(sums[d][best] / sums[d].sum()), labels[d], [LANGUAGES[x] for x in order], len(langs) > 1, bool(prose)))
                columns = list(zip(*out)) if out else [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "lang", "confidence", "label_lang", "languages", "mixed", "prose"])

    rows = docs.where(F.col(text).rlike(r"(?U)\S")).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("label"))
    return rows.mapInArrow(run, f"{key} bigint, lang string, confidence double, label_lang string, languages array<string>, mixed boolean, prose boolean")


def mislabelled(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang): prose whose label is missing or wrong, with its language; mixed prose with each of its languages."""
    told = document_languages(docs, filters).where("prose")
    right = F.when(F.col("mixed"), F.col("languages")).when(F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")), F.array("lang"))
    return told.select("doc_id", F.explode(right).alias("lang")).distinct()
