"""Arrow helpers of the text operators: byte-bounded slices and flat code-point views."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts hold about `most` bytes together (one row at least)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and the n + 1 offsets into it; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and the byte at which each begins (None: one byte each)."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), None
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), np.flatnonzero((data & 0xC0) != 0x80)


def unmet(points: np.ndarray, met: np.ndarray) -> list[int]:
    """The code points that aren't marked in `met`."""
    return np.unique(points[~met[points]]).tolist()


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.zeros(0x110000, np.uint8)
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        kinds[a : b + 1] = 3
    return kinds, kinds == 3


def char_classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space; worked out where one is first met."""
    kinds, met = _classes()
    for i in unmet(points, met):
        kinds[i], met[i] = {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 0), True
    return kinds[points]
