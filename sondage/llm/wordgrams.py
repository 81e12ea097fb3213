"""Vectorised word and word-gram hashing over Arrow string batches.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text; everything else
separates words.  All functions work on whole batches with NumPy, so that Python's cost is a few array passes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words in the regular expressions of Java and RE2, on lower-cased text.
WORD_PATTERN = r"(?:[0-9a-z]|[^\x00-\x7F])+"
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MIX = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xD6E8FEB86659FD93 | 1
_GRAM_INVERSE = pow(_GRAM_BASE, -1, 2**64)
_SLICE_BYTES = 1 << 20
_PLACE = np.uint64(2**26 - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def finalise(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts, one after the other.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``start`` and ``end`` are byte offsets into ``data``.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Split texts into words and hash each word; nulls and empty texts have none."""
    texts = texts.cast(pa.large_string())
    data, offsets = string_bytes(pc.utf8_lower(texts) if lower else texts)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IS_WORD[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    # A word ends where the next byte is outside, or where its text ends.
    after = inside[1:].copy()
    after[edge - 1] = False
    end = np.flatnonzero(inside[:-1] & ~after) + 1
    if len(start):
        size = end - start
        of_word = np.flatnonzero(inside[:-1])
        at = np.arange(len(of_word)) - np.repeat(np.cumsum(size) - size, size)
        terms = _BYTE_CODE[data[of_word]] * _powers(_BASE, int(size.max()))[at]
        code = finalise(np.add.reduceat(terms, np.cumsum(size) - size))
    else:
        code = np.zeros(0, np.uint64)
    return Words(data, start, end, code, np.searchsorted(start, offsets))


def gram_codes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether those words lie in one text."""
    n = len(words.code)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.code * _powers(_GRAM_BASE, n), out=sums[1:])
    grams = finalise((sums[k:] - sums[:-k]) * _powers(_GRAM_INVERSE, n - k + 1))
    doc = words.doc
    return grams, doc[: n - k + 1] == doc[k - 1 :]


class RunCodes:
    """Hash of any run of words in constant time; equal runs have equal hashes wherever they are."""

    def __init__(self, code: np.ndarray):
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * _powers(_GRAM_BASE, len(code))[: len(code)], out=self.sums[1:])
        self.back = _powers(_GRAM_INVERSE, len(code) + 1)

    def of(self, start: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.back[start]


def sliding(a: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each run of ``w`` neighbours."""
    done, out = 1, a
    while done < w:
        step = min(done, w - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def winnow(grams: np.ndarray, valid: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost least hash of every window of ``w`` grams inside a text.

    A text with fewer grams than ``w`` counts as one window.  Each text's choice depends on that text alone.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    worst = np.uint64(2**64 - 1)
    place = _PLACE - (np.arange(n, dtype=np.uint64) & _PLACE)
    key = np.where(valid, (grams & ~_PLACE) | place, worst)
    chosen = np.zeros(n, dtype=bool)
    doc = doc[:n]
    if n >= w:
        least = sliding(key, w, np.minimum)
        whole = valid[w - 1 :] & valid[: n - w + 1] & (doc[w - 1 :] == doc[: n - w + 1])
        least = np.where(whole, least, 0)
        padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        chosen = (sliding(padded, w, np.maximum) == key) & valid
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.add.reduceat(valid.astype(np.int64), first)
    least = np.minimum.reduceat(key, first)
    few = np.flatnonzero((count > 0) & (count < w))
    if len(few):
        wanted = np.zeros(len(first), dtype=bool)
        wanted[few] = True
        which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
        chosen |= wanted[which] & (key == least[which]) & valid
    return np.flatnonzero(chosen)


def window_minima(grams: np.ndarray, valid: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First position of every window of ``w`` grams inside a text, and the position of the window's rightmost least hash.

    The choice depends on the window's grams alone.
    """
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n, dtype=np.uint64)
    least = sliding((grams & ~_PLACE) | (_PLACE - (at & _PLACE)), w, np.minimum)
    start = np.flatnonzero(valid[: n - w + 1] & valid[w - 1 :] & (doc[: n - w + 1] == doc[w - 1 : n]))
    low = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
    return start, start + ((low - start) & int(_PLACE))


def slices(batch: pa.RecordBatch, column: str, limit: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each; a longer row stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def signed(codes: np.ndarray) -> pa.Array:
    """Hashes as Spark's bigint."""
    return pa.array(codes.view(np.int64))
