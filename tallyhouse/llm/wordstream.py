"""Words of many texts at once, as positions and 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 no other
character holds those bytes. Texts are walked in pieces of bounded size, a longer text
making a piece of its own, so memory follows the piece and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_WORD_STEP = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


class Words(NamedTuple):
    """Words of consecutive texts: byte ranges in `data`, text index, hash; `bounds[t]` is
    the first word of text t, with one more entry at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate(
                [self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(_STEP), _Powers(_WORD_STEP)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def substring_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): (sums[b] - sums[a]) * inverse[a] identifies data[a:b]."""
    up, down = _BYTES.upto(len(data) + 1)
    return _sums(_BYTE_VALUE[data] * up[: len(data)]), down


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the len + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset: texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of one string column."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of words of every text."""
    data, offsets = text_buffers(texts)
    begins = ~_SPACE[data]
    begins[1:] &= ~begins[:-1] | _starts(offsets, len(data))[1:]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])


def _starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether a text begins at each byte."""
    edge = np.zeros(size, bool)
    edge[offsets[:-1][offsets[:-1] < size]] = True
    return edge


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """Words of every text; `fold` lower-cases A-Z and nothing else."""
    data, offsets = text_buffers(texts)
    if fold:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, solid[:-1]
    before[edge] = False
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, solid[1:]
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    sums, down = substring_sums(data)
    named = (sums[end] - sums[start]) * down[start]
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(data, start, end, text, mix(named + (end - start).astype(np.uint64)), bounds)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive words, whatever text they lie in."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _GRAMS.upto(len(hashes) + 1)
    sums = _sums(hashes * up[: len(hashes)])
    return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def gram_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every run of `size` words inside one text, its text)."""
    count = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][text] + inner, text


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of `size` words of each text, sorted: (hashes, text of each, bounds).

    A text with words, but fewer than `size`, has its whole sequence as its only member.
    """
    at, text = gram_starts(words.bounds, size)
    values = grams(words.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(words.bounds)
    for t in np.flatnonzero((count > 0) & (count < size)):
        own = words.hash[words.bounds[t]: words.bounds[t + 1]]
        values = np.append(values, grams(own, len(own)))
        text = np.append(text, t)
    if len(text) and (np.diff(text) < 0).any():
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    edges = np.searchsorted(text, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[fresh], text[fresh]
    return values, text, np.searchsorted(text, np.arange(len(count) + 1))
