"""Array kernels over the bytes of an Arrow text column: no object per word is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Neither letters, digits nor parts of multi-byte characters.
PUNCT = np.zeros(256, bool)
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True
#: Texts are taken together up to so many bytes, a longer text alone.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
#: Powers of the odd base and of its inverse modulo 2 ** 64.
_powers = _inverses = np.ones(1, np.uint64)
#: What a byte counts in a hash: itself and one, in lower case or not; white space nothing.
_VALUE = {lower: np.where(SPACE, 0, (LOWER if lower else np.arange(256)).astype(np.uint64) + np.uint64(1)) for lower in (True, False)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        _powers, _inverses = (
            np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n + n // 4, base, np.uint64))]) for base in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    return _powers, _inverses


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads entropy over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, split_punct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. They are runs of non-space bytes; with split_punct each ASCII punctuation mark is a word of its own. A word never spans two texts."""
    n = len(buf)
    ok = ~SPACE[buf]
    cut = np.zeros(n + 1, bool)  # a word can't go on over these
    cut[offsets] = True
    if split_punct and n:
        punct = PUNCT[buf]
        cut[1:n] |= punct[1:] | punct[:-1]
    cut[:-1] |= ~ok
    cut[1:] |= ~ok
    return np.flatnonzero(ok & cut[:-1]), np.flatnonzero(ok & cut[1:]) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _VALUE[lower][buf]
    powers, inverses = _pow(len(buf))
    value *= powers[: len(buf)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, out=value)])
    return mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def tokens(buf: np.ndarray, offsets: np.ndarray, lower: bool = True, split_punct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of each text's first word and the end)."""
    starts, ends = word_spans(buf, offsets, split_punct)
    return word_hashes(buf, starts, ends, lower), np.searchsorted(starts, offsets)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the run at i starts with word i."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + m])
    return h
