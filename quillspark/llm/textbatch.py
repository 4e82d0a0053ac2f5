"""Numpy over Arrow string columns: words, lines and hashes of whole batches without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, so that the hash of a word depends on whole bytes.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Space and the five control characters U+0009 to U+000D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most ``rows`` values with about ``limit`` bytes; a longer value stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in ``inside`` that cross no value's border: starts, ends, number of the value."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    before[offsets[filled]] = False
    after[offsets[filled + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        p = np.full(n, _BASE if way == "up" else _BASE_INV, np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        if n > 2 * CHUNK:  # a single very long text: not worth keeping
            return p
        _powers[way] = p
    return _powers[way][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from prefix sums; equal bytes, equal hash, wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", max(1, len(data)))[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", max(1, len(data) + 1))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order, and the number of each one's text."""
    starts, ends, owner = spans(~SPACE[data], offsets)
    return span_hashes(LOWER[data], starts, ends), owner


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text, sorted by text and hash; a shorter text's words are one shingle."""
    n = len(words)
    counts = np.bincount(owner, minlength=n_texts)
    parts, owners = [], []
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += words[k : n - size + 1 + k] * _COEF[k]
        whole = owner[: n - size + 1] == owner[size - 1 :]
        parts.append(mix(h[whole]))
        owners.append(owner[: n - size + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        h = counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(size - 1):
            has = counts[short] > k
            h[has] += words[at[has] + k] * _COEF[size + k]
        parts.append(mix(h))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], o[first]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of one span for each distinct content, and for every span which of them it equals."""
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64)
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], which


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of counts[i] each, one run after another."""
    total = int(counts.sum())
    skip = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + skip
