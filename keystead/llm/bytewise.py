"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than space and \\t..\\r, with A-Z in lower case. UTF-8 continuation bytes are
never one of these, so byte runs and character runs are the same. Hashes are 64 bits: a polynomial in a random
value per byte, taken from prefix sums and then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_ODD = lambda n: _RNG.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
BYTE_VALUE = _ODD(256)
BASE = int(_ODD(1)[0])
BASE_INVERSE = pow(BASE, -1, 2**64)
SHINGLE_FACTORS = _ODD(64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]
_POWERS = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


#: What a worker keeps from task to task for one kind of work; other work lets go of it.
KEPT: list = []


def release(keep: bool = False) -> None:
    """Give freed memory back to the system; Python workers live on between tasks, and with them what KEPT can drop."""
    if not keep:
        for drop in KEPT:
            drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run, keep: bool = False):
    """``run`` (batches to batches) that gives its memory back at the end."""

    def inner(batches):
        yield from run(batches)
        release(keep)

    return inner


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more entry for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(at: np.ndarray, size: int = 1 << 19):
    """Ranges of whole texts with about ``size`` bytes (one text may have more)."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, begin, end) of every word, in order."""
    n = len(data)
    letter = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    begin = np.flatnonzero(letter & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = letter[1:]
    end = np.flatnonzero(letter & (~after | first[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER_VALUE[data] * _powers(BASE, n), out=total[1:])
    h = (total[end] - total[begin]) * _powers(BASE_INVERSE, max(n, 1))[begin]
    return np.searchsorted(at, begin, "right") - 1, mix(h + (end - begin).astype(np.uint64)), begin, end


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash), sorted, of the distinct n-word shingles; a text of fewer words has all of them as one."""
    doc, word, _, _ = words(data, at)
    count = np.bincount(doc, minlength=len(at) - 1)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(doc))  # words from here to the end of the text
    whole = (left >= n) | (left == np.repeat(count, count))
    h = np.zeros(len(word), np.uint64)
    for k in range(n):
        part = word[k:] * SHINGLE_FACTORS[k]
        part[left[: len(part)] <= k] = 0
        h[: len(part)] += part
    return distinct(doc[whole], mix(h[whole], 1))


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text index, hash), sorted."""
    order = np.argsort(h)
    kind = np.uint16 if len(doc) and doc[-1] < 65536 else np.int64
    order = order[np.argsort(doc[order].astype(kind), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sum of the values of each text; ``doc`` is sorted."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary column whose i-th value is data[edges[i]:edges[i + 1]], edges in items of data."""
    raw = np.ascontiguousarray(data)
    width = raw.strides[0] if raw.ndim == 2 else raw.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(raw)]
    )
