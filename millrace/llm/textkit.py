"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one byte array plus document offsets; words, hashes and n-grams of the
whole batch are computed together in numpy. Splitting happens at ASCII bytes only, so it is
exact on UTF-8. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: every ASCII character that is no letter or digit
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
NON_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240501)
_TAB = _rng.integers(1, 2**64 - 1, size=64 * 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is far faster here than numpy's hashed unique."""
    if len(a) < 2:
        return a.copy()
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words never cross documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    s = np.flatnonzero(w & ~before)
    e = np.flatnonzero(w & ~after) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit position-tabulation hash of each word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    lens = e - s
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    wb = data[pos + np.repeat(s, lens)]
    val = _TAB[((pos & 63) << 8) | wb]
    if int(lens.max()) > 64:
        val = val * ((pos >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(val, first) + lens.astype(np.uint64))


def ngram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive words within a document, and which starts are valid."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = h[:m].copy()
    for j in range(1, n):
        acc = acc * _MIX + h[j : j + m]
    return mix(acc), doc[:m] == doc[n - 1 :]


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles over A-Z-lowered words.

    With 1 to n - 1 words the whole sequence is the only shingle; without words the set is empty.
    """
    low = LOWER[data]
    s, e, doc = words(low, off)
    h = word_hashes(low, s, e)
    sh, ok = ngram_hashes(h, doc, n)
    sh, at = sh[ok], doc[: len(ok)][ok]
    docs = len(off) - 1
    cut = np.searchsorted(at, np.arange(docs + 1))
    wcut = np.searchsorted(doc, np.arange(docs + 1))
    out = []
    for i in range(docs):
        if cut[i + 1] > cut[i]:
            out.append(distinct(sh[cut[i] : cut[i + 1]]))
        elif wcut[i + 1] > wcut[i]:
            acc = np.array([wcut[i + 1] - wcut[i]], np.uint64)
            for x in h[wcut[i] : wcut[i + 1]]:
                acc = acc * _MIX + x
            out.append(mix(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Sums of integer values by document."""
    return np.bincount(doc, weights=values, minlength=docs).astype(np.int64) if len(doc) else np.zeros(docs, np.int64)
