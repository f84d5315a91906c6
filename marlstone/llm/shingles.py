"""Hashes of words and of runs of words, by numpy over the buffer of an Arrow column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15
_INV = pow(_R, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_R, _INV)):
            step = np.full(max(n, 1 << 20), x, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)


def slices(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets, bytes) of pieces of about ``most`` bytes, so that a worker needs tens of MB; a longer text is a piece by itself."""
    at, data = buffers(col)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last, at[first : last + 1] - at[first], data[at[first] : at[last]]
        first = last


def words(at: np.ndarray, data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, row) of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; between: other bytes that part words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~between[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = ink[cut]
    last[cut - 1] = ink[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start]), start, np.searchsorted(at, start, "right") - 1


def runs(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words within a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
    same = np.flatnonzero(row[:n] == row[k - 1 :])
    return mixed(out[same]), same


def folded(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of runs of n hashes each from such places on, of whatever lengths; for equal lengths those of ``runs``."""
    out = h[start]
    for j in range(1, int(n.max(initial=1))):
        longer = np.flatnonzero(n > j)
        out[longer] = out[longer] * _STEP + h[start[longer] + j]
    return mixed(out)


def shingle_sets(at: np.ndarray, data: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all rows one after the other, sizes, an identity for each row's set).

    A row with one to k-1 words has one shingle, the whole sequence; a row without words an empty set.
    """
    n_rows = len(at) - 1
    h, _, row = words(at, data)
    per = np.bincount(row, minlength=n_rows)
    s, i = runs(h, row, k)
    of = row[i]
    if ((per > 0) & (per < k)).any():
        for j in range(1, k):
            t, i = runs(h, row, j)
            short = per[row[i]] == j
            s, of = np.concatenate([s, mixed(t[short] + np.uint64(j))]), np.concatenate([of, row[i[short]]])
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    ends = np.cumsum(np.bincount(of, minlength=n_rows))
    a = 0
    for b in ends.tolist():
        s[a:b].sort()
        a = b
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    sizes = np.bincount(of, minlength=n_rows)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ _STEP), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return s, sizes, mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * _MIX)


#: Bytes between words where words are letters and digits only; bytes of other scripts count as letters.
PUNCTUATION = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def segments(at: np.ndarray, data: np.ndarray, sentences: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row, words) of each line, or sentence, trimmed of white space; blank ones are left out.

    A line ends at a line feed; a sentence there too, and at white space after one of ``.!?``.
    """
    empty = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    space = _SPACE[data]
    cut = data == 10
    if sentences:
        stop = (data == 46) | (data == 33) | (data == 63)
        cut[1:] |= stop[:-1] & space[1:]
    number = cut.astype(np.int32)
    begins = at[:-1]
    np.add.at(number, begins[begins < len(data)], 1)
    ink = np.flatnonzero(~space)
    part = np.cumsum(number, dtype=np.int32)[ink]
    new = np.ones(len(ink), bool)
    new[1:] = part[1:] != part[:-1]
    firsts = np.flatnonzero(new)
    start, end = ink[firsts], ink[np.append(firsts[1:], len(ink)) - 1] + 1 if len(ink) else ink
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    heads = ~space
    heads[1:] &= space[:-1]
    heads[start] = True  # a text can begin right behind the one before
    count = np.concatenate([[0], np.cumsum(heads, dtype=np.int32)])
    return mixed((sums[end] - sums[start]) * down[start]), start, end, np.searchsorted(at, start, "right") - 1, count[end] - count[start]
