"""Word hashes of whole texts, vectorised over the bytes of an Arrow column.

A word is a longest run of ASCII letters, digits and underscores and of characters outside ASCII, in lower case; general
punctuation outside ASCII (quotation marks, dashes, no-break spaces, ideographic stops) counts as white space. Its hash is
a polynomial of its UTF-8 bytes modulo 2^64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_powers = {}
#: Bytes worked on at a time.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate(([U(1)], np.full(max(n, STEP) + 64, base, U))), dtype=U)
        _powers[int(base)] = have
    return have[:n]


def spans(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; no word reaches over a place in ``breaks``."""
    is_word = _WORD[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    if breaks is not None:
        before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    if breaks is not None:
        inner = breaks[(breaks > 0) & (breaks <= len(data))] - 1
        after[inner] = False
    return starts, np.flatnonzero(is_word & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _table(_P, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _table(_INVERSE, len(data) + 1)[starts])


def lower(column: pa.Array) -> pa.Array:
    """Lower case, with general punctuation outside ASCII as spaces; nulls as empty texts."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(column, "[ -©«-´¶-¹»-¿ -⁯　-〿﻿]", " ")


def words(column: pa.Array, spans_too: bool = False) -> Iterator[tuple]:
    """Runs of rows as (first row, number of words of each, hashes of all their words[, bytes, starts, ends])."""
    column = lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        stop = min(stop, n)
        low, high = int(offsets[row]), int(offsets[stop])
        if stop == row + 1 and high - low > 2 * STEP:
            parts = list(_long(data[low:high]))
            counts, h = np.array([sum(map(len, parts))]), np.concatenate(parts)
            if spans_too:
                starts, ends = spans(data[low:high])
                yield row, counts, h, data[low:high], starts, ends
            else:
                yield row, counts, h
        else:
            own = data[low:high]
            starts, ends = spans(own, offsets[row : stop + 1] - low)
            counts = np.diff(np.searchsorted(starts, offsets[row : stop + 1] - low))
            h = hashes(own, starts, ends) if len(own) else np.zeros(0, U)
            yield (row, counts, h, own, starts, ends) if spans_too else (row, counts, h)
        row = stop


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """Of one long text, piece by piece, each ending between words."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + STEP)
        while stop < len(data) and _WORD[data[stop]] and _WORD[data[stop - 1]]:
            stop += 1
        part = data[at:stop]
        starts, ends = spans(part)
        yield hashes(part, starts, ends)
        at = stop


def segments(counts: np.ndarray) -> np.ndarray:
    """Row number of each of sum(counts) items."""
    return np.repeat(np.arange(len(counts)), counts)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and their number by row; a row of fewer words has one run of all of them."""
    if len(h) == 0:
        return h, counts.copy()
    total = np.zeros(len(h), U)
    size = len(h)
    of = segments(counts)
    ends = np.cumsum(counts)
    left = ends[of] - np.arange(size)  # words from here to the end of the row
    first = ends - counts
    for i in range(k):
        part = np.zeros(size, U)
        part[: size - i] = h[i:]
        total = np.where(left > i, mix(total * _P + part), total)
    out = np.maximum(counts - k + 1, np.minimum(counts, 1))
    keep = (np.arange(size) - first[of]) < out[of]
    return total[keep], out
