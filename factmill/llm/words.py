"""Words of many texts at once: hashes and places, from Arrow buffers, without Python loops.

Texts are taken as UTF-8 bytes. Separators are ASCII, so that a byte never belongs to
both a separator and a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
"""Bytes of text hashed at once, some 50 bytes each while they are; a longer text is cut between words."""
RUN = 1 << 20
"""Bytes of text of a run of rows."""
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits (the finishing step of a common 64-bit hash)."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x1B873593) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * BLOCK:
            _powers[name] = have
    return have


def flat_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of bytes, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, size: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes: first row, row behind the last, bytes, bounds."""
    data, bounds = flat_texts(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def _pieces(data: np.ndarray, bounds: np.ndarray, white: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut between words, so that a piece has about BLOCK bytes unless one word is longer."""
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        if to < len(data):
            gap = np.flatnonzero(white[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                while to < len(data) and not white[data[to]]:
                    step = np.flatnonzero(white[data[to : to + BLOCK]])
                    to = to + int(step[0]) if len(step) else min(len(data), to + BLOCK)
        yield at, to
        at = to


def hashed_words(
    data: np.ndarray,
    bounds: np.ndarray,
    white: np.ndarray = WHITE,
    prefixes: tuple[int, ...] = (),
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and a column of hashes: whole word, then each prefix.

    A word ends at a separator and where its text ends. Equal words have equal hashes in
    whatever block they stand; two different ones share a hash with a chance of 2 ** -64.
    """
    n = len(data)
    word = ~white[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty((len(starts), 1 + len(prefixes)), np.uint64)
    for at, to in _pieces(data, bounds, white):
        i, j = np.searchsorted(starts, (at, to))
        if i == j:
            continue
        up, down = _power("up", _STEP, to - at), _power("down", _BACK, to - at)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        base, shift = total[s], down[s]
        out[i:j, 0] = mix((total[e] - base) * shift)
        for k, length in enumerate(prefixes, 1):
            out[i:j, k] = mix((total[np.minimum(e, s + length)] - base) * shift, length)
    return starts, ends, out


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First word of each text, and one behind the last word of the last."""
    return np.searchsorted(starts, bounds)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]`` one behind the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
