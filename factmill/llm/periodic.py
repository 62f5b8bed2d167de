"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words in which words ``q`` apart are equal, which no
neighbouring word extends, of at least ``LEAST`` words and two periods. ``q`` is its smallest
period. So each word of a run occurs at least twice in it, and a word that occurs once in a
segment of a text is in none of the segment's runs: it splits the segment. What is frequent
in a segment may be rare in its parts, so the parts are split again until nothing changes
(``frequent_segments``); parts shorter than ``LEAST`` are dropped. Every run lies whole in a
surviving segment, and these are scanned at all lags:

* at lags below ``DIRECT``, word by word;
* at lags from ``Q`` to ``2 Q``, ``Q`` a power of two, at anchors only. A run of such a period
  repeats some block of ``Q / 2`` words that begins at a multiple of ``Q / 2`` one period
  later. Hashes of blocks are compared at every anchor and lag, twice as many comparisons as
  there are words, and what agrees is extended to either side by hashes of stretches.

Lengths come from the words themselves: a stretch that hashes claim is compared word by word,
and its lag is scanned whole if the claim was wrong. All texts of a block are handled at
once. The cost is n log n in the length n of a text, its own periods included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.llm.distinct import exact_ids, gathered, word_spans
from factmill.llm.words import blocks, mix, ragged

LEAST = 12
"""Words of a run."""
DIRECT = 16
ROUNDS = 32
"""Rounds in which all segments are split at once, before those left are split one by one."""
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_WORD = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def occurrences(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word before and behind that is equal, in the same text; else -1 and n."""
    n = len(ids)
    before, after = np.full(n, -1), np.full(n, n)
    if n:
        key = row * (int(ids.max()) + 1) + ids
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
    return before, after


def frequent_segments(
    before: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the segments in which every word occurs twice or more, in order.

    Segments are cut at words that occur once in them, over and over. After ``rounds`` rounds
    over all that still change, each is split from its nearer end, so that even a text that
    loses one word a round costs n log n.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        size = ends - starts
        at = ragged(np.arange(len(before)), starts, size)
        rare = (before[at] < np.repeat(starts, size)) & (after[at] >= np.repeat(ends, size))
        split = np.logical_or.reduceat(rare, np.cumsum(size) - size)
        done.append((starts[~split], ends[~split]))
        cuts = at[rare]
        starts = np.sort(np.concatenate([starts[split], cuts + 1]))
        ends = np.sort(np.concatenate([ends[split], cuts]))
    rest = [x for s, e in zip(starts.tolist(), ends.tolist()) for x in _split(before, after, s, e)]
    done.append((np.array([s for s, _ in rest], np.int64), np.array([e for _, e in rest], np.int64)))
    starts, ends = (np.concatenate([d[k] for d in done]) for k in (0, 1))
    order = np.argsort(starts)
    return starts[order], ends[order]


def _split(before: np.ndarray, after: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    todo = [(start, end)]
    while todo:
        s, e = todo.pop()
        if e - s < LEAST:
            continue
        cut = _near_an_end(before, after, s, e)
        if cut is None:
            yield s, e
        else:
            todo += [(s, cut), (cut + 1, e)]


def _near_an_end(before: np.ndarray, after: np.ndarray, s: int, e: int) -> int | None:
    """A word that occurs once, sought from both ends in turn in pieces that double."""
    seen, step = 0, 64
    while 2 * seen < e - s:
        for i, j in ((s + seen, min(s + seen + step, e)), (max(e - seen - step, s), e - seen)):
            rare = np.flatnonzero((before[i:j] < s) & (after[i:j] >= e))
            if len(rare):
                return i + int(rare[0])
        seen += step
        step *= 2
    return None


class Lags:
    """Segments one behind the other, each followed by a word of its own, and their hashes."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        self.first = np.cumsum(size + 1) - size - 1
        self.shift = starts - self.first
        n = int(size.sum()) + len(size)
        self.x = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.first + size] = False
        self.x[inside] = ragged(ids, starts, size)
        self.x[~inside] = -1 - np.arange(len(size))

    def words(self, place: np.ndarray) -> np.ndarray:
        """The words' numbers at these places."""
        return place + self.shift[np.searchsorted(self.first, place, "right") - 1]

    def scan(self, lag: int) -> np.ndarray:
        """Runs at one lag, as rows of start, end and lag (places)."""
        same = np.zeros(max(0, len(self.x) - lag) + 2, bool)
        same[1:-1] = self.x[:-lag] == self.x[lag:] if lag < len(self.x) else False
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2] + lag
        keep = ends - starts >= max(LEAST, 2 * lag)
        return np.stack([starts[keep], ends[keep], np.full(keep.sum(), lag)], 1)

    def level(self, low: int, known: np.ndarray) -> np.ndarray:
        """Runs at lags from ``low`` to twice that, but for multiples of known periods."""
        x, n, block = self.x, len(self.x), low // 2
        up, down = (np.full(n + 1, base, np.uint64) for base in (_STEP, _BACK))
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(x.astype(np.uint64)) * up[:n], out=total[1:])
        hashes = np.zeros(n + 2 * low, np.uint64)
        hashes[: n - block + 1] = (total[block:] - total[: n - block + 1]) * down[: n - block + 1]
        anchors = np.arange(0, max(0, n - low - block + 1), block)
        later = np.lib.stride_tricks.sliding_window_view(hashes, low)[low::block][: len(anchors)]
        k, lag = np.nonzero(later == hashes[anchors][:, None])
        j, q = anchors[k], lag + low
        inside = j + q + block <= n
        j, q = self._unknown(j[inside], q[inside], block, known)
        right = self._reach(total, up, j, q, n - j - q, 1)
        left = self._reach(total, up, j, q, j, -1)
        found = np.unique(np.stack([j - left, j + q + right, q], 1), axis=0)
        found = found[found[:, 1] - found[:, 0] >= 2 * found[:, 2]]
        wrong = {int(q) for s, e, q in found.tolist() if not self._is_run(s, e, q)}
        if wrong:
            found = np.concatenate([found[~np.isin(found[:, 2], list(wrong))], *map(self.scan, wrong)])
        return found

    def _unknown(
        self, j: np.ndarray, q: np.ndarray, block: int, known: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Without places and lags inside a known run whose period divides the lag."""
        if not len(j) or not len(known):
            return j, q
        place = self.words(j)
        end, period = np.zeros(len(j), np.int64), np.ones(len(j), np.int64)
        order = np.argsort(place)
        ordered = place[order]
        for s, e, p in known.tolist():
            mine = order[np.searchsorted(ordered, s) : np.searchsorted(ordered, e)]
            mine = mine[end[mine] < e]
            end[mine], period[mine] = e, p
        new = (place + q + block > end) | (q % period != 0)
        return j[new], q[new]

    @staticmethod
    def _reach(
        total: np.ndarray, up: np.ndarray, j: np.ndarray, q: np.ndarray, most: np.ndarray, way: int
    ) -> np.ndarray:
        """How far words at ``j`` and ``j + q`` agree, forwards or backwards."""
        low, high, power = np.zeros(len(j), np.int64), most.copy(), up[q]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            to = j + way * middle
            same = (total[to] - total[j]) * power == total[to + q] - total[j + q]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def _is_run(self, s: int, e: int, q: int) -> bool:
        x = self.x
        ends = (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q])
        return bool(ends and np.array_equal(x[s : e - q], x[s + q : e]))


def runs_of_words(ids: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """All runs of texts whose words' numbers lie one behind the other: rows of start, end
    and period, in order of start and period; places count over all texts."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts, ends = frequent_segments(*occurrences(ids, row), bounds[:-1], bounds[1:], rounds)
    runs = np.zeros((0, 3), np.int64)
    if not len(starts):
        return runs
    lags = Lags(ids, starts, ends)
    found = np.concatenate([lags.scan(q) for q in range(1, DIRECT)])
    runs = _smallest(np.stack([lags.words(found[:, 0]), lags.words(found[:, 1] - 1) + 1, found[:, 2]], 1))
    low = DIRECT
    while (long := ends - starts >= 2 * low).any():
        starts, ends = starts[long], ends[long]
        lags = Lags(ids, starts, ends)
        known = runs[runs[:, 1] - runs[:, 0] >= low + low // 2]
        found = lags.level(low, known)
        found = np.stack([lags.words(found[:, 0]), lags.words(found[:, 1] - 1) + 1, found[:, 2]], 1)
        runs = _smallest(np.concatenate([runs, found]))
        low *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch: a run at a multiple of its period is the same stretch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def repeated_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _found(column: pa.Array, order: Callable[[int, int], np.ndarray | None] | None, by: pa.Array | None):
    """For each block of texts: their runs, runs' bounds, and the words kept as lists."""
    values = by.to_pylist() if by is not None else None
    for i, j, data, bounds in blocks(column):
        starts, ends = word_spans(data, bounds)
        words = gathered(data, starts, ends)
        ids, _ = exact_ids(words)
        row = np.searchsorted(starts, bounds)
        places = np.arange(len(ids))
        for k in range(i, j) if order else ():
            n = int(row[k - i + 1] - row[k - i])
            if n and values[k] is not None and (own := order(n, values[k])) is not None:
                places[row[k - i] : row[k - i + 1]] = row[k - i] + own
        ids = ids[places]
        runs = runs_of_words(ids, row)
        kept = ~repeated_words(runs, len(ids))
        texts = pa.LargeListArray.from_arrays(
            np.concatenate([[0], np.cumsum(kept)])[row], words.take(pa.array(places[kept]))
        )
        at = np.searchsorted(runs[:, 0], row)
        runs[:, :2] -= row[np.searchsorted(row, runs[:, 0], "right") - 1][:, None]
        yield runs, at, pc.binary_join(texts, pa.scalar(b" ", pa.large_binary())), np.diff(row)


def runs(
    text: Column | str,
    order: Callable[[int, int], np.ndarray | None] | None = None,
    by: Column | str | None = None,
) -> Column:
    """``n_words``, ``runs`` (start, length, period by start, then period; word numbers from
    0) and ``collapsed_sha256`` of a text.

    The collapsed text has the words that no run holds behind its first period, joined by one
    space. Words are runs without ASCII white space, and compared byte by byte. A null or
    empty text has no words, no runs, and the digest of an empty text. Where ``by`` is not
    null, ``order(n_words, by)`` may say which words stand in which order instead.
    """

    @F.arrow_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string")
    def run(texts: pa.Array, *more: pa.Array) -> pa.Array:
        sizes, spans, digests = [pa.array([], pa.int64())], [], []
        for found, at, collapsed, n in _found(texts, order, more[0] if more else None):
            sizes.append(pa.array(n))
            flat = pa.StructArray.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])],
                fields=list(_WORD),
            )
            spans.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat))
            digests += [hashlib.sha256(t.as_buffer()).hexdigest() for t in collapsed]
        lists = pa.concat_arrays(spans) if spans else pa.array([], pa.list_(_WORD))
        return pa.StructArray.from_arrays(
            [pa.concat_arrays(sizes), lists, pa.array(digests, pa.string())],
            ["n_words", "runs", "collapsed_sha256"],
        )

    return run(text) if by is None else run(text, by)


def collapse(text: Column | str) -> Column:
    """A text's words without those that repeat a period, joined by one space; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        joined = [pa.array([], pa.large_binary()), *(c for _, _, c, _ in _found(texts, None, None))]
        whole = pa.concat_arrays(joined).cast(pa.large_string())
        return pc.if_else(pc.is_valid(texts), whole, None).cast(pa.string())

    return run(text)
