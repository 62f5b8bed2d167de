"""Similarity join on word shingles: links between texts, and the groups that they form.

Two texts link when ``100 * |A and B| >= percent * |A or B|`` for their sets of shingles.

*Points.* Shingles are hashed into groups, at least ``GROUPS`` of them and at most ``LOAD``
shingles to a group on average; a text is the point of its counts per group. The sum of the
smaller coordinates of two points bounds the overlap of their sets; of points with different
numbers of groups, powers of two, the finer one is folded. With few shingles a group this
tells long texts apart as well as short ones.

*Routing.* All shingles stand in one order. Of a text of n shingles at most D are not in a
text it links with, which follows from n and ``percent``; so the first shingle that both have
is among the first D + 1 of either. These are the keys of a text, and texts meet in the cell
of a key that they share. Any order does. Here rare shingles come first: the shingles of a
line that very many texts have are keys only of texts that have little else. How frequent a
shingle is, is counted by buckets of hashes: a guess, which moves work but no link.

*Links.* Texts of one set are one node. In a cell all nodes are first compared with one
leader, which settles large groups of copies without comparing their members. Cells whose
nodes still belong to different components get other leaders, drawn per cell, and those
that stay open are searched with an R-tree over the points: its boxes and points are passed
over if the bound is too small. Cells of the same nodes are searched once. Pairs that survive
meet as pairs of blocks of nodes, where they are bounded again by points with a group for
each shingle and then verified on their whole sets. No pair is left out at any size, and no cell is gathered: hot
cells meet as leaders of blocks, then as pairs of blocks.

Shingles are compared as 52-bit hashes and sets as 64-bit sums of them: two different
shingles of a pair of texts agree with a chance of about ``|A| * |B| / 2 ** 52``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.components import components
from factmill.llm.rows import numbered
from factmill.llm.words import LOWER, blocks, hashed_words, mix
from factmill.session import batches_of, settle

GROUPS = 128
LOAD = 4
BUCKETS = 1 << 22
"""Buckets of hashes in which shingles are counted."""
SLICE = 1 << 14
"""Buckets whose counts are added up at once."""
STEPS = 4
"""Bands of frequency for each doubling of a count."""
LEAF = 16
CHUNK = 4000
"""Nodes of a block of a cell in the search by R-tree."""
CHUNK_BYTES = 16 << 20
"""Bytes of their points."""
SEARCHED = 1 << 21
"""Counts that queries of a block are compared with at once."""
UNIT_NODES = 500
UNIT_BYTES = 8 << 20
"""Nodes, and bytes of their texts, of a block in the comparison of whole sets."""
SENT_ROWS = 1_000_000
"""Rows of small ids up to which they are sent to all tasks; beyond it they are joined."""
BLOCK_KEYS = 500_000
"""Keys that a task pairs at once; some 150 bytes each while it does."""
BLOCK_TEXT = 1 << 18
"""Bytes of text hashed at once; some 100 bytes each while they are."""
BATCH = 4 << 20
"""Bytes of texts that a task is sent at once."""
ROUNDS = 2
"""Times that open cells get a new leader before they are searched; not a bound on links."""
_BITS = np.uint64(52)
_MASK = np.uint64((1 << 52) - 1)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts: their text and 52-bit hash, sorted by both.

    A text of fewer words than ``size`` has one shingle, its whole sequence; one without
    words has none. At most 4,096 texts at a time.
    """
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    h = mix(words, size)
    for step in range(1, min(size, len(words) + 1)):
        h[: len(h) - step] = mix(h[: len(h) - step] * np.uint64(0x9FB21C651E98DF25) + words[step:], step)
    fits = np.arange(len(words)) + size <= bounds[1:][row] if len(words) else np.zeros(0, bool)
    rows, values = [row[fits]], [h[fits]]
    for text in np.flatnonzero((count > 0) & (count < size)):
        whole = np.uint64(count[text])
        for word in words[bounds[text] : bounds[text + 1]]:
            whole = mix(np.array([whole], np.uint64) ^ word, 99)[0]
        rows.append(np.array([text]))
        values.append(np.array([whole], np.uint64))
    keys = np.concatenate(rows).astype(np.uint64) << _BITS | np.concatenate(values) >> np.uint64(12)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> _BITS).astype(np.int64), keys & _MASK


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first, behind the last, and their shingles by row and hash."""
    for i, j, data, bounds in blocks(column, BLOCK_TEXT):
        starts, _, hashes = hashed_words(LOWER[data], bounds)
        at = np.searchsorted(starts, bounds)
        for a in range(0, j - i, 4096):
            b = min(a + 4096, j - i)
            row, h = shingle_sets(hashes[at[a] : at[b], 0], at[a : b + 1] - at[a], size)
            yield i + a, i + b, row, h


class Bands:
    """The order of shingles, by bands of frequency and then by hash, and how many are keys.

    ``of_bucket`` has the band of each bucket of hashes; without it all are in one band.
    """

    def __init__(self, percent: int, of_bucket: np.ndarray | None = None) -> None:
        self.percent, self.of_bucket = percent, of_bucket

    def of(self, h: np.ndarray) -> np.ndarray:
        return np.zeros(len(h), np.uint8) if self.of_bucket is None else self.of_bucket[bucket_of(h)]

    def keys(self, n: np.ndarray) -> np.ndarray:
        """One more than a text of ``n`` shingles can have that are not in a text it links with."""
        return np.where(n > 0, n + -self.percent * n // 100 + 1, 0)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (mix(h, 5) % np.uint64(BUCKETS)).astype(np.int64)


def bands_of(docs: DataFrame, size: int) -> np.ndarray:
    """The band of each bucket, by the number of shingles of all texts that fall into it."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(BUCKETS, np.int32), False
        for batch in batches:
            for _, _, _, h in text_sets(batch.column(0), size):
                np.add.at(counts, bucket_of(h), 1)
                some = some or len(h) > 0
        for at in range(0, BUCKETS if some else 0, SLICE):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([counts[at : at + SLICE].tobytes()], pa.binary())], ["first", "counts"]
            )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(SLICE, np.int64)

        def banded() -> pa.RecordBatch:
            band = np.where(total > 0, 1 + STEPS * np.log2(np.maximum(total, 1)), 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([band.tobytes()], pa.binary())], ["first", "bands"])

        for batch in batches:
            for first, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if first != last:
                    if last is not None:
                        yield banded()
                    last, total = first, np.zeros(SLICE, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.int32)
        if last is not None:
            yield banded()

    # of fixed size
    made = (
        docs.select("text")
        .mapInArrow(within, "first long, counts binary")
        .repartition("first")
        .sortWithinPartitions("first")
        .mapInArrow(across, "first long, bands binary")
        .collect()
    )
    out = np.zeros(BUCKETS, np.uint8)
    for first, bands in made:
        out[first : first + SLICE] = np.frombuffer(bands, np.uint8)
    return out


def cell_keys(row: np.ndarray, h: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of texts: their text and 64-bit key, grouped by text; shingles come by text and hash."""
    order = np.argsort(row << 8 | bands.of(h), kind="stable")
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    chosen = order[place < bands.keys(n)[row]]
    return row[chosen], mix(h[chosen], 8)


def _node(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((2, len(n)), np.uint64)
    for k in range(2):
        np.add.at(out[k], row, mix(h, 20 + k))
    return mix(out[0] ^ mix(out[1], 22)).view(np.int64)


def groups_of(n: np.ndarray, load: int) -> np.ndarray:
    """Groups of the points of texts of ``n`` shingles: a power of two."""
    least = np.maximum(-(-n // load), GROUPS)
    return np.int64(1) << np.ceil(np.log2(least)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """A byte a group unless a count is larger."""
    kind = "u1" if counts.max() < 256 else "<u4"
    return kind[-1].encode() + counts.astype(kind).tobytes()


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_shingles``, ``node`` and ``counts`` of every text.

    ``node`` tells sets apart and is null for texts without words. ``docs`` has its rows
    numbered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_shingles", "node", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, h in text_sets(batch.column(2), size):
                n = np.bincount(row, minlength=j - i)
                groups = groups_of(n, LOAD)
                first = np.cumsum(groups) - groups
                group = (h & (groups - 1).astype(np.uint64)[row]).astype(np.int64)
                found = np.bincount(first[row] + group, minlength=int(groups.sum()))
                counts = [_packed(own) for own in np.split(found, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(_node(row, h, n), mask=n == 0),
                        pa.array(counts, pa.binary()),
                    ],
                    names,
                )

    return docs.select("row", "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, n_shingles long, node long, counts binary"
    )


def cells_of(column: pa.Array, size: int, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and keys of texts, a pair of equal length for each run of rows."""
    for i, j, row, h in text_sets(column, size):
        n = np.bincount(row, minlength=j - i)
        owner, keys = cell_keys(row, h, n, bands)
        yield _node(row, h, n)[owner], keys.view(np.int64)


def keyed(rows: DataFrame, size: int, percent: int, sent: Broadcast | None = None) -> DataFrame:
    """``node``, ``key`` and ``width``, one row per cell of each text of ``rows``.

    ``width`` is the number of groups of the node's point; ``sent`` has the bands of the buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, sent and sent.value)
        for batch in batches:
            for i, j, row, h in text_sets(batch.column(0), size):
                n = np.bincount(row, minlength=j - i)
                owner, key = cell_keys(row, h, n, bands)
                width = groups_of(n, LOAD)[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (_node(row, h, n)[owner], key.view(np.int64), width)],
                    ["node", "key", "width"],
                )

    return rows.select("text").mapInArrow(run, "node long, key long, width long")


def met_keys(rows: DataFrame, size: int, percent: int, sent: Broadcast | None = None) -> DataFrame:
    """``key`` of all cells in which texts of different components meet, once each.

    A block of a task sends the smallest and largest component under a key; these are sorted
    and passed through, so that no task holds a table of its keys.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have, bands = 0, Bands(percent, sent and sent.value)

        def combined() -> pa.RecordBatch:
            key, component = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, component = key[order], component[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = (f.reduceat(component, at) for f in (np.minimum, np.maximum))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], low, high)], ["key", "low", "high"])

        for batch in batches:
            component = batch.column(1).to_numpy()
            for i, j, row, h in text_sets(batch.column(0), size):
                owner, key = cell_keys(row, h, np.bincount(row, minlength=j - i), bands)
                if len(key):
                    held.append((key.view(np.int64), component[i:j][owner]))
                    have += len(key)
                if have >= BLOCK_KEYS:
                    yield combined()
                    held, have = [], 0
        if have:
            yield combined()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last key of a batch may go on in the next
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(last))
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, low, high = key[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            last = [x[-1:] for x in (key, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][low[:-1] < high[:-1]])], ["key"])
        key, low, high = last
        yield pa.RecordBatch.from_arrays([pa.array(key[low < high])], ["key"])

    return (
        rows.select("text", "component")
        .mapInArrow(within, "key long, low long, high long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(across, "key long")
    )


def shared_cells(rows: DataFrame, size: int, percent: int, sent: Broadcast | None = None) -> DataFrame:
    """``node``, ``key`` and ``width`` in all cells in which texts of different components meet.

    The keys are made twice rather than stored: first to find these cells, which takes a
    row per key and block of a task, then to pick their members.
    """
    cells = settle(met_keys(rows, size, percent, sent), "shared")
    if cells.count() <= SENT_ROWS:
        cells = F.broadcast(cells)
    return settle(keyed(rows, size, percent, sent).join(cells, "key").select("node", "key", "width"), "nodes")


def leaders(docs: DataFrame, size: int, percent: int, sent: Broadcast | None = None) -> DataFrame:
    """Pairs of nodes that share a key with one of them as leader.

    Nodes of a task that share a key are paired there, and only the first goes on under the
    key; so a key that very many nodes share arrives once from each block of a task.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have, bands = 0, Bands(percent, sent and sent.value)

        def combined() -> Iterator[pa.RecordBatch]:
            node, key = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            lead = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            pair = lead != node
            both = np.unique(np.stack([lead[pair], node[pair]], 1), axis=0)
            # the pairs travel along under any key
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[first], both[:, 1]])),
                    pa.array(np.concatenate([node[first], both[:, 1]])),
                    pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(both[:, 0])]),
                ],
                ["key", "node", "leader"],
            )

        for batch in batches:
            for node, key in cells_of(batch.column(0), size, bands):
                if not len(key):
                    continue
                held.append((node, key))
                have += len(key)
                if have >= BLOCK_KEYS:
                    yield from combined()
                    held, have = [], 0
        if have:
            yield from combined()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_lead = None, 0
        for batch in batches:
            ready = batch.filter(batch.column(2).is_valid())
            yield pa.RecordBatch.from_arrays([ready.column(2), ready.column(1)], ["a", "b"])
            batch = batch.filter(batch.column(2).is_null())
            key, node = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(key):
                continue
            first = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            lead = np.where(at >= 0, node[at], last_lead)
            last_key, last_lead = key[-1], lead[-1]
            pair = lead != node
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead[pair]), pa.array(node[pair])], ["a", "b"]
            )

    return (
        docs.select("text")
        .mapInArrow(within, "key long, node long, leader long")
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(across, "a long, b long")
        .distinct()
    )


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points packed into boxes, boxes into larger boxes; searched by bounded overlap.

    A box keeps the largest coordinates and the smallest size below it: the summed
    minima with a query bound its overlap with any point in the box.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # sort by size, then tile by the coordinates in turn
        order = np.lexsort((*[points[:, k] for k in range(min(3, points.shape[1]))][::-1], sizes))
        self.order = order
        tops, least = points[order], sizes[order]
        self.levels = [(tops, least)]
        while len(tops) > LEAF:
            at = np.arange(0, len(tops), LEAF)
            tops = np.maximum.reduceat(tops, at, axis=0)
            least = np.minimum.reduceat(least, at)
            self.levels.append((tops, least))

    def search_all(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the points whose overlap with them is bounded by no less than a link needs.

        Queries descend together, as many as keep their pairs with the lowest level small.
        """
        step = max(1, SEARCHED // max(self.levels[0][0].size, 1))
        asked, found = [], []
        for a in range(0, len(points), step):
            query = np.arange(a, min(a + step, len(points)))
            top = len(self.levels[-1][0])
            query, live = np.repeat(query, top), np.tile(np.arange(top), len(query))
            for depth in range(len(self.levels) - 1, -1, -1):
                tops, least = self.levels[depth]
                # a sum of counts is at most a size, which the type of the counts holds
                bound = np.add.reduce(np.minimum(tops[live], points[query]), axis=1, dtype=tops.dtype)
                keep = bound >= least_overlap(sizes[query], least[live], percent)
                query, live = query[keep], live[keep]
                if depth:
                    live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
                    inside = live < len(self.levels[depth - 1][0])
                    query, live = np.repeat(query, LEAF)[inside], live[inside]
            asked.append(query)
            found.append(self.order[live])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, found))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The points that one query finds."""
        return self.search_all(point[None], np.array([size]), percent)[1]


def _alike(values: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Points of one number of groups: where they are, and their counts, a row each."""
    found: dict[tuple[bytes, int], list[int]] = {}
    for k, value in enumerate(values):
        found.setdefault((value[:1], len(value)), []).append(k)
    for (kind, _), at in found.items():
        raw = np.frombuffer(b"".join(values[k][1:] for k in at), "u1" if kind == b"1" else "<u4")
        yield at, raw.reshape(len(at), -1)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    if counts.shape[1] == groups:
        return counts
    return counts.reshape(len(counts), -1, groups).sum(1, dtype=np.uint32)


def points_of(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Points in the groups of the coarsest of them, a row each."""
    alike = list(_alike(column.to_pylist()))
    groups = min(counts.shape[1] for _, counts in alike)
    out = np.empty((len(sizes), groups), np.uint16 if sizes.max() < 1 << 16 else np.uint32)
    for at, counts in alike:
        out[at] = _folded(counts, groups)
    return out


def bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bounds of the overlap of pairs by their points."""
    out = np.zeros(len(a), np.int64)
    for at, left in _alike(a):
        at = np.array(at)
        for some, right in _alike([b[k] for k in at]):
            groups = min(left.shape[1], right.shape[1])
            both = np.minimum(_folded(left[some], groups), _folded(right, groups))
            out[at[some]] = both.sum(1, dtype=np.int64)
    return out


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose overlap may suffice by their points (node, n_shingles, counts)."""
    for side in ("a", "b"):
        pairs = pairs.join(
            points.select(
                F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("counts").alias(f"c_{side}")
            ),
            side,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = least_overlap(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            found = [
                bounds(*(batch.column(c).slice(k, 256).to_pylist() for c in (4, 5)))
                for k in range(0, batch.num_rows, 256)
            ]
            keep = np.concatenate(found) >= least if found else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(run, "a long, b long")


def wanted_texts(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the nodes of the pairs."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = settle(points.select("row", "node").join(nodes, "node"), "wanted")
    if wanted.count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "row").select("node", "text")


def fine_point(own: np.ndarray) -> bytes:
    """The point of a set with as many groups as it has shingles, a power of two."""
    groups = int(groups_of(np.array([len(own)]), 1)[0])
    return _packed(np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups))


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets; ``pairs`` passed the bound by ``points``.

    Nodes are dealt into blocks of bounded size, pairs into pairs of blocks, to which the
    text of each node goes once, however many pairs it stands in there. Pairs are bounded
    once more, by points of more groups, before their sets are compared.
    """
    texts = settle(wanted_texts(pairs, points, docs), "texts", "zstd")
    nodes, room = texts.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    parts = max(-(-nodes // UNIT_NODES), -(-(room or 0) // UNIT_BYTES), 1)
    i, j = (F.pmod(F.xxhash64(side), F.lit(parts)) for side in ("a", "b"))
    units = pairs.select("a", "b", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    needed = units.select(F.col("i").alias("p"), F.col("j").alias("q"), F.col("a").alias("node"))
    needed = needed.union(units.select("i", "j", "b")).distinct().join(texts, "node")

    def compare(unit: pa.Table, held: pa.Table) -> pa.Table:
        node = held.column("node").to_numpy()
        order = np.argsort(node)
        a, b = (
            order[np.searchsorted(node, unit.column(side).to_numpy(), sorter=order)] for side in ("a", "b")
        )
        sets = list(_lined_up(text_sets(held.column("text").combine_chunks(), size)))
        n = np.array([len(own) for own in sets], np.int64)
        fine = [fine_point(own) for own in sets]
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 256):
            some = slice(k, k + 256)
            bound = bounds([fine[x] for x in a[some]], [fine[x] for x in b[some]])
            keep[some] = bound >= least_overlap(n[a[some]], n[b[some]], percent)
        for k in np.flatnonzero(keep):
            both = np.concatenate([sets[a[k]], sets[b[k]]])
            both.sort(kind="stable")  # merges two sorted runs
            common = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * common >= percent * (len(both) - common)
        return unit.select(["a", "b"]).filter(pa.array(keep))

    return (
        units.groupBy("i", "j").cogroup(needed.groupBy("p", "q")).applyInArrow(compare, "a long, b long")
    )


def _lined_up(runs: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    for i, j, row, h in runs:
        at = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            yield h[at[k] : at[k + 1]]


def open_cells(nodes: DataFrame, labels: DataFrame, draw: int) -> tuple[DataFrame, DataFrame]:
    """Cells with nodes of different components, and the rows of these cells.

    ``nodes``: node, key and width; ``labels``: node and component. A cell has its number of
    nodes, the bytes of their points, as ``pick`` the smallest of numbers drawn for them and
    as ``main`` the component of that node. Of cells of the same nodes one is kept: they
    offer the same pairs.
    """
    labelled = nodes.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "key", "width"
    )
    labelled = labelled.withColumn("drawn", F.xxhash64("key", "node", F.lit(draw)))
    cells = labelled.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("many"),
        F.sum("width").alias("bytes"),
        F.min(F.struct("drawn", "component")).alias("first"),
        *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in range(2)],
    )
    cells = cells.where("low < high").groupBy("many", "bytes", "same0", "same1").agg(
        F.min(F.struct("key", "first")).alias("one")
    )
    cells = settle(
        cells.select(
            "one.key",
            "many",
            "bytes",
            F.col("one.first.drawn").alias("pick"),
            F.col("one.first.component").alias("main"),
        ),
        "open",
    )
    members = settle(labelled.join(cells, "key"), "members")
    return cells, members


def other_leaders(members: DataFrame) -> DataFrame:
    """Pairs of each node of an open cell with the one drawn, if of another component."""
    drawn = members.where(F.col("drawn") == F.col("pick")).select(
        "key", F.col("node").alias("lead"), F.col("component").alias("lead_component")
    )
    pairs = members.join(settle(drawn, "drawn"), "key").where("component != lead_component")
    return pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def cell_pairs(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """All pairs of an open cell, of different components, that pass the bound, by R-tree.

    Of two such nodes one is not of the main component. In a cell of many nodes these, the
    minor ones, are dealt into blocks, and the others into blocks behind them; every minor
    block is searched in itself and in each later block.
    """
    blocks = lambda share: F.greatest(
        F.ceil(share * F.col("many") / CHUNK), F.ceil(share * F.col("bytes") / CHUNK_BYTES), F.lit(1)
    ).cast("int")
    minor = F.col("component") != F.col("main")
    shares = settle(
        members.groupBy("key").agg((F.count_if(minor) / F.count("*")).alias("share")), "shares"
    )
    dealt = members.join(shares, "key").select(
        "key",
        "node",
        "component",
        "main",
        F.when(blocks(F.lit(1.0)) == 1, 0).when(minor, blocks(F.col("share"))).otherwise(
            blocks(1 - F.col("share"))
        ).alias("own"),
        blocks(F.col("share")).alias("minors"),
        (blocks(F.col("share")) + blocks(1 - F.col("share"))).alias("parts"),
        minor.alias("minor"),
    )
    # a cell of one block has no own blocks
    mine = F.when(F.col("own") == 0, 0).otherwise(
        F.pmod(F.xxhash64("node"), F.col("own")) + F.when(F.col("minor"), 0).otherwise(F.col("minors"))
    )
    others = F.when(F.col("own") == 0, 1).when(F.col("minor"), F.col("parts")).otherwise(F.col("minors"))
    cells = dealt.withColumn("mine", mine.cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), others - 1))
    )
    cells = cells.select(
        "key",
        "node",
        "component",
        "main",
        "mine",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    ).join(points.select("node", "n_shingles", "counts"), "node")

    def search(cell: pa.Table) -> pa.Table:
        node, component, main, mine, sizes = (
            cell.column(c).to_numpy() for c in ("node", "component", "main", "mine", "n_shingles")
        )
        points = points_of(cell.column("counts").combine_chunks(), sizes)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        indexed = np.flatnonzero(mine == j)
        asked = np.flatnonzero((mine == i) & (component != main))
        a = b = np.zeros(0, np.int64)
        if len(indexed) and len(asked):
            tree = RTree(points[indexed], sizes[indexed])
            a, b = tree.search_all(points[asked], sizes[asked], percent)
            a, b = asked[a], indexed[b]
        other = component[a] != component[b]
        both = np.sort(np.stack([node[a[other]], node[b[other]]], 1), axis=1)
        both = np.unique(both, axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return cells.groupBy("key", "i", "j").applyInArrow(search, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``row``, doc_id, ``n_shingles``,
    ``component_id``, the smallest doc_id of all that links reach, itself included, and
    ``kept``: true for one row of that id in each component.

    Words are runs without ASCII white space, A-Z lower-cased. Texts without words, null
    texts included, link with nothing. Repeated rows, whatever their doc_id, share a set
    and are one group. An empty table gives no rows.
    """
    return numbered_groups(numbered(docs, "doc_id", "text"), size, percent)


def numbered_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The same of ``docs`` (row, doc_id, text), whose rows are numbered."""
    with batches_of(docs.sparkSession, BATCH):
        return _numbered_groups(docs, size, percent)


def _numbered_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    profile = settle(profiles(docs, size), "profiles")
    sets = profile.where("node is not null")
    # the smallest doc_id, a null one last
    first_of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = settle(
        sets.groupBy("node")
        .agg(F.min(first_of).alias("first"))
        .select("node", "first.row", "first.doc_id"),
        "classes",
    )
    points = settle(
        sets.select("row", "n_shingles", "counts").join(classes.select("row", "node"), "row"), "points"
    )
    sent = docs.sparkSession.sparkContext.broadcast(bands_of(docs, size))
    pairs = settle(leaders(docs, size, percent, sent), "leaders")
    close = settle(bounded(pairs, points, percent), "pairs")
    links = settle(verified(close, points, docs, size, percent), "links")
    labels = components(links)
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    touched = classes.select("row", "node").join(touched, "node").join(labels, "node", "left")
    touched = settle(touched.select("row", F.coalesce("component", "node").alias("component")), "touched")
    if touched.count() <= SENT_ROWS:
        touched = F.broadcast(touched)
    nodes = shared_cells(docs.join(touched, "row"), size, percent, sent)
    for draw in range(ROUNDS + 1):
        cells, members = open_cells(nodes, labels, draw)
        if cells.isEmpty():
            break
        # a cell that is closed stays so
        nodes = members.select("node", "key", "width")
        if draw == ROUNDS:
            rest = cell_pairs(members, points, percent)
        else:
            rest = bounded(other_leaders(members), points, percent)
        more = verified(settle(rest, "rest"), points, docs, size, percent)
        links = settle(links.union(more), "links")
        labels = components(links)
    named = classes.join(labels, "node", "left").select(
        "node", "doc_id", "row", F.coalesce("component", "node").alias("component")
    )
    named = settle(named, "named")
    least = named.groupBy("component").agg(F.min(first_of).alias("first"))
    least = settle(least, "least")
    group = named.join(least, "component").select(
        "node", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("head")
    )
    group = settle(group, "groups")
    return profile.select("row", "doc_id", "n_shingles", "node").join(group, "node", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("kept"),
    )
