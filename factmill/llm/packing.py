"""Packing by lexical retrieval: windows filled with documents that resemble their seed.

Every document's ids, ended by one id, fill windows of their own as long as they can. The
rest of each (less than a window) is ordered by a sketch of its id pairs, so that alike
texts come together, and cut into shards of bounded size. A shard holds a BM25 index over
its documents, with idf from all documents of the table. A seed, the next unused document,
fetches the unused neighbours in order of score, and these fill its window; the first that
does not fit is cut, and its remainder stays in the index. So all windows are full, but
for the last ids of a task, which become sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.wordids import PATH, word_ids
from factmill.llm.words import mix
from factmill.session import batches_of, settle

WINDOW = 4096
END_ID = 2
SHARD_IDS = 1 << 20
"""Ids of a shard, the documents of one index."""
TASK_IDS = 1 << 23
"""Ids that a task packs, shard after shard."""
BATCH = 4 << 20
"""Bytes of texts that a task is sent at once."""
K1, B = 1.2, 0.75

TAILS = (
    "row long, doc_id {id}, doc_tokens long, windows array<long>, sequence long, "
    "start long, tail binary, sketch long, token int, df long"
)
PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def document_frequency(ids: np.ndarray, bounds: np.ndarray, size: int, docs: int = 128) -> np.ndarray:
    """In how many documents each id occurs: marks in a table of some documents at a time."""
    total = np.zeros(size, np.int64)
    for at in range(0, len(bounds) - 1, docs):
        to = min(at + docs, len(bounds) - 1)
        own = ids[bounds[at] : bounds[to]].astype(np.int64)
        marks = np.zeros(((to - at), size), np.uint8)
        marks.ravel()[np.repeat(np.arange(to - at) * size, np.diff(bounds[at : to + 1])) + own] = 1
        total += marks.sum(0, dtype=np.uint8)
    return total


def _sketches(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest hash of two neighbouring ids of each document; 0 without two ids."""
    out = np.zeros(len(bounds) - 1, np.int64)
    if not len(ids):
        return out
    pairs = np.full(len(ids), np.iinfo(np.uint64).max, np.uint64)
    pairs[:-1] = mix(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:])
    size = np.diff(bounds)
    # no pair across two documents
    pairs[bounds[1:][size > 0] - 1] = np.iinfo(np.uint64).max
    some = size > 0
    least = np.minimum.reduceat(pairs, bounds[:-1][some])
    out[some] = np.where(size[some] > 1, least >> np.uint64(1), 0).astype(np.int64)
    return out


def tokenized(docs: DataFrame, path: str = PATH, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Full windows and the rest of every document; in other rows each task's id counts.

    ``windows`` has the checksums of the full windows, ``sequence`` the number of the first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path, plain=False)
        task = TaskContext.get().partitionId()
        frequency = np.zeros(coder.size, np.int64)
        row, sequence = task << 33, (1 << 62) | (task << 33)
        little = np.dtype(coder.type).newbyteorder("<")
        names = ["row", "doc_id", "doc_tokens", "windows", "sequence", "start", "tail", "sketch", "token", "df"]
        for batch in batches:
            for i, j, ids, bounds in coder.column(batch.column(1)):
                n = j - i
                frequency += document_frequency(ids, bounds, coder.size)
                # every document's ids and its end, one behind the other
                own = np.full(len(ids) + n, end_id, coder.type)
                inside = np.ones(len(own), bool)
                inside[bounds[1:] + np.arange(n)] = False
                own[inside] = ids
                first = bounds + np.arange(n + 1)
                full = np.diff(first) // window
                starts = full * window
                flat = own.astype(little).tobytes()
                begin = ((first[:-1] + starts) * little.itemsize).tolist()
                tails = [flat[a:b] for a, b in zip(begin, (first[1:] * little.itemsize).tolist())]
                windows: list[list[int]] = [[] for _ in range(n)]
                for k in np.flatnonzero(full).tolist():
                    cuts = range(first[k], first[k] + starts[k], window)
                    windows[k] = [_crc(own[cut : cut + window]) for cut in cuts]
                numbers = sequence + np.cumsum(full) - full
                sequence += int(full.sum())
                sketches = _sketches(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(i, n),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(windows, pa.list_(pa.int64())),
                        pa.array(numbers.astype(np.int64)),
                        pa.array(starts.astype(np.int64)),
                        pa.array(tails, pa.binary()),
                        pa.array(sketches),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names,
                )
                row += n
        tokens = np.flatnonzero(frequency)
        n = len(tokens)
        empty = [pa.nulls(n, t) for t in (pa.int64(), id_type[0], pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array(tokens.astype(np.int32)), pa.array(frequency[tokens])], names
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = [to_arrow_type(docs.schema["doc_id"].dataType)]
    return docs.select("doc_id", "text").mapInArrow(run, TAILS.format(id=kind))


class Index:
    """BM25 over the documents of one shard; ``ids`` are their ids one behind the other.

    Every id with an idf is indexed, frequent ones too. A seed's ids lie in most of the
    documents, so one pass over all entries scores them, and documents that are used up
    leave the index.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray) -> None:
        length = np.array([len(d) for d in docs])
        ids = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), length)
        indexed = idf[ids] > 0
        keys, times = np.unique(owner[indexed] * len(idf) + ids[indexed], return_counts=True)
        self.doc, self.term = np.divmod(keys, len(idf))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1))
        self.weight = idf[self.term] * times * (K1 + 1) / (times + norm[self.doc])
        self.asked = np.zeros(len(idf))
        self.n = self.live = len(docs)
        self.of = np.searchsorted(self.doc, np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share an indexed id with the seed, best first."""
        terms = self.term[self.of[seed] : self.of[seed + 1]]
        live = self.n - np.count_nonzero(used)
        if 4 * live < 3 * self.live:
            keep = ~used[self.doc]
            keep[self.of[seed] : self.of[seed + 1]] = True
            self.doc, self.term, self.weight = self.doc[keep], self.term[keep], self.weight[keep]
            self.of = np.searchsorted(self.doc, np.arange(self.n + 1))
            self.live = live
        self.asked[terms] = 1
        scores = np.bincount(self.doc, self.weight * self.asked[self.term], self.n)
        self.asked[terms] = 0
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(
    docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW
) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows as lists of (document, start, length), and what is left over."""
    index = Index(docs, idf)
    length = np.array([len(d) for d in docs])
    taken = np.zeros(len(docs), np.int64)
    used = length == 0
    windows: list[list[tuple[int, int, int]]] = []
    at, room, current = 0, window, []
    while True:
        while at < len(docs) and used[at]:
            at += 1
        if at == len(docs):
            return windows, current
        # the seed, its neighbours, and should these not do, the next unused documents
        for doc in _candidates(index, at, used):
            if used[doc]:
                continue
            part = min(room, int(length[doc] - taken[doc]))
            current.append((doc, int(taken[doc]), part))
            taken[doc] += part
            used[doc] = taken[doc] == length[doc]
            room -= part
            if not room:
                windows.append(current)
                room, current = window, []
                break


def _candidates(index: Index, seed: int, used: np.ndarray) -> Iterator[int]:
    yield seed
    yield from index.neighbours(seed, used).tolist()
    yield from range(seed + 1, index.n)


def powers(length: int) -> list[int]:
    """The powers of two that add up to a length, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack(tails: DataFrame, idf: np.ndarray, tasks: int, width: int, window: int = WINDOW) -> DataFrame:
    """Pieces of the rests of documents in the sequences they went to."""
    kind = tails.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[object, int, int, np.ndarray]] = []
        have = 0

        def laid(groups: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for group in groups:
                offset = 0
                for doc, start, length in group:
                    key, base, total, ids = held[doc]
                    crc = _crc(ids[start : start + length])
                    rows.append((key, base + start, length, crc, total, sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [id_type[0], *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for key, base, total, raw in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((key, base, total, np.frombuffer(raw, f"<u{width}")))
                have += len(held[-1][3])
                if have >= SHARD_IDS:
                    full, left = pack_shard([h[3] for h in held], idf, window)
                    yield laid(full)
                    # an unfinished window goes on with the next shard
                    held = [
                        (held[d][0], held[d][1] + s, held[d][2], held[d][3][s : s + n])
                        for d, s, n in left
                    ]
                    have = sum(n for _, _, n in left)
        if held:
            full, left = pack_shard([h[3] for h in held], idf, window)
            yield laid(full)
            yield laid(cut_by_powers(left))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = [to_arrow_type(tails.schema["doc_id"].dataType)]
    return (
        tails.repartitionByRange(tasks, "sketch", "row")
        .sortWithinPartitions("sketch", "row")
        .select("doc_id", "start", "doc_tokens", "tail")
        .mapInArrow(run, PIECES.format(id=kind))
    )


def cut_by_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are powers of two."""
    groups = []
    rest = list(reversed(pieces))
    for room in powers(sum(n for _, _, n in pieces)):
        group = []
        while room:
            doc, start, n = rest.pop()
            part = min(n, room)
            group.append((doc, start, part))
            room -= part
            if part < n:
                rest.append((doc, start + part, n - part))
        groups.append(group)
    return groups


def pack_documents(
    docs: DataFrame, path: str = PATH, end_id: int = END_ID, window: int = WINDOW
) -> DataFrame:
    """All documents (``doc_id``, ``text``) in sequences of at most ``window`` ids.

    One row per piece: doc_id, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` in it.
    Each id lies in one piece. A null or empty text is its end id alone. Repeated rows are
    documents of their own; an empty table has no pieces.
    """
    with batches_of(docs.sparkSession, BATCH):
        table = settle(tokenized(docs, path, end_id, window), "tokenized")
    width = np.dtype(word_ids(path, plain=False).type).itemsize
    own = table.where("row is not null")
    # one row per id of the vocabulary reaches the driver
    counts = table.where("row is null").groupBy("token").agg(F.sum("df").alias("df")).collect()
    n, ids = own.agg(F.count("*"), F.sum(F.octet_length("tail"))).first()
    idf = np.zeros(word_ids(path, plain=False).size)
    for token, df in counts:
        idf[token] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    tasks = max(1, -(-(ids or 0) // (width * TASK_IDS)))
    rests = own.where(F.octet_length("tail") > 0)
    full = own.select("doc_id", "doc_tokens", "sequence", F.posexplode("windows").alias("_w", "crc"))
    full = full.select(
        "doc_id",
        (F.col("_w") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.col("_w")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(pack(rests, idf, tasks, width, window))
