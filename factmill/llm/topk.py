"""Exact top-k by inner product of integer vectors: MaxScore over sharded postings.

Every dimension is a term, its postings the components of a shard's vectors. For a query
each term's contribution lies between bounds known per shard. Terms are ordered by the
width of these bounds; the last ones, whose upper bounds together cannot lift a vector
without the others over the query's k-th best score, are non-essential. The postings of
the essential terms are traversed; only vectors that stay competitive are probed in the
others, a few terms at a time, and dropped once their bound falls below the k-th best
score. The best of all shards are merged. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.session import settle

SHARD_ROWS = 4096
QUERY_ROWS = 256
STEP = 8
EXACT = 2**53


def integer_vectors(df: DataFrame, scale: int = 1024, name: str = "embedding") -> DataFrame:
    """``row``, ``vec_id`` and ``vector`` of floor(scale * x); rows are numbered by place.

    Null vectors and those with a null or non-finite component are left out.
    """
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.monotonically_increasing_id().alias("row"), "vec_id", name)
        .where(F.col(name).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(
            "row",
            "vec_id",
            F.transform(name, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
        )
    )


def _packed(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """About ``rows`` vectors each in one row, their components by dimension; and how many."""
    parts = max(1, -(-vectors.count() // rows))

    def build(group: pa.Table) -> pa.Table:
        lists = group.column("vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        # a shorter vector is zero in its missing dimensions
        matrix = np.zeros((len(lengths), width), np.int64)
        matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
        return pa.table(
            {
                name: group.column(name).slice(0, 1),
                "rows": pa.array([group.column("row").to_numpy().tobytes()], pa.binary()),
                "ids": pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "dims": pa.array([width], pa.int64()),
                "postings": pa.array([np.ascontiguousarray(matrix.T).tobytes()], pa.binary()),
            }
        )

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)))
    packed = dealt.groupBy(name).applyInArrow(
        build, f"{name} long, rows binary, ids binary, dims long, postings binary"
    )
    return settle(packed, name), parts


class Shard:
    """The postings of a shard, by dimension, with the bounds of each."""

    def __init__(self, rows: bytes, ids: bytes, dims: int, postings: bytes) -> None:
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.postings = np.frombuffer(postings, np.int64).reshape(dims, -1)
        self.high = self.postings.max(1, initial=np.iinfo(np.int64).min)
        self.low = self.postings.min(1, initial=np.iinfo(np.int64).max)
        self.largest = max(int(np.abs(self.postings).max(initial=0)), 1)
        self.floats = self.postings.astype(float)

    def best(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the vectors that may be among the k best, by MaxScore.

        ``least`` is the k-th best score so far, if there are k; ``own`` the query's row.
        """
        dims = min(len(query), len(self.postings))
        query = query[:dims]
        exact = dims * self.largest * max(int(np.abs(query).max(initial=0)), 1) < EXACT
        postings = self.floats if exact else self.postings
        query = query.astype(float) if exact else query
        ends = np.stack([query * self.low[:dims], query * self.high[:dims]])
        high, low = ends.max(0), ends.min(0)
        order = np.argsort(low - high, kind="stable")
        # what the terms from each place on can add at most
        rest = np.concatenate([np.cumsum(high[order][::-1])[::-1], [0]])
        spread = np.concatenate([np.cumsum((high - low)[order][::-1])[::-1], [0]])
        split = dims if least is None else int(np.argmax(spread < least - low.sum())) if (spread < least - low.sum()).any() else dims
        live = np.flatnonzero(self.rows != own)
        essential = order[:split]
        scores = (query[essential] @ postings[essential])[live]
        at = split
        while True:
            if least is not None:
                keep = scores + rest[at] >= least
                live, scores = live[keep], scores[keep]
            if at >= dims or not len(live):
                break
            terms = order[at : at + STEP]
            scores = scores + query[terms] @ postings[terms[:, None], live]
            at += len(terms)
        scores = np.round(scores).astype(np.int64) if exact else scores
        if len(scores) > k:
            kth = -np.partition(-scores, k - 1)[k - 1]
            keep = scores >= kth
            live, scores = live[keep], scores[keep]
            if len(live) > k:
                first = np.lexsort((self.rows[live], self.ids[live], -scores))[:k]
                live, scores = live[first], scores[first]
        return live, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k best of all other rows for every row of ``vectors`` that ``is_query`` holds for.

    ``vectors`` has ``row``, ``vec_id`` and ``vector`` (array of long). Returns query_id,
    ``rank`` from 1, vec_id and ``score``, fewer than k rows where there are fewer others.
    Ties go to the smaller vec_id, then the earlier row; of repeated rows each is a query
    and a candidate of its own. A vector that is shorter than another counts as zero in the
    dimensions it lacks. Null ids take no part. Scores must fit into 64 bits.
    """
    vectors = settle(vectors.where(F.col("vec_id").isNotNull()), "vectors")
    shards, _ = _packed(vectors, SHARD_ROWS, "shard")
    queries, blocks = _packed(vectors.where(is_query), QUERY_ROWS, "block")
    asked = queries.select("block", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "dims", "postings")])
    met = (
        shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        .join(asked, "block")
        .select("block", "rows", "ids", "dims", "postings", "q_rows", "q_ids", "q_dims", "q_postings")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k best scores of each query in the shards that this task has seen
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                _, *values = (c[n].as_py() for c in batch.columns)
                shard = Shard(*values[:4])
                rows, ids = (np.frombuffer(v, np.int64) for v in values[4:6])
                matrix = np.frombuffer(values[7], np.int64).reshape(values[6], -1).T
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for row, vec_id, query in zip(rows.tolist(), ids.tolist(), matrix):
                    best = seen.get(row, np.zeros(0, np.int64))
                    places, scores = shard.best(query, row, k, int(best[-1]) if len(best) == k else None)
                    seen[row] = -np.sort(-np.concatenate([best, scores]))[:k]
                    many = len(places)
                    for column, value in zip(out, (np.full(many, row), np.full(many, vec_id), shard.rows[places], shard.ids[places], scores)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out],
                    ["query_row", "query_id", "row", "vec_id", "score"],
                )

    found = met.mapInArrow(
        search, "query_row long, query_id long, row long, vec_id long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
