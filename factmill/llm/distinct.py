"""Words of many texts as spans of bytes and as exact numbers, and bounded heads of counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.words import WHITE

HEAD = 1 << 17
"""Rows of a table of counts that may be sent to every task."""


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts that lie one behind the other in ``data``."""
    word = ~WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The spans, which are in order and do not overlap, as binary values."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    if len(starts) and offsets[-1] != ends[-1] - starts[0]:
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    elif len(starts):
        data = data[starts[0] : ends[-1]]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers)


def exact_ids(values: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal ones only, and the distinct values by number."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def head_bound(counts: DataFrame, column: str, limit: int = HEAD) -> int:
    """A power of two that at most ``limit`` rows of ``counts`` reach in ``column``.

    Rows that reach it are the head, few enough to be sent to every task whatever the size
    of the table; the others, none of them frequent, are the tail, which is joined. At most
    64 rows, one for each number of binary digits, come to the driver.
    """
    digits = F.length(F.bin(F.col(column))).alias("digits")
    sizes = dict(counts.where(F.col(column) > 0).groupBy(digits).count().collect())
    total = 0
    for digit in sorted(sizes, reverse=True):
        total += sizes[digit]
        if total > limit:
            return 1 << digit
    return 1


def with_tail(parts: DataFrame, rest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``parts`` without a key, their ``columns`` completed from the table of the tail.

    ``parts`` has a row without a key for each ``row``, and a row with a key and ``n``, how
    often it occurs, for each key of the tail in it. ``rest`` has ``columns`` by key.
    """
    tail = parts.where(F.col(key).isNotNull()).select("row", key, F.col("n").alias("_times"))
    # neither side has a size that is known to be small
    tail = tail.join(rest.select(key, *columns).hint("merge"), key)
    tail = tail.groupBy("row").agg(*[F.sum(F.col("_times") * F.col(c)).alias(f"_{c}") for c in columns])
    whole = parts.where(F.col(key).isNull()).drop(key).hint("merge").join(tail, "row", "left")
    return whole.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop(
        *[f"_{c}" for c in columns]
    )
