"""Shuffled shards in two passes: scatter into buckets, then shuffle each bucket.

Spark functions only. Pass one sends every record to a bucket drawn by a seeded hash of
its place in the input, so that buckets are alike in size whatever the records hold. Pass
two gathers a bucket, which fits into memory by choice of their number, and puts it into
random order (``shuffle``, Spark's Fisher-Yates). The buckets in sequence are one random
order of all records; record i of it goes to shard i modulo the number of shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.session import settle

BUCKET_BYTES = 8 << 20
"""Bytes of a bucket; a task holds a few buckets at once."""
SENT_BUCKETS = 1_000_000
"""Buckets whose numbers, 16 bytes each, are sent to all tasks; beyond it they are joined."""


def scatter(df: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass one and two: ``_bucket``, the place ``_at`` in it, and the record."""
    place = F.monotonically_increasing_id()
    record = F.struct(*[df[f"`{c}`"] for c in df.columns])
    drawn = df.select(record.alias("_record"), place.alias("_place")).select(
        F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(buckets)).alias("_bucket"),
        F.struct(F.xxhash64(F.lit(~seed), "_place").alias("_key"), "_place", "_record").alias("_row"),
    )
    gathered = (
        drawn.repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
    )
    # sorted first, so that the order does not depend on the arrival of the rows
    mixed = F.shuffle(F.array_sort("_rows"), seed)
    return gathered.select("_bucket", F.posexplode(mixed).alias("_at", "_row")).select(
        "_bucket", "_at", "_row._record"
    )


def shuffled_shards(
    df: DataFrame,
    shards: int,
    size: Column,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All records with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in it).

    The counts of the shards differ by one at most. ``size`` is a record's bytes and
    decides how many buckets there are. Columns of ``df`` that are named shard or slot are
    replaced. Equal rows are records of their own; an empty table gives no rows.

    ``df`` should read stored tables, so that a repeated task sees its rows in the same
    order. The scattered records are settled: a lost executor repeats single buckets
    before, and nothing but a join with one row per bucket after it.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    (total,) = df.agg(F.sum(size)).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    table = settle(scatter(df, buckets, seed), "scattered", "zstd")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    first = (
        table.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    # joined by a shuffle the records would move once more
    if buckets <= SENT_BUCKETS:
        first = F.broadcast(first)
    place = F.col("_first") + F.col("_at")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return table.join(first, "_bucket").select(
        *[F.col(f"_record.`{c}`").alias(c) for c in kept],
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str, files: int) -> None:
    """Write shards as folders of Parquet files whose rows are ordered by slot."""
    (
        shuffled.repartitionByRange(files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("errorifexists")
        .partitionBy("shard")
        .parquet(path)
    )
