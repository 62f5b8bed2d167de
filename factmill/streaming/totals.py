"""Copies and totals on a stream of files that arrive late, twice or out of order.

Two queries, each with a checkpoint of its own, so that either can be stopped and started
again at any time:

1. ``unique_stream`` drops rows that came before. Its state has a digest for each row seen
   within ``delay`` of the newest arrival, and nothing older.
2. ``upsert_totals`` keeps a running total per key in the state store and writes, for each
   micro-batch, the keys that changed with their new totals. A batch writes a folder of its
   own, under its number, in overwrite mode: a batch that is run again after a failure
   replaces what it left. ``read_upserts`` takes the newest total of each key.

Totals do not depend on the order in which rows come, so files may arrive in any order.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from factmill.functions import numbers
from factmill.operators.clean import add_date, clean_rows, drop_null_keys
from factmill.spec import DEFAULT_SPEC, FactSpec
from factmill.streaming.rows import append_to, state_on_disk

ARRIVAL = "__arrival"
BATCH = "__batch"
# batches that the files at hand are read in, at most
MOST_BATCHES = 4


def read_arrivals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New parquet files of a folder as a stream, each row with the time its file was made.

    A batch takes ``files_per_batch`` files, or more if the folder has more than
    ``MOST_BATCHES`` times as many. Every batch goes over the whole state: were their number
    to grow with the files, the time would with its square.
    """
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_batch is not None:
        files = len(spark.read.schema(schema).parquet(folder).inputFiles())
        reader = reader.option("maxFilesPerTrigger", max(files_per_batch, ceil(files / MOST_BATCHES)))
    rows = reader.load(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias(ARRIVAL))


def row_digest(df: DataFrame) -> Column:
    """256 bits of a whole row; null, empty text and their places in it are told apart."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    # each part with its length, so that no two rows have the same text
    sized = [F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*sized).cast("binary"), 256)


def unique_stream(rows: DataFrame, delay: str, arrival: str = ARRIVAL) -> DataFrame:
    """Each row once, without ``arrival``, by which copies are told to be near in time.

    A copy that arrives within ``delay`` of the first is dropped, in whatever batch. The
    state forgets a row once the newest arrival is ``delay`` past it: a copy that comes
    still later counts as a new row. A row that arrives more than ``delay`` behind the
    newest arrival is late and left out; Spark counts it as dropped by the watermark.
    """
    payload = rows.drop(arrival)
    marked = rows.withColumn("__digest", F.unhex(row_digest(payload))).withWatermark(arrival, delay)
    return marked.dropDuplicatesWithinWatermark(["__digest"]).select(*payload.columns)


def running_totals(
    rows: DataFrame, spec: FactSpec = DEFAULT_SPEC, closed_after: str | None = None
) -> DataFrame:
    """Totals per key of a stream of clean rows, for update mode.

    By default every key stays in the state: there are as many as rows in the totals. With
    ``closed_after`` a month is closed once the newest month is that much past it: its keys
    leave the state, and rows that come for it later are left out and counted by Spark.
    """
    dated = add_date(drop_null_keys(rows, spec), spec)
    dated = dated.withColumn(spec.date, F.col(spec.date).cast("timestamp"))
    if closed_after is not None:
        dated = dated.withWatermark(spec.date, closed_after)
    measure = F.col(spec.measure)
    if numbers.is_fraction(rows.schema[spec.measure].dataType):
        measure = F.when(~F.isnan(measure), measure)
    total = F.coalesce(F.sum(measure).cast("double"), F.lit(0.0))
    summed = dated.groupBy(*spec.keys, spec.date).agg(total.alias(spec.total))
    return summed.select(*spec.keys, spec.total, F.col(spec.date).cast("date").alias(spec.date))


def upsert_totals(
    totals: DataFrame, folder: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the changed keys of each micro-batch to ``folder``, a folder for each batch."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")

    writer = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with state_on_disk(totals.sparkSession):
        return writer.start()


def read_upserts(spark: SparkSession, folder: str, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The totals after the last batch: of each key, the row of its newest batch."""
    schema = T.StructType([*spec.processed_schema.fields, T.StructField(BATCH, T.LongType())])
    rows = spark.read.schema(schema).parquet(folder)
    newest = F.max_by(F.struct(spec.total, spec.date), BATCH).alias("newest")
    return rows.groupBy(*spec.keys).agg(newest).select(*spec.keys, "newest.*")


def compact_upserts(spark: SparkSession, folder: str, target: str, spec: FactSpec = DEFAULT_SPEC) -> str:
    """The totals as a plain table, for readers that come often."""
    read_upserts(spark, folder, spec).write.mode("overwrite").parquet(target)
    return target


def stream_to_totals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    out: str,
    delay: str,
    files_per_batch: int | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Bring the totals in ``out`` up to date with the files in ``folder``, and read them.

    Only files that are new since the last call are read. Copies are dropped after the rows
    are cleaned, as in the batch run.
    """
    arrivals = read_arrivals(spark, folder, schema, files_per_batch)
    rows = clean_rows(arrivals, spec)
    kept = unique_stream(rows, delay)
    append_to(kept, f"{out}/rows", f"{out}/progress/rows").awaitTermination()
    stored = spark.readStream.schema(kept.schema).parquet(f"{out}/rows")
    upsert_totals(running_totals(stored, spec), f"{out}/totals", f"{out}/progress/totals").awaitTermination()
    return read_upserts(spark, f"{out}/totals", spec)
