"""The row-by-row steps on a stream: they keep no state and need no watermark.

Dropping copies and totalling need whole groups and stay with the batch run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from factmill.operators.clean import clean_rows
from factmill.operators.models import Models, score
from factmill.spec import DEFAULT_SPEC, FactSpec

STORE = "spark.sql.streaming.stateStore."
# state on an executor's disk, within one bound of memory for all its parts: the default
# store keeps every row on the heap and copies the whole of it in each batch
STATE_CONF = {
    f"{STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}rocksdb.boundedMemoryUsage": "true",
    # a batch stores its changes, not the files of the whole state
    f"{STORE}rocksdb.changelogCheckpointing.enabled": "true",
    # a count that costs a lookup per row written
    f"{STORE}rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk, unless the session names a store.

    A query takes the settings over as it starts; a checkpoint made with another store
    goes on with that.
    """
    given = spark.conf.getAll
    added = {} if f"{STORE}providerClass" in given else STATE_CONF
    added = {key: value for key, value in added.items() if key not in given}
    for key, value in added.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream; a schema is needed, as none is inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def clean_stream(stream: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    return clean_rows(stream, spec)


def score_stream(
    stream: DataFrame, models: Models, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    return score(stream, models, spec=spec)


def append_to(
    stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append to parquet, each input row exactly once. ``checkpoint`` must outlive
    the cluster; by default the query ends when the files at hand are done."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with state_on_disk(stream.sparkSession):
        return writer.start(folder)
