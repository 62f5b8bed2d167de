"""Session defaults, and cutting a plan at a table in shared storage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "factmill", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # a whole cleaning chain is one generated method; let the JVM compile it even
        # when views below it make it long
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        # rows to be de-duplicated are nearly all distinct, so a small first map in
        # front of the aggregation map only costs a second lookup
        "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
        # beyond this many rows an ordered limit sorts and spills instead of
        # keeping a heap per task
        "spark.sql.execution.topKSortFallbackThreshold": "1000000",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the session's warehouse.

    Both are shared by driver and executors on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_factmill"
    return folder.rstrip("/")


def settled_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; ``clear_settled`` deletes it."""
    return f"{shared_folder(spark)}/factmill-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, label: str = "table", codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several plans read one expensive result. The lineage is cut and,
    unlike cached blocks, the files outlive lost executors and keep column
    pruning and filter pushdown for the readers. ``codec`` may be zstd for long texts,
    which take less room by it and more time.
    """
    spark = df.sparkSession
    path = f"{settled_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of some ``size`` bytes at most for what is run within, unless fewer are set.

    A batch of 10,000 whole texts takes tens of MB, in the executor and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if _bytes(before) <= size:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bytes(setting: str) -> int:
    """A setting such as 64m, or a plain number of bytes."""
    number, unit = re.fullmatch(r"([0-9]+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def clear_settled(spark: SparkSession) -> None:
    """Delete the tables this application settled, once no plan reads them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(settled_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(path, True)
