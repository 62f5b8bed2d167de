"""Numbers of rows that stay the same in every job that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.session import settle


def numbered(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` behind ``row``, a number of its own for each row.

    How files are split follows the number of live cores, which may change between two
    jobs. So the rows of a plain scan of Parquet are numbered by file and place in it, and
    those of any other plan are written together with their numbers.
    """
    if not _plain_scan(docs):
        return settle(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows", "zstd")
    # a row per file
    files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    number = F.row_number().over(Window.orderBy("_file")).cast("long") - 1
    files = settle(files.select("_file", number.alias("_number")), "files")
    places = docs.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"), F.struct(*columns).alias("_own")
    )
    row = (F.shiftleft("_number", 40) + F.col("_place")).alias("row")
    return places.join(F.broadcast(files), "_file").select(row, "_own.*")


def _plain_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns:
        return False
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return False
    paths = relation.location().rootPaths()
    return paths.distinct().length() == paths.length()
