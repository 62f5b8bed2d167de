"""Totals by month that are brought up to date from the raw files that changed.

The totals are a table in folders by year and month. A ledger beside it has a row for each
raw file and month in it, with the file's size and time of change. A refresh compares the
ledger with the files there are, finds the months that new, changed and removed files touch,
and makes those months anew, from all files that have rows of them. Other months are not
read, and their files stay as they are.

Copies and sums never cross a month, as year and month are columns of the row and of the key;
so the table equals that of a whole run. A refresh that fails is done again by the next one:
the ledger is written last, and a month made twice is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factmill.operators import clean
from factmill.session import settle
from factmill.spec import DEFAULT_SPEC, FactSpec

LEDGER = "file string, changed timestamp, size long, year long, month long"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def raw_files(raw: DataFrame) -> DataFrame:
    """``file``, ``changed`` and ``size`` of the files of a scan; no column is read."""
    place = F.col("_metadata")
    return raw.select(
        place["file_path"].alias("file"),
        place["file_modification_time"].alias("changed"),
        place["file_size"].alias("size"),
    ).distinct()


def months_of_files(raw: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The months in each file of a scan, as rows of the ledger; only two columns are read.

    A file without any valid month has one row with nulls, so that it counts as seen.
    """
    wanted = {spec.year, spec.month}
    columns = [c for c in raw.columns if clean.standard_name(c) in wanted]
    rows = raw.select(*columns, F.col("_metadata").alias("__place"))
    rows = clean.standardize_names(rows.select(*columns, F.col("__place.file_path").alias("file"),
        F.col("__place.file_modification_time").alias("changed"), F.col("__place.file_size").alias("size")))
    cast = clean.cast_columns(rows, spec)
    valid = cast.where(F.col(spec.year).isNotNull() & F.col(spec.month).isNotNull())
    valid = clean.keep_ranges(valid, spec)
    found = valid.select("file", "changed", "size", F.col(spec.year).alias("year"), F.col(spec.month).alias("month"))
    found = found.distinct()
    every = rows.select("file", "changed", "size").distinct()
    return every.join(found, ["file", "changed", "size"], "left")


def refresh_totals(
    spark: SparkSession,
    raw_folder: str,
    out: str,
    schema: T.StructType | str | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Bring the totals in ``out`` up to date with the parquet files in ``raw_folder``.

    Returns the months that were made anew, ``year`` and ``month``. Rows that cleaning drops,
    and files that have no others, touch no month.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    raw = reader.parquet(raw_folder)
    ledger = f"{out}/ledger"
    known = spark.read.schema(LEDGER).parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], LEDGER)
    same = ["file", "changed", "size"]
    files = settle(raw_files(raw), "files")
    before = known.select(*same).distinct()
    fresh = [r.file for r in files.join(before, same, "left_anti").select("file").collect()]
    gone = known.join(files, same, "left_anti")
    # a file has a name: as many come to the driver as the scan lists there anyway
    seen = months_of_files(raw.where(F.col("_metadata.file_path").isin(fresh)), spec) if fresh else None
    now = known.join(files, same, "left_semi")
    now = settle(now.unionByName(seen) if seen is not None else now, "ledger")
    changed = now.where(F.col("file").isin(fresh)) if fresh else now.limit(0)
    touched = gone.select("year", "month").unionByName(changed.select("year", "month")).where("year is not null")
    touched = settle(touched.distinct(), "touched")
    months = [(r.year, r.month) for r in touched.collect()]
    if months:
        _rewrite(spark, raw, now, touched, months, f"{out}/totals", spec)
    # the ledger comes last; until then a refresh starts from the one before
    now.write.mode("overwrite").parquet(f"{ledger}-next")
    spark.read.schema(LEDGER).parquet(f"{ledger}-next").write.mode("overwrite").parquet(ledger)
    return touched


def _rewrite(
    spark: SparkSession,
    raw: DataFrame,
    ledger: DataFrame,
    touched: DataFrame,
    months: list[tuple[int, int]],
    folder: str,
    spec: FactSpec,
) -> None:
    wanted = [r.file for r in ledger.join(touched, ["year", "month"]).select("file").distinct().collect()]
    rows = clean.clean(raw.where(F.col("_metadata.file_path").isin(wanted)), spec)
    # a filter on the keys: it goes below the sums and the removal of copies
    days = [F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in sorted(months)]
    rows = settle(rows.where(F.col(spec.date).isin(days)), "refreshed")
    (
        rows.repartition(spec.year, spec.month)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(spec.year, spec.month)
        .parquet(folder)
    )
    # a month that has no rows left is not overwritten by any
    left = {(r[0], r[1]) for r in rows.select(spec.year, spec.month).distinct().collect()}
    for year, month in set(months) - left:
        _delete(spark, f"{folder}/{spec.year}={year}/{spec.month}={month}")


def read_refreshed(spark: SparkSession, out: str, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The totals that refreshes left in ``out``; none before the first."""
    if not _exists(spark, f"{out}/totals"):
        return spark.createDataFrame([], spec.processed_schema)
    return spark.read.schema(spec.processed_schema).parquet(f"{out}/totals").select(*spec.processed_columns)
