"""Snapshots, strict outputs and exports. Every path and mode is an argument."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factmill import fixed_values as fixed
from factmill.functions import numbers, text
from factmill.operators.quality import missing_columns, quality_report, report_lines
from factmill.spec import DEFAULT_SPEC, FactSpec

log = logging.getLogger(__name__)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> str:
    """Write one copy. CSV has a header; parquet is snappy-compressed.

    ``partition_by`` (a year, say) lets later filters skip folders.
    """
    writer = df.write.format(fmt).mode(mode)
    if fmt == "parquet":
        writer = writer.option("compression", fixed.SNAPSHOT_CODEC)
    elif fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def save_raw(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> dict[str, str]:
    """The raw snapshot, unchanged."""
    return {"parquet": write_table(df, f"{folder}/{name}.parquet", mode=mode)}


def save_validated(
    df: DataFrame,
    folder: str,
    name: str,
    report_name: str | None = None,
    contract: str = "raw",
    stamp: str = "",
    spec: FactSpec = DEFAULT_SPEC,
    report: DataFrame | None = None,
) -> dict[str, str]:
    """A snapshot and, if named, its text report, which may be given if it is at hand.
    Findings never stop the write."""
    paths = {"parquet": write_table(df, f"{folder}/{name}.parquet")}
    if report_name:
        if report is None:
            report = quality_report(df, contract, spec)
        path = f"{folder}/{report_name}.txt"
        report_lines(report, stamp).write.mode("overwrite").text(path)
        paths["validation_report"] = path
    return paths


def save_processed(
    df: DataFrame,
    folder: str,
    name: str,
    formats: Sequence[str] = fixed.SNAPSHOT_FORMATS,
    spec: FactSpec = DEFAULT_SPEC,
) -> dict[str, str]:
    """The processed table in each format; missing columns are only logged.

    Give a stored table: each format reads it again. An unknown format raises before
    anything is written.
    """
    unknown = [fmt for fmt in formats if fmt not in fixed.SNAPSHOT_FORMATS]
    if unknown:
        raise ValueError(f"unknown formats: {unknown}")
    absent = missing_columns(df, spec.processed_columns)
    if absent:
        log.warning("missing columns: %s", absent)
    return {fmt: write_table(df, f"{folder}/{name}.{fmt}", fmt) for fmt in formats}


def save_strict(
    df: DataFrame, folder: str, name: str, spec: FactSpec = DEFAULT_SPEC
) -> dict[str, str]:
    """CSV and parquet of a complete processed table; raises, before any job, if a
    column is missing."""
    absent = missing_columns(df, spec.processed_columns)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return {
        fmt: write_table(df, f"{folder}/{name}.{fmt}", fmt) for fmt in ("csv", "parquet")
    }


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a bare header, every value quoted, quotes doubled, nulls empty, numbers
    plain. Each file begins with the header, so that any of them can be read alone; a
    table without rows has no file with one."""

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if numbers.is_fraction(field.dataType):
            column = numbers.plain(column)
        doubled = F.replace(text.blank(column), F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), doubled, F.lit('"'))

    line = F.concat_ws(",", *[shown(f) for f in df.schema.fields])
    # the low bits number the rows of a task, and each task writes a file
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.lit(",".join(df.columns) + "\n")
    whole = F.when(first, F.concat(header, line)).otherwise(line)
    df.select(whole.alias("line")).write.mode(mode).text(path)
    return path
