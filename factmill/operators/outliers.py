"""Outlier flags and their summary. Nothing is removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factmill.operators.ranked import exact_quantiles, quantile_name, quantiles_of_counts, value_counts
from factmill.spec import DEFAULT_SPEC, FactSpec

METHODS = ("iqr", "zscore")


def _one(row: DataFrame) -> Column:
    """A one-row table as a scalar struct, computed once and put in as a value."""
    return row.select(F.struct("*").alias("row")).scalar()


def with_fences(quartiles: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Add ``low`` and ``high`` to a one-row table of quartiles."""
    first, third = (F.col(quantile_name(s)) for s in spec.quartiles)
    reach = F.lit(spec.iqr_factor) * (third - first)
    return quartiles.withColumns({"low": first - reach, "high": third + reach})


def iqr_fences(quartiles: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """One row ``low, high`` from a one-row table of quartiles."""
    return with_fences(quartiles, spec).select("low", "high")


def spread(df: DataFrame, column: str) -> DataFrame:
    """One row ``mean, std`` with the sample standard deviation."""
    return df.agg(
        F.avg(column).alias("mean"),
        F.when(F.count(column) > 1, F.stddev_samp(column)).alias("std"),
    )


def _beyond(total: Column, fences: Column) -> Column:
    return F.coalesce((total < fences["low"]) | (total > fences["high"]), F.lit(False))


def _is_outlier(df: DataFrame, method: str, spec: FactSpec) -> Column:
    total = F.col(spec.total)
    if method == "iqr":
        quartiles = exact_quantiles(df, spec.total, spec.quartiles)
        return _beyond(total, _one(with_fences(quartiles, spec)))
    stats = _one(spread(df, spec.total))
    # a constant column has no spread and so no outliers
    score = F.try_divide(total - stats["mean"], F.nullif(stats["std"], F.lit(0.0)))
    return F.coalesce(F.abs(score) > spec.z_limit, F.lit(False))


def flag_outliers(
    df: DataFrame, method: str = "iqr", spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """Add ``is_outlier``. A table without totals has no rows to flag."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if spec.total not in df.columns:
        return df.withColumn("is_outlier", F.lit(False)).where(F.lit(False))
    return df.withColumn("is_outlier", _is_outlier(df, method, spec))


def outlier_rows(
    df: DataFrame, method: str = "iqr", spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    return flag_outliers(df, method, spec).where("is_outlier").drop("is_outlier")


def outlier_summary(
    df: DataFrame, method: str = "iqr", spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """One row: method, rows, outliers found, their range, and the usual range.

    Works on the settled value counts, so the table itself is read once.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    low_name, high_name = (quantile_name(s) for s in spec.report_quantiles)
    if spec.total not in df.columns:
        # no totals: an empty finding that still has every column
        empty = df.where(F.lit(False)).agg(F.count("*").alias("n_rows"))
        none = F.lit(None).cast("double")
        return empty.select(
            F.lit(method).alias("method"),
            "n_rows",
            F.lit(0).cast("bigint").alias("n_outliers"),
            *[
                none.alias(c)
                for c in ("outlier_min", "outlier_max", low_name, high_name)
            ],
        )
    counts = value_counts(df, spec.total)
    valued = counts.withColumnRenamed("value", spec.total)
    # all shares at once: one look at the counts finds them
    shares = dict.fromkeys([*spec.report_quantiles, *(spec.quartiles if method == "iqr" else [])])
    usual = quantiles_of_counts(counts, list(shares))
    if method == "iqr":
        usual = _one(with_fences(usual, spec))
        found = _beyond(F.col(spec.total), usual)
    else:
        usual = _one(usual)
        found = F.coalesce(_far_from_mean(valued, spec), F.lit(False))
    value, n = F.col(spec.total), F.col("n")
    return valued.withColumn("__out", found).agg(
        F.lit(method).alias("method"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("__out"), n)), F.lit(0))
        .cast("bigint")
        .alias("n_outliers"),
        F.min(F.when(F.col("__out"), value)).cast("double").alias("outlier_min"),
        F.max(F.when(F.col("__out"), value)).cast("double").alias("outlier_max"),
    ).select(
        "*",
        usual[low_name].alias(low_name),
        usual[high_name].alias(high_name),
    )


def _far_from_mean(counts: DataFrame, spec: FactSpec) -> Column:
    """The z-score test on a table of distinct totals and their row counts."""
    value, n = F.col(spec.total).cast("double"), F.col("n")
    mean = _one(counts.agg((F.sum(value * n) / F.sum(n)).alias("mean")))["mean"]
    squares = counts.agg(
        F.sqrt(
            F.try_divide(
                F.sum(n * (value - mean) * (value - mean)),
                F.nullif(F.sum(n) - 1, F.lit(0)),
            )
        ).alias("std")
    )
    std = _one(squares)["std"]
    return F.abs(F.try_divide(value - mean, F.nullif(std, F.lit(0.0)))) > spec.z_limit
