"""Data-quality rules: counters from one pass, a report, and enforcement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factmill.functions import dates, numbers
from factmill.operators.clean import (
    bad_measure,
    bad_month,
    bad_year,
    is_missing,
    is_null,
)
from factmill.spec import DEFAULT_SPEC, FactSpec

HARD, SOFT = "hard", "soft"


class QualityError(AssertionError):
    """A hard rule failed."""


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def null_counts(
    df: DataFrame, columns: Sequence[str] | None = None, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """One row: missing values per column, null tokens counted as missing."""
    columns = df.columns if columns is None else [c for c in columns if c in df.columns]
    return df.agg(*[F.count_if(is_missing(df, c, spec)).alias(c) for c in columns])


def critical_nulls(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """One row: nulls per critical column; tokens count as present."""
    columns = [c for c in spec.critical if c in df.columns]
    return df.agg(*[F.count_if(is_null(df, c)).alias(f"nulls_{c}") for c in columns])


def completeness(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """One row: percent of cells present in four core columns, 100 for no rows."""
    core = [spec.district, spec.year, spec.month, spec.total]
    empty = sum((F.count_if(is_null(df, c)) for c in core), F.lit(0))
    cells = F.count("*") * len(core)
    share = F.try_divide((cells - empty) * F.lit(100.0), cells)
    return df.agg(F.coalesce(share, F.lit(100.0)).alias("completeness_pct"))


def completeness_of(report: DataFrame) -> float:
    """The completeness of a processed table that has all its columns, from its report."""
    seen = {r["rule"]: r for r in report.where(F.col("rule").isin("core_nulls", "total_rows")).collect()}
    cells = 4 * int(seen["total_rows"]["detail"])
    return 100.0 * (cells - seen["core_nulls"]["observed"]) / cells if cells else 100.0


def surplus_copies(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each whole row, or of each key."""
    groups = df.groupBy(*(df.columns if keys is None else keys)).agg(
        F.count("*").alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus")
    )


def range_violations(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """One row: values out of range and fractional parts, from one pass.

    Takes a raw or a cast table: text is read as numbers where needed.
    """
    schema = df.schema
    typed = df.select(
        numbers.to_whole(F.col(spec.month), schema[spec.month].dataType).alias(spec.month),
        numbers.to_whole(F.col(spec.year), schema[spec.year].dataType).alias(spec.year),
        numbers.to_number(F.col(spec.measure), schema[spec.measure].dataType).alias(
            spec.measure
        ),
        (
            numbers.has_fraction(F.col(spec.month), schema[spec.month].dataType)
            | numbers.has_fraction(F.col(spec.year), schema[spec.year].dataType)
        ).alias("__fraction"),
    )
    return typed.agg(
        F.count_if(bad_month(spec)).alias("bad_months"),
        F.count_if(bad_year(spec)).alias("bad_years"),
        F.count_if(bad_measure(spec)).alias("negatives"),
        F.count_if(F.col(spec.measure).isNull()).alias("null_measures"),
        F.count_if("__fraction").alias("fractional"),
        F.min(spec.year).alias("year_min"),
        F.max(spec.year).alias("year_max"),
    )


def _type_faults(df: DataFrame, processed: bool, spec: FactSpec) -> int:
    """Columns present whose type does not fit their role; needs no job.

    The dimensions are looked at in a raw table only, where the measure has to be
    a fraction; a total may be any number.
    """
    fits = {spec.year: T.IntegralType, spec.month: T.IntegralType}
    if processed:
        fits[spec.total] = T.NumericType
        fits[spec.date] = (T.DateType, T.TimestampType, T.TimestampNTZType)
    else:
        fits[spec.measure] = (T.DoubleType, T.FloatType)
        fits |= dict.fromkeys(spec.dims, (T.StringType, T.CharType, T.VarcharType))
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return sum(not isinstance(kinds[c], kind) for c, kind in fits.items() if c in kinds)


def quality_report(
    df: DataFrame,
    contract: str = "processed",
    spec: FactSpec = DEFAULT_SPEC,
    only_hard: bool = False,
) -> DataFrame:
    """One row per rule: ``rule, severity, passed, observed, detail``.

    ``contract`` says what the table should be: ``processed`` (dated totals) or
    ``raw``. One pass groups by whole row and then by key, carrying every counter
    along; so copies, key duplicates and values are checked by a single scan. The
    hard rules need no whole rows, so ``only_hard`` groups by key alone.
    """
    if contract not in ("processed", "raw"):
        raise ValueError(f"contract must be 'processed' or 'raw', not {contract!r}")
    processed = contract == "processed"
    amount = spec.total if processed else spec.measure
    wanted = spec.processed_columns if processed else spec.raw_columns
    absent = missing_columns(df, wanted)
    has = set(df.columns)

    severity = HARD if processed else SOFT
    rules: list[tuple[str, str, Column, Column]] = []

    def rule(name: str, level: str, observed: Column, detail: Column | None = None):
        if level == HARD or not only_hard:
            detail = F.lit("") if detail is None else detail
            rules.append((name, level, observed, detail))

    rule("required_columns", severity, F.lit(len(absent)), F.lit(", ".join(absent)))
    rule("column_types", severity, F.lit(_type_faults(df, processed, spec)))

    flags: dict[str, Column] = {}
    core = [spec.district, spec.year, spec.month, spec.total] if processed else []
    for column in core:
        if column in has:
            flags[f"core_{column}"] = is_null(df, column)
    if not only_hard:
        for column in [spec.district, spec.major, amount, spec.year, spec.month]:
            if column in has:
                flags[f"nulls_{column}"] = is_null(df, column)
    if processed and spec.year in has:
        flags["low_year"] = F.col(spec.year) < spec.year_min
    if spec.month in has:
        flags["bad_month"] = bad_month(spec)
    if amount in has:
        flags["negative"] = F.col(amount) < 0

    keys = [c for c in spec.keys if c in has]
    if only_hard:
        rows, n = df, F.lit(1)
    else:
        # counted per distinct row, weighted by its copies
        rows, n = df.groupBy(*df.columns).agg(F.count("*").alias("__n")), F.col("__n")
    per_key = rows.groupBy(*keys).agg(
        F.sum(n).alias("__rows"),
        F.count("*").alias("__distinct"),
        *[F.sum(F.when(c, n).otherwise(F.lit(0))).alias(f) for f, c in flags.items()],
    )
    spans = []
    if spec.year in has and not only_hard:
        spans = [
            F.min(spec.year).alias("__year_min"),
            F.max(spec.year).alias("__year_max"),
        ]
    counted = per_key.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("__total"),
        F.coalesce(F.sum(F.col("__rows") - F.col("__distinct")), F.lit(0)).alias("__copies"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("__key_copies"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags],
        *spans,
    )

    if processed:
        nulls = sum((F.col(f"core_{c}") for c in core if c in has), F.lit(0))
        rule("core_nulls", HARD, nulls)
    if "low_year" in flags:
        rule("year_range", severity, F.col("low_year"))
    if "bad_month" in flags:
        rule("month_range", severity, F.col("bad_month"))
    if "negative" in flags:
        rule("no_negatives", severity, F.col("negative"))
    if processed:
        rule("unique_keys", HARD, F.col("__key_copies"))
    for flag in flags:
        if flag.startswith("nulls_"):
            rule(flag, SOFT, F.col(flag))
    rule("total_duplicates", SOFT, F.col("__copies"))
    rule("total_rows", "info", F.lit(0), F.col("__total").cast("string"))
    if spans:
        label = dates.span_label(F.col("__year_min"), F.col("__year_max"))
        rule("year_span", "info", F.lit(0), F.coalesce(label, F.lit("")))

    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(level).alias("severity"),
            (observed == 0).alias("passed"),
            observed.cast("bigint").alias("observed"),
            detail.alias("detail"),
        )
        for name, level, observed, detail in rules
    ]
    return counted.select(F.inline(F.array(*rows)))


def enforce(report: DataFrame) -> None:
    """Raise if a hard rule failed. The report has one row per rule."""
    failed = report.where((F.col("severity") == HARD) & ~F.col("passed")).collect()
    if failed:
        raise QualityError(
            "; ".join(
                f"{r['rule']}: {r['observed']}" + (f" ({r['detail']})" if r["detail"] else "")
                for r in failed
            )
        )


def check_schema(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> None:
    """Raise if a processed table lacks a column or has one of a wrong type."""
    absent = missing_columns(df, spec.processed_columns)
    if absent:
        raise QualityError(f"missing columns: {absent}")
    if _type_faults(df, True, spec):
        raise QualityError(f"unexpected column types: {df.schema.simpleString()}")


def check(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> bool:
    """True if the processed table meets every hard rule; raises otherwise.

    A fault of the schema is raised without reading the table.
    """
    check_schema(df, spec)
    enforce(quality_report(df, "processed", spec, only_hard=True))
    return True


def report_lines(report: DataFrame, stamp: str) -> DataFrame:
    """The report as text, one ``value`` column: when it was made, then a line for each rule,
    which begins with ``info``, ``ok`` or ``found`` so that it can be searched for."""
    name, more = F.col("rule"), F.col("detail")
    found = F.concat_ws(" ", F.lit("found"), F.col("observed").cast("string"), F.lit("in"), name)
    line = (
        F.when(F.col("severity") == "info", F.concat_ws(" ", F.lit("info"), name, F.lit("is"), more))
        .when(F.col("passed"), F.concat(F.lit("ok "), name))
        .otherwise(F.when(more != "", F.concat(found, F.lit(" ("), more, F.lit(")"))).otherwise(found))
    )
    made = report.sparkSession.createDataFrame([(f"# rules checked at {stamp}",)], "value string")
    return made.coalesce(1).unionAll(report.select(line.alias("value"))).coalesce(1)
