"""Totals, trends, leaders, matrices, lists and pages over the aggregated table.

Every total is combined in the tasks that read the table, so a value that holds
most rows sends one partial row per task into the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factmill.functions import dates, numbers, text
from factmill.spec import DEFAULT_SPEC, FactSpec


def filter_facts(
    df: DataFrame,
    district: str | None = None,
    major: str | None = None,
    year: int | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Keep rows equal to each filter given; an empty filter keeps all rows."""
    chosen = {spec.district: district, spec.major: major, spec.year: year}
    for column, wanted in chosen.items():
        if wanted:
            df = df.where(F.col(column) == F.lit(wanted))
    return df


def _sum(spec: FactSpec) -> Column:
    return F.coalesce(F.sum(spec.total), F.lit(0.0)).alias(spec.total)


def total_by(df: DataFrame, *columns: str, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    return df.groupBy(*columns).agg(_sum(spec))


def grand_total(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    return df.agg(_sum(spec))


def ranking(
    df: DataFrame, column: str, limit: int | None = None, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """Totals per value, largest first, ties by value; the first ``limit`` if given."""
    ordered = total_by(df, column, spec=spec).orderBy(
        F.col(spec.total).desc(), F.col(column).asc()
    )
    return ordered if limit is None else ordered.limit(limit)


def monthly_trend(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Totals per month in time order, keyed ``YYYY-MM``; grouped on the integers."""
    return (
        total_by(df, spec.year, spec.month, spec=spec)
        .orderBy(spec.year, spec.month)
        .select(
            dates.month_key(F.col(spec.year), F.col(spec.month)).alias("month_key"),
            spec.total,
        )
    )


def matrix(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """One row per ``row`` value, one column per ``column`` value, zero where empty.

    Give ``values`` where they are known, such as a range of years: otherwise they
    are looked up first, and Spark refuses more than ``spark.sql.pivotMaxValues``.
    """
    pivot = df.groupBy(row).pivot(column, None if values is None else list(values))
    wide = pivot.agg(F.sum(spec.total))
    return wide.na.fill(0.0, [c for c in wide.columns if c != row])


def matrix_map(
    df: DataFrame, row: str, column: str, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """The matrix as one map per row, for columns not known beforehand."""
    cells = total_by(df, row, column, spec=spec)
    entries = F.sort_array(F.collect_list(F.struct(F.col(column), F.col(spec.total))))
    return cells.groupBy(row).agg(F.map_from_entries(entries).alias("totals"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def distinct_lists(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of several columns as text (``kind, item``), from one pass.

    Each row goes into one group per column, and the groups are combined before the
    shuffle.
    """
    groups = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        *[F.grouping(c).alias(f"__{c}") for c in columns]
    )
    kind, item = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        own = F.col(f"__{c}") == 0
        kind = F.when(own, F.lit(c)).otherwise(kind)
        item = F.when(own, F.col(c).cast("string")).otherwise(item)
    return groups.select(kind.alias("kind"), item.alias("item"))


def minors_of(
    df: DataFrame, major: str | None = None, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """Minor categories in order, of one major category if given."""
    return distinct_values(filter_facts(df, major=major, spec=spec), spec.minor)


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """One row with the number of distinct values of each column.

    Exact counts group on all the columns first: dimensions repeat, so the groups
    are few, and only those are expanded once per counted column.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    return (
        df.select(*columns)
        .distinct()
        .agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    )


def year_span(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """First and last year, and both as one label."""
    return df.agg(
        F.min(spec.year).alias("year_min"), F.max(spec.year).alias("year_max")
    ).withColumn("label", dates.span_label(F.col("year_min"), F.col("year_max")))


def leader(df: DataFrame, column: str, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The value with the largest total and its percent of the grand total."""
    total = F.col(spec.total)
    first = F.struct((-total).alias("rank"), F.col(column).alias("name"))
    return (
        total_by(df, column, spec=spec)
        .agg(
            F.min_by(column, first).alias(column),
            F.max(total).alias(spec.total),
            F.sum(total).alias("__all"),
        )
        .where(F.col(spec.total).isNotNull())
        .select(
            column,
            spec.total,
            numbers.percent(F.col(spec.total), F.col("__all")).alias("share_pct"),
        )
    )


def page(
    df: DataFrame, order: Sequence[str], number: int, rows: int
) -> DataFrame:
    """Page ``number`` (from 0) of ``rows`` rows. ``order`` must tell rows apart.

    Reads ``number * rows`` rows past the start; for deep pages use ``page_after``.
    """
    return df.orderBy(*order).offset(number * rows).limit(rows)


def page_after(
    df: DataFrame, last: Mapping[str, object] | None, order: Sequence[str], rows: int
) -> DataFrame:
    """The page that follows the row ``last``; costs the same at any depth."""
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for column in order:
            bound = F.lit(last[column])
            beyond = beyond | (equal & (F.col(column) > bound))
            equal = equal & (F.col(column) == bound)
        df = df.where(F.col(order[0]) >= F.lit(last[order[0]])).where(beyond)
    return df.orderBy(*order).limit(rows)


def display(df: DataFrame) -> DataFrame:
    """Every value as text, a dash for null."""
    return df.select(*[text.dash(F.col(c)).alias(c) for c in df.columns])


def summary_union(
    df: DataFrame,
    tags: tuple[str, str, str],
    limit: int = 10,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Totals per district, of the top minors and per month, as one tagged table.

    One pass with grouping sets. Districts and months are alone in their window
    partition, so one rank bound serves all three and is applied before the
    shuffle of the window.
    """
    district, minor, year, month = (
        F.col(c) for c in (spec.district, spec.minor, spec.year, spec.month)
    )
    sets = df.groupingSets(
        [[district], [minor], [year, month]], district, minor, year, month
    ).agg(_sum(spec), F.grouping_id().alias("__set"))
    # bits from the left: district, minor, year, month; 1 where rolled up
    kinds = {0b0111: tags[0], 0b1011: tags[1], 0b1100: tags[2]}
    tag = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    among = Window.partitionBy("__set", spec.district, spec.year, spec.month).orderBy(
        F.col(spec.total).desc(), minor.asc()
    )
    return (
        sets.withColumn("__rank", F.row_number().over(among))
        .where(F.col("__rank") <= limit)
        .select(
            tag[F.col("__set").cast("int")].alias("Type"),
            text.blank(district).alias("Borough"),
            text.blank(minor).alias("Minor Category"),
            text.blank(dates.month_key(year, month)).alias("Date"),
            F.col(spec.total).alias("Total Crimes"),
        )
    )


def export_rows(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The aggregated table under display headers, a missing date as empty text."""
    return df.select(
        F.col(spec.district).alias("Borough"),
        F.col(spec.major).alias("Major Category"),
        F.col(spec.minor).alias("Minor Category"),
        F.col(spec.year).alias("Year"),
        F.col(spec.month).alias("Month"),
        F.col(spec.total).alias("Total Crimes"),
        text.blank(F.col(spec.date)).alias("Date"),
    )
