"""Exact order statistics and running totals without an unbounded task.

Rows are first reduced to one per distinct value (combined before the shuffle, so
a hot value costs one row). The values are cut into ranges of about equal size; each
range runs in a task of its own and is shifted by the total of the ranges below. A
small table is one range: the formula is the same at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from factmill.functions import numbers
from factmill.session import settle

# distinct values one task may order; above it the values are cut into ranges
RANGE_ROWS = 1_000_000
# the cut points go through the driver, so their number is bounded: beyond two billion
# distinct values a range, which its task sorts and spills, holds one 2,000th of them
MAX_RANGES = 2_000


def value_counts(df: DataFrame, value: str, **sums: Column) -> DataFrame:
    """One settled row per distinct value, with its row count ``n`` and sums."""
    column = F.col(value)
    present = column.isNotNull()
    if numbers.is_fraction(df.schema[value].dataType):
        present = present & ~F.isnan(column)
    counted = (
        df.where(present)
        .groupBy(column.alias("value"))
        .agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()])
    )
    return settle(counted, "counts")


def _cut_points(counts: DataFrame, range_rows: int) -> tuple[int, int, list[float]]:
    """Distinct values, rows, and inner cut points (none for a small table)."""
    distinct, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = min(MAX_RANGES, ceil(distinct / range_rows))
    if parts <= 1:
        return distinct, rows, []
    shares = [i / parts for i in range(1, parts)]
    # good to a tenth of a range, which is all that balance needs
    points = F.percentile_approx(F.col("value").cast("double"), shares, max(100, 10 * parts))
    return distinct, rows, sorted(set(counts.agg(points).first()[0]))


def _with_range(counts: DataFrame, cuts: list[float]) -> DataFrame:
    if not cuts:
        return counts.withColumn("__range", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = counts.withColumn("__key", F.col("value").cast("double"))
    cutter = Bucketizer(splits=splits, inputCol="__key", outputCol="__range")
    return cutter.transform(keyed).drop("__key")


def running_totals(
    counts: DataFrame,
    names: Sequence[str],
    descending: bool = False,
    following: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``before_<name>``, the total of each named column over earlier values.

    ``counts`` holds one row per distinct ``value``, as ``value_counts`` returns.
    With ``following`` each row also gets ``next_<name>`` of the value after it.
    """
    _, _, cuts = _cut_points(counts, range_rows)
    order = F.col("value").desc() if descending else F.col("value").asc()

    def shifted(name: str, window, offset: Column) -> Column:
        until = F.coalesce(F.sum(name).over(window), F.lit(0)) - F.col(name)
        return (until + offset).alias(f"before_{name}")

    if not cuts:
        # few distinct values, checked above: one window may order them all
        within = Window.partitionBy(F.lit(0)).orderBy(order)
        upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        result = [counts[c] for c in counts.columns]
        result += [shifted(n, upto, F.lit(0)) for n in names]
        if following:
            result += [F.lead(n).over(within).alias(f"next_{n}") for n in names]
        return counts.select(*result)

    ranged = _with_range(counts, cuts)
    range_order = F.col("__range").desc() if descending else F.col("__range").asc()
    first_of = F.max_by if descending else F.min_by
    per_range = ranged.groupBy("__range").agg(
        *[F.sum(n).alias(f"__sum_{n}") for n in names],
        *[first_of(n, "value").alias(f"__first_{n}") for n in names],
    )
    # at most MAX_RANGES + 1 rows, so one window and a broadcast are bounded
    across = Window.partitionBy(F.lit(0)).orderBy(range_order)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "__range",
        *[
            F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}")
            for n in names
        ],
        *[F.lead(f"__first_{n}").over(across).alias(f"__after_{n}") for n in names],
    )
    joined = ranged.join(F.broadcast(offsets), "__range")
    within = Window.partitionBy("__range").orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = [F.col(c) for c in counts.columns]
    result += [shifted(n, upto, F.col(f"__base_{n}")) for n in names]
    if following:
        result += [
            F.coalesce(F.lead(n).over(within), F.col(f"__after_{n}")).alias(f"next_{n}")
            for n in names
        ]
    return joined.select(*result)


def numbered(values: DataFrame, name: str = "index", group_name: str | None = None) -> DataFrame:
    """The rows of a table of any size, numbered from 0 in the order of its columns.

    Rows are dealt out by ranges, sorted and counted within each, and shifted by the
    counts of the ranges before, one row per range. Equal rows have no fixed order. With
    ``group_name`` the distinct values of the first column are numbered by it as well.
    """
    ranged = settle(
        values.repartitionByRange(*values.columns).withColumn(
            "__range", F.spark_partition_id()
        ),
        "ranged",
    )
    across = Window.orderBy("__range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    def before(count: Column) -> Column:
        return F.coalesce(F.sum(count).over(earlier), F.lit(0))

    within = Window.partitionBy("__range").orderBy(*values.columns)
    numbers = [(F.row_number().over(within) - 1 + F.col("__base")).cast("bigint").alias(name)]
    # a struct, as a null is a value here
    first = F.struct(F.col(values.columns[0]))
    if group_name is None:
        counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
        offsets = counts.select("__range", before(F.col("__n")).alias("__base"))
    else:
        counts = (
            ranged.groupBy("__range", first.alias("__first"))
            .agg(F.count("*").alias("__n"))
            .groupBy("__range")
            .agg(
                F.sum("__n").alias("__n"),
                F.count("*").alias("__groups"),
                F.min("__first").alias("__low"),
                F.max("__first").alias("__high"),
            )
        )
        # a group that goes on from the range before is counted there
        goes_on = F.coalesce(F.col("__low") == F.lag("__high").over(across), F.lit(False))
        counts = counts.withColumn("__goes_on", goes_on.cast("bigint"))
        offsets = counts.select(
            "__range",
            before(F.col("__n")).alias("__base"),
            (before(F.col("__groups") - F.col("__goes_on")) - F.col("__goes_on")).alias("__groups_before"),
        )
        # ordered like the rows, so that one sort serves both
        group = F.dense_rank().over(Window.partitionBy("__range").orderBy(values.columns[0]))
        numbers.append((group - 1 + F.col("__groups_before")).cast("bigint").alias(group_name))
    return ranged.join(offsets, "__range").select(*numbers, *values.columns)


def quantile_name(share: float) -> str:
    return "q" + f"{share * 100:g}".replace(".", "_").zfill(2)


def between(low: Column, high: Column, part: float) -> Column:
    """The number ``part`` of the way from low to high; equal ones, infinite too, stay."""
    return F.when(low == high, low).otherwise(low + (high - low) * F.lit(part))


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row of exact quantiles with linear interpolation, nulls and NaN left out.

    Columns are named ``q25`` for a share of 0.25, and ``n`` is the row count.
    """
    return quantiles_of_counts(value_counts(df, value), shares, range_rows)


def quantiles_of_counts(
    counts: DataFrame, shares: Sequence[float], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``exact_quantiles`` from a table that ``value_counts`` returned."""
    _, rows, cuts = _cut_points(counts, range_rows)
    counts = counts.withColumn("value", F.col("value").cast("double"))

    sizes = {0: rows}
    if cuts:
        # rows at or below each cut: MAX_RANGES numbers, from one pass
        per_range = _with_range(counts, cuts).groupBy("__range").agg(F.sum("n").alias("n"))
        sizes = {int(r["__range"]): r["n"] for r in per_range.toLocalIterator()}
    bounds = [float("-inf"), *cuts, float("inf")]
    starts, total = [], 0
    for i in range(len(bounds) - 1):
        starts.append(total)
        total += sizes.get(i, 0)

    if not rows:
        nothing = [F.lit(None).cast("double").alias(quantile_name(s)) for s in shares]
        return counts.agg(F.lit(0).cast("bigint").alias("n"), *nothing)

    def range_of(rank: int) -> int:
        return max(i for i, s in enumerate(starts) if s <= rank and sizes.get(i, 0))

    ranks = {}
    for share in shares:
        position = share * (rows - 1)
        ranks[share] = (floor(position), ceil(position), position - floor(position))
    wanted = sorted({r for low, high, _ in ranks.values() for r in (low, high)})
    by_range: dict[int, list[int]] = {}
    for rank in wanted:
        by_range.setdefault(range_of(rank), []).append(rank)

    # only the ranges that hold a wanted rank are ordered, one task each
    ranged = _with_range(counts, cuts).where(
        F.col("__range").isin([float(i) for i in by_range])
    )
    base = F.coalesce(
        *[F.when(F.col("__range") == i, F.lit(starts[i])) for i in by_range]
    )
    upto = (
        Window.partitionBy("__range")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranged.withColumn("__end", F.sum("n").over(upto) + base)
    at = {
        rank: F.max(
            F.when(
                (F.col("__end") - F.col("n") <= rank) & (rank < F.col("__end")),
                F.col("value"),
            )
        )
        for rank in wanted
    }
    return placed.agg(*[c.alias(f"__r{r}") for r, c in at.items()]).select(
        F.lit(rows).cast("bigint").alias("n"),
        *[
            between(F.col(f"__r{low}"), F.col(f"__r{high}"), part).alias(quantile_name(share))
            for share, (low, high, part) in ranks.items()
        ],
    )
