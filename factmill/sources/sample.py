"""A generated raw table: every row depends on its id and the seed alone.

No random state is carried between rows, so the table is the same for any number
of partitions and a lost task can be run again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factmill import fixed_values as fixed
from factmill.operators.ranked import numbered
from factmill.session import settle
from factmill.spec import DEFAULT_SPEC, FactSpec

# hexadecimal digits of the row digest spent on one draw
_DIGITS = 8
_RANGE = 16**_DIGITS


def poisson_steps(mean: float) -> list[float]:
    """Cumulative Poisson probabilities, up to the precision of one draw."""
    term = math.exp(-mean)
    steps, total, k = [], term, 0
    while total < 1 - 1 / _RANGE:
        steps.append(total)
        k += 1
        term *= mean / k
        total += term
    return steps


@dataclass(frozen=True)
class Pool:
    """A table to draw from by number: ``index`` from 0, and how many there are."""

    table: DataFrame
    size: Column


def value_pool(df: DataFrame, column: str) -> Pool:
    """The distinct values of a column, however many, numbered in their order."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    table = settle(numbered(values.distinct()), "pool")
    return Pool(table, table.agg(F.coalesce(F.max("index") + 1, F.lit(0)).alias("n")).scalar())


@dataclass(frozen=True)
class CategoryPool:
    """Majors numbered from 0 with their minors' first number and count; the minors."""

    majors: Pool
    minors: DataFrame


def category_pool(categories: DataFrame, major: str, minor: str) -> CategoryPool:
    """The distinct pairs of a category table, however many."""
    pairs = categories.select(F.col(major).alias("major"), F.col(minor).alias("minor"))
    minors = settle(numbered(pairs.distinct(), group_name="group"), "minors")
    majors = minors.groupBy(F.col("group").alias("index"), "major").agg(
        F.min("index").alias("first"), F.count("*").alias("n")
    )
    size = minors.agg(F.coalesce(F.max("group") + 1, F.lit(0)).alias("n")).scalar()
    return CategoryPool(Pool(majors, size), minors.select("index", "minor"))


def fixed_pool(categories: Mapping[str, Sequence[str]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(major).alias("major"),
                F.array(*[F.lit(m) for m in minors]).alias("minors"),
            )
            for major, minors in categories.items()
        ]
    )


def sample_facts(
    ids: DataFrame,
    id_column: str = "id",
    districts: Pool | None = None,
    categories: CategoryPool | None = None,
    years: Sequence[int] = fixed.SAMPLE_YEARS,
    mean: float = fixed.SAMPLE_MEAN,
    area_start: int = fixed.SAMPLE_AREA_START,
    area_stop: int = fixed.SAMPLE_AREA_STOP,
    seed: int = fixed.SAMPLE_SEED,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """One raw row per id: uniform district, category, area, year and month, and a
    Poisson measure. Both pools default to the fixed ones; a given pool is a table
    that each draw is joined with by number.
    """
    row_id = F.col(id_column).cast("bigint")
    digest = F.sha2(
        F.concat(F.lit(f"{seed}:"), row_id.cast("string")).cast("binary"), 256
    )
    # the digest, then its draws, are projected on their own: each is made once a row
    hashed = ids.select(row_id.alias("id"), digest.alias("__digest"))
    draws = [
        F.conv(F.substring("__digest", 1 + place * _DIGITS, _DIGITS), 16, 10)
        .cast("bigint")
        .alias(f"__draw{place}")
        for place in range(7)
    ]
    place_d, place_c, minor_d, area_d, value_d, year_d, month_d = (
        F.col(f"__draw{place}") for place in range(7)
    )

    def pick(draw: Column, pool: Column) -> Column:
        return F.get(pool, F.pmod(draw, F.size(pool)).cast("int"))

    def between(draw: Column, low: int, high: int) -> Column:
        return F.lit(low) + F.pmod(draw, F.lit(high - low))

    rows = hashed.select("id", *draws)
    if districts is None:
        names = F.array(*[F.lit(d) for d in fixed.SAMPLE_DISTRICTS])
        rows = rows.withColumn("__district", pick(place_d, names))
    else:
        rows = _drawn(rows, F.pmod(place_d, districts.size), districts.table, "value")
        rows = rows.withColumnRenamed("__value", "__district")
    if categories is None:
        category = pick(place_c, fixed_pool(fixed.SAMPLE_CATEGORIES))
        rows = rows.withColumns(
            {"__major": category["major"], "__minor": pick(minor_d, category["minors"])}
        )
    else:
        majors = categories.majors
        rows = _drawn(rows, F.pmod(place_c, majors.size), majors.table, "major", "first", "n")
        place = F.col("__first") + F.pmod(minor_d, F.col("__n"))
        rows = _drawn(rows, place, categories.minors, "minor")
    steps = [F.lit(int(step * _RANGE)) for step in poisson_steps(mean)]
    passed = [(value_d > step).cast("bigint") for step in steps]
    area = F.lpad(between(area_d, area_start, area_stop).cast("string"), 5, "0")
    return rows.select(
        "id",
        F.concat(F.lit("E010"), area).alias("lsoa_code"),
        F.col("__district").alias(spec.district),
        F.col("__major").alias(spec.major),
        F.col("__minor").alias(spec.minor),
        reduce(add, passed).alias(spec.measure),
        pick(year_d, F.array(*[F.lit(y).cast("bigint") for y in years])).alias(spec.year),
        between(month_d, spec.month_min, spec.month_max + 1).cast("bigint").alias(spec.month),
    )


def _drawn(rows: DataFrame, place: Column, pool: DataFrame, *columns: str) -> DataFrame:
    """Add the columns, with a mark before their names, of the pool's entry at ``place``."""
    entries = pool.select(F.col("index").alias("__place"), *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.withColumn("__place", place).join(entries, "__place", "left").drop("__place")


def inject_errors(
    df: DataFrame,
    id_column: str = "id",
    every: int | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Spoil four rows: a null district (id 0), a month past the last (1), a
    negative measure (2) and an unknown minor (3); with ``every``, the same
    remainders of every so many ids."""
    place = F.col(id_column)
    if every is not None:
        place = F.pmod(place, F.lit(every))
    kinds = {field.name: field.dataType for field in df.schema.fields}

    def spoil(column: str, at: int, bad) -> Column:
        return F.when(place == at, F.lit(bad).cast(kinds[column])).otherwise(F.col(column))

    return df.withColumns(
        {
            spec.district: spoil(spec.district, 0, None),
            spec.month: spoil(spec.month, 1, spec.month_max + 1),
            spec.measure: spoil(spec.measure, 2, -5),
            spec.minor: spoil(spec.minor, 3, "Unknown"),
        }
    )


def sample_table(
    spark: SparkSession,
    rows: int = fixed.SAMPLE_ROWS,
    errors: bool = True,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """The sample raw table of ``rows`` rows, spoiled unless told otherwise."""
    df = sample_facts(spark.range(rows), spec=spec)
    return (inject_errors(df, spec=spec) if errors else df).drop("id")
