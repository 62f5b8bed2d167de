"""Row cleaning. Each step is ``DataFrame -> DataFrame``, for use with ``transform``.

A step touches a column only if the table has it, so the steps run on any subset
of the roles. All of them but ``drop_copies`` work row by row and so also accept
a streaming table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factmill.functions import dates, numbers, text
from factmill.session import settle
from factmill.spec import DEFAULT_SPEC, FactSpec


def standard_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def standardize_names(df: DataFrame) -> DataFrame:
    """Lower-case column names with underscores; refuses names that collide."""
    names = [standard_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns with the same standard name: {clashes}")
    return df if names == df.columns else df.toDF(*names)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_missing(df: DataFrame, column: str, spec: FactSpec = DEFAULT_SPEC) -> Column:
    """Null, NaN or, in a text column, exactly one of the null tokens."""
    col = F.col(column)
    if numbers.is_text(df.schema[column].dataType) and spec.null_tokens:
        tokens = ", ".join(_quoted(token) for token in spec.null_tokens)
        # named once: the optimizer puts what the column is made of in place of each name,
        # and the JVM leaves generated methods above 8,000 bytes uncompiled
        return F.coalesce(F.expr(f"`{column}` IN ({tokens})"), F.lit(True))
    return is_null(df, column)


def is_null(df: DataFrame, column: str) -> Column:
    """Null or NaN; tokens count as present."""
    col = F.col(column)
    if numbers.is_fraction(df.schema[column].dataType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_critical(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> Column:
    """True where any critical column present in the table is missing."""
    found = [is_missing(df, c, spec) for c in spec.critical if c in df.columns]
    return reduce(or_, found, F.lit(False))


def drop_missing(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Keep rows whose critical columns are all present.

    Tokens are compared before any trimming, and the minor category is not
    critical: an unknown minor stays.
    """
    return df.where(~missing_critical(df, spec))


def _once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Put the given columns in place, each reckoned once per row.

    They come out of a generator of one row. Filters on them stay above it; moved
    below a plain projection, every filter would repeat the whole expression.
    """
    others = [F.col(c) for c in df.columns if c not in values]
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select(*others, F.inline(F.array(row))).select(*df.columns)


def cast_columns(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Year and month to bigint, measure to double, dimensions to text.

    Whole-number years and months are cast in place, so filters on them still
    reach the scan.
    """
    plain, parsed = {}, {}
    kinds = {field.name: field.dataType for field in df.schema.fields}
    for column in (spec.year, spec.month):
        kind = kinds.get(column, T.LongType())
        if not isinstance(kind, T.LongType):
            chosen = plain if isinstance(kind, T.IntegralType) else parsed
            chosen[column] = numbers.to_whole(F.col(column), kind, spec.strict_whole)
    if spec.measure in kinds:
        kind = kinds[spec.measure]
        chosen = parsed if numbers.is_text(kind) else plain
        chosen[spec.measure] = numbers.to_number(F.col(spec.measure), kind)
    for column in spec.dims:
        if not numbers.is_text(kinds.get(column, T.StringType())):
            plain[column] = F.col(column).cast("string")
    if plain:
        df = df.withColumns(plain)
    return _once(df, parsed) if parsed else df


def latest_year(spec: FactSpec = DEFAULT_SPEC) -> Column:
    if spec.year_max is None:
        return F.year(F.current_date()).cast("bigint")
    return F.lit(spec.year_max).cast("bigint")


def bad_month(spec: FactSpec = DEFAULT_SPEC) -> Column:
    """True for a month that is present and out of range, else false."""
    month = F.col(spec.month)
    return F.coalesce(~month.between(spec.month_min, spec.month_max), F.lit(False))


def bad_year(spec: FactSpec = DEFAULT_SPEC) -> Column:
    year = F.col(spec.year)
    return F.coalesce(~year.between(F.lit(spec.year_min), latest_year(spec)), F.lit(False))


def bad_measure(spec: FactSpec = DEFAULT_SPEC) -> Column:
    return F.coalesce(F.col(spec.measure) < 0, F.lit(False))


def keep_ranges(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Keep valid months, years and measures of a cast table.

    Null months and years pass here and go at aggregation, whose keys may not be
    null. A null measure passes and adds nothing, unless the spec drops it.
    """
    year, month, measure = F.col(spec.year), F.col(spec.month), F.col(spec.measure)
    kept = []
    if spec.month in df.columns:
        kept.append(month.isNull() | month.between(spec.month_min, spec.month_max))
    if spec.year in df.columns:
        kept.append(year.isNull() | year.between(F.lit(spec.year_min), latest_year(spec)))
    if spec.measure in df.columns:
        valid = measure >= 0
        if spec.null_measure == "keep":
            valid = valid | measure.isNull()
        kept.append(valid)
    return df.where(reduce(and_, kept)) if kept else df


def normalize_text(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Strip and title-case the dimensions, then restore known district spellings."""
    changes = {}
    for column in spec.dims:
        if column in df.columns:
            changes[column] = text.normal_case(F.col(column))
    if spec.district in changes and spec.corrections:
        # projected in a step of its own, so the casing is computed once per row
        df = df.withColumns(changes)
        return df.withColumn(
            spec.district, text.replace_values(F.col(spec.district), spec.corrections)
        )
    return df.withColumns(changes) if changes else df


def correct_from_table(
    df: DataFrame, column: str, table: DataFrame, old: str = "old", new: str = "new"
) -> DataFrame:
    """Replace values of ``column`` by a table of spellings, however large.

    The table is reduced to one row per spelling, so no row is multiplied, and settled:
    the optimizer knows its size before it broadcasts it, and otherwise can split a
    much-used value, or the nulls, as an aggregate under the join would prevent.
    """
    pairs = settle(
        table.where(F.col(old).isNotNull())
        .groupBy(F.col(old).alias("__old"))
        .agg(F.min(new).alias("__new")),
        "spellings",
    )
    joined = df.join(pairs, F.col(column) == F.col("__old"), "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def drop_copies(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Drop rows identical in every column; nulls are equal to each other.

    Copies are combined before the shuffle and the shuffle key is the whole row,
    so neither a much-copied row nor a hot dimension value lands in one task.
    """
    return df.dropDuplicates() if spec.dedup == "exact" else df


def drop_null_keys(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Keep rows whose keys are all present."""
    return df.where(reduce(and_, [F.col(key).isNotNull() for key in spec.keys]))


def total_by_keys(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Sum the measure per key; rows with a null key are left out.

    A group without any measure totals zero. A table that lacks a key column is
    returned as it is.
    """
    if any(c not in df.columns for c in spec.raw_columns):
        return df
    return _sum_groups(drop_null_keys(df, spec), spec)


def _sum_groups(df: DataFrame, spec: FactSpec) -> DataFrame:
    measure = F.col(spec.measure)
    if numbers.is_fraction(df.schema[spec.measure].dataType):
        measure = F.when(~F.isnan(measure), measure)
    total = F.coalesce(F.sum(measure).cast("double"), F.lit(0.0))
    return df.groupBy(*spec.keys).agg(total.alias(spec.total))


def add_date(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """First day of the month as a date."""
    if spec.year not in df.columns or spec.month not in df.columns:
        return df
    return df.withColumn(
        spec.date, dates.month_start(F.col(spec.year), F.col(spec.month))
    )


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def keep_columns(
    df: DataFrame, spec: FactSpec = DEFAULT_SPEC, keep: list[str] | None = None
) -> DataFrame:
    """Only the listed columns, in the order the table has them."""
    keep = spec.processed_columns if keep is None else keep
    return df.select(*[c for c in df.columns if c in keep])


def clean_rows(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The row-by-row steps: names, missing values, casts, ranges, text."""
    return normalize_text(_valid_rows(df, spec), spec)


def _valid_rows(df: DataFrame, spec: FactSpec) -> DataFrame:
    return (
        df.transform(standardize_names)
        .transform(drop_missing, spec)
        .transform(cast_columns, spec)
        .transform(keep_ranges, spec)
    )


def clean(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """From a raw table to dated totals per key.

    Rows that the totals leave out for a null key go before the text is treated
    and the copies are shuffled: neither step makes or fills a null.
    """
    rows = _valid_rows(df, spec)
    if any(c not in rows.columns for c in spec.raw_columns):
        # nothing to total: the cleaned rows themselves
        rows = rows.transform(normalize_text, spec).transform(drop_copies, spec)
    else:
        rows = (
            rows.transform(drop_null_keys, spec)
            .transform(normalize_text, spec)
            .transform(drop_copies, spec)
            .transform(_sum_groups, spec)
        )
    return rows.transform(add_date, spec).transform(keep_columns, spec)


def step_counts(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows in, out and removed per cleaning step, from one pass over the table.

    Every row is labelled with the first step that would remove it; the rest are
    counted by whole row and then by key. No step is counted with a job of its own.
    """
    named = standardize_names(df)
    marked = named.withColumn("__missing", missing_critical(named, spec))
    cast = cast_columns(marked, spec)
    label = F.when(F.col("__missing"), "missing")
    if spec.month in cast.columns:
        label = label.when(bad_month(spec), "month")
    if spec.year in cast.columns:
        label = label.when(bad_year(spec), "year")
    if spec.measure in cast.columns:
        bad = bad_measure(spec)
        if spec.null_measure == "drop":
            bad = bad | F.col(spec.measure).isNull()
        label = label.when(bad, "measure")
    labelled = cast.withColumn("__step", F.coalesce(label, F.lit("kept"))).drop("__missing")

    kept = F.col("__step") == "kept"
    columns = [c for c in labelled.columns if c != "__step"]
    normal = normalize_text(labelled, spec)
    # rows on their way out need no other column, so they collapse before the shuffle
    rows = normal.select("__step", *[F.when(kept, F.col(c)).alias(c) for c in columns])
    per_row = rows.groupBy("__step", *columns).agg(F.count("*").alias("__n"))
    null_key = reduce(or_, [F.col(key).isNull() for key in spec.keys])
    per_key = (
        per_row.withColumn("__null_key", kept & null_key)
        .groupBy("__step", "__null_key", *spec.keys)
        .agg(F.sum("__n").alias("__n"), F.count("*").alias("__distinct"))
    )
    copies = spec.dedup == "exact"
    survivors = F.col("__distinct") if copies else F.col("__n")

    def total(condition: Column, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("bigint")

    n = F.col("__n")
    sums = per_key.agg(
        *[
            total(F.col("__step") == step, n).alias(step)
            for step in ("missing", "month", "year", "measure")
        ],
        total(kept, n - survivors).alias("copies"),
        total(kept & F.col("__null_key"), survivors).alias("null_key"),
        total(kept & ~F.col("__null_key"), survivors - 1).alias("merged"),
        total(F.lit(True), n).alias("rows_in"),
    )
    order = ["missing", "month", "year", "measure", "copies", "null_key", "merged"]
    steps, before = [], F.col("rows_in")
    for position, step in enumerate(order, start=1):
        after = before - F.col(step)
        steps.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(step).alias("step"),
                before.alias("rows_in"),
                after.alias("rows_out"),
                F.col(step).alias("rows_removed"),
            )
        )
        before = after
    return sums.select(F.inline(F.array(*steps)))
