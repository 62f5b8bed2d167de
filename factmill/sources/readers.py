"""Table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from factmill.spec import DEFAULT_SPEC, FactSpec


def scan(
    spark: SparkSession,
    path: str | None,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    row_cap: int | None = None,
    cap_order: Sequence[str] | None = None,
    **options: str,
) -> DataFrame:
    """All columns of a stored table (without a ``path``, of what the format's
    options name), at most ``row_cap`` rows if given.

    With ``cap_order`` the first rows in that order are kept (``first_in_order``). Without it a parquet table is capped by file
    and position, which is fixed too and moves no row between tasks; other formats
    have no such position and raise.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if row_cap is None:
        return df
    if cap_order:
        return first_in_order(df, row_cap, cap_order)
    if fmt != "parquet":
        raise ValueError(f"a row cap on {fmt} needs cap_order to be determined")
    return first_rows(df, row_cap)


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of a parquet scan by file name and row position.

    Files are counted from their footers. Files past the end are never opened, and
    in the last one the position is a plain filter.
    """
    place = F.col("_metadata.file_path")
    per_file = df.select(place.alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    # one row per file: the driver lists the same files when it plans the scan
    upto = (
        Window.partitionBy(F.lit(0))
        .orderBy("file")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = per_file.withColumn("end", F.sum("n").over(upto))
    last = (
        ends.where(F.col("end") >= rows)
        .agg(F.min_by(F.struct("file", "end", "n"), "end").alias("last"))
        .first()["last"]
    )
    if last is None:
        return df
    kept = last["n"] - (last["end"] - rows)
    position = F.col("_metadata.row_index")
    # the first filter is on the file alone, so the scan drops files by it
    return df.where(place <= last["file"]).where(
        (place < last["file"]) | (position < kept)
    )


def first_in_order(
    df: DataFrame, rows: int, order: Sequence[str], small: int = 10_000, pivots: int = 32
) -> DataFrame:
    """The first ``rows`` rows by ``order``, nulls first, as a filter: no row is moved for it.

    The key of the last row is found in rounds. Each draws some keys of the interval that
    holds it, by hash, and counts the rows up to each of them in one pass, which shrinks the
    interval to about a ``pivots``-th; at ``small`` rows it is sorted. Only keys drawn and
    counts come to the driver. Give a stored table, as it is read in each round. Rows that
    share the last key are alike in ``order``; so many of them are kept as have room, which
    is fixed only if the order tells rows apart.
    """
    if rows <= 0:
        return df.limit(0)
    kinds = [df.schema[c].dataType for c in order]

    def lit(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(values, kinds))])

    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])
    low: tuple | None = None
    high: tuple | None = None
    total, below = df.count(), 0
    if total <= rows:
        return df

    def inside() -> DataFrame:
        keys = df.select(key.alias("k"))
        if low is not None:
            keys = keys.where(F.col("k") > lit(low))
        return keys if high is None else keys.where(F.col("k") <= lit(high))

    while total > small:
        drawn = inside().distinct().orderBy(F.xxhash64("k"), "k").limit(pivots).collect()
        cuts = sorted({tuple(r.k) for r in drawn}, key=_nulls_first)
        counted = inside().agg(*[F.count_if(F.col("k") <= lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        ends = [*zip(cuts, counted), (high, total)]
        if len(cuts) == 1 and ends[0][1] == total:
            break  # a single key
        start, before = low, 0
        for cut, upto in ends:
            if below + upto >= rows:
                low, high, total, below = start, cut, upto - before, below + before
                break
            start, before = cut, upto
    if total > small:
        last = tuple(cuts[0])
        above = below
    else:
        first = inside().orderBy("k").limit(rows - below).collect()
        last = tuple(first[-1].k)
        above = below + sum(tuple(r.k) != last for r in first)
    sure = df.where(key < lit(last))
    tied = df.where(key.eqNullSafe(lit(last)))
    room = rows - above
    if tied.limit(room + 1).count() <= room:
        return df.where(key <= lit(last))
    return sure.unionAll(tied.limit(room))


def _nulls_first(values: tuple) -> tuple:
    return tuple((v is not None, isinstance(v, float) and v != v, 0 if v is None or v != v else v) for v in values)


def read_totals(
    spark: SparkSession, path: str, spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """The aggregated table from parquet or, by any other suffix, from CSV.

    CSV columns are found by the names in the header and cast to the known types:
    inferring types would read the data twice, and a schema given to the reader
    would be applied by position.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    text = spark.read.csv(path, header=True)
    types = {field.name: field.dataType for field in spec.processed_schema.fields}
    return text.select(
        *[F.col(c).try_cast(types[c]) if c in types else F.col(c) for c in text.columns]
    ).toDF(*text.columns)
