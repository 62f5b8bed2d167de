"""Targets, features, encoding and the train/test split."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, functions as F

from factmill import fixed_values as fixed
from factmill.functions import dates
from factmill.operators.ranked import exact_quantiles
from factmill.spec import DEFAULT_SPEC, FactSpec

SIN, COS = "month_sin", "month_cos"
FEATURES = "features"
LABEL = "label"


def numeric_features(spec: FactSpec = DEFAULT_SPEC) -> list[str]:
    return [spec.year, SIN, COS]


def cyclical_month(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """Add sine and cosine of the month, so December is next to January."""
    month = F.col(spec.month)
    return df.withColumns({SIN: dates.month_sin(month), COS: dates.month_cos(month)})


def feature_columns(df: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> DataFrame:
    """The six columns a model sees: the dimensions, the year and the month circle."""
    return cyclical_month(df, spec).select(*spec.dims, *numeric_features(spec))


def target_threshold(
    df: DataFrame, method: str = "median", spec: FactSpec = DEFAULT_SPEC
) -> DataFrame:
    """One row with the ``threshold`` above which a total is high."""
    if method == "median":
        return exact_quantiles(df, spec.total, [0.5]).select(F.col("q50").alias("threshold"))
    if method == "mean":
        return df.agg(F.avg(spec.total).alias("threshold"))
    raise ValueError(f"method must be 'median' or 'mean', not {method!r}")


def add_target(
    df: DataFrame,
    method: str = "median",
    threshold_from: DataFrame | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Add ``label``: 1 where the total is above the threshold, else 0.

    The threshold is taken over the whole table, test rows included; give the
    training rows as ``threshold_from`` to keep the test rows out of it.
    """
    source = df if threshold_from is None else threshold_from
    threshold = target_threshold(source, method, spec).scalar()
    above = F.coalesce(F.col(spec.total) > threshold, F.lit(False))
    return df.withColumn(LABEL, above.cast("int"))


def standard_scale(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<name>_scaled``: zero mean and unit population deviation."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )
    row = stats.select(F.struct("*").alias("row")).scalar()

    def scaled(column: str) -> Column:
        std = F.coalesce(F.nullif(row[f"std_{column}"], F.lit(0.0)), F.lit(1.0))
        return ((F.col(column) - row[f"mean_{column}"]) / std).alias(f"{column}_scaled")

    return df.select("*", *[scaled(c) for c in columns])


def temporal_split(
    df: DataFrame,
    train_until: int = fixed.TRAIN_UNTIL,
    test_share: float = 0.3,
    seed: int = fixed.RANDOM_SEED,
    spec: FactSpec = DEFAULT_SPEC,
) -> tuple[DataFrame, DataFrame]:
    """Years up to ``train_until`` to train on, later ones to test on.

    Without any row to train on, the table is split by a hash of each row's keys,
    alike within both classes; the same row always falls on the same side. Give a
    stored table: both sides read it.
    """
    early = F.col(spec.year) <= train_until
    train = df.where(early)
    if not train.isEmpty():
        return train, df.where(~early | F.col(spec.year).isNull())
    held_out = split_bucket(seed, spec) < int(round(test_share * 1000))
    return df.where(~held_out), df.where(held_out)


def split_bucket(seed: int = fixed.RANDOM_SEED, spec: FactSpec = DEFAULT_SPEC) -> Column:
    """A number from 0 to 999 fixed by a row's keys and the seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000


def _literal(number: float) -> str:
    return f"CAST('{number!r}' AS DOUBLE)"


def encoder(train: DataFrame, spec: FactSpec = DEFAULT_SPEC) -> Pipeline:
    """Pipeline from the six columns to one sparse feature vector.

    A dimension value gets one slot; a value not seen in training gets none, as
    the slot for unseen values is the one dropped. Numbers are scaled by the
    population deviation, put into the pipeline as constants so that they are
    saved with it. The index holds one entry per distinct dimension value.
    """
    columns = numeric_features(spec)
    stats = (
        cyclical_month(train, spec)
        .agg(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        )
        .first()
    )
    scaled = []
    for column in columns:
        mean, std = stats[f"mean_{column}"], stats[f"std_{column}"] or 1.0
        scaled.append(f"(`{column}` - {_literal(mean)}) / {_literal(std)} AS `{column}_scaled`")
    turn = _literal(2 * math.pi)
    circle = SQLTransformer(
        statement=f"SELECT *, sin({turn} * `{spec.month}` / 12.0D) AS `{SIN}`, "
        f"cos({turn} * `{spec.month}` / 12.0D) AS `{COS}` FROM __THIS__"
    )
    scale = SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")
    index = StringIndexer(
        inputCols=spec.dims,
        outputCols=[f"{c}_index" for c in spec.dims],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    one_hot = OneHotEncoder(
        inputCols=[f"{c}_index" for c in spec.dims],
        outputCols=[f"{c}_slots" for c in spec.dims],
        dropLast=True,
    )
    assemble = VectorAssembler(
        inputCols=[f"{c}_slots" for c in spec.dims] + [f"{c}_scaled" for c in columns],
        outputCol=FEATURES,
    )
    return Pipeline(stages=[circle, scale, index, one_hot, assemble])


def feature_width(df: DataFrame, column: str = FEATURES) -> int:
    """Length of the feature vector, from the column's metadata; needs no job."""
    return df.schema[column].metadata["ml_attr"]["num_attrs"]
