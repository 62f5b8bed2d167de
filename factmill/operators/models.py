"""Training, batch scoring, and the stored model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factmill import fixed_values as fixed
from factmill.functions.numbers import at_least_zero, half_even
from factmill.operators import clean
from factmill.operators.features import FEATURES, LABEL, feature_width
from factmill.spec import DEFAULT_SPEC, FactSpec

# deepest tree that is built unless told otherwise; Spark's own limit is 30. On noisy
# totals deeper trees only split the noise of single rows: each level doubles the nodes,
# and the forest, which lives on the driver, grows with the rows
MAX_DEPTH = 12
# bins of a number: at least as many as there are years, so that any year can be split at
MAX_BINS = 128


def train_classifier(
    encoded: DataFrame, rows: int, max_iter: int = fixed.LOGREG_MAX_ITER
) -> LogisticRegressionModel:
    """Logistic regression with a unit L2 penalty on the summed loss.

    Spark averages the loss over the rows, so the penalty is divided by ``rows``
    to weigh the same. The intercept is not penalised.
    """
    fitted = LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        predictionCol="prediction",
        probabilityCol="probability",
        rawPredictionCol="margin",
        maxIter=max_iter,
        regParam=1.0 / max(rows, 1),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-8,
        threshold=fixed.DECISION_THRESHOLD,
    ).fit(encoded)
    # the training summary holds the session, which cannot be sent to tasks once anything
    # in it was observed; scoring needs the weights only
    nothing = encoded.sparkSession._jvm.scala.Option.empty()
    fitted._java_obj.setSummary(nothing)
    return fitted


def train_regressor(
    encoded: DataFrame,
    trees: int = fixed.FOREST_TREES,
    min_leaf: int = fixed.FOREST_MIN_LEAF,
    max_depth: int = MAX_DEPTH,
    seed: int = fixed.RANDOM_SEED,
    memory_mb: int = 1024,
    max_bins: int = MAX_BINS,
    spec: FactSpec = DEFAULT_SPEC,
) -> RandomForestRegressionModel:
    """A forest of regression trees on the totals, every feature tried per split.

    ``memory_mb`` bounds the node statistics of one pass: more of it means fewer
    passes over the rows. ``max_bins`` should not be below the number of distinct years,
    or splits between years are approximate. Each row's place in each tree is kept between passes, and
    checkpointed in the shared folder, instead of being walked to anew.
    """
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=spec.total,
        predictionCol="predicted",
        numTrees=trees,
        minInstancesPerNode=min_leaf,
        maxDepth=max_depth,
        featureSubsetStrategy="all",
        seed=seed,
        maxMemoryInMB=memory_mb,
        maxBins=max_bins,
        cacheNodeIds=True,
        checkpointInterval=10,
    ).fit(encoded)


@dataclass(frozen=True)
class Models:
    """The fitted encoder, classifier and regressor."""

    encoder: PipelineModel
    classifier: LogisticRegressionModel
    regressor: RandomForestRegressionModel

    def apply(self, df: DataFrame) -> DataFrame:
        """Add features, ``prediction``, ``probability`` and ``predicted``."""
        encoded = self.encoder.transform(df)
        return self.regressor.transform(self.classifier.transform(encoded))

    def save(self, folder: str) -> dict[str, str]:
        paths = {}
        for name in PARTS:
            paths[name] = f"{folder}/{name}"
            getattr(self, name).write().overwrite().save(paths[name])
        return paths


PARTS = {
    "encoder": PipelineModel,
    "classifier": LogisticRegressionModel,
    "regressor": RandomForestRegressionModel,
}


def load_models(spark: SparkSession, folder: str) -> Models:
    """The stored parts; raises if any of them is missing."""
    parts, absent = {}, []
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, kind in PARTS.items():
        path = files.Path(f"{folder}/{name}")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path):
            parts[name] = kind.load(f"{folder}/{name}")
        else:
            absent.append(name)
    if absent:
        raise FileNotFoundError(f"no model in {folder}: {absent} missing; train first")
    return Models(**parts)


def probability_of(column: str, place: int) -> Column:
    return vector_to_array(column)[place]


def score(
    df: DataFrame,
    models: Models,
    normalize_inputs: bool = True,
    spec: FactSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Score every row of a table (or stream) of dimensions, year and month.

    The dimensions are spelled as in training unless ``normalize_inputs`` is off;
    a spelling not seen in training counts as unknown. All columns of the table
    pass through as they were given.
    """
    given = {c: f"__given_{c}" for c in spec.dims}
    rows = df.withColumns({kept: F.col(c) for c, kept in given.items()})
    if normalize_inputs:
        rows = clean.normalize_text(rows, spec)
    scored = models.apply(rows)
    estimate = at_least_zero(F.col("predicted"))
    return scored.select(
        *[F.col(given.get(c, c)).alias(c) for c in df.columns],
        F.col("prediction").cast("int").alias("prediction"),
        half_even(probability_of("probability", 1), 4).alias("probability_high"),
        half_even(probability_of("probability", 0), 4).alias("probability_low"),
        half_even(estimate, 0).cast("bigint").alias("predicted_crimes"),
        half_even(estimate, 2).alias("predicted_crimes_raw"),
        F.lit(fixed.DECISION_THRESHOLD).alias("threshold"),
        F.lit(feature_width(scored)).alias("features_used"),
    )
