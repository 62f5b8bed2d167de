"""Training and evaluation in one run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factmill import fixed_values as fixed
from factmill.operators import evaluate, features, models
from factmill.session import settle
from factmill.spec import DEFAULT_SPEC, FactSpec


@dataclass(frozen=True)
class TrainingResult:
    models: models.Models
    metrics: DataFrame  # one row
    curve: DataFrame  # threshold, fpr, tpr
    scored: DataFrame  # the test rows with predictions
    totals: DataFrame  # the given totals, as settled


def train_and_evaluate(
    totals: DataFrame,
    train_until: int = fixed.TRAIN_UNTIL,
    target: str = "median",
    trees: int = fixed.FOREST_TREES,
    min_leaf: int = fixed.FOREST_MIN_LEAF,
    max_depth: int = models.MAX_DEPTH,
    max_iter: int = fixed.LOGREG_MAX_ITER,
    seed: int = fixed.RANDOM_SEED,
    folder: str | None = None,
    spec: FactSpec = DEFAULT_SPEC,
) -> TrainingResult:
    """Fit both models on the early years and measure them on the later ones.

    The totals are settled once, as the threshold is taken from them before their rows
    are labelled, and so are the labelled table, as every fit makes several passes, and
    the scored test rows, as every measure reads them. With a ``folder`` the
    models and the metrics are stored there.
    """
    started = time.monotonic()
    totals = settle(totals, "totals")
    labelled = settle(features.add_target(totals, target, spec=spec), "labelled")
    train, test = features.temporal_split(labelled, train_until, seed=seed, spec=spec)
    pipeline = features.encoder(train, spec).fit(train)
    encoded = pipeline.transform(train).select(
        features.FEATURES, features.LABEL, spec.total
    )
    n_train, n_test = train.count(), test.count()
    # blocks lost with an executor are made again from the settled rows
    encoded = encoded.persist()
    try:
        classifier = models.train_classifier(encoded, n_train, max_iter)
        regressor = models.train_regressor(
            encoded, trees, min_leaf, max_depth, seed, spec=spec
        )
    finally:
        encoded.unpersist()
    fitted = models.Models(pipeline, classifier, regressor)

    scored = settle(
        fitted.apply(test).select(
            *spec.keys,
            spec.total,
            features.LABEL,
            F.col("prediction").cast("int").alias("prediction"),
            models.probability_of("probability", 1).alias("score"),
            "predicted",
        ),
        "scored",
    )
    totals_by_score = settle(evaluate.score_totals(scored, following=True), "scores")
    counts = evaluate.confusion(scored)
    parts: list[DataFrame] = [
        evaluate.class_metrics(counts),
        counts,
        evaluate.roc_auc(totals_by_score),
        evaluate.regression_metrics(scored, spec.total, "predicted"),
    ]

    def one(frame: DataFrame) -> list[Column]:
        row = frame.select(F.struct("*").alias("row")).scalar()
        return [row[c].alias(c) for c in frame.columns]

    hyper = {
        "random_state": seed,
        "logreg_max_iter": max_iter,
        "forest_trees": trees,
        "forest_min_leaf": min_leaf,
        "forest_max_depth": max_depth,
        "train_until": train_until,
    }
    metrics = totals.sparkSession.range(1).select(
        F.lit("LogisticRegression").alias("model"),
        *[c for part in parts for c in one(part)],
        F.lit(n_train).cast("bigint").alias("train_rows"),
        F.lit(n_test).cast("bigint").alias("test_rows"),
        F.lit(fixed.LOG_SCHEMA_VERSION).alias("schema_version"),
        F.struct(*[F.lit(v).alias(k) for k, v in hyper.items()]).alias("hyperparameters"),
        F.lit(round(time.monotonic() - started, 2)).alias("duration_seconds"),
    )
    curve = evaluate.roc_points(totals_by_score)
    if folder:
        fitted.save(folder)
        metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
        curve.write.mode("overwrite").json(f"{folder}/roc_curve")
    return TrainingResult(fitted, metrics, curve, scored, totals)
