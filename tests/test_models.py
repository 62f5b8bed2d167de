import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from factmill import FactSpec
from factmill.operators import evaluate, features, models
from factmill.plans.training import train_and_evaluate

SPEC = FactSpec()


def test_target(ml_small):
    totals = [r["total_crimes"] for r in ml_small.collect()]
    for method, limit in (("median", np.median(totals)), ("mean", np.mean(totals))):
        got = features.add_target(ml_small, method).collect()
        assert all(r["label"] == int(r["total_crimes"] > limit) for r in got)
        assert 0.3 <= sum(r["label"] for r in got) / len(got) <= 0.7
    with pytest.raises(ValueError):
        features.add_target(ml_small, "mode")


def test_threshold_from_training_rows(ml_small):
    train, _ = features.temporal_split(ml_small, 2010)
    limit = np.median([r["total_crimes"] for r in train.collect()])
    got = features.add_target(ml_small, threshold_from=train).collect()
    assert all(r["label"] == int(r["total_crimes"] > limit) for r in got)


def test_month_circle(ml_small):
    for row in features.cyclical_month(ml_small).collect():
        assert row["month_sin"] ** 2 + row["month_cos"] ** 2 == pytest.approx(1)
        assert row["month_sin"] == pytest.approx(math.sin(2 * math.pi * row["month"] / 12))


def test_six_features(ml_small):
    assert features.feature_columns(ml_small).columns == [
        "borough", "major_category", "minor_category", "year", "month_sin", "month_cos",
    ]


def test_scale_uses_population_deviation(spark, ml_small):
    got = [r["year_scaled"] for r in features.standard_scale(ml_small, "year").collect()]
    assert np.mean(got) == pytest.approx(0, abs=1e-9)
    assert np.std(got) == pytest.approx(1)
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r["v_scaled"] for r in features.standard_scale(same, "v").collect()] == [0.0, 0.0]


def test_temporal_split(ml_small):
    train, test = features.temporal_split(ml_small)
    assert train.where("year > 2014").count() == test.where("year <= 2014").count() == 0
    assert train.count() + test.count() == ml_small.count()


def test_split_without_early_rows(spark):
    df = spark.range(4000).selectExpr(
        "concat('d', id % 40) AS borough", "concat('m', id % 7) AS major_category",
        "concat('n', id) AS minor_category", "2020 + id % 3 AS year", "1 + id % 12 AS month",
        "double(id % 9) AS total_crimes", "int(id % 2) AS label",
    )
    train, test = features.temporal_split(df, 2014)
    assert train.count() + test.count() == 4000
    shares = {r["label"]: r["count"] / 2000 for r in test.groupBy("label").count().collect()}
    assert all(abs(share - 0.3) < 0.05 for share in shares.values())
    again, _ = features.temporal_split(df.repartition(11), 2014)
    assert again.exceptAll(train).count() == train.exceptAll(again).count() == 0


def test_encoding(spark, ml_small):
    train, _ = features.temporal_split(ml_small)
    fitted = features.encoder(train).fit(train)
    encoded = fitted.transform(train)
    assert features.feature_width(encoded) == 12
    rows = encoded.select(vector_to_array("features").alias("x")).collect()
    x = np.array([r["x"] for r in rows])
    assert (x[:, :9].sum(axis=1) == 3).all()
    assert x[:, 9:].mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9)
    assert x[:, 9:].std(axis=0) == pytest.approx(np.ones(3))
    unseen = spark.createDataFrame(
        [("Atlantis", "Roads", "Leak", 2016, 6)],
        "borough string, major_category string, minor_category string, year long, month long",
    )
    y = fitted.transform(unseen).select(vector_to_array("features")).first()[0]
    assert y[:3] == [0.0, 0.0, 0.0] and sum(y[3:9]) == 2


def newton(x, y, steps=60):
    """Minimise summed log loss plus half the squared weights; free intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty,
                             x.T @ (p - y) + penalty @ w)
    return w


def test_classifier_solves_the_penalised_problem(ml_small):
    labelled = features.add_target(ml_small)
    encoded = features.encoder(labelled).fit(labelled).transform(labelled).cache()
    model = models.train_classifier(encoded, encoded.count())
    rows = encoded.select(vector_to_array("features").alias("x"), "label").collect()
    w = newton(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    assert list(model.coefficients) == pytest.approx(w[:-1], abs=1e-4)
    assert model.intercept == pytest.approx(w[-1], abs=1e-4)


@pytest.fixture(scope="module")
def trained(ml_small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    return folder, train_and_evaluate(ml_small, trees=5, max_depth=5, folder=folder)


def test_training_run(spark, trained):
    folder, result = trained
    row = result.metrics.first()
    assert row["train_rows"] + row["test_rows"] == 200
    assert (row["true_negatives"] + row["false_positives"] + row["false_negatives"]
            + row["true_positives"]) == row["test_rows"]
    assert row["roc_auc"] > 0.6 and row["gini"] == pytest.approx(2 * row["roc_auc"] - 1, abs=2e-4)
    assert row["r2"] > 0.2 and row["mae"] < 5
    stored = spark.read.json(f"{folder}/metrics").first()
    assert stored["accuracy"] == row["accuracy"]
    assert stored["hyperparameters"]["forest_trees"] == 5
    curve = [(r["fpr"], r["tpr"]) for r in result.curve.collect()]
    assert (0.0, 0.0) in curve and (1.0, 1.0) in curve


def test_scoring_stored_models(spark, trained):
    folder, result = trained
    rows = spark.createDataFrame(
        [(1, " millbrook ", "ROADS", "Potholes", 2016, 6), (2, "Nowhere", "x", "y", 2016, 6)],
        "id int, borough string, major_category string, minor_category string, year long, month long",
    )
    loaded = models.load_models(spark, folder)
    got = models.score(rows, loaded).orderBy("id").collect()
    fresh = models.score(rows, result.models).orderBy("id").collect()
    assert got == fresh
    for row in got:
        assert row["prediction"] == int(row["probability_high"] > 0.5)
        assert row["probability_high"] + row["probability_low"] == pytest.approx(1, abs=2e-4)
        assert row["predicted_crimes_raw"] >= 0
        assert row["predicted_crimes"] == round(row["predicted_crimes_raw"])
        assert (row["threshold"], row["features_used"]) == (0.5, 12)
    assert got[0]["borough"] == " millbrook "
    proper = rows.where("id = 1").withColumns(
        {"borough": F.lit("Millbrook"), "major_category": F.lit("Roads")}
    )
    exact = models.score(proper, loaded, normalize_inputs=False).first()
    assert exact["probability_high"] == got[0]["probability_high"]


def test_missing_models(spark, trained, tmp_path):
    with pytest.raises(FileNotFoundError, match="classifier"):
        models.load_models(spark, str(tmp_path))


def brute_roc(labels, scores):
    points, tp, fp = [], 0, 0
    for s in sorted(set(scores), reverse=True):
        tp += sum(1 for y, v in zip(labels, scores) if v == s and y == 1)
        fp += sum(1 for y, v in zip(labels, scores) if v == s and y == 0)
        points.append((fp, tp))
    keep = [
        p for i, p in enumerate(points)
        if i in (0, len(points) - 1)
        or points[i + 1][0] - 2 * p[0] + points[i - 1][0]
        or points[i + 1][1] - 2 * p[1] + points[i - 1][1]
    ]
    full = [(0, 0), *points]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(full, full[1:])) / (tp * fp)
    return [(0.0, 0.0), *[(round(f / fp, 6), round(t / tp, 6)) for f, t in keep]], area


def test_curve_and_area_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    scores = [float(v) for v in rng.integers(0, 60, 500) / 60]
    labels = [int(rng.random() < s) for s in scores]
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    curve, area = brute_roc(labels, scores)
    totals = evaluate.score_totals(df, following=True)
    got = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(totals).collect())
    assert got == sorted(curve)
    assert tuple(evaluate.roc_auc(totals).first()) == pytest.approx(
        (round(area, 4), round(2 * area - 1, 4)), abs=1e-9
    )


def test_one_class_still_has_four_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "label int, prediction int")
    counts = evaluate.confusion(df)
    assert tuple(counts.first()) == (0, 0, 1, 1)
    assert tuple(evaluate.class_metrics(counts).first()) == (0.5, 1.0, 0.5, 0.6667)
    none = evaluate.class_metrics(evaluate.confusion(df.where("label = 0")))
    assert tuple(none.first()) == (0.0, 0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    rows = [(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, p double")
    y, p = np.array(rows).T
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert tuple(evaluate.regression_metrics(df, "a", "p").first()) == (0.5, round(r2, 4))
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "a double, p double")
    assert evaluate.regression_metrics(flat, "a", "p").first()["r2"] == 1.0


def test_training_reads_the_totals_from_one_stored_table(ml_small, monkeypatch):
    from factmill.plans import training

    seen = []
    given = features.add_target

    def watched(df, *args, **kwargs):
        seen.append(df.inputFiles())
        return given(df, *args, **kwargs)

    monkeypatch.setattr(training.features, "add_target", watched)
    result = train_and_evaluate(ml_small, trees=2, max_depth=2)
    # the threshold and the labels come from a table, not from the plan of the totals
    assert seen == [result.totals.inputFiles()] and seen[0]
    assert sorted(result.totals.collect()) == sorted(ml_small.collect())
