"""Model measures from a table of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factmill.functions.numbers import half_even
from factmill.operators.ranked import running_totals, value_counts


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of true/false negatives and positives; all four for any input."""
    actual, guessed = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(~actual & ~guessed).alias("true_negatives"),
        F.count_if(~actual & guessed).alias("false_positives"),
        F.count_if(actual & ~guessed).alias("false_negatives"),
        F.count_if(actual & guessed).alias("true_positives"),
    )


def class_metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall and F1 of a confusion row; zero where undefined."""
    tn, fp, fn, tp = (
        F.col(c)
        for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )

    def share(part: Column, whole: Column) -> Column:
        ratio = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        return half_even(ratio.cast("double"), digits)

    return counts.select(
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, digits: int = 4
) -> DataFrame:
    """One row of mean absolute error and R squared, in one pass.

    The spread of the actual values is a population variance, which Spark merges
    from partial results without the cancellation of a sum of squares.
    """
    error = F.col(actual) - F.col(predicted)
    spread = F.var_pop(actual)
    # a constant target: perfect or useless
    r2 = F.when(spread == 0, F.when(F.avg(error * error) == 0, 1.0).otherwise(0.0)).otherwise(
        F.lit(1.0) - F.try_divide(F.avg(error * error), spread)
    )
    return df.agg(
        half_even(F.avg(F.abs(error)), digits).alias("mae"), half_even(r2, digits).alias("r2")
    )


def score_totals(
    df: DataFrame, label: str = "label", score: str = "score", following: bool = False
) -> DataFrame:
    """One row per distinct score with its positives and negatives, and how many of
    each score higher."""
    positive = F.col(label) == 1
    counts = value_counts(
        df, score, positives=F.count_if(positive), negatives=F.count_if(~positive)
    )
    return running_totals(counts, ["positives", "negatives"], descending=True, following=following)


def roc_auc(totals: DataFrame, digits: int = 4) -> DataFrame:
    """One row of the area under the curve and the Gini index of ``score_totals``.

    Each negative counts the positives above it and half of those level with it.
    Twice that is a whole number, summed as a decimal: exact, and no overflow.
    """
    above = F.col("before_positives") * 2 + F.col("positives")
    twice = F.sum(F.col("negatives").cast("decimal(19,0)") * above.cast("decimal(19,0)"))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    area = F.try_divide(twice.cast("double") / F.lit(2.0), pairs)
    return totals.agg(area.alias("__area")).select(
        half_even(F.col("__area"), digits).alias("roc_auc"),
        half_even(2 * F.col("__area") - 1, digits).alias("gini"),
    )


def roc_points(totals: DataFrame, digits: int = 6) -> DataFrame:
    """The curve as ``threshold, fpr, tpr`` rows, in no order, from (0, 0) to (1, 1).

    ``totals`` comes from ``score_totals`` with ``following``. A score whose step
    equals the next one's lies on a straight piece and is left out, but for the
    highest score. The start has an infinite threshold.
    """
    positives, negatives = F.col("positives"), F.col("negatives")
    grand = totals.agg(
        F.sum("positives").cast("double").alias("positives"),
        F.sum("negatives").cast("double").alias("negatives"),
    )
    whole = grand.select(F.struct("*").alias("row")).scalar()
    bend = (
        F.col("next_positives").isNull()
        | (F.col("before_positives") + F.col("before_negatives") == 0)
        | (F.col("next_positives") != positives)
        | (F.col("next_negatives") != negatives)
    )
    tpr = F.try_divide(F.col("before_positives") + positives, whole["positives"])
    fpr = F.try_divide(F.col("before_negatives") + negatives, whole["negatives"])
    curve = totals.where(bend).select(
        F.col("value").cast("double").alias("threshold"),
        half_even(fpr, digits).alias("fpr"),
        half_even(tpr, digits).alias("tpr"),
    )
    start = totals.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionAll(curve)
