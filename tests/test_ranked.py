import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factmill.operators import outliers, ranked
from factmill.spec import DEFAULT_SPEC

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.integers(-50, 50).map(lambda i: i / 4), min_size=1, max_size=120),
    st.sampled_from([1, 3, 10_000]),
)
def test_quantiles_agree_with_numpy(spark, values, range_rows):
    # a third of the rows share one value
    values = values + [1.5] * (len(values) // 2)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = ranked.exact_quantiles(df, "v", SHARES, range_rows).first()
    assert got["n"] == len(values)
    expected = np.quantile(np.array(values), SHARES)
    assert [got[ranked.quantile_name(s)] for s in SHARES] == pytest.approx(expected)


def test_quantiles_of_nothing(spark):
    got = ranked.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()
    assert (got["n"], got["q50"]) == (0, None)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("range_rows", [7, 100, 10_000])
def test_running_totals_agree_with_brute_force(spark, descending, range_rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)) / 7).alias("v")
    )
    counts = ranked.value_counts(df, "v", odd=F.count_if(F.floor(F.col("v")) % 2 == 1))
    got = ranked.running_totals(counts, ["n", "odd"], descending, True, range_rows).collect()
    got.sort(key=lambda r: r["value"], reverse=descending)
    assert len(got) == counts.count()
    n = odd = 0
    for i, row in enumerate(got):
        after = got[i + 1] if i + 1 < len(got) else None
        assert (row["before_n"], row["before_odd"]) == (n, odd)
        assert row["next_n"] == (after["n"] if after else None)
        assert row["next_odd"] == (after["odd"] if after else None)
        n, odd = n + row["n"], odd + row["odd"]
    assert n == 3000


def totals(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "total_crimes double")


def test_iqr(spark):
    df = totals(spark, [1, 2, 1, 2, 1, 2, 100])
    fences = outliers.iqr_fences(ranked.exact_quantiles(df, "total_crimes", [0.25, 0.75])).first()
    assert tuple(fences) == (-0.5, 3.5)
    assert [r[0] for r in outliers.outlier_rows(df).collect()] == [100.0]
    summary = outliers.outlier_summary(df).first()
    assert (summary["n_rows"], summary["n_outliers"], summary["outlier_min"]) == (7, 1, 100.0)


def test_zscore(spark):
    values = [1, 2] * 20 + [100]
    df = totals(spark, values)
    a = np.array(values, float)
    expected = [v for v in a if abs((v - a.mean()) / a.std(ddof=1)) > 3]
    assert [r[0] for r in outliers.outlier_rows(df, "zscore").collect()] == expected
    assert outliers.outlier_summary(df, "zscore").first()["n_outliers"] == len(expected)


@pytest.mark.parametrize("values", [[], [5], [5, 5, 5]])
@pytest.mark.parametrize("method", outliers.METHODS)
def test_no_spread_no_outliers(spark, values, method):
    df = totals(spark, values)
    assert outliers.outlier_rows(df, method).count() == 0
    assert outliers.outlier_summary(df, method).first()["n_outliers"] == 0


def test_unknown_method_and_missing_totals(spark):
    with pytest.raises(ValueError, match="iqr"):
        outliers.flag_outliers(totals(spark, [1]), "mad")
    other = spark.range(3)
    assert outliers.flag_outliers(other).count() == 0
    assert outliers.outlier_summary(other).first()["n_outliers"] == 0


def test_quantiles_do_not_depend_on_the_number_of_ranges(spark):
    """Infinities, ties and awkward doubles: one range and many give the very same numbers."""
    import random

    pick = random.Random(4)
    values = [pick.uniform(-1, 1) ** 3 for _ in range(300)] + [0.1, 0.1, 0.1, 0.3] * 20
    values += [float("inf")] * 40 + [float("-inf")] * 35 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts = ranked.value_counts(df, "x")
    shares = [0.0, 0.01, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.95, 0.99, 1.0]
    one = ranked.quantiles_of_counts(counts, shares).first()
    assert one["q05"] == float("-inf") and one["q95"] == float("inf")
    for range_rows in (7, 50, 200):
        many = ranked.quantiles_of_counts(counts, shares, range_rows).first()
        assert [repr(x) for x in many] == [repr(x) for x in one]


def test_numbered_rows(spark):
    df = spark.range(500).selectExpr("concat('k', id % 170) AS a", "id AS b").repartition(9)
    got = [tuple(r) for r in ranked.numbered(df).orderBy("index").collect()]
    want = sorted((f"k{i % 170}", i) for i in range(500))
    assert got == [(k, *row) for k, row in enumerate(want)]


def test_numbered_groups(spark):
    """Groups of one row, of many ranges, and of a null first column, in one pass."""
    keys = [None] * 90 + ["a"] * 300 + ["b"] + ["c"] * 2 + [f"d{i:02}" for i in range(40)] + ["z"] * 200
    rows = [(key, i) for i, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "a string, b long").repartition(9)
    got = ranked.numbered(df, group_name="group").orderBy("index").collect()
    places = {key: k for k, key in enumerate(dict.fromkeys(keys))}
    assert [tuple(r) for r in got] == [(i, places[key], key, i) for i, key in enumerate(keys)]
    assert ranked.numbered(df.limit(0), group_name="group").count() == 0


def test_summary_has_the_quantiles_of_the_rows(spark):
    values = [float(v) for v in range(1, 101)] + [10_000.0]
    summary = outliers.outlier_summary(totals(spark, values)).first()
    shares = DEFAULT_SPEC.report_quantiles
    got = [summary[ranked.quantile_name(share)] for share in shares]
    assert got == pytest.approx(np.quantile(values, shares))
    assert (summary["outlier_min"], summary["outlier_max"]) == (10_000.0, 10_000.0)
