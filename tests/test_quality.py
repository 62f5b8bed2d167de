import pytest
from pyspark.sql import functions as F

from factmill import FactSpec
from factmill.operators import quality


def by_rule(report):
    return {r["rule"]: r for r in report.collect()}


def test_clean_table_passes(clean_small):
    assert quality.check(clean_small) is True


def test_missing_column_raises(clean_small):
    with pytest.raises(quality.QualityError, match="date"):
        quality.check(clean_small.drop("date"))
    assert issubclass(quality.QualityError, AssertionError)


def test_wrong_type_raises(clean_small):
    with pytest.raises(quality.QualityError, match="types"):
        quality.check(clean_small.withColumn("year", F.col("year").cast("string")))


@pytest.mark.parametrize(
    "column, value, rule",
    [
        ("borough", "CAST(NULL AS STRING)", "core_nulls"),
        ("total_crimes", "double('NaN')", "core_nulls"),
        ("year", "1999L", "year_range"),
        ("month", "13L", "month_range"),
        ("total_crimes", "-1.0D", "no_negatives"),
    ],
)
def test_bad_values_raise(clean_small, column, value, rule):
    bad = clean_small.withColumn(
        column, F.when(F.col("borough") == "Dunmore", F.expr(value)).otherwise(F.col(column))
    )
    with pytest.raises(quality.QualityError, match=rule):
        quality.check(bad)


def test_no_upper_year_bound_after_cleaning(clean_small):
    assert quality.check(clean_small.withColumn("year", F.lit(9000).cast("long") + F.col("month")))


def test_duplicates(clean_small):
    same = clean_small.unionAll(clean_small.where("borough = 'Dunmore'"))
    other = same.unionAll(
        clean_small.where("borough = 'Dunmore'").withColumn("total_crimes", F.lit(7.0))
    )
    report = by_rule(quality.quality_report(other))
    assert report["unique_keys"]["observed"] == 2
    assert report["total_duplicates"]["observed"] == 1
    assert quality.surplus_copies(other).first()[0] == 1
    assert quality.surplus_copies(other, FactSpec().keys).first()[0] == 2
    with pytest.raises(quality.QualityError, match="unique_keys"):
        quality.check(other)


def test_raw_report_never_raises(raw_dirty):
    report = quality.quality_report(raw_dirty, "raw")
    quality.enforce(report)
    found = by_rule(report)
    assert found["month_range"]["observed"] == 1
    assert found["no_negatives"]["observed"] == 1
    assert found["nulls_borough"]["observed"] == 1
    assert found["total_rows"]["detail"] == "6"
    assert found["year_span"]["detail"] == "2011-2014"
    missing = by_rule(quality.quality_report(raw_dirty.drop("value"), "raw"))
    assert missing["required_columns"]["detail"] == "value"


def test_counts(spark, raw_dirty):
    df = raw_dirty.unionAll(raw_dirty.limit(0))
    nulls = quality.null_counts(df.withColumn("lsoa_code", F.lit("n/a"))).first()
    assert (nulls["borough"], nulls["minor_category"], nulls["lsoa_code"]) == (1, 1, 6)
    critical = quality.critical_nulls(df).first()
    assert (critical["nulls_borough"], critical["nulls_major_category"]) == (1, 1)
    found = quality.range_violations(df).first().asDict()
    assert found == {
        "bad_months": 1, "bad_years": 0, "negatives": 1, "null_measures": 0, "fractional": 0,
        "year_min": 2011, "year_max": 2014,
    }


def test_completeness(spark, clean_small):
    assert quality.completeness(clean_small).first()[0] == 100.0
    assert quality.completeness(clean_small.where("false")).first()[0] == 100.0
    holes = clean_small.withColumn("year", F.when(F.col("borough") == "Dunmore", F.col("year")))
    assert quality.completeness(holes).first()[0] == pytest.approx(100 * 10 / 12)


def test_report_lines(clean_small):
    bad = clean_small.withColumn("month", F.lit(13).cast("long"))
    report = quality.quality_report(bad)
    lines = [r[0] for r in quality.report_lines(report, "2024-01-01").collect()]
    assert lines[0] == "# rules checked at 2024-01-01"
    assert {"ok required_columns", "found 3 in month_range", "info total_rows is 3"} <= set(lines)


def test_empty_table(clean_small):
    report = by_rule(quality.quality_report(clean_small.where("false")))
    assert all(r["passed"] for r in report.values())
    assert report["total_rows"]["detail"] == "0"
    assert report["year_span"]["detail"] == ""
