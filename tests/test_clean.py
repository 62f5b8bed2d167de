import re
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F, types as T

from factmill import FactSpec
from factmill.functions import dates, numbers, text
from factmill.operators import clean

SPEC = FactSpec()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_are_standardised(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Borough Name` int, `Major-Category` int, `A - B` int")
    assert clean.standardize_names(df).columns == ["borough_name", "major_category", "a___b"]


def test_names_that_collide_are_refused(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
        with pytest.raises(ValueError, match="a_b"):
            clean.standardize_names(df)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_tokens_drop_rows(spark):
    df = spark.createDataFrame(
        [("City of London", "Theft", 1.0, 2016, 1), ("NULL", "B", 2.0, 2016, 2),
         ("Unknown", "V", 3.0, 2016, 3), ("x", "V", float("nan"), 2016, 3)],
        "borough string, major_category string, value double, year long, month long",
    )
    assert [r["borough"] for r in clean.drop_missing(df).collect()] == ["City of London"]


def test_tokens_are_compared_before_trimming_and_not_on_minors(spark):
    df = spark.createDataFrame(
        [(" Unknown ", "A", "Unknown", 1, 2016, 1, "x"), ("B", "A", None, 1, 2016, 1, "x")],
        "borough string, major_category string, minor_category string, value long, year long, "
        "month long, lsoa_code string",
    )
    assert rows(clean.clean(df)) == [("Unknown", "A", "Unknown", 2016, 1, 1.0, date(2016, 1, 1))]


@pytest.mark.parametrize(
    "given_text, number, whole",
    [
        ("3.0", 3.0, 3), ("3.7", 3.7, None), ("x", None, None), (" 4 ", 4.0, 4),
        ("1e3", 1000.0, 1000), ("nan", None, None), ("1d", None, None), ("0x1A", None, None),
        ("1_000", None, None), ("", None, None), ("+5", 5.0, 5), ("5.", 5.0, 5), (".5", 0.5, None),
        ("-7\t", -7.0, -7), ("1,000", None, None), ("--1", None, None), (None, None, None),
        ("inf", float("inf"), None), ("\x005", None, None), ("5\x7f", None, None), ("5\u2028", None, None), ("5.0\u2028", None, None), ("12345678901234", 12345678901234.0, 12345678901234),
    ],
)
def test_text_numbers(spark, given_text, number, whole):
    df = spark.createDataFrame([(given_text,)], "t string")
    got = df.select(
        numbers.to_number(F.col("t"), T.StringType()), numbers.to_whole(F.col("t"), T.StringType())
    ).first()
    assert tuple(got) == (number, whole)


def test_fraction_fails_when_strict(spark):
    df = spark.createDataFrame([("3.7",)], "year string")
    with pytest.raises(SparkRuntimeException, match="not a whole number: 3.7"):
        clean.cast_columns(df, FactSpec(strict_whole=True)).collect()
    ok = spark.createDataFrame([("3.0",), (None,), ("x",)], "year string")
    cast = clean.cast_columns(ok, FactSpec(strict_whole=True))
    assert rows(cast) == [(3,), (None,), (None,)]


def test_ranges(spark):
    df = spark.createDataFrame(
        [(1, 1999, 1.0), (1, 2000, 1.0), (13, 2001, 1.0), (0, 2001, 1.0), (12, 2001, -5.0),
         (12, 2001, 0.0), (None, 2001, 1.0), (3, 3000, 1.0), (3, 2001, None)],
        "month long, year long, value double",
    )
    kept = {(1, 2000, 1.0), (12, 2001, 0.0), (None, 2001, 1.0), (3, 2001, None)}
    assert set(rows(clean.keep_ranges(df))) == kept
    dropped = clean.keep_ranges(df, FactSpec(null_measure="drop"))
    assert set(rows(dropped)) == kept - {(3, 2001, None)}


ALPHABET = "abcXYZ 09/-'.,_#()éÉñ中ª\u0000\t\n 　"


@settings(
    max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(ALPHABET, max_size=12), min_size=1, max_size=40))
def test_title_case_and_strip_agree_with_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    t = F.col("t")
    got = df.select("t", text.title_case(t), text.strip_space(t), text.normal_case(t)).collect()
    for value, titled, stripped, normal in got:
        assert titled == value.title()
        assert stripped == value.strip()
        assert normal == value.strip().title()


def test_text_samples(spark):
    samples = {
        "  city of london  ": "City of London",
        "KENSINGTON AND CHELSEA": "Kensington and Chelsea",
        "theft/taking OF motor-vehicle children's 4x4": "Theft/Taking Of Motor-Vehicle Children'S 4X4",
        "\trichmond upon thames\n": "Richmond Upon Thames",
        "a\u0000 b": "A\u0000 B",
    }
    df = spark.createDataFrame([(k,) for k in samples], "borough string")
    got = [r[0] for r in clean.normalize_text(df).collect()]
    assert got == list(samples.values())


def test_corrections_from_a_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "borough string")
    table = spark.createDataFrame([("a", "x"), ("a", "y")], "old string, new string")
    got = clean.correct_from_table(df, "borough", table)
    assert rows(got) == rows(spark.createDataFrame([("x",), ("b",), (None,), ("x",)], "b string"))


def test_a_hot_spelling_is_split(spark):
    """With broadcasts off the join that corrects a hot district is a split one."""
    hot = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in hot}
    for key, value in hot.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 60000, 1, 6).selectExpr(
            "IF(id % 5 < 4, 'hot', concat('d', id)) AS borough", "md5(string(id)) AS rest"
        )
        table = spark.range(2000).selectExpr("concat('d', id) AS old", "concat('n', id) AS new")
        table = table.unionAll(spark.range(1).selectExpr("'hot'", "'cold'"))
        fixed = clean.correct_from_table(df, "borough", table)
        assert fixed.where("borough = 'cold'").count() == 48000
        fixed.write.format("noop").mode("overwrite").save()
        fixed.collect()
        plan = fixed._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_only_whole_copies_are_dropped(spark):
    df = spark.createDataFrame(
        [("A", "X", "foo", None), ("A", "X", "foo", None), ("A", "X", "bar", 1)],
        "borough string, major_category string, minor_category string, value long",
    )
    assert clean.drop_copies(df).count() == 2
    assert clean.drop_copies(df, FactSpec(dedup="none")).count() == 3


def test_copies_after_normalisation_count_once(spark):
    df = spark.createDataFrame(
        [(" camden", "a", "m", 4, 2016, 1), ("Camden ", "A", "M", 4, 2016, 1)],
        "borough string, major_category string, minor_category string, value long, year long, month long",
    )
    assert rows(clean.clean(df)) == [("Camden", "A", "M", 2016, 1, 4.0, date(2016, 1, 1))]
    both = clean.clean(df, FactSpec(dedup="none"))
    assert both.first()["total_crimes"] == 8.0


def test_group_without_measure_totals_zero(spark):
    df = spark.createDataFrame(
        [("A", "B", "C", 2016, 1, float("nan")), ("A", "B", "C", 2016, 1, None),
         ("A", "B", None, 2016, 1, 3.0)],
        "borough string, major_category string, minor_category string, year long, month long, value double",
    )
    assert rows(clean.total_by_keys(df)) == [("A", "B", "C", 2016, 1, 0.0)]
    assert clean.total_by_keys(df.drop("month")).columns == df.drop("month").columns


def test_dates(spark):
    df = spark.createDataFrame(
        [(2016, 1), (2015, 12), (2015, 13), (None, 1), (2016, None)], "year long, month long"
    )
    got = [r["date"] for r in clean.add_date(df).collect()]
    assert got == [date(2016, 1, 1), date(2015, 12, 1), None, None, None]
    keys = [r[0] for r in df.select(dates.month_key(F.col("year"), F.col("month"))).collect()]
    assert keys == ["2016-01", "2015-12", "2015-13", None, None]


def test_keep_columns_in_table_order(spark, clean_small):
    extra = clean_small.withColumn("trash", F.lit("x")).withColumn("lsoa_code", F.lit("E"))
    assert clean.keep_columns(extra).columns == clean_small.columns


def test_full_chain(raw_dirty):
    assert rows(clean.clean(raw_dirty)) == [
        ("Dunmore", "Road Works", "Potholes", 2011, 4, 0.0, date(2011, 4, 1)),
        ("Eastley", "Road Works", "Resurfacing", 2011, 4, 7.0, date(2011, 4, 1)),
        ("Fernhill", "Road Works", "Resurfacing", 2011, 4, 7.0, date(2011, 4, 1)),
    ]


def test_chain_without_all_keys_returns_rows(spark):
    df = spark.createDataFrame([("a", 3), ("A", 3), (None, 3)], "Borough string, value long")
    assert rows(clean.clean(df)) == [("A",)]


def test_cleaning_does_not_depend_on_partitions(spark, raw_dirty):
    big = raw_dirty.crossJoin(spark.range(50).withColumnRenamed("id", "copy"))
    expected = rows(clean.clean(big))
    for parts in (1, 7, 64):
        assert rows(clean.clean(big.repartition(parts))) == expected


def test_totals_add_up_to_the_surviving_measures(spark, raw_dirty):
    big = raw_dirty.crossJoin(spark.range(30).withColumnRenamed("id", "copy"))
    kept = clean.drop_copies(clean.clean_rows(big)).where("minor_category IS NOT NULL")
    total = clean.clean(big).agg(F.sum("total_crimes")).first()[0]
    assert total == kept.agg(F.sum("value")).first()[0]


def test_cleaning_its_own_output_changes_nothing(raw_dirty):
    once = clean.clean(raw_dirty)
    again = clean.clean(once.withColumnRenamed("total_crimes", "value"))
    assert rows(again) == rows(once)


def test_hot_key_and_hot_copies(spark):
    # a third of the rows are copies of one row, a third more share its key
    df = spark.range(3000).selectExpr(
        "'Camden' AS borough", "'Theft' AS major_category",
        "IF(id % 3 < 2, 'Bicycle', concat('M', id)) AS minor_category",
        "IF(id % 3 = 0, 7D, double(id % 5)) AS value", "2016L AS year", "1L AS month",
        "IF(id % 3 = 0, 'E1', concat('E', id)) AS lsoa_code",
    )
    got = {r["minor_category"]: r["total_crimes"] for r in clean.clean(df).collect()}
    assert len(got) == 1001
    assert got["Bicycle"] == 7 + sum(i % 5 for i in range(3000) if i % 3 == 1)


def test_empty_table(spark, raw_dirty):
    assert clean.clean(raw_dirty.where(F.lit(False))).collect() == []


def test_step_counts(spark, raw_dirty):
    again = raw_dirty.unionAll(raw_dirty.where("borough = 'Dunmore'")).unionAll(
        raw_dirty.where("borough = 'Dunmore'").withColumns(
            {"minor_category": F.lit(None).cast("string")}
        )
    ).unionAll(raw_dirty.where("borough = 'Dunmore'").withColumn("lsoa_code", F.lit("E2")))
    got = {r["step"]: (r["rows_in"], r["rows_out"], r["rows_removed"])
           for r in clean.step_counts(again).collect()}
    assert got == {
        "missing": (9, 7, 2), "month": (7, 6, 1), "year": (6, 6, 0), "measure": (6, 6, 0),
        "copies": (6, 5, 1), "null_key": (5, 4, 1), "merged": (4, 3, 1),
    }
    assert clean.clean(again).count() == 3


def test_cleaning_of_made_columns_is_compiled(spark):
    """The JVM leaves methods above 8,000 bytes uncompiled, which made the dirty table's rows slow."""
    from workload import tables

    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")  # an adaptive plan has no code before it runs
    try:
        lines = clean.clean(tables.dirty_facts(spark, "/root/testdata/sf0.001"), tables.SPEC)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        shown = lines._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set(adaptive, before)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000
