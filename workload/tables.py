"""The given tables as fact tables, scored rows and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factmill import FactSpec

# the given tables hold years 1995 to 2001
SPEC = FactSpec(year_min=1990, year_max=2026)
YEARS = list(range(1995, 2002))  # as the SQL side has to name them
TRAIN_UNTIL = 1999


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _star(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the nation of their supplier and the kind of their part.

    No join is hinted: the optimizer broadcasts a side only if its size allows. The
    lines come first, so a side's size is known and not guessed from another join.
    """
    lines = table(spark, folder, "lineitem")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return _star(spark, folder).select(
        F.col("n_name").alias("borough"),
        F.col("p_type").alias("major_category"),
        F.col("p_brand").alias("minor_category"),
        F.year("l_shipdate").cast("bigint").alias("year"),
        F.month("l_shipdate").cast("bigint").alias("month"),
        F.col("l_quantity").alias("value"),
        F.col("l_suppkey").cast("string").alias("lsoa_code"),
    )


def dirty_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts with faults by order number, numbers as text."""

    def each(divisor: int):
        return F.col("l_orderkey") % divisor == 0

    name, kind = F.col("n_name"), F.col("p_type")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    return _star(spark, folder).select(
        F.when(each(97), F.lit(None))
        .when(each(89), "Unknown")
        .when(each(67), F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
        .otherwise(name)
        .alias("Borough"),
        F.when(each(61), F.concat(kind, F.lit("/other of-kind")))
        .otherwise(kind)
        .alias("Major Category"),
        F.when(each(73), F.lit(None))
        .when(each(71), "Unknown")
        .otherwise(F.col("p_brand"))
        .alias("Minor-Category"),
        F.when(~each(59), F.year("l_shipdate").cast("string")).alias("Year"),
        F.when(each(83), "13")
        .when(each(53), F.concat(F.month("l_shipdate").cast("string"), F.lit(".0")))
        .when(each(47), F.concat(F.month("l_shipdate").cast("string"), F.lit(".7")))
        .otherwise(F.month("l_shipdate").cast("string"))
        .alias("Month"),
        F.when(each(79), "-5")
        .when(each(43), F.concat(F.lit(" "), quantity, F.lit("e0 ")))
        .when(each(41), F.concat(quantity, F.lit("d")))
        .otherwise(quantity)
        .alias("Value"),
        F.col("l_suppkey").cast("string").alias("lsoa_code"),
    )


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as scored rows: is the quantity high, judged by the price?"""
    return table(spark, folder, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000.0).alias("score"),
        (F.col("l_extendedprice") / 105000.0 >= 0.35).cast("int").alias("prediction"),
        F.col("l_quantity").alias("actual"),
        (F.col("l_extendedprice") / 1500.0).alias("predicted"),
    )


def run_stages(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    """One row per day (or hour) and kind of event: a run's stage."""
    slot = F.date_trunc("hour", "ts") if hourly else F.to_date("ts")
    return (
        table(spark, folder, "events")
        .groupBy(slot.alias("day"), F.col("event_type").alias("stage"))
        .agg(
            F.round(F.sum("value"), 2).alias("duration_seconds"),
            F.count("*").alias("records_in"),
            F.count_if(F.col("value") > 20).alias("records_out"),
            F.count_if(F.get_json_object("props", "$.k").cast("int") > 90).alias("warned"),
        )
    )


def runs(spark: SparkSession, folder: str, hourly: bool = False) -> DataFrame:
    """Each day (or hour) of events as one run record; its stages are the kinds of event."""
    if hourly:
        stamp = F.date_format("day", "yyyy-MM-dd'T'HH:00:00+00:00")
    else:
        stamp = F.concat(F.col("day").cast("string"), F.lit("T06:00:00+00:00"))
    signup = F.col("stage") == "signup"
    stage = F.struct(
        "stage",
        "duration_seconds",
        # the first stage has no input, as in a run that starts with a scan
        F.when(~signup, F.col("records_in")).alias("records_in"),
        "records_out",
    )
    came, left = F.sum("records_in"), F.sum("records_out")
    return (
        run_stages(spark, folder, hourly)
        .groupBy("day")
        .agg(
            F.lit("1.0").alias("schema_version"),
            stamp.alias("timestamp"),
            (F.dayofmonth("day") % 7 == 0).alias("demo_mode"),
            F.round(F.sum("duration_seconds"), 2).alias("total_duration_seconds"),
            F.sort_array(F.collect_list(stage)).alias("stages"),
            came.alias("records_initial"),
            left.alias("records_final"),
            F.round((F.lit(1.0) - left / came) * 100, 1).alias("reduction_pct"),
            F.round(F.lit(100.0) * left / came, 1).alias("completeness_pct"),
            F.lit(0).cast("bigint").alias("outliers_detected"),
            F.sum("warned").alias("warnings_count"),
            F.lit(None).cast("double").alias("peak_memory_mb"),
            F.lit(None).cast("double").alias("avg_cpu_percent"),
        )
        .drop("day")
    )


def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log lines: errors, sign-ups as warnings, the rest as information."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id"),
        F.date_format("ts", "HH:mm:ss").alias("ts"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias(
            "level"
        ),
        F.concat(kind, F.lit(" by "), F.col("user_id").cast("string")).alias("msg"),
    )
