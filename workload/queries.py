"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from factmill import fixed_values as fixed
from factmill.functions import dates, numbers, text
from factmill.operators import (
    aggregate,
    clean,
    evaluate,
    features,
    models,
    outliers,
    quality,
    ranked,
    runlog,
)
from factmill.plans.dashboard import TAGS, dashboard
from factmill.plans.etl import publish_run, run_etl
from factmill.plans.refresh import read_refreshed, refresh_totals
from factmill.plans.training import train_and_evaluate
from factmill.session import settle, settled_folder
from factmill.sources import dimensions, readers, sample, writers
from factmill.streaming import rows as stream_rows
from factmill.streaming import totals as stream_totals
from workload import tables
from workload.tables import SPEC, TRAIN_UNTIL

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# choices used by the filtered queries
DISTRICT, MAJOR, YEAR = "Nation_7", "Economy", 1997
NEW_NAMES = {"Nation_3": "Third Nation", "Nation_11": "Nation_12", "Unknown": "Elsewhere"}
INFINITE_SHARES = (0.02, 0.25, 0.5, 0.75, 0.98)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean(tables.facts(spark, folder), SPEC)


def settled_totals(spark: SparkSession, folder: str) -> DataFrame:
    return settle(totals(spark, folder), "totals")


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return clean.standardize_names(tables.dirty_facts(spark, folder))


# --- cleaning ---------------------------------------------------------------


@query
def standard_names(spark, folder):
    return clean.standardize_names(tables.dirty_facts(spark, folder))


@query
def clean_null_tokens(spark, folder):
    return clean.drop_missing(raw(spark, folder), SPEC)


@query
def clean_cast(spark, folder):
    return clean.cast_columns(raw(spark, folder), SPEC)


@query
def clean_ranges(spark, folder):
    return clean.keep_ranges(clean.cast_columns(raw(spark, folder), SPEC), SPEC)


@query
def clean_ranges_drop_null(spark, folder):
    spec = SPEC.but(null_measure="drop")
    return clean.keep_ranges(clean.cast_columns(raw(spark, folder), spec), spec)


@query
def clean_text(spark, folder):
    return clean.normalize_text(raw(spark, folder), SPEC)


@query
def correct_spellings(spark, folder):
    """District spellings replaced by a table: nation names by their region's."""
    nations = tables.table(spark, folder, "nation")
    regions = tables.table(spark, folder, "region")
    pairs = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("old"), F.col("r_name").alias("new")
    )
    corrected = clean.correct_from_table(raw(spark, folder), "borough", pairs)
    return corrected.groupBy("borough").agg(F.count("*").alias("n_rows"))


@query
def corrected_names(spark, folder):
    """District spellings replaced by a small map, which some names match."""
    spec = SPEC.but(corrections=NEW_NAMES)
    named = clean.normalize_text(raw(spark, folder), spec)
    return named.groupBy("borough").agg(F.count("*").alias("n_rows"))


@query
def dedup_exact(spark, folder):
    return clean.drop_copies(tables.facts(spark, folder), SPEC)


@query
def agg_facts(spark, folder):
    return clean.total_by_keys(tables.facts(spark, folder), SPEC)


@query
def clean_full(spark, folder):
    return clean.clean(tables.dirty_facts(spark, folder), SPEC)


@query
def clean_full_keep_copies(spark, folder):
    return clean.clean(tables.dirty_facts(spark, folder), SPEC.but(dedup="none"))


@query
def date_from_parts(spark, folder):
    cast = clean.cast_columns(raw(spark, folder), SPEC)
    return clean.add_date(cast, SPEC).select("year", "month", "date")


@query
def keep_columns(spark, folder):
    renamed = clean.rename_columns(tables.facts(spark, folder), {"value": "total_crimes"})
    return clean.keep_columns(renamed, SPEC)


@query
def rows_removed(spark, folder):
    return clean.step_counts(tables.dirty_facts(spark, folder), SPEC)


# --- totals, lists and pages ------------------------------------------------


@query
def sum_by_district(spark, folder):
    return aggregate.ranking(totals(spark, folder), "borough", spec=SPEC)


@query
def sum_by_major(spark, folder):
    return aggregate.ranking(totals(spark, folder), "major_category", spec=SPEC)


@query
def sum_by_minor(spark, folder):
    return aggregate.total_by(totals(spark, folder), "minor_category", spec=SPEC)


@query
def trend_monthly(spark, folder):
    return aggregate.monthly_trend(totals(spark, folder), SPEC)


@query
def matrix_district_year(spark, folder):
    return aggregate.matrix(totals(spark, folder), "borough", "year", spec=SPEC)


@query
def matrix_district_year_map(spark, folder):
    cells = aggregate.matrix_map(totals(spark, folder), "borough", "year", SPEC)
    return cells.select("borough", F.explode("totals").alias("year", "total_crimes"))


@query
def grand_total(spark, folder):
    return aggregate.grand_total(totals(spark, folder), SPEC)


@query
def distinct_values(spark, folder):
    return aggregate.distinct_lists(totals(spark, folder), "borough", "major_category", "year")


@query
def distinct_counts(spark, folder):
    return aggregate.distinct_counts(totals(spark, folder), "borough", "major_category")


@query
def year_span(spark, folder):
    return aggregate.year_span(totals(spark, folder), SPEC)


@query
def leader_district(spark, folder):
    return aggregate.leader(totals(spark, folder), "borough", SPEC)


@query
def leader_major(spark, folder):
    return aggregate.leader(totals(spark, folder), "major_category", SPEC)


def _filtered(spark, folder):
    return aggregate.filter_facts(totals(spark, folder), DISTRICT, MAJOR, YEAR, SPEC)


@query
def filtered_rows(spark, folder):
    return _filtered(spark, folder)


@query
def filtered_total(spark, folder):
    return aggregate.grand_total(_filtered(spark, folder), SPEC)


@query
def minor_given_major(spark, folder):
    return aggregate.minors_of(totals(spark, folder), MAJOR, SPEC)


@query
def top10_minor(spark, folder):
    return aggregate.ranking(totals(spark, folder), "minor_category", 10, SPEC)


@query
def page_slice(spark, folder):
    return aggregate.page(totals(spark, folder), SPEC.keys, 3, fixed.PAGE_ROWS[2])


@query
def page_after(spark, folder):
    last = {
        "borough": "Nation_20",
        "major_category": "Medium",
        "minor_category": "Brand#11",
        "year": 1998,
        "month": 6,
    }
    return aggregate.page_after(totals(spark, folder), last, SPEC.keys, fixed.PAGE_ROWS[0])


@query
def display_rows(spark, folder):
    return aggregate.display(clean.cast_columns(raw(spark, folder), SPEC))


@query
def grouped_numbers(spark, folder):
    by_year = aggregate.total_by(totals(spark, folder), "year", spec=SPEC)
    return by_year.select("year", numbers.grouped(F.col("total_crimes")).alias("shown"))


@query
def row_cap_ordered(spark, folder):
    path = f"{folder}/lineitem.parquet"
    columns = spark.read.parquet(path).columns
    return readers.scan(spark, path, row_cap=5000, cap_order=columns)


@query
def row_cap(spark, folder):
    return readers.scan(spark, f"{folder}/lineitem.parquet", row_cap=4321)


@query
def export_filtered(spark, folder):
    return aggregate.export_rows(_filtered(spark, folder), SPEC)


@query
def export_complete(spark, folder):
    return aggregate.export_rows(totals(spark, folder), SPEC)


@query
def export_aggregated(spark, folder):
    return aggregate.summary_union(totals(spark, folder), TAGS, spec=SPEC)


# --- quality ----------------------------------------------------------------


@query
def null_counts(spark, folder):
    return quality.null_counts(raw(spark, folder), spec=SPEC)


@query
def critical_nulls(spark, folder):
    return quality.critical_nulls(raw(spark, folder), SPEC)


@query
def completeness(spark, folder):
    cast = clean.cast_columns(raw(spark, folder), SPEC)
    return quality.completeness(cast.withColumnRenamed("value", "total_crimes"), SPEC).select(
        F.round("completeness_pct", 6).alias("completeness_pct")
    )


@query
def dup_surplus(spark, folder):
    return quality.surplus_copies(tables.facts(spark, folder))


@query
def key_dup_surplus(spark, folder):
    return quality.surplus_copies(tables.facts(spark, folder), SPEC.keys)


@query
def range_violations(spark, folder):
    return quality.range_violations(raw(spark, folder), SPEC)


@query
def quality_report(spark, folder):
    return quality.quality_report(totals(spark, folder), "processed", SPEC)


@query
def quality_report_faulty(spark, folder):
    """The processed rules on rows that were cast and dated but not filtered."""
    rows = clean.add_date(clean.cast_columns(raw(spark, folder), SPEC), SPEC)
    renamed = rows.withColumnRenamed("value", "total_crimes")
    return quality.quality_report(clean.keep_columns(renamed, SPEC), "processed", SPEC)


@query
def quality_report_raw(spark, folder):
    cast = clean.cast_columns(raw(spark, folder), SPEC)
    return quality.quality_report(cast, "raw", SPEC)


@query
def quality_report_short(spark, folder):
    """The processed rules on totals without a date, the year being text."""
    short = totals(spark, folder).drop("date", "total_crimes")
    return quality.quality_report(
        short.withColumn("month", F.col("month").cast("string")), "processed", SPEC
    )


@query
def outliers_without_totals(spark, folder):
    """Nothing to flag: the finding has all its columns, and no row is an outlier."""
    rows = tables.facts(spark, folder)
    flagged = outliers.flag_outliers(rows, "iqr", SPEC).agg(F.count("*")).scalar()
    return outliers.outlier_summary(rows, "iqr", SPEC).withColumn("n_flagged", flagged)


@query
def validation_lines(spark, folder):
    report = quality.quality_report(totals(spark, folder), "processed", SPEC)
    return quality.report_lines(report, "2024-01-31 06:00:00").select(
        F.col("value").alias("line")
    )


# --- outliers ---------------------------------------------------------------


@query
def quantiles(spark, folder):
    shares = [*SPEC.report_quantiles, *SPEC.quartiles, 0.5]
    found = ranked.exact_quantiles(totals(spark, folder), "total_crimes", shares)
    return found.select(
        "n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"]
    )


@query
def price_quantiles(spark, folder):
    """Quantiles of a column with many distinct values, cut into value ranges."""
    lines = tables.table(spark, folder, "lineitem")
    found = ranked.exact_quantiles(lines, "l_extendedprice", [0.05, 0.5, 0.95], 5000)
    return found.select(
        "n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"]
    )


@query
def quantiles_infinite(spark, folder):
    """Quantiles of values of which some are infinite, as one range and as many."""
    price = F.col("l_extendedprice")
    some = (
        F.when(F.col("l_orderkey") % 10 == 0, F.lit(float("inf")))
        .when(F.col("l_orderkey") % 10 == 1, F.lit(float("-inf")))
        .otherwise(price)
    )
    values = tables.table(spark, folder, "lineitem").select(some.alias("x"))
    counts = ranked.value_counts(values, "x")
    whole = ranked.quantiles_of_counts(counts, INFINITE_SHARES)
    cut = ranked.quantiles_of_counts(counts, INFINITE_SHARES, 3000)
    return whole.withColumn("ranges", F.lit("one")).unionByName(
        cut.withColumn("ranges", F.lit("many"))
    )


@query
def mean_and_spread(spark, folder):
    found = outliers.spread(totals(spark, folder), "total_crimes")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query
def outliers_iqr(spark, folder):
    return outliers.outlier_rows(settled_totals(spark, folder), "iqr", SPEC)


@query
def outliers_zscore(spark, folder):
    return outliers.outlier_rows(settled_totals(spark, folder), "zscore", SPEC)


def _rounded_summary(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("q05", "q95")})


@query
def outlier_summary(spark, folder):
    return _rounded_summary(outliers.outlier_summary(totals(spark, folder), "iqr", SPEC))


@query
def outlier_summary_zscore(spark, folder):
    return _rounded_summary(outliers.outlier_summary(totals(spark, folder), "zscore", SPEC))


# --- features and measures --------------------------------------------------


@query
def target_median(spark, folder):
    return features.add_target(settled_totals(spark, folder), "median", spec=SPEC)


@query
def target_mean(spark, folder):
    return features.add_target(settled_totals(spark, folder), "mean", spec=SPEC)


@query
def target_from_train(spark, folder):
    source = settled_totals(spark, folder)
    train, _ = features.temporal_split(source, TRAIN_UNTIL, spec=SPEC)
    return features.add_target(source, "median", train, SPEC)


@query
def feature_columns(spark, folder):
    found = features.feature_columns(totals(spark, folder), SPEC)
    return found.withColumns({c: F.round(c, 6) for c in ("month_sin", "month_cos")})


@query
def cyclical_month(spark, folder):
    turned = features.cyclical_month(totals(spark, folder), SPEC)
    return turned.select(
        "year",
        "month",
        F.round("month_sin", 6).alias("month_sin"),
        F.round("month_cos", 6).alias("month_cos"),
    )


@query
def standard_scale(spark, folder):
    scaled = features.standard_scale(
        features.cyclical_month(settled_totals(spark, folder), SPEC), "year", "month_sin"
    )
    return scaled.select(
        *SPEC.keys,
        F.round("year_scaled", 5).alias("year_scaled"),
        F.round("month_sin_scaled", 5).alias("month_sin_scaled"),
    )


def _split_counts(source: DataFrame, until: int) -> DataFrame:
    train, test = features.temporal_split(source, until, spec=SPEC)
    sides = [
        side.agg(F.lit(name).alias("side"), F.count("*").alias("n_rows"))
        for name, side in (("train", train), ("test", test))
    ]
    return sides[0].unionAll(sides[1])


@query
def temporal_split_counts(spark, folder):
    return _split_counts(settled_totals(spark, folder), TRAIN_UNTIL)


@query
def fallback_split_counts(spark, folder):
    """No year is early enough, so rows are split by their hash."""
    return _split_counts(settled_totals(spark, folder), 1900)


def _slots(encoded: DataFrame) -> list:
    """How many slots of each dimension a row fills."""
    return [
        F.aggregate(vector_to_array(f"{c}_slots"), F.lit(0.0), lambda a, x: a + x)
        .cast("int")
        .alias(f"slots_{c}")
        for c in SPEC.dims
    ]


@query
def onehot_width(spark, folder):
    """Width of the feature vector, and how many slots the later rows fill."""
    source = settled_totals(spark, folder)
    train, test = features.temporal_split(source, TRAIN_UNTIL, spec=SPEC)
    encoded = features.encoder(train, SPEC).fit(train).transform(test)
    filled = sum(F.col(f"slots_{c}") for c in SPEC.dims)
    return encoded.select(*_slots(encoded)).agg(
        F.lit(features.feature_width(encoded)).cast("bigint").alias("width"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(filled), F.lit(0)).cast("bigint").alias("n_filled"),
    )


@query
def onehot_slots(spark, folder):
    """Slots that each row of the dirty table's totals fills, by the facts' encoder."""
    train = settled_totals(spark, folder)
    rows = settle(clean.clean(tables.dirty_facts(spark, folder), SPEC), "rows")
    encoded = features.encoder(train, SPEC).fit(train).transform(rows)
    return encoded.select(*SPEC.keys, *_slots(encoded))


@query
def classifier_optimum(spark, folder):
    """Gradient of the penalised loss at the fitted weights: zero for every feature."""
    labelled = settle(features.add_target(totals(spark, folder), spec=SPEC), "labelled")
    encoded = features.encoder(labelled, SPEC).fit(labelled).transform(labelled)
    encoded = settle(encoded.select(features.FEATURES, features.LABEL), "encoded")
    rows = encoded.count()
    fitted = models.train_classifier(encoded, rows)
    scored = fitted.transform(encoded).select(
        (models.probability_of("probability", 1) - F.col(features.LABEL)).alias("error"),
        F.posexplode(vector_to_array(features.FEATURES)).alias("feature", "x"),
    )
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients])
    slope = F.avg(F.col("error") * F.col("x")) + F.get(weights, F.col("feature")) / F.lit(rows)
    return scored.groupBy("feature").agg(F.round(F.abs(slope), 4).alias("gradient"))


@query
def confusion(spark, folder):
    return evaluate.confusion(tables.scored_lines(spark, folder))


@query
def class_metrics(spark, folder):
    return evaluate.class_metrics(evaluate.confusion(tables.scored_lines(spark, folder)))


@query
def reg_metrics(spark, folder):
    return evaluate.regression_metrics(
        tables.scored_lines(spark, folder), "actual", "predicted"
    )


@query
def auc_gini(spark, folder):
    return evaluate.roc_auc(evaluate.score_totals(tables.scored_lines(spark, folder)))


@query
def roc_points(spark, folder):
    scores = evaluate.score_totals(tables.scored_lines(spark, folder), following=True)
    return evaluate.roc_points(settle(scores, "scores")).select("fpr", "tpr")


def _trained(spark, folder, store=None):
    return train_and_evaluate(totals(spark, folder), TRAIN_UNTIL, folder=store, spec=SPEC)


@query
def train_eval(spark, folder):
    """Row counts of a training run, and whether its measures are those of its scored rows."""
    found = _trained(spark, folder)
    metrics = found.metrics.select(F.struct("*").alias("m")).scalar()
    label, guess = F.col(features.LABEL), F.col("prediction")
    actual, predicted = F.col(SPEC.total), F.col("predicted")

    def close(name: str, value) -> list:
        return F.abs(metrics[name] - F.coalesce(value, F.lit(0.0))) <= 6e-5

    hits = F.count_if((label == 1) & (guess == 1)).cast("double")
    mean = found.scored.agg(F.avg(actual)).scalar()
    limits = found.totals.where(F.col("year") <= TRAIN_UNTIL)
    low, high = (limits.agg(f(SPEC.total)).scalar() for f in (F.min, F.max))
    return found.scored.agg(
        metrics["train_rows"].alias("train_rows"),
        metrics["test_rows"].alias("test_rows"),
        F.count("*").alias("scored_rows"),
        sum(
            metrics[c]
            for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
        ).alias("confused_rows"),
        close("accuracy", F.avg((label == guess).cast("double"))).alias("accuracy_holds"),
        close("precision", F.try_divide(hits, F.count_if(guess == 1))).alias("precision_holds"),
        close("recall", F.try_divide(hits, F.count_if(label == 1))).alias("recall_holds"),
        close("mae", F.avg(F.abs(actual - predicted))).alias("mae_holds"),
        close(
            "r2",
            1 - F.avg((actual - predicted) ** 2) / F.avg((actual - mean) * (actual - mean)),
        ).alias("r2_holds"),
        F.bool_and(predicted.between(low, high)).alias("forest_in_range"),
    )


@query
def score_batch(spark, folder):
    """Every combination in the facts, scored by models stored and loaded again."""
    store = _fresh_folder(spark)
    _trained(spark, folder, store)
    rows = tables.facts(spark, folder).select(*SPEC.keys).distinct()
    scored = models.score(rows, models.load_models(spark, store), spec=SPEC)
    high = F.col("probability_high")
    return scored.select(
        *SPEC.keys,
        (F.abs(high + F.col("probability_low") - 1) < 2e-4).alias("sums_to_one"),
        ((high >= F.col("threshold")) == (F.col("prediction") == 1))
        .__or__(F.abs(high - F.col("threshold")) < 1e-4)
        .alias("class_fits"),
        (F.col("predicted_crimes") == numbers.half_even(F.col("predicted_crimes_raw"), 0))
        .__or__(F.abs(F.col("predicted_crimes_raw") % 1 - 0.5) < 0.006)
        .alias("estimate_fits"),
        "features_used",
    )


@query
def metrics_document(spark, folder):
    """The metrics that a training run stores, read again."""
    store = _fresh_folder(spark)
    _trained(spark, folder, store)
    return spark.read.json(f"{store}/metrics").select(
        "model",
        "train_rows",
        "test_rows",
        "schema_version",
        F.col("hyperparameters.forest_trees").alias("forest_trees"),
        F.col("hyperparameters.train_until").alias("train_until"),
    )


# --- sample table -----------------------------------------------------------


@query
def sample_facts(spark, folder):
    """A generated row per order, from the nations and part kinds in the tables."""
    orders = tables.table(spark, folder, "orders")
    districts = sample.value_pool(tables.table(spark, folder, "nation"), "n_name")
    parts = tables.table(spark, folder, "part")
    pool = sample.category_pool(parts, "p_type", "p_brand")
    made = sample.sample_facts(orders, "o_orderkey", districts, pool)
    return sample.inject_errors(made, every=1000)


# --- sources and sinks ------------------------------------------------------


def _fresh_folder(spark) -> str:
    return f"{settled_folder(spark)}/trip-{uuid.uuid4().hex}"


@query
def etl_run(spark, folder):
    """A whole run over the dirty rows; the totals as it stored them."""
    dirty = tables.dirty_facts(spark, folder)
    return run_etl(spark, _fresh_folder(spark), dirty, spec=SPEC).totals


@query
def csv_round_trip(spark, folder):
    """The strict sink's CSV, read back with the known schema."""
    paths = writers.save_strict(totals(spark, folder), _fresh_folder(spark), "totals", SPEC)
    return readers.read_totals(spark, paths["csv"], SPEC)


@query
def export_round_trip(spark, folder):
    """The quoted export, read back as text."""
    export = aggregate.export_rows(totals(spark, folder), SPEC)
    path = writers.export_csv(export, _fresh_folder(spark))
    schema = ", ".join(f"`{c}` string" for c in export.columns)
    return spark.read.schema(schema).csv(path, header=True, escape='"').na.fill("")


@query
def validated_round_trip(spark, folder):
    """The validated snapshot, read back."""
    paths = writers.save_validated(totals(spark, folder), _fresh_folder(spark), "totals")
    return spark.read.parquet(paths["parquet"])


@query
def validated_report(spark, folder):
    """The text report beside a validated snapshot, read back."""
    stamp = "2024-01-31 06:00:00"
    paths = writers.save_validated(
        totals(spark, folder), _fresh_folder(spark), "totals", "report", "processed", stamp, SPEC
    )
    return spark.read.text(paths["validation_report"]).select(F.col("value").alias("line"))


@query
def etl_record(spark, folder):
    """The record of a whole run over the dirty rows, read back from its log."""
    out = _fresh_folder(spark)
    run_etl(spark, out, tables.dirty_facts(spark, folder), spec=SPEC)
    return runlog.read_runs(spark, f"{out}/metrics/runs").select(
        "schema_version", "demo_mode", "records_initial", "records_final", "completeness_pct",
        "outliers_detected", "warnings_count", F.array_join("stages.stage", ",").alias("stages"),
    )


@query
def published_stats(spark, folder):
    """The statistics that the dashboard reads after a run over the dirty rows."""
    out = _fresh_folder(spark)
    run_etl(spark, out, tables.dirty_facts(spark, folder), spec=SPEC)
    publish_run(spark, out)
    stats = spark.read.schema("stage string, records string, records_out string")
    return stats.json(f"{out}/metrics/statistics")


@query
def json_dimensions(spark, folder):
    """Nations and part kinds written as JSON documents and read as dimensions."""
    out = _fresh_folder(spark)
    names = tables.table(spark, folder, "nation").agg(F.to_json(F.collect_set("n_name")))
    parts = tables.table(spark, folder, "part").groupBy("p_type")
    kinds = parts.agg(F.collect_set("p_brand").alias("minors"))
    entries = F.map_from_entries(F.collect_list(F.struct("p_type", "minors")))
    names.write.text(f"{out}/names")
    kinds.agg(F.to_json(entries)).write.text(f"{out}/kinds")
    districts = dimensions.read_districts(spark, f"{out}/names", "major")
    pairs = dimensions.read_categories(spark, f"{out}/kinds")
    return districts.select("major", F.lit("").alias("minor")).unionByName(pairs)


@query
def run_log_round_trip(spark, folder):
    """Run records appended to the log in two parts and read back."""
    made, log = tables.runs(spark, folder), _fresh_folder(spark)
    early = F.col("timestamp") < "2024-01-16"
    runlog.append_run(made.where(early), log)
    runlog.append_run(made.where(~early), log)
    return runlog.read_runs(spark, log).select(
        "timestamp", "demo_mode", "records_initial", "records_final", F.inline("stages")
    )


@query
def streamed_rows(spark, folder):
    """The row-by-row steps over the raw snapshot read as a stream."""
    trip = _fresh_folder(spark)
    raw_path = writers.save_raw(tables.dirty_facts(spark, folder), trip, "raw")["parquet"]
    schema = spark.read.parquet(raw_path).schema
    cleaned = stream_rows.clean_stream(stream_rows.read_stream(spark, raw_path, schema), SPEC)
    running = stream_rows.append_to(cleaned, f"{trip}/rows", f"{trip}/progress")
    running.awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(f"{trip}/rows")


def _arrivals(spark, folder, trip: str):
    """The dirty rows as files that come one by one; writes the files of one turn."""
    dirty = settle(tables.dirty_facts(spark, folder), "dirty")
    part = F.pmod(F.xxhash64(*dirty.columns), F.lit(3))

    def arrive(*parts: int) -> None:
        for k in parts:
            dirty.where(part == k).write.mode("append").parquet(f"{trip}/raw")

    return dirty.schema, arrive


@query
def streamed_unique_rows(spark, folder):
    """Cleaned rows without copies, from files in three batches of which two come again."""
    trip = _fresh_folder(spark)
    schema, arrive = _arrivals(spark, folder, trip)
    arrive(0, 1, 0, 2, 1)
    arrivals = stream_totals.read_arrivals(spark, f"{trip}/raw", schema, files_per_batch=2)
    unique = stream_totals.unique_stream(clean.clean_rows(arrivals, SPEC), "1 day")
    stream_rows.append_to(unique, f"{trip}/rows", f"{trip}/progress").awaitTermination()
    return spark.read.schema(unique.schema).parquet(f"{trip}/rows")


@query
def streamed_totals(spark, folder):
    """Totals kept by a stream that is stopped and started again, with files that come twice."""
    trip = _fresh_folder(spark)
    schema, arrive = _arrivals(spark, folder, trip)
    arrive(2, 0)
    stream_totals.stream_to_totals(spark, f"{trip}/raw", schema, trip, "1 day", 1, SPEC)
    arrive(2, 1, 0)
    return stream_totals.stream_to_totals(spark, f"{trip}/raw", schema, trip, "1 day", 2, SPEC)


@query
def refreshed_totals(spark, folder):
    """Totals by month after refreshes for the first files, for later years, and for none."""
    trip = _fresh_folder(spark)
    dirty = settle(tables.dirty_facts(spark, folder), "dirty")
    late = F.coalesce(F.col("Year") >= "1998", F.lit(False))
    for rows in (dirty.where(~late), dirty.where(late), None):
        if rows is not None:
            rows.write.mode("append").parquet(f"{trip}/raw")
        refresh_totals(spark, f"{trip}/raw", trip, dirty.schema, SPEC)
    return read_refreshed(spark, trip, SPEC)


# --- run log ----------------------------------------------------------------


@query
def run_latest(spark, folder):
    return runlog.latest_run(tables.runs(spark, folder)).drop(
        "stages", "peak_memory_mb", "avg_cpu_percent"
    )


@query
def run_entries(spark, folder):
    entries = runlog.dashboard_entries(tables.runs(spark, folder))
    return entries.select(
        "run_id",
        "mode",
        "duration_seconds",
        "total_records_in",
        "total_records_out",
        "completeness_pct",
        "warnings_count",
        F.inline("stages"),
    )


@query
def run_history5(spark, folder):
    return runlog.dashboard_entries(runlog.recent_runs(tables.runs(spark, folder))).select(
        "run_id", "mode", "duration_seconds", "total_records_in", "total_records_out"
    )


@query
def run_history_prepend(spark, folder):
    """The first run put in front of the others; the newest few are kept. Days hold
    several runs."""
    entries = settle(
        runlog.dashboard_entries(tables.runs(spark, folder, hourly=True)), "entries"
    )
    first = entries.agg(F.min("timestamp")).scalar()
    added = entries.where(F.col("timestamp") == first)
    older = entries.where(F.col("timestamp") != first)
    kept = runlog.add_to_history(older, added)
    return kept.select("run_id", "timestamp", "duration_seconds")


@query
def run_stage_shares(spark, folder):
    return runlog.stage_shares(runlog.dashboard_entries(tables.runs(spark, folder)))


@query
def run_kpis(spark, folder):
    return runlog.kpis(
        runlog.dashboard_entries(tables.runs(spark, folder)),
        tables.log_entries(spark, folder),
    )


@query
def run_kpis_hourly(spark, folder):
    """The cards of the newest of several runs on one day."""
    return runlog.kpis(
        runlog.dashboard_entries(tables.runs(spark, folder, hourly=True)),
        tables.log_entries(spark, folder),
    )


@query
def dashboard_tables(spark, folder):
    """Rows of every table that the dashboard shows under its filters."""
    shown = dashboard(settled_totals(spark, folder), DISTRICT, MAJOR, YEAR, SPEC)
    counted = [
        frame.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        for name, frame in shown.items()
    ]
    return reduce(DataFrame.unionAll, counted)


@query
def log_errors(spark, folder):
    return runlog.of_level(tables.log_entries(spark, folder), "ERROR")


@query
def log_levels(spark, folder):
    return runlog.level_counts(tables.log_entries(spark, folder))


@query
def sample_rollup(spark, folder):
    samples = tables.table(spark, folder, "events").select(
        "event_type", (F.col("value") - 10).alias("sample")
    )
    found = runlog.sample_rollup(samples, "sample", "event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_positive", "peak")})


@query
def run_stats(spark, folder):
    """Record counts of the newest run put into a table of stages."""
    newest = runlog.dashboard_entries(runlog.latest_run(tables.runs(spark, folder)))
    return runlog.updated_stats(runlog.empty_stats(spark), newest)


@query
def run_stat_of(spark, folder):
    """The statistics of one stage."""
    newest = runlog.dashboard_entries(runlog.latest_run(tables.runs(spark, folder)))
    stats = runlog.updated_stats(runlog.empty_stats(spark), newest)
    return runlog.stat_of(stats, fixed.STAT_RAW)


@query
def run_summary(spark, folder):
    return runlog.summary_lines(tables.runs(spark, folder))


@query
def run_json(spark, folder):
    """Run records written to JSON text and read back with their schema."""
    coded = tables.runs(spark, folder).select(F.to_json(F.struct("*")).alias("line"))
    back = coded.select(F.from_json("line", runlog.RUN_SCHEMA).alias("run")).select("run.*")
    return back.select(
        "timestamp", "demo_mode", "records_initial", "warnings_count",
        F.size("stages").cast("bigint").alias("n_stages"),
    )


@query
def scalar_functions(spark, folder):
    """Text, date and number expressions on the dirty rows, side by side."""
    rows = clean.cast_columns(raw(spark, folder), SPEC)
    return rows.select(
        text.blank(F.col("borough")).alias("blank_borough"),
        text.title_case(text.strip_space(F.col("major_category"))).alias("titled"),
        dates.month_key(F.col("year"), F.col("month")).alias("month_key"),
        dates.iso_day(F.concat(F.lit("2024-02-03T04:05:06"), F.col("lsoa_code"))).alias("day"),
        numbers.at_least_zero(F.col("value")).alias("clamped"),
        numbers.half_even(F.col("value") / 4, 0).alias("half_even"),
        numbers.plain(F.col("value")).alias("plain"),
        numbers.percent(F.col("value"), F.col("month").cast("double")).alias("pct"),
    )
