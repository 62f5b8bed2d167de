"""One ETL run: read, snapshot, clean, check, store, load and log."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from factmill import fixed_values as fixed
from factmill.operators import clean, quality, runlog
from factmill.operators.outliers import outlier_summary
from factmill.session import settle
from factmill.sources import jdbc, readers, writers
from factmill.sources.sample import sample_table
from factmill.spec import DEFAULT_SPEC, FactSpec

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class EtlResult:
    """Where a run left its outputs, and its record."""

    totals: DataFrame
    paths: dict[str, dict[str, str]]
    run: DataFrame
    loaded: bool


def run_etl(
    spark: SparkSession,
    out: str,
    raw: DataFrame | None = None,
    name: str = "facts",
    db_url: str | None = None,
    db_table: str = "facts_aggregated",
    db_mode: str = "replace",
    keep_raw: bool = True,
    load_demo: bool = False,
    spec: FactSpec = DEFAULT_SPEC,
) -> EtlResult:
    """Run the whole chain and return its result. Without ``raw`` the sample table
    is used and the run is marked a demo.

    The raw table is counted while it is written to the snapshot, and cleaned from
    there; with ``keep_raw`` off there is no snapshot, and it is counted while it is
    cleaned. The totals are written once; every later stage scans that output. A
    failing stage raises; only a failed database load is logged and counted as a
    warning. A demo run is not loaded into the database unless ``load_demo`` is set.
    """
    demo = raw is None
    record = runlog.RunLog(demo)
    paths: dict[str, dict[str, str]] = {}

    source = sample_table(spark, spec=spec) if demo else raw
    seen = Observation("raw")
    counted = source.observe(seen, F.count(F.lit(1)).alias("rows"))
    with record.stage(fixed.STAGE_INGEST) as stage:
        if keep_raw:
            paths["raw"] = writers.save_raw(counted, f"{out}/raw", name)
            stage["records_out"] = seen.get["rows"]
            # from the snapshot: the source itself is asked only once
            counted = readers.scan(spark, paths["raw"]["parquet"], schema=source.schema)

    with record.stage(fixed.STAGE_CLEAN) as stage:
        cleaned = clean.clean(counted, spec)
        made = Observation("totals")
        checked = cleaned.observe(made, F.count(F.lit(1)).alias("rows"))
        paths["processed"] = writers.save_processed(
            checked, f"{out}/processed", name, ["parquet"], spec
        )
        totals = spark.read.schema(cleaned.schema).parquet(paths["processed"]["parquet"])
        stage["records_in"] = record.records_initial = seen.get["rows"]
        stage["records_out"] = record.records_final = made.get["rows"]

    with record.stage(fixed.STAGE_VALIDATE):
        quality.check_schema(totals, spec)
        # every rule from one pass; the text report below shows the same findings
        report = settle(quality.quality_report(totals, "processed", spec), "report")
        quality.enforce(report)
        record.completeness_pct = quality.completeness_of(report)
        record.outliers_detected = outlier_summary(totals, spec=spec).first()["n_outliers"]

    with record.stage(fixed.STAGE_SAVE):
        paths["validated"] = writers.save_validated(
            totals,
            f"{out}/validated",
            name,
            "validation_report",
            "processed",
            record.timestamp,
            spec,
            report,
        )
        paths["processed"] |= writers.save_processed(
            totals, f"{out}/processed", name, ["csv"], spec
        )

    loaded = False
    with record.stage(fixed.STAGE_LOAD):
        if demo and db_url and not load_demo:
            log.info("a demo run: the database is left as it is")
        else:
            try:
                loaded = jdbc.load_table(totals, db_url, db_table, db_mode, spec=spec)
            except Exception:
                log.exception("database load failed; the run goes on")
                record.warnings_count += 1

    run = record.frame(spark)
    runlog.append_run(run, f"{out}/metrics/runs")
    return EtlResult(totals, paths, run, loaded)


def publish_run(
    spark: SparkSession, out: str, log_entries: DataFrame | None = None
) -> DataFrame:
    """Write what the dashboard reads of the run log, and return the newest entries.

    These are the entries of the newest runs, the statistics of the stages with the
    newest run's counts, and the cards. ``log_entries`` (``ts, level, msg``) count as
    the log's state; without them it is clean.
    """
    metrics = f"{out}/metrics"
    runs = runlog.read_runs(spark, f"{metrics}/runs")
    entries = settle(runlog.dashboard_entries(runlog.recent_runs(runs)), "entries")
    if log_entries is None:
        log_entries = spark.createDataFrame([], "ts string, level string, msg string")
    newest = runlog.dashboard_entries(runlog.latest_run(runs))
    stats = runlog.updated_stats(runlog.empty_stats(spark), newest)
    for name, table in (
        ("dashboard_runs", entries),
        ("statistics", stats),
        ("cards", runlog.kpis(entries, log_entries)),
    ):
        # a handful of rows each, as one document
        table.coalesce(1).write.mode("overwrite").json(f"{metrics}/{name}")
    return entries
