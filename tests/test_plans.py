import os

import pytest
from pyspark.sql import functions as F

from factmill import FactSpec, __main__ as command
from factmill.operators import aggregate, clean, evaluate, outliers, quality, runlog
from factmill.plans import etl
from factmill.sources import readers
from factmill.streaming import rows as stream_rows

SPEC = FactSpec()


def plan_of(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_demo_run(spark, tmp_path):
    result = etl.run_etl(spark, str(tmp_path))
    run = result.run.first()
    assert run["demo_mode"] and not result.loaded
    assert run["records_initial"] == 150 and run["records_final"] == result.totals.count()
    assert [s["stage"] for s in run["stages"]] == [
        "ingesta", "limpieza", "validacion", "guardado", "carga"]
    assert run["stages"][1]["records_in"] == 150
    assert run["completeness_pct"] == 100.0
    for kind in ("parquet", "csv"):
        assert readers.read_totals(spark, result.paths["processed"][kind]).count() == (
            run["records_final"])
    assert quality.check(result.totals)
    entries = etl.publish_run(spark, str(tmp_path)).collect()
    assert len(entries) == 1 and entries[0]["mode"] == "Demo"


def test_run_on_a_table(spark, raw_dirty, tmp_path):
    result = etl.run_etl(spark, str(tmp_path), raw_dirty)
    assert result.totals.count() == 3 and not result.run.first()["demo_mode"]
    assert spark.read.parquet(result.paths["raw"]["parquet"]).count() == 6


def test_run_without_raw_snapshot(spark, raw_dirty, tmp_path):
    result = etl.run_etl(spark, str(tmp_path), raw_dirty, keep_raw=False)
    run = result.run.first()
    assert "raw" not in result.paths and not os.path.exists(tmp_path / "raw")
    assert (run["records_initial"], run["records_final"]) == (6, 3)
    assert [s["records_in"] for s in run["stages"]][:2] == [None, 6]


def test_failed_load_is_a_warning(spark, raw_dirty, tmp_path):
    result = etl.run_etl(spark, str(tmp_path), raw_dirty, db_url="jdbc:nosuchdriver:x")
    assert not result.loaded and result.run.first()["warnings_count"] == 1


def test_a_demo_run_is_loaded_only_if_asked(spark, raw_dirty, tmp_path, monkeypatch):
    loads = []

    def load(totals, url, table, mode, spec):
        loads.append((url, table, mode))
        return bool(url)

    monkeypatch.setattr(etl.jdbc, "load_table", load)
    assert not etl.run_etl(spark, str(tmp_path / "a"), db_url="jdbc:x").loaded
    assert loads == []
    assert etl.run_etl(spark, str(tmp_path / "b"), db_url="jdbc:x", load_demo=True).loaded
    assert etl.run_etl(spark, str(tmp_path / "c"), raw_dirty, db_url="jdbc:x").loaded
    assert loads == [("jdbc:x", "facts_aggregated", "replace")] * 2


def test_published_documents(spark, tmp_path):
    out = str(tmp_path)
    etl.run_etl(spark, out)
    lines = spark.createDataFrame([("1", "ERROR", "a")], "ts string, level string, msg string")
    (entry,) = etl.publish_run(spark, out, lines).collect()
    stats = {r["stage"]: r for r in spark.read.json(f"{out}/metrics/statistics").collect()}
    assert stats["crudos"]["records"] == f"~{entry['total_records_in']}"
    assert stats["agregacion"]["records_out"] == str(entry["total_records_out"])
    card = spark.read.json(f"{out}/metrics/cards").first()
    assert card["errors"] == 1 and card["stability"] == "Revisar"


def test_bad_table_raises(spark, raw_dirty, tmp_path):
    with pytest.raises(quality.QualityError):
        etl.run_etl(spark, str(tmp_path), raw_dirty.drop("month"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(command, "build_session", lambda: spark)
    out = str(tmp_path)
    command.main(["etl", "--demo", "--out", out])
    assert "RUN SUMMARY" in capsys.readouterr().out
    command.main(["publish", "--out", out, "--dry-run"])
    command.main(["publish", "--out", out])
    assert os.path.isdir(f"{out}/metrics/dashboard_runs")
    with pytest.raises(SystemExit):
        command.main(["etl", "--out", out])


@pytest.fixture
def stored(spark, raw_dirty, tmp_path):
    path = str(tmp_path / "raw.parquet")
    raw_dirty.write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(stored):
    plan = plan_of(clean.clean(stored, FactSpec(year_max=2026)), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for column in ("borough", "major_category", "minor_category", "value", "year", "month"):
        assert f"IsNotNull({column})" in pushed, column
    for bound in ("GreaterThanOrEqual(month,1)", "LessThanOrEqual(year,2026)"):
        assert bound in pushed


def test_totals_read_only_their_columns(stored):
    named = stored.withColumnRenamed("value", "total_crimes")
    plan = plan_of(aggregate.total_by(named, "borough"), "formatted")
    assert "ReadSchema: struct<borough:string,value:bigint>" in plan


def test_dashboard_filter_passes_the_aggregate(stored):
    totals = clean.clean(stored, FactSpec(year_max=2026))
    plan = plan_of(aggregate.filter_facts(totals, year=2016), "formatted")
    assert "EqualTo(year,2016)" in plan


def test_plans_have_no_python_and_no_cross_join(stored):
    totals = clean.clean(stored)
    scored = stored.selectExpr("int(value > 5) AS label", "double(value) AS score")
    frames = [
        totals,
        clean.step_counts(stored),
        aggregate.summary_union(totals, ("a", "b", "c")),
        aggregate.leader(totals, "borough"),
        aggregate.matrix_map(totals, "borough", "year"),
        quality.quality_report(totals),
        outliers.flag_outliers(totals, "iqr"),
        outliers.flag_outliers(totals, "zscore"),
        evaluate.roc_points(evaluate.score_totals(scored, following=True)),
    ]
    for frame in frames:
        plan = plan_of(frame)
        for bad in ("Python", "CartesianProduct", "NestedLoopJoin"):
            assert bad not in plan


def test_whole_chain_is_two_shuffles(stored):
    assert plan_of(clean.clean(stored)).count("Exchange") == 2
    kept = clean.clean(stored, FactSpec(dedup="none"))
    assert plan_of(kept).count("Exchange") == 1


def test_copies_are_combined_before_the_shuffle(stored):
    lines = plan_of(clean.drop_copies(stored)).splitlines()
    kinds = [line.strip(" +-").split("(")[0] for line in lines if "Aggregate" in line or "Exchange" in line]
    assert [k.split(" ")[0] for k in kinds] == ["HashAggregate", "Exchange", "HashAggregate"]


def test_stream_matches_batch(spark, raw_dirty, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw_dirty.repartition(3).write.parquet(source)
    stream = stream_rows.read_stream(spark, source, raw_dirty.schema, files_per_batch=1)
    query = stream_rows.append_to(stream_rows.clean_stream(stream), out, str(tmp_path / "log"))
    query.awaitTermination()
    got = spark.read.parquet(out)
    expected = clean.clean_rows(raw_dirty)
    assert sorted(got.collect()) == sorted(expected.select(*got.columns).collect())


def test_run_log_keeps_rows_apart(spark, tmp_path):
    etl.run_etl(spark, str(tmp_path))
    etl.run_etl(spark, str(tmp_path))
    runs = runlog.read_runs(spark, f"{tmp_path}/metrics/runs")
    assert runs.count() == 2 and runs.agg(F.count_distinct("timestamp")).first()[0] == 2


def test_scored_stream_matches_batch(spark, ml_small, tmp_path):
    from factmill.operators import models
    from factmill.plans.training import train_and_evaluate

    store, source, out = (str(tmp_path / p) for p in ("models", "in", "out"))
    train_and_evaluate(ml_small, trees=3, max_depth=3, folder=store)
    rows = ml_small.select("borough", "major_category", "minor_category", "year", "month")
    rows.write.parquet(source)
    fitted = models.load_models(spark, store)
    stream = stream_rows.read_stream(spark, source, rows.schema, files_per_batch=1)
    scored = stream_rows.score_stream(stream, fitted)
    stream_rows.append_to(scored, out, str(tmp_path / "log")).awaitTermination()
    expected = models.score(rows, fitted)
    got = spark.read.schema(expected.schema).parquet(out)
    assert sorted(got.collect()) == sorted(expected.collect())
