import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill import FactSpec, fixed_values as fixed
from factmill.operators import aggregate, clean
from factmill.session import clear_settled, settle, shared_folder
from factmill.sources import dimensions, jdbc, readers, sample, writers

SPEC = FactSpec()


def test_cap_by_position(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(7).write.parquet(path)
    for cap in (0, 1, 137, 143, 999, 1000, 5000):
        capped = readers.scan(spark, path, row_cap=cap)
        first = [r[0] for r in capped.collect()]
        assert len(first) == len(set(first)) == min(cap, 1000)
        assert sorted(r[0] for r in capped.collect()) == sorted(first)
    ordered = readers.scan(spark, path, row_cap=5, cap_order=["id"])
    assert [r[0] for r in ordered.collect()] == [0, 1, 2, 3, 4]


def files_read(df):
    """Files the scan of a plan opened."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plans, found = [execution.executedPlan()], []
    while plans:
        plan = plans.pop()
        if plan.metrics().contains("numFiles"):
            found.append(plan.metrics().apply("numFiles").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(found)


def test_cap_reads_no_file_past_the_end(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(5).write.parquet(path)
    assert files_read(spark.read.parquet(path)) == 5
    assert files_read(readers.scan(spark, path, row_cap=10)) == 1
    assert files_read(readers.scan(spark, path, row_cap=250)) == 2


class NoFolderSession:
    """As much of a session as names no shared folder."""

    def __init__(self):
        self.conf = self
        self.settings = {"spark.sql.warehouse.dir": "hdfs://store/warehouse"}

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    session = NoFolderSession()
    assert shared_folder(session) == "hdfs://store/warehouse/_factmill"
    session.settings["spark.checkpoint.dir"] = "hdfs://store/checkpoints/"
    assert shared_folder(session) == "hdfs://store/checkpoints"


def test_settled_tables_can_be_cleared(spark):
    table = settle(spark.range(10))
    (file, *_) = table.inputFiles()
    path = file.removeprefix("file://")
    assert os.path.exists(path)
    clear_settled(spark)
    assert not os.path.exists(path)


def test_strict_save_and_read(spark, clean_small, tmp_path):
    paths = writers.save_strict(clean_small, str(tmp_path / "deep" / "er"), "totals")
    for fmt in ("csv", "parquet"):
        back = readers.read_totals(spark, paths[fmt]).select(*clean_small.columns)
        assert sorted(back.collect()) == sorted(clean_small.collect())
    with pytest.raises(ValueError, match="date"):
        writers.save_strict(clean_small.drop("date"), str(tmp_path / "none"), "totals")
    assert not os.path.exists(tmp_path / "none")


def test_processed_save_only_warns(spark, clean_small, tmp_path, caplog):
    writers.save_processed(clean_small.drop("date"), str(tmp_path), "t", ["parquet"])
    assert "date" in caplog.text
    assert os.path.isdir(tmp_path / "t.parquet") and not os.path.exists(tmp_path / "t.csv")


def test_unknown_formats_and_undetermined_caps_raise(spark, clean_small, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        writers.save_processed(clean_small, str(tmp_path), "t", ["parquet", "xlsx"])
    assert not (tmp_path / "t.parquet").exists()
    path = writers.write_table(clean_small, str(tmp_path / "c"), "csv")
    with pytest.raises(ValueError, match="cap_order"):
        readers.scan(spark, path, "csv", row_cap=2)
    assert readers.scan(spark, path, "csv", row_cap=2, cap_order=["_c0"]).count() == 2


def test_export_has_a_bare_header_and_plain_numbers(spark, tmp_path):
    rows = [('a "b", c', 1e-5, 1), (None, 1e20, 2), ("x", -1.5e-7, None), ("y", 12345678.25, 4)]
    df = spark.createDataFrame(rows, "`Some Name` string, v double, n long").coalesce(1)
    path = writers.export_csv(df, str(tmp_path / "e"))
    (file,) = [f for f in os.listdir(path) if f.endswith(".txt")]
    with open(os.path.join(path, file)) as lines:
        assert lines.read().splitlines() == [
            "Some Name,v,n",
            '"a ""b"", c","0.00001","1"',
            '"","100000000000000000000","2"',
            '"x","-0.00000015",""',
            '"y","12345678.25","4"',
        ]


def test_partitioned_snapshot_prunes(spark, clean_small, tmp_path):
    path = writers.write_table(clean_small, str(tmp_path / "t"), partition_by=["year"])
    plan = spark.read.parquet(path).where("year = 2012")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert spark.read.parquet(path).where("year = 2012").count() == 1


def test_validated_save(spark, clean_small, tmp_path):
    paths = writers.save_validated(
        clean_small, str(tmp_path), "v", "report", "raw", "2024-01-01"
    )
    assert spark.read.parquet(paths["parquet"]).count() == 3
    text = [r[0] for r in spark.read.text(paths["validation_report"]).collect()]
    assert "found 1 in required_columns (value)" in text


def test_dimensions(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(fixed.SAMPLE_DISTRICTS, indent=1))
    (tmp_path / "c.json").write_text(json.dumps(fixed.SAMPLE_CATEGORIES, indent=1))
    districts = dimensions.read_districts(spark, str(tmp_path / "d.json"))
    assert [r[0] for r in districts.collect()] == list(fixed.SAMPLE_DISTRICTS)
    pairs = dimensions.read_categories(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in pairs.collect()} == {
        (major, minor) for major, minors in fixed.SAMPLE_CATEGORIES.items() for minor in minors
    }


def test_sample_is_fixed_and_spoiled(spark):
    table = sample.sample_table(spark)
    assert table.count() == fixed.SAMPLE_ROWS
    a, b, c, d = (
        sample.inject_errors(sample.sample_facts(spark.range(4))).orderBy("id").collect()
    )
    assert a["borough"] is None and b["month"] == 13
    assert c["value"] == -5 and d["minor_category"] == "Unknown"
    whole = sorted(map(tuple, sample.sample_facts(spark.range(500)).collect()))
    parts = sorted(map(tuple, sample.sample_facts(spark.range(500).repartition(9)).collect()))
    assert whole == parts


def test_sample_distribution(spark):
    df = sample.sample_facts(spark.range(20000))
    values = np.array([r["value"] for r in df.select("value").collect()])
    assert values.mean() == pytest.approx(15, abs=0.15)
    assert values.var() == pytest.approx(15, abs=0.6)
    per = {c: df.groupBy(c).count().collect() for c in ("borough", "month", "year")}
    assert [len(per[c]) for c in ("borough", "month", "year")] == [33, 12, 9]
    assert all(abs(r["count"] - 20000 / 12) < 200 for r in per["month"])
    for row in df.select("major_category", "minor_category").distinct().collect():
        assert row[1] in fixed.SAMPLE_CATEGORIES[row[0]]
    assert clean.clean(sample.sample_table(spark)).count() > 100


def test_pools_are_numbered_tables(spark):
    df = spark.range(60).selectExpr("concat('m', id % 4) AS a", "concat('n', id % 20) AS b")
    pool = sample.value_pool(df, "a")
    assert [tuple(r) for r in pool.table.orderBy("index").collect()] == [
        (k, f"m{k}") for k in range(4)
    ]
    categories = sample.category_pool(df, "a", "b")
    of = {r["major"]: (r["first"], r["n"]) for r in categories.majors.table.collect()}
    minors = {r["index"]: r["minor"] for r in categories.minors.collect()}
    for k in range(4):
        first, n = of[f"m{k}"]
        wanted = sorted({f"n{i % 20}" for i in range(60) if i % 4 == k})
        assert [minors[first + i] for i in range(n)] == wanted
    made = sample.sample_facts(spark.range(300), districts=pool, categories=categories)
    assert made.count() == 300 and made.where("borough IS NULL OR minor_category IS NULL").isEmpty()


def test_poisson_steps():
    steps = sample.poisson_steps(15)
    assert steps == sorted(steps) and steps[-1] < 1 and 1 - steps[-1] < 1e-8


def test_settled_table_is_cut_off(spark, clean_small):
    totals = settle(aggregate.total_by(clean_small, "borough"))
    assert "Aggregate" not in totals._jdf.queryExecution().toString()
    assert totals.count() == 3


def test_jdbc_options(clean_small):
    options = jdbc.write_options("jdbc:postgresql://h/db", "t", connections=4)
    assert options["batchsize"] == "1000" and options["numPartitions"] == "4"
    assert options["reWriteBatchedInserts"] == "true"
    assert "reWriteBatchedInserts" not in jdbc.write_options("jdbc:other:x", "t")
    assert jdbc.MODES == {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    reading = jdbc.read_options("u", "t", "year", 2008, 2016, 9)
    assert (reading["partitionColumn"], reading["lowerBound"], reading["numPartitions"]) == (
        "year", "2008", "9")
    with pytest.raises(ValueError, match="bounds"):
        jdbc.read_options("u", "t", "year")


def test_load_without_url_is_skipped(clean_small):
    assert jdbc.load_table(clean_small, None, "t") is False
    with pytest.raises(ValueError, match="date"):
        jdbc.load_table(clean_small.drop("date"), "jdbc:x", "t")
    with pytest.raises(ValueError, match="mode"):
        jdbc.load_table(clean_small, "jdbc:x", "t", mode="merge")


@pytest.mark.parametrize("rows", [0, 1, 7, 40, 123, 400, 1000])
def test_first_in_order_is_a_sorted_prefix(spark, tmp_path, rows):
    import random

    pick = random.Random(rows)
    # nulls, ties in the first columns, NaN, and a last column that tells rows apart
    data = [
        (pick.choice([None, "a", "b", "b", "c"]), pick.choice([None, 1.5, float("nan"), -2.0]), k)
        for k in pick.sample(range(600), 600)
    ]
    spark.createDataFrame(data, "x string, y double, z int").repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = readers.first_in_order(df, rows, ["x", "y", "z"], small=20, pivots=4)
    assert [r.z for r in got.orderBy("x", "y", "z").collect()] == [
        r.z for r in df.orderBy("x", "y", "z").limit(rows).collect()
    ]
    # tied rows: as many as have room
    few = readers.first_in_order(df.select("x"), rows, ["x"], small=20, pivots=4)
    assert [r.x for r in few.orderBy("x").collect()] == [r.x for r in df.select("x").orderBy("x").limit(rows).collect()]


def test_first_in_order_moves_no_rows(spark, tmp_path):
    spark.range(0, 50_000, 1, 4).selectExpr("hash(id) AS h", "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = readers.first_in_order(df, 30_000, ["h", "id"], small=1000)
    assert got.count() == 30_000 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
