"""Copies and totals on a stream against the batch run over the same rows."""

from datetime import datetime

import pytest
from factmill import FactSpec
from factmill.operators import clean
from factmill.streaming import totals
from pyspark.sql import functions as F

SPEC = FactSpec(year_min=1990, year_max=2030)
SCHEMA = "Borough string, `Major-Category` string, `Minor Category` string, Value string, Year string, Month string, lsoa_code string"


def raw_rows(n, year=2011):
    return [
        (["Eastley", " fernhill ", None][k % 3], "Lighting", ["Lamp out", "pole"][k % 2], str(k % 4), str(year + k % 3), str(1 + k % 12), f"A{k % 5}")
        for k in range(n)
    ]


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def raw(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")

    return arrive


def test_totals_after_restarts_and_repeated_files(spark, tmp_path, raw):
    first, second = raw_rows(60), raw_rows(90)[30:]

    def run(per_batch):
        return totals.stream_to_totals(spark, f"{tmp_path}/raw", SCHEMA, str(tmp_path), "1 day", per_batch, SPEC)

    raw(first)
    raw(first[10:30])
    assert ordered(run(1)) == ordered(clean.clean(spark.createDataFrame(first, SCHEMA), SPEC))
    # nothing new
    assert ordered(run(1)) == ordered(clean.clean(spark.createDataFrame(first, SCHEMA), SPEC))
    # older and newer months, and the first file again
    raw(raw_rows(40, 2001))
    raw(second)
    raw(first)
    got = run(2)
    every = spark.createDataFrame(first + second + raw_rows(40, 2001), SCHEMA)
    assert ordered(got) == ordered(clean.clean(every, SPEC)) and got.schema == SPEC.processed_schema
    compact = totals.compact_upserts(spark, f"{tmp_path}/totals", f"{tmp_path}/plain", SPEC)
    assert ordered(spark.read.parquet(compact)) == ordered(got)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/totals"
    rows = [("Eastley", "Lighting", "Pole", 2011, 4, 7.0, datetime(2011, 4, 1).date())]
    for batch, total in ((0, 7.0), (1, 9.0), (1, 9.0), (10, 12.0), (2, 10.0)):
        frame = spark.createDataFrame([(*rows[0][:5], total, rows[0][6])], SPEC.processed_schema)
        frame.write.mode("overwrite").parquet(f"{path}/{totals.BATCH}={batch}")
    assert [r[SPEC.total] for r in totals.read_upserts(spark, path, SPEC).collect()] == [12.0]


def test_copies_within_and_past_the_delay(spark, tmp_path):
    schema = "a string, b double, at timestamp"
    hour = [datetime(2024, 1, 1, h) for h in range(24)]
    batches = [
        [("x", 1.0, hour[1]), ("x", 1.0, hour[1]), ("x", None, hour[1]), ("", 1.0, hour[1]), (None, 1.0, hour[1])],
        # a copy in the next batch, then time goes on
        [("x", 1.0, hour[2]), ("y", 2.0, hour[9])],
        [("z", 3.0, hour[10])],
        # the first is forgotten, so its copy is new; a row of hour 3 is late
        [("x", 1.0, hour[11]), ("y", 2.0, hour[10]), ("w", 4.0, hour[3])],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        unique = totals.unique_stream(stream, "3 hours", "at")
        query = unique.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        query.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    out = sorted(map(tuple, spark.read.schema(unique.schema).parquet(f"{tmp_path}/out").collect()), key=str)
    assert out == sorted([("x", 1.0), ("x", None), ("", 1.0), (None, 1.0), ("y", 2.0), ("z", 3.0), ("x", 1.0)], key=str)


def test_digests_tell_rows_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("-", "ab"), ("=", "ab"), ("a1:=", "b"), (None, None), ("", "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert frame.select(totals.row_digest(frame).alias("d")).distinct().count() == len(rows)


def test_closed_months_take_no_more_rows(spark, tmp_path):
    schema = "borough string, major_category string, minor_category string, value double, year long, month long"
    files = [[("E", "L", "P", 1.0, 2010, 1)], [("E", "L", "P", 2.0, 2012, 1)], [("E", "L", "P", 4.0, 2010, 1), ("E", "L", "P", 8.0, 2011, 12)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        kept = totals.running_totals(stream, SPEC, "90 days")
        totals.upsert_totals(kept, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {(r.year, r.month): r[SPEC.total] for r in totals.read_upserts(spark, f"{tmp_path}/out", SPEC).collect()}
    assert got == {(2010, 1): 1.0, (2012, 1): 2.0, (2011, 12): 8.0}


def test_empty_rows_without_state(spark, tmp_path, raw):
    raw([(None,) * 7])
    out = totals.stream_to_totals(spark, f"{tmp_path}/raw", SCHEMA, str(tmp_path), "1 day", None, SPEC)
    assert out.collect() == []
    assert F.col(totals.ARRIVAL) is not None and totals.ARRIVAL not in out.columns


def test_many_files_are_read_in_few_batches_with_state_on_disk(spark, tmp_path, raw):
    rows = raw_rows(44)
    for k in range(0, 44, 4):
        raw(rows[k : k + 4])
    before = spark.conf.getAll
    out = totals.stream_to_totals(spark, f"{tmp_path}/raw", SCHEMA, str(tmp_path), "1 day", 1, SPEC)
    assert ordered(out) == ordered(clean.clean(spark.createDataFrame(rows, SCHEMA), SPEC))
    offsets = sorted((tmp_path / "progress" / "rows" / "offsets").glob("[0-9]*"))
    # one more, without rows, lets the state forget
    assert 1 <= len(offsets) <= totals.MOST_BATCHES + 1
    for step in ("rows", "totals"):
        first = (tmp_path / "progress" / step / "offsets" / "0").read_text()
        assert "RocksDBStateStoreProvider" in first
    assert spark.conf.getAll == before
