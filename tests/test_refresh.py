"""Refreshed totals against whole runs, and what a refresh leaves alone."""

import glob
import os

import pytest
from factmill import FactSpec
from factmill.operators import clean
from factmill.plans import refresh

SPEC = FactSpec(year_min=1990, year_max=2030)
SCHEMA = "Borough string, `Major-Category` string, `Minor Category` string, Value string, Year string, Month string"


def rows_of(year, months, n=20):
    return [
        (["Eastley", "fernhill"][k % 2], "Lighting", "Lamp out", str(k % 3), str(year), str(months[k % len(months)]))
        for k in range(n)
    ]


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


class Months:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.rows = spark, folder, {}

    def put(self, name, rows):
        self.rows[name] = rows
        path = f"{self.folder}/raw/{name}"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    def remove(self, name):
        del self.rows[name]
        for file in glob.glob(f"{self.folder}/raw/{name}/*"):
            os.remove(file)

    def refresh(self):
        done = refresh.refresh_totals(self.spark, f"{self.folder}/raw/*", self.folder, SCHEMA, SPEC)
        every = [r for rows in self.rows.values() for r in rows]
        whole = clean.clean(self.spark.createDataFrame(every, SCHEMA), SPEC)
        got = refresh.read_refreshed(self.spark, self.folder, SPEC)
        assert ordered(got) == ordered(whole.select(*got.columns)) and got.schema == SPEC.processed_schema
        return sorted(tuple(r) for r in done.collect())

    def files(self):
        found = glob.glob(f"{self.folder}/totals/year=*/month=*/*.parquet")
        return {f: os.stat(f).st_mtime_ns for f in found}


@pytest.fixture
def months(spark, tmp_path):
    return Months(spark, str(tmp_path))


def test_only_touched_months_are_made_again(months):
    months.put("a", rows_of(2011, [1, 2]))
    months.put("b", rows_of(2011, [2, 3]))
    assert months.refresh() == [(2011, 1), (2011, 2), (2011, 3)]
    before = months.files()
    # nothing to do
    assert months.refresh() == [] and months.files() == before
    # a new file with copies of rows of another and a new month
    months.put("c", rows_of(2011, [3, 4]) + rows_of(2011, [3])[:5])
    assert months.refresh() == [(2011, 3), (2011, 4)]
    after = months.files()
    kept = {f: t for f, t in before.items() if "month=3" not in f}
    assert kept.items() <= after.items()
    assert not any(f in after for f in before if "month=3" in f)


def test_changed_and_removed_files(months):
    months.put("a", rows_of(2011, [1, 2]))
    months.put("b", rows_of(2012, [5]))
    months.put("c", rows_of(2012, [6]))
    months.refresh()
    # the months that a file had before count as well as those that it has now
    months.put("a", rows_of(2011, [2, 7]))
    assert months.refresh() == [(2011, 1), (2011, 2), (2011, 7)]
    assert not any("year=2011/month=1/" in f for f in months.files())
    months.remove("b")
    assert months.refresh() == [(2012, 5)]


def test_files_without_valid_rows(months):
    months.put("a", rows_of(2011, [1]))
    months.refresh()
    before = months.files()
    months.put("b", [("Eastley", "Lighting", "Pole", "1", "2011", "13"), (None,) * 6])
    assert months.refresh() == [] and months.files() == before
    assert months.refresh() == []


def test_a_refresh_that_failed_is_done_by_the_next(months, monkeypatch):
    months.put("a", rows_of(2011, [1, 2]))
    months.refresh()
    months.put("b", rows_of(2011, [2, 3]))
    rewrite = refresh._rewrite

    def fail(*args):
        rewrite(*args)
        raise OSError("lost")

    monkeypatch.setattr(refresh, "_rewrite", fail)
    with pytest.raises(OSError):
        months.refresh()
    monkeypatch.setattr(refresh, "_rewrite", rewrite)
    assert months.refresh() == [(2011, 2), (2011, 3)]
