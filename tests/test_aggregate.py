import pytest
from pyspark.sql import functions as F

from factmill import FactSpec
from factmill.functions import numbers, text
from factmill.operators import aggregate
from factmill.plans.dashboard import TAGS, dashboard

SPEC = FactSpec()


@pytest.fixture(scope="module")
def totals(spark):
    rows = []
    for d in ("Camden", "Brent", "Ealing"):
        for major in ("Theft", "Drugs"):
            for minor in range(7):
                for year in (2014, 2015):
                    for month in (1, 10):
                        total = float((len(d) * 7 + minor * 3 + year + month) % 11)
                        rows.append((d, major, f"{major}-{minor}", year, month, total))
    # equal totals at the boundary of the ten largest are settled by name
    return spark.createDataFrame(
        rows,
        "borough string, major_category string, minor_category string, year long, month long, "
        "total_crimes double",
    ).withColumn("date", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)))


def by_hand(rows, key):
    sums = {}
    for r in rows:
        sums[key(r)] = sums.get(key(r), 0.0) + r["total_crimes"]
    return sums


def test_totals_trend_and_top(totals):
    rows = totals.collect()
    minors = by_hand(rows, lambda r: r["minor_category"])
    top = sorted(minors.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert [tuple(r) for r in aggregate.ranking(totals, "minor_category", 10).collect()] == top
    months = by_hand(rows, lambda r: f"{r['year']}-{r['month']:02d}")
    assert [tuple(r) for r in aggregate.monthly_trend(totals).collect()] == sorted(months.items())
    assert aggregate.grand_total(totals).first()[0] == sum(months.values())
    assert aggregate.grand_total(totals.where("false")).first()[0] == 0.0


def test_matrix_rows_sum_to_totals(totals):
    wide = aggregate.matrix(totals, "borough", "year", [2013, 2014, 2015])
    sums = dict(map(tuple, aggregate.total_by(totals, "borough").collect()))
    assert wide.columns == ["borough", "2013", "2014", "2015"]
    for row in wide.collect():
        assert row["2013"] == 0.0
        assert row["2014"] + row["2015"] == sums[row["borough"]]
    maps = aggregate.matrix_map(totals, "borough", "year").collect()
    assert {r["borough"]: sum(r["totals"].values()) for r in maps} == sums


def test_leader(spark, totals):
    rows = totals.collect()
    sums = by_hand(rows, lambda r: r["borough"])
    name, total = min(sums.items(), key=lambda kv: (-kv[1], kv[0]))
    got = aggregate.leader(totals, "borough").first()
    assert tuple(got) == (name, total, round(100 * total / sum(sums.values()), 1))
    assert aggregate.leader(totals.where("false"), "borough").collect() == []


def test_lists(totals):
    assert [r[0] for r in aggregate.distinct_values(totals, "year").collect()] == [2014, 2015]
    minors = [r[0] for r in aggregate.minors_of(totals, "Drugs").collect()]
    assert minors == [f"Drugs-{i}" for i in range(7)]
    assert len(aggregate.minors_of(totals).collect()) == 14
    assert tuple(aggregate.distinct_counts(totals, "borough", "year").first()) == (3, 2)
    assert tuple(aggregate.distinct_counts(totals, "borough", approximate=True).first()) == (3,)
    assert aggregate.year_span(totals).first()["label"] == "2014-2015"
    assert aggregate.year_span(totals.where("year = 2014")).first()["label"] == "2014"


def test_filters(totals):
    assert aggregate.filter_facts(totals).count() == totals.count()
    assert aggregate.filter_facts(totals, "Camden", "Theft", 2015).count() == 14
    assert aggregate.filter_facts(totals, "", None, 0).count() == totals.count()


def test_pages_cover_every_row_once(totals):
    everything = [tuple(r) for r in totals.orderBy(*SPEC.keys).collect()]
    numbered, followed, last, i = [], [], None, 0
    while True:
        one = aggregate.page(totals, SPEC.keys, i, 25).collect()
        two = aggregate.page_after(totals, last, SPEC.keys, 25).collect()
        assert one == two
        if not one:
            break
        numbered += map(tuple, one)
        last, i = two[-1].asDict(), i + 1
    assert numbered == everything


def test_summary_union(totals):
    got = aggregate.summary_union(totals, TAGS).collect()
    kinds = {tag: [r for r in got if r["Type"] == tag] for tag in TAGS}
    assert [len(kinds[t]) for t in TAGS] == [3, 10, 4]
    for row in got:
        filled = [c for c in ("Borough", "Minor Category", "Date") if row[c] != ""]
        assert filled == [dict(zip(TAGS, ("Borough", "Minor Category", "Date")))[row["Type"]]]
    top = {tuple(r) for r in aggregate.ranking(totals, "minor_category", 10).collect()}
    assert {(r["Minor Category"], r["Total Crimes"]) for r in kinds[TAGS[1]]} == top


def test_dashboard_tables_run(totals):
    tables = dashboard(totals, district="Camden", year=2014)
    assert tables["total"].first()[0] == aggregate.grand_total(
        totals.where("borough = 'Camden' and year = 2014")
    ).first()[0]
    for name, frame in tables.items():
        assert frame.count() > 0, name


def test_display_and_numbers(spark):
    df = spark.createDataFrame([("a", None, 2.5), (None, 3, 1234567.0)], "s string, n long, d double")
    assert [tuple(r) for r in aggregate.display(df).collect()] == [
        ("a", "-", "2.5"), ("-", "3", "1234567.0"),
    ]
    got = df.select(
        numbers.plain(F.col("d")), numbers.grouped(F.col("d")), text.blank(F.col("s")),
        numbers.half_even(F.col("d"), 0), numbers.at_least_zero(-F.col("d")),
        numbers.percent(F.lit(1), F.lit(0)),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("2.5", "2", "a", 2.0, 0.0, None), ("1234567", "1,234,567", "", 1234567.0, 0.0, None),
    ]
