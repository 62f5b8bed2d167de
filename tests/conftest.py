import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from factmill.session import build_session  # noqa: E402

RAW_SCHEMA = (
    "borough string, major_category string, minor_category string, "
    "value long, year long, month long, lsoa_code string"
)
TOTALS_SCHEMA = (
    "borough string, major_category string, minor_category string, "
    "total_crimes double, year long, month long, date date"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw_dirty(spark):
    # a month past the last, a missing district, a missing major, three good rows
    rows = [
        ("Eastley", "road works", "Resurfacing", 7, 2011, 4, "A1"),
        ("Fernhill", "Lighting", "Lamp out", 9, 2012, 14, "A2"),
        (None, "Drainage", None, -8, 2013, 2, "A3"),
        ("Gorsefield", None, "Drainage", 21, 2014, 9, "A4"),
        ("Dunmore", "road works", "potholes", 0, 2011, 4, "A1"),
        ("Fernhill", "road works", "Resurfacing", 7, 2011, 4, "A1"),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


@pytest.fixture
def clean_small(spark):
    from datetime import date

    rows = [
        ("Eastley", "Road Works", "Resurfacing", 7.0, 2011, 4, date(2011, 4, 1)),
        ("Fernhill", "Lighting", "Lamp Out", 9.0, 2012, 11, date(2012, 11, 1)),
        ("Dunmore", "Road Works", "Potholes", 0.0, 2011, 4, date(2011, 4, 1)),
    ]
    return spark.createDataFrame(rows, TOTALS_SCHEMA)


@pytest.fixture(scope="session")
def ml_small(spark):
    import random

    # a place decides most of the total; years on both sides of the split
    pick = random.Random(5)
    level = {"Ashford": 5, "Millbrook": 15, "Northgate": 10}
    minors = {"Roads": ["Potholes", "Leak"], "Lighting": ["Lamp Out"], "Water": ["Leak"]}
    rows = []
    for _ in range(200):
        borough, major = pick.choice(sorted(level)), pick.choice(sorted(minors))
        minor = pick.choice(minors[major])
        year, month = pick.choice([2007, 2009, 2011, 2013, 2015, 2016, 2018]), pick.randint(1, 12)
        high = level[borough]
        rows.append((borough, major, minor, float(high + pick.randint(0, 9)), year, month))
    return spark.createDataFrame(
        rows,
        "borough string, major_category string, minor_category string, "
        "total_crimes double, year long, month long",
    ).repartition(3)
