import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracktally.functions.text import clock, observed_at
from tracktally.operators.paths import path_steps
from tracktally.plans import explore, modelling

# Published event totals by month and by location, 2000-2024.
MONTH_TOTALS = [2, 0, 0, 0, 12, 37, 46, 118, 150, 105, 27, 3]
LOCATION_TOTALS = {
    "Antigua and Barbuda": 8, "Bahamas": 28, "Belize": 16, "Canada": 17, "Cuba": 34,
    "Dominican Republic": 11, "Mexico": 145, "Nicaragua": 17, "Puerto Rico": 7, "United States": 151,
}


@pytest.fixture(scope="module")
def landfalls(spark):
    rows = []
    for month, total in enumerate(MONTH_TOTALS, start=1):
        rows += [(2000 + i % 25, month, "Mexico") for i in range(total)]
    return spark.createDataFrame(rows, "YEAR int, MONTH int, LOCATION string")


def test_monthly_grid(spark, landfalls):
    grid = modelling.monthly_grid(landfalls, 2000, 2024).collect()
    assert len(grid) == 360
    assert [r.ALL_ID for r in grid] == list(range(1, 361))
    assert [(r.YEAR, r.MONTH) for r in grid[:2]] == [(2000, "January"), (2001, "January")]
    assert [r.OBS_ID for r in grid[:300]] == list(range(1, 301))
    assert [r.PRED_ID for r in grid[300:]] == list(range(1, 61))
    # Forecast months run alphabetically inside a year
    assert [r.MONTH for r in grid[300:312]] == [
        "April", "August", "December", "February", "January", "July", "June", "March", "May",
        "November", "October", "September",
    ]
    assert sum(r.LANDFALL_COUNT for r in grid[:300]) == 500
    assert all(r.LANDFALL_COUNT is None for r in grid[300:])
    by_year = {r.YEAR: r.DATE for r in grid}
    # Published standardised years
    for year, want in ((2000, -1.0), (2024, 0.655172413793103), (2025, 0.724137931034483), (2029, 1.0)):
        assert by_year[year] == pytest.approx(want, abs=1e-14)
    assert len(modelling.observed(modelling.monthly_grid(landfalls, 2000, 2024)).collect()) == 300


def test_location_grid(spark):
    rows = [(2000 + i % 25, name) for name, n in LOCATION_TOTALS.items() for i in range(n)]
    rows += [(2003, "Small")] * 3
    grid = modelling.location_grid(spark.createDataFrame(rows, "YEAR int, LOCATION string"), 2000, 2024).collect()
    assert len(grid) == 300
    assert [r.ALL_ID for r in grid] == list(range(1, 301))
    assert [r.LOCATION for r in grid[250:260]] == sorted(LOCATION_TOTALS)
    totals = {}
    for r in grid[:250]:
        totals[r.LOCATION] = totals.get(r.LOCATION, 0) + r.LANDFALL_NBR
        marks = [r[str(k)] for k in range(1, 11)]
        assert sum(marks) == 1 and marks[r.LOC_ID - 1] == 1
    assert totals == LOCATION_TOTALS


def test_average_counts_empty_months(spark, landfalls):
    out = explore.average_per_month(landfalls, 2000, 2024).collect()
    assert [r.AVG_LANDFALLS for r in out] == pytest.approx([n / 25 for n in MONTH_TOTALS])
    assert out[0].MONTH == "January" and out[11].MONTH == "December"


def test_year_counts_have_no_grid(spark):
    few = spark.createDataFrame([(2000,), (2002,), (2002,)], "YEAR int")
    assert sorted(map(tuple, explore.landfalls_per_year(few).collect())) == [(2000, 1), (2002, 2)]


def test_time_of_day(spark):
    row = spark.range(1).select(
        clock(F.lit(0)).alias("midnight"), clock(F.lit(630)).alias("morning"),
        observed_at(F.lit(2005), F.lit(8), F.lit(29), F.lit(30)).alias("at"),
    ).first()
    assert (row.midnight, row.morning) == ("0000", "0630")
    assert row["at"] == datetime.datetime(2005, 8, 29, 0, 30)


def test_paths_of_a_dominant_track(spark):
    rng = random.Random(1)
    start = datetime.datetime(2001, 3, 1)
    rows = []
    for i in range(900):
        track = "big" if rng.random() < 0.7 else f"t{i % 9}"
        rows.append((i, track, start + datetime.timedelta(minutes=rng.randrange(60_000)), float(i)))
    df = spark.createDataFrame(rows, "id long, STORM_ID string, at timestamp_ntz, LON double")
    out = path_steps(df, "STORM_ID", ["at", "id"], ["LON"], "at", bucket_seconds=7_200).collect()
    got = {r.id: (r.SEQ, r.NEXT_LON) for r in out}
    want = {}
    for track in {r[1] for r in rows}:
        path = sorted((r for r in rows if r[1] == track), key=lambda r: (r[2], r[0]))
        for seq, (r, following) in enumerate(zip(path, path[1:] + [None]), start=1):
            want[r[0]] = (seq, following[3] if following else None)
    assert got == want


def test_path_keeps_rows_without_a_time(spark):
    at = datetime.datetime(2000, 6, 1)
    rows = [("A", at, 1), ("A", None, 2), ("A", at + datetime.timedelta(days=40), 3), (None, at, 4)]
    df = spark.createDataFrame(rows, "track string, at timestamp, n int")
    out = path_steps(df.withColumn("m", df.n), "track", ["at", "n"], ["m"], "at").collect()
    assert sorted((r.track or "", r.SEQ, r.n) for r in out) == [("", 1, 4), ("A", 1, 2), ("A", 2, 1), ("A", 3, 3)]


def test_following_point_with_a_missing_value(spark):
    rows = [(1, 2, "2020-01-01 06:00:00", None), (1, 1, "2020-01-01 00:00:00", 1.0), (1, 0, "2020-01-02 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "t int, n int, s string, x double").withColumn("ts", F.to_timestamp("s"))
    out = {r.SEQ: r.NEXT_x for r in path_steps(df, "t", ["n"], ["x"], "ts").collect()}
    assert out == {1: None, 2: 3.0, 3: None}  # by time, whatever the order starts with
