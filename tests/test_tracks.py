import datetime

from pyspark.sql import functions as F

from tracktally.plans.wrangle import wrangle_tracks
from tracktally.sources import tables
from tracktally.sources import tracks as T

TEXT = """AL012000,            ALPHA,      2,
20000606, 0000,  , TD, 21.0N,  93.0W,  25, 1008, extra, 1
20000606, 0600, L, TS, 20.9N,  92.8W,  40, 1004
EP022000,             BETA,      1,
20000522, 0600,  , TD, 10.5S, 179.5E,  25, -999
AL031999,            GAMMA,      1,
19990606, 0000,  , TD, 21.0N,  93.0W,  25, 1008
AL042001,            DELTA,      5,
20010606, 0000,  , TD, 21.0N,  93.0W,    , 1008
20010606, 1200,  , TD, 21.5X,  93.0W,  30, 1008
AL052001,            EMPTY,      0,
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_parse_types_and_signs(spark, tmp_path):
    path = write(tmp_path, "a.txt", TEXT)
    out = {(r.STORM_ID, r.TIME, r.YEAR): r for r in wrangle_tracks(spark, {"x": path}).collect()}
    assert len(out) == 5  # the 1999 track is filtered
    first = out["AL012000", "0000", 2000]
    assert (first.NAME, first.LAT, first.LON, first.WIND, first.PRESSURE) == ("ALPHA", 21.0, -93.0, 25, 1008)
    assert (first.DATE, first.MONTH, first.DAY, first.RECORD_ID) == (datetime.date(2000, 6, 6), 6, 6, "")
    assert out["AL012000", "0600", 2000].RECORD_ID == "L"
    beta = out["EP022000", "0600", 2000]
    assert (beta.LAT, beta.LON, beta.PRESSURE) == (-10.5, 179.5, -999)
    assert out["AL042001", "0000", 2001].WIND is None
    assert out["AL042001", "1200", 2001].LAT is None  # no hemisphere letter


def test_missing_codes_are_optional(spark, tmp_path):
    lines = T.read_track_lines(spark, write(tmp_path, "a.txt", TEXT), "x")
    seen = T.typed(T.observations(T.stage_track_lines(lines)), missing_codes=(-999, -99))
    assert [r.PRESSURE for r in seen.filter("STORM_ID = 'EP022000'").collect()] == [None]


def test_rejected_tracks(spark, tmp_path):
    stray = "20000101, 0000,  , TD, 21.0N,  93.0W,  25, 1008\n"
    lines = T.read_track_lines(spark, write(tmp_path, "a.txt", stray + TEXT), "x")
    bad = {r.STORM_ID: (r.N_TRACK, r.N_FOUND) for r in T.rejected_tracks(T.stage_track_lines(lines)).collect()}
    assert bad == {"AL042001": (5, 2), "AL052001": (0, 0), None: (None, 1)}


def test_header_is_carried_across_chunks_and_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    rows = [f"20000606, {i:04d},  , TD, 21.0N,  93.0W,  25, {i}" for i in range(200)]
    whole = ["AL012000, A, 150,"] + rows[:150] + ["AL022000, B, 50,"] + rows[150:]
    for i in range(0, len(whole), 60):
        (folder / f"part-{i:05d}.txt").write_text("\n".join(whole[i:i + 60]) + "\n")
    staged = T.stage_track_lines(T.read_track_lines(spark, str(folder), "x"), chunk_bits=3)
    seen = T.typed(T.observations(staged, across_files=True))
    got = {r.PRESSURE: r.STORM_ID for r in seen.collect()}
    assert got == {i: "AL012000" if i < 150 else "AL022000" for i in range(200)}
    assert T.rejected_tracks(staged, across_files=True).count() == 0
    # files that stand alone: the 59 + 31 lines behind a header of their own file, in any chunk
    alone = {r.PRESSURE: r.STORM_ID for r in T.typed(T.observations(staged)).collect()}
    assert alone == {**{i: "AL012000" for i in range(59)}, **{i: "AL022000" for i in range(150, 178)}}
    assert {r.STORM_ID: r.N_FOUND for r in T.rejected_tracks(staged).collect()} == {
        "AL012000": 59, "AL022000": 28, None: 113}


def test_one_track_over_many_blocks(spark, tmp_path):
    details = [f"20000606, {i:05d},  , TD, 21.0N,  93.0W,  25, {i}" for i in range(3000)]
    path = write(tmp_path, "a.txt", "\n".join(["AL012000, A, 2990,", *details[:2990], "AL022000, B, 10,", *details[2990:]]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        staged = T.stage_track_lines(T.read_track_lines(spark, path, "x"), chunk_bits=4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert staged.select("BLOCK").distinct().count() > 10
    got = {r.PRESSURE: r.STORM_ID for r in T.typed(T.observations(staged)).collect()}
    assert got == {i: "AL012000" if i < 2990 else "AL022000" for i in range(3000)}
    assert T.rejected_tracks(staged).count() == 0


def test_two_basins_are_stacked_and_repeats_kept(spark, tmp_path):
    a, b = write(tmp_path, "a.txt", TEXT), write(tmp_path, "b.txt", TEXT)
    both = wrangle_tracks(spark, {"atlantic": a, "pacific": b})
    counts = {r.BASIN: r["count"] for r in both.groupBy("BASIN").count().collect()}
    assert counts == {"atlantic": 5, "pacific": 5}


def test_csv_keeps_missing_and_empty_apart(spark, tmp_path):
    path = write(tmp_path, "a.txt", TEXT)
    seen = wrangle_tracks(spark, {"x": path}).drop("BASIN")
    tables.write_csv(seen, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), tables.TRACK_SCHEMA)
    assert sorted(map(str, back.collect())) == sorted(map(str, seen.collect()))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "NA" in text
    tables.write_by_year(seen, str(tmp_path / "parquet"))
    again = spark.read.parquet(str(tmp_path / "parquet")).filter(F.col("YEAR") == 2001)
    assert again.count() == 2
