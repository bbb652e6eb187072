"""Header/detail track text to tidy rows.

A header line ``id, name, n`` is followed by its n observation lines. The header
is carried forward in levels: inside bounded chunks of a file block, then across the
chunks of a block, the blocks of a file and, if asked for, the files of a basin, through
a table with one row per chunk. No task sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracktally.functions.text import compact_date, field, fields, int_part, signed_degrees
from tracktally.session import written_once

# The first eight fields of an observation line.
DETAIL_FIELDS = ["DATE", "TIME", "RECORD_ID", "STATUS", "LAT", "LON", "WIND", "PRESSURE"]
HEADER_PATTERN = r"^\s*[A-Z]{2}[0-9]{6,}\s*,"
CHUNK = ["BASIN", "FILE", "BLOCK", "CHUNK"]
CHUNK_BITS = 18  # at most 2^18 lines per chunk


def read_track_lines(spark: SparkSession, path: str, basin: str) -> DataFrame:
    """Text lines with their place: file, file block and row number of the scan."""
    return spark.read.text(path).select(
        F.lit(basin).alias("BASIN"),
        F.col("_metadata.file_path").alias("FILE"),
        F.col("_metadata.file_block_start").alias("BLOCK"),
        F.monotonically_increasing_id().alias("ROW"),
        "value",
    )


def stage_track_lines(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Parse every line once and fill headers inside chunks; written to shared storage.

    Row numbers and block borders depend on how a scan was split, so the rows are
    fixed by the write before two branches use them.
    """
    parts = fields(F.col("value"))
    is_header = F.col("value").rlike(HEADER_PATTERN)
    header = F.struct(
        F.col("ROW").alias("AT"),
        field(parts, 1).alias("STORM_ID"),
        field(parts, 2).alias("NAME"),
        field(parts, 3).try_cast("int").alias("N_TRACK"),
    )
    parsed = (
        lines.filter(F.trim("value") != "")
        .withColumn("CHUNK", F.shiftright("ROW", chunk_bits))
        .withColumn("IS_HEADER", is_header)
        .withColumn("OPENS", F.when(is_header, header))
        .withColumns({n: F.when(~is_header, field(parts, i))
                      for i, n in enumerate(DETAIL_FIELDS, start=1)})
        .drop("value")
    )
    so_far = W.partitionBy(*CHUNK).orderBy("ROW").rowsBetween(W.unboundedPreceding, 0)
    filled = parsed.withColumn("HEADER", F.last("OPENS", ignorenulls=True).over(so_far))
    return written_once(filled.drop("OPENS"), "track-lines")


def with_headers(staged: DataFrame, across_files: bool = False) -> DataFrame:
    """Every staged line with the header that governs it, across chunk borders.

    Only lines before the first header of their chunk meet the table of carried headers,
    which adaptive execution broadcasts when it is measured small. A file stands alone
    unless ``across_files`` says that the files of a basin are the parts of one text,
    in the order of their names (shorter names first).
    """
    joined = staged.filter(F.col("HEADER").isNull()).drop("HEADER").join(
        _carried(staged, across_files).withColumnRenamed("CARRIED", "HEADER"), CHUNK, "left"
    )
    return staged.filter(F.col("HEADER").isNotNull()).unionByName(joined)


def _carried(staged: DataFrame, across_files: bool) -> DataFrame:
    """Last header before each chunk: of its block, else of the file's blocks before, else of files before.

    Each step hands on one row per place, so a task sees the chunks of a block, the
    blocks of a file, or the files of a basin.
    """
    chunks = staged.groupBy(*CHUNK).agg(
        F.min("ROW").alias("START"),
        F.max_by("HEADER", F.when(F.col("IS_HEADER"), F.col("ROW"))).alias("LAST_HEADER"),
    )

    def before(parts: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
        earlier = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return parts.withColumn(name, F.last("LAST_HEADER", ignorenulls=True).over(earlier))

    def rolled(parts: DataFrame, keys: list[str], order: Column) -> DataFrame:
        known = F.when(F.col("LAST_HEADER").isNotNull(), order)
        return parts.groupBy(*keys).agg(F.max_by("LAST_HEADER", known).alias("LAST_HEADER"))

    blocks = rolled(chunks, CHUNK[:3], F.col("START"))
    by_block = before(blocks, CHUNK[:2], [F.col("BLOCK")], "IN_FILE").drop("LAST_HEADER")
    out = before(chunks, CHUNK[:3], [F.col("START")], "IN_BLOCK").join(by_block, CHUNK[:3])
    levels = ["IN_BLOCK", "IN_FILE"]
    if across_files:
        files = rolled(blocks, CHUNK[:2], F.col("BLOCK"))
        by_file = before(files, CHUNK[:1], [F.length("FILE"), F.col("FILE")], "IN_BASIN")
        out = out.join(by_file.drop("LAST_HEADER"), CHUNK[:2])
        levels.append("IN_BASIN")
    return out.select(*CHUNK, F.coalesce(*levels).alias("CARRIED"))


def observations(staged: DataFrame, across_files: bool = False) -> DataFrame:
    """Detail rows with the id and name of their header; text fields as read."""
    return (
        with_headers(staged, across_files)
        .filter(~F.col("IS_HEADER") & F.col("HEADER").isNotNull())
        .select("BASIN", F.col("HEADER.STORM_ID").alias("STORM_ID"),
                F.col("HEADER.NAME").alias("NAME"), *DETAIL_FIELDS)
    )


def track_counts(staged: DataFrame, across_files: bool = False) -> DataFrame:
    """Announced and found observations per header; lines before any header have no id."""
    return (
        with_headers(staged, across_files)
        .groupBy("BASIN", F.col("HEADER.STORM_ID").alias("STORM_ID"), F.col("HEADER.AT").alias("AT"))
        .agg(F.max("HEADER.N_TRACK").alias("N_TRACK"),
             F.count_if(~F.col("IS_HEADER")).alias("N_FOUND"))
        .drop("AT")
    )


def rejected_tracks(staged: DataFrame, across_files: bool = False) -> DataFrame:
    """Headers whose announced count is missing, wrong or zero, and headerless lines."""
    return track_counts(staged, across_files).filter(
        F.col("N_TRACK").isNull() | (F.col("N_TRACK") != F.col("N_FOUND")) | (F.col("N_FOUND") == 0)
    )


def typed(observed: DataFrame, missing_codes: tuple[int, ...] = ()) -> DataFrame:
    """Dates, integers and signed coordinates.

    Missing-value codes of wind and pressure stay as they are unless listed.
    """
    def code(name: str):
        number = F.col(name).try_cast("int")
        if not missing_codes:
            return number
        return F.when(~number.isin(*missing_codes), number)

    return observed.withColumns({
        "YEAR": int_part(F.col("DATE"), 1, 4),
        "MONTH": int_part(F.col("DATE"), 5, 2),
        "DAY": int_part(F.col("DATE"), 7, 2),
        "DATE": compact_date(F.col("DATE")),
        "WIND": code("WIND"),
        "PRESSURE": code("PRESSURE"),
        "LAT": signed_degrees(F.col("LAT"), "N", "S"),
        "LON": signed_degrees(F.col("LON"), "E", "W"),
    })


def since(observed: DataFrame, year: int) -> DataFrame:
    """Keep observations from ``year`` on, judged by the date text."""
    return observed.filter(int_part(F.col("DATE"), 1, 4) >= year)
