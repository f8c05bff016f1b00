"""Segment metadata text: comment lines, then 24 numbers and a quoted name a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the text format, in order.
FIELDS = [
    "nr", "flags", "red1", "green1", "blue1", "pattern1", "red2", "green2", "blue2", "pattern2", "anchorx", "anchory", "anchorz",
    "parentnr", "childnr", "prevnr", "nextnr", "collapsednr", "bboxx1", "bboxy1", "bboxz1", "bboxx2", "bboxy2", "bboxz2",
]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The numbers and ``name`` of each segment; comment and blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) != '' and not startswith(ltrim(value), '%')")
    return parsed(lines)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    number = F.split(F.trim(F.regexp_extract(column, '^([^"]*)"', 1)), r"\s+")
    name = F.regexp_extract(column, '"(.*)"', 1)
    return lines.select(number.alias("_n"), name.alias("name")).select(*[F.col("_n")[i].cast("long").alias(f) for i, f in enumerate(FIELDS)], "name")
