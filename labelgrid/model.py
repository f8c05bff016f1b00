"""The data model: a label volume is a table of voxels ``(z, y, x, label)``.

Label 0 is background, never NULL; maxima of boxes are inclusive, crop bounds half-open;
ties go to the smallest id. Axes are columns, so no operator relies on their position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

AXES = ("z", "y", "x")
VOXEL = T.StructType([T.StructField("z", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.LongType())])
BOX = T.StructType([T.StructField("label", T.LongType()), *[T.StructField(f"{a}{m}", T.IntegerType()) for a in AXES for m in ("min", "max")], T.StructField("cnt", T.LongType())])
MATCH = T.StructType([T.StructField(c, T.LongType()) for c in ("id0", "id1", "n0", "n1", "overlap")])


def axes_of(df: DataFrame) -> list[str]:
    """The axes that a voxel table has, outermost first."""
    return [a for a in AXES if a in df.columns]


def foreground(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) > 0)


def in_box(df: DataFrame, **bounds: tuple[int | None, int | None]) -> DataFrame:
    """Voxels inside half-open bounds, for instance ``z=(0, 10)``; None is open. Plain comparisons reach the scan."""
    for axis, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.col(axis) >= low)
        if high is not None:
            df = df.where(F.col(axis) < high)
    return df


def block_of(axis: str, size: int) -> Column:
    return F.floor(F.col(axis) / size).cast("int")


def with_blocks(df: DataFrame, size: int = 64) -> DataFrame:
    """Adds block columns cz, cy, cx: the layout columns of a stored volume."""
    return df.select("*", *[block_of(a, size).alias(f"c{a}") for a in axes_of(df)])


def in_blocks(df: DataFrame, size: int = 64, **bounds: tuple[int | None, int | None]) -> DataFrame:
    """``in_box`` on a volume stored by ``with_blocks``: the box also prunes block partitions."""
    for axis, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.col(f"c{axis}") >= low // size)
        if high is not None:
            df = df.where(F.col(f"c{axis}") <= (high - 1) // size)
    return in_box(df, **bounds)


def numbered(df: DataFrame, *order: str | Column, name: str = "number", start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without gathering all rows in one task.

    Rows are dealt by ranges of the order and written; each range is numbered by itself, and the
    ranges' sizes (one row a range) give the offsets."""
    from pyspark.sql import Window

    order = [F.col(c) if isinstance(c, str) else c for c in order]
    held = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = held.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.join(F.broadcast(sizes), "_range").select(*df.columns, (inner + F.col("_before") - 1 + start).cast("long").alias(name))
