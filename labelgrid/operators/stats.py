"""Sizes, boxes and distinct ids of labels. Every operator is one aggregation, partial before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, axes_of


def label_count(df: DataFrame, label: str = "label", drop_zero: bool = False) -> DataFrame:
    """``label, cnt``. An all-background volume has no rows, and a 0/1 volume only label 1."""
    counts = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("cnt"))
    if drop_zero:
        return counts.where("label != 0")
    # both columns are used, so that the counts are computed once for both sides
    top = counts.agg(F.max(F.struct("label", "cnt")).alias("_top"))
    return counts.crossJoin(F.broadcast(top)).where("_top.label > 1 or (_top.label = 1 and label = 1)").drop("_top")


def label_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """Sizes of all labels but the background."""
    return label_count(df, label, drop_zero=True)


def sizes_over(sizes: DataFrame, thresholds: list[int]) -> DataFrame:
    """How many labels are larger than each threshold: ``threshold, labels``."""
    wide = sizes.agg(*[F.count_if(F.col("cnt") > t).alias(str(t)) for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"`{t}`").alias("labels")) for t in thresholds]))
    return wide.select(rows.alias("r")).select("r.*")


def large_labels(sizes: DataFrame, min_voxels: int = 10000) -> DataFrame:
    """Labels of strictly more than ``min_voxels`` voxels."""
    return sizes.where(F.col("cnt") > min_voxels)


def zcount(df: DataFrame, label: str = "label") -> DataFrame:
    """In how many slices each label occurs."""
    return df.where(F.col(label) > 0).groupBy(F.col(label).cast("long").alias("label")).agg(F.countDistinct("z").alias("slices"))


def unique_ids(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(F.col(label).cast("long").alias("label")).distinct()


def _extent(axes: list[str]):
    return [f(F.col(a)).cast("int").alias(f"{a}{m}") for a in axes for f, m in ((F.min, "min"), (F.max, "max"))]


def bbox_global(df: DataFrame, label: str = "label", count: bool = True) -> DataFrame:
    """One box around everything but the background; no row if there is nothing."""
    out = df.where(F.col(label) > 0).agg(*_extent(axes_of(df)), F.count("*").alias("cnt")).where("cnt > 0")
    return out if count else out.drop("cnt")


def bbox_all(df: DataFrame, label: str = "label", ids: DataFrame | None = None, shape: dict[str, int] | None = None) -> DataFrame:
    """A box and a size for each label. With ``ids`` (column ``label``), one row for each of them: an absent id has
    min = the axis' size from ``shape``, max = -1 and no voxels."""
    axes = axes_of(df)
    boxes = df.where(F.col(label) > 0).groupBy(F.col(label).cast("long").alias("label")).agg(*_extent(axes), F.count("*").alias("cnt"))
    if ids is None:
        return boxes
    shape = shape or {}
    found = ids.select(F.col("label").cast("long")).distinct().join(boxes, "label", "left")
    cols = [c for a in axes for c in (F.coalesce(f"{a}min", F.lit(shape[a])).alias(f"{a}min"), F.coalesce(f"{a}max", F.lit(-1)).alias(f"{a}max"))]
    return found.select("label", *cols, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def merge_boxes(*boxes: DataFrame) -> DataFrame:
    """Boxes of several tables (or several rows a label) as one row a label: least minima, greatest maxima, summed sizes."""
    rows = reduce(DataFrame.unionByName, boxes)
    return rows.groupBy("label").agg(*_merged(rows))


def merge_all_boxes(boxes: DataFrame) -> DataFrame:
    """One box around all rows."""
    return boxes.agg(*_merged(boxes))


def _merged(rows: DataFrame):
    axes = [a for a in AXES if f"{a}min" in rows.columns]
    cols = [c for a in axes for c in (F.min(f"{a}min").alias(f"{a}min"), F.max(f"{a}max").alias(f"{a}max"))]
    return [*cols, F.sum("cnt").cast("long").alias("cnt")] if "cnt" in rows.columns else cols


def merge_box(a: dict, b: dict) -> dict:
    """Two boxes as dictionaries."""
    pick = {"min": min, "max": max}
    return {k: (a[k] + b[k] if k == "cnt" else pick[k[-3:]](a[k], b[k])) for k in a}


def shifted(boxes: DataFrame, chunk: str, axis: str, size: int) -> DataFrame:
    """Boxes in chunk coordinates, moved by the chunk's number times its size."""
    move = F.col(chunk) * size
    return boxes.withColumns({f"{axis}min": (F.col(f"{axis}min") + move).cast("int"), f"{axis}max": (F.col(f"{axis}max") + move).cast("int")})


def border_faces(boxes: DataFrame, shape: dict[str, int]) -> DataFrame:
    """How many faces of the volume each box touches: ``faces`` beside the box."""
    faces = reduce(lambda x, y: x + y, [(F.col(f"{a}min") == 0).cast("int") + (F.col(f"{a}max") == n - 1).cast("int") for a, n in shape.items()])
    return boxes.withColumn("faces", faces)


def chunk_extent(chunks: DataFrame) -> DataFrame:
    """Shape of the volume that chunks (z0, dz, ...) cover."""
    return chunks.agg(*[F.max(F.col(f"{a}0") + F.col(f"d{a}")).alias(a) for a in AXES])


def volume_shape(df: DataFrame) -> DataFrame:
    """Largest index plus one on each axis; minima and maxima come from file footers where the source can."""
    return df.agg(*[(F.max(a) + 1).alias(a) for a in axes_of(df)])
