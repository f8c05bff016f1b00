"""Lookups and relabelling. Lookup tables hold one row a label; joins with them are left to Catalyst,
which broadcasts a table only below its size limit and re-plans at run time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import numbered
from .stats import label_sizes


def consecutive(df: DataFrame, label: str = "label", by_size: bool = False) -> DataFrame:
    """``old, new``: labels numbered from 1, by id, or by falling size with ties by id."""
    sizes = label_sizes(df, label)
    order = [F.desc("cnt"), F.asc("label")] if by_size else [F.asc("label")]
    return numbered(sizes, *order, name="new", start=1).select(F.col("label").alias("old"), "new")


def relabel(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Labels by a table ``old, new``; labels that it lacks become 0."""
    found = df.join(mapping.select(F.col("old").alias(label), F.col("new").alias("_new")), label, "left")
    return found.withColumn(label, F.coalesce("_new", F.lit(0)).cast("long")).select(*df.columns)


def remove_ids(df: DataFrame, ids: Iterable[int] | DataFrame, label: str = "label", invert: bool = False) -> DataFrame:
    """Listed labels become 0, or with ``invert`` all others. ``ids``: a short list, or a table with a column ``label``."""
    if isinstance(ids, DataFrame):
        listed = ids.select(F.col("label").alias(label), F.lit(True).alias("_listed")).distinct()
        df, keep = df.join(listed, label, "left").select(*df.columns, F.col("_listed").isNotNull().alias("_hit")), ~F.col("_hit")
    else:
        df, keep = df.withColumn("_hit", F.col(label).isin(list(ids))), ~F.col("_hit")
    keep = ~keep if invert else keep
    return df.withColumn(label, F.when(keep, F.col(label)).otherwise(0).cast("long")).drop("_hit")


def remove_small(df: DataFrame, threshold: int = 100, label: str = "label", invert: bool = False) -> DataFrame:
    """Labels of fewer than ``threshold`` voxels become 0; with ``invert``, all others do."""
    small = label_sizes(df, label).where(F.col("cnt") < threshold).select("label")
    return remove_ids(df, small, label, invert)


def biggest_label(df: DataFrame, label: str = "label") -> DataFrame:
    """The largest label, the smallest of equals: ``label, cnt`` in one row."""
    top = label_sizes(df, label).agg(F.max(F.struct("cnt", (-F.col("label")).alias("neg"))).alias("top"))
    return top.where("top is not null").select((-F.col("top.neg")).alias("label"), F.col("top.cnt").alias("cnt"))


def biggest(df: DataFrame, label: str = "label") -> DataFrame:
    """Everything but the largest label becomes 0."""
    return remove_ids(df, biggest_label(df, label), label, invert=True)


def query_in(keys: DataFrame, members: DataFrame, key: str, member: str | Column) -> DataFrame:
    """``keys`` with a flag ``found``: whether any member has the key. ``member`` may be a function of its columns."""
    member = F.col(member) if isinstance(member, str) else member
    return keys.join(members.select(member.alias(key)).distinct().withColumn("_in", F.lit(True)), key, "left").select(*keys.columns, F.col("_in").isNotNull().alias("found"))


def query_count(keys: DataFrame, counts: DataFrame, key: str, cnt: str = "cnt", default: int = 0, above: int = 0) -> DataFrame:
    """``keys`` with their count, ``default`` where there is none; counts of keys up to ``above`` are not looked at."""
    known = counts.where(F.col(key) > above).select(key, F.col(cnt).alias("_cnt"))
    return keys.join(known, key, "left").select(*keys.columns, F.coalesce("_cnt", F.lit(default)).cast("long").alias("cnt"))


def query_count_strict(keys: DataFrame, counts: DataFrame, key: str, order: str, cnt: str = "cnt") -> DataFrame:
    """Like ``query_count``, but an unknown key is an error, and of several counts the last by ``order`` holds."""
    last = counts.groupBy(key).agg(F.max_by(cnt, order).alias("_cnt"))
    found = F.coalesce("_cnt", F.raise_error(F.concat(F.lit("no count for key "), F.col(key).cast("string"))).cast("long"))
    return keys.join(last, key, "left").select(*keys.columns, found.cast("long").alias("cnt"))


def label_type(df: DataFrame, label: str = "label") -> DataFrame:
    """The narrowest unsigned type for the labels."""
    top = F.max(label)
    kind = F.when(top < 2**8, "uint8").when(top < 2**16, "uint16").when(top < 2**32, "uint32").otherwise("uint64")
    return df.agg(kind.alias("dtype"))


def masked(df: DataFrame, mask: DataFrame, axes: list[str], label: str = "label", value: str = "mask", clip: bool = False) -> DataFrame:
    """Labels times a mask at the same place, clipped to 0 and 1 first if asked; a place without a mask is 0."""
    m = F.least(F.greatest(F.col("_mask"), F.lit(0)), F.lit(1)) if clip else F.col("_mask")
    told = mask.select(*axes, F.col(value).alias("_mask"))
    return df.join(told, axes, "left").withColumn(label, (F.col(label) * F.coalesce(m, F.lit(0))).cast("long")).select(*df.columns)


def offset_labels(df: DataFrame, chunk: list[str], label: str = "label") -> DataFrame:
    """Makes labels of chunks distinct: each chunk's labels rise by the sum of the largest labels of the chunks before it."""
    top = df.groupBy(*chunk).agg(F.max(label).alias("_top"))
    # one row a chunk
    before = top.withColumn("_before", F.coalesce(F.sum("_top").over(Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_top")
    moved = F.when(F.col(label) > 0, F.col(label) + F.col("_before")).otherwise(0)
    return df.join(before, chunk).withColumn(label, moved.cast("long")).select(*df.columns)


def merge_pairs(a: DataFrame, b: DataFrame, axes: list[str], offset_a: int, offset_b: int) -> DataFrame:
    """Pairs of instances that meet, of two volumes whose labels 2n-1 and 2n are the two sides of instance n: for each
    distinct pair, (2n, 2m) and (2n-1, 2m-1) with offsets. ``id0, id1``."""
    half = lambda c: F.shiftright(F.col(c).cast("long"), 1) + F.col(c).cast("long").bitwiseAND(F.lit(1))
    left, right = a.select(*axes, half("label").alias("a")), b.select(*axes, half("label").alias("b"))
    pairs = left.join(right, axes).where("a > 0 and b > 0").select("a", "b").distinct()
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    return pairs.select("a", "b", side).select((2 * F.col("a") - F.col("side") + offset_a).alias("id0"), (2 * F.col("b") - F.col("side") + offset_b).alias("id1"))
