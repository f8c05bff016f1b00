"""Resampling, pyramids, padding, and stitching of tiles and slices."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import axes_of


def decimate(df: DataFrame, ratio: dict[str, int], start: dict[str, int] | None = None) -> DataFrame:
    """Every ratio-th voxel on each axis, from ``start``; coordinates are divided."""
    for a, r in ratio.items():
        at = F.col(a) - (start or {}).get(a, 0)
        df = df.where((at >= 0) & (F.pmod(at, F.lit(r)) == 0)).withColumn(a, F.floor(at / r).cast("int"))
    return df


def chunk(df: DataFrame, number: int, height: int, ratio: dict[str, int] | None = None) -> DataFrame:
    """One slab of ``height`` slices (number -1: the slice at ``height`` alone), thinned from its own start."""
    if number < 0:
        return df.where(F.col("z") == height).withColumn("z", F.lit(0))
    slab = df.where((F.col("z") >= number * height) & (F.col("z") < (number + 1) * height)).withColumn("z", (F.col("z") - number * height).cast("int"))
    return decimate(slab, ratio or {})


def _cells(df: DataFrame, ratio: dict[str, int]):
    return [F.floor(F.col(a) / ratio.get(a, 1)).cast("int").alias(a) for a in axes_of(df)]


def average_pool(df: DataFrame, ratio: dict[str, int], value: str = "value") -> DataFrame:
    """Mean of each cell; cells at the edge have fewer voxels."""
    return df.groupBy(*_cells(df, ratio)).agg(F.avg(value).alias(value))


def mode_pool(df: DataFrame, ratio: dict[str, int], label: str = "label") -> DataFrame:
    """Commonest label of each cell, the smallest of equals. Two aggregations on the same cells: the second needs no shuffle."""
    axes = axes_of(df)
    counted = df.groupBy(*_cells(df, ratio), label).agg(F.count("*").alias("_n"))
    top = counted.groupBy(*axes).agg(F.max(F.struct("_n", (-F.col(label)).alias("neg"))).alias("_t"))
    return top.select(*axes, (-F.col("_t.neg")).cast("long").alias(label))


def pyramid(df: DataFrame, levels: int, ratio: dict[str, int], kind: str = "label", column: str | None = None) -> DataFrame:
    """All levels, each from the one below: ``mip`` from 0. ``kind``: "label" (mode) or "value" (mean)."""
    column = column or kind
    pool = mode_pool if kind == "label" else average_pool
    out, now = [df.withColumn("mip", F.lit(0))], df
    for level in range(1, levels):
        now = pool(now, ratio, column)
        out.append(now.withColumn("mip", F.lit(level)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def reflect_pad(df: DataFrame, pad: dict[str, tuple[int, int]], shape: dict[str, int]) -> DataFrame:
    """Mirrors the volume at its faces without repeating the edge. Coordinates begin at 0 of the padded volume."""
    for a, (low, high) in pad.items():
        n = shape[a]
        if max(low, high) >= n:
            raise ValueError(f"the padding of {a} must be smaller than its size")
        c = F.col(a)
        places = F.array(c + low, F.when((c >= 1) & (c <= low), low - c), F.when((c <= n - 2) & (c >= n - 1 - high), 2 * (n - 1) - c + low))
        df = df.withColumn(a, F.explode(F.filter(places, lambda p: p.isNotNull()))).withColumn(a, F.col(a).cast("int"))
    return df


#: Lines of an axis that one task resizes, along each other axis.
LINES = 32


def bspline(x: np.ndarray, order: int) -> np.ndarray:
    """The centred B-spline of an order."""
    out = np.zeros(np.shape(x))
    for j in range(order + 2):
        out += (-1) ** j * math.comb(order + 1, j) * np.maximum(x + (order + 1) / 2 - j, 0) ** order
    return out / math.factorial(order)


def spline_lines(lines: np.ndarray, m: int, order: int) -> np.ndarray:
    """Lines (rows) of n values as m values each: the spline through all values, mirrored at both ends with the edge repeated."""
    n = lines.shape[1]
    # the mirrored line is periodic, so its coefficients are a quotient of transforms
    whole = np.concatenate([lines, lines[:, ::-1]], axis=1)
    reach = np.arange(-(order // 2), order // 2 + 1)
    kernel = np.zeros(2 * n)
    np.add.at(kernel, reach % (2 * n), bspline(reach.astype(float), order))
    coef = np.fft.irfft(np.fft.rfft(whole, axis=1) / np.fft.rfft(kernel), 2 * n, axis=1)
    at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
    out = np.zeros((len(lines), m))
    for tap in range(-(order // 2) - 1, order // 2 + 3):
        k = np.floor(at).astype(np.int64) + tap
        out += coef[:, k % (2 * n)] * bspline(at - k, order)
    return out


def _spline_axis(df: DataFrame, axis: str, n: int, m: int, value: str, order: int) -> DataFrame:
    rest = [a for a in axes_of(df) if a != axis]
    names, kinds = df.columns, dict(df.dtypes)
    if set(names) != {*rest, axis, value}:
        raise ValueError(f"a volume of {[*rest, axis, value]} is needed")

    def zoom(key: tuple, table: pa.Table) -> pa.Table:
        places = np.stack([table[a].to_numpy() for a in rest] or [np.zeros(table.num_rows, np.int64)], axis=1)
        lines, row = np.unique(places, axis=0, return_inverse=True)
        dense = np.zeros((len(lines), n))
        dense[row.ravel(), table[axis].to_numpy()] = table[value].to_numpy()
        made = {a: np.repeat(lines[:, i], m) for i, a in enumerate(rest)}
        made |= {axis: np.tile(np.arange(m), len(lines)), value: spline_lines(dense, m, order).ravel()}
        return pa.table([pa.array(made[c], pa.float64() if c == value else pa.int32()) for c in names], names=names)

    schema = ", ".join(f"`{c}` {'double' if c == value else 'int'}" for c in names)
    src = df.select(*[F.col(c).cast("double" if c == value else "int").alias(c) for c in names])
    keys = [F.floor(F.col(a) / LINES).alias(f"_l{a}") for a in rest] or [F.lit(0).alias("_l")]
    return src.select("*", *keys).groupBy(*[f"_l{a}" for a in rest] or ["_l"]).applyInArrow(zoom, schema)


def resize(df: DataFrame, ratio: dict[str, float], shape: dict[str, int], value: str = "value", order: int = 0) -> DataFrame:
    """Spline zoom of order 0 (nearest), 1 (linear) or 2 to 5: ends of the axes are matched, sizes rounded; the volume is mirrored
    at its ends. A ratio of 1 is the identity.

    One explode and one aggregation an axis for orders 0 and 1: an input place knows which output places it feeds.
    Higher orders need whole lines of an axis, which are taken ``LINES`` squared at a time; the table must be dense."""
    if order not in range(6):
        raise ValueError("orders are 0 to 5")
    if order > 1:
        for a, r in ratio.items():
            df = df if r == 1 else _spline_axis(df, a, shape[a], max(1, int(shape[a] * r + 0.5)), value, order)
        return df
    for a, r in ratio.items():
        if r == 1:
            continue
        n = shape[a]
        m = max(1, int(n * r + 0.5))
        scale = (n - 1) / (m - 1) if m > 1 else 0.0
        spark = df.sparkSession
        at = F.col("id") * F.lit(scale)
        low = F.least(F.floor(at), F.lit(max(n - 2, 0))) if order else F.floor(at + 0.5)
        table = spark.range(m).select(F.col("id").cast("int").alias("_o"), low.cast("int").alias("_l"), (at - low).alias("_w"))
        if order == 0:
            table = table.select("_o", F.least(F.col("_l"), F.lit(n - 1)).alias(a), F.lit(1.0).alias("_w"))
        else:
            both = F.explode(F.array(F.struct(F.col("_l").alias("c"), (1 - F.col("_w")).alias("w")), F.struct((F.col("_l") + 1).alias("c"), F.col("_w").alias("w")))).alias("t")
            table = table.select("_o", both).select("_o", F.col("t.c").alias(a), F.col("t.w").alias("_w")).where(f"_w > 0 and {a} < {n}")
        # one row an output place and source of one axis
        moved = df.join(table, a).withColumn(a, F.col("_o"))
        rest = [c for c in df.columns if c not in (value, a)]
        df = moved.select(*df.columns) if order == 0 else moved.groupBy(*rest, a).agg(F.sum(F.col(value) * F.col("_w")).alias(value)).select(*df.columns)
    return df


def stitch(tiles: DataFrame, height: int, width: int, row: str = "row", column: str = "column") -> DataFrame:
    """Voxels of tiles (with the tile's row and column) in one image."""
    return tiles.withColumns({"y": (F.col("y") + F.col(row) * height).cast("int"), "x": (F.col("x") + F.col(column) * width).cast("int")}).drop(row, column)


def slices(df: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int], zstep: int = 1) -> DataFrame:
    """A crop of a stack, every ``zstep``-th slice, moved to the origin; the last slice belongs to it."""
    from ..model import in_box

    cut = in_box(df, z=z, y=y, x=x).where((F.col("z") - z[0]) % zstep == 0)
    return cut.withColumns({"z": F.floor((F.col("z") - z[0]) / zstep).cast("int"), "y": (F.col("y") - y[0]).cast("int"), "x": (F.col("x") - x[0]).cast("int")})


def trim(df: DataFrame, threshold: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The voxels inside the box of all values over a threshold, moved to the origin, and the half-open box."""
    axes = axes_of(df)
    over = df.where(F.col(value) > threshold).agg(*[c for a in axes for c in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))])
    inside = df.crossJoin(F.broadcast(over))
    for a in axes:
        inside = inside.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
    return inside.withColumns({a: (F.col(a) - F.col(f"{a}0")).cast("int") for a in axes}).select(*df.columns), over


def tile_ranges(spark, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int], parts: tuple[int, int, int]) -> DataFrame:
    """The volume cut into parts along x, y and z, the last taking the remainder: ``x0, x1, y0, y1, z0, z1``."""
    df = spark.range(1)
    for name, (low, high), n in zip("xyz", (x, y, z), parts):
        step = (high - low) // n
        df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        df = df.withColumns({f"{name}0": (F.col("_i") * step + low).cast("long"), f"{name}1": F.when(F.col("_i") == n - 1, F.lit(high)).otherwise((F.col("_i") + 1) * step + low).cast("long")}).drop("_i")
    return df.drop("id")


def map_blocks(df: DataFrame, function, schema: str, keys: list[str]):
    """A user's function of one block's Arrow table, run for every block: the hook for kernels that are not expressions."""
    return df.groupBy(*keys).applyInArrow(function, schema)


def clahe_any(df: DataFrame, shape: dict[str, int], value: str = "value", tiles: tuple[int, int] = (8, 8), limit: float = 2.0) -> DataFrame:
    """``clahe`` of values that are not 8-bit: each slice is brought to 0..255 by its own least and largest value, and back
    afterwards, in the type that it had (whole numbers are cut). A flat slice stays as it is."""
    by, kind = [c for c in ("z",) if c in df.columns], dict(df.dtypes)[value]
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    joined = lambda x: x.join(ends, by) if by else x.crossJoin(F.broadcast(ends))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    byte = joined(df).withColumn(value, F.floor(share * 255).cast("int")).drop("_a", "_b")
    out = joined(clahe(byte, shape, value, tiles, limit))
    return out.withColumn(value, (F.col(value) / 255 * (F.col("_b") - F.col("_a")) + F.col("_a")).cast(kind)).select(*df.columns)


def clahe(df: DataFrame, shape: dict[str, int], value: str = "value", tiles: tuple[int, int] = (8, 8), limit: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalization of 8-bit slices: clipped histograms per tile, looked up in the four nearest
    tiles and blended. Bins over the limit are cut and their excess spread over all bins."""
    by = [c for c in ("z",) if c in df.columns]
    h, w = -(-shape["y"] // tiles[0]), -(-shape["x"] // tiles[1])
    cell = [F.floor(F.col("y") / h).cast("int").alias("_ty"), F.floor(F.col("x") / w).cast("int").alias("_tx")]
    hist = df.groupBy(*by, *cell, F.col(value).cast("int").alias("_v")).agg(F.count("*").alias("_n"))
    area = Window.partitionBy(*by, "_ty", "_tx")
    hist = hist.withColumn("_all", F.sum("_n").over(area))
    most = F.greatest(F.lit(1), F.floor(limit * F.col("_all") / 256))
    hist = hist.withColumns({"_cut": F.least("_n", most), "_over": F.greatest(F.col("_n") - most, F.lit(0))})
    excess = F.sum("_over").over(area) / 256
    run = F.sum("_cut").over(area.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    # a tile's table as an array over the 256 values, so that values it lacks are found too
    known = hist.select(*by, "_ty", "_tx", "_v", run.alias("_c"), excess.alias("_e"), "_all")
    table = known.groupBy(*by, "_ty", "_tx").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_t"), F.max("_e").alias("_e"), F.max("_all").alias("_all"))
    near = []
    ny, nx = -(-shape["y"] // h), -(-shape["x"] // w)
    for axis, size, n in (("y", h, ny), ("x", w, nx)):
        at = (F.col(axis) + 0.5) / size - 0.5
        low = F.floor(at)
        first, second = F.greatest(low, F.lit(0)), F.least(low + 1, F.lit(n - 1))
        near.append(F.array(F.struct(first.cast("int").alias("t"), (1 - (at - low)).alias("w")), F.struct(second.cast("int").alias("t"), (at - low).alias("w"))))
    four = df.withColumn("_a", F.explode(near[0])).withColumn("_b", F.explode(near[1]))
    four = four.withColumns({"_ty": F.col("_a.t"), "_tx": F.col("_b.t"), "_w": F.col("_a.w") * F.col("_b.w")})
    met = four.join(table, [*by, "_ty", "_tx"])
    below = F.aggregate(F.filter("_t", lambda s: s["_v"] <= F.col(value)), F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["_c"]))
    looked = (below + F.col("_e") * (F.col(value) + 1)) * 255 / F.col("_all")
    rest = [c for c in df.columns if c != value]
    out = met.withColumn("_s", F.col("_w") * looked).groupBy(*rest, value).agg(F.sum("_s").alias("_s"))
    return out.select(*rest, F.least(F.greatest(F.floor(F.round("_s", 6) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(value))
