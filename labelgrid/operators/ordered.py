"""Ordered analytics: runs, folds, offsets, links and fills.

Windows run per series, or over tables of one row a slice, chunk or label. The two
filters whose every step needs the one before are folds in blocks of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import midpoint
from ..model import numbered
from ..storage import written


def minmax(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``value`` scaled to 0..1 (by series): NULL where all values are equal. Bounds come from an aggregation, joined back."""
    by = list(by)
    bounds = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    both = df.join(bounds, by) if by else df.crossJoin(F.broadcast(bounds))
    scaled = F.try_divide(F.col(value) - F.col("_low"), (F.col("_high") - F.col("_low")).cast("double"))
    return both.withColumn(value, scaled).select(*df.columns)


def _same(a, b) -> bool:
    return a is not None and a == b


def _fold(values: list, state: tuple | None, momentum: float):
    """Smoothed values as (a, l) for a * carry + l, and the last state; None where there is no value (yet)."""
    out = []
    for v in values:
        if v is None:
            state = None
        elif state is None:
            state = (0.0, v)
        else:
            state = (state[0] * (1 - momentum), state[1] + momentum * (v - state[1]))
        out.append(state)
    return out, state


def ema(df: DataFrame, order: str, value: str, momentum: float = 0.1, by: list[str] = (), block: int = 1 << 16) -> DataFrame:
    """Exponential smoothing that starts at the first value (and anew after a null): each step moves by ``momentum`` times the difference.

    Rows are numbered over all series and cut into blocks. Each step is linear in what came before, so a block tells what it
    makes of any carry in one row; carries pass along these rows, and blocks are smoothed with them, so that no task
    holds a series."""
    by = list(by)
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    keys = [f"_k{i}" for i in range(len(by))]
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    held = numbered(rows, *keys, "_o", name="_n").withColumns({"_b": F.floor(F.col("_n") / block), "_s": named})
    held = written(held, "series")

    def parts(table: pa.Table):
        """Rows in order, and where each series begins among them."""
        table = table.sort_by("_n")
        series = table["_s"].to_pylist()
        cuts = [i for i, s in enumerate(series) if i == 0 or s != series[i - 1]]
        return table, series, list(zip(cuts, [*cuts[1:], len(series)]))

    def told(key: tuple, table: pa.Table) -> pa.Table:
        table, series, runs_ = parts(table)
        values = table["_v"].to_pylist()
        (a, z), whole = runs_[-1], len(runs_) == 1
        fresh = _fold(values[a:z], None, momentum)[1]
        carried = _fold(values, (1.0, 0.0), momentum)[1] if whole else fresh
        ends = [x for s in (fresh, carried) for x in (s or (None, None))]
        return pa.table([[key[0].as_py()], [series[0]], [series[-1]], *[pa.array([x], pa.float64()) for x in ends]], schema=pa.schema(ends_of))

    ends_of = [("_b", pa.int64()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.float64()) for c in ("fresh_a", "fresh_l", "carry_a", "carry_l")]]
    edges = held.groupBy("_b").applyInArrow(told, "_b long, first string, last string, fresh_a double, fresh_l double, carry_a double, carry_l double")

    def pass_on(batches):
        """The carry into each block: None where its first series begins there, or has no value yet."""
        before, carry = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                on = _same(before, r["first"])
                carried = carry if on else None
                out.append(carried)
                a, l = (r["carry_a"], r["carry_l"]) if carried is not None else (r["fresh_a"], r["fresh_l"])
                before, carry = r["last"], None if l is None else a * (carried or 0.0) + l
            yield pa.RecordBatch.from_arrays([batch.column("_b"), pa.array(out, pa.float64())], names=["_b", "_c"])

    # one row a block
    carries = written(edges.repartition(1).sortWithinPartitions("_b").mapInArrow(pass_on, "_b long, _c double"), "carries")
    names = [*keys, "_o", "_v"]

    def smooth(key: tuple, table: pa.Table) -> pa.Table:
        table, _, runs_ = parts(table)
        values, carry, out = table["_v"].to_pylist(), table["_c"][0].as_py(), []
        for i, (a, z) in enumerate(runs_):
            start = (1.0, 0.0) if i == 0 and carry is not None else None
            out += [None if s is None else s[0] * (carry or 0.0) + s[1] for s in _fold(values[a:z], start, momentum)[0]]
        return table.select(names).set_column(len(names) - 1, "_v", pa.array(out, pa.float64()))

    schema = rows.schema
    done = held.join(carries, "_b").groupBy("_b").applyInArrow(smooth, schema)
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("_o").alias(order), F.col("_v").alias(value))


def clip_peak(df: DataFrame, order: str, value: str, threshold: float = 0.4, window: int = 20, stride: int = 10, by: list[str] = ()) -> DataFrame:
    """Zeroes every window (``window`` + 1 values, each ``stride``) that reaches the threshold, the earlier ones first: zeroed
    values no longer count for later windows.

    Whether a window is zeroed depends only on windows that overlap it and reach the threshold as they are. Islands of
    such windows are settled by themselves, one after another inside an island."""
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    held = written(numbered(rows, *keys, "_o", name="_n"), "series")
    ends = held.groupBy(*keys).agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    held = held.join(ends, keys) if keys else held.crossJoin(F.broadcast(ends))
    held = held.select(*keys, "_o", "_v", (F.col("_n") - F.col("_first")).alias("_p"), (F.col("_last") - F.col("_first")).alias("_top"))
    # windows that hold a place and end inside the series
    low = F.greatest(F.ceil((F.col("_p") - window) / stride), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("_p") / stride), F.floor((F.col("_top") - window) / stride)).cast("long")
    of = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))).alias("_w")
    each = held.where(F.col("_top") >= window).select(*keys, "_p", "_v", of)
    hot = each.groupBy(*keys, "_w").agg(F.max("_v").alias("_m"))
    hot = hot.where(F.col("_m") >= threshold) if threshold > 0 else hot  # zeroed values may reach a bound of 0
    inner = Window.partitionBy(*keys).orderBy("_w")
    apart = F.coalesce(F.col("_w") - F.lag("_w").over(inner) > window // stride, F.lit(True))
    islands = hot.withColumn("_new", apart.cast("int")).select(*keys, "_w", F.sum("_new").over(inner).alias("_i"))
    names = [*keys, "_w"]

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_w", "ascending"), ("_p", "ascending")])
        number, place, v = (table[c].to_numpy(zero_copy_only=False) for c in ("_w", "_p", "_v"))
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        gone, zeroed = [], -1
        for a, z in zip(cuts[:-1], cuts[1:]):
            now = np.where(place[a:z] <= zeroed, 0.0, v[a:z].astype(float))
            # places of earlier zeroed windows are those up to the last one's end, as windows that overlap lie without a gap
            if np.nanmax(now, initial=-np.inf) >= threshold:
                gone.append(a)
                zeroed = int(place[z - 1])
        return table.select(names).take(pa.array(gone, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in islands.select(names).dtypes)
    gone = each.join(islands, names).groupBy(*keys, "_i").applyInArrow(settle, schema)
    hit = gone.select(*keys, F.explode(F.sequence(F.col("_w") * stride, F.col("_w") * stride + window)).alias("_p")).distinct().withColumn("_z", F.lit(True))
    out = held.join(hit, [*keys, "_p"], "left")
    new = F.when(F.col("_z"), F.lit(0.0)).otherwise(F.col("_v"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("_o").alias(order), new.alias(value))


def runs(df: DataFrame, order: str, inside: Column, least: int = 1, by: list[str] = ()) -> DataFrame:
    """Maximal runs of consecutive ``order`` values where the predicate holds, of at least ``least``: ``first, last, n``."""
    by = list(by)
    hit = df.where(inside).select(*by, F.col(order).alias("_o"))
    island = hit.withColumn("_island", F.col("_o") - F.row_number().over(Window.partitionBy(*by).orderBy("_o")))
    out = island.groupBy(*by, "_island").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).drop("_island")


def shots(df: DataFrame, frame: str, value: str, low: float = 0.2, high: float = 1.0, least: int = 15, by: list[str] = (), peak: float | None = None, momentum: float | None = None) -> DataFrame:
    """Boundaries of shots: frame 0, first and last frame of each run within the band, the last frame. The feature is smoothed
    and cleared of peaks if asked for, and scaled to 0..1. ``position, frame, label``; labels alternate 1, 0."""
    by = list(by)
    if momentum is not None:
        df = minmax(ema(df, frame, value, momentum, by), value, by)
    if peak is not None:
        df = minmax(clip_peak(df, frame, value, peak, by=by), value, by)
    if momentum is None and peak is None:
        df = minmax(df, value, by)
    found = runs(df, frame, F.col(value).between(low, high), least, by)
    ends = df.groupBy(*by).agg(F.min(frame).alias("_first"), F.max(frame).alias("_last"))
    marks = ends.select(*by, F.lit(0).alias("_k"), F.col("_first").alias("frame")).unionByName(ends.select(*by, F.lit(2).alias("_k"), F.col("_last").alias("frame")))
    inner = found.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("first").alias("frame")), F.struct(F.lit(1).alias("_side"), F.col("last").alias("frame")))).alias("_m"))
    rows = marks.withColumn("_side", F.lit(0)).unionByName(inner.select(*by, F.lit(1).alias("_k"), F.col("_m.frame").alias("frame"), F.col("_m._side").alias("_side")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_k", "frame", "_side")) - 1
    return rows.withColumn("position", place.cast("int")).select(*by, "position", "frame", ((F.col("position") + 1) % 2).cast("int").alias("label"))


def linked(df: DataFrame, order: str, group: list[str] = ()) -> DataFrame:
    """Previous and next sibling (0: none) and the group's first child, in order."""
    by = Window.partitionBy(*group).orderBy(order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"prev": F.lag(order, 1, 0).over(by), "next": F.lead(order, 1, 0).over(by), "first_child": F.first(order).over(whole)})


def anchors(boxes: DataFrame) -> DataFrame:
    """Boxes (label, xmin..zmax) as a flat linked list with anchors at the middle of each box."""
    out = linked(boxes, "label")
    return out.select("label", *[midpoint(f"{a}min", f"{a}max").alias(f"anchor{a}") for a in "xyz"], "prev", "next")


def blank_fill(df: DataFrame, z: str = "z", axes: list[str] = ("y", "x"), label: str = "label", blank: Column | None = None) -> DataFrame:
    """Blank slices take the labels of the last slice before them that is not blank; those at the head, of the first after.
    ``blank``: an aggregate that marks a slice as blank, by default that it has no label over 0."""
    axes = list(axes)
    blank = blank if blank is not None else F.max(label) <= 0
    slices = df.groupBy(F.col(z).alias("_z")).agg(blank.alias("_blank"))
    full = F.when(~F.col("_blank"), F.col("_z"))
    back = F.last(full, ignorenulls=True).over(Window.orderBy("_z").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(full, ignorenulls=True).over(Window.orderBy("_z").rowsBetween(0, Window.unboundedFollowing))
    source = slices.select("_z", F.coalesce(back, ahead, F.col("_z")).alias("_from"))
    old = df.select(F.col(z).alias("_from"), *axes, label)
    return source.join(old, "_from").select(F.col("_z").alias(z), *axes, label)


def sharded(df: DataFrame, shard: int, shards: int, key: str) -> DataFrame:
    """Every ``shards``-th row in the order of the key, from row ``shard``."""
    from ..model import numbered

    return numbered(df, key, name="_i").where(F.col("_i") % shards == shard).drop("_i")


def split_chunks(df: DataFrame, chunk: int, chunks: int, key: str, overlap: int = 0) -> DataFrame:
    """One of ``chunks`` equal runs of rows in the order of the key (sizes rounded up), with ``overlap`` rows of the next."""
    from ..model import numbered

    total = df.count()
    size = -(-total // chunks)
    rows = numbered(df, key, name="_i")
    return rows.where((F.col("_i") >= chunk * size) & (F.col("_i") < (chunk + 1) * size + overlap)).drop("_i")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no marker yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")
