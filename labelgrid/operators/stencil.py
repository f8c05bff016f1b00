"""Neighbourhood operators and connected components of voxels.

A neighbourhood is a dense block with a halo, a window where the table is dense, or an explode of
offsets followed by one aggregation. No operator joins a volume with itself.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import axes_of, numbered
from ..storage import written
from .components import connected_components, linked_minima
from .stats import bbox_all

BITS = 21  # of each coordinate in a voxel's key
BLOCK = 64  # voxels along a block's edge


def cross(axes: list[str]) -> list[tuple[int, ...]]:
    """Offsets of the 2 n neighbours that share a face."""
    return [tuple(s if i == j else 0 for j in range(len(axes))) for i in range(len(axes)) for s in (-1, 1)]


def offsets(axes: list[str], connectivity: int | None) -> list[tuple[int, ...]]:
    """Neighbour offsets for 4 or 8 in two dimensions, 6, 18 or 26 in three."""
    n = len(axes)
    reach = {2: {None: 1, 4: 1, 8: 2}, 3: {None: 1, 6: 1, 18: 2, 26: 3}}[n][connectivity]
    return [o for o in product((-1, 0, 1), repeat=n) if 0 < sum(map(abs, o)) <= reach]


def _moved(axes: list[str], moves) -> F.Column:
    """An array of shifted places, for explode."""
    return F.array(*[F.struct(*[(F.col(a) + d).cast("int").alias(a) for a, d in zip(axes, m)]) for m in moves])


def im2col(df: DataFrame, size: tuple[int, int], shape: tuple[int, int], step: int = 1, value: str = "value") -> DataFrame:
    """All windows of ``size`` that lie in the image, every ``step``: ``block, place, value``, both in row order."""
    (h, w), (rows, cols) = size, shape
    across = (cols - w) // step + 1
    each = F.explode(F.array(*[F.struct((F.col("y") - a).alias("y0"), (F.col("x") - b).alias("x0"), F.lit(a * w + b).alias("place")) for a in range(h) for b in range(w)])).alias("o")
    inside = F.expr(f"o.y0 between 0 and {rows - h} and o.x0 between 0 and {cols - w} and o.y0 % {step} = 0 and o.x0 % {step} = 0")
    block = (F.floor(F.col("o.y0") / step) * across + F.floor(F.col("o.x0") / step)).cast("long")
    return df.select(value, each).where(inside).select(block.alias("block"), F.col("o.place").alias("place"), value)


def widen_border(df: DataFrame, half: int = 1, label: str = "label") -> DataFrame:
    """Voxels with more than one positive label in their (2 half + 1) squared window become 0. The table must hold all voxels
    of a slice. Mirroring at the edge adds no voxel that the window lacks, so windows are just cut there."""
    by = [c for c in ("z",) if c in df.columns]
    top, low = F.max("_top"), F.min("_low")
    out = df.withColumns({"_top": F.col(label), "_low": F.when(F.col(label) > 0, F.col(label))})
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*by, across).orderBy(along).rangeBetween(-half, half)
        out = out.withColumns({"_t": top.over(w), "_l": low.over(w)}).withColumns({"_top": F.col("_t"), "_low": F.col("_l")}).drop("_t", "_l")
    return out.withColumn(label, F.when(F.col("_top") == F.col("_low"), F.col(label)).otherwise(0).cast("long")).drop("_top", "_low")


# --- erosion and dilation: dense blocks with a halo as wide as the number of steps, so that one shuffle is enough


def _halo_blocks(df: DataFrame, axes: list[str], halo: int, block: int) -> DataFrame:
    """Each voxel in every block whose halo holds it: columns ``_b`` and axis, and ``_own`` for the block that it lies in."""
    own = F.lit(True)
    for a in axes:
        low, high = (F.floor((F.col(a) + d) / block).cast("int") for d in (-halo, halo))
        df = df.withColumn(f"_b{a}", F.explode(F.sequence(low, high)))
        own = own & (F.col(f"_b{a}") == F.floor(F.col(a) / block))
    return df.withColumn("_own", own)


def _shifted(mask: np.ndarray, grow: bool) -> np.ndarray:
    """A mask after one step of dilation, or of erosion; outside the array there is nothing."""
    wide = np.pad(mask, 1)
    out = mask.copy()
    for axis in range(mask.ndim):
        for at in (0, 2):
            cut = tuple(slice(at, at + n) if i == axis else slice(1, -1) for i, n in enumerate(mask.shape))
            out = out | wide[cut] if grow else out & wide[cut]
    return out


def _moved_mask(places: np.ndarray, steps: list[tuple[bool, int]], shape: list[int] | None) -> np.ndarray:
    """Places of a mask (one column an axis) after steps (dilate or erode, how often); dilation stays inside ``shape``."""
    pad = sum(n for grow, n in steps if grow)
    low = places.min(axis=0) - pad
    mask = np.zeros(places.max(axis=0) + pad + 1 - low, bool)
    mask[tuple((places - low).T)] = True
    inside = tuple(slice(max(0, -b), max(0, n - b)) for b, n in zip(low, shape)) if shape else ()
    for grow, n in steps:
        for _ in range(n):
            mask = _shifted(mask, grow)
            if grow and shape:
                kept = np.zeros_like(mask)
                kept[inside] = mask[inside]
                mask = kept
    return np.argwhere(mask) + low


def _groups(table: pa.Table, keys: list[str]) -> list[np.ndarray]:
    """Row numbers of each combination of keys."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        _, part = np.unique(table[k].to_numpy(zero_copy_only=False), return_inverse=True)
        _, code = np.unique(code * (part.max(initial=0) + 1) + part, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def _places(table: pa.Table, axes: list[str]) -> np.ndarray:
    return np.stack([table[a].to_numpy().astype(np.int64) for a in axes], axis=1)


def _stepped(fg: DataFrame, steps: list[tuple[bool, int]], shape: dict[str, int] | None, keys: list[str], block: int) -> DataFrame:
    """Places of masks after steps: ``keys`` and axes. One mask a combination of keys."""
    axes, names = axes_of(fg), [*keys, *axes_of(fg)]
    bounds = [shape[a] for a in axes] if shape else None

    def step(key: tuple, table: pa.Table) -> pa.Table:
        first, at = np.array([k.as_py() for k in key]) * block, _places(table, axes)
        out = []
        for rows in _groups(table, keys):
            moved = _moved_mask(at[rows], steps, bounds)
            moved = moved[((moved >= first) & (moved < first + block)).all(axis=1)]
            named = table.select(keys).take(pa.array(np.full(len(moved), rows[0])))
            out.append(pa.table([*named.columns, *[pa.array(c, pa.int32()) for c in moved.T]], names=names))
        return pa.concat_tables(out)

    src = fg.select(*keys, *[F.col(a).cast("int").alias(a) for a in axes])
    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes)
    blocks = _halo_blocks(src, axes, sum(n for _, n in steps), block).drop("_own")
    return blocks.groupBy(*[f"_b{a}" for a in axes]).applyInArrow(step, schema)


def erode(fg: DataFrame, keys: list[str] = (), iterations: int = 1, block: int = BLOCK) -> DataFrame:
    """Places of a foreground (no other rows) whose face neighbours are all foreground; outside there is none."""
    return _stepped(fg, [(False, iterations)], None, list(keys), block)


def dilate(fg: DataFrame, shape: dict[str, int], keys: list[str] = (), iterations: int = 1, block: int = BLOCK) -> DataFrame:
    """Places of a foreground and their face neighbours inside the volume."""
    return _stepped(fg, [(True, iterations)], shape, list(keys), block)


def _relabelled(df: DataFrame, steps: list[tuple[bool, int]], shape: dict[str, int], label: str, block: int) -> DataFrame:
    """Labels after each label's mask took ``steps``: a voxel keeps its label if its mask holds it; background takes the least
    that does. Masks and labels of a block are settled in one task."""
    axes, names = axes_of(df), df.columns
    bounds = [shape[a] for a in axes]

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        first, at = np.array([k.as_py() for k in key]) * block, _places(table, axes)
        value, own = table[label].to_numpy().astype(np.int64), np.flatnonzero(table["_own"].to_numpy(zero_copy_only=False))
        here = np.full([block] * len(axes), -1)
        here[tuple((at[own] - first).T)] = np.arange(len(own))
        keeps, least, mine = np.zeros(len(own), bool), np.full(len(own), np.iinfo(np.int64).max), value[own]
        fg = np.flatnonzero(value > 0)
        order = fg[np.argsort(value[fg], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if len(order) else []:
            moved = _moved_mask(at[rows], steps, bounds) - first
            moved = moved[((moved >= 0) & (moved < block)).all(axis=1)]
            hit = here[tuple(moved.T)]
            hit = hit[hit >= 0]
            keeps[hit] |= mine[hit] == value[rows[0]]
            least[hit] = np.minimum(least[hit], value[rows[0]])
        taken = np.where((mine == 0) & (least < np.iinfo(np.int64).max), least, 0)
        new = pa.array(np.where(keeps, mine, taken), pa.int64())
        kept = table.select(names).take(pa.array(own))
        return kept.set_column(names.index(label), label, new)

    src = df.withColumn(label, F.col(label).cast("long"))
    blocks = _halo_blocks(src, axes, sum(n for _, n in steps), block).where(F.col("_own") | (F.col(label) > 0))
    return blocks.groupBy(*[f"_b{a}" for a in axes]).applyInArrow(settle, src.schema)


def _merged(df: DataFrame, masks: DataFrame, label: str) -> DataFrame:
    """Labels from one mask a label: a voxel keeps its label if its mask holds it; background takes the least that does."""
    axes = axes_of(df)
    masks = masks.select(*axes, F.col("label").alias("_l")).join(df.select(*axes, F.col(label).alias("_own")), axes)
    found = masks.groupBy(*axes).agg(F.bool_or(F.col("_l") == F.col("_own")).alias("_keeps"), F.min("_l").alias("_least"))
    new = F.when(F.col("_keeps"), F.col(label)).when(F.col(label) == 0, F.coalesce("_least", F.lit(0))).otherwise(0)
    return df.join(found, axes, "left").withColumn(label, new.cast("long")).select(*df.columns)


def opening(df: DataFrame, shape: dict[str, int], iterations: int = 4, label: str = "label", block: int = BLOCK) -> DataFrame:
    """Each label's mask eroded, then dilated."""
    return _relabelled(df, [(False, iterations), (True, iterations)], shape, label, block)


def closing(df: DataFrame, shape: dict[str, int], iterations: int = 4, label: str = "label", block: int = BLOCK) -> DataFrame:
    """Each label's mask dilated, then eroded; only background and own voxels are written."""
    return _relabelled(df, [(True, iterations), (False, iterations)], shape, label, block)


def fill_holes(df: DataFrame, label: str = "label", connectivity: int | None = None) -> DataFrame:
    """Each label's mask with the background pockets that do not reach the border of its box."""
    axes = axes_of(df)
    boxes = bbox_all(df, label)
    places = boxes
    for a in axes:
        places = places.withColumn(a, F.explode(F.sequence(f"{a}min", f"{a}max")))
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == F.col(f"{a}min")) | (F.col(a) == F.col(f"{a}max"))
    own = df.where(F.col(label) > 0).select(F.col(label).cast("long").alias("label"), *axes)
    rest = places.withColumn("_edge", edge).select("label", *axes, "_edge").join(own, ["label", *axes], "left_anti")
    parts = voxel_components(rest, connectivity, dense=False)
    holes = parts.groupBy("label", "component").agg(F.bool_or("_edge").alias("_open")).where("not _open").select("label", "component")
    filled = parts.join(holes, ["label", "component"], "left_semi").select("label", *axes)
    return _merged(df, own.unionByName(filled), label)


def sphericity(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, sphericity`` from each label's volume and the part of it that erosion of all foreground removes; -1 where
    nothing is removed, and for the background."""
    axes = axes_of(df)
    volume = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("v"))
    fg = df.where(F.col(label) > 0)
    left = erode(fg.select(*axes)).join(fg.select(*axes, F.col(label).cast("long").alias("label")), axes).groupBy("label").agg(F.count("*").alias("e"))
    gone = F.col("v") - F.coalesce("e", F.lit(0))
    value = math.pi ** (1 / 3) * F.pow(6.0 * F.col("v"), F.lit(2 / 3)) / gone
    return volume.join(left, "label", "left").select("label", F.when((F.col("label") > 0) & (gone > 0), value).otherwise(-1.0).alias("sphericity"))


# --- connected components


def place_key(axes: list[str]) -> F.Column:
    """A voxel's place as one number that orders like (z, y, x); places that it can't hold are errors."""
    out = F.lit(0).cast("long")
    for a in axes:
        beyond = F.raise_error(F.concat(F.lit(f"{a} is not within 0 to {2**BITS - 1}: "), F.col(a).cast("string"))).cast("int")
        out = F.shiftleft(out, BITS) + F.when(F.col(a).between(0, 2**BITS - 1), F.col(a)).otherwise(beyond)
    return out


def _block_labels(axes: list[str], moves: list[tuple[int, ...]], names: list[str]):
    forward = [m for m in moves if m > tuple(0 for _ in m)]

    def label(key: tuple, table: pa.Table) -> pa.Table:
        n = table.num_rows
        group = table["label"].to_numpy()
        places = [table[a].to_numpy().astype(np.int64) for a in axes]
        low = [p.min() - 1 for p in places]
        span = [int(p.max() - b) + 2 for p, b in zip(places, low)]
        flat = np.zeros(n, np.int64)
        for p, b, s in zip(places, low, span):
            flat = flat * s + (p - b)
        # equal labels are neighbours only inside their own key range, so one lookup table serves all
        _, kind = np.unique(group, return_inverse=True)
        size = int(np.prod(span))
        code = kind * size + flat
        order = np.argsort(code, kind="stable")
        code = code[order]
        ends = []
        for m in forward:
            step = 0
            for d, s in zip(m, span):
                step = step * s + d
            at = np.minimum(np.searchsorted(code, code + step), n - 1)
            hit = np.flatnonzero(code[at] == code + step)
            ends.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*ends))
        root = linked_minima(a, b, n)
        # the least place of each part names it
        out = np.empty(n, np.int64)
        keys = table["_key"].to_numpy()[order]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, keys)
        out[order] = least[root]
        return table.select(names).append_column("part", pa.array(out))

    return label


def voxel_components(df: DataFrame, connectivity: int | None = None, label: str = "label", block: int = 32, dense: bool = True) -> DataFrame:
    """Parts of neighbouring voxels with equal labels over 0, as ``component``: numbered from 1 in the order of their first
    voxel, or with ``dense=False`` named by label and the key of the first voxel.

    Blocks are labelled by themselves; only parts that meet at block faces enter the iteration over edges."""
    axes = axes_of(df)
    moves = offsets(axes, connectivity)
    fg = df.where(F.col(label) > 0).withColumn(label, F.col(label).cast("long")).withColumn("_key", place_key(axes))
    cells = [F.floor(F.col(a) / block).cast("int").alias(f"_c{a}") for a in axes]
    src = fg.select("*", *cells)
    if label != "label":
        src = src.withColumnRenamed("label", "_other").withColumnRenamed(label, "label") if "label" in src.columns else src.withColumnRenamed(label, "label")
    names = [c for c in src.columns if c not in ("_key",) and not c.startswith("_c")]
    schema = ", ".join(f"`{c}` {t}" for c, t in src.select(*names).dtypes) + ", part long"
    parts = written(src.groupBy(*[f"_c{a}" for a in axes]).applyInArrow(_block_labels(axes, moves, names), schema), "parts")
    forward = [m for m in moves if m > tuple(0 for _ in m)]
    # only voxels at a block's faces have neighbours in others
    face = F.lit(False)
    for a in axes:
        face = face | F.pmod(F.col(a), F.lit(block)).isin(0, block - 1)
    to = parts.where(face).select("label", *axes, "part", F.explode(_moved(axes, forward)).alias("p"))
    other_block = F.lit(False)
    for a in axes:
        other_block = other_block | (F.floor(F.col(a) / block) != F.floor(F.col(f"p.{a}") / block))
    to = to.where(other_block).select("label", F.col("part").alias("a"), *[F.col(f"p.{a}").alias(a) for a in axes])
    met = to.join(parts.select("label", *axes, F.col("part").alias("b")), ["label", *axes]).select("a", "b").distinct()
    roots = connected_components(met)
    named = parts.join(roots.select(F.col("id").alias("part"), "component"), "part", "left").withColumn("component", F.coalesce("component", "part")).drop("part")
    if dense:
        ids = numbered(named.select("component").distinct(), "component", name="_n", start=1)
        named = named.join(ids, "component").drop("component").withColumnRenamed("_n", "component")
    if label != "label":
        named = named.withColumnRenamed("label", label)
        named = named.withColumnRenamed("_other", "label") if "_other" in named.columns else named
    return named


def slice_components(df: DataFrame, connectivity: int | None = None, label: str = "label") -> DataFrame:
    """Components inside each slice; numbers begin at 1 in every slice."""
    # slices two apart are never neighbours
    apart = df.withColumn("z", F.col("z") * 2)
    parts = voxel_components(apart, {4: 6, 8: 26, None: 6}[connectivity], label, dense=False).withColumn("z", F.floor(F.col("z") / 2).cast("int"))
    first = parts.select("z", "component").distinct()
    number = F.row_number().over(Window.partitionBy("z").orderBy("component"))
    return parts.join(first.select("z", "component", number.cast("long").alias("_n")), ["z", "component"]).drop("component").withColumnRenamed("_n", "component")


def biggest_component(df: DataFrame, connectivity: int | None = None, label: str = "label") -> DataFrame:
    """The largest component only, labelled by its component's number."""
    from .relabel import biggest

    return biggest(voxel_components(df, connectivity, label).drop(label).withColumnRenamed("component", label), label).where(F.col(label) > 0)


def remove_small_components(df: DataFrame, threshold: int = 100, connectivity: int | None = None, label: str = "label", invert: bool = False) -> DataFrame:
    """Components of fewer than ``threshold`` voxels become 0."""
    from .relabel import remove_small

    return remove_small(voxel_components(df, connectivity, label).drop(label).withColumnRenamed("component", label), threshold, label, invert)
