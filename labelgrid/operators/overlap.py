"""Overlap of two labelings, segmentation scores, and tracking from slice to slice.

All scores come from the contingency table (one row a pair of labels), which is one
aggregation of the voxels; everything after it works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import xlogx


def paired(seg: DataFrame, gt: DataFrame, axes: list[str], label: str = "label") -> DataFrame:
    """Labels of two volumes at the same place: ``seg, gt``."""
    return seg.select(*axes, F.col(label).alias("seg")).join(gt.select(*axes, F.col(label).alias("gt")), axes)


def contingency(pairs: DataFrame, ignore_seg: list[int] = (), ignore_gt: list[int] = (), share: bool = False) -> DataFrame:
    """``seg, gt, n`` of paired labels, without ignored ones; with ``share`` also n over the sum."""
    if ignore_seg:
        pairs = pairs.where(~F.col("seg").isin(list(ignore_seg)))
    if ignore_gt:
        pairs = pairs.where(~F.col("gt").isin(list(ignore_gt)))
    table = pairs.groupBy(F.col("seg").cast("long").alias("seg"), F.col("gt").cast("long").alias("gt")).agg(F.count("*").alias("n"))
    if not share:
        return table
    total = table.agg(F.sum("n").alias("_all"))
    return table.crossJoin(F.broadcast(total)).select("seg", "gt", "n", (F.col("n") / F.col("_all")).alias("p"))


def adapted_rand(pairs: DataFrame) -> DataFrame:
    """``error, precision, recall`` of a segmentation against a ground truth whose label 0 is not counted."""
    table = contingency(pairs).withColumn("n", F.col("n").cast("double"))
    fg, both_fg = F.col("gt") > 0, (F.col("gt") > 0) & (F.col("seg") > 0)
    # pairs and both marginals from one pass over the pairs, combined before the shuffle; labels are never null, so null is "all"
    table = table.withColumns({"both": F.when(both_fg, F.col("n")), "lone": F.when(fg & (F.col("seg") == 0), F.col("n"))})
    sums = table.groupingSets([["seg", "gt"], ["gt"], ["seg"]], "seg", "gt").agg(F.grouping_id().alias("of"), *[F.sum(c).alias(c) for c in ("n", "both", "lone")])
    square = lambda c, where: F.sum(F.when(where, F.col(c) * F.col(c)))
    pair, by_gt, by_seg = F.col("of") == 0, F.col("of") == 2, F.col("of") == 1
    one = sums.agg(F.sum(F.when(pair, F.col("n"))).alias("n"), square("n", by_gt & fg).alias("a"), square("both", by_seg).alias("b"), square("both", pair).alias("ab"), F.sum(F.when(pair, F.col("lone"))).alias("c"))
    # foreground voxels that the segmentation leaves out add their share of all voxels to both sums
    zero = F.lit(0.0)
    lone = F.coalesce(F.col("c") / F.col("n"), zero)
    both = F.coalesce("ab", zero) + lone
    precision, recall = F.try_divide(both, F.coalesce("b", zero) + lone), F.try_divide(both, F.col("a"))
    f = F.try_divide(2 * precision * recall, precision + recall)
    return one.select((1 - f).alias("error"), precision.alias("precision"), recall.alias("recall"))


def vi_tables(pairs: DataFrame, ignore_seg: list[int] = (), ignore_gt: list[int] = ()) -> DataFrame:
    """Conditional entropy (bits) that each label adds: ``side, label, entropy``. Side ``seg``: of the ground truth inside
    the segment; side ``gt``: of the segmentation inside the true object."""
    # with m the label's voxels and N all voxels: -m/N sum (n/m) log2 (n/m) = (m log2 m - sum n log2 n) / N, so one
    # aggregation with both sides as grouping sets is enough
    table = contingency(pairs, ignore_seg, ignore_gt).withColumn("w", xlogx(F.col("n").cast("double")))
    total = table.agg(F.sum("n").alias("_all"))
    sums = table.groupingSets([["seg"], ["gt"]], "seg", "gt").agg(F.grouping_id().alias("of"), F.sum("n").cast("double").alias("m"), F.sum("w").alias("w"))
    side = F.when(F.col("of") == 1, "seg").otherwise("gt")
    entropy = F.greatest(xlogx(F.col("m")) - F.col("w"), F.lit(0.0)) / F.col("_all")
    return sums.crossJoin(F.broadcast(total)).select(side.alias("side"), F.coalesce("seg", "gt").alias("label"), entropy.alias("entropy"))


def split_vi(pairs: DataFrame, ignore_seg: list[int] = (), ignore_gt: list[int] = ()) -> DataFrame:
    """``under, over``: conditional entropies H(gt|seg) and H(seg|gt)."""
    t = vi_tables(pairs, ignore_seg, ignore_gt)
    zero = F.lit(0.0)
    return t.agg(F.coalesce(F.sum(F.when(F.col("side") == "seg", F.col("entropy"))), zero).alias("under"), F.coalesce(F.sum(F.when(F.col("side") == "gt", F.col("entropy"))), zero).alias("over"))


def voi(pairs: DataFrame, ignore_seg: list[int] = (), ignore_gt: list[int] = (0,)) -> DataFrame:
    """Variation of information: ``split`` = H(seg|gt), ``merge`` = H(gt|seg)."""
    return split_vi(pairs, ignore_seg, ignore_gt).select(F.col("over").alias("split"), F.col("under").alias("merge"))


def rand_score(seg: DataFrame, gt: DataFrame, axes: list[str], mask: DataFrame | None = None) -> DataFrame:
    """Adapted Rand of two volumes, with segmentation labels outside an optional mask set to 0."""
    from .relabel import masked

    if mask is not None:
        seg = masked(seg, mask, axes, clip=True)
    return adapted_rand(paired(seg, gt, axes))


def _confusion(pred: Column, gt: Column, threshold: Column) -> list[Column]:
    hit = pred > threshold
    return [F.count_if(hit & (gt == 1)).alias("tp"), F.count_if(hit & (gt == 0)).alias("fp"), F.count_if(~hit & (gt == 0)).alias("tn"), F.count_if(~hit & (gt == 1)).alias("fn")]


def confusion(rows: DataFrame, pred: str = "pred", gt: str = "gt", threshold: float = 0.5) -> DataFrame:
    """Confusion counts of predictions strictly over a threshold; truths other than 0 and 1 are not counted."""
    return rows.agg(*_confusion(F.col(pred), F.col(gt), F.lit(threshold)))


def binary_jaccard(rows: DataFrame, thresholds: list[float], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Per threshold: foreground IoU, mean IoU, precision and recall; NULL where a denominator is 0. One scan for all thresholds."""
    if not all(0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie between 0 and 1")
    wide = rows.agg(*[c.alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in zip(("tp", "fp", "tn", "fn"), _confusion(F.col(pred), F.col(gt), F.lit(t)))])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for i, t in enumerate(thresholds)])).alias("r")
    r = wide.select(each).select("r.*")
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    fg, bg = F.try_divide(tp, tp + fp + fn), F.try_divide(tn, tn + fp + fn)
    return r.select("threshold", fg.alias("fg_iou"), ((fg + bg) / 2).alias("mean_iou"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def best_match(pairs: DataFrame, sizes0: DataFrame, sizes1: DataFrame, keys: list[str] = (), min_iou: float | None = None) -> DataFrame:
    """For each label of the first side, the label of the second that it overlaps most (the smallest of equals):
    ``id0, id1, n0, n1, overlap``; zeros where nothing overlaps. ``pairs``: keys, a, b; sizes: keys, label, cnt.
    With ``min_iou``, only matches of a strictly larger IoU."""
    keys = list(keys)
    n = pairs.where("a > 0 and b > 0").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    top = n.groupBy(*keys, "a").agg(F.max(F.struct("n", (-F.col("b")).alias("neg"))).alias("top"))
    top = top.select(*keys, F.col("a").alias("id0"), (-F.col("top.neg")).alias("id1"), F.col("top.n").alias("overlap"))
    first = sizes0.where("label > 0").select(*keys, F.col("label").alias("id0"), F.col("cnt").alias("n0"))
    second = sizes1.where("label > 0").select(*keys, F.col("label").alias("id1"), F.col("cnt").alias("n1"))
    out = first.join(top, [*keys, "id0"], "left").join(second, [*keys, "id1"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select(*keys, F.col("id0").cast("long").alias("id0"), zero("id1"), "n0", zero("n1"), zero("overlap"))
    if min_iou is not None:
        out = out.where(F.col("overlap") / (F.col("n0") + F.col("n1") - F.col("overlap")) > min_iou)
    return out


def track(voxels: DataFrame, z: str = "z", axes: list[str] = ("y", "x"), label: str = "label", min_iou: float | None = None) -> DataFrame:
    """Best match of every label in a slice with the next slice that is not empty: ``z, id0, id1, n0, n1, overlap``, z being the
    later slice. All pairs of slices at once: the previous non-empty slice comes from a window over slices, not voxels.
    An empty slice gives the identity of the slice before it."""
    axes = list(axes)
    slices = voxels.groupBy(z).agg(F.max(label).alias("_top"))
    full = F.when(F.col("_top") > 0, F.col(z))
    before = Window.orderBy(z).rowsBetween(Window.unboundedPreceding, -1)
    prev = slices.select(F.col(z).alias("z"), F.last(full, ignorenulls=True).over(before).alias("prev"), (F.col("_top") > 0).alias("full")).where("prev is not null")
    fg = voxels.where(F.col(label) > 0).select(F.col(z).alias("z"), *axes, F.col(label).cast("long").alias("label"))
    sizes = fg.groupBy("z", "label").agg(F.count("*").alias("cnt"))
    earlier = fg.join(prev.where("full").select(F.col("prev").alias("z"), F.col("z").alias("_next")), "z").select(F.col("_next").alias("z"), *axes, F.col("label").alias("a"))
    pairs = earlier.join(fg.withColumnRenamed("label", "b"), ["z", *axes]).select("z", "a", "b")
    sizes0 = sizes.join(prev.select(F.col("prev").alias("z"), F.col("z").alias("_next"), "full"), "z").select(F.col("_next").alias("z"), "label", "cnt", "full")
    matched = best_match(pairs, sizes0.where("full").drop("full"), sizes, ["z"], min_iou)
    same = sizes0.where("not full").select("z", F.col("label").alias("id0"), F.col("label").alias("id1"), F.col("cnt").alias("n0"), F.col("cnt").alias("n1"), F.col("cnt").alias("overlap"))
    return matched.unionByName(same)


def assembled(voxels: DataFrame, z: str = "z", axes: list[str] = ("y", "x"), label: str = "label", min_iou: float = 0.0) -> DataFrame:
    """Labels of slices as objects of the volume: labels that ``track`` ties (over ``min_iou``) get one number, from 1 in the order
    of their first slice and label. Only the table of labels is iterated over; voxels are relabelled by one join."""
    from ..model import numbered
    from .components import connected_components

    axes = list(axes)
    name = lambda s, i: F.struct(F.col(s).cast("long").alias("z"), F.col(i).cast("long").alias("id"))
    fg = voxels.where(F.col(label) > 0)
    nodes = fg.select(F.col(z).alias("z"), F.col(label).alias("id")).distinct().select(name("z", "id").alias("node"))
    full = fg.select(F.col(z).alias("z")).distinct()
    slices = voxels.select(F.col(z).alias("z")).distinct().join(full.withColumn("_full", F.lit(True)), "z", "left")
    before = F.last(F.when(F.col("_full"), F.col("z")), ignorenulls=True).over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1))
    prev = slices.select("z", before.alias("_prev"), "_full").where("_full and _prev is not null").drop("_full")
    ties = track(voxels, z, axes, label, min_iou).where("overlap > 0").join(prev, "z").select(name("_prev", "id0").alias("a"), name("z", "id1").alias("b"))
    found = connected_components(ties).withColumnRenamed("id", "node")
    whole = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    ids = numbered(whole.select("component").distinct(), "component", name="_new", start=1)
    mapping = whole.join(ids, "component").select(F.col("node.z").alias("_z"), F.col("node.id").alias("_id"), "_new")
    out = voxels.join(mapping, (F.col(z) == F.col("_z")) & (F.col(label) == F.col("_id")), "left")
    return out.withColumn(label, F.coalesce("_new", F.lit(0)).cast("long")).select(*voxels.columns)
