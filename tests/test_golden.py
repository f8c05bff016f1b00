"""The small cases of FIXTURES.md, and brute force for what SQL does not express."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid import model
from labelgrid.functions import scalar
from labelgrid.operators import components, hierarchy, ordered, overlap, relabel, resample, stats, stencil
from labelgrid.operators.components import connected_components
from labelgrid.sources.volumes import from_array

GT = np.array([[1, 1, 0, 2], [1, 1, 0, 2], [0, 0, 0, 2], [3, 3, 3, 3]])
SEG = np.array([[1, 1, 0, 4], [1, 5, 0, 4], [0, 0, 0, 4], [3, 3, 6, 6]])


def table(spark, a):
    return from_array(spark, np.asarray(a))


def array(df, shape, column="label"):
    out = np.zeros(shape, float if column == "value" else int)
    for r in df.collect():
        out[tuple(r[a] for a in ("z", "y", "x")[-len(shape) :])] = r[column]
    return out


def pairs(spark, seg=SEG, gt=GT):
    return overlap.paired(table(spark, seg), table(spark, gt), ["z", "y", "x"])


def test_adapted_rand(spark):
    r = overlap.adapted_rand(pairs(spark)).first()
    assert (r["error"], r["precision"], r["recall"]) == pytest.approx((0.20588235294117652, 1.0, 0.6585365853658537))
    assert overlap.adapted_rand(pairs(spark, GT, GT)).first()["error"] == pytest.approx(0)


def test_voi(spark):
    r = overlap.voi(pairs(spark)).first()
    assert (r["split"], r["merge"]) == pytest.approx((0.658646590712412, 0.0))
    r = overlap.voi(pairs(spark, SEG, SEG)).first()
    assert (r["split"], r["merge"]) == pytest.approx((0, 0))


def test_boxes(spark):
    v = table(spark, SEG).drop("z")
    found = {tuple(r) for r in stats.bbox_all(v).collect()}
    assert found == {(1, 0, 1, 0, 1, 3), (3, 3, 3, 0, 1, 2), (4, 0, 2, 3, 3, 3), (5, 1, 1, 1, 1, 1), (6, 3, 3, 2, 3, 2)}
    assert stats.bbox_global(table(spark, np.zeros((2, 2), int))).count() == 0
    assert stats.merge_box({"xmin": 1, "xmax": 2, "cnt": 3}, {"xmin": 0, "xmax": 1, "cnt": 4}) == {"xmin": 0, "xmax": 2, "cnt": 7}


def test_counts_of_nearly_empty_volumes(spark):
    assert stats.label_count(table(spark, np.zeros((2, 2), int))).count() == 0
    assert [tuple(r) for r in stats.label_count(table(spark, [[0, 1], [1, 1]])).collect()] == [(1, 3)]


def test_best_match(spark):
    p = pairs(spark)
    out = overlap.best_match(p.select(F.col("gt").alias("a"), F.col("seg").alias("b")), stats.label_sizes(table(spark, GT)), stats.label_sizes(table(spark, SEG)))
    assert {tuple(r) for r in out.collect()} == {(1, 1, 4, 3, 3), (2, 4, 3, 3, 3), (3, 3, 4, 2, 2)}


def test_widen_border(spark):
    out = array(stencil.widen_border(table(spark, GT)), (1, 4, 4))[0]
    assert (out == [[1, 1, 0, 2], [1, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 0]]).all()


def test_erosion_and_sphericity(spark):
    v = table(spark, GT).drop("z")
    assert stencil.erode(v.where("label > 0").select("y", "x")).count() == 0
    found = {r["label"]: r["sphericity"] for r in stencil.sphericity(v).collect()}
    assert found == pytest.approx({1: 3.0464738926897774, 2: 3.3530783864394866, 3: 3.0464738926897774, 0: -1})


def test_component_relabel(spark):
    s = hierarchy.Sets(spark.createDataFrame([(i,) for i in range(4)], "id long")).union(spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"))
    assert sorted(tuple(r) for r in s.relabel().collect()) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert s.connected(0, 1) and not s.connected(1, 2) and len(s) == 4 and s.n_components == 2
    with pytest.raises(ValueError):
        s.find(9)


def test_shots_and_ema(spark):
    values = [0, 5, 6, 7, 0, 0, 8, 1, 9, 9, 9, 10]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "frame long, value double")
    rows = ordered.shots(df, "frame", "value", 0.2, 1.0, 3).orderBy("position").collect()
    assert [r["frame"] for r in rows] == [0, 1, 3, 8, 11, 11]
    assert [r["label"] for r in rows] == [1, 0, 1, 0, 1, 0]
    expected = [0, 0.5, 1.05, 1.645, 1.4805, 1.33245, 1.999205, 1.899284, 2.609356, 3.24842, 3.823578, 4.441221]
    assert [r["value"] for r in ordered.ema(df, "frame", "value").orderBy("frame").collect()] == pytest.approx(expected, abs=1e-6)


def test_clip_peak_matches_a_loop(spark):
    rnd = random.Random(4)
    values = [rnd.random() * 0.5 for _ in range(95)]
    now = np.array(values)
    for i in range(0, len(now) - 20, 10):
        if now[i : i + 21].max() >= 0.48:
            now[i : i + 21] = 0
    df = spark.createDataFrame(list(enumerate(values)), "frame long, value double")
    assert [r["value"] for r in ordered.clip_peak(df, "frame", "value", 0.48).orderBy("frame").collect()] == pytest.approx(list(now))


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([(197121,), (0,), (2**24 - 1,)], "v long")
    r, g, b = scalar.rgb_pack("v")
    rows = df.select("v", r.alias("r"), g.alias("g"), b.alias("b")).select("*", scalar.rgb_unpack("r", "g", "b").alias("w")).collect()
    assert [tuple(x)[1:4] for x in rows] == [(3, 2, 1), (0, 0, 0), (255, 255, 255)]
    assert all(x["v"] == x["w"] for x in rows)
    one = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").select(scalar.dim_pack(["a", "b", "c"], 10000).alias("p"))
    assert one.first()["p"] == 100020003
    assert tuple(one.select(*scalar.dim_unpack("p", 10000)).first()) == (1, 2, 3)


def test_split_chunks(spark):
    df = spark.range(10)
    got = [[r["id"] for r in ordered.split_chunks(df, c, 3, "id", 1).orderBy("id").collect()] for c in range(3)]
    assert got == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8], [8, 9]]


def parts_of(a, moves):
    """Components of an array by a plain search, named by the first voxel."""
    out, n = np.zeros(a.shape, int), 0
    for start in itertools.product(*map(range, a.shape)):
        if a[start] and not out[start]:
            n += 1
            stack = [start]
            out[start] = n
            while stack:
                p = stack.pop()
                for m in moves:
                    q = tuple(i + d for i, d in zip(p, m))
                    if all(0 <= i < s for i, s in zip(q, a.shape)) and a[q] == a[start] and not out[q]:
                        out[q] = n
                        stack.append(q)
    return out


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_voxel_components(spark, connectivity):
    a = np.random.default_rng(connectivity).integers(0, 3, (5, 7, 9))
    found = array(stencil.voxel_components(table(spark, a), connectivity, block=3), a.shape, "component")
    assert (found == parts_of(a, stencil.offsets(["z", "y", "x"], connectivity))).all()


def test_slice_components(spark):
    a = np.random.default_rng(1).integers(0, 3, (3, 6, 6))
    found = array(stencil.slice_components(table(spark, a), 8), a.shape, "component")
    for z in range(3):
        assert (found[z] == parts_of(a[z], stencil.offsets(["y", "x"], 8))).all()


def test_fill_holes(spark):
    a = np.zeros((7, 8), int)
    a[1:6, 1:6] = 2
    a[2:4, 2:4] = 0
    a[4, 4] = 5
    a[0, 7] = 1
    a[3, 6] = 0
    out = array(stencil.fill_holes(table(spark, a).drop("z")), a.shape)
    expected = a.copy()
    expected[2:4, 2:4] = 2
    assert (out == expected).all()  # the voxel of label 5 inside label 2 stays


def test_biggest_and_small_components(spark):
    a = np.array([[1, 1, 0, 1], [0, 0, 0, 0], [2, 0, 1, 1]])
    assert array(stencil.biggest_component(table(spark, a), 6), (1, 3, 4), "label")[0].tolist() == [[1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    kept = array(stencil.remove_small_components(table(spark, a), 2, 6), (1, 3, 4), "label")[0]
    assert (kept > 0).tolist() == [[True, True, False, False], [False] * 4, [False, False, True, True]]


def test_opening_and_closing(spark):
    a = np.zeros((9, 9), int)
    a[1:6, 1:6] = 1
    a[3, 6:9] = 1
    shape = {"y": 9, "x": 9}
    def moved(m, grow):
        out = m.copy() if grow else m.copy()
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            s = np.zeros_like(m)
            s[max(dy, 0) : 9 + min(dy, 0), max(dx, 0) : 9 + min(dx, 0)] = m[max(-dy, 0) : 9 + min(-dy, 0), max(-dx, 0) : 9 + min(-dx, 0)]
            out = out | s if grow else out & s
        return out
    m = a > 0
    opened = moved(moved(m, False), True)
    assert (array(stencil.opening(table(spark, a).drop("z"), shape, 1), (9, 9)) > 0).tolist() == opened.tolist()
    closed = moved(moved(m, True), False) | False
    got = array(stencil.closing(table(spark, a).drop("z"), shape, 1), (9, 9)) > 0
    assert got.tolist() == closed.tolist()


@pytest.mark.parametrize("small", [1 << 18, 60, 0])
def test_components_do_not_depend_on_order(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)]
    a = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    b = connected_components(spark.createDataFrame([(y, x) for x, y in reversed(edges)], "a long, b long").repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len({r["id"] for r in a}) == len(a)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for x, y in edges:
        if x is not None:
            x, y = sorted((root(x), root(y)))
            parent[y] = x
    assert {r["id"]: r["component"] for r in a} == {v: root(v) for v in list(parent)}


def test_numbered_is_dense(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long").repartition(5)
    rows = model.numbered(df, "k", start=1).collect()
    assert sorted((r["k"], r["number"]) for r in rows) == [(i, i + 1) for i in range(101)]


def test_reflect_pad_matches_numpy(spark):
    a = np.arange(20.0).reshape(4, 5)
    out = resample.reflect_pad(table(spark, a).drop("z"), {"y": (3, 1), "x": (0, 4)}, {"y": 4, "x": 5})
    assert (array(out, (8, 9), "value") == np.pad(a, ((3, 1), (0, 4)), "reflect")).all()


def test_percentile_clip_matches_numpy(spark):
    a = np.random.default_rng(0).random((9, 9))
    out = array(scalar.adjust(table(spark, a), "value").drop("value").withColumnRenamed("adjusted", "value"), (1, 9, 9), "value")
    assert out[0] == pytest.approx(np.clip(a, *np.percentile(a, [1, 99])))


def test_relabel_is_pure_and_strict_lookup_raises(spark):
    v = table(spark, GT)
    assert array(relabel.relabel(v, spark.createDataFrame([(1, 9)], "old long, new long")), (1, 4, 4)).max() == 9
    assert array(v, (1, 4, 4)).max() == 3
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    counts = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "k long, cnt long, o int")
    with pytest.raises(Exception, match="no count for key"):
        relabel.query_count_strict(keys, counts, "k", "o").collect()
    assert relabel.query_count_strict(keys.where("k = 1"), counts, "k", "o").first()["cnt"] == 6


def test_blank_fill(spark):
    a = np.array([[[0, 0]], [[1, 2]], [[0, 0]], [[0, 0]], [[3, 0]], [[0, 0]]])
    out = array(ordered.blank_fill(table(spark, a)), a.shape)
    assert out[:, 0].tolist() == [[1, 2], [1, 2], [1, 2], [1, 2], [3, 0], [3, 0]]


def test_clahe_of_a_flat_image_is_flat(spark):
    out = resample.clahe(table(spark, np.full((16, 16), 7)).withColumnRenamed("label", "value"), {"y": 16, "x": 16}, tiles=(2, 2))
    assert out.select("value").distinct().count() == 1


def test_gaussian_attention(spark):
    v = spark.range(3).select(scalar.gaussian_attention("id", 1, 2, 3, 4).alias("a")).collect()
    assert [r["a"] for r in v] == [round(math.exp(-((x - 1) ** 2 / (360 * 3) + (x - 2) ** 2 / (640 * 4)))) for x in range(3)]


@pytest.mark.parametrize("name", ["contingency", "seg_iou", "slice_tracking", "relabel_by_size", "acc_id_offset", "voxel_components"])
def test_results_do_not_depend_on_partitions(spark, sf, name):
    from labelgrid.plans import catalogue

    before, runs = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = catalogue.queries()[name](spark, sf)
        runs.append(sorted(map(repr, found.select(*sorted(found.columns)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1]


def test_scores_do_not_depend_on_label_names(spark):
    rng = np.random.default_rng(6)
    seg, gt = rng.integers(0, 5, (4, 9, 9)), rng.integers(0, 4, (4, 9, 9))
    names = np.array([0, 3, 4, 1, 2])
    score = lambda s: overlap.adapted_rand(pairs(spark, s, gt)).first()[:] + overlap.voi(pairs(spark, s, gt)).first()[:]
    assert score(seg) == pytest.approx(score(names[seg]))


def test_merging_boxes_commutes(spark):
    a, b = (stats.bbox_all(table(spark, v)) for v in (GT, SEG))
    assert sorted(map(tuple, stats.merge_boxes(a, b).collect())) == sorted(map(tuple, stats.merge_boxes(b, a).collect()))


def test_objects_from_slices(spark):
    a = np.array([[[1, 1, 0, 2]], [[0, 0, 0, 0]], [[5, 5, 0, 0]], [[7, 0, 0, 2]]])
    out = array(overlap.assembled(table(spark, a)), a.shape)
    assert out[:, 0].tolist() == [[1, 1, 0, 2], [0, 0, 0, 0], [1, 1, 0, 0], [1, 0, 0, 3]]


def test_whole_numbers_beyond_double_precision(spark):
    big = [2**53 + 1, 2**62 + 1, 2**62 + 2, 7, 0]
    df = spark.createDataFrame([(v,) for v in big], "v long")
    three = df.select("v", *[c.alias(n) for n, c in zip("abc", scalar.dim_unpack("v", 10**6))]).collect()
    assert all((r["a"], r["b"], r["c"]) == (r["v"] // 10**12 % 10**6, r["v"] // 10**6 % 10**6, r["v"] % 10**6) for r in three)
    found = df.select("v", scalar.ceil_div("v", 3).alias("c"), scalar.midpoint("v", F.lit(2**62 + 1)).alias("m"), scalar.midpoint(-F.col("v"), F.lit(0)).alias("n")).collect()
    assert all((r["c"], r["m"], r["n"]) == (-(-r["v"] // 3), (r["v"] + 2**62 + 1) // 2, -r["v"] // 2) for r in found)
    v = spark.createDataFrame([(0, 0, 0, 2**53 + 1), (0, 0, 1, 2**62), (0, 0, 2, 7)], "z int, y int, x int, label long")
    pairs_ = relabel.merge_pairs(v, v, ["z", "y", "x"], 0, 0).collect()
    assert {r["id0"] for r in pairs_} == {2**53 + 2, 2**53 + 1, 2**62, 2**62 - 1, 8, 7}


@pytest.mark.parametrize("cycle", [1, 2, 3, 5])
def test_a_cycle_of_parents_is_an_error(spark, cycle):
    rows = [(1 + i, 1 + (i + 1) % cycle, "a") for i in range(cycle)] + [(50, 1, "b"), (51, 50, "c"), (60, 0, "root"), (61, 60, "leaf")]
    df = spark.createDataFrame(rows, "nr long, parentnr long, name string")
    if cycle == 1:  # a segment that is its own parent is a root
        assert {r["id"]: r["new"] for r in hierarchy.hierarchy_relabel(df).collect()} == {1: 1, 50: 1, 51: 1, 60: 60, 61: 60}
        return
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.hierarchy_relabel(df)


def test_long_chains_of_parents(spark):
    df = spark.createDataFrame([(i + 1, i, "a") for i in range(300)], "nr long, parentnr long, name string")
    assert {r["new"] for r in hierarchy.hierarchy_relabel(df).collect()} == {1}


def test_scores_with_a_label_that_nearly_all_voxels_have(spark):
    rng = np.random.default_rng(3)
    seg, gt = rng.integers(0, 40, (5, 20, 20)), rng.integers(0, 30, (5, 20, 20))
    seg[rng.random(seg.shape) < 0.8], gt[rng.random(gt.shape) < 0.8] = 0, 0
    n = np.zeros((40, 30))
    np.add.at(n, (seg.ravel(), gt.ravel()), 1)
    rows, cols = n.sum(1), n.sum(0)
    log = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1)), 0)
    found = {(r["side"], r["label"]): r["entropy"] for r in overlap.vi_tables(pairs(spark, seg, gt)).collect()}
    for side, total, part in (("seg", rows, log(n).sum(1)), ("gt", cols, log(n).sum(0))):
        expected = {(side, i): (log(t) - p) / n.sum() for i, (t, p) in enumerate(zip(total, part)) if t}
        assert {k: v for k, v in found.items() if k[0] == side} == pytest.approx(expected, abs=1e-12)
    plan = overlap.adapted_rand(pairs(spark, seg, gt))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def grown(m, grow):
    wide, out = np.pad(m, 1), m.copy()
    for axis in range(m.ndim):
        for d in (-1, 1):
            s = np.roll(wide, d, axis)[(slice(1, -1),) * m.ndim]
            out = out | s if grow else out & s
    return out


@pytest.mark.parametrize("block, iterations", [(5, 1), (6, 4), (64, 4), (3, 5)])
def test_morphology_across_blocks(spark, block, iterations):
    rng = np.random.default_rng(block)
    a = np.kron(rng.integers(0, 3, (3, 5, 5)), np.ones((4, 4, 4), int)) * (rng.random((12, 20, 20)) < 0.995)
    shape, v = dict(zip("zyx", a.shape)), table(spark, a)
    fg = v.where("label > 0").select("label", "z", "y", "x")
    for name, steps in (("opening", (False, True)), ("closing", (True, False))):
        masks = {}
        for l in (1, 2):
            m = a == l
            for grow in steps:
                for _ in range(iterations):
                    m = grown(m, grow)
            masks[l] = m
        expected = np.where((a == 1) & masks[1] | (a == 2) & masks[2], a, np.where(a == 0, np.where(masks[1], 1, np.where(masks[2], 2, 0)), 0))
        found = getattr(stencil, name)(v, shape, iterations, block=block)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert (array(found, a.shape) == expected).all() and found.count() == a.size
    eroded = stencil.erode(fg, ["label"], iterations, block).collect()
    m1 = a == 1
    for _ in range(iterations):
        m1 = grown(m1, False)
    assert sorted((r["z"], r["y"], r["x"]) for r in eroded if r["label"] == 1) == sorted(map(tuple, np.argwhere(m1).tolist()))


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_ema_of_many_series_in_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(k, i, None if rnd.random() < 0.1 else rnd.random()) for k, n in (("a", 17), (None, 9), ("c", 1), ("d", 30)) for i in range(n)]
    expected, last, series = {}, None, object()
    for k, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last = v if k != series or last is None or v is None else last + 0.25 * (v - last)
        series = k
        expected[k, i] = last
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
    found = {(r["k"], r["i"]): r["v"] for r in ordered.ema(df, "i", "v", 0.25, ["k"], block=block).collect()}
    assert found.keys() == expected.keys()
    for key, v in expected.items():
        assert found[key] is None if v is None else found[key] == pytest.approx(v)


@pytest.mark.parametrize("threshold, window, stride", [(0.9, 20, 10), (0.97, 7, 3), (0.2, 5, 5), (0.8, 4, 6), (0.0, 6, 2)])
def test_clip_peak_of_many_series(spark, threshold, window, stride):
    rnd, rows, expected = random.Random(window), [], {}
    for k, n in (("a", 150), ("b", 7), ("c", 61), ("d", window), ("e", window + 1)):
        now = np.array([rnd.random() - 0.1 for _ in range(n)])
        rows += [(k, i, float(v)) for i, v in enumerate(now)]
        for i in range(0, len(now) - window, stride):
            if now[i : i + window + 1].max() >= threshold:
                now[i : i + window + 1] = 0
        expected |= {(k, i): v for i, v in enumerate(now)}
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    found = {(r["k"], r["i"]): r["v"] for r in ordered.clip_peak(df, "i", "v", threshold, window, stride, ["k"]).collect()}
    assert found == pytest.approx(expected)


def test_places_beyond_the_key_are_errors(spark):
    v = spark.createDataFrame([(0, 0, 1 << 21, 1)], "z int, y int, x int, label long")
    with pytest.raises(Exception, match="x is not within"):
        stencil.voxel_components(v)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_splines_against_a_linear_system(spark, order):
    rng = np.random.default_rng(order)
    n, m = 9, 23
    line = rng.random(n)
    mirrored = lambda k: k % (2 * n) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
    system = np.zeros((n, n))
    for i in range(n):
        for k in range(i - 4, i + 5):
            system[i, mirrored(k)] += float(resample.bspline(np.array([float(i - k)]), order)[0])
    coef = np.linalg.solve(system, line)
    at = np.arange(m) * (n - 1) / (m - 1)
    expected = [sum(coef[mirrored(k)] * float(resample.bspline(np.array([x - k]), order)[0]) for k in range(-6, n + 6)) for x in at]
    assert resample.spline_lines(line[None], m, order)[0] == pytest.approx(expected, abs=1e-9)
    assert resample.spline_lines(line[None], n, order)[0] == pytest.approx(line, abs=1e-9)
    a = rng.random((3, 6, 40))
    out = resample.resize(table(spark, a), {"z": 1, "y": 2.0, "x": 0.5}, {"z": 3, "y": 6, "x": 40}, order=order)
    rows = np.stack([resample.spline_lines(a[z].T, 12, order).T for z in range(3)])
    both = np.stack([resample.spline_lines(rows[z], 20, order) for z in range(3)])
    assert np.abs(array(out, (3, 12, 20), "value") - both).max() < 1e-9


def test_equalization_of_wide_values(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(100, 40_000, (2, 16, 16))
    a[1] = 7
    v = table(spark, a).withColumnRenamed("label", "value")
    out = array(resample.clahe_any(v, {"y": 16, "x": 16}, tiles=(2, 2)), a.shape, "value")
    low, high = a[0].min(), a[0].max()
    byte = ((a[0] - low) / (high - low) * 255).astype(np.uint8)
    eight = resample.clahe(table(spark, byte.astype(int)).withColumnRenamed("label", "value"), {"y": 16, "x": 16}, tiles=(2, 2))
    expected = (array(eight, (1, 16, 16), "value")[0] / 255 * (high - low) + low).astype(int)
    assert (out[0] == expected).all() and (out[1] == 7).all()


def test_elements_of_sets(spark):
    s = hierarchy.Sets(spark.createDataFrame([(i,) for i in (3, 5, 8)], "id long")).union(spark.createDataFrame([(5, 8), (20, 21)], "a long, b long"))
    assert s[8] == 5 and 20 in s and 9 not in s and sorted(s) == [3, 5, 8, 20, 21]
    assert {tuple(r) for r in s.found(spark.createDataFrame([(8,), (3,)], "x long")).collect()} == {(8, 5), (3, 3)}
    with pytest.raises(Exception, match="not an element"):
        s.found(spark.createDataFrame([(9,)], "x long")).collect()
    assert {tuple(r) for r in s.tied(spark.createDataFrame([(5, 8), (3, 5), (9, 9)], "x long, y long")).collect()} == {(5, 8, True), (3, 5, False), (9, 9, False)}
