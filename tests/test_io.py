"""Files: volumes in and out, segment metadata, documents, streams."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid import model
from labelgrid.operators import hierarchy, stats
from labelgrid.sinks import documents
from labelgrid.sinks import volumes as out
from labelgrid.sources import segments
from labelgrid.sources import volumes as src
from labelgrid.streaming import ingest


def as_array(df, shape, column="label"):
    a = np.zeros(shape, np.int64)
    for r in df.collect():
        a[r["z"], r["y"], r["x"]] = r[column]
    return a


@pytest.fixture()
def volume():
    return np.random.default_rng(3).integers(0, 5, (6, 7, 8))


def test_npy_round_trip_and_slab_pruning(spark, tmp_path, volume):
    np.save(tmp_path / "v.npy", volume.astype(np.uint16))
    df = src.read_volume(spark, str(tmp_path / "v.npy"))
    assert (as_array(df, volume.shape) == volume).all()
    part = src.read_volume(spark, str(tmp_path / "v.npy"), z=(2, 4))
    assert part.count() == 2 * 7 * 8 and (as_array(part, volume.shape)[2:4] == volume[2:4]).all()
    assert src.shape(str(tmp_path / "v.npy")) == (6, 7, 8)
    files = out.write_npy(df, f"file://{tmp_path}/out", volume.shape, slab=4).collect()
    assert (np.concatenate([np.load(r["file"]) for r in sorted(files)]) == volume).all()


def test_parquet_volume_by_block(spark, tmp_path, volume):
    out.write_volume(src.from_array(spark, volume), str(tmp_path / "v"), block=4)
    df = spark.read.parquet(str(tmp_path / "v"))
    assert (as_array(df, volume.shape) == volume).all() and df.where("label = 0").count() == 0
    box = model.in_blocks(df, 4, z=(1, 3), x=(4, 8))
    assert (as_array(box, volume.shape)[1:3, :, 4:] == volume[1:3, :, 4:]).all()
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert all(f"{c}#" in plan.split("PartitionFilters:")[1].split("]")[0] for c in ("cz", "cx"))


def test_pyramid_is_written_without_empty_blocks(spark, tmp_path):
    a = np.zeros((4, 8, 8), int)
    a[0, :2, :2] = 3
    out.write_pyramid(src.from_array(spark, a), str(tmp_path / "p"), 2, {"y": 2, "x": 2}, block=4)
    assert sorted(os.listdir(tmp_path / "p" / "mip=0")) == ["cz=0"]
    assert spark.read.parquet(str(tmp_path / "p")).where("mip = 1").count() == 1


def test_label_images_round_trip(spark, tmp_path):
    a = np.array([[[0, 70000], [513, 3]], [[5, 5], [5, 5]]])
    files = out.write_slices(src.from_array(spark, a), f"file://{tmp_path}/png", 2, 2).collect()
    assert len(files) == 2
    df = src.read_images(spark, f"{tmp_path}/png/*.png", segmentation=True)
    assert (as_array(df, a.shape)[0] == a[0]).all()


def test_pickles_and_yaml(tmp_path):
    out.write_pickles(str(tmp_path / "a.pkl"), [1], {"b": 2})
    assert src.read_pickles(str(tmp_path / "a.pkl")) == [[1], {"b": 2}]
    (tmp_path / "c.yml").write_text("a: [1, 2]\n")
    assert src.read_yaml(str(tmp_path / "c.yml")) == {"a": [1, 2]}


def test_unknown_and_missing_formats(spark):
    with pytest.raises(ValueError, match="no reader"):
        src.opened("x.bin")
    with pytest.raises(ImportError):
        src.opened("x.h5")


def test_chunk_listing_is_ordered_by_name(spark, tmp_path):
    for z in (2, 10):
        (tmp_path / f"c_z{z}_y0_x4.h5").write_text("")
    assert [r["z0"] for r in src.list_chunks(spark, str(tmp_path)).collect()] == [10, 2]


def test_segment_text_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 0, 2, 0, 2, 0, 2, 9), (2, 1, 5, 1, 5, 1, 5, 9), (3, 0, 1, 0, 1, 0, 1, 9)], model.BOX)
    tree = hierarchy.sibling_tree(boxes.withColumn("g", F.when(F.col("label") == 2, "bad").otherwise("good")), "g")
    lines = documents.segment_lines(documents.segment_rows(tree, boxes))
    out.write_lines(lines.unionByName(spark.createDataFrame([(None, "% a comment"), (None, "")], "nr long, line string")), str(tmp_path / "s"))
    found = segments.read_segments(spark, str(tmp_path / "s"))
    by = {r["nr"]: r for r in found.collect()}
    assert len(by) == 5 and by[1]["name"] == "seg1" and by[1]["nextnr"] == 3 and by[3]["prevnr"] == 1 and by[2]["anchorx"] == 3
    assert by[4]["name"] == "bad" and by[4]["childnr"] == 2 and by[5]["childnr"] == 1 and by[1]["parentnr"] == 5
    relabelled = {r["id"]: r["new"] for r in hierarchy.hierarchy_relabel(found).collect()}
    assert relabelled == {1: 5, 2: 0, 3: 5, 4: 0, 5: 5}


def test_point_annotations(spark, tmp_path):
    n = out.write_points(spark.createDataFrame([(3, 2, 1), (1, 1, 0)], "x long, y long, z long"), f"file://{tmp_path}/spatial0")
    raw = (tmp_path / "spatial0").read_bytes()
    assert n == 2 and struct.unpack("<Q", raw[:8]) == (2,) and struct.unpack("<6f", raw[8:32]) == (1, 1, 0, 3, 2, 1) and struct.unpack("<2Q", raw[32:]) == (0, 1)


def test_documents(spark):
    info = json.loads(documents.Pyramid((10, 11, 5), (9, 9, 20), [(1, 1, 1), (2, 2, 1)]).info(spark, "seg"))
    assert info["scales"][1]["size"] == [5, 6, 5] and info["scales"][1]["key"] == "18_18_20" and info["data_type"] == "uint32"
    assert json.loads(documents.annotation_info())["annotation_type"] == "POINT"
    page = documents.shot_page(spark.createDataFrame([(0, 0, 1), (1, 7, 0)], "position int, frame long, label int"))
    assert 'value="7"' in page and "shot_start,label," in page


def test_streamed_sizes_equal_batch_sizes(spark, tmp_path, volume):
    v = src.from_array(spark, volume)
    for z in range(6):
        v.where(F.col("z") == z).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.running_sizes(ingest.arriving(spark, str(tmp_path / "in"), v.schema, 1))
    q = stream.writeStream.format("memory").queryName("sizes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT label, cnt FROM sizes").collect())) == sorted(map(tuple, stats.label_sizes(v).collect()))


def test_ingest_resumes(spark, tmp_path, volume):
    v, seen = src.from_array(spark, volume), []
    for z in (0, 1):
        v.where(F.col("z") == z).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(ingest.arriving(spark, str(tmp_path / "in"), v.schema), lambda df, _: seen.append(df.count()), str(tmp_path / "c"))
        q.awaitTermination()
    assert sum(seen) == 2 * 7 * 8


def test_box_is_read_and_resized(spark, tmp_path, volume):
    np.save(tmp_path / "v.npy", volume)
    df = src.read_bbox(spark, str(tmp_path / "v.npy"), (1, 5), (0, 6), (2, 8), ratio={"x": 0.5})
    assert df.agg(F.max("z"), F.max("y"), F.max("x")).first()[:] == (3, 5, 2)
    assert (as_array(src.read_bbox(spark, str(tmp_path / "v.npy"), (1, 5), (0, 6), (2, 8)), (4, 6, 6)) == volume[1:5, :6, 2:8]).all()


def test_tiled_stack(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(1, 9, (3, 8, 6))
    a[1] = 0
    rows = [(z, y // 4, x // 3, y % 4, x % 3, int(a[z, y, x])) for z in range(3) for y in range(8) for x in range(6) if not (y < 4 and x >= 3)]
    tiles = spark.createDataFrame(rows, "z int, row int, column int, y int, x int, value int")
    whole = a.copy()
    whole[:, :4, 3:] = 0  # a tile is missing
    whole[1] = whole[0]
    out = src.tile_volume(tiles, 4, 3, (0, 3), (-2, 9), (1, 8), shape={"z": 3, "y": 8, "x": 6}, fill_blank=True)
    assert (as_array(out, (3, 11, 7), "value") == np.pad(whole[:, :, 1:], ((0, 0), (2, 1), (0, 2)), "reflect")).all()


def test_chunk_grid(spark):
    a = np.arange(1, 4 * 4 * 4 + 1).reshape(4, 4, 4) % 5
    rows = [(z // 2, y // 2, x // 2, 0, z % 2, y % 2, x % 2, int(a[z, y, x])) for z in range(4) for y in range(4) for x in range(4)]
    chunks = spark.createDataFrame(rows, "cz int, cy int, cx int, c int, z int, y int, x int, label long")
    got = src.chunk_grid(chunks, (2, 2, 2), (1, 4), (0, 4), (1, 3), step=(2, 1, 1))
    assert (as_array(got, (2, 4, 2)) == a[1:4:2, :, 1:3]).all()
    top, before, expected = {}, 0, np.zeros_like(a)
    for key in np.ndindex(2, 2, 2):
        part = tuple(slice(2 * k, 2 * k + 2) for k in key)
        expected[part] = np.where(a[part] > 0, a[part] + before, 0)
        before += a[part].max()
    assert (as_array(src.chunk_grid(chunks, (2, 2, 2), (0, 4), (0, 4), (0, 4), accumulate=True), (4, 4, 4)) == expected).all()


def test_raw_blocks(spark, tmp_path, volume):
    volume[:4, :4, :4] = 0
    files = [os.path.basename(r["file"]) for r in out.write_blocks(src.from_array(spark, volume), f"file://{tmp_path}", volume.shape, (4, 4, 4)).collect()]
    assert "0-4_0-4_0-4" not in files and "4-8_0-4_4-6" in files
    raw = np.frombuffer((tmp_path / "4-8_0-4_4-6").read_bytes(), "<u4").reshape(2, 4, 4)
    assert (raw == volume[4:6, :4, 4:8]).all()


def test_affinity_shards_resume(spark, tmp_path):
    rows = [(f"k{i}", c, 0, 0, x, 0.5) for i in range(4) for c in range(3) for x in range(2)]
    chunks = spark.createDataFrame(rows, "key string, c int, z int, y int, x int, value double")
    first = out.write_affinity(chunks, f"file://{tmp_path}", 0, 2).collect()
    assert sorted(r["key"] for r in first) == ["k0", "k2"]
    done = spark.createDataFrame([("k0",)], "key string")
    assert [r["key"] for r in out.write_affinity(chunks, f"file://{tmp_path}", 0, 2, done).collect()] == ["k2"]
    assert (tmp_path / "k2.raw").read_bytes() == bytes([128] * 6)


def test_job_scripts():
    from labelgrid import jobs

    scripts = jobs.submit_scripts("run -ji %d -jn %d", "j", 2)
    assert scripts[1].startswith("#!/bin/bash") and "run -ji 1 -jn 2" in scripts[1]
    assert jobs.parser().parse_args(["-t", "voi", "-i", "a", "-o", "b"]).job_num == 1
    assert documents.layer("a", "u", "seg", (30, 6, 8))["source"]["transform"]["outputDimensions"]["z"][0] == pytest.approx(30e-9)


def test_labels_of_chunks_are_numbered_as_they_arrive(spark, tmp_path):
    rows = [[("a", 0, 1), ("a", 1, 3), ("b", 0, 2), ("b", 1, 0)], [("c", 0, 1), ("c", 1, 4)], [("d", 0, 2)]]
    for run, part in enumerate(rows):
        spark.createDataFrame(part, "key string, x int, label long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.arriving(spark, f"{tmp_path}/in", "key string, x int, label long")
        ingest.number_chunks(stream, ["key"], f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = {(r["key"], r["x"]): r["label"] for r in spark.read.parquet(f"{tmp_path}/out/labels").collect()}
    assert found == {("a", 0): 1, ("a", 1): 3, ("b", 0): 5, ("b", 1): 0, ("c", 0): 6, ("c", 1): 9, ("d", 0): 11}


def test_tiles_are_read_in_one_scan(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 255, (8, 9))
    tiles = [(r, c, a[r * 4 : r * 4 + 4, c * 3 : c * 3 + 3]) for r in range(2) for c in range(3) if (r, c) != (1, 1)]
    for r, c, t in tiles:
        (tmp_path / f"t_{r + 5}_{c + 2}.png").write_bytes(out.png(t))
    found = src.read_tiles(spark, f"{tmp_path}/t_%d_%d.png", range(5, 7), range(2, 5), 4, 3)
    got = np.full(a.shape, -1)
    for r in found.collect():
        got[r["y"], r["x"]] = r["value"]
    expected = a.copy()
    expected[4:, 3:6] = -1
    assert (got == expected).all()
    assert src.read_tiles(spark, f"{tmp_path}/t_%d_%d.png", range(50, 51), range(2), 4, 3).count() == 0


class FakeH5(dict):
    """As much of h5py as is used, with arrays in memory."""

    files: dict = {}

    def __new__(cls, path, mode):
        if mode == "w":
            cls.files[path] = super().__new__(cls)
        return cls.files[path]

    def __init__(self, path, mode):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def create_dataset(self, name, shape, kind, compression):
        self[name] = np.full(shape, -1, kind)
        return self[name]


def test_h5_files_of_several_datasets(spark, tmp_path, monkeypatch, volume):
    import sys
    import types

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=FakeH5))
    path, other = str(tmp_path / "v.h5"), np.random.default_rng(4).random(volume.shape)
    out.write_h5(src.from_array(spark, volume), path, volume.shape, slab=4)
    assert (FakeH5.files[path]["main"] == volume).all() and src.datasets(path) == ["main"] and src.shape(path) == volume.shape
    out.write_h5({"seg": src.from_array(spark, volume), "again": src.from_array(spark, volume + 1)}, path, volume.shape, slab=5)
    assert src.datasets(path) == ["again", "seg"] and (src.opened(path, "again")[:] == volume + 1).all()
    with pytest.raises(ValueError, match="name one of"):
        src.opened(path)
    out.write_h5(src.from_array(spark, other), path, other.shape, column="value")
    assert (src.opened(path) == other).all()


def test_groups_and_frames_of_other_libraries(monkeypatch, volume):
    import sys
    import types

    class Group(dict):
        array_keys = dict.keys

    monkeypatch.setitem(sys.modules, "zarr", types.SimpleNamespace(open=lambda path, mode: volume if "flat" in path else Group(b=volume + 1, a=volume)))
    assert (src.opened("x.zarr") == volume).all() and (src.opened("x.zarr", "b") == volume + 1).all() and src.datasets("x.zarr") == ["a", "b"]
    assert src.shape("flat.zarr") == volume.shape and src.datasets("flat.zarr") == []
    monkeypatch.setitem(sys.modules, "nd2", types.SimpleNamespace(ND2File=lambda path: types.SimpleNamespace(to_dask=lambda: volume)))
    assert (src.opened("x.nd2", "2") == volume[2]).all() and src.shape("x.nd2") == volume.shape
    with pytest.raises(ValueError, match="frames 0 to 5"):
        src.opened("x.nd2", "6")
    monkeypatch.setitem(sys.modules, "tifffile", types.SimpleNamespace(memmap=lambda path: volume))
    assert (src.opened("x.tif") == volume).all()
