"""Readers of volume files as voxel tables, by suffix.

Array files are Python data sources whose partitions are slabs of slices, so a task holds one slab
at a time; bounds on z given to the reader choose the slabs. (Bounds that Spark pushes into a Python
source stay with it for later queries of the same frame, so they are not used.) Formats whose library
is not installed raise ImportError with its name when they are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLAB_VOXELS = 1 << 22


class Slab(InputPartition):
    def __init__(self, path: str, dataset: str | None, low: int, high: int):
        self.path, self.dataset, self.low, self.high = path, dataset, low, high


def _npy(path: str, dataset: str | None):
    return np.load(path, mmap_mode="r")


def _h5(path: str, dataset: str | None):
    import h5py

    f = h5py.File(path, "r")
    names = list(f)
    if dataset is None and len(names) != 1:
        raise ValueError(f"name one of the datasets {names}")
    return f[dataset or names[0]]


def _zarr(path: str, dataset: str | None):
    import zarr

    g = zarr.open(path, mode="r")
    return g if hasattr(g, "shape") else g[dataset or sorted(g.array_keys())[0]]


def _nd2(path: str, dataset: str | None):
    import nd2

    frames = nd2.ND2File(path).to_dask()
    if dataset is None:
        return frames
    number = int(dataset)
    if not 0 <= number < frames.shape[0]:
        raise ValueError(f"the file has frames 0 to {frames.shape[0] - 1}")
    return frames[number]


def _tif(path: str, dataset: str | None):
    import tifffile

    return tifffile.memmap(path)


OPENERS: dict[str, Callable] = {".npy": _npy, ".h5": _h5, ".hdf5": _h5, ".zarr": _zarr, ".zip": _zarr, ".nd2": _nd2, ".tif": _tif, ".tiff": _tif}


def opened(path: str, dataset: str | None = None):
    """An array of the file that is read slice by slice."""
    for suffix, f in OPENERS.items():
        if path.endswith(suffix):
            return f(path, dataset)
    raise ValueError(f"no reader for {path}")


def datasets(path: str) -> list[str]:
    """Names of a file's datasets, or of a group's arrays."""
    if path.endswith((".h5", ".hdf5")):
        import h5py

        with h5py.File(path, "r") as f:
            return sorted(f)
    import zarr

    group = zarr.open(path, mode="r")
    return [] if hasattr(group, "shape") else sorted(group.array_keys())


def read_datasets(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Several datasets of a file by name, all of them by default."""
    return {n: read_volume(spark, path, n) for n in (datasets(path) if names is None else names)}


def shape(path: str, dataset: str | None = None) -> tuple[int, ...]:
    """A volume's shape from its header."""
    return tuple(opened(path, dataset).shape)


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dataset, self.voxels = options["path"], options.get("dataset"), int(options.get("slabvoxels", SLAB_VOXELS))
        self.low, self.high = int(options.get("zlow", 0)), int(options["zhigh"]) if "zhigh" in options else None

    def partitions(self) -> list[Slab]:
        dims = shape(self.path, self.dataset)
        dims = dims if len(dims) == 3 else (1, *dims)
        high = dims[0] if self.high is None else min(self.high, dims[0])
        step = max(1, self.voxels // max(1, dims[1] * dims[2]))
        return [Slab(self.path, self.dataset, z, min(z + step, high)) for z in range(max(0, self.low), high, step)] or [Slab(self.path, self.dataset, 0, 0)]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        array = opened(slab.path, slab.dataset)
        flat = len(array.shape) == 2
        for z in range(slab.low, slab.high):
            plane = np.asarray(array[...] if flat else array[z])
            if plane.dtype.kind == "u" and plane.size and plane.max() >= 1 << 63:
                raise ValueError("labels of 2**63 and more are not supported")
            y, x = np.divmod(np.arange(plane.size), plane.shape[1])
            value = plane.astype(np.float64 if plane.dtype.kind == "f" else np.int64).ravel()
            kind = pa.float64() if plane.dtype.kind == "f" else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, z), pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(value, kind)], names=["z", "y", "x", "value" if plane.dtype.kind == "f" else "label"])


class VolumeSource(DataSource):
    """``format("volume")``: options ``path``, ``dataset``, ``slabvoxels``, ``zlow``, ``zhigh`` (not included). Whole numbers are labels, others values."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        kind = np.dtype(opened(self.options["path"], self.options.get("dataset")).dtype).kind
        return "z int, y int, x int, value double" if kind == "f" else "z int, y int, x int, label bigint"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)


def read_volume(spark: SparkSession, path: str, dataset: str | None = None, z: tuple[int, int] | None = None) -> DataFrame:
    """Voxels of a volume by its suffix: Parquet tables, array files, images, trusted pickles of one array; of array files,
    only slabs of the slices ``z`` are read."""
    if path.endswith((".png", ".jpg", ".jpeg")) or "%" in path or "*" in path:
        return read_images(spark, path)
    if path.endswith(".pkl"):
        (array,) = read_pickles(path)
        return from_array(spark, np.asarray(array))
    if not path.endswith(tuple(OPENERS)):
        return spark.read.parquet(path)
    spark.dataSource.register(VolumeSource)
    reader = spark.read.format("volume")
    if dataset:
        reader = reader.option("dataset", dataset)
    if z:
        reader = reader.option("zlow", z[0]).option("zhigh", z[1])
    return reader.load(path)


def from_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """A small array of the driver as voxels."""
    flat = array.reshape((1, *array.shape)) if array.ndim == 2 else array
    z, y, x = (c.ravel().astype(np.int32) for c in np.indices(flat.shape))
    value = flat.ravel()
    name, kind = ("value", np.float64) if array.dtype.kind == "f" else ("label", np.int64)
    table = pa.table({"z": z, "y": y, "x": x, name: value.astype(kind)})
    return spark.createDataFrame(table)


def read_images(spark: SparkSession, path: str, segmentation: bool = False) -> DataFrame:
    """An image, or a folder of slices by a pattern with ``*`` or ``%d``: z is the place in the order of paths.
    ``z, y, x, c, value``, or with ``segmentation`` labels packed from red, green and blue."""
    found = spark.read.format("image").option("dropInvalid", True).load(path.replace("%d", "*") if "%d" in path else path)
    files = found.select("image.*")
    order = sorted(r["origin"] for r in files.select("origin").collect())
    place = spark.createDataFrame(list(enumerate(order)), "z int, origin string")
    n = F.col("height") * F.col("width") * F.col("nChannels")

    def voxels(batches):
        for batch in batches:
            for z, h, w, c, raw in zip(*(batch.column(k).to_pylist() for k in ("z", "height", "width", "nChannels", "data"))):
                a = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                a = a[:, :, ::-1] if c == 3 else a  # stored blue first
                y, x, k = (v.ravel().astype(np.int32) for v in np.indices(a.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, z), pa.int32()), pa.array(y), pa.array(x), pa.array(k), pa.array(a.ravel().astype(np.int32))], names=["z", "y", "x", "c", "value"])

    rows = files.where(n > 0).join(place, "origin").select("z", "height", "width", "nChannels", "data").mapInArrow(voxels, "z int, y int, x int, c int, value int")
    if not segmentation:
        return rows
    wide = rows.groupBy("z", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(n_) for i, n_ in enumerate("rgb")])
    from ..functions.scalar import unpack_image

    filled = wide.select("z", "y", "x", "r", F.coalesce("g", "r").alias("g"), F.coalesce("b", "r").alias("b"))
    return unpack_image(filled, "z").select("z", "y", "x", "label")


def read_pickles(path: str) -> list:
    """All objects of a trusted pickle file."""
    out = []
    with open(path, "rb") as f:
        while True:
            try:
                out.append(pickle.load(f))
            except EOFError:
                return out


def read_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def list_chunks(spark: SparkSession, folder: str, pattern: str = r"z(\d+)_y(\d+)_x(\d+)") -> DataFrame:
    """Chunk files of a folder with their place, in the order of their names: ``key, path, z0, y0, x0``."""
    from ..functions.scalar import chunk_start

    # listed through Hadoop, so that folders of any file system are read
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(x.getPath().getName(), x.getPath().toString().removeprefix("file:")) for x in found]
    files = spark.createDataFrame(rows, "key string, path string")
    return files.where(F.col("key").rlike(pattern)).select("key", "path", chunk_start("key", pattern).alias("c")).select("key", "path", "c.*").orderBy("key")


def read_tiles(spark: SparkSession, pattern: str, rows: range, columns: range, height: int, width: int) -> DataFrame:
    """A grid of tile images as one image; tiles that do not exist leave no voxels. One scan reads all tiles, and the names
    that the pattern gives are joined to the files found."""
    from ..functions.scalar import tile_name
    from ..operators.resample import stitch

    folder = pattern.rpartition("/")[0]
    places = spark.range(len(rows)).select((F.col("id") * rows.step + rows.start).alias("_r")).crossJoin(spark.range(len(columns)).select((F.col("id") * columns.step + columns.start).alias("_c")))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    places = places.select(last(tile_name(pattern, F.col("_r"), F.col("_c"))).alias("_name"), (F.col("_r") - rows[0]).alias("row"), (F.col("_c") - columns[0]).alias("column"))
    files = spark.read.format("image").option("dropInvalid", True).load(f"{folder}/*").select("image.*")
    found = files.withColumn("_name", last(F.col("origin"))).join(places, "_name").select("row", "column", "height", "width", "nChannels", "data")

    def first_channel(batches):
        for batch in batches:
            for r, k, h, w, c, raw in zip(*(batch.column(n).to_pylist() for n in ("row", "column", "height", "width", "nChannels", "data"))):
                a = np.frombuffer(raw, np.uint8).reshape(h, w, c)[:, :, -1 if c == 3 else 0]  # stored blue first
                y, x = (v.ravel().astype(np.int32) for v in np.indices(a.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, r)), pa.array(np.full(a.size, k)), pa.array(y), pa.array(x), pa.array(a.ravel().astype(np.int32))], names=["row", "column", "y", "x", "value"])

    parts = found.mapInArrow(first_channel, "row long, column long, y int, x int, value int")
    return stitch(parts, height, width).select("y", "x", "value")


def merge_chunks(chunks: DataFrame, chunk: list[str], offset: dict[str, str] | None = None, accumulate: bool = False, label: str = "label") -> DataFrame:
    """Voxels of chunk files in volume coordinates; with ``accumulate``, labels of chunks are made distinct."""
    from ..operators.relabel import offset_labels

    if accumulate:
        chunks = offset_labels(chunks, chunk, label)
    return chunks.withColumns({a: (F.col(a) + F.col(o)).cast("int") for a, o in (offset or {}).items()})


def read_bbox(spark: SparkSession, path: str, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int], dataset: str | None = None, ratio: dict[str, float] | None = None, order: int = 0) -> DataFrame:
    """A half-open box of a volume, moved to the origin and resized by ``ratio``. Only its slabs are read."""
    from ..operators.resample import resize, slices

    df = read_volume(spark, path, dataset, z if path.endswith(tuple(OPENERS)) else None)
    cut = slices(df, z, y, x)
    value = "label" if "label" in cut.columns else "value"
    return resize(cut, ratio, {"z": z[1] - z[0], "y": y[1] - y[0], "x": x[1] - x[0]}, value, order) if ratio else cut


def read_image(spark: SparkSession, path: str, crop: tuple[int, int, int, int] | None = None, ratio: dict[str, float] | None = None, shape: dict[str, int] | None = None, order: int = 0, segmentation: bool = False) -> DataFrame:
    """One image, resized (``shape`` is then its size) and cropped to (y0, y1, x0, x1), in this order."""
    from ..model import in_box
    from ..operators.resample import resize

    df = read_images(spark, path, segmentation).drop("z")
    if ratio:
        df = resize(df, ratio, shape, "label" if segmentation else "value", order)
    if crop:
        df = in_box(df, y=crop[:2], x=crop[2:]).withColumns({"y": F.col("y") - crop[0], "x": F.col("x") - crop[2]})
    return df


def tile_volume(tiles: DataFrame, height: int, width: int, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int], zstep: int = 1, shape: dict[str, int] | None = None, fill_blank: bool = False, value: str = "value") -> DataFrame:
    """A box of a tiled stack. ``tiles``: z, row, column, y and x inside the tile, and a value; only tiles that the box meets
    are read, places without a tile are 0, and the part of the box outside ``shape`` mirrors the volume.
    With ``fill_blank``, blank slices take the slice before them."""
    from ..operators.ordered import blank_fill
    from ..operators.resample import reflect_pad, slices, stitch

    size = {"z": z[1], "y": y[1], "x": x[1]} | (shape or {})
    inner = {a: (max(b[0], 0), min(b[1], size[a])) for a, b in (("z", z), ("y", y), ("x", x))}
    (z0, z1), (y0, y1), (x0, x1) = inner["z"], inner["y"], inner["x"]
    met = tiles.where(F.col("row").between(y0 // height, (y1 - 1) // height) & F.col("column").between(x0 // width, (x1 - 1) // width) & (F.col("z") >= z0) & (F.col("z") < z1))
    found = slices(stitch(met, height, width), *inner.values(), zstep)
    spark = tiles.sparkSession
    frame = spark.range(len(range(z0, z1, zstep))).select(F.col("id").cast("int").alias("z"))
    for a, n in (("y", y1 - y0), ("x", x1 - x0)):
        frame = frame.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = frame.join(found, ["z", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))
    if fill_blank:
        out = blank_fill(out, label=value)
    pad = {a: (max(-b[0], 0), max(b[1] - size[a], 0)) for a, b in (("y", y), ("x", x))}
    return reflect_pad(out, {a: p for a, p in pad.items() if any(p)}, {"y": y1 - y0, "x": x1 - x0}) if any(map(any, pad.values())) else out


def chunk_grid(chunks: DataFrame, size: tuple[int, int, int], z: tuple[int, int], y: tuple[int, int], x: tuple[int, int], channel: int = -1, step: tuple[int, int, int] = (1, 1, 1), accumulate: bool = False, mask: DataFrame | None = None, label: str = "label") -> DataFrame:
    """A box of a grid of chunk files. ``chunks``: cz, cy, cx, the place inside the chunk, perhaps a channel c, and a label; only
    chunks that the box meets are read. ``channel`` -1: the only one; -2: all. With ``accumulate``, labels of
    chunks are made distinct in chunk order; ``mask`` multiplies."""
    from ..operators.relabel import masked, offset_labels

    box = {"z": z, "y": y, "x": x}
    for (a, (low, high)), n in zip(box.items(), size):
        chunks = chunks.where(F.col(f"c{a}").between(low // n, (high - 1) // n))
    if "c" in chunks.columns and channel != -2:
        chunks = chunks.where(F.col("c") == max(channel, 0)).drop("c")
    if accumulate:
        chunks = offset_labels(chunks, ["cz", "cy", "cx"], label)
    for (a, (low, high)), n, s in zip(box.items(), size, step):
        at = F.col(a) + F.col(f"c{a}") * n
        chunks = chunks.withColumn(a, at.cast("int")).where((F.col(a) >= low) & (F.col(a) < high) & ((F.col(a) - low) % s == 0)).withColumn(a, F.floor((F.col(a) - low) / s).cast("int")).drop(f"c{a}")
    return masked(chunks, mask, ["z", "y", "x"], label) if mask is not None else chunks
