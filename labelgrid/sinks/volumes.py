"""Writers of volumes and annotations. The store of record is Parquet partitioned by block; other formats are
written by the tasks, one file a slice or block."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import with_blocks
from ..operators.resample import pyramid


def write_volume(df: DataFrame, path: str, block: int = 64, sparse: bool = True) -> None:
    """Voxels by block; background is not stored when ``sparse``. One task writes a block, so files do not multiply."""
    df = df.where("label > 0") if sparse and "label" in df.columns else df
    blocks = with_blocks(df, block)
    keys = [c for c in ("cz", "cy", "cx") if c in blocks.columns]
    blocks.repartition(*keys).sortWithinPartitions(*keys, "z" if "z" in df.columns else "y").write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_pyramid(df: DataFrame, path: str, levels: int, ratio: dict[str, int], kind: str = "label", block: int = 64) -> None:
    """All levels by level and block; blocks without anything are not written."""
    levels_ = pyramid(df, levels, ratio, kind)
    rows = with_blocks(levels_.where("label > 0") if kind == "label" else levels_, block)
    rows.repartition("mip", "cz", "cy", "cx").write.mode("overwrite").partitionBy("mip", "cz", "cy", "cx").parquet(path)


def png(pixels: np.ndarray) -> bytes:
    """A PNG of 8-bit grey or RGB pixels."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _written(folder: str, name: str, body: bytes) -> str:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(body)
    return f"{root}/{name}"


def write_slices(df: DataFrame, folder: str, height: int, width: int, pattern: str = "%04d.png", column: str = "label") -> DataFrame:
    """One PNG a slice: labels as colours, 8-bit values as grey. The files written, one row a slice."""

    def save(key: tuple, table: pa.Table) -> pa.Table:
        z = key[0].as_py()
        at = (table["y"].to_numpy(), table["x"].to_numpy())
        value = table[column].to_numpy().astype(np.int64)
        if column == "label":
            image = np.zeros((height, width, 3), np.uint8)
            for i, shift in enumerate((16, 8, 0)):
                image[(*at, i)] = value >> shift & 255
        else:
            image = np.zeros((height, width), np.uint8)
            image[at] = value
        return pa.table({"z": pa.array([z], pa.int32()), "file": [_written(folder, pattern % z, png(image))]})

    return df.groupBy("z").applyInArrow(save, "z int, file string")


def write_npy(df: DataFrame, folder: str, shape: tuple[int, int, int], column: str = "label", slab: int = 64) -> DataFrame:
    """A .npy file for each slab of slices. The files written."""
    def save(key: tuple, table: pa.Table) -> pa.Table:
        c = key[0].as_py()
        kind = np.float64 if pa.types.is_floating(table.schema.field(column).type) else np.int64
        out = np.zeros((min(slab, shape[0] - c * slab), *shape[1:]), kind)
        out[table["z"].to_numpy() - c * slab, table["y"].to_numpy(), table["x"].to_numpy()] = table[column].to_numpy()
        body = io.BytesIO()
        np.save(body, out)
        return pa.table({"slab": pa.array([c], pa.int32()), "file": [_written(folder, f"z{c * slab:06d}.npy", body.getvalue())]})

    return df.withColumn("_c", F.floor(F.col("z") / slab).cast("int")).groupBy("_c").applyInArrow(save, "slab int, file string")


def write_points(df: DataFrame, path: str) -> int:
    """Point annotations of one block, binary: the count, then x, y, z of each, then ids from 0 in the order of (z, y, x).
    The format is one file, so it is meant for tables that fit one."""
    rows = df.select(*[F.col(a).cast("float").alias(a) for a in "xyz"]).orderBy("z", "y", "x").toArrow()
    xyz = np.stack([rows[a].to_numpy() for a in "xyz"], axis=1).astype("<f4")
    folder, _, name = path.rpartition("/")
    _written(folder, name, struct.pack("<Q", len(xyz)) + xyz.tobytes() + np.arange(len(xyz), dtype="<u8").tobytes())
    return len(xyz)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pickles(path: str, *objects) -> None:
    """Small objects of the driver, one pickle after another."""
    import pickle

    with open(path, "wb") as f:
        for o in objects:
            pickle.dump(o, f)


def write_blocks(df: DataFrame, folder: str, shape: tuple[int, int, int], block: tuple[int, int, int] = (64, 64, 64), offset: tuple[int, int, int] = (0, 0, 0), column: str = "label", dtype: str = "<u4") -> DataFrame:
    """Raw blocks as a viewer reads them: one file a block, named by its range in x, y, z, with x running fastest. All numbers
    are in z, y, x. Blocks without anything are not written. The files written."""

    def save(key: tuple, table: pa.Table) -> pa.Table:
        low = [k.as_py() * b for k, b in zip(key, block)]
        high = [min(a + b, s) for a, b, s in zip(low, block, shape)]
        out = np.zeros([b - a for a, b in zip(low, high)], dtype)
        out[tuple(table[a].to_numpy() - o for a, o in zip("zyx", low))] = table[column].to_numpy()
        name = "_".join(f"{low[i] + offset[i]}-{high[i] + offset[i]}" for i in (2, 1, 0))
        return pa.table({"file": [_written(folder, name, out.tobytes())]})

    keys = [F.floor(F.col(a) / b).cast("int").alias(f"c{a}") for a, b in zip("zyx", block)]
    return df.where(F.col(column) > 0).select("*", *keys).groupBy("cz", "cy", "cx").applyInArrow(save, "file string")


def write_h5(volumes: DataFrame | dict[str, DataFrame], path: str, shape: tuple[int, int, int], dataset: str = "main", column: str = "label", slab: int = 64) -> None:
    """Compressed datasets of one file: a volume, or several by name. The format has one writer: tasks write dense slabs
    into the shared folder in one pass over each table, and the writer puts one slab after another into the file."""
    import h5py

    from ..storage import fresh

    many = volumes if isinstance(volumes, dict) else {dataset: volumes}
    with h5py.File(path, "w") as f:
        for name, df in many.items():
            kind = "f8" if dict(df.dtypes)[column] == "double" else "i8"
            out = f.create_dataset(name, shape, kind, compression="gzip")
            slabs = write_npy(df.select("z", "y", "x", column), _uri(fresh(df.sparkSession, "slabs")), shape, column, slab)
            for r in slabs.orderBy("slab").toLocalIterator():
                with pyarrow.fs.FileSystem.from_uri(_uri(r["file"]))[0].open_input_file(_uri(r["file"]).removeprefix("file://")) as part:
                    out[r["slab"] * slab : (r["slab"] + 1) * slab] = np.load(io.BytesIO(part.read()))


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_affinity(chunks: DataFrame, folder: str, shard: int = 0, shards: int = 1, done: DataFrame | None = None) -> DataFrame:
    """Quantized affinities of the chunks of one shard that are not marked as done: ``key`` of each written chunk.
    ``chunks``: key, c, z, y, x, value; the markers are what this returned before."""
    from ..functions.scalar import quantize
    from ..operators.ordered import not_done, sharded

    keys = sharded(chunks.select("key").distinct(), shard, shards, "key")
    if done is not None:
        keys = not_done(keys, done, "key")
    rows = chunks.join(keys, "key", "left_semi").withColumn("value", quantize("value"))

    def save(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        at = [table[a].to_numpy() for a in ("c", "z", "y", "x")]
        out = np.zeros([int(a.max()) + 1 for a in at], np.uint8)
        out[tuple(at)] = table["value"].to_numpy()
        _written(folder, f"{name}.raw", out.tobytes())
        return pa.table({"key": [name]})

    return rows.groupBy("key").applyInArrow(save, "key string")
