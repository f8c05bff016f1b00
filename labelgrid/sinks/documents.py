"""Small documents about volumes: pyramid info, tile catalogues, segment metadata, proofreading pages.

Everything that grows with the data is a DataFrame of lines; only descriptions of fixed size are built on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"im": ("image", "uint8", "jpeg"), "seg": ("segmentation", "uint32", "compressed_segmentation"), "skel": ("segmentation", "uint32", "raw")}


@dataclass(frozen=True)
class Pyramid:
    """Geometry of a served volume, all in x, y, z."""

    size: tuple[int, int, int]
    resolution: tuple[int, int, int]
    ratios: list[tuple[int, int, int]]
    chunk: tuple[int, int, int] = (64, 64, 64)
    offset: tuple[int, int, int] = (0, 0, 0)

    def scales(self, spark: SparkSession) -> DataFrame:
        """One row a level: ``mip, size, voxel_offset, resolution, key``, sizes and offsets rounded up."""
        rows = spark.createDataFrame([(i, list(r)) for i, r in enumerate(self.ratios)], "mip int, r array<int>")
        up = lambda values: F.array(*[F.floor((F.lit(v) + F.col("r")[i] - 1) / F.col("r")[i]).cast("long") for i, v in enumerate(values)])
        res = F.array(*[(F.lit(v) * F.col("r")[i]).cast("long") for i, v in enumerate(self.resolution)])
        return rows.select("mip", up(self.size).alias("size"), up(self.offset).alias("voxel_offset"), res.alias("resolution"), F.concat_ws("_", F.transform(res, lambda x: x.cast("string"))).alias("key"))

    def info(self, spark: SparkSession, kind: str = "im", channels: int = 1) -> str:
        """The info document of all levels."""
        layer, dtype, encoding = KINDS[kind]
        scales = [
            {"encoding": encoding, "chunk_sizes": [list(self.chunk)], "key": r["key"], "resolution": r["resolution"], "voxel_offset": r["voxel_offset"], "mesh": "mesh", "skeletons": "skeletons", "compressed_segmentation_block_size": [8, 8, 8], "size": r["size"]}
            for r in self.scales(spark).orderBy("mip").collect()
        ]
        return json.dumps({"num_channels": channels, "type": layer, "data_type": dtype, "scales": scales})

    def tile_setup(self, tile: tuple[int, int]) -> list[dict]:
        """For each level, whether blocks fit inside one tile (so tiles can be written one by one) or need whole sections."""
        out = []
        for i, r in enumerate(self.ratios):
            inside = all(tile[j] % (r[j] * self.chunk[j]) == 0 for j in range(2))
            out.append({"mip": i, "tilewise": inside, "block": list(self.chunk), "slices": self.chunk[2] * r[2]})
        return out


def annotation_info(key: str = "skel", resolution: tuple[int, int, int] = (1, 1, 1), lower: tuple = (0, 0, 0), upper: tuple = (1, 1, 1)) -> str:
    """The info document of point annotations in one block."""
    return json.dumps({
        "@type": "neuroglancer_annotations_v1", "annotation_type": "POINT", "properties": [], "relationships": [], "by_id": {"key": "by_id"}, "dimensions": {a: [r * 1e-9, "m"] for a, r in zip("xyz", resolution)},
        "lower_bound": list(lower), "upper_bound": list(upper), "spatial": [{"key": key, "grid_shape": [1, 1, 1], "chunk_size": [u - v for u, v in zip(upper, lower)], "limit": 1}],
    })


def tile_info(spark: SparkSession, size: tuple[int, int, int], tiles: tuple[int, int], pattern: str, pad: tuple[int, int] = (0, 0), ids: list[int] | None = None, start: int = 0, tile: int = 1024, origin: tuple[int, int] = (0, 0), dims: int = 1, ratio: int = 1, dtype: str = "uint8") -> DataFrame:
    """A tile catalogue as one JSON row; slice ids are mirrored at both ends of z by ``pad``."""
    own = F.array(*[F.lit(i) for i in ids]) if ids else F.sequence(F.lit(start), F.lit(start + size[0] - 1))
    parts = [F.reverse(F.slice(own, 2, F.lit(pad[0])))] if pad[0] else []
    parts.append(own)
    if pad[1]:
        parts.append(F.reverse(F.slice(own, F.size(own) - pad[1], F.lit(pad[1]))))
    names = F.transform(F.concat(*parts), lambda i: F.format_string(pattern, i))
    n = lambda v: F.lit(v).cast("int")
    cols = [names.alias("image"), n(size[0] + sum(pad)).alias("depth"), n(size[1]).alias("height"), n(size[2]).alias("width"), F.array(n(origin[0]), n(origin[1])).alias("tile_st"), F.lit(dtype).alias("dtype"), n(tiles[1]).alias("n_columns"), n(tiles[0]).alias("n_rows"), n(tile).alias("tile_size"), n(dims).alias("ndim"), n(ratio).alias("tile_ratio")]
    return spark.range(1).select(F.to_json(F.struct(*cols)).alias("json"))


def background(spark: SparkSession, first: int = 1) -> DataFrame:
    """The row of the background, with which each segment text begins; ``first``: the first segment of the top level."""
    from ..sources.segments import FIELDS

    fixed = {c: -1 for c in FIELDS if c.startswith(("anchor", "bbox"))} | {"nextnr": first}
    return spark.range(1).select(*[F.lit(fixed.get(c, 0)).cast("long").alias(c) for c in FIELDS], F.lit("Background").alias("name"))


def segment_lines(segments: DataFrame, first: int | None = None) -> DataFrame:
    """Segment metadata rows (the 24 numbers and a name) as lines of the text format: ``nr, line``. With ``first``, the background's
    line is one of them."""
    from ..sources.segments import FIELDS

    if first is not None:
        segments = segments.unionByName(background(segments.sparkSession, first).select(*segments.columns))
    return segments.select("nr", F.concat(F.concat_ws("   ", *[F.col(c).cast("string") for c in FIELDS]), F.lit('   "'), F.col("name"), F.lit('"')).alias("line"))


def segment_rows(tree: DataFrame, boxes: DataFrame) -> DataFrame:
    """All fields of segments from their links (``sibling_tree``) and boxes; a colour follows from the number."""
    from ..sources.segments import FIELDS

    box = boxes.select(F.col("label").alias("nr"), *[F.col(f"{a}{m}").alias(f"bbox{a}{i}") for i, m in ((1, "min"), (2, "max")) for a in "xyz"])
    both = tree.join(box, "nr", "left")
    color = F.pmod(F.xxhash64("nr"), F.lit(255**3))
    fixed = {"flags": F.lit(1), "red1": F.pmod(F.shiftright(color, 16), F.lit(256)), "green1": F.pmod(F.shiftright(color, 8), F.lit(256)), "blue1": F.pmod(color, F.lit(256)), "pattern1": F.lit(0), "red2": F.lit(255), "green2": F.lit(0), "blue2": F.lit(0), "pattern2": F.lit(0), "collapsednr": F.col("nr")}
    return both.select(*[(fixed[c] if c in fixed else F.coalesce(F.col(c), F.lit(-1)) if c.startswith("bbox") else F.col(c)).cast("long").alias(c) for c in FIELDS], "name")


def html_items(rows: DataFrame, start: str, label: str) -> DataFrame:
    """List items of a proofreading page."""
    safe = F.replace(F.replace(F.replace(F.col(label), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select("*", F.concat(F.lit('<li data-start="'), F.col(start).cast("string"), F.lit('">'), safe, F.lit("</li>")).alias("item"))


def shot_page(shots: DataFrame, title: str = "shots") -> str:
    """A page on which shot boundaries can be corrected and saved as CSV. Boundaries of one video only."""
    rows = shots.orderBy("position").collect()
    items = "\n".join(f'<tr><td><input value="{r["frame"]}"></td><td><input value="{r["label"]}"></td></tr>' for r in rows)
    script = "function save(){const t=[...document.querySelectorAll('tr')].map(r=>[...r.querySelectorAll('input')].map(i=>i.value).join(',')+',');const a=document.createElement('a');a.href='data:text/csv,'+encodeURIComponent('shot_start,label,\\n'+t.join('\\n'));a.download='shots.csv';a.click()}"
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>{script}</script></head><body><table>\n{items}\n</table><button onclick=\"save()\">CSV</button></body></html>"


def layer(name: str, source: str, kind: str = "im", resolution: tuple[int, int, int] = (1, 1, 1), offset: tuple[int, int, int] = (0, 0, 0)) -> dict:
    """A viewer layer. Resolution and offset are given in z, y, x and stand in x, y, z in the layer."""
    return {"name": name, "type": "image" if kind == "im" else "segmentation", "source": {"url": source, "transform": {"outputDimensions": {a: [r * 1e-9, "m"] for a, r in zip("xyz", resolution[::-1])}, "offset": list(offset[::-1])}}}
