"""Skeleton graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_vectors(nodes: DataFrame, edges: DataFrame, by: list[str] = ("skeleton_id",), resolution: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """Squared length of each edge: its two ends looked up by equi-joins."""
    by = list(by)
    end = lambda e: nodes.select(*by, F.col("node").alias(e), *[F.col(a).alias(f"{e}_{a}") for a in "zyx"])
    both = edges.select(*by, "src", "dst").join(end("src"), [*by, "src"]).join(end("dst"), [*by, "dst"])
    d = [(F.col(f"src_{a}") - F.col(f"dst_{a}")) * float(r) for a, r in zip("zyx", resolution)]
    return both.select(*by, "src", "dst", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"))


def skeleton_norm(nodes: DataFrame, edges: DataFrame, by: list[str] = ("skeleton_id",), resolution=(1, 1, 1)) -> DataFrame:
    """Root of the summed squares of all edges of each skeleton."""
    return edge_vectors(nodes, edges, by, resolution).groupBy(*by).agg(F.sqrt(F.sum("d2")).alias("norm"))


def cable_length(nodes: DataFrame, edges: DataFrame, by: list[str] = ("skeleton_id",), resolution=(1, 1, 1)) -> DataFrame:
    """Summed lengths of all edges of each skeleton."""
    return edge_vectors(nodes, edges, by, resolution).groupBy(*by).agg(F.sum(F.sqrt("d2")).alias("length"))


def skeletons(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skeletons of a graph whose nodes have an ``id``: edges whose two ends share it, with node numbers inside each skeleton.
    Nodes ``node, id, z, y, x``; edges ``src, dst``."""
    local = F.row_number().over(Window.partitionBy("id").orderBy("node")) - 1
    numbered = nodes.select("id", "node", local.cast("long").alias("local"), "z", "y", "x")
    end = lambda e: numbered.select(F.col("node").alias(e), F.col("id").alias(f"{e}_id"), F.col("local").alias(f"{e}_local"))
    kept = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_id = dst_id")
    return numbered, kept.select(F.col("src_id").alias("id"), F.col("src_local").alias("src"), F.col("dst_local").alias("dst"))


def joined(nodes: DataFrame, edges: DataFrame, resolution=(1, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """All skeletons as one graph: local node numbers are moved behind those of the skeletons before. Skeletons without edges
    are left out and take no numbers. Nodes ``skeleton_id, node, z, y, x``; positions times resolution."""
    used = edges.select("skeleton_id").distinct()
    nodes = nodes.join(used, "skeleton_id", "left_semi")
    # one row a skeleton
    sizes = nodes.groupBy("skeleton_id").agg(F.count("*").alias("_n"))
    before = sizes.select("skeleton_id", (F.sum("_n").over(Window.orderBy("skeleton_id")) - F.col("_n")).alias("_before"))
    moved = nodes.join(before, "skeleton_id").select((F.col("node") + F.col("_before")).alias("node"), "skeleton_id", *[(F.col(a) * float(r)).alias(a) for a, r in zip("zyx", resolution)])
    return moved, edges.join(before, "skeleton_id").select((F.col("src") + F.col("_before")).alias("src"), (F.col("dst") + F.col("_before")).alias("dst"))
