"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins on vertices; nothing is gathered per vertex,
so a vertex with very many neighbours is split like any other skewed join key. What is left is
solved by one task as soon as it is at most ``SMALL`` edges (4 MB), whatever the input's size was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written


SMALL = 1 << 18


def linked_minima(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of each of n vertices' component, for edges between numbers."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == root).all():
            return root
        root = new


def _solved(batches):
    """Components of all edges of a partition."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    ids, both = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    root = linked_minima(both[: table.num_rows], both[table.num_rows :], len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is tied to the least of the vertex and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every vertex in a table of undirected edges: the least id that it can reach.

    Edges with a null end are ignored; a loop only names its vertex. Ids may be of any orderable type.
    """
    src = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    now = written(src.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = now.where("a = b").select(F.col("a").alias("id"))
    now = now.where("a != b")
    state, long = None, now.schema["a"].dataType.simpleString() == "bigint"
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b").cast("decimal(38,0)"))).first()
        if long and seen[0] <= SMALL:
            found = written(now.coalesce(1).mapInArrow(_solved, "id long, component long"), "components")
            break
        if seen == state:
            found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            found = found.unionByName(now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component")))
            break
        state, before, now = seen, now, written(small_star(large_star(now)), "stars")
        forget(before)  # the first is a view of the edges, and stays
    lone = loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(lone)
