"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt into shards by the hash of their id; equal vectors of a shard are one node with
a list of ids. A shard's graph is a flat array of neighbours per layer. It is built in batches
that at most double it, and whose marks of seen nodes are bounded: all vectors of a batch walk the current graph in step (a beam search
over arrays), choose neighbours that are nearer to them than to each other, and are linked
back. Blocks of queries meet every shard, walk its graph in step, and are scored exactly, in
double precision, on the original vectors; the best of all shards are merged per query. Shards grow with
the table up to a size whose recall is tested; beyond it their number grows, and with it the copies of the queries.

Defined cases: vectors that are null, zero, of another length than the most common one, or that
hold a null or non-finite component take no part, as queries or as candidates; rows without an
id take no part; rows that share an id are candidates once each, the query's own id never;
ties go to the smaller id; with fewer candidates than asked for, all are returned; an empty
table gives no rows; only the key and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import text as T

LINKS, BUILD_BEAM, BEAM, NEAREST, QUERY_EVERY = 16, 64, 192, 5, 50
#: Rows of a shard at least and at most; between them, there are ``SHARDS`` shards. Queries walk a graph in blocks.
LEAST_ROWS, MOST_ROWS, SHARDS, BLOCK = 4096, 1 << 14, 4096, 256
#: Bytes that mark what the walks of one batch of new nodes have seen.
SEEN = 32 << 20
SHARD = pa.schema([("shard", pa.int32()), ("graph", pa.binary())])


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Graph:
    """Nodes with unit vectors, neighbour arrays per layer (-1: none), and the ids of each node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        """``vectors``: original rows in double precision; equal rows become one node."""
        order = np.lexsort((ids, *vectors.T[::-1])) if len(ids) else np.zeros(0, np.int64)
        vectors, ids = vectors[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        # a fixed random order of nodes, so that batches are unbiased
        mixed = np.random.default_rng(7).permutation(len(first))
        self.ids, self.start, self.count = ids, first[mixed], np.diff(np.append(first, len(ids)))[mixed]
        self.original = vectors[self.start]
        self.unit = _unit(self.original).astype(np.float32) if len(ids) else np.zeros((0, 1), np.float32)
        n = len(first)
        levels = np.floor(-np.log(np.random.default_rng(11).random(n)) / math.log(LINKS)).astype(int) if n else np.zeros(0, int)
        if n:
            levels[0] = max(int(levels.max()), 0)  # the first node is on all layers, and every walk begins there
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        self.levels = levels
        done = 1
        while done < n:
            batch = np.arange(done, min(n, 2 * done, done + max(1, SEEN // n)))
            self._insert(batch)
            done = batch[-1] + 1

    def stored(self) -> bytes:
        """The graph as flat arrays."""
        out = io.BytesIO()
        np.savez(out, ids=self.ids, start=self.start, count=self.count, original=self.original, unit=self.unit, **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Graph":
        g = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as f:
            g.ids, g.start, g.count, g.original, g.unit = f["ids"], f["start"], f["count"], f["original"], f["unit"]
            g.layers = [f[f"layer{k}"] for k in range(len(f.files) - 5)]
        return g

    def _insert(self, batch: np.ndarray) -> None:
        at = np.zeros(len(batch), np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            here = self.levels[batch] >= layer
            found, dist = self._beam(self.unit[batch], at, layer, BUILD_BEAM if here.any() else 1)
            at = found[:, 0]
            if not here.any():
                continue
            mine = batch[here]
            chosen = self._chosen(mine, found[here], dist[here], LINKS)
            self.layers[layer][mine, :LINKS] = chosen
            self._back(mine, chosen, layer)

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: nodes by similarity (descending) and the similarities; -1 pads."""
        links, n, m = self.layers[layer], len(self.unit), len(q)
        nodes, sims, open_ = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32), np.zeros((m, width), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("ij,ij->i", q, self.unit[entry]), True
        seen = np.zeros((m, n), bool)
        seen[np.arange(m), entry] = True
        live = np.arange(m)
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            some = open_[live, best]
            live, best = live[some], best[some]
            if not len(live):
                break
            open_[live, best] = False
            near = links[nodes[live, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
            new = np.full(near.shape, -np.inf, np.float32)
            row = np.repeat(np.arange(len(live)), fresh.sum(axis=1))
            new[fresh] = np.einsum("ij,ij->i", q[live[row]], self.unit[near[fresh]])
            all_sims = np.concatenate([sims[live], new], axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.tile(np.arange(width), (len(live), 1))
            sims[live] = np.take_along_axis(all_sims, keep, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1), keep, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), np.take_along_axis(nodes, order, 1), -1), sims

    def _chosen(self, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in descending similarity, those nearer to their node than to any chosen before; the rest fills up."""
        m, width = cand.shape
        out, taken, used = np.full((m, most), -1, np.int64), np.zeros(m, int), np.zeros((m, width), bool)
        best = np.full((m, width), -np.inf, np.float32)  # similarity of each candidate to the nearest chosen one
        for k in range(width):
            ok = (cand[:, k] >= 0) & (cand[:, k] != own) & (taken < most) & (sims[:, k] >= best[:, k])
            rows = np.flatnonzero(ok)
            if len(rows):
                out[rows, taken[rows]] = cand[rows, k]
                taken[rows] += 1
                used[rows, k] = True
                if k + 1 < width:
                    rest = cand[rows, k + 1 :]
                    to = np.einsum("ij,ikj->ik", self.unit[cand[rows, k]], self.unit[np.maximum(rest, 0)])
                    best[rows, k + 1 :] = np.maximum(best[rows, k + 1 :], to)
        for k in range(width):
            rows = np.flatnonzero((taken < most) & ~used[:, k] & (cand[:, k] >= 0) & (cand[:, k] != own))
            out[rows, taken[rows]] = cand[rows, k]
            taken[rows] += 1
        return out

    def _back(self, mine: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """Links the chosen neighbours back; a node with too many keeps the chosen of them."""
        links = self.layers[layer]
        room = links.shape[1]
        src = np.repeat(mine, (chosen >= 0).sum(axis=1))
        dst = chosen[chosen >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = min(int(count.max(initial=0)), 4 * room)
        sims = np.einsum("ij,ij->i", self.unit[src], self.unit[dst])
        by = np.lexsort((-sims, dst))
        src = src[by]
        place = np.arange(len(dst)) - np.repeat(first, count)
        fits = place < most
        add = np.full((len(nodes), most), -1, np.int64)
        add[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = src[fits]
        have = (links[nodes] >= 0).sum(axis=1)
        small = have + count <= room
        for i in range(most):
            rows = np.flatnonzero(small & (i < count))
            links[nodes[rows], have[rows] + i] = add[rows, i]
        large = np.flatnonzero(~small)
        for a in range(0, len(large), 512):
            rows = large[a : a + 512]
            own = nodes[rows]
            cand = np.concatenate([links[own].astype(np.int64), add[rows]], axis=1)
            s = np.einsum("ij,ikj->ik", self.unit[own], self.unit[np.maximum(cand, 0)])
            s[cand < 0] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, : 3 * room]
            links[own] = self._chosen(own, np.take_along_axis(cand, top, 1), np.take_along_axis(s, top, 1), room)

    def nearest(self, q: np.ndarray, ids: np.ndarray, k: int, beam: int = BEAM):
        """The k nearest ids of each query but its own, exactly scored: query row, id, cosine."""
        if not len(self.unit):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        unit = _unit(q)
        at = np.zeros(len(q), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._beam(unit.astype(np.float32), at, layer, 1)[0][:, 0]
        found, _ = self._beam(unit.astype(np.float32), at, 0, min(beam, max(1, len(self.unit))))
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = cosine(q[row], self.original[node])
        # of equal vectors, the k + 1 smallest ids are enough
        take = np.minimum(self.count[node], k + 1)
        at = np.repeat(self.start[node] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        row, score, id_ = np.repeat(row, take), np.repeat(score, take), self.ids[at]
        other = id_ != ids[row]
        row, score, id_ = row[other], score[other], id_[other]
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], id_[place < k], score[place < k]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """``id, v`` of the rows that take part, and the vectors' length."""
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = src.where(fine)
    size = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return src.where(F.size("v") == (size["d"] if size else 0)), size["d"] if size else 0


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def shard_size(rows: int) -> int:
    return min(max(LEAST_ROWS, -(-rows // SHARDS)), MOST_ROWS)


def _searcher(width: int, k: int, beam: int):
    """Rows by shard, each shard's graph before its queries -> neighbours found in the shard. One graph is in memory at a time,
    and the queries pass by in batches."""

    def search(batches):
        graph, at = None, None
        for batch in batches:
            shard, is_graph = batch.column("shard").to_numpy(), batch.column("graph").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)  # whole numbers, also where a graph has none
            cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | is_graph[1:] | is_graph[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
            for first, last in zip(cuts[:-1], cuts[1:]):
                if is_graph[first]:
                    graph, at = Graph.load(batch.column("graph")[int(first)].as_py()), shard[first]
                    continue
                if at != shard[first]:
                    continue  # a shard without rows has no graph
                q = _matrix(batch.column("v").slice(first, last - first), width)
                own = ids[first:last]
                for x in range(0, len(own), BLOCK):
                    row, near, score = graph.nearest(q[x : x + BLOCK], own[x : x + BLOCK], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(own[x : x + BLOCK][row]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = NEAREST, every: int = QUERY_EVERY, shard_rows: int | None = None, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest other rows."""
    src, width = usable(vectors, key, column)
    rows = src.count()
    shards = max(1, -(-rows // (shard_rows or shard_size(rows))))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        graph = Graph(_matrix(table["v"], width), table["id"].to_numpy())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([graph.stored()], pa.binary())], schema=SHARD)

    dealt = src.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = shared.written(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(T.one(build), "shard int, graph binary"), "graphs")
    # the stated queries go to every shard; a graph moves once, to the task that its queries pass through
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = src.where(F.col("id") % every == 0).select(every_shard.alias("shard"), "id", "v", F.lit(None).cast("binary").alias("graph"))
    both = graphs.select("shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "graph").unionByName(queries)
    ordered = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("graph").isNull())
    found = ordered.mapInArrow(T.steady(_searcher(width, k, beam)), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
