"""Counting many 64-bit hashes in Spark, as sorted blobs instead of one row a hash.

Documents are dealt into groups; each group sorts its own hashes, merges equal ones and
sends them to hash ranges ("buckets") as compact binary rows. A bucket merges the blobs of
all groups, and answers each group with what it needs to know. A hash that a third of all
rows share costs one entry a group, so there is no hot key, and no text moves to a bucket. With
many groups, blobs take two hops (see ``Hops``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import one

U64 = np.uint64
MB = 1 << 20
BLOB = "bucket int, g int, n long, h binary, v binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("h", pa.binary()), ("v", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """64-bit values as byte planes, without the planes that are zero in all of them: the first and last plane, then the planes."""
    x = np.ascontiguousarray(x.astype(U64, copy=False))
    used = np.flatnonzero(np.bitwise_or.reduce(x, initial=U64(0)).reshape(1).view(np.uint8)) if len(x) else np.zeros(0, int)
    low, high = (int(used[0]), int(used[-1]) + 1) if len(used) else (0, 1)
    out, each = np.empty((high - low, len(x)), np.uint8), x.view(np.uint8).reshape(-1, 8)
    for k in range(low, high):
        out[k - low] = each[:, k]
    return bytes([low, high]) + out.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    low, high = b[0], b[1]
    each = np.frombuffer(b, np.uint8, offset=2).reshape(high - low, -1)
    out = np.zeros((each.shape[1], 8), np.uint8)
    for k in range(low, high):
        out[:, k] = each[k - low]
    return out.view(U64).reshape(-1)


def pack(h: np.ndarray) -> bytes:
    """Ascending hashes: the first, then byte planes of the differences, which are small."""
    return h[:1].tobytes() + planes(np.diff(h))


def unpack(b: bytes) -> np.ndarray:
    if len(b) == 2:
        return np.zeros(0, U64)
    out = np.concatenate([np.frombuffer(b, U64, 1), unplanes(b[8:])])
    return np.cumsum(out, dtype=U64, out=out)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def to_buckets(g: int, h: np.ndarray, v: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Blob rows of a group's ascending distinct hashes, with a value for each if there is one."""
    cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    rows = [(h[cuts[b] : cuts[b + 1]], None if v is None else v[cuts[b] : cuts[b + 1]]) for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(np.full(len(full), g), pa.int32()), pa.array([len(a) for a, _ in rows], pa.int64()), pa.array([pack(a) for a, _ in rows], pa.binary()), pa.array([None if b is None else planes(b) for _, b in rows], pa.binary())],
        schema=BLOB_ARROW,
    )


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a bucket by hash, then group: hash, group, value, and where each hash begins."""
    if not table.num_rows:
        return np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, U64), np.zeros(0, np.int64)
    gs, ns = table["g"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(gs, kind="stable")
    hs, vs = table["h"].to_pylist(), table["v"].to_pylist()
    h = np.concatenate([unpack(hs[i]) for i in order])
    g = np.repeat(gs[order], ns[order]).astype(np.int32)
    v = np.concatenate([unplanes(vs[i]) for i in order]) if vs[0] is not None else np.zeros(0, U64)
    by = np.argsort(h, kind="stable")
    h = h[by]
    return h, g[by], v[by] if len(v) else v, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def replies(bucket: int, g: np.ndarray, h: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
    """Blob rows for the groups: entries come by hash, and leave by group and hash."""
    by = np.argsort(g, kind="stable")
    g, h, v = g[by], h[by], None if v is None else v[by]
    cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    parts = list(zip(cuts[:-1], cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket] * len(parts), pa.int32()), pa.array([int(g[a]) for a, _ in parts], pa.int32()), pa.array([int(b - a) for a, b in parts], pa.int64()), pa.array([pack(h[a:b]) for a, b in parts], pa.binary()), pa.array([None if v is None else planes(v[a:b]) for a, b in parts], pa.binary())],
        schema=BLOB_ARROW,
    )


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group's replies, ascending by hash."""
    if not table.num_rows:
        return np.zeros(0, U64), np.zeros(0, U64)
    order = np.argsort(table["bucket"].to_numpy(), kind="stable")
    hs, vs = table["h"].to_pylist(), table["v"].to_pylist()
    h = np.concatenate([unpack(hs[i]) for i in order])
    return h, np.concatenate([unplanes(vs[i]) for i in order]) if vs[0] is not None else np.zeros(0, U64)


def found(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each hash in an ascending array, and whether it is there."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def group_count(total: int, group_bytes: int = 4 * MB, most_bytes: int = 128 * MB, many: int = 8192) -> int:
    """How many groups so many bytes of text need. A group has ``group_bytes``; once there would be over ``many`` groups they
    grow, up to ``most_bytes``, so that the blobs between groups and buckets do not become tiny. A task holds about
    25 times its group while it counts."""
    each = min(max(group_bytes, total // many), most_bytes)
    return max(1, -(-total // each))


def by_hash(docs: DataFrame, groups: int, key: str = "id", text: str = "text") -> DataFrame:
    """Documents with a group ``g`` by the hash of their key, those without one by that of their text, together by group.
    Rows with neither are alike, and have no words."""
    g = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))), F.lit(groups)).cast("int")
    return docs.withColumn("g", g).repartition(groups, "g")


#: Bounds between ranges that the driver asks for at most; bytes of text for which a row counts once more.
BOUNDS, UNIT = 4096, 4096


def by_range(docs: DataFrame, groups: int, key: str = "id", text: str = "text") -> DataFrame:
    """Documents with a group ``g`` that rises with their key, together by group; those without a key are dealt by the hash of
    their text, as they are neither before nor after any other.

    Bounds are quantiles of the key by bytes of text over all rows (a long text counts several times), ``BOUNDS`` at most;
    a two-level search finds a row's range. Beyond that number each range is cut into equal steps of the key."""
    bounds, name = [], key.replace("`", "``")
    if groups > 1:
        ranges = min(groups, BOUNDS)
        share = [i / ranges for i in range(1, ranges)]
        sizes = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).alias("b")).where("k is not null")
        weighed = sizes.select("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("b") / UNIT).cast("int"))))
        bounds = sorted(set(weighed.agg(F.percentile_approx("k", F.lit(share), F.lit(max(10_000, 20 * ranges)))).first()[0] or []))
    if not bounds:
        return docs.withColumn("g", F.pmod(F.xxhash64(text), F.lit(groups)).cast("int")).repartition(groups, "g")
    step = max(1, int(len(bounds) ** 0.5))
    tops, parts = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    listed = lambda x: "array(" + ",".join(f"{int(b)}L" for b in x) + ")"
    nested = "array(" + ",".join(map(listed, parts)) + ")"
    top = f"size(filter({listed(tops)}, b -> b <= `{name}`))"
    at = f"CASE WHEN {top} = 0 THEN 0 ELSE ({top} - 1) * {step} + size(filter({nested}[{top} - 1], b -> b <= `{name}`)) END"
    steps = -(-groups // (len(bounds) + 1))
    docs = docs.withColumn("g", F.expr(at).cast("int"))
    if steps > 1:
        # the outer ranges end at the least and the largest key
        ends = docs.agg(F.min(key), F.max(key)).first()
        edges = [ends[0], *bounds, ends[1] + 1]
        low, high = (F.element_at(F.expr(listed(x)), F.col("g") + 1) for x in (edges[:-1], edges[1:]))
        part = (F.col(key) - low).cast("double") / (high - low) * steps
        docs = docs.withColumn("g", (F.col("g") * steps + F.least(F.floor(part), F.lit(steps - 1))).cast("int"))
    any_ = F.pmod(F.xxhash64(text), F.lit(groups)).cast("int")
    return docs.withColumn("g", F.when(F.col(key).isNull(), any_).otherwise(F.col("g"))).repartition((len(bounds) + 1) * steps, "g")


# --- from groups to buckets and back

#: Groups that send to every bucket directly; beyond them, blobs go in two hops.
DIRECT = 1024


def _bundled(table: pa.Table, to: np.ndarray) -> pa.Table:
    """Blob rows put into one row a destination, as an Arrow stream each."""
    order = np.argsort(to, kind="stable")
    table, to = table.take(pa.array(order)), to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        sink = pa.BufferOutputStream()
        part = table.slice(a, b - a).combine_chunks()
        with pa.ipc.new_stream(sink, BLOB_ARROW) as out:
            out.write_table(part)
        rows.append(sink.getvalue().to_pybytes())
    return pa.table([pa.array(to[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["to", "rows"])


def _opened(table: pa.Table) -> pa.Table:
    """The blob rows of bundles."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["rows"].to_pylist()] or [BLOB_ARROW.empty_table()])


BUNDLE = "to long, rows binary"


class Hops:
    """Ways of blobs between ``groups`` groups and ``buckets`` buckets.

    Up to ``DIRECT`` groups, each sends a row to every bucket. Beyond them buckets are put together in about sqrt(buckets)
    runs, groups in as many sets, and a task for each run and set passes on what comes from its groups to its buckets,
    and the answers back; so a group or bucket sends and gets about sqrt(groups) rows, whose size does not fall with their number."""

    def __init__(self, groups: int, buckets: int):
        self.groups, self.buckets = groups, buckets
        self.direct = groups <= DIRECT
        self.runs, self.sets = max(1, math.isqrt(buckets)), max(1, math.isqrt(groups))

    def _task(self, bucket: np.ndarray, g: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.int64) * self.runs // self.buckets) * self.sets + g % self.sets

    def sent(self, f):
        """A function of a group that returns blob rows for buckets, as one whose rows leave for the first hop."""
        if self.direct:
            return f
        return lambda key, table: (lambda out: _bundled(out, self._task(out["bucket"].to_numpy(), out["g"].to_numpy())))(f(key, table))

    @property
    def schema(self) -> str:
        return BLOB if self.direct else BUNDLE

    def _hop(self, frame: DataFrame, by: str) -> DataFrame:
        def pass_on(key: tuple, table: pa.Table) -> pa.Table:
            out = _opened(table)
            return _bundled(out, out[by].to_numpy().astype(np.int64))

        return frame.repartition(self.runs * self.sets, "to").groupBy("to").applyInArrow(one(pass_on), BUNDLE)

    def answered(self, sent: DataFrame, answer) -> DataFrame:
        """What buckets answer to what was ``sent``: blob rows, or bundles on their way back."""
        if self.direct:
            return sent.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(one(answer), BLOB)

        def reply(key: tuple, table: pa.Table) -> pa.Table:
            out = answer(key, _opened(table))
            return _bundled(out, np.where(out["g"].to_numpy() < 0, -1, self._task(out["bucket"].to_numpy(), out["g"].to_numpy())))

        return self._hop(sent, "bucket").repartition(self.buckets, "to").groupBy("to").applyInArrow(one(reply), BUNDLE)

    def back(self, answered: DataFrame) -> DataFrame:
        """Answers on their last way to the groups, with ``g``."""
        if self.direct:
            return answered.where(F.col("g") >= 0)
        passed = self._hop(answered.where(F.col("to") >= 0), "g")
        return passed.select(F.col("to").cast("int").alias("g"), "rows")

    def told(self, answered: DataFrame) -> DataFrame:
        """Answers by group, to be grouped by ``g``."""
        return self.back(answered).repartition(self.groups, "g")

    def aside(self, answered: DataFrame) -> DataFrame:
        """Answers to nobody (groups below 0), as blob rows."""
        if self.direct:
            return answered.where(F.col("g") < 0)

        def opened(batches):
            for batch in batches:
                yield from _opened(pa.Table.from_batches([batch])).to_batches()

        return answered.where(F.col("to") < 0).mapInArrow(opened, BLOB)

    def rows(self, told: pa.Table) -> pa.Table:
        """The blob rows that a group was told."""
        return told if self.direct else _opened(told)
