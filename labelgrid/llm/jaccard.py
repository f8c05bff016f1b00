"""Jaccard metric-space join: all documents whose word shingles overlap enough, exactly.

The Jaccard distance is a metric. Unrelated documents are all at distance 1 from each other, so documents as first pivots
would separate nothing; the first level takes single shingles as pivots instead, in one global order (rarest first, then by
hash). A document lies nearest to the pivots it holds; by the bound |A & B| >= t |A| a linked document holds one of its
first n - ceil(t n) + 1 shingles, and goes to those regions. Only light rows go there: size, place of the shingle in the order,
and a sketch (how many shingles fall into each of 64 hash buckets). The sum of differences of two sketches is a lower bound
of the sets' symmetric difference, so members of a region that can't be linked part again, and what may be linked is tied
into cells. Regions of over ``REGION`` members are tied as a whole.

Inside a cell, documents are the pivots: members go to the Voronoi region of the nearest pivot, and by the triangle
inequality also to the region of any earlier pivot that is at most twice the join radius farther (those far from all pivots form a region of their
own, with a margin of one radius); members within the radius of a pivot are
linked to it and leave unless somebody outside the ball can still be near them. Regions split further until they are small
or stop shrinking, and are then joined by the exact sizes of all intersections.

Cells beyond ``cell_members`` or ``cell_bytes`` are split the same way as Spark steps over parts of ``PART`` members. A cell that
doesn't shrink (near copies of one text are all equally far apart) is not copied: its pivots have met all its members and are
done, and what is linked already needs no comparison, so the next pivots are members outside the cell's largest
component, more each time, until there are none.

Equal sets are one member, so copies are never paired. The order needs document frequencies of all shingles; they are
counted with sorted blobs (see ``exchange``).

Defined cases: null or blank texts have no shingles and no links; an empty table gives no rows; a null id has no links and a
null component; rows that share an id are one vertex; ties and repeated rows give equal results; texts of any length
are taken whole; only the key and the text are read, so other columns may have any names (``representatives`` returns
them as they are).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.components import connected_components, linked_minima
from . import exchange as X
from . import shared
from . import text as T

U64 = np.uint64
SHINGLE, PERCENT = 4, 85
LEAF, PIVOTS, CELL_BYTES, CELL_MEMBERS, PART, SALTS = 8, 8, 8 << 20, 256, 256, 16
#: Members of a region whose pairs are looked at one by one; hash buckets of a sketch; pairs in memory at once.
REGION, SKETCH, PAIRS = 4096, 64, 1 << 18
#: Bytes of small cells that one call joins.
PACK = 1 << 18
#: Pivots of a cell that doesn't shrink, at first and at most.
FIRST_PIVOTS, MOST_PIVOTS = 128, 1024
ROWS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("lead", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary()), ("shingles", pa.binary())])
SPARK_ROWS = "id long, n long, f1 long, f2 long, lead int, prefix array<long>, sketch binary, shingles binary"


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending in a row, and row offsets."""
    buf, off = T.flat(column)
    buf = T.LOWER[buf]
    starts, ends, woff = T.words(buf, off)
    h = T.hashes(buf, starts, ends)
    count = np.diff(woff)
    n = np.maximum(count - k + 1, 0)
    at = T.ragged(woff[:-1], n)
    roll = T.rolling(h, k)
    row, value = np.repeat(np.arange(len(n)), n), roll[at]
    for short in range(1, k):  # the whole sequence is the one shingle
        rows = np.flatnonzero(count == short)
        if len(rows):
            seq = T.rolling(h, short)[woff[rows]]
            row, value = np.concatenate([row, rows]), np.concatenate([value, T.mix(seq + U64(short))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def kept_bits(total: int) -> np.uint64:
    """A mask of the leading hash bits by which shingles are counted: 2**11 times as many values as there may be shingles.
    Two shingles that agree in them only count as more frequent than they are, which the order may say as well as not."""
    bits = 8 * -(-(max(total, 1).bit_length() + 9) // 8)
    return U64((1 << 64) - (1 << (64 - min(bits, 64))))


def _sender(k: int, buckets: int, mask: np.uint64):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        value, _ = shingle_sets(table["text"], k)
        h, count = np.unique(value & mask, return_counts=True)
        return pa.Table.from_batches([X.to_buckets(key[0].as_py(), h, count.astype(U64), buckets)])

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Shingles in two documents or more, with their frequency, to all groups that hold them."""
    h, g, v, first = X.merged(table)
    if not len(h):
        return pa.Table.from_batches([X.replies(0, g, h, v)])
    total = np.add.reduceat(v, first)
    each = np.repeat(total, np.diff(np.append(first, len(h))))
    many = each > 1
    return pa.Table.from_batches([X.replies(key[0].as_py(), g[many], h[many], each[many])])


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def _profiler(k: int, percent: int, mask: np.uint64, hops: X.Hops):
    def profile(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        known, df = X.received(hops.rows(told))
        value, off = shingle_sets(docs["text"], k)
        n = np.diff(off)
        at, rep = X.found(known, value & mask)
        row = T.rows_of(off)
        unique = n - np.bincount(row[rep], minlength=len(n))
        need = n - least_overlap(n, percent) + 1 - unique
        valid = docs["id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        open_ = (need > 0) & (n > 0) & valid
        # the first shingles of each open row in the global order: unique ones are first and need no region
        pick = np.flatnonzero(rep & open_[row])
        order = pick[np.lexsort((value[pick], df[at[pick]], row[pick]))]
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[place < need[row[order]]]
        poff = np.searchsorted(row[order], np.arange(len(n) + 1))
        total = lambda x: np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
        f1, f2 = total(value), total(T.mix(value ^ U64(0xA24BAED4963EE407)))
        blobs = [X.pack(value[a:b]) if o else None for a, b, o in zip(off[:-1], off[1:], open_)]
        prefix = pa.ListArray.from_arrays(pa.array(poff, pa.int32()), pa.array(value[order].view(np.int64)))
        sums = [pa.array((f[off[1:]] - f[off[:-1]]).view(np.int64)) for f in (f1, f2)]
        cols = [docs["id"].combine_chunks(), pa.array(n, pa.int64()), *sums, pa.array(unique, pa.int32()), prefix, pa.array(sketches(value, off, open_), pa.binary()), pa.array(blobs, pa.binary())]
        return pa.Table.from_arrays(cols, schema=ROWS)

    return profile


def sketches(value: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> list[bytes | None]:
    """How many shingles of each chosen row fall into each bucket, at most 255."""
    rows = np.flatnonzero(chosen)
    lens = np.diff(off)[rows]
    bucket = (value[T.ragged(off[:-1][rows], lens)] >> U64(58)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(rows)), lens) * SKETCH + bucket, minlength=len(rows) * SKETCH)
    count = np.minimum(count, 255).astype(np.uint8).reshape(-1, SKETCH)
    out: list[bytes | None] = [None] * len(chosen)
    for i, r in enumerate(rows):
        out[r] = count[i].tobytes()
    return out


def least_common(n, m, percent: int):
    """The least intersection of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def ties(region: np.ndarray, n: np.ndarray, place: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Members of regions (ascending numbers) -> the least row of each member's part, parts being tied by pairs that may be
    linked: their sizes, what can follow their place in the order, and their sketches allow it."""
    rows = len(region)
    end = np.searchsorted(region, region, side="right")
    after = end - 1 - np.arange(rows)
    total, root, first = np.concatenate([[0], np.cumsum(after)]), np.arange(rows), 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(first, last), after[first:last])
        b = T.ragged(np.arange(first, last) + 1, after[first:last])
        first = last
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        need = least_common(n[a], n[b], percent)
        may = (np.minimum(n[a] - place[a], n[b] - place[b]) >= need) & (percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
        a, b, need = a[may], b[may], need[may]
        differ = np.zeros(len(a), np.int64)
        for x in range(0, len(a), 1 << 14):
            s = slice(x, x + (1 << 14))
            differ[s] = np.abs(sketch[a[s]].astype(np.int16) - sketch[b[s]]).sum(axis=1)
        may = differ <= n[a] + n[b] - 2 * need
        if may.any():
            root = linked_minima(np.concatenate([a[may], np.arange(rows)]), np.concatenate([b[may], root]), rows)
    return root


def _tied(percent: int):
    """Rows sorted by region -> pairs that tie the members of each region's parts."""

    def emit(table: pa.Table):
        ids = table["id"].to_numpy()
        _, region = np.unique(table["s"].to_numpy(), return_inverse=True)
        # a stable order by number, since signed hashes need not come in the order of their numbers
        order = np.argsort(region, kind="stable")
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        root = ties(region[order], table["n"].to_numpy()[order], table["place"].to_numpy()[order], sketch[order], percent)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[order][moved]), pa.array(ids[order][root[moved]])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            s = table["s"].to_numpy()
            cut = int(np.flatnonzero(s != s[-1])[-1]) + 1 if len(s) and (s != s[-1]).any() else 0
            if cut:
                yield emit(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held.combine_chunks())

    return run


class Sets:
    """Members of cells: their ids and sets (ascending hashes)."""

    def __init__(self, ids, blobs, percent: int):
        parts = [X.unpack(b) for b in blobs]
        self.ids, self.percent, self.radius = np.asarray(ids, np.int64), percent, 1 - percent / 100 + 1e-9
        self.n = np.array([len(p) for p in parts], np.int64)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.start = np.cumsum(self.n) - self.n
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.splits = 0  # how often pivots have parted members

    def common(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Size of each member's intersection with the pivot."""
        own = self.flat[self.start[pivot] : self.start[pivot] + self.n[pivot]]
        hit = X.found(own, self.flat[T.ragged(self.start[members], self.n[members])])[1]
        total = np.concatenate([[0], np.cumsum(hit)])
        cut = np.concatenate([[0], np.cumsum(self.n[members])])
        return np.diff(total[cut])

    def distances(self, pivots: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of members (columns) from pivots (rows), and which are linked, by whole numbers."""
        both = np.stack([self.common(p, members) for p in pivots]) if len(pivots) else np.zeros((0, len(members)), np.int64)
        union = self.n[members] + self.n[pivots][:, None] - both
        return 1 - both / union, 100 * both >= self.percent * union

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links.append((a, b))

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Links of members with each other: by pivots, Voronoi regions and windows, recursively."""
        if len(members) <= LEAF or depth > 12:
            return self.leaf(members)
        spread = members[np.argsort(T.mix(self.ids[members].astype(U64) + U64(depth + 1)), kind="stable")]
        pivots = spread[:PIVOTS]
        dist, near = self.distances(pivots, members)
        at, who = np.nonzero(near)
        self.link(members[who], pivots[at])
        self.splits += 1
        regions = [members[kept] for kept in windows(dist, near, self.radius) if kept.any()]
        if sum(map(len, regions)) > 2 * len(members) or any(len(r) > 0.9 * len(members) for r in regions):
            return self.leaf(np.unique(np.concatenate(regions)))
        for r in regions:
            self.join(r, depth + 1)

    def leaf(self, members: np.ndarray) -> None:
        """Links of all pairs, by a product of their incidence matrices over columns that two or more share."""
        k = len(members)
        if k < 2:
            return
        at = T.ragged(self.start[members], self.n[members])
        row = np.repeat(np.arange(k), self.n[members])
        value, column, count = np.unique(self.flat[at], return_inverse=True, return_counts=True)
        several = count > 1
        number = np.cumsum(several) - 1
        use = several[column]
        row, column = row[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((k, k))
        columns = int(several.sum())
        wide = max(1, min(columns, max(256, (1 << 22) // k)))
        for first in range(0, columns, wide):
            a, b = np.searchsorted(column, [first, first + wide])
            part = np.zeros((k, wide), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            both += part @ part.T
        n = self.n[members]
        i, j = np.nonzero(np.triu(100 * both >= self.percent * (n + n[:, None] - both), 1))
        self.link(members[i], members[j])

    def components(self) -> np.ndarray:
        """The least id that each member's links reach."""
        order = np.argsort(self.ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = (np.concatenate(x) for x in zip(*self.links)) if self.links else (np.zeros(0, np.int64),) * 2
        return self.ids[order[linked_minima(rank[a], rank[b], len(order))[rank]]]


def regions_of(dist: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Which members (columns) lie beyond all pivots, and which regions of pivots (rows) hold each other member: that of
    the nearest pivot, the first of equals, and those of earlier pivots that are at most two radii farther.

    Two members within the radius meet: beyond, if one of them is farther than the cut from every pivot, as the other is
    then nearly so; else in the earlier one of their regions."""
    cut, number = 1 - 2.5 * radius, np.arange(len(dist))[:, None]
    own = dist.argmin(axis=0) if len(dist) else np.zeros(dist.shape[1], np.int64)
    nearest = dist.min(axis=0, initial=1)
    held = (number == own) | (number < own) & (dist - nearest <= 2 * radius)
    return nearest > cut - radius, held & (nearest <= cut)


def windows(dist: np.ndarray, near: np.ndarray, radius: float):
    """The members beyond all pivots, and for each pivot those that its region keeps: of those linked to it, only the ones
    that somebody outside its ball may still be near to."""
    beyond, held = regions_of(dist, radius)
    yield beyond
    for d, linked, inside in zip(dist, near, held):
        outside = inside & ~linked
        if not outside.any():
            yield np.zeros(len(d), bool)  # the ball is one component
            continue
        yield outside | (linked & inside & (d >= d[outside].min() - radius))


def _joiner(percent: int):
    def join(key: tuple, table: pa.Table) -> pa.Table:
        """All cells of a pack, one after another."""
        sets = Sets(table["id"].to_numpy(), table["shingles"].to_pylist(), percent)
        _, cell = np.unique(table["cell"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.argsort(cell, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            sets.join(members)
        return pa.table([pa.array(sets.ids), pa.array(sets.components())], names=["id", "component"])

    return join


def _splitter(percent: int):
    """Members of a cell's part with the cell's pivots -> the links found, as stars, and each member's windows (the first
    ``PIVOTS`` pivots): number, distance, whether linked."""
    radius = 1 - percent / 100 + 1e-9

    def split(key: tuple, table: pa.Table) -> pa.Table:
        pivot = table["pivot"].to_numpy()
        table = table.take(pa.array(np.argsort(np.where(pivot < 0, 1 << 30, pivot), kind="stable")))
        pivot = np.sort(pivot[pivot >= 0])
        sets = Sets(table["id"].to_numpy(), table["shingles"].to_pylist(), percent)
        piv, members = np.arange(len(pivot)), np.arange(len(pivot), table.num_rows)
        dist, near = sets.distances(piv, members)
        at, who = np.nonzero(near)
        sets.link(members[who], piv[at])
        few = dist[:PIVOTS]
        beyond, held = regions_of(few, radius)
        far = len(few)  # the number of the region beyond all pivots
        m, j = np.nonzero(np.concatenate([held, beyond[None]]).T)
        few, near = np.concatenate([few, np.ones((1, len(members)))]), np.concatenate([near[:far], np.zeros((1, len(members)), bool)])
        cuts = pa.array(np.searchsorted(m, np.arange(len(members) + 1)), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(j, pa.int32()), pa.array(few[j, m]), pa.array(near[j, m])], names=["sub", "dist", "near"])
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(pivot) + 1, int), pa.int32()), each.slice(0, 0))
        subs = pa.concat_arrays([none, pa.ListArray.from_arrays(cuts, each)])
        return pa.table([table["cell"], table["id"], table["fp"], pa.array(sets.components()), subs], names=[*NAME, "tie", "subs"])

    return split


ROW = ["cell", "id", "fp", "shingles", "done"]
#: What names a row of a cell: rows may share an id, but not a set.
NAME = ["cell", "id", "fp"]


def _split_cells(cells: DataFrame, percent: int, cell_bytes: int, cell_members: int) -> tuple[DataFrame, DataFrame]:
    """Cells beyond a bound split by pivots until none is: rows of the small cells (cell, id, shingles), and links found."""
    radius = 1 - percent / 100 + 1e-9
    cells = cells.select("cell", "id", F.xxhash64("shingles").alias("fp"), "shingles", F.lit(False).alias("done"))
    links = cells.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    small, level = [], 0
    while True:
        sizes = cells.groupBy("cell").agg(F.sum(F.octet_length("shingles")).alias("bytes"), F.count("*").alias("members"))
        large = shared.written(sizes.where((F.col("bytes") > cell_bytes) & (F.col("members") > LEAF) | (F.col("members") > cell_members)), "large-cells")
        small.append(cells.join(large, "cell", "left_anti").select("cell", "id", "shingles"))
        if large.isEmpty():
            out = small[0]
            for more in small[1:]:
                out = out.unionByName(more)
            return out, links
        big = cells.join(large, "cell")
        # what is linked already: members outside the largest component of their cell are open
        roots = connected_components(links) if level else None
        named = big.select(*NAME, "done") if roots is None else big.select(*NAME, "done").join(roots, "id", "left")
        named = named.withColumn("component", F.coalesce("component", "id") if roots is not None else F.col("id"))
        most = named.groupBy("cell", "component").count().groupBy("cell").agg(F.max_by("component", F.struct("count", F.col("component"))).alias("most"))
        open_ = named.join(most, "cell").where("not done and component != most" if level else "not done").select(NAME)
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(level)), "id", "fp"))
        wanted = min(FIRST_PIVOTS << level, MOST_PIVOTS)
        chosen = shared.written(open_.withColumn("pivot", rank - 1).where(F.col("pivot") < wanted), "pivots")
        live = big.join(chosen.select("cell").distinct(), "cell", "left_semi")  # a cell without open members is done
        parts = F.greatest(F.lit(1), F.ceil(F.col("members") / PART)).cast("int")
        dealt = live.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(-1).alias("pivot"), "id", "fp", "shingles")
        every = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
        told = live.join(chosen, NAME).select("cell", every, "pivot", "id", "fp", "shingles")
        fields = "cell string, id long, fp long, tie long, subs array<struct<sub:int,dist:double,near:boolean>>"
        made = shared.written(dealt.unionByName(told).groupBy("cell", "part").applyInArrow(T.one(_splitter(percent)), fields), "split-cells")
        links = shared.written(links.unionByName(made.where("id != tie").select(F.col("id").alias("a"), F.col("tie").alias("b"))).distinct(), "split-links")
        each = made.select(*NAME, F.explode("subs").alias("x")).select(*NAME, "x.*")
        rim = each.where("not near").groupBy("cell", "sub").agg(F.min("dist").alias("rim"))
        kept = each.join(rim, ["cell", "sub"]).where(F.expr(f"not near or dist >= rim - {radius!r}")).select(*NAME, "sub")
        counts = kept.groupBy("cell", "sub").count().groupBy("cell").agg(F.max("count").alias("top"), F.sum("count").alias("all"))
        told_size = large.select("cell", "members").join(counts, "cell", "left")
        shrinks = F.coalesce(F.col("top") < 0.9 * F.col("members"), F.lit(True)) & F.coalesce(F.col("all") <= 2 * F.col("members"), F.lit(True))
        told_size = shared.written(told_size.select("cell", shrinks.alias("shrinks")), "shrunk")
        used = chosen.select(*NAME, F.lit(True).alias("used"))
        rows = live.join(used, NAME, "left").select(*NAME, "shingles", (F.col("done") | F.coalesce("used", F.lit(False))).alias("done"))
        rows = rows.join(told_size, "cell")
        parted = rows.where("shrinks").join(kept, NAME).select(F.concat_ws("/", "cell", "sub").alias("cell"), *ROW[1:])
        cells = shared.written(rows.where("not shrinks").select(ROW).unionByName(parted), "cells")
        level += 1


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, groups: int | None = None, cell_bytes: int = CELL_BYTES, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: the least id that links reach. Two rows link when
    100 * |intersection| >= percent * |union| of their sets of ``k``-word shingles."""
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = X.text_bytes(src)
    groups, mask = groups or X.group_count(total), kept_bits(total)
    dealt = X.by_hash(src, groups, "id").select("g", "id", "text")
    hops = X.Hops(groups, groups)
    sent = dealt.groupBy("g").applyInArrow(T.one(hops.sent(_sender(k, groups, mask))), hops.schema)
    told = hops.told(hops.answered(sent, _answer))
    rows = shared.written(dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(T.two(_profiler(k, percent, mask, hops)), SPARK_ROWS), "profiles")
    del dealt, sent, told
    shared.release(docs.sparkSession)
    # equal sets are one member: the least id stands for them
    open_ = rows.where("shingles is not null")
    member = open_.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "lead", "prefix", "sketch", "shingles")).alias("m"))
    member = shared.written(member.select("n", "f1", "f2", "m.*"), "members")
    # shingle regions with two members or more, and the cells that their ties form
    entries = member.select("id", "n", "sketch", "lead", F.posexplode("prefix").alias("at", "s"))
    entries = entries.select("s", "id", "n", (F.col("lead") + F.col("at")).cast("long").alias("place"), "sketch")
    least = entries.groupBy("s").agg(F.min("id").alias("m"), F.count("*").alias("c")).where("c > 1")
    regions = entries.join(least, "s")
    whole = regions.where((F.col("c") > REGION) & (F.col("id") != F.col("m"))).select(F.col("id").alias("a"), F.col("m").alias("b"))
    calm = regions.where(F.col("c") <= REGION).select("s", "id", "n", "place", "sketch")
    edges = calm.repartition("s").sortWithinPartitions("s").mapInArrow(T.steady(_tied(percent)), "a long, b long").unionByName(whole)
    cells = connected_components(edges)
    cells = member.join(cells.withColumnRenamed("component", "cell"), "id").select(F.col("cell").cast("string").alias("cell"), "id", "shingles")
    cells = shared.written(cells, "cells")
    small, links = _split_cells(cells, percent, cell_bytes, cell_members)
    size = cells.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    packs = max(1, -(-size // PACK))
    packed = small.withColumn("pack", F.pmod(F.xxhash64("cell"), F.lit(packs)).cast("int")).repartition(packs, "pack")
    joined = shared.written(packed.groupBy("pack").applyInArrow(T.one(_joiner(percent)), "id long, component long"), "links")
    same = joined.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)
    # rows that share an id are one vertex: its sets are tied, and every such row has the vertex' component
    sets = rows.where("id is not null").groupBy("id").agg(F.min("f1").alias("x"), F.max("f1").alias("y"), F.min("f2").alias("z"), F.max("f2").alias("w"))
    several = shared.written(sets.where("x != y or z != w").select("id"), "several")
    tied = rows.where("n > 0").select("id", "f1", "f2").join(several, "id", "left_semi").join(member.select("f1", "f2", F.col("id").alias("b")), ["f1", "f2"])
    roots = connected_components(same.unionByName(tied.select(F.col("id").alias("a"), "b").where("a != b")))
    # members are few and their copies many: the copies' side is salted against a set that a third of all rows share
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = member.join(roots, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"), salt)
    found = rows.select("id", "n", "f1", "f2").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(named, ["f1", "f2", "salt"], "left")
    vertex = several.join(roots, "id").select("id", F.col("component").alias("vertex"))
    found = found.join(vertex, "id", "left")
    own = F.coalesce("vertex", F.when(F.col("n") > 0, F.col("component")), F.col("id"))
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


SET = "set of shingles"


def _with_sets(text: str, k: int):
    """Rows with a digest of their set of shingles."""

    def add(batches):
        for batch in batches:
            value, off = shingle_sets(batch.column(text), k)
            sets = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.binary())], names=[*batch.schema.names, SET])

    return add


def representatives(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` but one a group of linked documents: the least id stays, with one row for each of its sets, the least
    by its text and then by all its columns as JSON; rows without an id stay."""
    found = jaccard_components(docs, key, **how)
    gone = shared.written(found.where("id != component_id").select(F.col("id").alias(key)).distinct(), "gone")
    again = found.groupBy("id").count().where("count > 1 and id is not null")
    again = shared.written(again.select(F.col("id").alias(key)), "again")
    kept = docs.join(gone, key, "left_anti")
    if again.isEmpty():
        return kept
    several = kept.join(again, key, "left_semi")
    with_sets = several.mapInArrow(T.steady(_with_sets(how.get("text", "text"), how.get("k", SHINGLE))), StructType([*several.schema.fields, StructField(SET, BinaryType())]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = F.min_by(row, F.struct(F.col(how.get("text", "text")), F.to_json(row))).alias("row")
    chosen = with_sets.groupBy(F.col(key).alias("a key"), SET).agg(least).select("row.*")
    return kept.join(again, key, "left_anti").unionByName(chosen)


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
