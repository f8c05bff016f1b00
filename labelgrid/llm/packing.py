"""Bounded-space online packing of token streams into sequences of at most ``length`` ids.

A document's ids, with an end id, are cut: runs of ``length`` ids are sequences of their
own, the rest is placed. Each partition keeps ``windows`` open windows. A piece goes where it
fits best; when none fits, the fullest window takes the head of the piece, is emitted full,
and the tail is placed anew. At a partition's end the open windows are joined into full ones,
and less than one window is left; leftovers of up to ``fan_in`` partitions are joined the
same way in a second step, and again until one partition is left.

Defined cases: a null or empty text is one end id; rows that share an id are packed each on
its own; a null id is kept as it is; a text of any length is cut into as many sequences as it
needs; an empty table gives no rows; only the key and the text are read, so other columns may
have any names. Padding is at most ``length - 1`` ids for the whole table. Which pieces share a
sequence depends on the partitions; that each id lies in one piece does not.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared
from . import text as T

LENGTH, WINDOWS, END, FAN_IN = 1024, 64, 0, 256
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())])
SPARK_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary, part long"


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, level: int, part: int):
        self.length, self.most, self.level, self.part = length, windows, level, part
        self.open: list[tuple[int, int, list]] = []  # (room, number, pieces), ascending: the fullest first
        self.made, self.rows = 0, []

    def sequence(self) -> int:
        """A number no other partition or level gives out."""
        self.made += 1
        return self.level << 58 | self.part << 34 | self.made

    def emit(self, pieces, keep: bool = False) -> None:
        """Rows of a finished sequence; ``keep`` marks pieces that a later step joins."""
        number, at = self.sequence(), 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, at, raw, self.part if keep else -1))
            at += len(ids)

    def whole(self, doc, ids: np.ndarray) -> None:
        """A whole document: runs of ``length`` ids, then the rest."""
        n, cut = len(ids), len(ids) // self.length * self.length
        for a in range(0, cut, self.length):
            self.emit([(doc, a, ids[a : a + self.length], n)])
        if cut < n:
            self.place((doc, cut, ids[cut:], n))

    def place(self, piece) -> None:
        doc, start, ids, total = piece
        while True:
            i = bisect.bisect_left(self.open, (len(ids), -1))
            if i < len(self.open):
                room, number, pieces = self.open.pop(i)
            elif len(self.open) < self.most:
                room, number, pieces = self.length, self.sequence(), []
            else:
                room, number, pieces = self.open.pop(0)
                self.emit([*pieces, (doc, start, ids[:room], total)])
                start, ids = start + room, ids[room:]
                continue
            pieces.append((doc, start, ids, total))
            if room == len(ids):
                self.emit(pieces)
            else:
                bisect.insort(self.open, (room - len(ids), number, pieces), key=lambda w: w[:2])
            return

    def close(self, last: bool) -> None:
        """Joins the open windows; what does not fill one is left for the next step, or emitted by the last."""
        room, held = self.length, []
        for _, _, pieces in self.open:
            for doc, start, ids, total in pieces:
                while len(ids) >= room:
                    self.emit([*held, (doc, start, ids[:room], total)])
                    start, ids, room, held = start + room, ids[room:], self.length, []
                if len(ids):
                    held.append((doc, start, ids, total))
                    room -= len(ids)
        if held:
            self.emit(held, keep=not last)
        self.open = []

    def batch(self, ids: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) if rows else [[] for _ in SCHEMA]
        cols[7] = [raw if ids or part >= 0 else None for raw, part in zip(cols[7], cols[8])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = WINDOWS, ids: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and with ``ids`` the piece's ids
    as little-endian unsigned 32-bit integers."""
    path = path or bpe.default_path()
    shared.bounded(docs.sparkSession)

    def first(batches):
        v, packer = bpe.vocabulary(path), Packer(length, windows, 0, TaskContext.get().partitionId())
        for batch in batches:
            for a, b in T.spans(batch.column("text"), 2 << 20):
                part = batch.slice(a, b - a)
                found, off = bpe.encode(v, part.column("text"))
                for doc, x, y in zip(part.column("id").to_pylist(), off[:-1], off[1:]):
                    packer.whole(doc, np.append(found[x:y], END))
                yield packer.batch(ids)
        packer.close(last=False)
        yield packer.batch(ids)

    def joining(level: int, last: bool):
        def join(batches):
            packer = Packer(length, windows, level, TaskContext.get().partitionId())
            for batch in batches:
                cols = batch.to_pydict()
                for doc, start, raw, total in zip(cols["doc_id"], cols["start"], cols["ids"], cols["doc_tokens"]):
                    packer.place((doc, start, np.frombuffer(raw, "<u4"), total))
                yield packer.batch(ids)
            packer.close(last)
            yield packer.batch(ids)

        return join

    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = shared.written(src.mapInArrow(T.steady(first), SPARK_SCHEMA), "packed")
    done, level = [made.where("part < 0")], 0
    left = made.where("part >= 0")
    # what is left is less than one window a partition, so a step's input is bounded by fan_in windows a task
    parts = left.agg(F.countDistinct("part")).first()[0]
    while parts:
        level += 1
        into = max(1, -(-parts // fan_in))
        spread = left.repartition(into, F.floor(F.col("part") / fan_in)) if into > 1 else left.coalesce(1)
        made = spread.mapInArrow(joining(level, into == 1), SPARK_SCHEMA)
        if into == 1:
            done.append(made)
            break
        made = shared.written(made, "packed")
        done.append(made.where("part < 0"))
        left = made.where("part >= 0")
        parts = left.agg(F.countDistinct("part")).first()[0]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("part") if ids else out.drop("part", "ids")


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ids=False)
