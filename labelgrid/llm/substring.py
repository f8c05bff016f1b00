"""Substring dedup: words inside windows that an earlier document already has are removed.

Rabin-Karp hashes of every window of ``length`` words are merged per group of documents,
counted over all groups in hash buckets, and answered back to the groups; repeated windows
of a document merge into maximal intervals of removed words. A window is known by 80 bits: a hash
of 64, and 16 of a second one. Groups are ranges of the id,
so "an earlier group has it" needs only the hash; inside a group, ids are compared.

Defined cases: a null text has no words; a null id is neither earlier nor later than any
other, so nothing is removed from such a row and nothing because of it; rows that share an
id are one document as far as "earlier" goes, and each is returned; texts shorter than a
window stay whole, and those of any length are searched whole; an empty table gives no rows;
other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T

WINDOW, CHECK, CHECK_SEED = 13, np.uint64(0xFFFF), np.uint64(0xC4CEB9FE1A85EC53)


def _windows(column, length: int):
    """Bytes and words of a string column; hash, check bits, row and first word of each window.

    The check bits are those of a second, independent hash: windows are equal only if both agree."""
    buf, off = T.flat(column)
    starts, ends, woff = T.words(buf, off)
    unit = T.hashes(buf, starts, ends)
    roll, check = T.rolling(unit, length), T.rolling(T.mix(unit ^ CHECK_SEED), length) & CHECK
    n = np.diff(woff) - length + 1
    n[n < 0] = 0
    at = T.ragged(woff[:-1], n)
    return buf, off, starts, ends, woff, roll[at], check[at], np.repeat(np.arange(len(n)), n), at


def _by_value(h: np.ndarray, check: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, check bits and ``last``, and where a new window begins in it. Sorting by check bits is left out
    where no two windows with the same hash differ in them, as is nearly always so."""
    order = np.argsort(h, kind="stable") if last is None else np.lexsort((last, h))
    sh, sc = h[order], check[order]
    same = sh[1:] == sh[:-1]
    if (same & (sc[1:] != sc[:-1])).any():
        order = np.lexsort(((np.arange(len(h)) if last is None else last), check, h))
        sh, sc = h[order], check[order]
        same = sh[1:] == sh[:-1]
    return order, np.concatenate([[True], ~same | (sc[1:] != sc[:-1])]) if len(h) else np.zeros(0, bool)


def _seen(known: np.ndarray, checks: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which windows are among ``known`` (ascending by hash, equal hashes with different check bits)."""
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    out, run = np.zeros(len(h), bool), 0
    while True:
        here = np.minimum(at + run, len(known) - 1)
        same = known[here] == h
        out |= same & (checks[here] == check)
        run += 1
        if run >= len(known) or not (known[run:] == known[:-run]).any():
            return out


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _earlier_inside(ids, known, row, h, check) -> np.ndarray:
    """Windows that a smaller id of the same table has."""
    out = np.zeros(len(h), bool)
    use = np.flatnonzero(known[row])
    order, new = _by_value(h[use], check[use], ids[row[use]])
    order = use[order]
    if len(order):
        sid, first = ids[row[order]], np.flatnonzero(new)
        least = np.repeat(sid[first], np.diff(np.append(first, len(sid))))
        out[order] = sid > least
    return out


def _covered(n_words: int, at: np.ndarray, length: int) -> np.ndarray:
    """Words inside the windows that begin at ``at``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _kept_bytes(buf, off, starts, ends, woff, gone):
    """Kept words joined by one space: bytes and row offsets."""
    kept = np.flatnonzero(~gone)
    row = T.rows_of(woff)[kept]
    followed = np.concatenate([row[1:] == row[:-1], [False]]) if len(kept) else np.zeros(0, bool)
    step = np.zeros(len(buf) + 2, np.int8)
    step[starts[kept]] += 1
    close = ends[kept] + followed
    # a kept word's separator may be the byte before the next word
    np.add.at(step, close, -1)
    take = np.cumsum(step[: len(buf)], dtype=np.int8) > 0
    out = buf.copy()
    out[ends[kept[followed]]] = 0x20
    count = np.concatenate([[0], np.cumsum(take)])
    return out[take], count[off]


def _sender(length: int, buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        ids, known = _ids(table)
        *_, h, check, row, _ = _windows(table["text"], length)
        h, check = h[known[row]], check[known[row]]
        order, new = _by_value(h, check)
        order = order[new]
        return pa.Table.from_batches([X.to_buckets(key[0].as_py(), h[order], check[order], buckets)])

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Windows that an earlier group has, to each group that has them too."""
    h, g, check, _ = X.merged(table)
    order, new = _by_value(h, check)
    later = np.sort(order[~new])
    return pa.Table.from_batches([X.replies(key[0].as_py(), g[later], h[later], check[later])])


def _remover(length: int, schema: pa.Schema, texts: bool, hops: X.Hops):
    def remove(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        seen, checks = X.received(hops.rows(told))
        ids, known = _ids(docs)
        buf, off, starts, ends, woff, h, check, row, at = _windows(docs["text"], length)
        hit = _seen(seen, checks, h, check) & known[row]
        hit |= _earlier_inside(ids, known, row, h, check)
        gone = _covered(len(starts), at[hit], length)
        kept, koff = _kept_bytes(buf, off, starts, ends, woff, gone)
        total = np.concatenate([[0], np.cumsum(gone)])
        out = {"n_words": np.diff(woff), "n_removed": np.diff(total[woff])}
        data = kept.tobytes()
        if texts:
            # rows that lose nothing keep their text as it is
            new, old = T.strings(kept, koff), docs["text"].combine_chunks().cast(pa.large_string())
            out["new_text"] = pa.compute.if_else(pa.array(out["n_removed"] > 0), new, old).cast(pa.string())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            row_first = np.zeros(len(gone) + 1, bool)
            row_first[woff] = True
            inner = np.flatnonzero(row_first[1:-1] & gone[1:] & gone[:-1]) + 1 if len(gone) > 1 else np.zeros(0, np.int64)
            lo = np.sort(np.concatenate([edge[::2], inner]))
            hi = np.sort(np.concatenate([edge[1::2], inner]))
            ioff = np.searchsorted(lo, woff)
            base = np.repeat(woff[:-1], np.diff(ioff))
            pairs = pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], names=["first", "last"])
            out["removed"] = pa.ListArray.from_arrays(pa.array(ioff, pa.int32()), pairs)
        out["kept_sha256"] = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(koff[:-1], koff[1:])]
        return pa.table([docs["row"] if f.name == "row" else docs["id"] if f.name == "id" else pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)

    return remove


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW, groups: int | None = None, texts: bool = False) -> DataFrame:
    """Per row: ``id, n_words, n_removed, kept_sha256``, and with ``texts`` also ``new_text`` and ``removed``,
    the maximal intervals [first, last) of removed words. ``row`` carries all columns of the input when ``texts`` is set.

    ``groups`` only sets how the work is cut; the result does not depend on it.
    """
    cols = [F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")]
    src = docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")] if texts else []))
    groups = groups or X.group_count(X.text_bytes(src))
    dealt = X.by_range(src, groups, "id")
    # all columns as below, so that both steps read one exchange
    hops = X.Hops(groups, groups)
    sent = dealt.groupBy("g").applyInArrow(T.one(hops.sent(_sender(length, groups))), hops.schema)
    told = hops.told(hops.answered(sent, _answer))
    fields = [("id", pa.int64(), "id long"), ("n_words", pa.int64(), "n_words long"), ("n_removed", pa.int64(), "n_removed long"), ("kept_sha256", pa.string(), "kept_sha256 string")]
    if texts:
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        fields += [("new_text", pa.string(), "new_text string"), ("removed", spans, "removed array<struct<first:long,last:long>>")]
    schema, spark_schema = pa.schema([f[:2] for f in fields]), ", ".join(f[2] for f in fields)
    if texts:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = schema.append(pa.field("row", to_arrow_type(src.schema["row"].dataType)))
        spark_schema += f", row {src.schema['row'].dataType.simpleString()}"
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(T.two(_remover(length, schema, texts, hops)), spark_schema)


def shortened(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with repeated words removed; rows that lose words get their new length, if there is
    such a column. Rows that lose nothing keep their text sign by sign."""
    out = repeated_words(docs, key, text, texts=True)
    cols = []
    for f in docs.schema:
        if f.name == text:
            c = F.col("new_text").cast(f.dataType)
        elif f.name == size and size != key:
            c = F.when(F.col("n_removed") > 0, F.length("new_text").cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`"))
        else:
            c = F.col(f"row.`{f.name}`")
        cols.append(c.alias(f.name))
    return out.select(*cols)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_words(docs.select("doc_id", "text")).withColumnRenamed("id", "doc_id")
