"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are array arithmetic over whole batches. The trees are grown on the driver from at
most ``sample`` labelled rows (the first in hash order of their id, so the choice does not
depend on partitioning), and flattened into arrays; scoring walks all trees of a batch in step.

Defined cases: a null text is an empty one and gets a score like any other; a text of any length is measured whole; a null id is
never held out and never learned from; rows that share an id are scored each on its own, and of several labels for an id the
least counts; without labels every score is 0.5; an empty table gives no rows; extra columns are not read, and stay as they
are whatever their names (``scored`` replaces a column of the score's name, ``accepted`` none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared
from . import text as T

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST_ROWS, SMOOTH, THRESHOLD = 20_000, 80, 5, 64, 0.15, 20, 1.0, 0.3
#: Byte classes of which a text's share is a statistic.
CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": [33, 44, 46, 58, 59, 63],
    "sign": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 126],
    "bar": [47, 92, 124],
    "bracket": [34, 39, 40, 41, 91, 93, 123, 125],
    "high": list(range(128, 256)),
    "line": [10],
    "control": [*range(9), *range(14, 32), 127],
}
NAMES = ["log_bytes", "log_words", *[f"{c}_share" for c in CLASSES], "word_mean", "word_spread", "word_longest", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "upper_words", "signed_words", "short_words", "words_a_line"]


def statistics(column) -> np.ndarray:
    """One row of statistics a text, over the whole text."""
    buf, off = T.flat(column)
    n, size = len(off) - 1, np.diff(off)
    each = np.maximum(size, 1)
    out = np.zeros((n, len(NAMES)))
    col = iter(range(len(NAMES)))
    starts, ends, woff = T.words(buf, off)
    count = np.diff(woff)
    many = np.maximum(count, 1)
    row = T.rows_of(woff)
    out[:, next(col)], out[:, next(col)] = np.log1p(size), np.log1p(count)
    table = np.zeros(256, np.uint8)
    for k, signs in enumerate(CLASSES.values()):
        table[signs] = k + 1
    kinds, shares = table[buf], {}
    for k, name in enumerate(CLASSES):
        shares[name] = _per_row(kinds == k + 1, off)
        out[:, next(col)] = shares[name] / each
    lens = (ends - starts).astype(float)
    by_word = lambda x: np.bincount(row, x, n) if len(row) else np.zeros(n)
    mean = by_word(lens) / many
    out[:, next(col)] = mean
    out[:, next(col)] = np.sqrt(np.maximum(by_word(lens * lens) / many - mean * mean, 0))
    longest = np.zeros(n)
    if len(row):
        longest[count > 0] = np.maximum.reduceat(lens, woff[:-1][count > 0])
    out[:, next(col)] = np.log1p(longest)
    h = T.hashes(buf, starts, ends)
    distinct, top = _distinct(row, h, n)
    out[:, next(col)], out[:, next(col)] = distinct / many, top / many
    same = row[1:] == row[:-1]
    next_same = np.flatnonzero(same & (h[1:] == h[:-1])) if len(h) else np.zeros(0, np.int64)
    out[:, next(col)] = np.bincount(row[next_same], minlength=n) / many if len(row) else 0
    pairs = np.flatnonzero(same)
    pair_count = np.bincount(row[pairs], minlength=n) if len(row) else np.zeros(n)
    if len(pairs):
        out[:, next(col)] = _distinct(row[pairs], h[pairs] * T.U64(31) + h[pairs + 1], n)[0] / np.maximum(pair_count, 1)
    else:
        next(col)
    if len(row):
        up = np.concatenate([[0], np.cumsum(kinds == 1)])
        word_up = up[ends] - up[starts]
        last = kinds[ends - 1]
        out[:, next(col)] = by_word((word_up == lens) & (lens > 1)) / many
        out[:, next(col)] = by_word((last == 5) | (last == 6) | (buf[ends - 1] == 33)) / many
        out[:, next(col)] = by_word(lens <= 3) / many
    else:
        for _ in range(3):
            next(col)
    out[:, next(col)] = np.log1p(count / (shares["line"] + 1))
    return out


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(float)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its commonest."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    r, v = row[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    run = np.diff(np.append(new, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], run)
    return np.bincount(r[new], minlength=n).astype(float), top


@dataclass
class Trees:
    """Complete binary trees as flat arrays: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees = np.arange(len(self.value))[None, :]
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.value)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            raw = self.base + self.value[trees, node - self.feature.shape[1]].sum(axis=1)
            out[a : a + 4096] = 1 / (1 + np.exp(-raw))
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees of fixed depth for 0/1 labels, by second-order logistic loss on binned statistics."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if not len(y) or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width = x.shape[1]
    slot = bins + np.arange(width) * BINS
    raw, feats, tops, values = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width_l = 2**level - 1, 2**level
            at = ((node - first) * (width * BINS))[:, None] + slot
            hist = [np.bincount(at.ravel(), np.repeat(v, width), width_l * width * BINS).reshape(width_l, width, BINS) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (np.cumsum(v, axis=2)[:, :, :-1] for v in hist)
            gt, ht, nt = (v.sum(axis=2, keepdims=True) for v in hist)
            gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = -np.inf
            flat = gain.reshape(width_l, -1)
            best = flat.argmax(axis=1)
            split = np.full(inner, BINS)
            for k in range(width_l):
                f, b = divmod(int(best[k]), BINS - 1)
                if flat[k, best[k]] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k], split[first + k] = f, cuts[f][b], b
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > split[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SMOOTH)
        raw += value[leaf]
        feats.append(feature)
        tops.append(cut)
        values.append(value)
    return Trees(np.array(feats), np.array(tops), np.array(values), base)


def remainder(key: str, parts: int):
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Trees:
    """Trees for the labelled documents whose crc32(id) mod ``folds`` is not 0, from at most ``sample`` of them."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    known = known.where(remainder("id", folds) != 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows of two numbers, so its size is bounded
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "id")

    def measure(batches):
        for batch in batches:
            for a, b in T.spans(batch.column("text"), 2 << 20):
                part = batch.slice(a, b - a)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(NAMES), pa.int32()), pa.array(statistics(part.column("text")).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), stats], names=["id", "y", "x"])

    # of rows that share an id, one is learned from: at most ``sample`` rows of numbers reach the driver
    measured = texts.mapInArrow(T.steady(measure), "id long, y int, x array<double>")
    rows = measured.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.y", "r.x").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if rows.num_rows else np.zeros((0, len(NAMES)))
    y, ids = rows["y"].to_numpy().astype(float), rows["id"].to_numpy()
    order = np.lexsort((*x.T, ids))
    return grow(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, which replaces a column of its name."""
    shared.bounded(docs.sparkSession)
    kept = docs.drop(name)
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])

    def score(batches):
        for batch in batches:
            for a, b in T.spans(batch.column(text), 2 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees.score(statistics(part.column(text))))], names=[*part.schema.names, name])

    return kept.mapInArrow(T.steady(score), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are."""
    name, taken = "score", {c.lower() for c in docs.columns}  # Spark's names don't mind case
    while name in taken:
        name += "_"
    return scored(docs, train(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, trees)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
