"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Every word has a class: the most frequent words of the
training documents form ``HEAD`` classes of ``SLOTS`` words by rank, and all others share the remaining classes by their hash.
Inside a head class the choice is a softmax of its own; inside the others a word has its smoothed unigram probability (words
never seen count as one more word). Features of the history are the previous word and the words two and three back
(skips), hashed into fixed weight tables.

Word counts over all training documents are summed in Spark as sorted blobs (``exchange``). Training makes one pass over
all training tokens in ``rounds`` slices. Documents are dealt into shards by their id and sorted inside them, so what is
learned does not depend on how the table is partitioned. A shard takes gradient steps from the current weights over its
part of a slice and sends its change, with how often it touched each row; changes are averaged row by row, in two steps
of at most ``FAN`` shards each, and the next slice starts from there. The weights' size is fixed by constants (about 8 MB), so
they are broadcast. Scoring multiplies nothing dense: it gathers the rows of active features.

That model is the base of one that grows with the corpus. Every pair of a history (the word three back, the word two back,
the previous word, the two previous words) and its next word, of any word, is counted over all training documents; from
the weaker history to the stronger, P = (n(history, word) + s * P') / (n(history) + s), P' being the step before. Pairs are
counted in two passes, so that the blobs of one are gone before the next; the first is the words' as well. The bits of a
pair's hash grow with the text, so that less than one in 200 of its values is used.

Defined cases: a null or empty text is one end token; a null id is never held out; rows that share an id are scored each
on its own; an empty table gives no rows; without training documents every word is unseen (N = V = 0) and both scores are
sums of log10(1) = 0 but for the class model's share; a word of any length is one token, and a text of any length is
learned and scored whole; only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import shared
from . import text as T

U64 = np.uint64
CLASSES, HEAD, SLOTS, ROWS_LOG2, ROUNDS, RATE, BATCH, FOLDS = 32, 16, 32, 15, 3, 0.8, 8192, 7
TAIL, WORDS = CLASSES - HEAD, HEAD * SLOTS
#: Bytes of text in a training shard while there are at most ``SHARDS``; bytes between two cuts into steps; changes that one task averages.
SHARD_BYTES, SHARDS, CHUNK, FAN = 16 << 20, 4096, 1 << 20, 256
ROWS = 1 << ROWS_LOG2
BLOCKS, PLACES_LOG2 = 16, 20
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Histories of the counted pairs, the weakest first: number in their pass, seed, least place in a document, strength of
#: what they correct.
GRAMS = {
    "three": (1, 0xD6E8FEB86659FD93, 3, 100000.0),
    "two": (0, 0xA0761D6478BD642F, 2, 100000.0),
    "one": (0, 0xE7037ED1A0B428DB, 0, 10000.0),
    "pair": (1, 0x8EBC6AF09C88C6E3, 1, 10.0),
}
PASSES = (("one", "pair"), ("two", "three"))
#: Histories whose pairs of any word with the end tell how often the word is too near the end for the next skip.
ENDED = ("one", "two")
PARTS = 1  # buckets of the pairs of one pass a bucket of words
SEEDS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of every text (lower-cased words, then one end), and the n+1 offsets."""
    buf, off = T.flat(column)
    buf = T.LOWER[buf]
    starts, ends, woff = T.words(buf, off)
    h = T.hashes(buf, starts, ends)
    h[h == END] ^= U64(1)
    toff = woff + np.arange(len(woff))
    out = np.empty(toff[-1], U64)
    mask = np.ones(len(out), bool)
    mask[toff[1:] - 1] = False
    out[mask], out[~mask] = h, END
    return out, toff


class Model:
    """Word classes and weights. ``words``: hashes of the words of head classes by rank, with their ``counts``; ``totals`` and
    ``distinct``: training tokens and words of each hash class (head words included)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, distinct: np.ndarray):
        order = np.argsort(words)
        self.known, self.number = words[order], np.arange(len(words))[order]
        # a table in which no two head words meet
        odd = 0x9E3779B97F4A7C15
        while True:
            at = (self.known * U64(odd)) >> U64(64 - PLACES_LOG2)
            if len(np.unique(at)) == len(at):
                break
            odd = (odd * 0xD1342543DE82EF95 | 1) % (1 << 64)
        self.odd, self.places = U64(odd), np.zeros(1 << PLACES_LOG2, np.int16)
        self.places[at] = np.arange(len(at))
        self.total, self.distinct = int(totals.sum()), int(distinct.sum())
        own = tail_of(words)
        self.rest_total = totals - np.bincount(own, counts, TAIL).astype(np.int64)
        self.rest_distinct = distinct - np.bincount(own, minlength=TAIL)
        mass = np.concatenate([np.bincount(np.arange(len(words)) // SLOTS, counts, HEAD), self.rest_total])
        slots = np.zeros((HEAD, SLOTS), np.float32)
        slots.ravel()[: len(words)] = counts
        used = np.zeros((HEAD, SLOTS), bool)
        used.ravel()[: len(words)] = True
        # a head class or slot that holds nothing has no probability; a hash class always may come
        self.class_bias = np.where(mass > 0, np.log(np.maximum(mass, 1)), -40).astype(np.float32)
        self.class_bias[HEAD:] = np.maximum(self.class_bias[HEAD:], 0)
        self.class_bias = centred(self.class_bias)
        self.slot_bias = centred(np.where(used, np.log(np.maximum(slots, 1)), -40))
        self.class_weights = np.zeros((ROWS, CLASSES), np.float32)
        self.slot_weights = np.zeros((ROWS, SLOTS), np.float32)

    def targets(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each token (-1: none) and its class."""
        rank = np.full(len(tok), -1)
        if len(self.known):
            slot = self.places[(tok * self.odd) >> U64(64 - PLACES_LOG2)]
            rank = np.where(self.known[slot] == tok, self.number[slot], -1)
        return rank, np.where(rank >= 0, rank // SLOTS, HEAD + tail_of(tok))


def tail_of(tok: np.ndarray) -> np.ndarray:
    """Hash class of each word that is in no head class."""
    return ((tok >> U64(32)) % U64(TAIL)).astype(np.int64)


def _places(toff: np.ndarray) -> np.ndarray:
    return np.arange(toff[-1]) - np.repeat(toff[:-1], np.diff(toff))


def _back(x: np.ndarray, toff: np.ndarray, k: int, start) -> np.ndarray:
    """What each token's k-th token back has, or ``start`` where a document has none."""
    out = np.full(len(x), start, x.dtype)
    out[k:] = x[:-k] if len(x) > k else out[k:]
    out[_places(toff) < k] = start
    return out


def features(tok: np.ndarray, toff: np.ndarray) -> np.ndarray:
    """Rows of the weight tables for each token's history: previous word, two and three back."""
    rows = [T.mix(_back(tok, toff, k, START) * SEEDS[k]) >> U64(64 - ROWS_LOG2) for k in (1, 2, 3)]
    return np.stack([r.astype(np.uint16) for r in rows], axis=1)


def slot_features(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows for the choice inside a class: previous word and two back, each with the class."""
    mixed = lambda x, seed: (T.mix((x.astype(U64) << U64(8) | group.astype(U64)) * seed) >> U64(64 - ROWS_LOG2)).astype(np.uint16)
    return np.stack([mixed(rows[:, 0], SEEDS[4]), mixed(rows[:, 1], SEEDS[5])], axis=1)


def _folded(x: np.ndarray, f) -> np.ndarray:
    """Each row folded by halves; rows have a power of two of columns."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        x = f(x[:, :half], x[:, half:])
    return x


def exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits), and their sums as a column. Biases are centred, so only far outliers need a shift of their rows."""
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = _folded(e, np.add)
    if not (np.isfinite(total) & (total > 1e-30)).all():
        logits -= _folded(logits, np.maximum)
        e = np.exp(logits)
        total = _folded(e, np.add)
    return e, total


def centred(bias: np.ndarray) -> np.ndarray:
    """Rows of log weights, less the logarithm of their sum."""
    top = bias.max(axis=-1, keepdims=True)
    return (bias - top - np.log(np.exp(bias - top).sum(axis=-1, keepdims=True))).astype(np.float32)


def _gathered(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        out += np.take(weights, rows[:, j], axis=0)
    out += bias
    return out


def _segment_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows. Pairs of single-precision columns are added as one complex number, which takes half the time."""
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)


def _log_chosen(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of one column of each row."""
    _, total = exponentials(logits)
    return logits[np.arange(len(logits)), target] - np.log(total[:, 0])


def score_tokens(m: Model, tok: np.ndarray, toff: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log probability of every token under the model; ``counts``: its training count."""
    (rank, group), rows = m.targets(tok), features(tok, toff)
    out = np.empty(len(tok))
    for a in range(0, len(tok), BATCH):
        s = slice(a, a + BATCH)
        out[s] = _log_chosen(_gathered(m.class_weights, rows[s], m.class_bias), group[s])
    rest = np.flatnonzero(rank < 0)
    out[rest] += np.log((counts[rest] + 1.0) / (m.rest_total + m.rest_distinct + 1.0)[group[rest] - HEAD])
    inner = np.flatnonzero(rank >= 0)
    for a in range(0, len(inner), BATCH):
        i = inner[a : a + BATCH]
        out[i] += _log_chosen(_gathered(m.slot_weights, slot_features(rows[i], group[i]), m.slot_bias[group[i]]), rank[i] % SLOTS)
    return out


class Trainer:
    """Gradient steps of one task, from the weights of a model; steps shrink with a row's past gradients."""

    def __init__(self, m: Model):
        self.m = m
        self.tables = [(m.class_weights.copy(), np.full(ROWS, 1e-3, np.float32), np.zeros(ROWS, np.int64)), (m.slot_weights.copy(), np.full(ROWS, 1e-3, np.float32), np.zeros(ROWS, np.int64))]

    def _step(self, table: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        weights, past, touched = self.tables[table]
        n = len(rows)
        g, total = exponentials(_gathered(weights, rows, bias))
        g /= total
        g[np.arange(n), target] -= 1
        flat = rows.T.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        sums, at = _segment_sums(np.take(g, order % n, axis=0), first), flat[first].astype(np.int64)
        past[at] += np.einsum("ij,ij->i", sums, sums)
        weights[at] -= RATE * sums / np.sqrt(past[at])[:, None]
        touched[at] += np.diff(np.append(first, len(flat)))

    def learn(self, tok: np.ndarray, toff: np.ndarray) -> None:
        m = self.m
        (rank, group), rows = m.targets(tok), features(tok, toff)
        for a in range(0, len(tok), BATCH):
            s = slice(a, a + BATCH)
            self._step(0, rows[s], m.class_bias, group[s])
        inner = np.flatnonzero(rank >= 0)
        for a in range(0, len(inner), BATCH):
            i = inner[a : a + BATCH]
            self._step(1, slot_features(rows[i], group[i]), m.slot_bias[group[i]], rank[i] % SLOTS)

    def changes(self, shard: int) -> pa.RecordBatch:
        """Blocks of rows: change times touches, and touches."""
        rows = []
        for t, ((now, _, touched), was) in enumerate(zip(self.tables, (self.m.class_weights, self.m.slot_weights))):
            size = ROWS // BLOCKS
            for b in range(BLOCKS):
                s = slice(b * size, (b + 1) * size)
                if touched[s].any():
                    rows.append((t * BLOCKS + b, shard, (now[s] - was[s]).astype(np.float16).tobytes(), touched[s].astype(np.float32).tobytes()))
        return pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(("block", "task", "d", "w"), zip(*rows))} if rows else {k: [] for k in ("block", "task", "d", "w")}, schema=CHANGE)


CHANGE = pa.schema([("block", pa.int32()), ("task", pa.int64()), ("d", pa.binary()), ("w", pa.binary())])


def _averaged(batches):
    """Change blocks of one block number, averaged by touches row by row: one row. They come in the order of shards, which
    makes the sums repeatable."""
    change = weight = None
    block = task = 0
    for batch in batches:
        for block, task, d, w in zip(*(batch.column(c).to_pylist() for c in CHANGE.names)):
            w = np.frombuffer(w, np.float32)
            d = np.frombuffer(d, np.float16).reshape(len(w), -1).astype(np.float32)
            if change is None:
                change, weight = np.zeros(d.shape, np.float64), np.zeros(len(w), np.float64)
            change += d * w[:, None]
            weight += w
    if change is not None:
        mean = change / np.maximum(weight, 1)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([mean.astype(np.float16).tobytes()], pa.binary()), pa.array([weight.astype(np.float32).tobytes()], pa.binary())], schema=CHANGE)


def kept_bits(total: int) -> np.uint64:
    """A mask of the leading hash bits by which pairs are known: one for the kind of history, and 2**7 values a byte of text or
    more. The last bit is always free."""
    bits = max(40, 8 * -(-(max(total, 1).bit_length() + 9) // 8))
    return U64((1 << 64) - (1 << (64 - min(bits, 63))))


def histories(tok: np.ndarray, toff: np.ndarray, name: str) -> np.ndarray:
    """Hash of each token's history of one kind."""
    if name == "pair":
        return T.mix(_back(tok, toff, 1, START) * SEEDS[1]) + _back(tok, toff, 2, START)
    return _back(tok, toff, {"one": 1, "two": 2, "three": 3}[name], START)


def grams(tok: np.ndarray, toff: np.ndarray, words: np.ndarray, name: str, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Tokens from the least place on, and the hashes of their pairs; these are followed, for histories in ``ENDED``, by the
    pairs of all distinct ``words`` with the end."""
    kind, seed, least, _ = GRAMS[name]
    at = np.flatnonzero(_places(toff) >= least)
    history, follower = histories(tok, toff, name)[at], tok[at]
    if name in ENDED:
        history = np.concatenate([history, words])
        follower = np.concatenate([follower, np.full(len(words), END)])
    h = T.mix(T.mix(history * U64(seed)) + follower)
    return at, ((h >> U64(1)) | U64(kind << 63)) & mask


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def distinct_grams(tok: np.ndarray, toff: np.ndarray, learn: np.ndarray, words: np.ndarray, names: tuple, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some kinds of history, ascending, and how often training has each here. Whether a token is
    learned from stands in the free bit of its hash, so that one sort of plain numbers counts them."""
    found = []
    for name in names:
        at, h = grams(tok, toff, words, name, mask)
        h[: len(at)] |= learn[at].astype(U64)
        h.sort()
        one, h = h & U64(1), h & mask
        first = _firsts(h)
        found.append((h[first], np.add.reduceat(one, first) if len(first) else one))
    return tuple(np.concatenate(x) for x in zip(*found))


def word_counts(tok: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, ascending, and how often training has each here."""
    h, n = np.unique(tok, return_counts=True)
    other, m = np.unique(tok[~learn], return_counts=True)
    n[np.searchsorted(h, other)] -= m
    return h, n.astype(U64)


def _learns(table: pa.Table, toff: np.ndarray) -> np.ndarray:
    return np.repeat(table["learn"].combine_chunks().to_numpy(zero_copy_only=False), np.diff(toff))


def _sender(buckets: int, mask: np.uint64, names: tuple, with_words: bool):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        tok, toff = tokens(table["text"])
        learn = _learns(table, toff)
        words, n = word_counts(tok, learn)
        pairs = X.to_buckets(g, *distinct_grams(tok, toff, learn, words, names, mask), PARTS * buckets)
        if not with_words:
            return pa.Table.from_batches([pairs])
        at = pa.array(pairs.column("bucket").to_numpy() + np.int32(buckets), pa.int32())
        pairs = pa.RecordBatch.from_arrays([at, *pairs.columns[1:]], schema=X.BLOB_ARROW)
        return pa.Table.from_batches([X.to_buckets(g, words, n, buckets), pairs])

    return send


TOP, STATS = -1, -2


def _answerer(buckets: int):
    """``buckets``: how many of them, from the first, are the words'."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        """The counts over all groups of each group's hashes, in the order that the group has them; of words also the
        bucket's top ones (group -1), and tokens and words of each hash class (group -2)."""
        bucket, cuts = key[0].as_py(), np.cumsum(table["n"].to_numpy())
        hashes, back = np.unique(np.concatenate([X.unpack(x) for x in table["h"].to_pylist()]), return_inverse=True)
        total = np.bincount(back, np.concatenate([X.unplanes(x) for x in table["v"].to_pylist()])).astype(U64)
        v = pa.array([X.planes(x) for x in np.split(total[back], cuts[:-1])], pa.binary())
        out = [pa.table([table["bucket"], table["g"], table["n"], pa.nulls(len(v), pa.binary()), v], schema=X.BLOB_ARROW)]
        if bucket < buckets:
            top = np.lexsort((hashes, -total.astype(np.int64)))[:WORDS]
            top = np.sort(top[total[top] > 0])
            own, seen = tail_of(hashes), total > 0
            sums = np.concatenate([np.bincount(own, total, TAIL), np.bincount(own[seen], minlength=TAIL)]).astype(U64)
            out.append(pa.Table.from_batches([X.replies(bucket, np.full(len(top), TOP, np.int32), hashes[top], total[top])]))
            out.append(pa.Table.from_batches([X.replies(bucket, np.full(2 * TAIL, STATS, np.int32), np.arange(2 * TAIL, dtype=U64), sums)]))
        return pa.concat_tables(out)

    return answer


def _unpacked(batches):
    for batch in batches:
        for g, h, v in zip(*(batch.column(c).to_pylist() for c in ("g", "h", "v"))):
            h, v = X.unpack(h), X.unplanes(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), g), pa.int32()), pa.array(h.view(np.int64)), pa.array(v.view(np.int64))], names=["g", "h", "v"])


def gram_counts(tok: np.ndarray, toff: np.ndarray, words: np.ndarray, word: np.ndarray, count: np.ndarray, told: tuple, mask: np.uint64) -> dict:
    """By kind of history: for each token, how often training has its history with a next word, and with this word.
    ``word``: the place of each token among the distinct ``words``, of which ``count`` are the training counts; ``told``: for
    each pass, the counts of all its ``distinct_grams``."""
    out = {}
    for names, counts in zip(PASSES, told):
        done = 0
        for name in names:
            at, h = grams(tok, toff, words, name, mask)
            order = np.argsort(h)
            first = _firsts(h[order])
            each = np.empty(len(h))
            each[order] = np.repeat(counts[done : done + len(first)], np.diff(first, append=len(h)))
            done += len(first)
            n = np.zeros(len(tok))
            n[at] = each[: len(at)]
            if name == "one":
                # every word is followed by a word or the end; what begins a document follows the start, once a document
                history = _back(count[word], toff, 1, count[words == END].sum())
                followed, one = count, n
            elif name == "pair":
                history = _back(one, toff, 1, 0.0)
            else:
                history = _back(followed[word], toff, GRAMS[name][2], 0.0)
            if name in ENDED:
                followed = np.maximum(followed - each[len(at) :], 0)
            out[name] = (np.maximum(history, n), n)
    return out


def corrected(p: np.ndarray, counts: dict) -> np.ndarray:
    """Probabilities of the base model, corrected by the counted pairs, the strongest history last."""
    for name, (*_, strength) in GRAMS.items():
        history, n = counts[name]
        p = (n + strength * p) / (history + strength)
    return p


def _told(table: pa.Table) -> np.ndarray:
    """Counts that all buckets answered, in the order of hashes."""
    parts = [X.unplanes(x) for x in table.sort_by("bucket")["v"].to_pylist()]
    return np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)


def _scorer(shared_model, buckets: int, mask: np.uint64, hops: tuple):
    def score(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        m = shared_model.value
        if not docs.num_rows:
            return SCORED.empty_table()
        first, second = (h.rows(told.filter(pa.compute.equal(told["pass"], i)).drop_columns("pass")) for i, h in enumerate(hops))
        of_pairs = pa.compute.greater_equal(first["bucket"], buckets)
        counts, pairs = _told(first.filter(pa.compute.invert(of_pairs))), (_told(first.filter(of_pairs)), _told(second))
        tok, toff = tokens(docs["text"])
        lens = np.diff(toff)
        row = np.repeat(np.arange(len(lens)), lens)
        add = lambda x: np.bincount(row, x, len(lens))
        words, word = np.unique(tok, return_inverse=True)
        c = counts[word]
        base = add(np.log10(c + 1)) - lens * math.log10(m.total + m.distinct + 1)
        p = np.empty(len(tok))
        for a, b in T.spans(docs["text"], 2 << 20):
            s = slice(toff[a], toff[b])
            p[s] = score_tokens(m, tok[s], toff[a : b + 1] - toff[a], c[s])
        own = add(np.log10(corrected(np.exp(p), gram_counts(tok, toff, words, word, counts, pairs, mask))))
        return pa.table([docs["id"], docs["held_out"], pa.array(lens, pa.int64()), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(len(lens), m.total), pa.int64()), pa.array(base), pa.array(own)], schema=SCORED)

    return score


SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _learner(told):
    """Rows sorted by shard -> the changes of each shard. Cuts between chunks depend on the shard's rows only."""

    def learn(batches):
        trainer, at, held, size = None, None, [], 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
            for first, last in zip(edges[:-1], edges[1:]):
                if at != shard[first]:
                    if trainer is not None:
                        trainer.learn(*tokens(pa.chunked_array(held, pa.large_string())))
                        yield trainer.changes(at)
                    trainer, at, held, size = Trainer(told.value), int(shard[first]), [], 0
                text = batch.column("text").slice(first, last - first).cast(pa.large_string())
                _, off = T.flat(text)
                a = 0
                while a < len(text):
                    b = min(len(text), max(a + 1, int(np.searchsorted(off, off[a] + CHUNK - size))))
                    held.append(text.slice(a, b - a))
                    size += int(off[b] - off[a])
                    a = b
                    if size >= CHUNK:
                        trainer.learn(*tokens(pa.chunked_array(held)))
                        held, size = [], 0
        if trainer is not None:
            trainer.learn(*tokens(pa.chunked_array(held, pa.large_string())))
            yield trainer.changes(at)

    return learn


def trained(src: DataFrame, model: Model, size: int, rounds: int = ROUNDS) -> Model:
    """One pass over the tokens of all rows that ``learn``, a slice of the documents a round; ``size``: bytes of all texts."""
    spark = src.sparkSession
    shared.bounded(spark)
    shards = min(SHARDS, max(1, -(-size // SHARD_BYTES)))
    name = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")), F.lit(1))
    part = src.where("learn").withColumns({"round": F.pmod(name, F.lit(rounds)), "shard": F.pmod(F.shiftrightunsigned(name, 16), F.lit(shards)).cast("int")})
    fields = "block int, task long, d binary, w binary"
    for r in range(rounds):
        told = spark.sparkContext.broadcast(model)
        mine = part.where(F.col("round") == r).select("shard", "id", F.xxhash64("text").alias("order"), "text")
        sent = mine.repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "order").mapInArrow(T.steady(_learner(told)), fields)
        # two steps, so that no task adds up the blocks of more than ``FAN`` others
        first = sent.withColumn("salt", F.floor(F.col("task") / FAN)).groupBy("block", "salt").applyInArrow(_average_group, fields)
        done = first.groupBy("block").applyInArrow(_average_group, fields).toArrow().to_pylist()
        rows = ROWS // BLOCKS
        for x in done:
            table, b = divmod(x["block"], BLOCKS)
            weights = (model.class_weights, model.slot_weights)[table]
            weights[b * rows : (b + 1) * rows] += np.frombuffer(x["d"], np.float16).reshape(rows, -1).astype(np.float32)
        told.unpersist()
        del mine, sent, first
        shared.release(spark)
    return model


def _average_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_averaged(table.select(CHANGE.names).sort_by("task").to_batches()), schema=CHANGE)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = 2, groups: int | None = None) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, with a model learned from
    the rows whose crc32(id) mod ``folds`` is not ``fold``."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), held.alias("held_out"), (~held).alias("learn"))
    size = X.text_bytes(src)
    groups, mask = groups or X.group_count(size), kept_bits(size)
    dealt = X.by_hash(src, groups, "id").select("g", "id", "text", "held_out", "learn")
    hops = (X.Hops(groups, (1 + PARTS) * groups), X.Hops(groups, PARTS * groups))

    def counted(i: int) -> DataFrame:
        sent = dealt.groupBy("g").applyInArrow(T.one(hops[i].sent(_sender(groups, mask, PASSES[i], i == 0))), hops[i].schema)
        return shared.written(hops[i].answered(sent, _answerer(0 if i else groups)), "counts")

    counts = [counted(0)]
    few = hops[0].aside(counts[0]).mapInArrow(_unpacked, "g int, h long, v long")
    sums = {x.h: int(x.s) for x in few.where(F.col("g") == STATS).groupBy("h").agg(F.sum("v").alias("s")).collect()}
    top = few.where(F.col("g") == TOP).orderBy(F.desc("v"), "h").limit(WORDS).toArrow()
    shared.release(spark)
    totals = np.array([sums.get(i, 0) for i in range(2 * TAIL)], np.int64)
    model = Model(top["h"].to_numpy().view(U64), top["v"].to_numpy().astype(np.int64), totals[:TAIL], totals[TAIL:])
    # training needs little disk, so Spark has deleted the blobs of the first pass when the second begins
    model = spark.sparkContext.broadcast(trained(src, model, size))
    counts.append(counted(1))
    shared.release(spark)
    parts = [h.back(c).withColumn("pass", F.lit(i)) for i, (h, c) in enumerate(zip(hops, counts))]
    told = parts[0].unionByName(parts[1]).repartition(groups, "g")
    fields = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(T.two(_scorer(model, groups, mask, hops)), fields)


def op1(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
