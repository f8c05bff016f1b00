"""BPE encoding and decoding: greedy longest match proposes, pair checks verify, failures merge exactly.

A text is cut into pieces by the byte-level rule (contractions, runs of letters, of numbers,
of other signs, white space). Each distinct piece is tokenized by greedy longest match, all
pieces in step. A tokenization is what merging gives exactly if no merge could have crossed
the border of any two neighbours, which a vectorised walk down both tokens' merge trees
decides for each distinct pair. Pieces with a failing pair, and very long ones, are merged
exactly, one by one. Distinct pieces are kept between batches, up to a fixed number.

Defined cases: a null or empty text has no tokens and decodes to an empty text; a text of any
length is encoded whole, in parts that are cut where no piece goes on; an empty table gives no
rows; a null id is kept, and rows that share an id are encoded each on its own; only the key
and the text are read, so other columns may have any names; strings of added tokens in a text
become those tokens, as the tokenizers library does by default; a vocabulary with rules that
this module does not have raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as T

U64 = np.uint64
LONG_PIECE, CACHED_PIECES = 256, 1 << 20
#: Longer texts are encoded in parts of about so many bytes.
LONG_TEXT = 4 << 20
OTHER, LETTER, NUMBER, WHITE = range(4)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    signs = "".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, signs):
            out[m.start() : m.end()] = kind
    out[0x1C:0x20] = OTHER  # separators are white space to Python only
    return out


def _supported(spec: dict) -> None:
    """Raises ValueError for a vocabulary whose rules are others than this module's, which would give wrong ids."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [f"an added token's {k}" for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or spec.get("post_processor") and spec["post_processor"]["type"] != "ByteLevel":
        wrong.append("a model, normalizer or post-processor of another kind")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("a pre-tokenizer other than plain byte level")
    if wrong:
        raise ValueError(f"this vocabulary needs {', '.join(wrong)}")


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library.

    Tokens are numbered by merge order here ("rank": single bytes first), ids only at the ends.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec)
        model, signs = spec["model"], byte_signs()
        raw = lambda s: bytes(signs[c] for c in s)
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = [c for c, _ in sorted(signs.items(), key=lambda x: x[1])]
        rank = {c: i for i, c in enumerate(names)}
        split, self.pairs = [(i, i) for i in range(256)], {}
        for a, b in pairs:
            if a + b not in rank:
                rank[a + b] = len(names)
                names.append(a + b)
                split.append((rank[a], rank[b]))
            self.pairs[rank[a] << 32 | rank[b]] = rank[a + b]
        self.tokens = [raw(n) for n in names]
        self.split = np.array(split, np.int64)
        self.id_of = np.array([vocab[n] for n in names], np.int64)
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_tokens = keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)).encode()) if self.added else None
        self._trie()
        known = {int(i): t for i, t in zip(self.id_of, self.tokens)} | {i: t.encode() for t, i in self.added.items()}
        size = max(known) + 1
        self.id_lens = np.array([len(known.get(i, b"")) for i in range(size)], np.int64)
        self.id_bytes = np.frombuffer(b"".join(known.get(i, b"") for i in range(size)), np.uint8)
        self.id_starts = np.cumsum(self.id_lens) - self.id_lens
        self.checked: dict[int, bool] = {}
        self._forget()

    def _trie(self) -> None:
        # nodes that go on come first; their steps lie in one shared array, each node's at an offset of its own
        nodes: dict[bytes, int] = dict.fromkeys([b"", *(t[:k] for t in self.tokens for k in range(1, len(t)))])
        self.inner = len(nodes)
        nodes.update(dict.fromkeys(self.tokens))
        for i, p in enumerate(nodes):
            nodes[p] = i
        steps: list[list[tuple[int, int]]] = [[] for _ in range(self.inner)]
        for p, i in nodes.items():
            if p:
                steps[nodes[p[:-1]]].append((p[-1], i))
        used = bytearray(256 * (self.inner + 2))
        self.base, self.owner, self.step = np.zeros(self.inner, np.int32), np.full(len(used), -1, np.int32), np.zeros(len(used), np.int32)
        low = end = 256
        for i in sorted(range(self.inner), key=lambda i: -len(steps[i])):
            signs = [c for c, _ in steps[i]]
            while used[low]:
                low += 1
            # a few tries in the gaps, then behind all others; nodes with one step come last and fill the gaps
            first = low - min(signs)
            base = next((b for b in range(first, first + 16) if not any(used[b + c] for c in signs)), end - min(signs))
            self.base[i], end = base, max(end, base + max(signs) + 1)
            for c, j in steps[i]:
                used[base + c], self.owner[base + c], self.step[base + c] = 1, i, j
        # a step looks at most 255 places behind a base
        self.owner, self.step = self.owner[: end + 256].copy(), self.step[: end + 256].copy()
        self.accepts = np.full(len(nodes), -1, np.int32)
        for i, t in enumerate(self.tokens):
            self.accepts[nodes[t]] = i

    def _forget(self) -> None:
        """Empty the store of pieces: hash -> range of ids."""
        self.seen, self.seen_at, self.seen_len, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # --- pieces

    def greedy(self, buf, starts, ends):
        """Longest-match tokens of each byte range: ranks, and offsets."""
        lanes, pos = np.arange(len(starts)), starts.copy()
        found, where, count = [], [], np.zeros(len(starts), np.int64)
        while len(lanes):
            at, end = pos.copy(), ends[lanes]
            node, best, best_end = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int64), pos.copy()
            live = np.arange(len(lanes))
            while len(live):
                slot = self.base[node] + buf[at[live]]
                ok = self.owner[slot] == node
                live, node = live[ok], self.step[slot[ok]]
                at[live] += 1
                token = self.accepts[node]
                hit = token >= 0
                best[live[hit]], best_end[live[hit]] = token[hit], at[live[hit]]
                more = (at[live] < end[live]) & (node < self.inner)
                live, node = live[more], node[more]
            found.append(best)
            where.append(lanes)
            count[lanes] += 1
            more = best_end < end
            lanes, pos = lanes[more], best_end[more]
        off = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(off[-1], np.int64)
        for k, (lane, token) in enumerate(zip(where, found)):
            out[off[lane] + k] = token
        return out, off

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between two tokens.

        The last merges on either side are undone, latest first; the border falls if at some
        point the two tokens beside it had a merge of their own that came before the undone one."""
        ok = np.ones(len(left), bool)
        live, a, b, bound = np.arange(len(left)), left.copy(), right.copy(), np.full(len(left), np.iinfo(np.int64).max)
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            lost = (self.pair_keys[at] == key) & (self.pair_tokens[at] < bound)
            ok[live[lost]] = False
            live, a, b, bound = live[~lost], a[~lost], b[~lost], bound[~lost]
            a_single, b_single = a < 256, b < 256
            undo_a = ~a_single & ((a > b) | b_single)
            over = a_single & b_single
            # a merge on the left is undone if it is the later one; equal numbers undo the right side first
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.split[a, 1], a), np.where(undo_a, b, self.split[b, 0])
            live, a, b, bound = live[~over], a[~over], b[~over], bound[~over]
        return ok

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging: always the leftmost pair of the lowest rank."""
        token, n = list(piece), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := self.pairs.get(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := self.pairs.get(r << 32 | token[after[j]])) is not None:
                    heapq.heappush(heap, (s, i, r, token[after[j]]))
            if (k := before[i]) >= 0 and (s := self.pairs.get(token[k] << 32 | r)) is not None:
                heapq.heappush(heap, (s, k, token[k], r))
        return [t for t in token if t >= 0]

    def _tokenize(self, buf, starts, ends):
        """Ranks of each byte range, exact: ids and offsets."""
        long = ends - starts > LONG_PIECE
        ranks, off = self.greedy(buf, starts, np.where(long, starts + 1, ends))
        lane = T.rows_of(off)
        inner = np.flatnonzero(lane[1:] == lane[:-1]) if len(lane) else np.zeros(0, np.int64)
        pair, back = np.unique(ranks[inner] << 32 | ranks[inner + 1], return_inverse=True)
        fails = ~self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        bad = np.unique(np.concatenate([lane[inner[fails[back]]], np.flatnonzero(long)])).astype(np.int64)
        if len(bad):
            fixed = [self.merge(buf[starts[i] : ends[i]].tobytes()) for i in bad]
            lens = np.diff(off)
            lens[bad] = [len(x) for x in fixed]
            new = np.concatenate([[0], np.cumsum(lens)])
            out = np.empty(new[-1], np.int64)
            good = np.ones(len(lens), bool)
            good[bad] = False
            out[T.ragged(new[:-1][good], lens[good])] = ranks[T.ragged(off[:-1][good], lens[good])]
            out[T.ragged(new[:-1][bad], lens[bad])] = np.concatenate(fixed) if fixed else 0
            ranks, off = out, new
        return self.id_of[ranks].astype(np.int32), off

    # --- texts

    def pieces(self, buf: np.ndarray, off: np.ndarray):
        """Start, end and fixed id (or -1) of every piece of a batch; no piece crosses a row."""
        if not len(buf):
            none = np.zeros(0, np.int64)
            return none, none, none
        marks = [(m.start(), m.end(), self.added[m.group().decode()]) for row in self._rows_with_added(buf, off) for m in row]
        bounds = np.unique(np.concatenate([off, *([[a, b] for a, b, _ in marks])])) if marks else np.unique(off)
        lead = (buf & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = classes()[points]
        edge = np.zeros(len(points) + 1, bool)
        edge[np.searchsorted(at, bounds)] = True
        edge[-1] = True
        white, blank = kind == WHITE, points == 0x20
        start = edge[:-1].copy()
        start[1:] |= ~white[1:] & (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~edge[1:-1])
        start[1:] |= white[1:] & ~white[:-1]
        last_white = np.zeros(len(points), bool)
        last_white[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
        start |= last_white
        self._contractions(points, start, edge, blank)
        first = np.flatnonzero(start)
        starts = at[first]
        ends = np.append(starts[1:], len(buf))
        fixed = np.full(len(starts), -1, np.int64)
        if marks:
            keep = np.ones(len(starts), bool)
            for a, b, i in marks:
                lo, hi = np.searchsorted(starts, [a, b])
                keep[lo + 1 : hi], ends[lo], fixed[lo] = False, b, i
            starts, ends, fixed = starts[keep], ends[keep], fixed[keep]
        return starts, ends, fixed

    def _rows_with_added(self, buf, off):
        if self.added_pattern is None:
            return
        data = buf.tobytes()
        if not any(t.encode() in data for t in self.added):
            return
        for a, b in zip(off[:-1], off[1:]):
            yield self.added_pattern.finditer(data, int(a), int(b))

    @staticmethod
    def _contractions(points, start, edge, blank) -> None:
        """A quote that begins a piece takes s, t, m, d, re, ve or ll with it, and the piece ends there."""
        quote = np.flatnonzero((points == 0x27) & start)
        quote = quote[quote + 1 < len(points)]
        quote = quote[~edge[quote + 1]]
        one = points[quote + 1]
        two = np.where((quote + 2 < len(points)), points[np.minimum(quote + 2, len(points) - 1)], 0)
        two = np.where(edge[np.minimum(quote + 2, len(points))], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, n in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            after = at[at + n < len(points)] + n
            # what follows begins a piece of its own, but the last white space of a run is found already
            start[after[~edge[after]]] = True

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row of a string column, one after another, and the n+1 row offsets."""
        buf, off = T.flat(column)
        starts, ends, fixed = self.pieces(buf, off)
        h = T.hashes(buf, starts, ends)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.seen, distinct), max(len(self.seen) - 1, 0))
        new = self.seen[where] != distinct if len(self.seen) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.seen) > CACHED_PIECES:
                self._forget()
                new = np.ones(len(distinct), bool)
            ids, ioff = self._tokenize(buf, starts[first[new]], ends[first[new]])
            into = np.searchsorted(self.seen, distinct[new])
            self.seen_at = np.insert(self.seen_at, into, len(self.ids) + ioff[:-1])
            self.seen_len = np.insert(self.seen_len, into, np.diff(ioff))
            self.ids = np.concatenate([self.ids, ids])
            self.seen = np.insert(self.seen, into, distinct[new])
            where = np.searchsorted(self.seen, distinct)
        at, lens = self.seen_at[where][back], self.seen_len[where][back]
        lens = np.where(fixed >= 0, 1, lens)
        total = np.concatenate([[0], np.cumsum(lens)])
        out = self.ids[T.ragged(np.where(fixed >= 0, 0, at), lens)] if total[-1] else np.zeros(0, np.int32)
        marked = np.flatnonzero(fixed >= 0)
        out[total[marked]] = fixed[marked]
        return out, total[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and the length of each."""
        lens = self.id_lens[ids]
        return self.id_bytes[T.ragged(self.id_starts[ids], lens)], lens


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def cuts(raw: np.ndarray, limit: int) -> list[int]:
    """Ends of parts of a text of about ``limit`` bytes. Cuts lie between a letter or digit and white space, where no piece goes on."""
    fit, out, at = np.flatnonzero(_ALNUM[raw[:-1]] & T.SPACE[raw[1:]]) + 1, [], 0
    while len(raw) - at > limit:
        k = int(np.searchsorted(fit, at + limit))
        if k == len(fit):
            break
        at = int(fit[k])
        out.append(at)
    return [*out, len(raw)]


def encode(v: Vocabulary, column) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text and the n+1 offsets; long texts in parts, so that memory does not grow with them."""
    buf, off = T.flat(column)
    if not len(buf) or np.diff(off).max() <= LONG_TEXT or any(c.isspace() for t in v.added for c in t):
        return v.encode(column)
    ids, lens = [], []
    for a, b in zip(off[:-1], off[1:]):
        ends = [a + x for x in cuts(buf[a:b], LONG_TEXT)]
        parts = [v.encode(T.strings(buf[x:y], np.array([0, y - x])))[0] for x, y in zip([a, *ends[:-1]], ends)]
        ids += parts
        lens.append(sum(map(len, parts)))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(lens)])


def decode(v: Vocabulary, ids: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and the number of each; ``limit`` ids at a time."""
    parts = [v.decode(ids[a : a + limit]) for a in range(0, max(len(ids), 1), limit)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded string`` of every row; ``path`` must be readable on the executors."""
    return _mapped(docs, path or default_path(), key, text, digests=False)


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row, without moving ids out of the workers."""
    return _mapped(docs, path or default_path(), key, text, digests=True)


def _mapped(docs: DataFrame, path: str, key: str, text: str, digests: bool) -> DataFrame:
    fields = [("id", pa.int64())] + ([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    schema = pa.schema(fields)

    def rows(batches):
        v = vocabulary(path)
        for batch in batches:
            for a, b in T.spans(batch.column("text"), 2 << 20):
                part = batch.slice(a, b - a)
                ids, off = encode(v, part.column("text"))
                data, lens = decode(v, ids)
                boff = np.concatenate([[0], np.cumsum(lens)])[off]
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(boff[:-1], boff[1:])]
                if digests:
                    texts = [hashlib.sha256(_clean(x)).hexdigest() for x in texts]
                    le = ids.astype("<u4").tobytes()
                    sums = [hashlib.sha256(le[4 * x : 4 * y]).hexdigest() for x, y in zip(off[:-1], off[1:])]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off)), pa.array(sums, pa.string()), pa.array(texts, pa.string())], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], schema=schema)

    shared.bounded(docs.sparkSession)
    kinds = {"id": "long", "n_tokens": "long", "ids": "array<int>"}
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(T.steady(rows), ", ".join(f"{n} {kinds.get(n, 'string')}" for n, _ in fields))


def _clean(raw: bytes) -> bytes:
    """Bytes as the UTF-8 of their decoded text: what is not UTF-8 is replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def op5(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
