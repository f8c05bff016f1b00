"""Operators on texts against brute force, and their defined cases."""

import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelgrid.llm import bpe, jaccard, lm, packing, quality, substring
from labelgrid.llm import exchange as X
from labelgrid.llm import text as T


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- shared parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1cabé中", max_size=30)), max_size=8))
def test_words_of_any_batch(texts):
    buf, off = T.flat(pa.array(texts, pa.string()))
    starts, ends, woff = T.words(buf, off)
    found = [[buf[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(woff[:-1], woff[1:])]
    assert found == [brute.words(t) for t in texts]
    h = T.hashes(buf, starts, ends)
    flat = [w for f in found for w in f]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_hashes_of_long_words():
    buf, off = T.flat(pa.array(["a" * 3000, "a" * 2999 + "b", "a" * 3000, "a" * 20, "a" * 19 + "b"]))
    starts, ends, _ = T.words(buf, off)
    h = T.hashes(buf, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_rolling_hash_depends_on_the_window_only():
    u = np.random.default_rng(0).integers(0, 1 << 62, 50).astype(np.uint64)
    both = T.rolling(np.concatenate([u, u[7:30]]), 13)
    assert (both[50:] == both[7 : 7 + len(both) - 50]).all() and len(set(both[:38].tolist())) == 38


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=40))
def test_blobs_round_trip(values):
    h = np.array(sorted(values), np.uint64)
    assert (X.unpack(X.pack(h)) == h).all()
    batch = X.to_buckets(3, h, h % np.uint64(5), 4)
    table = pa.Table.from_batches([batch])
    assert sum(batch.column("n").to_pylist()) == len(h) == len(X.merged(table)[0])


# --- substring dedup


def removed(df, **how):
    return {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_words(df, **how).collect() if r["id"] is not None}


def expected(rows):
    return {d: (n, g, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (n, g, kept) in brute.without_repeats(rows).items()}


@pytest.mark.parametrize("groups", [1, 6])
def test_substring_equals_brute_force(documents, groups):
    assert removed(documents, groups=groups) == expected(rows_of(documents))


def test_substring_defined_cases(odd, spark):
    rows = [(d, t) for d, t in rows_of(odd) if d is not None]
    assert removed(odd, groups=3) == expected(rows)
    all_ = substring.repeated_words(odd, groups=3).collect()
    assert len(all_) == odd.count() and all(r["n_removed"] == 0 for r in all_ if r["id"] is None)
    assert substring.repeated_words(odd.limit(0)).collect() == []


def test_shortened_keeps_columns_and_spans(odd):
    out = substring.shortened(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == {r["doc_id"]: r["text"] for r in odd.collect()}[0] and texts[1] == "" and texts[2] is None
    for r in substring.repeated_words(odd, groups=2, texts=True).collect():
        assert sum(s["last"] - s["first"] for s in r["removed"]) == r["n_removed"]
        assert all(a["last"] < b["first"] for a, b in zip(r["removed"], r["removed"][1:]))


# --- near copies


def found_components(df, **how):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **how).collect() if r["id"] is not None}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(documents, k, percent):
    assert found_components(documents, k=k, percent=percent, groups=4) == brute.components(rows_of(documents), k, percent)


@pytest.fixture(scope="module")
def clusters(spark):
    import random

    rnd, rows = random.Random(3), []
    for size in (4, 60, 250):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([60, 120]))]
        for _ in range(size):
            b = list(base)
            for _ in range(rnd.randint(0, 4)):
                i = rnd.randrange(len(b))
                b[i : i + 1] = rnd.choice([[], [f"w{rnd.randrange(3000)}"], [b[i], "new"]])
            rows.append(" ".join(b))
    rnd.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("cell_bytes", [48 << 20, 20_000, 3_000])
def test_large_groups_of_near_copies(clusters, cell_bytes):
    assert found_components(clusters, groups=3, cell_bytes=cell_bytes) == brute.components(rows_of(clusters), 4, 85)


def drifting(seed, members, words=80, chains=5):
    """Texts that drift away from each other step by step, so that links form chains."""
    import random

    rnd, out = random.Random(seed), []
    for _ in range(chains):
        now = [f"w{rnd.randrange(4000)}" for _ in range(words)]
        for _ in range(members):
            out.append(" ".join(now))
            now[rnd.randrange(len(now))] = f"w{rnd.randrange(4000)}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pivots_and_windows_carry_the_join(seed):
    texts = drifting(seed, 60)
    value, off = jaccard.shingle_sets(pa.array(texts), 4)
    ids = np.random.default_rng(seed).permutation(10 * len(texts))[: len(texts)]
    sets = jaccard.Sets(ids, [X.pack(value[a:b]) for a, b in zip(off[:-1], off[1:])], 85)
    leaves, leaf = [], sets.leaf
    sets.leaf = lambda members: (leaves.append(len(members)), leaf(members))
    sets.join(np.arange(len(texts)))
    assert sets.splits > 20 and max(leaves) < len(texts) / 2  # regions were parted, and no leaf holds all
    found = dict(zip(ids.tolist(), sets.components().tolist()))
    assert found == {d: c for d, (_, c) in brute.components(list(zip(ids.tolist(), texts)), 4, 85).items()}


def test_windows_hold_all_links():
    """Any two members within the radius meet in a region, or are linked to the same pivot."""
    value, off = jaccard.shingle_sets(pa.array(drifting(7, 40)), 4)
    sets = jaccard.Sets(np.arange(len(off) - 1), [X.pack(value[a:b]) for a, b in zip(off[:-1], off[1:])], 85)
    everyone = np.arange(len(sets.ids))
    full, linked = sets.distances(everyone, everyone)
    pivots = everyone[::29]
    dist, near = full[pivots], linked[pivots]
    regions = list(jaccard.windows(dist, near, sets.radius))
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        assert any(r[i] and r[j] for r in regions) or (near[:, i] & near[:, j]).any()


def test_sketches_and_places_lose_no_link(documents):
    rows = [(d, t) for d, t in rows_of(documents) if t]
    value, off = jaccard.shingle_sets(pa.array([t for _, t in rows]), 4)
    sketch = np.frombuffer(b"".join(jaccard.sketches(value, off, np.ones(len(rows), bool))), np.uint8).reshape(-1, jaccard.SKETCH)
    n, linked = np.diff(off), brute.components(rows, 4, 85)
    root = jaccard.ties(np.zeros(len(rows), np.int64), n, np.zeros(len(rows), np.int64), sketch, 85)
    where = {d: i for i, (d, _) in enumerate(rows)}
    assert all(root[where[d]] == root[where[c]] for d, (_, c) in linked.items())
    assert len(set(root.tolist())) > len(rows) / 2  # and most others are apart


@pytest.mark.parametrize("first, most, members", [(8, 64, 24), (4, 32, 12)])
def test_cells_are_split_over_tasks(spark, clusters, monkeypatch, first, most, members):
    for name, value in {"FIRST_PIVOTS": first, "MOST_PIVOTS": most, "PART": 16, "PIVOTS": min(8, first)}.items():
        monkeypatch.setattr(jaccard, name, value)
    largest, split = [], jaccard._split_cells

    def watched(*args):
        small, links = split(*args)
        largest.append((small.groupBy("cell").count().agg({"count": "max"}).first()[0], links.count()))
        return small, links

    monkeypatch.setattr(jaccard, "_split_cells", watched)
    chains = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(drifting(1, 60, chains=2))], "doc_id long, text string")
    table = clusters.unionByName(chains)
    assert found_components(table, groups=3, cell_members=members) == brute.components(rows_of(table), 4, 85)
    assert largest[0][0] <= members and largest[0][1] > 50


def test_large_regions_are_tied_as_a_whole(clusters, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 20)
    assert found_components(clusters, groups=2, cell_members=64) == brute.components(rows_of(clusters), 4, 85)


def test_join_defined_cases(odd):
    out = jaccard.jaccard_components(odd).collect()
    assert len(out) == odd.count()
    by = {r["id"]: r["component_id"] for r in out if r["id"] is not None}
    assert by[0] == by[1] == 0 and by[2] == 2 and by[3] == 3 and by[4] == 4 and by[6] == 6
    assert all(r["component_id"] is None for r in out if r["id"] is None)
    assert jaccard.jaccard_components(odd.limit(0)).collect() == []


def test_same_id_with_different_texts_is_one_vertex(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    df = spark.createDataFrame([(5, a), (5, b), (5, "a text of its own"), (5, None), (3, a), (9, b), (8, "another text")], "doc_id long, text string")
    out = jaccard.jaccard_components(df).collect()
    assert {(r["id"], r["component_id"]) for r in out} == {(3, 3), (5, 3), (9, 3), (8, 8)} and len(out) == 7


def test_representatives(odd):
    out = jaccard.representatives(odd)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in out.collect() if r["doc_id"] is not None) == [(True, i) for i in (0, 2, 3, 4, 5, 6, 7, 8, 9)]
    assert out.where("doc_id is null").count() == 2


def test_representatives_keep_unequal_texts_of_an_id(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    df = spark.createDataFrame([(5, a), (5, b), (5, a), (5, a.upper()), (5, None), (5, ""), (8, "another text"), (9, b)], "doc_id long, text string")
    out = [(r["doc_id"], (r["text"] or "").lower()) for r in jaccard.representatives(df).collect()]
    assert sorted(out) == [(5, ""), (5, a), (5, b), (8, "another text")]


@pytest.mark.parametrize("first", [2, 40])
def test_all_sets_of_an_id_are_joined_in_a_cell_that_does_not_shrink(spark, monkeypatch, first):
    monkeypatch.setattr(jaccard, "FIRST_PIVOTS", first)
    rng = np.random.default_rng(4)
    ids = [7, 7, *range(10, 130)]  # all at about the same distance from each other
    sets = [np.unique(np.append(rng.integers(1, 1 << 62, 30).astype(np.uint64), np.uint64(9))) for _ in ids]
    ids, sets = [*ids, 500, 501], [*sets, sets[0][1:], sets[1][:-1]]  # near copies of both sets of an id
    cells = spark.createDataFrame([("c", i, X.pack(s)) for i, s in zip(ids, sets)], "cell string, id long, shingles binary")
    small, links = jaccard._split_cells(cells, 85, 1 << 30, 60)
    found = {frozenset((r["a"], r["b"])) for r in links.collect()}
    for rows in small.groupBy("cell").agg({"id": "collect_list", "shingles": "collect_list"}).collect():
        own = jaccard.Sets(rows["collect_list(id)"], [bytes(x) for x in rows["collect_list(shingles)"]], 85)
        own.join(np.arange(len(own.ids)))
        found |= {frozenset((int(a), int(b))) for a, b in zip(own.ids, own.components())}
    assert {f for f in found if len(f) == 2} == {frozenset((7, 500)), frozenset((7, 501))}


# --- tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def same_ids(v, tokenizer, texts):
    ids, off = v.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = ids[off[i] : off[i + 1]]
        assert own.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)[:200]
        assert v.decode(own)[0].tobytes().decode() == tokenizer.decode(own.tolist(), skip_special_tokens=False) == (t or "")


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "'", "s", "re", "ll", "'t", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "1", "\u00b2", "é", "中文", "!", "<|endoftext|>", "the", " and", "\U0001f600", "\x1c", "\u200b", "0", "_"]), max_size=25).map("".join), max_size=5))
def test_any_text(texts, tokenizer):
    same_ids(bpe.vocabulary(bpe.default_path()), tokenizer, texts)


def test_long_pieces_and_store_overflow(tokenizer, monkeypatch):
    v = bpe.Vocabulary(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    same_ids(v, tokenizer, ["x" * 5000, "ab" * 700, None, "", " " * 900])
    for i in range(5):
        same_ids(v, tokenizer, [" ".join(f"word{i}{j}" for j in range(60))])


def test_encoding_documents(documents, odd, tokenizer):
    for df in (documents, odd):
        out = bpe.encoded(df).collect()
        texts = rows_of(df)
        assert sorted((r["id"] or -1, r["decoded"]) for r in out) == sorted((d or -1, t or "") for d, t in texts)
        by = {(r["id"], r["decoded"]): r["ids"] for r in out}
        assert all(by[d, t or ""] == tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in texts)
    assert bpe.digests(odd.limit(0)).collect() == []


def test_compatibility_equals_merging():
    v = bpe.vocabulary(bpe.default_path())
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(v.tokens), 4000), rng.integers(0, 3000, 4000)
    exact = [v.merge(v.tokens[x] + v.tokens[y]) == [x, y] for x, y in zip(a, b)]
    assert v.compatible(a, b).tolist() == exact


# --- packing


@pytest.mark.parametrize("fan_in", [256, 2])
def test_packing(documents, tokenizer, fan_in):
    out = packing.pack(documents.repartition(5), windows=4, fan_in=fan_in).collect()
    check_pieces(rows_of(documents), out, tokenizer)
    assert len({r["sequence_id"] for r in out}) <= sum(r["length"] for r in out) / 1024 + 1


def check_pieces(texts, out, tokenizer):
    by, sequences = {}, {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == {d for d, _ in texts}
    for d, t in texts:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids"] == ids[at : at + r["length"]].tobytes() and r["ids_crc32"] == zlib.crc32(r["ids"])
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_packing_defined_cases(odd):
    out = packing.pack(odd).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in odd.collect()}
    assert sum(r["length"] for r in out if r["start"] == 0 and r["doc_tokens"] == 1) == 3  # two empty texts and one without an id
    assert packing.pack(odd.limit(0)).collect() == []


# --- language model


def test_counts_equal_brute_force(documents):
    got = {r["id"]: r for r in lm.scored(documents, groups=3).collect()}
    toks = {d: [*brute.words(t, lower=True), None] for d, t in rows_of(documents)}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    c = Counter(w for d, t in toks.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    out = [r for d, r in got.items() if held[d]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better on texts it has not seen


def test_model_is_a_distribution():
    words = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(200, 100, -1)
    # beside the head words, each hash class has 3 words that occur 50 times in all
    own = lm.tail_of(words)
    totals = np.bincount(own, counts, lm.TAIL).astype(np.int64) + 50
    m = lm.Model(words, counts, totals, np.bincount(own, minlength=lm.TAIL) + 3)
    trainer = lm.Trainer(m)
    rng = np.random.default_rng(0)
    trainer.learn(rng.choice(words, 6000), np.array([0, 6000]))
    m.class_weights, m.slot_weights = trainer.tables[0][0], trainer.tables[1][0]
    history = words[[5, 9, 3]]
    last = lambda w, c: math.exp(lm.score_tokens(m, np.append(history, np.uint64(w)), np.array([0, 4]), np.array([0, 0, 0, c]))[3])
    # each head word after one history, and in each hash class its words by their counts and the unseen one
    seen = sum(last(w, 1) for w in words)
    rest = [last((k << 32) + 5, 0) + 3 * last((k << 32) + 5, 50 / 3) for k in range(lm.TAIL)]
    assert seen + sum(rest) == pytest.approx(1, abs=1e-4)


def pair_counts(toks, learn):
    """By kind of history, for every token in order: training count of its history with a next word, and with this word."""

    def history(name, w, i):
        if i < {"one": 0, "pair": 1, "two": 2, "three": 3}[name]:
            return None
        at = lambda k: w[i - k] if i >= k else "<start>"
        return {"one": (at(1),), "pair": (at(2), at(1)), "two": (at(2),), "three": (at(3),)}[name]

    out = {}
    for name in ("three", "two", "one", "pair"):
        flat = [(history(name, w, i), x, ok) for w, ok in zip(toks, learn) for i, x in enumerate((*w, None))]
        both, alone = Counter((h, x) for h, x, ok in flat if ok and h), Counter(h for h, _, ok in flat if ok and h)
        out[name] = [(alone[h], both[h, x]) for h, x, _ in flat]
    return out


def test_pairs_of_the_whole_corpus_count(documents):
    rows = rows_of(documents.limit(40))
    toks = [tuple(brute.words(t, lower=True)) for _, t in rows]
    learn = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    texts = pa.array([t or "" for _, t in rows])
    tok, toff = lm.tokens(texts)
    mask = lm.kept_bits(sum(len(t or "") for _, t in rows))
    known = np.repeat(learn, np.diff(toff))
    words, back = np.unique(tok, return_inverse=True)
    count = np.bincount(back[known], minlength=len(words))
    assert all((x == y).all() for x, y in zip(lm.word_counts(tok, known), (words, count)))
    told = [lm.distinct_grams(tok, toff, known, words, names, mask)[1].astype(float) for names in lm.PASSES]
    got = lm.gram_counts(tok, toff, words, back, count.astype(float), told, mask)
    assert got.keys() == lm.GRAMS.keys()
    for name, expected in pair_counts(toks, learn).items():
        assert list(zip(*(x.tolist() for x in got[name]))) == expected


def test_score_equals_dense_softmax(documents, monkeypatch):
    """Every token's probability by a plain softmax over all classes and slots, and plain pair counts."""
    models, trained = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda *a, **k: models.append(trained(*a, **k)) or models[-1])
    few = documents.where("doc_id % 7 < 2").limit(90)
    got = {r["id"]: r["score"] for r in lm.scored(few, groups=2).collect()}
    m, rows = models[0], sorted(rows_of(few))
    assert np.abs(m.class_weights).max() > 0.1 and np.abs(m.slot_weights).max() > 0.1  # something was learned
    toks = [tuple(brute.words(t, lower=True)) for _, t in rows]
    learn = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    texts = pa.array([t or "" for _, t in rows])
    tok, toff = lm.tokens(texts)
    count = Counter(t for w, ok in zip(toks, learn) if ok for t in (*w, None))
    pairs = pair_counts(toks, learn)
    rank = dict(zip(m.known.tolist(), m.number.tolist()))
    top = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
        h = (h ^ h >> 27) * 0x94D049BB133111EB & top
        return h ^ h >> 31

    def chosen(weights, at, bias, target):
        logits = [float(sum(float(weights[r, j]) for r in at) + float(bias[j])) for j in range(len(bias))]
        high = max(logits)
        return math.exp(logits[target] - high) / sum(math.exp(x - high) for x in logits)

    flat = -1
    for (d, _), words, a, b in zip(rows, toks, toff[:-1], toff[1:]):
        own = [int(x) for x in tok[a:b]]
        score = 0.0
        for i, t in enumerate(own):
            flat += 1
            back = [own[i - k] if i >= k else int(lm.START) for k in (1, 2, 3)]
            at = [mixed(x * int(lm.SEEDS[k]) & top) >> 64 - lm.ROWS_LOG2 for k, x in zip((1, 2, 3), back)]
            group = rank[t] // lm.SLOTS if t in rank else lm.HEAD + (t >> 32) % lm.TAIL
            p = chosen(m.class_weights, at, m.class_bias, group)
            if t in rank:
                inner = [mixed((at[j] << 8 | group) * int(lm.SEEDS[s]) & top) >> 64 - lm.ROWS_LOG2 for j, s in ((0, 4), (1, 5))]
                p *= chosen(m.slot_weights, inner, m.slot_bias[group], rank[t] % lm.SLOTS)
            else:
                c = count[(*words, None)[i]]
                p *= (c + 1) / (m.rest_total[group - lm.HEAD] + m.rest_distinct[group - lm.HEAD] + 1)
            for name in ("three", "two", "one", "pair"):
                history, n = pairs[name][flat]
                s = lm.GRAMS[name][3]
                p = (n + s * p) / (history + s)
            score += math.log10(p)
        assert got[d] == pytest.approx(score, rel=1e-4)


def test_scores_do_not_depend_on_partitions(documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 300_000)
    runs = []
    for table, groups in ((documents.coalesce(1), 2), (documents.repartition(8), 5)):
        runs.append({r["id"]: r["score"] for r in lm.scored(table, groups=groups).collect()})
    assert runs[0].keys() == runs[1].keys() and all(runs[1][d] == pytest.approx(s, rel=1e-9) for d, s in runs[0].items())


def test_rare_words_depend_on_their_history(spark):
    import random

    # 6000 words beyond the classed ones by far, each always followed by the same other one
    rnd, rows = random.Random(5), []
    for i in range(600):
        rows.append((i, " ".join(f"a{j} b{j}" for j in rnd.sample(range(3000), 60))))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    right = {i: " ".join(f"a{j} b{j}" for j in range(k * 20, k * 20 + 20)) for k, i in enumerate(held)}
    wrong = {i: " ".join(f"a{j} b{20 * (j // 20) + (j + 7) % 20}" for j in range(k * 20, k * 20 + 20)) for k, i in enumerate(held)}
    runs = []
    for other, groups in ((right, 1), (right, 3), (wrong, 3)):
        table = spark.createDataFrame([(i, other.get(i, t)) for i, t in rows], "doc_id long, text string").coalesce(1)
        runs.append({r["id"]: r for r in lm.scored(table, groups=groups).where("held_out").collect()})
    one, three, mixed = runs
    assert all(three[i]["score"] == pytest.approx(one[i]["score"], rel=0.03) for i in held)  # what other groups have counts as well; of words as frequent, others may have a class
    assert all(three[i]["base_score"] == pytest.approx(mixed[i]["base_score"]) for i in held)
    # 20 words that follow as ever, or that follow as never
    assert all(three[i]["score"] > mixed[i]["score"] + 10 for i in held)


def test_corrected_model_is_a_distribution():
    p, n = np.full(41, 1 / 41), np.random.default_rng(0).integers(0, 9, (4, 41)).astype(float)
    assert lm.corrected(p, {k: (np.full(41, x.sum()), x) for k, x in zip(lm.GRAMS, n)}).sum() == pytest.approx(1)


def test_lm_defined_cases(odd):
    out = lm.scored(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r["score"]) and not (r["id"] is None and r["held_out"]) for r in out)
    assert {r["n_tokens"] for r in out if r["id"] in (2, 3, 4)} == {1}
    assert lm.scored(odd.limit(0)).collect() == []
    alone = lm.scored(odd.where("doc_id is not null and crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["base_score"] == 0 for r in alone)


# --- quality


def plain_statistics(text):
    """The statistics of one text, by definition."""
    raw, words = (text or "").encode(), [w.encode() for w in brute.words(text)]
    n, each, pairs = len(words), max(len(raw), 1), list(zip(words, words[1:]))
    many, lens = max(n, 1), [len(w) for w in words]
    mean = sum(lens) / many
    counts = Counter(words)
    out = [math.log1p(len(raw)), math.log1p(n)]
    out += [sum(b in signs for b in raw) / each for signs in quality.CLASSES.values()]
    out += [mean, math.sqrt(max(sum(x * x for x in lens) / many - mean * mean, 0)), math.log1p(max(lens, default=0))]
    out += [len(counts) / many, max(counts.values(), default=0) / many, sum(a == b for a, b in pairs) / many, len(set(pairs)) / max(len(pairs), 1)]
    out.append(sum(len(w) > 1 and all(65 <= b <= 90 for b in w) for w in words) / many)
    out.append(sum(w[-1] in quality.CLASSES["sign"] or w[-1] in quality.CLASSES["bar"] or w[-1] == 33 for w in words) / many)
    out.append(sum(x <= 3 for x in lens) / many)
    out.append(math.log1p(n / (raw.count(b"\n") + 1)))
    return out


def test_statistics_by_definition(documents):
    texts = [t for _, t in rows_of(documents.limit(120))] + [None, "", " \t ", "AB cd! EF# x", "a a a\nb/ b|", "é" * 40, "Z" * 5000 + "\n" + "q " * 900]
    got = quality.statistics(pa.array(texts, pa.string()))
    expected = np.array([plain_statistics(t) for t in texts])
    assert got.shape == (len(texts), len(quality.NAMES)) and np.abs(got - expected).max() < 1e-9


def plain_tree(x, g, h, cuts, rows, level):
    """A node by trying every feature and cut: (feature, cut, left, right), or the leaf's value."""
    if level == quality.DEPTH:
        return -quality.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.SMOOTH)
    best, total_g, total_h = (1e-6, None, None), sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f, own in enumerate(cuts):
        for cut in own:
            left = [i for i in rows if x[i][f] <= cut]
            if min(len(left), len(rows) - len(left)) < quality.LEAST_ROWS:
                continue
            a, b = sum(g[i] for i in left), sum(h[i] for i in left)
            gain = a * a / (b + quality.SMOOTH) + (total_g - a) ** 2 / (total_h - b + quality.SMOOTH) - total_g**2 / (total_h + quality.SMOOTH)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return plain_tree(x, g, h, cuts, rows, quality.DEPTH)
    sides = [i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]
    return (f, cut, *(plain_tree(x, g, h, cuts, side, level + 1) for side in sides))


def test_trees_by_trying_every_split():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)).round(3)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2) | (rng.random(400) < 0.1)).astype(float)
    trees = quality.grow(x, y, trees=4)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]
    share = y.mean()
    raw = [math.log(share / (1 - share))] * len(y)

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def flat(t, row):
        """A recursive walk down the flat arrays."""

        def down(node):
            if node >= trees.feature.shape[1]:
                return trees.value[t, node - trees.feature.shape[1]]
            return down(2 * node + (2 if row[trees.feature[t, node]] > trees.cut[t, node] else 1))

        return down(0)

    for t in range(4):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        tree = plain_tree(x, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], cuts, list(range(len(y))), 0)
        step = [walk(tree, row) for row in x]
        assert [flat(t, row) for row in x] == pytest.approx(step, abs=1e-9)
        raw = [a + b for a, b in zip(raw, step)]
    new = rng.normal(size=(300, 3))
    expected = [1 / (1 + math.exp(-(trees.base + sum(flat(t, row) for t in range(4))))) for row in new]
    assert trees.score(new) == pytest.approx(expected, abs=1e-12)


def test_accepted_keeps_all_columns(documents, spark):
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = documents.withColumns({"Score": F.lit(7), "score_": F.lit(8)})
    out = quality.accepted(docs, labels)
    assert out.columns == ["doc_id", "text", "Score", "score_"] and {r["Score"] for r in out.collect()} == {7}


def test_which_row_of_an_id_stays(spark):
    a = " ".join("abcdefghij")
    rows = [(1, a, 3), (1, a, 2), (1, a.upper(), 1), (1, "another text for the same id here", 9), (2, a, 0)]
    out = [jaccard.representatives(spark.createDataFrame(x, "doc_id long, text string, extra int").repartition(n)) for x, n in ((rows, 1), (rows[::-1], 4))]
    kept = [sorted(map(tuple, o.collect())) for o in out]
    assert kept[0] == kept[1] == [(1, a.upper(), 1), (1, "another text for the same id here", 9)]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((found.score >= 0.3) == found.predicted).all()
    assert (found.predicted == found.quality).mean() > 0.97
    assert found[found.quality == 1].predicted.mean() > 0.99


def test_quality_does_not_depend_on_partitions(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    runs = [sorted(map(tuple, quality.scored(d, quality.train(d, labels)).select("doc_id", "score").collect())) for d in (documents.repartition(1), documents.repartition(7))]
    assert runs[0] == runs[1]


def test_quality_defined_cases(odd, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, None), (99, 1)], "doc_id long, quality int")
    for given_ in (labels, labels.limit(0)):
        trees = quality.train(odd, given_)
        out = quality.scored(odd, trees).collect()
        assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.scored(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.scored(odd.limit(0), trees).collect() == []


def test_statistics_of_one_text_do_not_depend_on_the_batch(documents):
    texts = [t for _, t in rows_of(documents)][:50]
    whole = quality.statistics(pa.array(texts))
    assert all(np.allclose(whole[i], quality.statistics(pa.array([t]))[0]) for i, t in enumerate(texts))


def test_windows_whose_hashes_collide(documents, monkeypatch):
    """With few hash bits, the check bits tell windows apart."""
    rolling = T.rolling

    def narrow(units, length):
        out = rolling(units, length)
        return out & np.uint64(0xFFF) << np.uint64(52) if not narrow.second else out

    def windows(column, length, plain=substring._windows):
        narrow.second = False
        found = list(plain(column, length))
        found[6] = rolling(T.mix(T.hashes(found[0], found[2], found[3]) ^ substring.CHECK_SEED), length)[found[8]]
        return tuple(found)

    texts = pa.table({"id": [1, 2, 3], "text": [t for _, t in rows_of(documents)[:3]]})
    both = pa.concat_tables([texts, pa.table({"id": [7, 8, 9], "text": texts["text"]})])
    monkeypatch.setattr(T, "rolling", narrow)
    monkeypatch.setattr(substring, "_windows", windows)
    sent = substring._sender(13, 1)((pa.scalar(0),), texts)
    later = substring._sender(13, 1)((pa.scalar(1),), both)
    told = substring._answer((pa.scalar(0),), pa.concat_tables([later, sent]))
    out = substring._remover(13, pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]), False, X.Hops(1, 1))((pa.scalar(1),), both, told)
    whole = brute.without_repeats([(0, " \n ".join(texts["text"].to_pylist())), *zip([1, 2, 3, 7, 8, 9], both["text"].to_pylist())])
    assert out["n_removed"].to_pylist() == [whole[d][1] for d in (1, 2, 3, 7, 8, 9)]


# --- blobs between groups and buckets


def test_two_hops_bring_the_same_answers(documents, odd, monkeypatch):
    rows = rows_of(documents)
    scores = {r["id"]: r["score"] for r in lm.scored(documents, groups=3).collect()}
    monkeypatch.setattr(X, "DIRECT", 2)
    assert removed(documents, groups=10) == expected(rows)
    assert found_components(documents, groups=10) == brute.components(rows, 4, 85)
    found = {r["id"]: r["score"] for r in lm.scored(documents, groups=10).collect()}
    assert found.keys() == scores.keys() and all(found[d] == pytest.approx(s, rel=1e-9) for d, s in scores.items())
    assert removed(odd, groups=5) == expected([(d, t) for d, t in rows_of(odd) if d is not None])


def test_hops_bound_the_rows_of_a_group():
    def rows(groups):
        hops = X.Hops(groups, groups)
        h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2))
        out = hops.sent(lambda key, table: pa.Table.from_batches([X.to_buckets(5, h, None, groups)]))(None, None)
        return out.num_rows

    assert rows(1024) == 1024  # straight to every bucket
    assert (rows(4096), rows(16 * 4096)) == (64, 256)  # by hops: the root of the number of groups


def test_ranges_of_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    long = "x" * 400_000
    rows = [(i * 3, long if i == 500 else "ab" * 50) for i in range(1000)] + [(None, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")

    def groups(n):
        out = X.by_range(df, n, "id").select("g", "id", F.length("text").alias("n")).collect()
        keyed = sorted((r["id"], r["g"]) for r in out if r["id"] is not None)
        assert [g for _, g in keyed] == sorted(g for _, g in keyed)  # groups rise with the key
        lone = {r["g"] for r in out if r["id"] is None}
        return len({g for _, g in keyed}), len(lone), max(sum(g == k for _, g in keyed) for k in {g for _, g in keyed})

    seen, lone, most = groups(10)
    assert seen > 5 and lone == 10 and most < 600  # nulls are dealt out
    monkeypatch.setattr(X, "BOUNDS", 4)
    seen, lone, most = groups(20)
    assert seen > 10 and lone == 20


def test_long_texts_are_encoded_in_parts(monkeypatch, spark):
    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    v, library = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    texts = ["word " * 400, "a  b\n\n c\tünï   x y's don't 12 3<|endoftext|> q " * 40, "x" * 3000, None, "short", "no cut" * 300]
    ids, off = bpe.encode(v, pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert len(bpe.cuts(np.frombuffer(texts[0].encode(), np.uint8), 500)) == 4


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"content": "<x>", "id": 9, "lstrip": True}]}])
def test_other_vocabularies_are_refused(change):
    import json

    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    for key, value in change.items():
        spec[key] = spec[key] | value if key == "model" else value
    with pytest.raises(ValueError, match="this vocabulary needs"):
        bpe._supported(spec)
