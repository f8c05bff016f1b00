"""URL filters, archives, neighbours, images and the pipeline."""

import hashlib
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from labelgrid.llm import ann, bpe, jpeg, oracles, queries, quality, shared, urls, warc

# --- urls


def verdicts(spark, rows, rules=urls.RULES):
    pages = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, host int, verdict string")
    out = urls.judged(pages, urls.rule_table(spark, rules))
    return {r["page"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_rules_and_defined_cases(spark):
    got = verdicts(spark, [
        (1, "http://good.org/fr/a", None), (2, "http://bad.net/x", ""), (3, "HTTP://A.B.net/en?q", ""), (4, "x://example.net/en/q#f", ""), (5, "x://sub.Example.com/de/", ""),
        (6, None, None), (7, "no url", ""), (8, "x://good.com/z?://bad.net/", ""), (9, "x://net", ""), (10, "http://xnet/", ""), (11, "http://a.example.net/EN/", ""), (12, "a\nb://c.net/d\ne?f", ""),
    ])
    assert got == {
        1: ("good.org", "/fr/a", "org/fr/", "allow"), 2: ("bad.net", "/x", "net/", "block"), 3: ("a.b.net", "/en", "net/", "block"), 4: ("example.net", "/en/q", "example.net/en/", "allow"),
        5: ("sub.example.com", "/de/", "example.com/de/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("good.com", "/z", None, "allow"), 9: ("net", "", None, "allow"),
        10: ("xnet", "/", None, "allow"), 11: ("a.example.net", "/EN/", "net/", "block"), 12: ("c.net", "/d\ne", "net/", "block"),
    }


def test_distrust_and_trust_spread(spark):
    link = lambda *to: "".join(f"<a href='{t}'>" for t in to)
    got = verdicts(spark, [
        (1, "http://good.org/fr/", link("//friend.com/", "http://linker.com/")), (2, "http://bad.net/", ""), (3, "http://linker.com/", link("http://bad.net/a", "/own")),
        (4, "http://spam.com/", link("https://BAD.net/", "http://linker.com/")), (5, "http://friend.com/", ""), (6, "http://bad.net/x", link("http://victim.com/")), (7, "http://victim.com/", ""),
    ])
    assert {k: v[3] for k, v in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}


def test_propagation_equals_power_iteration(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, 9, 25), rng.integers(0, 9, 25), rng.integers(1, 4, 25)) if a != b}
    e = spark.createDataFrame([("trust", f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "side string, src string, dst string, w double")
    s = spark.createDataFrame([("trust", "h0", 0.5), ("trust", "h1", 0.5)], "side string, host string, share double")
    m = np.zeros((9, 9))
    for (a, b), w in edges.items():
        m[b, a] = w
    seed = np.zeros(9)
    seed[:2] = 0.5
    out = m.sum(axis=0)
    now = seed.copy()
    for _ in range(urls.ITERATIONS):
        moved = m @ np.where(out > 0, now / np.maximum(out, 1e-9), 0)
        now = 0.85 * moved + seed * (1 - 0.85 * moved.sum())
    got = {r["host"]: r["score"] for r in urls.propagated(e, s).collect()}
    assert all(got.get(f"h{i}", 0) == pytest.approx(now[i]) for i in range(9))


def test_propagation_goes_on_until_scores_are_settled(spark):
    # a chain of 14 hosts from the seed, with a way back to its middle
    edges = [(i, i + 1, 2.0) for i in range(13)] + [(13, 5, 1.0), (7, 2, 1.0)]
    e = spark.createDataFrame([("trust", f"h{a}", f"h{b}", w) for a, b, w in edges], "side string, src string, dst string, w double")
    m = np.zeros((14, 14))
    for a, b, w in edges:
        m[b, a] = w
    m /= m.sum(axis=0)
    seed = np.eye(14)[0]
    settled = np.linalg.solve(np.eye(14) - 0.85 * m, seed * 0.15)  # every host has links, so that nothing goes back
    got = {r["host"]: r["score"] for r in urls.propagated(e, spark.createDataFrame([("trust", "h0", 1.0)], "side string, host string, share double"), iterations=None).collect()}
    assert len(got) == 14 and all(got[f"h{i}"] == pytest.approx(settled[i], rel=1e-4) for i in range(14))


def test_distrust_reaches_the_end_of_a_chain(spark):
    link = lambda to: f"<a href='http://{to}/'>"
    got = verdicts(spark, [(0, "http://bad.net/", ""), (1, "http://l1.com/", link("bad.net")), *((i, f"http://l{i}.com/", link(f"l{i - 1}.com")) for i in range(2, 14)), (14, "http://other.com/", "")])
    assert {k: v[3] for k, v in got.items()} == {**dict.fromkeys(range(14), "block"), 14: "allow"}


def test_a_graph_of_many_hosts_equals_sql(spark, tmp_path):
    """4000 pages of 600 hosts with links between them: settled scores against the SQL with 60 steps."""
    rng = np.random.default_rng(11)
    names = [f"h{i}.{'net' if i % 9 == 0 else 'org' if i % 7 == 0 else 'com'}" for i in range(600)]
    rows = []
    for page in range(4000):
        host = int(rng.integers(600) if page % 3 else rng.integers(3))  # three hosts have a third of all pages
        to = [names[(host + 1 + int(d)) % 600] for d in rng.geometric(0.05, rng.integers(0, 4))]
        html = " ".join(f'<a href="http://{t}/p{page}">' for t in to)
        rows.append((page, f"http://{names[host]}/{'fr' if page % 2 else 'en'}/{page}", html))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(oracles._url_filter(60))
    got = urls.op2(spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))
    by_graph = [r for r in got if r["rule"] is None]
    assert {r["verdict"] for r in by_graph} == {"allow", "block"} and len(by_graph) > 1000


def test_no_python_in_the_plan(spark, sf):
    plan = urls.op2(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(0)
    assert urls.judged(pages, urls.rule_table(spark)).collect() == []


# --- archives


def test_revisits_equal_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel = con.sql(queries.oracle_sql()["op6_warc"])
    got = warc.op6(spark, sf).select(*rel.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_archives_defined_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 900)
    texts = ["a" * 1500, "a" * 1500, None, "", "b" * 999, "b" * 999, "é" * 600, "é" * 600, "é" * 600, "a" * 1500]
    ids = [0, 1, 2, 3, 4, 5, 6, None, 8, 0]
    pages = spark.createDataFrame([(i, "http://x/ y\r\nz" if i else None, t, "clash") for i, t in zip(ids, texts)], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}"
    files = warc.deduplicate(warc.write(pages, f"{folder}/raw"), f"{folder}/dedup")
    read = warc.read(files, folder, payloads=True).cache()
    assert read.count() == 10 and files.count() > 1
    assert {r["uri"] for r in read.collect()} == {"", "http://x/%20y%0D%0Az"}
    assert sorted((r["payload"] or b"").decode() for r in read.where("type = 'response'").collect()) == sorted(["a" * 1500, "", "", "b" * 999, "b" * 999, "é" * 600])
    got = sorted((r["id"] if r["id"] is not None else -1, r["type"], r["payload_bytes"], r["refers_to"]) for r in warc.joined(read).collect())
    assert got == [(-1, "revisit", 1200, 8), (0, "revisit", 1500, 1), (0, "revisit", 1500, 1), (1, "response", 1500, None), (2, "response", 0, None), (3, "response", 0, None), (4, "response", 999, None), (5, "response", 999, None), (6, "revisit", 1200, 8), (8, "response", 1200, None)]
    assert all(r["digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in read.where("type = 'response'").collect())


def test_cut_archive_is_an_error(tmp_path):
    import io

    raw = warc.response(1, "u", b"x" * 5000, hashlib.sha1(b"x" * 5000).hexdigest())
    assert [f["warc-type"] for f, _ in warc.records(io.BytesIO(raw + raw))] == ["response"] * 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[:-9])))


def test_no_pages(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(0)
    files = warc.deduplicate(warc.write(pages, f"file://{tmp_path}/raw"), f"file://{tmp_path}/dedup")
    assert warc.joined(warc.read(files, f"file://{tmp_path}")).collect() == []


# --- neighbours


def exact(ids, v, q, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u[q]
    s[ids == ids[q]] = -9
    return ids[np.lexsort((ids, -s))[:k]]


@pytest.mark.parametrize("shard_rows", [4096, 100])
def test_recall_and_scores(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = table.toPandas()
    ids, v = pdf.vec_id.values, np.stack(pdf.embedding.values).astype(float)
    out = ann.nearest(table, shard_rows=shard_rows).toPandas()
    hits = total = 0
    for q, rows in out.groupby("query_id"):
        at = np.flatnonzero(ids == q)[0]
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == [1, 2, 3, 4, 5] and q not in rows.vec_id.values
        for x, s in zip(rows.vec_id, rows.score):
            b = v[np.flatnonzero(ids == x)[0]]
            assert s == pytest.approx(v[at] @ b / np.linalg.norm(v[at]) / np.linalg.norm(b), abs=1e-12)
        hits += len(set(rows.vec_id) & set(exact(ids, v, at, 5)))
        total += 5
    assert total == 5 * len(ids[ids % 50 == 0]) and hits / total >= 0.97


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(5)
    v, ids = rng.normal(size=(4000, 48)), np.arange(4000)
    g = ann.Graph.load(ann.Graph(v, ids).stored())
    row, near, _ = g.nearest(v[::50], ids[::50], 5)
    assert np.mean([len(set(near[row == i]) & set(exact(ids, v, 50 * i, 5))) / 5 for i in range(80)]) >= 0.9


def test_the_largest_shard(monkeypatch):
    n, marked, walk = ann.MOST_ROWS, [], ann.Graph._beam
    monkeypatch.setattr(ann.Graph, "_beam", lambda g, q, *a: marked.append(len(q) * len(g.unit)) or walk(g, q, *a))
    assert ann.shard_size(10**12) == n
    v, ids = np.random.default_rng(5).normal(size=(n, 48)), np.arange(n)
    g = ann.Graph(v, ids)
    assert max(marked) <= ann.SEEN
    q = ids[:: n // 128]
    row, near, _ = g.nearest(v[q], q, 5)
    assert np.mean([len(set(near[row == i]) & set(exact(ids, v, x, 5))) / 5 for i, x in enumerate(q)]) >= 0.9


def test_neighbours_defined_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, nan]), (5, [0.0, 1.0]), (100, [-1e300, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, shard int, score double")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 1.0), (6, 1.0), (50, 1.0), (5, 0.0), (100, -1.0)], 50: [(0, 1.0), (1, 1.0), (6, 1.0), (5, 0.0), (100, -1.0)], 100: [(5, 0.0), (0, -1.0), (1, -1.0), (6, -1.0), (50, -1.0)]}
    assert ann.nearest(df.limit(0)).collect() == []
    far = 1 << 60  # ids beyond what doubles tell apart
    large = spark.createDataFrame([(far + i, [1.0, float(i)]) for i in range(51)], "vec_id long, embedding array<double>")
    out = [(r["query_id"], r["vec_id"]) for r in ann.nearest(large, every=far + 50).where("rank = 1").collect()]
    assert out == [(far + 50, far + 49)]
    many = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)] + [(1000, [1.0, 0.9])], "vec_id long, embedding array<double>")
    first = [r["vec_id"] for r in ann.nearest(many).where("query_id = 0").orderBy("rank").collect()]
    assert first == [1, 2, 3, 4, 5]


# --- images


def reader(bits):
    at = [0]

    def take(n):
        at[0] += n
        return int(bits[at[0] - n : at[0]] or "0", 2)

    return take


class Grey:
    """A plain one-component progressive encoder with runs of ended blocks and long zero runs, as other programs write them."""

    def __init__(self, coef):
        self.coef, self.bits = coef, ""
        self.code, self.length, _ = jpeg.codes(jpeg.AC_SPEC)
        self.dc, self.dc_length, _ = jpeg.codes(jpeg.DC_SPEC)
        # end-of-block runs of up to 2**14 blocks
        lengths = {5: [0x00, 0xF0, *range(0x01, 0x09), *range(0x11, 0x17)], 9: sorted({r << 4 | s for r in range(16) for s in range(11)} - {0x00, 0xF0, *range(0x01, 0x09), *range(0x11, 0x17)})}
        self.spec = jpeg._spec(lengths)
        self.code, self.length, _ = jpeg.codes(self.spec)

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def symbol(self, s):
        self.put(int(self.code[s]), int(self.length[s]))

    def end_run(self, run):
        if run:
            n = run.bit_length() - 1
            self.symbol(n << 4)
            self.put(run - (1 << n), n)

    def first_ac(self, lo, hi, low):
        run = 0
        for block in self.coef:
            r = 0
            for k in range(lo, hi + 1):
                m = abs(int(block[k])) >> low
                if not m:
                    r += 1
                    continue
                self.end_run(run)
                run = 0
                while r > 15:
                    self.symbol(0xF0)
                    r -= 16
                size = m.bit_length()
                self.symbol(r << 4 | size)
                self.put(m if block[k] > 0 else m ^ ((1 << size) - 1), size)
                r = 0
            run += r > 0
        self.end_run(run)

    def refine_ac(self, lo, hi, low):
        run, held = 0, ""
        for block in self.coef:
            mags = [abs(int(block[k])) >> low for k in range(lo, hi + 1)]
            last = max([i for i, m in enumerate(mags) if m == 1], default=-1)
            r, own = 0, ""
            for i, m in enumerate(mags):
                if m == 0:
                    r += 1
                    continue
                while r > 15 and i <= last:
                    self.end_run(run)
                    self.bits += held
                    run, held = 0, ""
                    self.symbol(0xF0)
                    self.bits += own
                    own = ""
                    r -= 16
                if m > 1:
                    own += str(m & 1)
                    continue
                self.end_run(run)
                self.bits += held
                run, held = 0, ""
                self.symbol(r << 4 | 1)
                self.put(int(block[lo + i] > 0), 1)
                self.bits += own
                own, r = "", 0
            if r > 0 or own:
                run += 1
                held += own
        self.end_run(run)
        self.bits += held

    def dc_first(self, low):
        before = 0
        for block in self.coef:
            v = int(block[0]) >> low
            d, before = v - before, v
            size = abs(d).bit_length()
            self.put(int(self.dc[size]), int(self.dc_length[size]))
            self.put(d if d > 0 else (abs(d) ^ ((1 << size) - 1) if size else 0), size)

    def dc_refine(self, low):
        for block in self.coef:
            self.put(int(block[0]) >> low & 1, 1)

    def flush(self):
        bits, self.bits = self.bits + "1" * (-len(self.bits) % 8), ""
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def stream(self, width, height, quant):
        s = jpeg._segment
        out = [b"\xff\xd8", s(0xDB, b"\0" + bytes(quant)), s(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\1\x07\x11\0"), s(0xC4, b"\0" + b"".join(jpeg.DC_SPEC)), s(0xC4, b"\x10" + b"".join(self.spec))]
        for write, lo, hi, before, low in ((self.dc_first, 0, 0, 0, 1), (self.first_ac, 1, 5, 0, 2), (self.first_ac, 6, 63, 0, 2), (self.refine_ac, 1, 63, 2, 1), (self.dc_refine, 0, 0, 1, 0), (self.refine_ac, 1, 63, 1, 0)):
            write(*(() if lo == 0 else (lo, hi)), low)
            out += [s(0xDA, b"\1\x07\0" + bytes([lo, hi, before << 4 | low])), self.flush()]
        return b"".join(out) + b"\xff\xd9"


def test_streams_of_another_encoder():
    rng = np.random.default_rng(9)
    streams, all_ = [], []
    for width, height, share in ((41, 20, 0.05), (8, 8, 0.9), (100, 64, 0.004), (16, 24, 0.3)):
        blocks = -(-width // 8) * -(-height // 8)
        coef = np.where(rng.random((blocks, 64)) < share, rng.integers(-40, 41, (blocks, 64)), 0)
        coef[:, 0] = rng.integers(-200, 200, blocks)
        all_.append(coef)
        streams.append(Grey(coef).stream(width, height, [3] * 64))
    images, base, found = jpeg.coefficients(streams)
    for coef, b in zip(all_, base):
        assert (found[b : b + len(coef)] == coef).all()
    tensor = jpeg.tensors(streams)[0]
    assert tensor.shape == (20, 41, 3)
    # the first block by the definition of the transform
    c = np.zeros(64)
    c[jpeg.ZIGZAG] = all_[0][0] * 3.0
    c = c.reshape(8, 8)
    a = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    assert np.abs(np.clip(a @ c @ a.T + 128, 0, 255) - tensor[:8, :8, 0]).max() <= 1


def test_payloads_round_trip():
    rng = np.random.default_rng(2)
    some = [rng.choice([0, 1, 126, 127, 128, 129, 130, 255], 64 * n).astype(np.uint8).tobytes() for n in (1, 2, 6, 7, 97, 400)]
    some += [bytes(64), bytes([128]) * 640, bytes(rng.integers(0, 256, 64 * 700, dtype=np.uint8))]
    streams = jpeg.stored(some)
    assert jpeg.payloads(*jpeg.coefficients(streams)) == some
    assert jpeg.stored(some[3:4]) == streams[3:4]  # neighbours make no difference
    whole, alone = jpeg.tensors(streams), jpeg.tensors(streams[4:5])
    assert (whole[4] == alone[0]).all()


def test_damaged_streams():
    (good,) = jpeg.stored([bytes(range(64)) * 4])
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc2", b"\xff\xc0"), *(good[:n] for n in range(0, len(good) - 1, 3))):
        with pytest.raises(ValueError):
            jpeg.coefficients([bad])


def test_image_columns(odd):
    out = jpeg.read(jpeg.media(odd), pixels=True).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    assert sorted((r["id"] or -1, r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in out) == sorted((d or -1, hashlib.sha256(jpeg.padded(t)).hexdigest(), len(t), zlib.crc32(jpeg.padded(t)[-64:])) for d, t in texts)
    assert all([len(t) for t in r["rgb"]] == [h * w * 3 for h, w in r["shapes"]] for r in out)
    assert jpeg.read(jpeg.media(odd.limit(0))).collect() == []


def test_tensors_rest_in_a_table(odd, tmp_path):
    table = jpeg.tensors_written(jpeg.media(odd), f"{tmp_path}/tensors")
    expected = {(r["doc_id"], r["text"]): jpeg.tensors(jpeg.stored([jpeg.padded((r["text"] or "").encode())]))[0] for r in odd.collect()}
    by = {hashlib.sha256(jpeg.padded((t or "").encode())).hexdigest(): x for (_, t), x in expected.items()}
    for r in table.collect():
        (shape,), (raw,) = r["shapes"], r["rgb"]
        assert (np.frombuffer(raw, np.uint8).reshape(*shape, 3) == by[r["payload_sha256"]]).all()


def test_colour_with_halved_chroma_by_definition():
    """A 4:2:0 stream of our own: each pixel from the transform's definition, its unit's chroma, and the colour formula."""
    payload = np.random.default_rng(5).integers(96, 160, 64 * 6 * 5, dtype=np.uint8).tobytes()
    (stream,) = jpeg.stored([payload])
    (m,), base, coef = jpeg.coefficients([stream])
    (tensor,) = jpeg.tensors([stream])
    assert tensor.shape == (m.height, m.width, 3) and m.width % 16 == 0
    basis = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    planes = []
    for c in m.parts:
        plane = np.zeros((c.rows * 8, c.stride * 8))
        for row in range(c.rows):
            for col in range(c.stride):
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = coef[c.base + row * c.stride + col]
                sample = basis @ block.reshape(8, 8) @ basis.T + 128
                plane[row * 8 : row * 8 + 8, col * 8 : col * 8 + 8] = np.clip(np.floor(sample + 0.5), 0, 255)
        planes.append(plane)
    worst = 0
    for y in range(m.height):
        for x in range(0, m.width, 3):
            luma, cb, cr = planes[0][y, x], planes[1][y // 2, x // 2] - 128, planes[2][y // 2, x // 2] - 128
            pixel = [luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb]
            worst = max(worst, max(abs(min(max(p, 0), 255) - int(t)) for p, t in zip(pixel, tensor[y, x])))
    assert worst <= 2.3  # a sample at a rounding edge may differ by one


def test_long_payloads_are_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "PAYLOAD", 640)
    monkeypatch.setattr(jpeg, "DECODED", 3000)
    payload = np.random.default_rng(1).integers(0, 256, 64 * 101, dtype=np.uint8).tobytes()
    cell = jpeg.whole(payload)
    images = jpeg.single(cell)
    assert len(images) == 11 and b"".join(images) == cell
    assert b"".join(jpeg.payloads(*jpeg.coefficients(images))) == payload


def test_a_long_text_in_bounded_memory(spark):
    """24 MB of text: coding and decoding hold a few images at a time."""
    import resource

    words = " ".join(f"word{i % 9973}" for i in range(2_600_000))
    df = spark.createDataFrame([(1, words), (2, "short")], "doc_id long, text string").coalesce(1)

    def peak(batches):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        rows = list(stage(batches))
        yield pa.RecordBatch.from_pydict({"mb": [(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10], "n": [sum(r.num_rows for r in rows)]})

    out = {r["id"]: r for r in jpeg.read(jpeg.media(df)).collect()}
    raw = words.encode()
    assert out[1]["payload_sha256"] == hashlib.sha256(jpeg.padded(raw)).hexdigest() and out[1]["feature"].count(";") == -(-len(jpeg.padded(raw)) // jpeg.PAYLOAD) - 1
    stage = jpeg_stage(raw)
    (found,) = df.select("doc_id").limit(1).mapInArrow(peak, "mb long, n long").collect()
    assert found["mb"] < 900


def jpeg_stage(raw):
    """Both directions for one text, in one function over batches."""

    def run(batches):
        list(batches)
        cell = jpeg.whole(jpeg.padded(raw))
        for piece in jpeg.single(cell):
            images, base, coef = jpeg.coefficients([piece])
            jpeg.samples(images, base, coef)
            yield pa.RecordBatch.from_pydict({"n": [len(jpeg.payloads(images, base, coef)[0])]})

    return run


# --- the pipeline


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, sf), name)
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows = out.collect()
        if name == "quality":
            trees = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            kept = {r["doc_id"] for r in quality.scored(docs, trees).where("score >= 0.3").collect()}
            assert {r["doc_id"] for r in rows} == kept and 0 < len(rows) < len(before)
        elif name == "near_copies":
            least = brute.components(before, 5, 80)
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, c in least.values()}) and len(rows) < len(before)
        elif name == "substring":
            expected = brute.without_repeats(before)
            old = dict(before)
            for r in rows:
                _, gone, words = expected[r["doc_id"]]
                assert r["text"] == (" ".join(words) if gone else old[r["doc_id"]])
                assert not gone or r["n_chars"] == len(r["text"])
            assert len(rows) == len(before) and any(g for _, g, _ in expected.values())
        else:
            from test_texts import check_pieces

            check_pieces(before, rows, Tokenizer.from_file(bpe.default_path()))
        assert out.columns == columns or name == "packing"
        docs = out


def test_pipeline_of_odd_rows(odd, spark, tmp_path):
    spark.createDataFrame([(0, 1), (5, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, odd.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = shared.written(stage(spark, docs, str(tmp_path)), "odd")
        assert (docs.count() > 0) == (start is odd)
