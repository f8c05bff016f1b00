"""Queries over images and dense volumes: stencils, components, resampling, intensities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relabel, resample, stencil
from ..sources import volumes as src
from . import encodings as E
from .registry import query

G = f"WITH v AS ({E.GRID})"
I = f"WITH v AS ({E.IMAGE})"  # noqa: E741
CROSS = "o AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dz, dy, dx))"
HIGH = "(SELECT max(z) FROM v)"
INSIDE = f"z BETWEEN 0 AND {HIGH} AND y BETWEEN 0 AND 19 AND x BETWEEN 0 AND 63"


def _shape(spark, d):
    return {"z": E.depth(spark, d), "y": 20, "x": 64}


def _fg(spark, d):
    return E.grid(spark, d).where("label > 0").select("z", "y", "x")


@query("im2col", I + ", m AS (SELECT max(y) AS h FROM v) SELECT CAST(y0 // 2 * 31 + x0 // 2 AS BIGINT) AS block, CAST(a * 3 + b AS INTEGER) AS place, value FROM (SELECT v.y - a AS y0, v.x - b AS x0, a, b, value FROM v, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([0, 1, 2]) AS b)), m WHERE y0 BETWEEN 0 AND h - 2 AND x0 BETWEEN 0 AND 61 AND y0 % 2 = 0 AND x0 % 2 = 0")
def _(spark, d):
    rows = E.image(spark, d).agg(F.max("y")).first()[0] + 1
    return stencil.im2col(E.image(spark, d), (3, 3), (rows, 64), step=2)


@query("erode", G + f", {CROSS} SELECT CAST(z + dz AS INTEGER) AS z, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM v, o WHERE label > 0 GROUP BY 1, 2, 3 HAVING count(*) = 7")
def _(spark, d):
    return stencil.erode(_fg(spark, d))


@query("dilate", G + f", {CROSS}, p AS (SELECT DISTINCT CAST(z + dz AS INTEGER) AS z, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM v, o WHERE label > 0) SELECT * FROM p WHERE {INSIDE}")
def _(spark, d):
    return stencil.dilate(_fg(spark, d), _shape(spark, d))


MERGED = """, f AS (SELECT v.z, v.y, v.x, bool_or(p.l = v.label) AS own, min(p.l) AS least FROM v JOIN p ON p.z = v.z AND p.y = v.y AND p.x = v.x GROUP BY 1, 2, 3)
SELECT v.z, v.y, v.x, CAST(CASE WHEN own THEN v.label WHEN v.label = 0 THEN coalesce(least, 0) ELSE 0 END AS BIGINT) AS label FROM v LEFT JOIN f ON f.z = v.z AND f.y = v.y AND f.x = v.x"""
GROW = f"SELECT DISTINCT l, z + dz AS z, y + dy AS y, x + dx AS x FROM {{0}}, o"
SHRINK = "SELECT l, z + dz AS z, y + dy AS y, x + dx AS x FROM {0}, o GROUP BY 1, 2, 3, 4 HAVING count(*) = 7"


@query("opening", G + f", {CROSS}, a AS (SELECT label AS l, z, y, x FROM v WHERE label > 0), b AS ({SHRINK.format('a')}), c AS ({GROW.format('b')}), p AS (SELECT * FROM c WHERE {INSIDE})" + MERGED)
def _(spark, d):
    return stencil.opening(E.grid(spark, d).drop("value"), _shape(spark, d), 1)


@query("closing", G + f", {CROSS}, a AS (SELECT label AS l, z, y, x FROM v WHERE label > 0), b AS ({GROW.format('a')}), c AS (SELECT * FROM b WHERE {INSIDE}), p AS ({SHRINK.format('c')})" + MERGED)
def _(spark, d):
    return stencil.closing(E.grid(spark, d).drop("value"), _shape(spark, d), 1)


@query("widen_border", G + ", w AS (SELECT v.z, v.y, v.x, max(n.label) AS t, min(nullif(n.label, 0)) AS l FROM v JOIN v n ON n.z = v.z AND n.y BETWEEN v.y - 1 AND v.y + 1 AND n.x BETWEEN v.x - 1 AND v.x + 1 GROUP BY 1, 2, 3) SELECT v.z, v.y, v.x, CAST(CASE WHEN t = l THEN label ELSE 0 END AS BIGINT) AS label FROM v JOIN w USING (z, y, x)")
def _(spark, d):
    return stencil.widen_border(E.grid(spark, d).drop("value"))


@query("sphericity", G + f", {CROSS}, e AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x FROM v, o WHERE label > 0 GROUP BY 1, 2, 3 HAVING count(*) = 7), s AS (SELECT label, count(*) AS c FROM v GROUP BY 1), k AS (SELECT label, count(*) AS c FROM v JOIN e USING (z, y, x) GROUP BY 1) SELECT s.label, CASE WHEN s.label > 0 AND s.c - coalesce(k.c, 0) > 0 THEN round(pow(pi(), 1.0 / 3) * pow(6.0 * s.c, 2.0 / 3) / (s.c - coalesce(k.c, 0)), 9) ELSE -1.0 END AS sphericity FROM s LEFT JOIN k ON k.label = s.label")
def _(spark, d):
    return stencil.sphericity(E.grid(spark, d)).withColumn("sphericity", F.round("sphericity", 9))


# connected components by reachability: each voxel with all that it reaches
REACH = G.replace("WITH v", "WITH RECURSIVE v") + """, f AS (SELECT z * 1280 + y * 64 + x AS k, z, y, x, label FROM v WHERE label > 0),
e AS (SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON b.label = a.label AND {0}), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT k AS id, k AS o FROM f UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.o),
c AS (SELECT id, min(o) AS m FROM r GROUP BY id), p AS (SELECT z, y, x, label, m, {1} AS component FROM f JOIN c ON c.id = f.k) """
NEXT = "(b.z = a.z AND b.y = a.y AND b.x = a.x + 1 OR b.z = a.z AND b.y = a.y + 1 AND b.x = a.x{0})"
VOLUME = REACH.format(NEXT.format(" OR b.z = a.z + 1 AND b.y = a.y AND b.x = a.x"), "dense_rank() OVER (ORDER BY m)")


@query("fill_holes", G.replace("WITH v", "WITH RECURSIVE v") + f""", {CROSS},
b AS (SELECT label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v WHERE label > 0 GROUP BY 1),
h AS (SELECT b.label AS l, v.z, v.y, v.x, v.z IN (z0, z1) OR v.y IN (y0, y1) OR v.x IN (x0, x1) AS rim FROM b JOIN v ON v.z BETWEEN z0 AND z1 AND v.y BETWEEN y0 AND y1 AND v.x BETWEEN x0 AND x1 WHERE v.label <> b.label),
u AS (SELECT l, z, y, x FROM h WHERE rim UNION SELECT h.l, h.z, h.y, h.x FROM u, o, h WHERE h.l = u.l AND h.z = u.z + dz AND h.y = u.y + dy AND h.x = u.x + dx),
p AS (SELECT label AS l, z, y, x FROM v WHERE label > 0 UNION ALL SELECT l, z, y, x FROM (SELECT l, z, y, x FROM h EXCEPT SELECT l, z, y, x FROM u))""" + MERGED)
def _(spark, d):
    return stencil.fill_holes(E.grid(spark, d).drop("value"))


@query("voxel_components", VOLUME + "SELECT z, y, x, label, component FROM p")
def _(spark, d):
    return stencil.voxel_components(E.grid(spark, d).drop("value"))


@query("slice_components", REACH.format(NEXT.format(""), "dense_rank() OVER (PARTITION BY z ORDER BY m)") + "SELECT z, y, x, label, component FROM p")
def _(spark, d):
    return stencil.slice_components(E.grid(spark, d).drop("value"))


@query("biggest_component", VOLUME + "SELECT z, y, x, component AS label FROM p WHERE component = (SELECT component FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def _(spark, d):
    return stencil.biggest_component(E.grid(spark, d).drop("value"))


@query("remove_small_components", VOLUME + "SELECT z, y, x, CAST(CASE WHEN count(*) OVER (PARTITION BY component) < 30 THEN 0 ELSE component END AS BIGINT) AS label FROM p")
def _(spark, d):
    return stencil.remove_small_components(E.grid(spark, d).drop("value"), 30)


# --- resampling


@query("strided_decimate", G + " SELECT CAST(z // 2 AS INTEGER) AS z, CAST((y - 1) // 3 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, label FROM v WHERE z % 2 = 0 AND y >= 1 AND (y - 1) % 3 = 0 AND x % 4 = 0")
def _(spark, d):
    return resample.decimate(E.grid(spark, d).drop("value"), {"z": 2, "y": 3, "x": 4}, {"y": 1})


@query("chunk_read", G + " SELECT CAST((z - 4) // 2 AS INTEGER) AS z, y, x, label FROM v WHERE z >= 4 AND z < 8 AND (z - 4) % 2 = 0")
def _(spark, d):
    return resample.chunk(E.grid(spark, d).drop("value"), 1, 4, {"z": 2})


@query("slice_crop", G + " SELECT CAST((z - 3) // 2 AS INTEGER) AS z, CAST(y - 2 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, label FROM v WHERE z >= 3 AND z < 20 AND (z - 3) % 2 = 0 AND y >= 2 AND y < 15 AND x >= 10 AND x < 40")
def _(spark, d):
    return resample.slices(E.grid(spark, d).drop("value"), (3, 20), (2, 15), (10, 40), zstep=2)


@query("avg_pool_mip", I + " SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(value), 9) AS value FROM v GROUP BY 1, 2")
def _(spark, d):
    return resample.average_pool(E.image(spark, d), {"y": 2, "x": 2}).withColumn("value", F.round("value", 9))


MODE = "SELECT z, y, x, label FROM (SELECT z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, label, count(*) AS n FROM {0} GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC, label) = 1"


@query("mode_pool_mip", G + " " + MODE.format("v"))
def _(spark, d):
    return resample.mode_pool(E.grid(spark, d).drop("value"), {"y": 2, "x": 2})


@query("mip_pyramid", G + f", a AS ({MODE.format('v')}), b AS ({MODE.format('a')}) SELECT z, y, x, label, CAST(0 AS INTEGER) AS mip FROM v UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b")
def _(spark, d):
    return resample.pyramid(E.grid(spark, d).drop("value"), 3, {"y": 2, "x": 2})


@query("reflect_pad", I + ", m AS (SELECT max(y) + 1 AS h FROM v), yy AS (SELECT CAST(i AS INTEGER) AS o, CASE WHEN i < 3 THEN 3 - i WHEN i >= h + 3 THEN 2 * (h - 1) - (i - 3) ELSE i - 3 END AS s FROM (SELECT unnest(generate_series(0, h + 4)) AS i, h FROM m)), xx AS (SELECT CAST(i AS INTEGER) AS o, CASE WHEN i < 1 THEN 1 WHEN i >= 65 THEN 126 - (i - 1) ELSE i - 1 END AS s FROM (SELECT unnest(generate_series(0, 66)) AS i)) SELECT yy.o AS y, xx.o AS x, value FROM v JOIN yy ON yy.s = v.y JOIN xx ON xx.s = v.x")
def _(spark, d):
    rows = E.image(spark, d).agg(F.max("y")).first()[0] + 1
    return resample.reflect_pad(E.image(spark, d), {"y": (3, 2), "x": (1, 2)}, {"y": rows, "x": 64})


@query("resize_nearest", G + " SELECT z, y, CAST(o AS INTEGER) AS x, label FROM v JOIN (SELECT i AS o, CAST(floor(i * (63 / 31.0::DOUBLE) + 0.5) AS INTEGER) AS s FROM (SELECT unnest(generate_series(0, 31)) AS i)) ON s = x")
def _(spark, d):
    return resample.resize(E.grid(spark, d).drop("value"), {"x": 0.5}, {"x": 64}, "label")


@query("resize_linear", I + ", t AS (SELECT i, i * (63 / 95.0::DOUBLE) AS p FROM (SELECT unnest(generate_series(0, 95)) AS i)), w AS (SELECT i, least(floor(p), 62) AS l, p - least(floor(p), 62) AS f FROM t) SELECT y, CAST(i AS INTEGER) AS x, round(sum(value * CASE WHEN x = l THEN 1 - f ELSE f END), 9) AS value FROM v JOIN w ON x = l OR x = l + 1 GROUP BY 1, 2")
def _(spark, d):
    return resample.resize(E.image(spark, d), {"x": 1.5}, {"x": 64}, "value", order=1).withColumn("value", F.round("value", 9))


@query("tile_stitch", G + " SELECT CAST(y + z // 5 * 20 AS INTEGER) AS y, CAST(x + z % 5 * 64 AS INTEGER) AS x, label FROM v")
def _(spark, d):
    tiles = E.grid(spark, d).select((F.col("z") % 5).alias("column"), F.floor(F.col("z") / 5).alias("row"), "y", "x", "label")
    return resample.stitch(tiles, 20, 64)


@query("clahe", f"""WITH v AS (SELECT z, y, x, CAST(floor(least(greatest(value + 0.5, 0.0::DOUBLE), 1.0::DOUBLE) * 255) AS INTEGER) AS value FROM ({E.GRID})),
h AS (SELECT z, y // 10 AS ty, x // 16 AS tx, value AS b, count(*) AS n FROM v GROUP BY 1, 2, 3, 4),
a AS (SELECT *, sum(n) OVER (PARTITION BY z, ty, tx) AS al FROM h), m AS (SELECT *, greatest(1, floor(2.0::DOUBLE * al / 256)) AS most FROM a),
t AS (SELECT z, ty, tx, b, al, sum(least(n, most)) OVER (PARTITION BY z, ty, tx ORDER BY b) AS c, sum(greatest(n - most, 0)) OVER (PARTITION BY z, ty, tx) / 256.0::DOUBLE AS e FROM m),
g AS (SELECT z, ty, tx, max(al) AS al, max(e) AS e FROM t GROUP BY 1, 2, 3),
w AS (SELECT v.*, (y + 0.5::DOUBLE) / 10 - 0.5::DOUBLE AS fy, (x + 0.5::DOUBLE) / 16 - 0.5::DOUBLE AS fx FROM v),
q AS (SELECT z, y, x, value, CASE WHEN i = 0 THEN greatest(floor(fy), 0) ELSE least(floor(fy) + 1, 1) END AS ty, CASE WHEN j = 0 THEN greatest(floor(fx), 0) ELSE least(floor(fx) + 1, 3) END AS tx,
 CASE WHEN i = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE WHEN j = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS k FROM w, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
l AS (SELECT q.z, q.y, q.x, q.k, ((coalesce((SELECT max(c) FROM t WHERE t.z = q.z AND t.ty = q.ty AND t.tx = q.tx AND t.b <= q.value), 0)) + g.e * (q.value + 1)) * 255 / g.al AS o FROM q JOIN g ON g.z = q.z AND g.ty = q.ty AND g.tx = q.tx)
SELECT z, y, x, CAST(least(greatest(floor(round(sum(k * o), 6) + 0.5), 0), 255) AS INTEGER) AS value FROM l GROUP BY 1, 2, 3""")
def _(spark, d):
    byte = E.grid(spark, d).select("z", "y", "x", F.floor(S.clip(F.col("value") + 0.5, 0.0, 1.0) * 255).cast("int").alias("value"))
    return resample.clahe(byte, {"y": 20, "x": 64}, tiles=(2, 4))


# --- intensities


@query("percentile_clip", I + ", p AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM v) SELECT y, x, round(least(greatest(value, a), b), 9) AS adjusted FROM v, p")
def _(spark, d):
    return S.adjust(E.image(spark, d), "value").select("y", "x", F.round("adjusted", 9).alias("adjusted"))


@query("unit_scale", I + ", p AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.9) AS b FROM v) SELECT y, x, round((least(greatest(value, a), b) - a) / (b - a), 9) AS adjusted FROM v, p")
def _(spark, d):
    return S.adjust(E.image(spark, d), "value", percent=(2, 90), scale="unit").select("y", "x", F.round("adjusted", 9).alias("adjusted"))


@query("uint8_scale", I + " SELECT y, x, CAST(floor((least(greatest(value, -0.2::DOUBLE), 0.25::DOUBLE) - -0.2::DOUBLE) / (0.25::DOUBLE - -0.2::DOUBLE) * 255) AS INTEGER) AS adjusted FROM v")
def _(spark, d):
    return S.adjust(E.image(spark, d), "value", -0.2, 0.25, scale="byte").select("y", "x", "adjusted")


@query("quantize_affinity", I + " SELECT y, x, CAST(floor(least(greatest(CAST(value AS FLOAT), 0::FLOAT), 1::FLOAT) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS byte FROM v")
def _(spark, d):
    return E.image(spark, d).select("y", "x", S.quantize("value").alias("byte"))


@query("trim_bounds", I + " SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM v WHERE value > 0.36")
def _(spark, d):
    return resample.trim(E.image(spark, d), 0.36)[1]


@query("trim_by_intensity", I + ", b AS (SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM v WHERE value > 0.36) SELECT CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, value FROM v, b WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1")
def _(spark, d):
    return resample.trim(E.image(spark, d), 0.36)[0]


def _colors(spark, d):
    """Triples of neighbouring components as colours."""
    byte = lambda i: F.floor(S.clip(F.element_at("embedding", i).cast("double") * 2 + 0.5, 0.0, 1.0) * 255).cast("int")
    return E.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


COLORS = "c AS (SELECT vec_id AS frame, " + ", ".join(f"CAST(floor(least(greatest(CAST(embedding[{i}] AS DOUBLE) * 2 + 0.5, 0), 1) * 255) AS INTEGER) AS {n}" for i, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM embeddings), m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS w FROM c), k AS (SELECT frame, v, w, CASE WHEN w = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60 * ((g - b) / w::DOUBLE) WHEN v = g THEN 120 + 60 * ((b - r) / w::DOUBLE) ELSE 240 + 60 * ((r - g) / w::DOUBLE) END AS h FROM m), q AS (SELECT frame, CAST(floor(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2 + 0.5) % 180 AS INTEGER) AS h, CAST(CASE WHEN v = 0 THEN 0 ELSE floor(255 * (w / v::DOUBLE) + 0.5) END AS INTEGER) AS s, v FROM k)"


@query("hsv", f"WITH {COLORS} SELECT frame, h, s, v FROM q")
def _(spark, d):
    h, s, v = S.hsv("r", "g", "b")
    return _colors(spark, d).select("frame", h.alias("h"), s.alias("s"), v.alias("v"))


@query("hsv_features", f"WITH {COLORS} SELECT frame // 10 AS frame, count(*) FILTER (WHERE h BETWEEN 0 AND 60 AND s BETWEEN 30 AND 255 AND v BETWEEN 50 AND 255 OR h BETWEEN 100 AND 179 AND s BETWEEN 0 AND 120 AND v BETWEEN 0 AND 200) AS n FROM q GROUP BY 1")
def _(spark, d):
    c = S.hsv("r", "g", "b")
    hit = S.in_range(c, [0, 30, 50], [60, 255, 255]) | S.in_range(c, [100, 0, 0], [179, 120, 200])
    return _colors(spark, d).groupBy(F.floor(F.col("frame") / 10).alias("frame")).agg(F.count_if(hit).alias("n"))


@query("mask_multiply", G + " SELECT z, y, x, CAST(label * (x % 2) AS BIGINT) AS label FROM v")
def _(spark, d):
    v = E.grid(spark, d).drop("value")
    return relabel.masked(v, v.select("z", "y", "x", (F.col("x") % 2).alias("mask")), ["z", "y", "x"])


# --- tiled and chunked stacks


@query("tile_volume", G + " SELECT CAST((z - 1) // 2 AS INTEGER) AS z, CAST(y - 3 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, label FROM v WHERE z >= 1 AND z < 9 AND (z - 1) % 2 = 0 AND y >= 3 AND y < 18 AND x >= 10 AND x < 60")
def _(spark, d):
    v = E.grid(spark, d)
    tiles = v.select("z", F.floor(F.col("y") / 8).alias("row"), F.floor(F.col("x") / 24).alias("column"), (F.col("y") % 8).alias("y"), (F.col("x") % 24).alias("x"), "label")
    return src.tile_volume(tiles, 8, 24, (1, 9), (3, 18), (10, 60), zstep=2, value="label")


@query("tile_volume_mirrored", G + ", p AS (SELECT unnest(generate_series(-2, 21)) AS q) SELECT z, CAST(q + 2 AS INTEGER) AS y, x, label FROM v JOIN p ON v.y = CASE WHEN q < 0 THEN -q WHEN q > 19 THEN 38 - q ELSE q END WHERE z < 3")
def _(spark, d):
    v = E.grid(spark, d)
    tiles = v.select("z", F.floor(F.col("y") / 10).alias("row"), F.floor(F.col("x") / 32).alias("column"), (F.col("y") % 10).alias("y"), (F.col("x") % 32).alias("x"), "label")
    return src.tile_volume(tiles, 10, 32, (0, 3), (-2, 22), (0, 64), shape={"z": 3, "y": 20, "x": 64}, value="label")


CHUNKS = ", b AS (SELECT *, z // 4 AS cz, y // 10 AS cy, x // 32 AS cx FROM v WHERE z >= 4 AND z < 12), t AS (SELECT cz, cy, cx, max(label) AS m FROM b GROUP BY 1, 2, 3), o AS (SELECT cz, cy, cx, coalesce(sum(m) OVER (ORDER BY cz, cy, cx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM t)"


@query("chunk_grid", G + CHUNKS + " SELECT CAST(z - 5 AS INTEGER) AS z, CAST((y - 2) // 3 AS INTEGER) AS y, CAST(x - 20 AS INTEGER) AS x, CAST(CASE WHEN label > 0 THEN label + f ELSE 0 END * (x % 2) AS BIGINT) AS label FROM b JOIN o USING (cz, cy, cx) WHERE z >= 5 AND z < 11 AND y >= 2 AND y < 19 AND (y - 2) % 3 = 0 AND x >= 20 AND x < 50")
def _(spark, d):
    v = E.grid(spark, d)
    chunks = v.select(*[F.floor(F.col(a) / n).cast("int").alias(f"c{a}") for a, n in (("z", 4), ("y", 10), ("x", 32))], *[(F.col(a) % n).alias(a) for a, n in (("z", 4), ("y", 10), ("x", 32))], "label")
    mask = v.select((F.col("z") - 5).alias("z"), F.floor((F.col("y") - 2) / 3).cast("int").alias("y"), (F.col("x") - 20).alias("x"), (F.col("x") % 2).alias("mask")).where((F.col("z") >= 0) & (F.col("x") >= 0)).distinct()
    return src.chunk_grid(chunks, (4, 10, 32), (5, 11), (2, 19), (20, 50), step=(1, 3, 1), accumulate=True, mask=mask)


@query("clahe_16bit", G + " SELECT z, count(*) AS n, true AS inside FROM v GROUP BY z")
def _(spark, d):
    """Slices of 16-bit values keep their range; the equalization itself is held against its definition in tests."""
    wide = E.grid(spark, d).select("z", "y", "x", F.floor(S.clip(F.col("value") + 0.5, 0.0, 1.0) * 60000).cast("int").alias("value"))
    out = resample.clahe_any(wide, {"y": 20, "x": 64}, tiles=(2, 4)).withColumnRenamed("value", "new")
    both = wide.join(out, ["z", "y", "x"]).groupBy("z").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.min("new").alias("c"), F.max("new").alias("e"))
    return both.select("z", "n", ((F.col("c") >= F.col("a")) & (F.col("e") <= F.col("b"))).alias("inside"))


@query("resize_cubic", G + " SELECT z, y, CAST(x * 2 AS INTEGER) AS x, round(value, 9) AS value FROM v")
def _(spark, d):
    """A cubic spline goes through all values: every second place of a line that is twice as dense."""
    out = resample.resize(E.grid(spark, d).drop("label"), {"x": 127 / 64}, {"x": 64}, "value", order=3)
    return out.where("x % 2 = 0").withColumn("value", F.round("value", 9))
