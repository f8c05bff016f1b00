"""Queries over labelings: sizes, boxes, relabelling, overlap, tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, overlap, relabel, stats
from . import encodings as E
from .registry import query

L = f"WITH v AS ({E.LINES}) "
G = f"WITH v AS ({E.GRID}) "
BOXES = "min(z) AS zmin, max(z) AS zmax, min(y) AS ymin, max(y) AS ymax, min(x) AS xmin, max(x) AS xmax, count(*) AS cnt"
BY_GT = f"SELECT gt AS label, {BOXES} FROM v WHERE gt > 0 GROUP BY gt"
SHAPE = {"z": 8, "y": 13, "x": 51}


def _gt(spark, d):
    return E.lines(spark, d).withColumnRenamed("gt", "label")


@query("label_count", L + "SELECT seg AS label, count(*) AS cnt FROM v GROUP BY seg")
def _(spark, d):
    return stats.label_count(E.lines(spark, d), "seg")


@query("label_count_nonzero", L + "SELECT seg AS label, count(*) AS cnt FROM v WHERE seg <> 0 GROUP BY seg")
def _(spark, d):
    return stats.label_count(E.lines(spark, d), "seg", drop_zero=True)


@query("label_sizes_thresholds", L + "SELECT CAST(t AS BIGINT) AS threshold, count(*) FILTER (WHERE cnt > t) AS labels FROM (SELECT count(*) AS cnt FROM v WHERE gt <> 0 GROUP BY gt), (SELECT unnest([1000, 10000, 100000]) AS t) GROUP BY t")
def _(spark, d):
    return stats.sizes_over(stats.label_sizes(E.lines(spark, d), "gt"), [1000, 10000, 100000])


@query("large_labels", L + "SELECT gt AS label, count(*) AS cnt FROM v WHERE gt <> 0 GROUP BY gt HAVING count(*) > 8500")
def _(spark, d):
    return stats.large_labels(stats.label_sizes(E.lines(spark, d), "gt"), 8500)


@query("zcount", L + "SELECT gt AS label, count(DISTINCT z) AS slices FROM v WHERE gt > 0 GROUP BY gt")
def _(spark, d):
    return stats.zcount(E.lines(spark, d), "gt")


@query("unique_ids", L + "SELECT DISTINCT gt AS label FROM v")
def _(spark, d):
    return stats.unique_ids(E.lines(spark, d), "gt")


@query("bbox_global", L + f"SELECT {BOXES} FROM v WHERE gt > 0")
def _(spark, d):
    return stats.bbox_global(_gt(spark, d))


@query("bbox_all_2d", L + "SELECT gt AS label, min(y) AS ymin, max(y) AS ymax, min(x) AS xmin, max(x) AS xmax, count(*) AS cnt FROM v WHERE gt > 0 GROUP BY gt")
def _(spark, d):
    return stats.bbox_all(_gt(spark, d).drop("z"))


@query("bbox_all_3d", L + BY_GT)
def _(spark, d):
    return stats.bbox_all(_gt(spark, d))


@query("bbox_uid_subset", L + "SELECT CAST(id AS BIGINT) AS label, coalesce(zmin, 8) AS zmin, coalesce(zmax, -1) AS zmax, coalesce(ymin, 13) AS ymin, coalesce(ymax, -1) AS ymax, coalesce(xmin, 51) AS xmin, coalesce(xmax, -1) AS xmax, coalesce(cnt, 0) AS cnt FROM (SELECT unnest([1, 3, 99]) AS id) LEFT JOIN (" + BY_GT + ") b ON b.label = id")
def _(spark, d):
    ids = spark.createDataFrame([(1,), (3,), (99,)], "label long")
    return stats.bbox_all(_gt(spark, d), ids=ids, shape=SHAPE)


@query("bbox_chunk_merge", L + BY_GT)
def _(spark, d):
    local = _gt(spark, d).withColumn("c", F.floor(F.col("z") / 3).cast("int")).withColumn("z", (F.col("z") % 3).cast("int"))
    wide = local.withColumn("label", F.when(F.col("label") > 0, F.col("label") + F.col("c") * 100).otherwise(0))
    boxes = stats.bbox_all(wide).withColumn("c", F.floor(F.col("label") / 100).cast("int")).withColumn("label", F.col("label") % 100)
    return stats.merge_boxes(stats.shifted(boxes, "c", "z", 3).drop("c"))


@query("bbox_merge_two", L + BY_GT)
def _(spark, d):
    v = _gt(spark, d)
    return stats.merge_boxes(stats.bbox_all(v.where("z <= 3")), stats.bbox_all(v.where("z > 3")))


@query("bbox_merge_one", L + f"SELECT {BOXES} FROM v WHERE gt > 0")
def _(spark, d):
    return stats.merge_all_boxes(stats.bbox_all(_gt(spark, d)))


@query("bbox_border_faces", L + "SELECT label, CAST((zmin = 0)::INT + (zmax = 7)::INT + (ymin = 0)::INT + (ymax = 12)::INT + (xmin = 0)::INT + (xmax = 50)::INT AS INTEGER) AS faces FROM (" + BY_GT + ")")
def _(spark, d):
    return stats.border_faces(stats.bbox_all(_gt(spark, d)), SHAPE).select("label", "faces")


@query("chunk_extent", G + "SELECT max(z0 + dz) AS z, max(y0 + dy) AS y, max(x0 + dx) AS x FROM (SELECT z // 4 * 4 AS z0, CAST(0 AS INTEGER) AS y0, x // 16 * 16 AS x0, max(z) - z // 4 * 4 + 1 AS dz, max(y) + 1 AS dy, max(x) - x // 16 * 16 + 1 AS dx FROM v GROUP BY z // 4, x // 16)")
def _(spark, d):
    v = E.grid(spark, d)
    z0, x0 = F.floor(F.col("z") / 4) * 4, F.floor(F.col("x") / 16) * 16
    chunks = v.groupBy(z0.cast("int").alias("z0"), x0.cast("int").alias("x0")).agg((F.max("z") + 1).alias("ze"), (F.max("y") + 1).alias("dy"), (F.max("x") + 1).alias("xe"))
    return stats.chunk_extent(chunks.select("z0", F.lit(0).alias("y0"), "x0", (F.col("ze") - F.col("z0")).alias("dz"), "dy", (F.col("xe") - F.col("x0")).alias("dx")))


@query("volume_shape", G + "SELECT max(z) + 1 AS z, max(y) + 1 AS y, max(x) + 1 AS x FROM v")
def _(spark, d):
    return stats.volume_shape(E.grid(spark, d))


# --- relabelling


@query("relabel_asc", L + "SELECT gt * 3 AS old, row_number() OVER (ORDER BY gt) AS new FROM (SELECT DISTINCT gt FROM v WHERE gt > 0)")
def _(spark, d):
    return relabel.consecutive(_gt(spark, d).withColumn("label", F.col("label") * 3))


@query("relabel_by_size", L + "SELECT gt AS old, row_number() OVER (ORDER BY count(*) DESC, gt) AS new FROM v WHERE gt > 0 GROUP BY gt")
def _(spark, d):
    return relabel.consecutive(_gt(spark, d), by_size=True)


@query("relabel_map", L + "SELECT CAST(CASE gt WHEN 1 THEN 40 WHEN 2 THEN 40 WHEN 5 THEN 7 ELSE 0 END AS BIGINT) AS label, count(*) AS cnt FROM v GROUP BY 1")
def _(spark, d):
    mapping = spark.createDataFrame([(1, 40), (2, 40), (5, 7)], "old long, new long")
    return relabel.relabel(_gt(spark, d), mapping).groupBy("label").agg(F.count("*").alias("cnt"))


@query("remove_ids", L + "SELECT CAST(CASE WHEN gt IN (2, 4) THEN 0 ELSE gt END AS BIGINT) AS label, count(*) AS cnt FROM v GROUP BY 1")
def _(spark, d):
    return relabel.remove_ids(_gt(spark, d), [2, 4]).groupBy("label").agg(F.count("*").alias("cnt"))


@query("keep_ids", L + "SELECT CAST(CASE WHEN gt IN (2, 4) THEN gt ELSE 0 END AS BIGINT) AS label, count(*) AS cnt FROM v GROUP BY 1")
def _(spark, d):
    ids = spark.createDataFrame([(2,), (4,)], "label long")
    return relabel.remove_ids(_gt(spark, d), ids, invert=True).groupBy("label").agg(F.count("*").alias("cnt"))


@query("remove_small", L + "SELECT CAST(CASE WHEN n < (SELECT avg(n) FROM (SELECT count(*) AS n FROM v WHERE gt > 0 GROUP BY gt)) THEN 0 ELSE gt END AS BIGINT) AS label, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT gt, count(*) AS n FROM v GROUP BY gt) GROUP BY 1")
def _(spark, d):
    v = _gt(spark, d)
    mean = stats.label_sizes(v).agg(F.avg("cnt")).first()[0]
    return relabel.remove_small(v, mean).groupBy("label").agg(F.count("*").alias("cnt"))


@query("biggest", L + "SELECT CAST(CASE WHEN gt = (SELECT gt FROM v WHERE gt > 0 GROUP BY gt ORDER BY count(*) DESC, gt LIMIT 1) THEN gt ELSE 0 END AS BIGINT) AS label, count(*) AS cnt FROM v GROUP BY 1")
def _(spark, d):
    return relabel.biggest(_gt(spark, d)).groupBy("label").agg(F.count("*").alias("cnt"))


@query("label_type", "SELECT CASE WHEN max(l_orderkey) < 256 THEN 'uint8' WHEN max(l_orderkey) < 65536 THEN 'uint16' WHEN max(l_orderkey) < 4294967296 THEN 'uint32' ELSE 'uint64' END AS dtype FROM lineitem")
def _(spark, d):
    return relabel.label_type(E.table(spark, d, "lineitem"), "l_orderkey")


@query("query_in", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def _(spark, d):
    return relabel.query_in(E.table(spark, d, "customer").select("c_custkey"), E.table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("query_count", "SELECT c_custkey, CAST(coalesce(n, -1) AS BIGINT) AS cnt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey > 10 GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, d):
    counts = E.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("cnt"))
    return relabel.query_count(E.table(spark, d, "customer").select("c_custkey"), counts, "c_custkey", default=-1, above=10)


@query("query_count_strict", "SELECT o_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS cnt FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    found = E.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("cnt"), F.struct("l_linenumber", "l_partkey").alias("o"))
    keys = E.table(spark, d, "orders").select("o_orderkey").join(found.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    return relabel.query_count_strict(keys, found, "o_orderkey", "o")


@query("mask_apply", G + "SELECT CAST(CASE WHEN (x + y) % 3 = 0 THEN label ELSE 0 END AS BIGINT) AS label, count(*) AS cnt FROM v GROUP BY 1")
def _(spark, d):
    v = E.grid(spark, d)
    mask = v.select("z", "y", "x", F.when((F.col("x") + F.col("y")) % 3 == 0, 255).otherwise(0).alias("mask"))
    return relabel.masked(v.drop("value"), mask, ["z", "y", "x"], clip=True).groupBy("label").agg(F.count("*").alias("cnt"))


@query("syn_pair_merge", G + "SELECT CAST(2 * a - s + 100 AS BIGINT) AS id0, CAST(2 * b - s + 1000 AS BIGINT) AS id1 FROM (SELECT DISTINCT (p.label + 1) // 2 AS a, (q.label + 1) // 2 AS b FROM v p JOIN v q ON q.z = p.z AND q.y = p.y AND q.x = p.x + 1 WHERE p.label > 0 AND q.label > 0), (SELECT unnest([0, 1]) AS s)")
def _(spark, d):
    v = E.grid(spark, d).drop("value")
    return relabel.merge_pairs(v, v.withColumn("x", F.col("x") - 1), ["z", "y", "x"], 100, 1000)


@query("acc_id_offset", L + "SELECT z, CAST(CASE WHEN gt > 0 THEN gt + before ELSE 0 END AS BIGINT) AS label, count(*) AS cnt FROM v JOIN (SELECT z, coalesce(sum(m) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT z, max(gt) AS m FROM v GROUP BY z)) USING (z) GROUP BY 1, 2")
def _(spark, d):
    return relabel.offset_labels(_gt(spark, d), ["z"]).groupBy("z", "label").agg(F.count("*").alias("cnt"))


@query("topk_labels", L + "SELECT gt AS label, count(*) AS cnt FROM v WHERE gt <> 0 GROUP BY gt ORDER BY cnt DESC, label LIMIT 3")
def _(spark, d):
    return stats.label_sizes(_gt(spark, d)).orderBy(F.desc("cnt"), "label").limit(3)


# --- overlap


@query("contingency", L + "SELECT seg, gt, count(*) AS n FROM v WHERE gt <> 0 GROUP BY 1, 2")
def _(spark, d):
    return overlap.contingency(E.lines(spark, d), ignore_gt=[0])


@query("contingency_norm", L + "SELECT seg, gt, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 12) AS p FROM v GROUP BY 1, 2")
def _(spark, d):
    return overlap.contingency(E.lines(spark, d), share=True).withColumn("p", F.round("p", 12))


ARAND = """, t AS (SELECT gt, seg, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1, 2),
s AS (SELECT (SELECT sum(q * q) FROM (SELECT sum(n) AS q FROM t WHERE gt > 0 GROUP BY gt)) AS a,
 (SELECT sum(q * q) FROM (SELECT sum(n) AS q FROM t WHERE gt > 0 AND seg > 0 GROUP BY seg)) AS b,
 (SELECT sum(n * n) FROM t WHERE gt > 0 AND seg > 0) AS ab,
 (SELECT sum(n) FILTER (WHERE gt > 0 AND seg = 0) / sum(n) FROM t) AS c),
r AS (SELECT (ab + c) / (b + c) AS p, (ab + c) / a AS r FROM s)
SELECT round(1 - 2 * p * r / (p + r), 9) AS error, round(p, 9) AS precision, round(r, 9) AS recall FROM r"""


@query("adapted_rand", L.strip() + ARAND)
def _(spark, d):
    return overlap.adapted_rand(E.lines(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("error", "precision", "recall")])


def _entropy(where: str) -> str:
    return f""", t AS (SELECT seg, gt, CAST(count(*) AS DOUBLE) AS n FROM v {where} GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY seg) AS ns, sum(n) OVER (PARTITION BY gt) AS ng, sum(n) OVER () AS al FROM t) """


@query("voi", L.strip() + _entropy("WHERE gt <> 0") + "SELECT round(-sum(n / al * log2(n / ng)), 9) AS split, round(-sum(n / al * log2(n / ns)), 9) AS merge FROM m")
def _(spark, d):
    return overlap.voi(E.lines(spark, d)).select(F.round("split", 9).alias("split"), F.round("merge", 9).alias("merge"))


@query("split_vi", L.strip() + _entropy("") + "SELECT round(-sum(n / al * log2(n / ns)), 9) AS under, round(-sum(n / al * log2(n / ng)), 9) AS over FROM m")
def _(spark, d):
    return overlap.split_vi(E.lines(spark, d)).select(F.round("under", 9).alias("under"), F.round("over", 9).alias("over"))


@query("vi_tables", L.strip() + _entropy("") + "SELECT 'seg' AS side, seg AS label, round(-sum(n / al * log2(n / ns)), 9) AS entropy FROM m GROUP BY seg UNION ALL SELECT 'gt', gt, round(-sum(n / al * log2(n / ng)), 9) FROM m GROUP BY gt")
def _(spark, d):
    return overlap.vi_tables(E.lines(spark, d)).withColumn("entropy", F.round("entropy", 9))


PRED = "WITH v AS (SELECT least(n_chars / 5000.0::DOUBLE, 1) AS pred, quality AS gt FROM labels JOIN documents USING (doc_id)) "


def _pred(spark, d):
    both = E.table(spark, d, "labels").join(E.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("pred"), F.col("quality").alias("gt"))


@query("confusion_matrix", PRED + "SELECT count(*) FILTER (WHERE pred > 0.5 AND gt = 1) AS tp, count(*) FILTER (WHERE pred > 0.5 AND gt = 0) AS fp, count(*) FILTER (WHERE NOT pred > 0.5 AND gt = 0) AS tn, count(*) FILTER (WHERE NOT pred > 0.5 AND gt = 1) AS fn FROM v")
def _(spark, d):
    return overlap.confusion(_pred(spark, d))


@query("binary_jaccard", PRED.strip() + """, c AS (SELECT CAST(t AS DOUBLE) AS threshold, CAST(count(*) FILTER (WHERE pred > t AND gt = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE pred > t AND gt = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE NOT pred > t AND gt = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE NOT pred > t AND gt = 1) AS DOUBLE) AS fn FROM v, (SELECT unnest([0.1, 0.3, 0.5]) AS t) GROUP BY t)
SELECT threshold, round(tp / nullif(tp + fp + fn, 0), 12) AS fg_iou, round((tp / nullif(tp + fp + fn, 0) + tn / nullif(tn + fp + fn, 0)) / 2, 12) AS mean_iou, round(tp / nullif(tp + fp, 0), 12) AS precision, round(tp / nullif(tp + fn, 0), 12) AS recall FROM c""")
def _(spark, d):
    out = overlap.binary_jaccard(_pred(spark, d), [0.1, 0.3, 0.5])
    return out.select("threshold", *[F.round(c, 12).alias(c) for c in out.columns[1:]])


MATCH = """, n AS (SELECT gt AS a, seg AS b, count(*) AS n FROM v WHERE gt > 0 AND seg > 0 GROUP BY 1, 2),
best AS (SELECT a, b, n FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
m AS (SELECT s.gt AS id0, coalesce(b, 0) AS id1, s.c AS n0, coalesce(t.c, 0) AS n1, coalesce(n, 0) AS overlap FROM (SELECT gt, count(*) AS c FROM v WHERE gt > 0 GROUP BY gt) s LEFT JOIN best ON a = s.gt LEFT JOIN (SELECT seg, count(*) AS c FROM v GROUP BY seg) t ON t.seg = b) """


def _match(spark, d, min_iou=None):
    v = E.lines(spark, d)
    pairs = v.select(F.col("gt").alias("a"), F.col("seg").alias("b"))
    return overlap.best_match(pairs, stats.label_count(v, "gt"), stats.label_count(v, "seg"), min_iou=min_iou)


@query("seg_iou", L.strip() + MATCH + "SELECT * FROM m")
def _(spark, d):
    return _match(spark, d)


@query("seg_iou_filtered", L.strip() + MATCH + "SELECT * FROM m WHERE overlap / (n0 + n1 - overlap) > 0.092")
def _(spark, d):
    return _match(spark, d, 0.092)


TRACK = f"""WITH RECURSIVE v AS ({E.BLANKED}), s AS (SELECT z, max(label) > 0 AS has FROM v GROUP BY z),
p AS (SELECT z, has, last_value(CASE WHEN has THEN z END IGNORE NULLS) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
c AS (SELECT z, label, count(*) AS n FROM v WHERE label > 0 GROUP BY 1, 2),
n AS (SELECT p.z, a.label AS a, b.label AS b, count(*) AS n FROM p JOIN v a ON a.z = p.prev JOIN v b ON b.z = p.z AND b.y = a.y AND b.x = a.x WHERE a.label > 0 AND b.label > 0 GROUP BY 1, 2, 3),
best AS (SELECT z, a, b, n FROM n QUALIFY row_number() OVER (PARTITION BY z, a ORDER BY n DESC, b) = 1)
SELECT p.z, o.label AS id0, CASE WHEN p.has THEN coalesce(b, 0) ELSE o.label END AS id1, o.n AS n0, CASE WHEN p.has THEN coalesce(t.n, 0) ELSE o.n END AS n1, CASE WHEN p.has THEN coalesce(best.n, 0) ELSE o.n END AS overlap
FROM p JOIN c o ON o.z = p.prev LEFT JOIN best ON best.z = p.z AND a = o.label LEFT JOIN c t ON t.z = p.z AND t.label = b WHERE p.prev IS NOT NULL"""


@query("slice_tracking", TRACK)
def _(spark, d):
    return overlap.track(E.blanked(spark, d))


ASSEMBLED = TRACK.replace("SELECT p.z, o.label AS id0", "m AS (SELECT p.prev, p.has, p.z, o.label AS id0").replace("ORDER BY n DESC, b) = 1)\nm AS", "ORDER BY n DESC, b) = 1),\nm AS") + """),
k AS (SELECT prev * 1000 + id0 AS a, z * 1000 + id1 AS b FROM m WHERE has AND overlap / (n0 + n1 - overlap) > 0.2),
g AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT z * 1000 + label AS id, z * 1000 + label AS o FROM c UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.o),
q AS (SELECT id, min(o) AS component FROM r GROUP BY id), w AS (SELECT id, dense_rank() OVER (ORDER BY component) AS new FROM q)
SELECT v.z, v.y, v.x, CAST(coalesce(new, 0) AS BIGINT) AS label FROM v LEFT JOIN w ON w.id = v.z * 1000 + v.label AND v.label > 0"""


@query("track_assembly", ASSEMBLED)
def _(spark, d):
    return overlap.assembled(E.blanked(spark, d).drop("value"), min_iou=0.2)


@query("masked_rand", f"WITH v AS (SELECT label AS gt, CAST(CASE WHEN (x + y) % 5 = 0 THEN 0 ELSE label % 11 END AS BIGINT) AS seg FROM ({E.GRID}))" + ARAND)
def _(spark, d):
    v = E.grid(spark, d)
    seg = v.select("z", "y", "x", (F.col("label") % 11).alias("label"))
    mask = v.select("z", "y", "x", F.when((F.col("x") + F.col("y")) % 5 == 0, 0).otherwise(1).alias("mask"))
    return overlap.rand_score(seg, v, ["z", "y", "x"], mask).select(*[F.round(c, 9).alias(c) for c in ("error", "precision", "recall")])


# --- order and links over label tables


@query("linked_list_anchor", L.strip() + f", b AS ({BY_GT}) SELECT label, CAST((xmin + xmax) // 2 AS BIGINT) AS anchorx, CAST((ymin + ymax) // 2 AS BIGINT) AS anchory, CAST((zmin + zmax) // 2 AS BIGINT) AS anchorz, coalesce(lag(label) OVER (ORDER BY label), 0) AS prev, coalesce(lead(label) OVER (ORDER BY label), 0) AS next FROM b")
def _(spark, d):
    return ordered.anchors(stats.bbox_all(_gt(spark, d)))
