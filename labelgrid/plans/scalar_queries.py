"""Queries over scalar functions, texts and small generated grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import resample
from ..sinks import documents as docs_out
from ..sinks import volumes as files_out
from ..sources import segments, volumes
from ..storage import fresh
from . import encodings as E
from .registry import query


def _part(spark, d):
    return E.table(spark, d, "part")


@query("rgb_pack", "SELECT p_partkey, CAST((p_partkey * 7919 // 65536) % 256 AS INTEGER) AS r, CAST((p_partkey * 7919 // 256) % 256 AS INTEGER) AS g, CAST(p_partkey * 7919 % 256 AS INTEGER) AS b FROM part")
def _(spark, d):
    r, g, b = S.rgb_pack(F.col("p_partkey") * 7919)
    return _part(spark, d).select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("rgb_unpack", "SELECT p_partkey, CAST(CASE WHEN grey THEN p_partkey % 256 ELSE r * 65536 + g * 256 + p_partkey % 256 END AS BIGINT) AS label FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey % 256 ELSE p_size END AS r, CASE WHEN p_size % 3 = 0 THEN p_partkey % 256 ELSE 3 END AS g, bool_and(p_size % 3 = 0 OR (p_size = 3 AND p_partkey % 256 = 3)) OVER (PARTITION BY p_size) AS grey FROM part)")
def _(spark, d):
    b = (F.col("p_partkey") % 256).cast("int")
    grey = F.col("p_size") % 3 == 0
    img = _part(spark, d).select("p_partkey", "p_size", F.when(grey, b).otherwise(F.col("p_size")).alias("r"), F.when(grey, b).otherwise(3).alias("g"), b.alias("b"))
    return S.unpack_image(img, "p_size").select("p_partkey", "label")


@query("dim_pack", "SELECT p_partkey, CAST((p_partkey % 100 * 1000 + p_size) * 1000 + p_partkey % 7 AS BIGINT) AS packed FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", S.dim_pack([F.col("p_partkey") % 100, "p_size", F.col("p_partkey") % 7], 1000).alias("packed"))


@query("dim_unpack", "SELECT p_partkey, CAST(p_partkey * 12345 // 10000 % 100 AS BIGINT) AS a, CAST(p_partkey * 12345 // 100 % 100 AS BIGINT) AS b, CAST(p_partkey * 12345 % 100 AS BIGINT) AS c FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", *[c.alias(n) for c, n in zip(S.dim_unpack(F.col("p_partkey") * 12345, 100), "abc")])


@query("arr_to_str", "SELECT l_orderkey, string_agg(CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_extendedprice) AS prices FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = E.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("s"))
    return rows.select("l_orderkey", S.array_text(F.transform("s", lambda x: x["l_extendedprice"])).alias("prices"))


@query("arr_rows", "SELECT l_orderkey, i // 3 AS line, string_agg(CAST(CAST(trunc(p) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS row FROM (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i FROM lineitem) GROUP BY 1, 2")
def _(spark, d):
    rows = E.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("s"))
    return rows.select("l_orderkey", F.posexplode(S.array_rows(F.transform("s", lambda x: x["l_extendedprice"]), 3)).alias("line", "row")).withColumn("line", F.col("line").cast("long"))


@query("first_occurrences", "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    turns = E.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return turns.select("conv_id", F.array_join(S.first_occurrences(F.transform("s", lambda x: x["role"])), ",").alias("roles"))


@query("spaced_colors", "SELECT i, CAST(i * 2368767 // 65536 % 256 AS INTEGER) AS r, CAST(i * 2368767 // 256 % 256 AS INTEGER) AS g, CAST(i * 2368767 % 256 AS INTEGER) AS b FROM (SELECT CAST(unnest(generate_series(0, 7)) AS BIGINT) AS i)")
def _(spark, d):
    return S.spaced_colors(spark, 7)


@query("url_param", "SELECT page_id, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS source, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def _(spark, d):
    return E.table(spark, d, "pages").select("page_id", S.url_param("url", "utm_source").alias("source"), S.url_param("url", "page").alias("page"))


@query("name_keyword_match", "SELECT p_partkey, lower(p_name) LIKE '%blue%' OR lower(p_name) LIKE '%7%' AS hit FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", S.has_keyword("p_name", ["Blue", "7"]).alias("hit"))


@query("chunk_name_regex", "SELECT p_partkey, CAST(p_partkey % 50 * 112 AS INTEGER) AS z0, p_size AS y0, CAST(p_partkey AS INTEGER) AS x0 FROM part")
def _(spark, d):
    name = F.format_string("chunk_z%d_y%d_x%d.h5", F.col("p_partkey") % 50 * 112, "p_size", "p_partkey")
    return _part(spark, d).select("p_partkey", S.chunk_start(name).alias("c")).select("p_partkey", "c.*")


@query("tuple_parse", "SELECT p_partkey, p_partkey AS z, CAST(p_size AS BIGINT) AS y, p_partkey * 2 AS x FROM part")
def _(spark, d):
    t = S.tuple_numbers(F.format_string("(%d, %d, %d)", "p_partkey", "p_size", F.col("p_partkey") * 2))
    return _part(spark, d).select("p_partkey", t[0].alias("z"), t[1].alias("y"), t[2].alias("x"))


@query("tile_name", "SELECT p_partkey, 'im_' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '_' || p_partkey || '.png' AS a, 'r' || p_size || 'c' || p_partkey AS b FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", S.tile_name("im_%04d_%d.png", "p_size", "p_partkey").alias("a"), S.tile_name("r{row}c{column}", "p_size", "p_partkey").alias("b"))


@query("xlogx", "SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 0.0::DOUBLE ELSE (p_size - 1) / 50.0::DOUBLE * log2((p_size - 1) / 50.0::DOUBLE) END, 9) AS v FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", F.round(S.xlogx((F.col("p_size") - 1) / 50.0), 9).alias("v"))


@query("divide_rows", "SELECT l_returnflag, l_linestatus, round(coalesce(q / nullif(sum(q) OVER (PARTITION BY l_returnflag), 0), 0), 9) AS by_row, round(coalesce(q / nullif(sum(q) OVER (PARTITION BY l_linestatus), 0), 0), 9) AS by_column FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def _(spark, d):
    q = E.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    both = S.divide_by_marginal(S.divide_by_marginal(q, "q", "l_returnflag", "by_row"), "q", "l_linestatus", "by_column")
    return both.select("l_returnflag", "l_linestatus", F.round("by_row", 9).alias("by_row"), F.round("by_column", 9).alias("by_column"))


@query("ceil_div", "SELECT p_partkey, CAST((p_partkey + 6) // 7 AS BIGINT) AS v, least(64.0::DOUBLE, pow(2.0::DOUBLE, ceil(log2(sqrt(CAST(p_size AS DOUBLE)))))) AS side FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", S.ceil_div("p_partkey", 7).alias("v"), S.square_chunk("p_size", F.lit(64)).alias("side"))


@query("gaussian_mask", "SELECT CAST(i AS BIGINT) AS x, round(exp(-((i - 100) * (i - 100) / (360 * 20.0::DOUBLE) + (i - 200) * (i - 200) / (640 * 30.0::DOUBLE)))) AS a FROM (SELECT unnest(generate_series(0, 359)) AS i)")
def _(spark, d):
    return spark.range(360).select(F.col("id").alias("x"), S.gaussian_attention("id", 100, 200, 20, 30).alias("a"))


@query("tile_coord", """WITH p(n, lo, hi, k) AS (VALUES ('x', 10, 110, 3), ('y', 0, 77, 2), ('z', 5, 25, 4)), r AS (SELECT n, CAST(lo + i * ((hi - lo) // k) AS BIGINT) AS a, CAST(CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) // k) END AS BIGINT) AS b FROM p, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i < k)
SELECT x.a AS x0, x.b AS x1, y.a AS y0, y.b AS y1, z.a AS z0, z.b AS z1 FROM r x, r y, r z WHERE x.n = 'x' AND y.n = 'y' AND z.n = 'z'""")
def _(spark, d):
    return resample.tile_ranges(spark, (10, 110), (0, 77), (5, 25), (3, 2, 4))


@query("tile_info_json", """SELECT '{"image":["im2","im1","im0","im1","im2","im3","im4","im3"],"depth":8,"height":9216,"width":6144,"tile_st":[0,0],"dtype":"uint8","n_columns":6,"n_rows":9,"tile_size":1024,"ndim":1,"tile_ratio":1}' AS json""")
def _(spark, d):
    return docs_out.tile_info(spark, (5, 9216, 6144), (9, 6), "im%d", pad=(2, 1))


@query("mip_info", """SELECT CAST(m AS INTEGER) AS mip, (3000 + r - 1) // r || 'x' || (3001 + r - 1) // r || 'x1350' AS size, (7 + r - 1) // r || 'x' || (5 + r - 1) // r || 'x0' AS "offset", 9 * r || '_' || 9 * r || '_20' AS key FROM (SELECT m, CAST(pow(2, m) AS INTEGER) AS r FROM (SELECT unnest([0, 1, 2, 3]) AS m))""")
def _(spark, d):
    scales = docs_out.Pyramid((3000, 3001, 1350), (9, 9, 20), [(2**m, 2**m, 1) for m in range(4)], (128, 128, 64), (7, 5, 0)).scales(spark)
    joined = lambda c: F.concat_ws("x", F.transform(c, lambda x: x.cast("string")))
    return scales.select("mip", joined("size").alias("size"), joined("voxel_offset").alias("offset"), "key")


@query("text_lines", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)")
def _(spark, d):
    return E.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query("read_text_lines", "SELECT l AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE text NOT LIKE '%' || chr(13) || '%') GROUP BY 1")
def _(spark, d):
    """Lines written to files, and read back by the library's reader."""
    lines = E.table(spark, d, "documents").where(~F.contains("text", F.lit("\r"))).select(F.explode(F.split("text", "\n")).alias("line"))
    folder = fresh(spark, "lines")
    files_out.write_lines(lines, folder)
    return volumes.read_lines(spark, folder).groupBy("value").agg(F.count("*").alias("n"))


@query("segment_text", "SELECT CAST(p_partkey AS BIGINT) AS nr, CAST(p_size AS BIGINT) AS red1, CAST(p_partkey % 11 AS BIGINT) AS parentnr, CAST(p_partkey + 1 AS BIGINT) AS nextnr, CAST(-1 AS BIGINT) AS bboxz2, p_name AS name FROM part UNION ALL SELECT 0, 0, 0, 1, -1, 'Background'")
def _(spark, d):
    """Segments as lines of the text format, with the background's, written to files and parsed again."""
    own = {"nr": F.col("p_partkey"), "red1": F.col("p_size"), "parentnr": F.col("p_partkey") % 11, "nextnr": F.col("p_partkey") + 1}
    rows = _part(spark, d).select(*[own.get(c, F.lit(-1)).cast("long").alias(c) for c in segments.FIELDS], F.col("p_name").alias("name"))
    folder = fresh(spark, "segments")
    files_out.write_lines(docs_out.segment_lines(rows, first=1), folder)
    return segments.read_segments(spark, folder).select("nr", "red1", "parentnr", "nextnr", "bboxz2", "name")


@query("chunk_side", "SELECT p_partkey, CAST(least(128, CAST(pow(2.0::DOUBLE, ceil(log2(sqrt(CAST(p_partkey AS DOUBLE))))) AS BIGINT)) AS BIGINT) AS side FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", S.square_chunk("p_partkey", F.lit(128)).cast("long").alias("side"))


@query("wide_labels", "SELECT p_partkey, CAST((4611686018427387904::HUGEINT + p_partkey * 1000003) // 7 AS BIGINT) AS cut, CAST((4611686018427387904::HUGEINT + p_partkey * 1000003) // 1000 % 1000 AS BIGINT) AS digit, CAST((4611686018427387904::HUGEINT + p_partkey * 1000003 + 4611686018427387905::HUGEINT) // 2 AS BIGINT) AS middle FROM part")
def _(spark, d):
    label = F.lit(1 << 62).cast("long") + F.col("p_partkey") * 1000003
    return _part(spark, d).select("p_partkey", S.floor_div(label, 7).alias("cut"), S.dim_unpack(label, 1000)[1].alias("digit"), S.midpoint(label, F.lit((1 << 62) + 1)).alias("middle"))


@query("html_shots", """SELECT CAST(doc_id AS BIGINT) AS doc_id, '<li data-start="' || doc_id || '">' || replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li>' AS item FROM documents""")
def _(spark, d):
    return docs_out.html_items(E.table(spark, d, "documents"), "doc_id", "source").select("doc_id", "item")
