"""Queries over ordered data: shards, links, fills, runs, folds, hierarchies, graphs, skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, ordered, skeleton
from . import encodings as E
from .registry import query


@query("shard_modulo", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 2")
def _(spark, d):
    return ordered.sharded(E.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 2, 7, "o_orderkey")


@query("split_chunk_overlap", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CAST(ceil(count(*) OVER () / 4) AS BIGINT) AS s FROM orders) WHERE i >= s AND i < 2 * s + 5")
def _(spark, d):
    return ordered.split_chunks(E.table(spark, d, "orders").select("o_orderkey"), 1, 4, "o_orderkey", overlap=5)


@query("done_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    return ordered.not_done(E.table(spark, d, "customer").select("c_custkey"), E.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("sibling_links", "SELECT conv_id, turn, coalesce(lag(turn) OVER w, 0) AS prev, coalesce(lead(turn) OVER w, 0) AS next, first_value(turn) OVER w AS first_child FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    return ordered.linked(E.table(spark, d, "conversations").select("conv_id", "turn"), "turn", ["conv_id"])


@query("sibling_tree", """WITH t AS (SELECT n_regionkey AS g, n_nationkey + 1 AS label FROM nation), m AS (SELECT max(label) AS m FROM t),
g AS (SELECT g, min(label) AS f, CAST(row_number() OVER (ORDER BY g) + (SELECT m FROM m) AS BIGINT) AS nr FROM t GROUP BY g)
SELECT CAST(label AS BIGINT) AS nr, 'seg' || label AS name, nr AS parentnr, CAST(0 AS BIGINT) AS childnr, CAST(coalesce(lag(label) OVER w, 0) AS BIGINT) AS prevnr, CAST(coalesce(lead(label) OVER w, 0) AS BIGINT) AS nextnr, CAST(-1 AS BIGINT) AS anchorx, CAST(-1 AS BIGINT) AS anchory, CAST(-1 AS BIGINT) AS anchorz FROM t JOIN g USING (g) WINDOW w AS (PARTITION BY t.g ORDER BY label)
UNION ALL SELECT nr, CAST(g AS VARCHAR), 0, CAST(f AS BIGINT), coalesce(lag(nr) OVER (ORDER BY nr), 0), coalesce(lead(nr) OVER (ORDER BY nr), 0), -1, -1, -1 FROM g""")
def _(spark, d):
    nation = E.table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") + 1).alias("label"))
    return hierarchy.sibling_tree(nation, "g")


@query("blank_slice_fill", f"""WITH v AS ({E.BLANKED}), s AS (SELECT z, max(label) > 0 AS has FROM v GROUP BY z),
f AS (SELECT z, coalesce(last_value(CASE WHEN has THEN z END IGNORE NULLS) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(CASE WHEN has THEN z END IGNORE NULLS) OVER (ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), z) AS src FROM s)
SELECT f.z, y, x, label FROM f JOIN v ON v.z = f.src""")
def _(spark, d):
    return ordered.blank_fill(E.blanked(spark, d).drop("value"))


T = f"WITH t AS ({E.FRAMES})"
NORM = T + ", n AS (SELECT frame, (value - min(value) OVER ()) / nullif(max(value) OVER () - min(value) OVER (), 0) AS value FROM t) "


@query("minmax_normalise", NORM + "SELECT frame, round(value, 12) AS value FROM n")
def _(spark, d):
    return ordered.minmax(E.frames(spark, d), "value").withColumn("value", F.round("value", 12))


RUNS = ", i AS (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS k FROM n WHERE value BETWEEN 0.4 AND 1.0), r AS (SELECT min(frame) AS first, max(frame) AS last, count(*) AS n FROM i GROUP BY k HAVING count(*) >= 2) "


@query("runs", NORM.strip() + RUNS + "SELECT first, last, n FROM r")
def _(spark, d):
    scaled = ordered.minmax(E.frames(spark, d), "value")
    return ordered.runs(scaled, "frame", F.col("value").between(0.4, 1.0), 2)


@query("shot_islands", NORM.strip() + RUNS + """, m AS (SELECT 0 AS k, min(frame) AS frame, 0 AS s FROM n UNION ALL SELECT 2, max(frame), 0 FROM n UNION ALL SELECT 1, first, 0 FROM r UNION ALL SELECT 1, last, 1 FROM r),
p AS (SELECT CAST(row_number() OVER (ORDER BY k, frame, s) - 1 AS INTEGER) AS position, frame FROM m)
SELECT position, frame, CAST((position + 1) % 2 AS INTEGER) AS label FROM p""")
def _(spark, d):
    return ordered.shots(E.frames(spark, d), "frame", "value", 0.4, 1.0, 2)


@query("ema", T.replace("WITH t", "WITH RECURSIVE t") + ", e AS (SELECT frame, value, value AS e FROM t WHERE frame = 0 UNION ALL SELECT t.frame, t.value, e.e + 0.1::DOUBLE * (t.value - e.e) FROM e JOIN t ON t.frame = e.frame + 1) SELECT frame, round(e, 9) AS value FROM e")
def _(spark, d):
    return ordered.ema(E.frames(spark, d), "frame", "value", 0.1).withColumn("value", F.round("value", 9))


@query("clip_peak", f"""WITH RECURSIVE t AS ({E.FRAMES}), l AS (SELECT list(value ORDER BY frame) AS v FROM t),
c AS (SELECT 0 AS i, v FROM l UNION ALL SELECT i + 10, CASE WHEN list_max(v[i + 1:i + 21]) >= 9 THEN list_concat(list_concat(v[1:i], list_transform(v[i + 1:i + 21], lambda q: 0.0::DOUBLE)), v[i + 22:]) ELSE v END FROM c WHERE i + 20 < len(v)),
f AS (SELECT v FROM c ORDER BY i DESC LIMIT 1)
SELECT CAST(unnest(generate_series(0, len(v) - 1)) AS BIGINT) AS frame, unnest(v) AS value FROM f""")
def _(spark, d):
    return ordered.clip_peak(E.frames(spark, d), "frame", "value", 9)


# --- hierarchies, graphs, skeletons


def _chain(spark, d):
    """Regions, their nations, and the nations' customers as segments."""
    t = lambda n: E.table(spark, d, n)
    region = t("region").select((F.col("r_regionkey") + 1).cast("long").alias("nr"), F.lit(0).cast("long").alias("parentnr"), F.col("r_name").alias("name"))
    nation = t("nation").select((F.col("n_nationkey") + 101).cast("long").alias("nr"), (F.col("n_regionkey") + 1).cast("long").alias("parentnr"), F.col("n_name").alias("name"))
    customer = t("customer").select((F.col("c_custkey") + 1000).alias("nr"), (F.col("c_nationkey") + 101).cast("long").alias("parentnr"), F.concat("c_mktsegment", "c_name").alias("name"))
    return region.unionByName(nation).unionByName(customer)


CHAIN = """s AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS p, r_name AS name FROM region UNION ALL SELECT n_nationkey + 101, n_regionkey + 1, n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 101, c_mktsegment || c_name FROM customer),
k AS (SELECT nr, p, lower(name) LIKE '%furn%' OR lower(name) LIKE '%7%' AS bad, lower(name) LIKE '%asia%' OR lower(name) LIKE '%background%' AS stop FROM s)"""


def _relabel_sql(resurrect: bool) -> str:
    gone, up = "WHEN k.bad OR coalesce(q.bad, false) THEN 0", "WHEN NOT coalesce(q.bad, false) AND NOT coalesce(q.stop, k.p = 0) THEN k.p"
    return f"""WITH RECURSIVE {CHAIN}, o AS (SELECT k.nr AS id, CAST(CASE {up if resurrect else gone} {gone if resurrect else up} ELSE k.nr END AS BIGINT) AS t FROM k LEFT JOIN k q ON q.nr = k.p),
w AS (SELECT id, t, 0 AS step FROM o UNION ALL SELECT w.id, o.t, step + 1 FROM w JOIN o ON o.id = w.t WHERE o.t <> w.t)
SELECT id, arg_max(t, step) AS new FROM w GROUP BY id"""


@query("hierarchy_relabel", _relabel_sql(False))
def _(spark, d):
    return hierarchy.hierarchy_relabel(_chain(spark, d), ["furn", "7"], ["asia"])


@query("hierarchy_relabel_resurrect", _relabel_sql(True))
def _(spark, d):
    return hierarchy.hierarchy_relabel(_chain(spark, d), ["furn", "7"], ["asia"], resurrect=True)


def _sets(spark, d):
    c = E.table(spark, d, "customer")
    return hierarchy.Sets(c.select("c_custkey"), c.select("c_custkey", (F.col("c_custkey") + F.col("c_nationkey") % 3).alias("b")))


SETS = """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + c_nationkey % 3 AS b FROM customer), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS o FROM n UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.o), c AS (SELECT id, min(o) AS component FROM r GROUP BY id) """


@query("components_mapping", SETS + "SELECT id, component FROM c")
def _(spark, d):
    s = _sets(spark, d)
    return s.union(s.pairs).mapping()


@query("components_list", SETS + "SELECT component, count(*) AS members FROM c GROUP BY component")
def _(spark, d):
    s = _sets(spark, d)
    return s.union(s.pairs).components()


@query("union_find_relabel", SETS + "SELECT i AS id, coalesce(component, i) AS new FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(id) FROM c))) AS BIGINT) AS i) LEFT JOIN c ON c.id = i")
def _(spark, d):
    s = _sets(spark, d)
    return s.union(s.pairs).relabel()


P = f"WITH n AS ({E.POINTS})"


@query("skeleton_build", P + ", m AS (SELECT skeleton_id, node, CAST(x AS BIGINT) % 2 AS part FROM n) SELECT a.skeleton_id * 2 + a.part AS id, count(*) AS edges, CAST(sum(a.node) AS BIGINT) AS nodes FROM m a JOIN m b ON b.skeleton_id = a.skeleton_id AND b.node = a.node + 1 AND b.part = a.part GROUP BY 1")
def _(spark, d):
    nodes, edges = E.points(spark, d)
    key = lambda s, n: F.col(s) * 1000 + F.col(n)
    flat = nodes.select(key("skeleton_id", "node").alias("node"), (F.col("skeleton_id") * 2 + F.col("x").cast("long") % 2).alias("id"), "z", "y", "x")
    n, e = skeleton.skeletons(flat, edges.select(key("skeleton_id", "src").alias("src"), key("skeleton_id", "dst").alias("dst")))
    whole = n.select("id", F.col("local").alias("src"), (F.col("node") % 1000).alias("place"))
    return e.join(whole, ["id", "src"]).groupBy("id").agg(F.count("*").alias("edges"), F.sum("place").alias("nodes"))


SQUARED = P + ", e AS (SELECT a.skeleton_id, 900 * (a.z - b.z) * (a.z - b.z) + 36 * (a.y - b.y) * (a.y - b.y) + 36 * (a.x - b.x) * (a.x - b.x) AS d2 FROM n a JOIN n b ON b.skeleton_id = a.skeleton_id AND b.node = a.node + 1) "


@query("skeleton_norm", SQUARED + "SELECT skeleton_id, round(sqrt(sum(d2)), 6) AS norm FROM e GROUP BY 1")
def _(spark, d):
    return skeleton.skeleton_norm(*E.points(spark, d), resolution=(30, 6, 6)).withColumn("norm", F.round("norm", 6))


@query("cable_length", SQUARED + "SELECT skeleton_id, round(sum(sqrt(d2)), 6) AS length FROM e GROUP BY 1")
def _(spark, d):
    return skeleton.cable_length(*E.points(spark, d), resolution=(30, 6, 6)).withColumn("length", F.round("length", 6))


@query("skeleton_join", P + ", u AS (SELECT skeleton_id, count(*) AS c FROM n GROUP BY 1 HAVING count(*) > 1), o AS (SELECT skeleton_id, CAST(sum(c) OVER (ORDER BY skeleton_id) - c AS BIGINT) AS before FROM u) SELECT node + before AS node, skeleton_id, z * 30 AS z, y * 6 AS y, x * 6 AS x FROM n JOIN o USING (skeleton_id)")
def _(spark, d):
    return skeleton.joined(*E.points(spark, d), resolution=(30, 6, 6))[0]


@query("find_elements", SETS + "SELECT id, component FROM c WHERE id % 4 = 1")
def _(spark, d):
    s = _sets(spark, d)
    ids = E.table(spark, d, "customer").where("c_custkey % 4 = 1").select("c_custkey")
    extra = s.union(s.pairs)
    beyond = extra.mapping().where("id % 4 = 1").select("id").subtract(ids)
    return extra.found(ids.union(beyond))


@query("connected_pairs", SETS + "SELECT CAST(c_custkey AS BIGINT) AS a, CAST(c_custkey + 2 AS BIGINT) AS b, coalesce(p.component = q.component, false) AS connected FROM customer LEFT JOIN c p ON p.id = c_custkey LEFT JOIN c q ON q.id = c_custkey + 2")
def _(spark, d):
    s = _sets(spark, d)
    pairs = E.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("a"), (F.col("c_custkey") + 2).cast("long").alias("b"))
    return s.union(s.pairs).tied(pairs)


@query("rewired_tree", """WITH t AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS nr, CAST(100 + n_regionkey AS BIGINT) AS g, CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS BIGINT) END AS up FROM nation),
k AS (SELECT nr, coalesce(up, g) AS parentnr, up IS NOT NULL AS child, coalesce(lag(nr) OVER w, 0) AS prevnr, coalesce(lead(nr) OVER w, 0) AS nextnr FROM t WINDOW w AS (PARTITION BY coalesce(up, g), up IS NOT NULL ORDER BY nr))
SELECT k.nr, parentnr, CAST(coalesce(c.f, 0) AS BIGINT) AS childnr, CAST(prevnr AS BIGINT) AS prevnr, CAST(nextnr AS BIGINT) AS nextnr FROM k LEFT JOIN (SELECT up, min(nr) AS f FROM t GROUP BY up) c ON c.up = k.nr
UNION ALL SELECT g, 0, min(nr) FILTER (WHERE up IS NULL), coalesce(lag(g) OVER (ORDER BY g), 0), coalesce(lead(g) OVER (ORDER BY g), 0) FROM t GROUP BY g""")
def _(spark, d):
    n = E.table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("nr"), (100 + F.col("n_regionkey")).cast("long").alias("parentnr"))
    zero = F.lit(0).cast("long")
    leaves = n.select("nr", "parentnr", zero.alias("childnr"), zero.alias("prevnr"), zero.alias("nextnr"))
    tops = n.groupBy("parentnr").agg(F.min("nr").alias("childnr")).select(F.col("parentnr").alias("nr"), zero.alias("parentnr"), "childnr", zero.alias("prevnr"), zero.alias("nextnr"))
    mapping = n.select(F.col("nr").alias("id"), F.when((F.col("nr") - 1) % 3 == 1, F.col("nr") - 1).otherwise(F.col("nr")).alias("new"))
    return hierarchy.rewired(leaves.unionByName(tops), mapping)


SMOOTH = T.replace("WITH t", "WITH RECURSIVE t") + """, e AS (SELECT frame, value AS e FROM t WHERE frame = 0 UNION ALL SELECT t.frame, e.e + 0.2::DOUBLE * (t.value - e.e) FROM e JOIN t ON t.frame = e.frame + 1),
n AS (SELECT frame, (e - min(e) OVER ()) / nullif(max(e) OVER () - min(e) OVER (), 0) AS value FROM e) """


@query("shots_smoothed", SMOOTH.strip() + RUNS.replace("0.4 AND 1.0", "0.45 AND 1.0").replace(">= 2", ">= 3") + """, m AS (SELECT 0 AS k, min(frame) AS frame, 0 AS s FROM n UNION ALL SELECT 2, max(frame), 0 FROM n UNION ALL SELECT 1, first, 0 FROM r UNION ALL SELECT 1, last, 1 FROM r),
p AS (SELECT CAST(row_number() OVER (ORDER BY k, frame, s) - 1 AS INTEGER) AS position, frame FROM m)
SELECT position, frame, CAST((position + 1) % 2 AS INTEGER) AS label FROM p""")
def _(spark, d):
    return ordered.shots(E.frames(spark, d), "frame", "value", 0.45, 1.0, 3, momentum=0.2)
