"""The tables as volumes: how lineitem, embeddings, events and others stand for voxels, frames and graphs,
in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, d) -> DataFrame:
    """Two labelings of lineitem rows: gt, seg at z, y, x (places repeat)."""
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 7).alias("gt"), (F.col("l_suppkey") % 5).alias("seg"), F.col("l_linenumber").cast("int").alias("z"), F.month("l_shipdate").alias("y"), F.floor("l_quantity").cast("int").alias("x")
    )


LINES = "SELECT CAST(l_partkey % 7 AS BIGINT) AS gt, CAST(l_suppkey % 5 AS BIGINT) AS seg, CAST(l_linenumber AS INTEGER) AS z, CAST(month(l_shipdate) AS INTEGER) AS y, CAST(floor(l_quantity) AS INTEGER) AS x FROM lineitem"


def image(spark, d) -> DataFrame:
    """Embeddings as one image: y = vector, x = component."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "value")).select("y", "x", F.col("value").cast("double").alias("value"))


IMAGE = "SELECT CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)"


def grid(spark, d) -> DataFrame:
    """Embeddings as a dense volume: 20 vectors a slice, 32 block labels with holes."""
    v = F.when(F.col("value") > 0, 1 + F.floor(F.col("x") / 8) + 8 * F.floor((F.col("y") % 20) / 5)).otherwise(0)
    return image(spark, d).select(F.floor(F.col("y") / 20).cast("int").alias("z"), (F.col("y") % 20).cast("int").alias("y"), "x", v.cast("long").alias("label"), "value")


GRID = f"SELECT CAST(y // 20 AS INTEGER) AS z, CAST(y % 20 AS INTEGER) AS y, x, CASE WHEN value > 0 THEN CAST(1 + x // 8 + 8 * ((y % 20) // 5) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS label, value FROM ({IMAGE})"


def blanked(spark, d) -> DataFrame:
    """The same volume with every seventh slice blank."""
    return grid(spark, d).withColumn("label", F.when(F.col("z") % 7 == 3, F.lit(0)).otherwise(F.col("label")).cast("long"))


BLANKED = f"SELECT z, y, x, CASE WHEN z % 7 = 3 THEN CAST(0 AS BIGINT) ELSE label END AS label FROM ({GRID})"


def depth(spark, d) -> int:
    """Number of slices of ``grid``."""
    top = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return int(top) // 20 + 1


def frames(spark, d) -> DataFrame:
    """Events an hour: frame 0 is the first hour; hours without events have 0."""
    hour = table(spark, d, "events").groupBy(F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("h")).agg(F.count("*").alias("n"))
    ends = hour.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    every = ends.select("a", F.explode(F.sequence("a", "b")).alias("h"))
    return every.join(hour, "h", "left").select((F.col("h") - F.col("a")).cast("long").alias("frame"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))


FRAMES = """SELECT CAST(h.h - a AS BIGINT) AS frame, CAST(coalesce(n, 0) AS DOUBLE) AS value
FROM (SELECT unnest(generate_series(a, b)) AS h, a FROM (SELECT min(h) AS a, max(h) AS b FROM (SELECT epoch_us(ts) // 3600000000 AS h FROM events))) h
LEFT JOIN (SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1) c ON c.h = h.h"""


def points(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as skeletons: lines in order of their number are nodes, neighbours in that order are edges."""
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    node = (F.row_number().over(by) - 1).cast("long")
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("skeleton_id"), node.alias("node"), F.col("l_linenumber").cast("double").alias("z"), F.month("l_shipdate").cast("double").alias("y"), F.col("l_quantity").alias("x"))
    edges = nodes.where("node > 0").select("skeleton_id", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
    return nodes, edges


POINTS = "SELECT l_orderkey AS skeleton_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS BIGINT) AS node, CAST(l_linenumber AS DOUBLE) AS z, CAST(month(l_shipdate) AS DOUBLE) AS y, l_quantity AS x FROM lineitem"
