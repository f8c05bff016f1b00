"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

Trust spreads from hosts that rules mostly allow along host edges (personalised PageRank);
distrust spreads from hosts that rules mostly block against them, so a host that links to
blocked ones is distrusted. A host whose share of distrust exceeds the threshold is blocked.
Only DataFrame functions are used; the state of an iteration is one row a host and side.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed
unless a rule for the empty host exists; a null page is judged like any other and has no links;
rows that share an id, or have none, are judged each on its own; a page of any length is searched
whole; an empty table gives no rows; of rules equally long, the first by name wins; only the key,
the url and the page are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
DAMPING, ITERATIONS, THRESHOLD, SALTS = 0.85, 10, 0.5, 16
#: Scores are settled once a step reaches no new host and changes none by more than this share of it.
TOLERANCE = 1e-6


def lower(c: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(c, UPPER, LOWER)


def split(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it has none."""
    return F.coalesce(lower(F.regexp_extract(url, URL, 1)), F.lit("")), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as a table: ``rule, verdict``."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])
    return spark.range(1).select(F.inline(rows))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules of each host's domains, the longest first, for hosts that have any."""
    split_rule = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("domain"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"))
    each = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(split_rule, "domain")
    listed = F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "verdict", "prefix")))
    return each.groupBy("host").agg(listed.alias("rules"))


def by_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Left join of pages and one row a host, salted: a host may have a third of all pages."""
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page", "path"), F.lit(SALTS)).cast("int"))
    told = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(told, ["host", "salt"], "left").drop("salt")


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int | None = ITERATIONS) -> DataFrame:
    """``side, host, score`` after personalised PageRank. ``edges``: side, src, dst, w; ``seeds``: side, host, share,
    summing to 1 on each side. What reaches a host without edges goes back to the seeds. ``iterations`` None: until the scores
    are settled, which they come to be, as what is unsettled shrinks by ``damping`` each step."""
    out = edges.groupBy("side", "src").agg(F.sum("w").alias("out"))
    step = shared.written(edges.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("w") / F.col("out")).alias("part")), "steps")
    score = seeds.select("side", "host", F.col("share").alias("score"))
    if step.isEmpty():
        return score
    for i in itertools.count() if iterations is None else range(iterations):
        last = score
        moved = step.join(score.withColumnRenamed("host", "src"), ["side", "src"]).groupBy("side", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        kept = moved.groupBy("side").agg(F.sum("got").alias("total"))
        back = seeds.join(kept, "side", "left").select("side", "host", (F.col("share") * (1 - damping * F.coalesce("total", F.lit(0.0)))).alias("score"))
        score = moved.select("side", "host", (damping * F.col("got")).alias("score")).unionByName(back).groupBy("side", "host").agg(F.sum("score").alias("score"))
        score = shared.written(score, "scores")
        settled = iterations is None and _settled(last, score)
        shared.forget(last)
        if settled:
            break
    return score


def _settled(last: DataFrame, score: DataFrame) -> bool:
    """Whether every score is what it was before, within the tolerance; hosts once reached stay reached."""
    both = score.join(last.withColumnRenamed("score", "last"), ["side", "host"], "left")
    return both.where(F.col("last").isNull() | (F.abs(F.col("score") - F.col("last")) > TOLERANCE * F.col("score"))).isEmpty()


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``page, host, path, rule, verdict, distrust`` of every row."""
    host, path = split(F.col(url))
    src = pages.select(F.col(key).alias("page"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    links = src.select("host", F.explode(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower)).alias("to"))
    edges = links.where("host != '' and host != to").groupBy("host", "to").agg(F.count("*").cast("double").alias("w"))
    urls = src.drop("html")
    told = fitting(urls.select("host").distinct(), rules)
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(1))
    ruled = by_host(urls, told).withColumn("first", first)
    ruled = ruled.select("page", "host", "path", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("by_rule"))
    counted = ruled.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allow"), F.count_if(F.col("by_rule") == "block").alias("block"))
    sides = F.explode(F.array(F.struct(F.lit("trust").alias("side"), (2 * F.col("allow") > F.col("n")).alias("seed")), F.struct(F.lit("distrust").alias("side"), (2 * F.col("block") > F.col("n")).alias("seed"))))
    seeds = counted.select("host", sides.alias("s")).where("s.seed").select("s.side", "host")
    total = seeds.groupBy("side").agg(F.count("*").alias("of"))
    seeds = shared.written(seeds.join(total, "side").select("side", "host", (1 / F.col("of")).alias("share")), "seeds")
    both = edges.select(F.lit("trust").alias("side"), F.col("host").alias("src"), F.col("to").alias("dst"), "w").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("to").alias("src"), F.col("host").alias("dst"), "w"))
    score = propagated(both, seeds, iterations=None).groupBy("host").agg(F.sum(F.when(F.col("side") == "trust", F.col("score"))).alias("t"), F.sum(F.when(F.col("side") == "distrust", F.col("score"))).alias("d"))
    share = F.coalesce("d", F.lit(0.0)) / (F.coalesce("t", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)))
    bad = score.where("coalesce(t, 0) + coalesce(d, 0) > 0").select("host", share.alias("distrust")).where(F.col("distrust") > threshold)
    out = by_host(ruled, bad)
    return out.select("page", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("distrust").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judged(pages, rule_table(spark)).withColumnRenamed("page", "page_id")
