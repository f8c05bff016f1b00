"""Segment hierarchies: clean-up by names, sibling links, union-find as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import has_keyword, midpoint
from ..storage import written
from .components import connected_components


def hierarchy_relabel(segments: DataFrame, bad: list[str] = ("bad", "del"), keep: list[str] = ("merge",), id: str = "nr", parent: str = "parentnr", name: str = "name", resurrect: bool = False) -> DataFrame:
    """``id, new``: segments with a bad word in their name, and their direct children, become 0; others are merged into their
    parents, up to the root, except below parents whose name has a word of ``keep`` or is the background. With ``resurrect``,
    a bad child of a good parent is merged instead of deleted.

    Chains are followed by pointer doubling: the number of joins is the logarithm of the longest chain. Segments that are
    their own ancestors raise ValueError with one of their ids."""
    seg = segments.select(F.col(id).cast("long").alias("id"), F.col(parent).cast("long").alias("p"), has_keyword(name, list(bad)).alias("bad"), has_keyword(name, [*keep, "background"]).alias("stop"))
    over = seg.select(F.col("id").alias("p"), F.col("bad").alias("p_bad"), F.col("stop").alias("p_stop"))
    both = seg.join(over, "p", "left").withColumns({"p_bad": F.coalesce("p_bad", F.lit(False)), "p_stop": F.coalesce("p_stop", F.col("p") == 0)})
    merges = ~F.col("p_bad") & ~F.col("p_stop")
    gone = F.col("bad") | F.col("p_bad")
    to = F.when(merges, F.col("p")).when(gone, 0).otherwise(F.col("id")) if resurrect else F.when(gone, 0).when(merges, F.col("p")).otherwise(F.col("id"))
    first = now = written(both.select("id", to.cast("long").alias("new")), "chains")
    # whoever stands for others must stand for itself; on a cycle nobody does, or nobody comes to rest
    moving = first.where("new != id and new != 0").select(F.col("id").alias("new"))
    rounds = now.count().bit_length() + 1
    while True:
        on = now.select(F.col("id").alias("new"), F.col("new").alias("_next"))
        step = written(now.join(on, "new", "left").select("id", "new", F.coalesce("_next", "new").alias("_next")), "chains")
        moved = step.where("new != _next").first()
        now = step.select("id", F.col("_next").alias("new"))
        rounds -= 1
        caught = now.join(moving, "new", "left_semi").first() if moved is None else moved if rounds < 0 else None
        if caught is not None:
            raise ValueError(f"segment {caught['id']} is below a cycle of parents")
        if moved is None:
            return now


def rewired(tree: DataFrame, mapping: DataFrame) -> DataFrame:
    """A tree (``nr, parentnr, childnr, prevnr, nextnr`` and more) whose merged segments become children. ``mapping``: id, new. Segments with
    the same ``new`` are linked below it in order of their number; the others keep their level and skip them."""
    told = tree.join(mapping.where("id != new").select(F.col("id").alias("nr"), F.col("new").alias("_new")), "nr", "left")
    # links of a level are drawn anew among those that stay in it; children form levels of their own
    level = Window.partitionBy(F.coalesce("_new", "parentnr"), F.col("_new").isNotNull()).orderBy("nr")
    told = told.withColumns({"_prev": F.lag("nr", 1, 0).over(level), "_next": F.lead("nr", 1, 0).over(level)})
    first = told.where("_new is not null").groupBy(F.col("_new").alias("nr")).agg(F.min("nr").alias("_child"))
    stays = told.where("_new is null").groupBy(F.col("parentnr").alias("nr")).agg(F.min("nr").alias("_first"))
    both = told.join(first, "nr", "left").join(stays, "nr", "left")
    new = {"parentnr": F.coalesce("_new", "parentnr"), "childnr": F.coalesce("_child", F.when(F.col("childnr") != 0, F.coalesce("_first", F.lit(0))), "childnr"), "prevnr": F.col("_prev"), "nextnr": F.col("_next")}
    return both.select(*[(new[c].cast("long") if c in new else F.col(c)).alias(c) for c in tree.columns])


def sibling_tree(boxes: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Two levels: groups, numbered above all labels in order of their name, and labels linked inside their group.
    ``nr, name, parentnr, childnr, prevnr, nextnr`` and anchors; a colour follows from the number."""
    top = boxes.agg(F.max(label).alias("_m"))
    groups = boxes.groupBy(group).agg(F.min(label).alias("_first"))
    # one row a group
    order = Window.orderBy(group)
    groups = groups.crossJoin(F.broadcast(top)).select(group, "_first", (F.row_number().over(order) + F.col("_m")).cast("long").alias("_nr"))
    inner = Window.partitionBy(group).orderBy(label)
    leaf = boxes.select("*", F.lag(label, 1, 0).over(inner).alias("prevnr"), F.lead(label, 1, 0).over(inner).alias("nextnr")).join(groups, group)
    anchor = [midpoint(f"{a}min", f"{a}max").alias(f"anchor{a}") for a in "xyz"] if "xmin" in boxes.columns else [F.lit(-1).cast("long").alias(f"anchor{a}") for a in "xyz"]
    leaves = leaf.select(F.col(label).cast("long").alias("nr"), F.concat(F.lit("seg"), F.col(label)).alias("name"), F.col("_nr").alias("parentnr"), F.lit(0).cast("long").alias("childnr"), F.col("prevnr").cast("long"), F.col("nextnr").cast("long"), *anchor)
    none = [F.lit(-1).cast("long").alias(f"anchor{a}") for a in "xyz"]
    by = Window.orderBy("_nr")
    tops = groups.select(F.col("_nr").alias("nr"), F.col(group).cast("string").alias("name"), F.lit(0).cast("long").alias("parentnr"), F.col("_first").cast("long").alias("childnr"), F.lag("_nr", 1, 0).over(by).alias("prevnr"), F.lead("_nr", 1, 0).over(by).alias("nextnr"), *none)
    return leaves.unionByName(tops)


class Sets:
    """Disjoint sets as tables: elements, and pairs that belong together. Nothing runs until components are asked for."""

    def __init__(self, elements: DataFrame, pairs: DataFrame | None = None):
        self.elements = elements.select(F.col(elements.columns[0]).alias("id")).distinct()
        self.pairs = pairs.select(F.col(pairs.columns[0]).alias("a"), F.col(pairs.columns[1]).alias("b")) if pairs is not None else self.elements.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        self._found: DataFrame | None = None

    def add(self, elements: DataFrame) -> "Sets":
        return Sets(self.elements.union(elements.select(F.col(elements.columns[0]).alias("id"))), self.pairs)

    def union(self, pairs: DataFrame) -> "Sets":
        """Merges pairs; their elements are added."""
        pairs = pairs.select(F.col(pairs.columns[0]).alias("a"), F.col(pairs.columns[1]).alias("b"))
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        return Sets(self.elements.union(ends), self.pairs.union(pairs))

    def mapping(self) -> DataFrame:
        """``id, component``: the least member of each element's set."""
        if self._found is None:
            found = connected_components(self.pairs)
            self._found = self.elements.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        return self._found

    def find(self, id) -> object:
        """The least member of an element's set; an unknown element is an error."""
        row = self.mapping().where(F.col("id") == id).first()
        if row is None:
            raise ValueError(f"{id} is not an element")
        return row["component"]

    def connected(self, a, b) -> bool:
        return self.find(a) == self.find(b)

    def __getitem__(self, id):
        return self.find(id)

    def __contains__(self, id) -> bool:
        return not self.elements.where(F.col("id") == id).isEmpty()

    def __iter__(self):
        """Elements, without gathering them."""
        return (r["id"] for r in self.elements.toLocalIterator())

    def found(self, ids: DataFrame) -> DataFrame:
        """``find`` of a whole table: ``id, component``; an unknown element is an error."""
        known = ids.select(F.col(ids.columns[0]).alias("id")).join(self.mapping(), "id", "left")
        unknown = F.raise_error(F.concat(F.col("id").cast("string"), F.lit(" is not an element")))
        return known.select("id", F.coalesce("component", unknown.cast(known.schema["component"].dataType)).alias("component"))

    def tied(self, pairs: DataFrame) -> DataFrame:
        """``connected`` of a whole table of pairs: ``a, b, connected``; a pair with an unknown element is not."""
        a, b = (F.col(c) for c in pairs.columns[:2])
        left, right = (self.mapping().select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
        both = pairs.select(a.alias("a"), b.alias("b")).join(left, "a", "left").join(right, "b", "left")
        return both.select("a", "b", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("connected"))

    def component(self, id) -> DataFrame:
        """Members of an element's set."""
        return self.mapping().where(F.col("component") == self.find(id)).select("id")

    def components(self) -> DataFrame:
        """Each set once, with its size: ``component, members``."""
        return self.mapping().groupBy("component").agg(F.count("*").alias("members"))

    def contains(self, ids: DataFrame) -> DataFrame:
        key = ids.columns[0]
        return ids.join(self.elements.withColumnRenamed("id", key), key, "left_semi")

    def relabel(self) -> DataFrame:
        """``id, new`` for 0 to the largest element: the least member of its set, or itself for what is no element. One row an id
        up to the largest, which suits dense ids; for sparse ones ``mapping`` has the elements only."""
        spark = self.elements.sparkSession
        top = self.elements.agg(F.max("id")).first()[0]
        return spark.range((top if top is not None else -1) + 1).join(self.mapping(), "id", "left").select("id", F.coalesce("component", "id").alias("new"))

    def __len__(self) -> int:
        return self.elements.count()

    @property
    def n_components(self) -> int:
        return self.components().count()
