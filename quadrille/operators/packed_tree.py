"""A packed tree of boxes: bulk loading by sort-tile-recursion, search by levels, overlap of siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import ranked

BOX = ("x1", "y1", "x2", "y2")


class Tree:
    """Nodes (level, node, parent, n, box) from 0, the leaves, up to one root; items (leaf, id, box)."""

    def __init__(self, nodes: DataFrame, items: DataFrame, levels: int, capacity: int):
        self.nodes, self.items, self.levels, self.capacity = nodes, items, levels, capacity


def load(boxes: DataFrame, capacity: int = 16) -> Tree:
    """A tree over boxes (id, x1, y1, x2, y2): sorted by their middles into vertical strips, in these from top to bottom, and cut
    into leaves of `capacity`; higher nodes take as many that follow each other.

    Two orders of all boxes, each in ranges; no strip or node is gathered. ids should be distinct.
    """
    rows = boxes.select("id", *BOX)
    n = rows.count()
    leaves = max(1, -(-n // capacity))
    strips = max(1, int((leaves - 1) ** 0.5) + 1 if leaves > 1 else 1)
    by_x = ranked(rows.withColumn("_mx", F.col("x1") + F.col("x2")), "_mx", "id", name="_rank")
    stripped = by_x.select("id", *BOX, F.expr(f"_rank div {strips * capacity}").alias("_strip"), (F.col("y1") + F.col("y2")).alias("_my"))
    items = ranked(stripped, "_strip", "_my", "id", name="_rank").select(F.expr(f"_rank div {capacity}").alias("leaf"), "id", *BOX)
    levels, width = 1, leaves
    while width > 1:
        levels, width = levels + 1, -(-width // capacity)
    spans = F.posexplode(F.array(*(F.lit(capacity**k).cast("bigint") for k in range(levels))))
    # an item is in one node of each level: aggregated where it is, before anything is shuffled
    own = items.select(*BOX, "leaf", spans.alias("level", "_span")).withColumn("node", F.expr("leaf div _span"))
    box = (F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    nodes = own.groupBy("level", "node").agg(F.count("*").alias("n"), *box).withColumn("parent", F.expr(f"node div {capacity}"))
    return Tree(nodes.select("level", "node", "parent", "n", *BOX), items, levels, capacity)


def meets(a: str, b: str) -> Column:
    """Whether two boxes have a point in common, their borders too."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x1") <= c(b, "x2")) & (c(b, "x1") <= c(a, "x2")) & (c(a, "y1") <= c(b, "y2")) & (c(b, "y1") <= c(a, "y2"))


def search(tree: Tree, windows: DataFrame) -> DataFrame:
    """(q, id) of the items that meet windows (q, x1, y1, x2, y2), borders too.

    All windows go down together, a join with the next level on the parent's number at a time; branches that a window
    doesn't meet are left at once. Joins are shuffled on the node: windows of a small file would
    otherwise stay in the few tasks that read it, with all that they find.
    """
    w = windows.select("q", *BOX).repartition("q")
    level = lambda k: tree.nodes.filter(F.col("level") == k)
    root = level(tree.levels - 1).select(F.col("node").alias("_root"), *(F.col(c).alias(f"_{c}") for c in BOX))
    hit = (F.col("x1") <= F.col("_x2")) & (F.col("_x1") <= F.col("x2")) & (F.col("y1") <= F.col("_y2")) & (F.col("_y1") <= F.col("y2"))
    found = w.join(F.broadcast(root), hit).select("q", *BOX, F.col("_root").alias("node"))  # one row
    for k in range(tree.levels - 2, -1, -1):
        a, b = found.alias("a"), level(k).hint("merge").alias("b")
        found = a.join(b, (F.col("a.node") == F.col("b.parent")) & meets("a", "b")).select("a.q", *(f"a.{c}" for c in BOX), "b.node")
    a, b = found.alias("a"), tree.items.hint("merge").alias("b")
    return a.join(b, (F.col("a.node") == F.col("b.leaf")) & meets("a", "b")).select("a.q", "b.id")


def sibling_overlap(tree: Tree) -> DataFrame:
    """(level, nodes, overlap): nodes of each level, and the area that pairs of siblings share; less is better.

    A node has at most the others of its parent as partners.
    """
    a, b = tree.nodes.alias("a"), tree.nodes.alias("b")
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda n: F.greatest(F.lit(0), F.least(c("a", f"{n}2"), c("b", f"{n}2")) - F.greatest(c("a", f"{n}1"), c("b", f"{n}1")))
    pairs = a.join(b, (c("a", "level") == c("b", "level")) & (c("a", "parent") == c("b", "parent")) & (c("a", "node") < c("b", "node")))
    shared = pairs.groupBy(c("a", "level").alias("level")).agg(F.sum(side("x") * side("y")).alias("overlap"))
    sizes = tree.nodes.groupBy("level").agg(F.count("*").alias("nodes"))
    return sizes.join(shared, "level", "left").select("level", "nodes", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def write(tree: Tree, path: str) -> None:
    """The tree below a folder: nodes by level, items ordered by leaf so that a leaf is in few row groups."""
    tree.nodes.repartition("level").sortWithinPartitions("level", "node").write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    tree.items.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{path}/items")


def read(spark: SparkSession, path: str, capacity: int = 16) -> Tree:
    nodes = spark.read.parquet(f"{path}/nodes")
    top = nodes.agg(F.max("level")).first()[0]
    return Tree(nodes.select("level", "node", "parent", "n", *BOX), spark.read.parquet(f"{path}/items"), (top or 0) + 1, capacity)
