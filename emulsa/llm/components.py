"""Connected components of links between texts, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, written

#: Links from which a step looks for centres that have many of them: fewer fit a task whole.
MANY = 500_000


def components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """a, b: each node that has an edge and is not the smallest of its component, and that smallest node.

    The driver sees two numbers a step. A node with a large share of all edges is joined by broadcast, so that no task gets them all.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    flip = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    now, last = edges, None
    is_now = mark(now)
    while is_now[0] and is_now != last:
        meet = (lambda left, right: join_split(left, right, "a")) if is_now[0] >= many else (lambda left, right: left.join(right, "a"))
        both = now.union(flip(now))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = meet(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = written(large, "star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = meet(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        now, last = written(small, "star"), is_now
        is_now = mark(now)
    return now


def component_ids(rows: DataFrame, classes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """rows (a written table) with component_id: the smallest doc_id that the edges (a, b: nodes) reach from the row's node.

    classes: node and doc_id, the smallest of the rows with the node. Large components and nodes of many rows are split.
    """
    stars = components(edges).select(F.col("a").alias(node), F.col("b").alias("root"))
    # Nodes of a component with the smallest doc_id of each: roots are nodes too.
    nodes = written(stars.union(stars.select("root", "root").distinct()).join(classes, node).select(node, "root", "doc_id"), "component-nodes")
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(join_split(nodes, least, "root").select(node, "component_id", F.lit(True).alias("linked")), "components")
    by_node = classes.join(named, node, "left").select(node, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return join_split(rows, by_node, node, "left")
