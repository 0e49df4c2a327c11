"""Connected components over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.operators.staging import remove, staged, written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), as (node, component): the smallest node reachable.

    Each round hooks every component to its smallest neighbour, jumps to the roots and contracts the edges, over staged
    tables. Such hooks close no cycle but those of two components, of which the smaller becomes the root, so every
    component that still has an edge merges and their number halves at least: log2(nodes) rounds on any graph, each with
    log2(depth) jumps. Nodes without an edge are absent. Only whether rows changed or are left reaches the driver.
    """
    spark = edges.sparkSession
    twice = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both, both_at = written(twice.distinct())
    rows = both.count()  # no later table has more
    label, label_at = None, None
    while True:
        near, near_at = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), rows=rows)
        back = near.select(F.col("node").alias("up"), F.col("up").alias("back"))
        own = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
        tree, tree_at = written(near.join(back, "up").select("node", F.when(own, F.col("node")).otherwise(F.col("up")).alias("root")), rows=rows)
        remove(spark, near_at)
        changed = True
        while changed:
            jump = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new, new_at = written(tree.select("node", "root").join(jump, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), rows=rows)
            changed = new.where("old <> root").limit(1).count()
            remove(spark, tree_at)
            tree, tree_at = new.select("node", "root"), new_at
        if label is None:
            label, label_at = written(tree, rows=rows)
        else:
            jump = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved, moved_at = written(label.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root")), rows=rows)
            remove(spark, label_at)
            label, label_at = moved, moved_at
        ends = [tree.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b")]
        less, less_at = written(both.join(ends[0], "a").join(ends[1], "b").where("r_a <> r_b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct(), rows=rows)
        remove(spark, both_at, tree_at)
        both, both_at = less, less_at
        if not both.limit(1).count():
            break
    low = label.groupBy("root").agg(F.min("node").alias("component"))
    out = staged(label.join(low, "root").select("node", "component"), rows=rows)
    remove(spark, both_at, label_at)
    return out
