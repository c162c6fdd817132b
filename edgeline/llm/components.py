"""Connected components of a table of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any sortable type -> (node, root): root is the smallest node of the component.

    Each round hooks every node to the smallest of itself and its neighbours
    and replaces links by links between hooks; a node that is not the smallest
    among its neighbours goes, so at least one end of every link does. Rounds
    end when no link joins different nodes. Minima are pre-aggregated by map
    tasks, so a node with very many links is no hot key. Links to itself and
    null ends are ignored.
    """
    links = links.select("a", "b").where("a != b").distinct()
    roots, left = None, keep(links, "links")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = keep(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("hook")), "hooks")
        step = hooks.withColumnRenamed("a", "node")
        if roots is None:
            roots = step.select("node", F.col("hook").alias("root"))
        else:
            moved = roots.join(step.withColumnRenamed("node", "root"), "root", "left")
            fresh = step.join(roots.select("node"), "node", "left_anti").select("node", F.col("hook").alias("root"))
            roots = keep(
                moved.select("node", F.coalesce("hook", "root").alias("root")).union(fresh), "roots"
            )
        p, q = hooks.toDF("a", "pa"), hooks.toDF("b", "pb")
        left = keep(
            left.join(p, "a").join(q, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a != b").distinct(),
            "links",
        )
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
