"""Connected groups by a spanning forest.

Method: Boruvka-style contraction. In each round every component picks its smallest edge; the picked edges join the forest, which
is a written table; components are contracted along them by pointer jumping, and parallel edges collapse to the smallest. Each
round at least halves the components that still have edges. Every step is a combining aggregation or a join to a table that is
unique in the key, with hot components (after some rounds most nodes carry one root) salted; the driver sees counts only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.runtime import join_unique, scratch_path, write_table


def spanning_forest(edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of an undirected graph. edges: (u, v, w) of one orderable node type and a weight; loops and nulls are ignored.

    forest: (u, v, w) of a minimum spanning forest, ties broken by (u, v). labels: (node, root) for every node that has an edge;
    root is some node of its component. Both are written, to `path`/edges and `path`/roots, which must not exist yet and stay with the
    caller; without a path to the shared folder, until the application ends. An empty graph gives empty tables."""
    path = path or scratch_path(edges.sparkSession, "forest")
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w"))
    live = write_table(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"), "forest-edges")
    labels, forest, nodes = None, [], 0
    while n := live.count():
        nodes = nodes or 2 * n  # no node table has more rows
        ends = live.select(F.col("a").alias("c"), F.col("b").alias("to"), "w", "u", "v").unionByName(live.select(F.col("b").alias("c"), F.col("a").alias("to"), "w", "u", "v"))
        best = ends.groupBy("c").agg(F.min(F.struct("w", "u", "v", "to")).alias("e")).select("c", "e.to", "e.u", "e.v", "e.w")
        best = write_table(best, "forest-best")
        forest.append(best.select("u", "v", "w").distinct())
        # two components that chose each other are the only cycles; the smaller one becomes the root
        other = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = join_unique(best.select("c", "to"), other, "to", most=2 * n).select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        up = write_table(up, "forest-up")
        while True:
            above = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            new = write_table(join_unique(up, above, "p", most=2 * n).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "forest-up")
            up = new.select("c", "p")
            if new.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("c").alias("node"), F.col("p").alias("root"))
        else:
            step = up.select(F.col("c").alias("root"), "p")
            labels = write_table(join_unique(labels, step, "root", how="left", most=nodes).select("node", F.coalesce("p", "root").alias("root")), "forest-labels")
        moved = join_unique(live, up.select(F.col("c").alias("a"), F.col("p").alias("na")), "a", most=n)
        moved = join_unique(moved, up.select(F.col("c").alias("b"), F.col("p").alias("nb")), "b", most=n).where("na <> nb")
        moved = moved.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("a", "b", "e.w", "e.u", "e.v")
        live = write_table(moved, "forest-edges")
    if labels is None:
        forest, labels = [edges], edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return write_table(reduce(DataFrame.unionByName, forest), "", f"{path}/edges"), write_table(labels, "", f"{path}/roots")
