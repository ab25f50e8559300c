"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.plans.scratch import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50, told: list | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    `edges` has two columns of one orderable type, self-loops and repeats allowed; nulls are dropped. Alternates the
    large-star and small-star steps until the edge set stops changing: O(log^2 n) rounds, each a partially aggregated
    minimum and an equi-join (hot nodes are split by AQE), with lineage cut in the shared folder every round.
    Isolated nodes have no row: they are their own component. `told` gets the number of edges of each round.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().filter("a <> b").distinct()
    now = materialize(now, "edges")
    last = None
    for _ in range(max_rounds):
        new = materialize(_small_star(_large_star(now)), "edges")
        drop(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told is not None:
            told.append(state[0])
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def update_components(known: DataFrame, edges: DataFrame, max_rounds: int = 50, told: list | None = None) -> DataFrame:
    """(node, component) of a former result (the same columns) after more edges, as connected_components() of all would give.

    Ends of new edges are replaced by the roots of what is known, so the rounds run over as many edges as are new, however
    large the graph is. What they join is one join with the known rows; nodes of untouched components keep their rows. A
    node that is known twice must have one component; a null end drops its edge.
    """
    a, b = edges.columns
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    root = known.select("node", "component")
    new = ends.select("a").union(ends.select("b")).toDF("node").distinct().join(root, "node", "left")
    new = materialize(new.select("node", F.coalesce("component", "node").alias("root")), "ends")
    contracted = ends.join(new.toDF("a", "x"), "a").join(new.toDF("b", "y"), "b").select("x", "y")
    merged = materialize(connected_components(contracted, max_rounds, told).toDF("root", "component"), "merged")
    moved = root.join(merged.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # self-loops name nodes too, but connect nothing
    fresh = new.join(root.select("node"), "node", "left_anti").join(merged, "root").select("node", "component")
    return moved.unionByName(fresh)
