"""Components, reachability, levels, routes and colours of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.plans.materialise import checkpointed, sorted_side


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes with an edge (a, b), by least labels with pointer jumping.

    Each round takes the least label among neighbours, aggregated before it is joined, then the label's own label.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        of_neighbours = both.join(sorted_side(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(sorted_side(of_neighbours), "node").select("node", F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = checkpointed(lower.join(sorted_side(jump), "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        if new.join(sorted_side(labels), ["node", "component"], "left_anti").isEmpty():
            return new
        labels = new


def reachable(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(a, b): every b that a reaches over one edge or more; `start` limits the a's (column a). Cycles end it."""
    found = checkpointed((edges if start is None else edges.join(sorted_side(start), "a", "left_semi")).select("a", "b").distinct())
    front = found
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while not front.isEmpty():
        front = checkpointed(front.join(sorted_side(step), "b").select("a", F.col("c").alias("b")).distinct().join(sorted_side(found), ["a", "b"], "left_anti"))
        found = checkpointed(found.unionByName(front))
    return found


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level), nodes on or behind cycles): the longest path from a node without incoming edges (a before b)."""
    edges = checkpointed(edges.select("a", "b").distinct())
    left = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    done, level = None, 0
    while True:
        waiting = edges.join(sorted_side(left.withColumnRenamed("node", "a")), "a", "left_semi").select(F.col("b").alias("node"))
        ready = checkpointed(left.join(sorted_side(waiting), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return (done if done is not None else ready), left
        done = ready if done is None else done.unionByName(ready)
        left, level = checkpointed(left.join(sorted_side(ready), "node", "left_anti")), level + 1


def recipe_costs(recipes: DataFrame, known: DataFrame) -> DataFrame:
    """(item, cost): new items that the cheapest recipe chain needs, over recipes (x, y, result) and known items (item).

    Rounds relax all recipes against the costs of the round before until none improves.
    """
    recipes = checkpointed(recipes.select("x", "y", "result"))
    costs = checkpointed(known.select("item", F.lit(0).cast("long").alias("cost")))
    while True:
        x, y = costs.select(F.col("item").alias("x"), F.col("cost").alias("cx")), costs.select(F.col("item").alias("y"), F.col("cost").alias("cy"))
        made = recipes.join(sorted_side(x), "x").join(sorted_side(y), "y").select(F.col("result").alias("item"), (1 + F.col("cx") + F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("cy"))).alias("cost"))
        new = checkpointed(costs.unionByName(made).groupBy("item").agg(F.min("cost").alias("cost")))
        if new.join(sorted_side(costs), ["item", "cost"], "left_anti").isEmpty():
            return new
        costs = new


def coloured(edges: DataFrame, slots: int, passes: int = 20) -> dict:
    """Slot by node of a weighted graph (a, b, w): most saturated first, least conflict, then improvement passes.

    A heuristic over polities, thousands at most: their aggregated graph is small by nature and is collected.
    """
    near: dict = {}
    for r in edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")).collect():
        near.setdefault(r["a"], {})[r["b"]] = r["w"]
        near.setdefault(r["b"], {})[r["a"]] = r["w"]
    colour: dict = {}
    conflict = lambda n, c: sum(w for m, w in near[n].items() if colour.get(m) == c)
    best = lambda n: min(range(slots), key=lambda c: (conflict(n, c), c))
    weight = {n: sum(m.values()) for n, m in near.items()}
    while len(colour) < len(near):
        n = min((n for n in near if n not in colour), key=lambda n: (-len({colour[m] for m in near[n] if m in colour}), -weight[n], n))
        colour[n] = best(n)
    for _ in range(passes):
        moved = False
        for n in sorted(near):
            c = best(n)
            if conflict(n, c) < conflict(n, colour[n]):
                colour[n], moved = c, True
        if not moved:
            break
    return colour
