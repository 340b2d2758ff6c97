"""Area specifications: trees of set operations over named areas, stored as rows and folded bottom-up by joins on cells.

Nodes are (tree, node, parent, place, op, kind, codes, pid, year). Leaves are `codes` (the union of named areas of a
kind) and `record` (the area of a record alive in a year); `union` and `intersection` take all children, `difference` takes the
child at place 0 less the others. A node's key is canonical: the order of commutative children does not count, nor do repeats, so equal
subtrees of all trees are evaluated once. Trees with a problem give no area, and every problem is a row.

Defined results: an unknown operation or code, an empty or null list of codes, a record without id or year or that is not alive, an
operation without children, a difference without a base or without anything to take away, a node whose parent is missing, that hangs on a
leaf or on a cycle, and a tree with other than one root are problems; an area may be empty; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.years import overlaps
from spanwright.plans.materialise import checkpointed, sorted_side

SETS = ("union", "intersection", "difference")
#: Operations over one child that a task joins with its cells.
SHARE = 64


def _leaves(nodes: DataFrame, named: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, x, y), (tree, node, key, problem)): areas of the distinct leaves, and each leaf's key or problem."""
    coded = nodes.filter("op = 'codes'").withColumn("codes", F.array_sort(F.array_distinct(F.coalesce("codes", F.array().cast("array<string>")))))
    coded = coded.withColumn("key", F.sha2(F.concat_ws("|", F.lit("codes"), F.coalesce("kind", F.lit("")), F.array_join("codes", ",", "null")), 256))
    asked = coded.select("key", "kind", F.explode("codes").alias("code")).distinct()
    known = named.select("kind", "code").distinct().withColumn("known", F.lit(True))
    unknown = asked.join(known, ["kind", "code"], "left").groupBy("key").agg(F.min(F.when(F.col("known").isNull(), F.coalesce("code", F.lit("null")))).alias("unknown"))
    problem = F.when(F.size("codes") == 0, "no codes").when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown code "), "unknown"))
    by_code = coded.join(unknown, "key", "left").select("tree", "node", "key", problem.alias("problem"))
    areas = asked.join(named, ["kind", "code"]).select("key", "x", "y")

    held = nodes.filter("op = 'record'").withColumn("key", F.sha2(F.concat_ws("|", F.lit("record"), "pid", F.col("year").cast("string")), 256))
    wanted = held.filter("pid IS NOT NULL AND year IS NOT NULL").select("key", "pid", "year").distinct()
    alive = wanted.join(records, "pid").filter(overlaps(F.col("from_year"), F.col("to_year"), F.col("year"), F.col("year"))).select("key", "x", "y").distinct()
    found = alive.select("key").distinct().withColumn("found", F.lit(True))
    problem = F.when(F.col("pid").isNull() | F.col("year").isNull(), "record without id or year").when(F.col("found").isNull(), "no record alive")
    by_record = held.join(found, "key", "left").select("tree", "node", "key", problem.alias("problem"))
    return areas.unionByName(alive).distinct(), by_code.unionByName(by_record)


def _level(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, x, y) of operations (key, op, child, base) over the areas of their children.

    A child that many operations share is dealt to several tasks: its operations by shares of SHARE, its cells to each share.
    """
    shares = checkpointed(edges.groupBy("child").agg(F.ceil(F.count("*") / SHARE).alias("shares")))
    edges = edges.join(sorted_side(shares), "child").withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares"))).drop("shares")
    cells = areas.withColumnRenamed("key", "child").join(sorted_side(shares), "child").select("child", "x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    of = edges.groupBy("key").agg(F.count_distinct("child").alias("children"))
    # a child is at most once in the base and once in the rest of an operation, and cells of a child are distinct
    met = edges.join(sorted_side(cells), ["child", "share"]).groupBy("key", "op", "x", "y").agg(F.count(F.when(~F.col("base"), 1)).alias("n"), F.max("base").alias("in_base"))
    keep = F.when(F.col("op") == "union", True).when(F.col("op") == "intersection", F.col("n") == F.col("children")).otherwise(F.col("in_base") & (F.col("n") == 0))
    return met.join(sorted_side(of), "key").filter(keep).select("key", "x", "y")


def _keyed(nodes: DataFrame, named: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """Areas of leaves, (tree, key) of the trees without a problem, the sound operations by rounds, (tree, node, problem); none needs the areas of operations."""
    nodes = checkpointed(nodes.select("tree", "node", "parent", "place", "op", "kind", "codes", "pid", "year"))
    areas, leaves = _leaves(nodes, named, records)
    done, rounds = checkpointed(leaves), []
    inner = nodes.filter(F.col("op").isin(*SETS)).select("tree", "node", "op")
    child = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.col("node").alias("of"), "place")
    family = checkpointed(inner.join(child, ["tree", "node"], "left"))
    unknown_op = nodes.filter(~F.coalesce(F.col("op").isin("codes", "record", *SETS), F.lit(False))).select("tree", "node", F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null"))).alias("problem"))
    parents = nodes.select("tree", F.col("node").alias("parent"), F.col("op").alias("parent_op"))
    lost = nodes.filter("parent IS NOT NULL").join(parents, ["tree", "parent"], "left").filter(F.col("parent_op").isNull() | F.col("parent_op").isin("codes", "record")).select("tree", "node", F.lit("parent is missing or a leaf").alias("problem"))
    roots = nodes.groupBy("tree").agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("n")).filter("n <> 1").select("tree", F.lit(None).cast("string").alias("node"), F.lit("not one root").alias("problem"))
    while True:
        waiting = family.join(done.select("tree", "node"), ["tree", "node"], "left_anti")
        known = done.select("tree", F.col("node").alias("of"), F.col("key").alias("child"), F.col("problem").alias("below"))
        ready = waiting.join(known.withColumn("seen", F.lit(True)), ["tree", "of"], "left").groupBy("tree", "node", "op").agg(
            F.count("of").alias("children"),
            F.count("seen").alias("seen"),
            F.count("below").alias("below"),
            F.max(F.when(F.col("place") == 0, F.col("child"))).alias("base"),
            F.count(F.when(F.col("place") == 0, 1)).alias("bases"),
            F.array_sort(F.collect_set(F.when((F.col("op") != "difference") | (F.col("place") != 0), F.col("child")))).alias("rest"),
        )
        ready = ready.filter("children = seen")
        parts = F.concat_ws(",", F.when(F.col("op") == "difference", F.col("base")), F.array_join("rest", ","))
        problem = F.when(F.col("children") == 0, "no parts").when((F.col("op") == "difference") & (F.col("bases") != 1), "no base").when((F.col("op") == "difference") & (F.col("children") < 2), "nothing to take away").when(F.col("below") > 0, "problem below")
        level = checkpointed(ready.select("tree", "node", "op", "base", "rest", F.sha2(F.concat_ws("(", "op", parts), 256).alias("key"), problem.alias("problem")))
        if level.isEmpty():
            break
        rounds.append(level.filter("problem IS NULL").dropDuplicates(["key"]).select("key", "op", "base", "rest"))
        done = checkpointed(done.unionByName(level.select("tree", "node", "key", "problem")))
    unresolved = inner.join(done.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit("below or on a cycle, or over a problem").alias("problem"))
    problems = checkpointed(done.filter("problem IS NOT NULL").select("tree", "node", "problem").unionByName(unknown_op).unionByName(lost).unionByName(roots).unionByName(unresolved))
    tops = nodes.filter("parent IS NULL").join(done.filter("problem IS NULL"), ["tree", "node"]).join(problems.select("tree").distinct(), "tree", "left_anti")
    return areas, tops.select("tree", "key"), rounds, problems


def problems(nodes: DataFrame, named: DataFrame, records: DataFrame) -> DataFrame:
    """(tree, node, problem), without the areas."""
    return _keyed(nodes, named, records)[3]


def resolved(nodes: DataFrame, named: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tree, x, y) of the trees without a problem, (tree, node, problem)).

    `named` is (kind, code, x, y); `records` is (pid, from_year, to_year, x, y). A round takes the nodes whose children are known.
    """
    areas, tops, rounds, wrong = _keyed(nodes, named, records)
    areas = checkpointed(areas)
    for sound in rounds:
        fresh = checkpointed(sound.join(sorted_side(areas.select("key").distinct()), "key", "left_anti"))
        edges = fresh.select("key", "op", F.explode("rest").alias("child"), F.lit(False).alias("base")).unionByName(fresh.filter("op = 'difference'").select("key", "op", F.col("base").alias("child"), F.lit(True).alias("base")))
        areas = areas.unionByName(checkpointed(_level(edges, areas)))
    return tops.join(sorted_side(areas), "key").select("tree", "x", "y"), wrong
