"""Giving unowned land to owners by rules: majority islands, chains of small islands, pockets and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.spatial import raster_components
from spanwright.plans.materialise import checkpointed

#: The four neighbours of a cell.
FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _moved(cells: DataFrame, steps) -> DataFrame:
    """A row for each cell and step, at the place that the step leads to, with the squared length d2 of the step."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("s")
    rest = [c for c in cells.columns if c not in ("x", "y")]
    return cells.select("x", "y", *rest, step).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), *rest, (F.col("s.dx") * F.col("s.dx") + F.col("s.dy") * F.col("s.dy")).alias("d2"))


def _disc(reach: float) -> list[tuple[int, int]]:
    n = int(reach)
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if 0 < dx * dx + dy * dy <= reach * reach]


def settled(land: DataFrame, owned: DataFrame, near: int = 3, ratio: int = 2, share: float = 0.5, gap: int = 1) -> DataFrame:
    """(x, y, island, owner, rule, round) of each land cell (x, y), from owned ones (x, y, owner), one owner a cell.

    In this order: `claim`, owned as given; `majority`, the free cells of an island of which one owner holds more than `share`; `island`,
    an island without owner goes to the nearest owner within `near` cells, unless another one is less than `ratio` times as far. All
    islands of a round are decided together and count as owned in the next, so that chains of islands follow; rounds end when no island is won. `pocket`,
    four-connected free cells with one owner around them; `gap`, free cells within `gap` of an owned one of their island, the nearest, then
    the least owner; the rest is `unclaimed`. Only what a round has won is measured in the next. Owned cells off the land are left out;
    rows that repeat count once.
    """
    island = checkpointed(raster_components(land).withColumnRenamed("component", "island"))
    held = checkpointed(island.join(owned.groupBy("x", "y").agg(F.min("owner").alias("owner")), ["x", "y"]).select("x", "y", "island", "owner"))
    done = held.withColumn("rule", F.lit("claim")).withColumn("round", F.lit(0))

    size = island.groupBy("island").agg(F.count("*").alias("cells"))
    by_owner = held.groupBy("island", "owner").agg(F.count("*").alias("n")).groupBy("island").agg(F.max(F.struct("n", "owner")).alias("top"))
    major = by_owner.join(size, "island").filter(F.col("top.n") > share * F.col("cells")).select("island", F.col("top.owner").alias("owner"))
    free = island.join(held.select("x", "y"), ["x", "y"], "left_anti")
    more = free.join(major, "island").select("x", "y", "island", "owner", F.lit("majority").alias("rule"), F.lit(0).alias("round"))
    done = checkpointed(done.unionByName(more))

    waiting = checkpointed(island.join(held.select("island").distinct(), "island", "left_anti"))
    new, distances, k = done.select("x", "y", "owner"), None, 0
    disc = _disc(near * ratio)
    while not waiting.isEmpty():
        k += 1
        seen = _moved(new, disc).join(waiting, ["x", "y"]).groupBy("island", "owner").agg(F.min("d2").alias("d2"))
        distances = seen if distances is None else distances.unionByName(seen).groupBy("island", "owner").agg(F.min("d2").alias("d2"))
        distances = checkpointed(distances.join(waiting.select("island").distinct(), "island", "left_semi"))
        first = distances.groupBy("island").agg(F.min(F.struct("d2", "owner")).alias("a"))
        second = distances.join(first, "island").filter(F.col("owner") != F.col("a.owner")).groupBy("island").agg(F.min("d2").alias("other"))
        clear = F.col("other").isNull() | (F.col("other") >= ratio * ratio * F.col("a.d2"))
        winners = first.join(second, "island", "left").filter((F.col("a.d2") <= near * near) & clear).select("island", F.col("a.owner").alias("owner"))
        won = checkpointed(waiting.join(winners, "island").select("x", "y", "island", "owner", F.lit("island").alias("rule"), F.lit(k).alias("round")))
        if won.isEmpty():
            break
        done = checkpointed(done.unionByName(won))
        new, waiting = won.select("x", "y", "owner"), checkpointed(waiting.join(won.select("island").distinct(), "island", "left_anti"))

    def left() -> DataFrame:
        return island.join(done.select("x", "y"), ["x", "y"], "left_anti")

    parts = checkpointed(raster_components(left().select("x", "y")))
    around = _moved(parts, FOUR).join(done.select("x", "y", "owner"), ["x", "y"]).groupBy("component").agg(F.min("owner").alias("owner"), F.max("owner").alias("last")).filter("owner = last")
    pockets = parts.join(around, "component").join(island, ["x", "y"]).select("x", "y", "island", "owner", F.lit("pocket").alias("rule"), F.lit(0).alias("round"))
    done = checkpointed(done.unionByName(pockets))

    open_cells = left()
    close = _moved(done.select("x", "y", "island", "owner"), _disc(gap)).join(open_cells, ["x", "y", "island"]).groupBy("x", "y", "island").agg(F.min(F.struct("d2", "owner")).alias("b"))
    gaps = close.select("x", "y", "island", F.col("b.owner").alias("owner"), F.lit("gap").alias("rule"), F.lit(0).alias("round"))
    done = checkpointed(done.unionByName(gaps))
    rest = left().select("x", "y", "island", F.lit(None).cast(done.schema["owner"].dataType).alias("owner"), F.lit("unclaimed").alias("rule"), F.lit(0).alias("round"))
    return done.unionByName(rest)
