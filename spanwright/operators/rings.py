"""Rings and arcs of cell maps by list ranking: sides know their neighbour, and pointer jumping puts them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.plans.materialise import checkpointed

#: Cells have coordinates from -HALF to HALF; a side's number holds its cell and direction (east, north, west, south).
HALF = 1 << 20
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def ranked(links: DataFrame) -> DataFrame:
    """(item, head, rank) of a table (item, prev), prev null at a head and each item the prev of one other at most.

    Rounds double the distance that items look back, so their number is the logarithm of the longest list. A cycle is found when no item
    of it sees a smaller one any more, though it looks twice as far; it is cut before its least item, which becomes its head.
    """

    def rounds(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(items that have reached a head, items on cycles with the least of theirs)."""
        state = checkpointed(state.select("item", F.coalesce("prev", "item").alias("at"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.col("prev").isNull().alias("ended"), F.col("item").alias("least")))
        while True:
            back = state.select(F.col("item").alias("at"), F.col("at").alias("at2"), F.col("rank").alias("rank2"), F.col("ended").alias("ended2"), F.col("least").alias("least2"))
            new = state.filter("NOT ended").join(back, "at").select(
                "item", F.col("at2").alias("at"), (F.col("rank") + F.col("rank2")).alias("rank"), F.col("ended2").alias("ended"), F.least("least", "least2").alias("least"), (F.col("ended2") | (F.col("least2") < F.col("least"))).alias("moved")
            )
            new = checkpointed(new)
            moved = not new.filter("moved").isEmpty()
            state = checkpointed(state.filter("ended").unionByName(new.drop("moved")))
            if not moved:
                return state.filter("ended").select("item", F.col("at").alias("head"), "rank"), state.filter("NOT ended").select("item", "least")

    lists, cycles = rounds(links)
    cut = links.join(cycles, "item").select("item", F.when(F.col("item") != F.col("least"), F.col("prev")).alias("prev"))
    return lists.unionByName(rounds(cut)[0]) if not cut.isEmpty() else lists


def number(x: Column, y: Column, d: Column) -> Column:
    return ((x.cast("long") + HALF) * (2 * HALF) + y + HALF) * 4 + d


def border_sides(cells: DataFrame) -> DataFrame:
    """(item, x, y, owner, d, other, next): sides of cells (x, y, owner) where the owner changes, its own area to the left.

    `other` is the owner across, null for none. The next side goes straight on, turns right where the cell ahead on the right is the
    owner's too, or left where the one ahead is not; areas that touch at a corner alone are apart.
    """
    around = {"east": (1, 0), "north": (0, 1), "west": (-1, 0), "south": (0, -1), "ne": (1, 1), "nw": (-1, 1), "sw": (-1, -1), "se": (1, -1)}
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, (dx, dy) in around.items()]))
    # each cell tells the eight around it who its owner is
    told = cells.select("x", "y", "owner", steps.alias("s")).select((F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), F.col("s.n").alias("n"), "owner")
    seen = told.groupBy("x", "y").agg(*[F.max(F.when(F.col("n") == n, F.col("owner"))).alias(n) for n in around])
    each = cells.join(seen, ["x", "y"], "left")
    sides = []
    # a side's cell across, ahead on the left and ahead on the right, by direction
    for d, (across, ahead, right) in enumerate((("south", "east", "se"), ("east", "north", "ne"), ("north", "west", "nw"), ("west", "south", "sw"))):
        dx, dy = STEPS[d]
        ax, ay = around[right]
        x, y = F.col("x"), F.col("y")
        on = F.coalesce(F.col(ahead) == F.col("owner"), F.lit(False))
        turn = F.coalesce(F.col(right) == F.col("owner"), F.lit(False))
        following = F.when(~on, number(x, y, F.lit((d + 1) % 4))).when(turn, number(x + ax, y + ay, F.lit((d + 3) % 4))).otherwise(number(x + dx, y + dy, F.lit(d)))
        sides.append(F.struct(number(x, y, F.lit(d)).alias("item"), F.lit(d).alias("d"), F.col(across).alias("other"), following.alias("next")))
    flat = each.select("x", "y", "owner", F.explode(F.array(*sides)).alias("s")).select("s.item", "x", "y", "owner", "s.d", "s.other", "s.next")
    return flat.filter(F.col("other").isNull() | (F.col("other") != F.col("owner")))


def start_of(sides: DataFrame) -> tuple[Column, Column]:
    """The grid point where a side begins."""
    d = F.col("d")
    return F.col("x") + F.when(d.isin(1, 2), 1).otherwise(0), F.col("y") + F.when(d.isin(2, 3), 1).otherwise(0)


def rings(sides: DataFrame) -> DataFrame:
    """(item, ring, rank) of border sides: the ring's least side names it and is its first."""
    return ranked(sides.select(F.col("next").alias("item"), F.col("item").alias("prev"))).select("item", F.col("head").alias("ring"), "rank")


def ring_table(cells: DataFrame) -> DataFrame:
    """(owner, ring, sides, corners, area) of cells (x, y, owner): the area of a hole is negative."""
    sides = checkpointed(border_sides(cells))
    before = sides.select(F.col("next").alias("item"), F.col("d").alias("d_before"))
    sx, sy = start_of(sides)
    dx = F.when(F.col("d") == 0, 1).when(F.col("d") == 2, -1).otherwise(0)
    dy = F.when(F.col("d") == 1, 1).when(F.col("d") == 3, -1).otherwise(0)
    at = sides.join(rings(sides), "item").join(before, "item")
    return at.groupBy("owner", "ring").agg(F.count("*").alias("sides"), F.sum((F.col("d") != F.col("d_before")).cast("long")).alias("corners"), (F.sum(sx * dy - sy * dx) / 2).cast("long").alias("area"))


def arcs(cells: DataFrame) -> DataFrame:
    """(arc, item, rank, owner, other) of the border sides of cells: arcs end where three or more sides meet.

    What lies between two owners is one arc walked from both sides: the least of its undirected sides names it. Its sides are
    ranked in the walk of each owner.
    """
    sides = checkpointed(border_sides(cells))
    px, py = start_of(sides)
    # undirected: the same side seen from across is the cell's there, in the opposite direction
    across = F.when(F.col("d") == 0, number(F.col("x"), F.col("y") - 1, F.lit(2))).when(F.col("d") == 1, number(F.col("x") + 1, F.col("y"), F.lit(3))).when(F.col("d") == 2, number(F.col("x"), F.col("y") + 1, F.lit(0))).otherwise(number(F.col("x") - 1, F.col("y"), F.lit(1)))
    named = sides.withColumn("side", F.least("item", across)).withColumn("px", px).withColumn("py", py)
    end_x = F.col("px") + F.when(F.col("d") == 0, 1).when(F.col("d") == 2, -1).otherwise(0)
    end_y = F.col("py") + F.when(F.col("d") == 1, 1).when(F.col("d") == 3, -1).otherwise(0)
    ends = named.select("side", F.explode(F.array(F.struct("px", "py"), F.struct(end_x.alias("px"), end_y.alias("py")))).alias("p")).select("side", "p.px", "p.py").distinct()
    meeting = ends.groupBy("px", "py").agg(F.count("*").alias("n")).filter("n > 2").select("px", "py", F.lit(True).alias("meet"))
    prev = sides.select(F.col("next").alias("item"), F.col("item").alias("prev"))
    links = named.join(prev, "item").join(meeting, ["px", "py"], "left").select("item", F.when(F.col("meet").isNull(), F.col("prev")).alias("prev"))
    walk = checkpointed(ranked(checkpointed(links)).join(named.select("item", "side", "owner", "other"), "item"))
    names = walk.groupBy("head").agg(F.min("side").alias("arc"))
    return walk.join(names, "head").select("arc", "item", "rank", "owner", "other")
