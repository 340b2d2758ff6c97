"""Noding of rings: vertices that lie near another ring's side become its vertices, and sides that run out and back are taken away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.plans.materialise import checkpointed, sorted_side

#: Vertices of a ring that one task holds together.
BLOCK = 4096


def _renumbered(rows: DataFrame, *order: Column) -> DataFrame:
    """`place` from 0 in each ring, by block and then `order`; windows see a block, or the blocks of a ring, never a whole ring."""
    blocks = rows.groupBy("ring", "block").agg(F.count("*").alias("n"))
    of_ring = Window.partitionBy("ring")
    before = F.coalesce(F.sum("n").over(of_ring.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("ring", "block", before.alias("before"), F.sum("n").over(of_ring).alias("size"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("ring", "block").orderBy(*order)))
    return rows.join(sorted_side(blocks), ["ring", "block"]).withColumn("place", F.col("before") + F.col("nth") - 1).drop("block", "before", "nth")


def open_rings(points: DataFrame) -> DataFrame:
    """(ring, place, x, y, size) of the vertices (ring, place, x, y), places from 0 without gaps, and without a last vertex that repeats the first.

    Of rows with an equal place the greatest counts; rows with a null and coordinates that are not finite take no part.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rows = points.select("ring", F.col("place").cast("long").alias("at"), x.alias("x"), y.alias("y")).na.drop().filter("abs(x) < double('inf') AND abs(y) < double('inf')")
    rows = rows.groupBy("ring", "at").agg(F.max(F.struct("x", "y")).alias("p")).select("ring", "at", "p.x", "p.y")
    point = F.struct("at", "x", "y")
    ends = rows.groupBy("ring").agg(F.min(point).alias("a"), F.max(point).alias("b"))
    closing = ends.filter("a.at < b.at AND a.x = b.x AND a.y = b.y").select("ring", F.col("b.at").alias("at"))
    return _renumbered(rows.join(sorted_side(closing), ["ring", "at"], "left_anti").withColumn("block", F.floor(F.col("at") / BLOCK)), F.col("at")).select("ring", "place", "x", "y", "size")


def sides(vertices: DataFrame) -> DataFrame:
    """(ring, place, ax, ay, bx, by): each vertex of open rings (ring, place, x, y, size) with the next one, by a join on the place."""
    after = vertices.select("ring", F.pmod(F.col("place") - 1, F.col("size")).alias("place"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return vertices.select("ring", "place", F.col("x").alias("ax"), F.col("y").alias("ay")).join(sorted_side(after), ["ring", "place"])


def noded(vertices: DataFrame, eps: float, end_eps: float | None = None, cell: float = 1.0) -> DataFrame:
    """Open rings (ring, place, x, y, size) with the vertices that they lack: (ring, place, x, y, size).

    A vertex of any ring that lies within `eps` of a side, between its ends and farther than `end_eps` (as `eps`, where it is none) from both, is
    inserted into the side, by its place along it. Vertices of equal coordinates are one.

    Sides are dealt to the grid cells that they pass, column by column, so a long side meets as many cells as it is long and not as its
    bounding box holds; vertices meet them there by an equi-join. Cells must be so small that few sides share one.
    """
    far = eps if end_eps is None else end_eps
    c = lambda v: F.floor(v / cell)
    s = sides(vertices)
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    s = s.withColumn("cx", F.explode(F.sequence(c(left - eps), c(right + eps))))
    # the side's heights over the column and `eps` to both sides of it
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    over = lambda v: F.when(F.col("ax") == F.col("bx"), F.col("ay")).otherwise(F.col("ay") + slope * (F.least(F.greatest(v, left), right) - F.col("ax")))
    upright = F.col("ax") == F.col("bx")
    h1, h2 = over(F.col("cx") * cell - eps), F.when(upright, F.col("by")).otherwise(over((F.col("cx") + 1) * cell + eps))
    # heights are rounded, so they get a little more than `eps`
    room = 1.001 * eps + 1e-9
    s = s.withColumn("cy", F.explode(F.sequence(c(F.least(h1, h2) - room), c(F.greatest(h1, h2) + room))))
    points = vertices.select("x", "y").distinct().withColumn("cx", c(F.col("x"))).withColumn("cy", c(F.col("y")))
    ux, uy, px, py, qx, qy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    length2, along, across = ux * ux + uy * uy, px * ux + py * uy, ux * py - uy * px
    near = (along > 0) & (along < length2) & (across * across <= eps * eps * length2) & (px * px + py * py > far * far) & (qx * qx + qy * qy > far * far)
    new = points.join(sorted_side(s), ["cx", "cy"]).filter(near).select("ring", "place", along.alias("along"), "x", "y")
    rows = vertices.select("ring", "place", F.lit(0.0).alias("along"), "x", "y").unionByName(new).withColumn("block", F.floor(F.col("place") / BLOCK))
    return _renumbered(rows.withColumnRenamed("place", "at"), F.col("at"), F.col("along"), F.col("x"), F.col("y")).select("ring", "place", "x", "y", "size")


def _walked(x: np.ndarray, y: np.ndarray, cyclic: bool) -> list[int]:
    """The vertices that are left when repeats and ways out and back are taken from a walk."""
    same = lambda i, j: x[i] == x[j] and y[i] == y[j]
    left: list[int] = []
    for i in range(len(x)):
        if left and same(left[-1], i):
            continue
        if len(left) > 1 and same(left[-2], i):
            left.pop()
        else:
            left.append(i)
    first, last = 0, len(left) - 1
    while cyclic and last > first:
        if same(left[first], left[last]) or same(left[first], left[last - 1]):
            last -= 1
        elif same(left[first + 1], left[last]):
            first += 1
        else:
            break
    return left[first : last + 1]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for b in batch.itertuples(index=False):
            k = _walked(b.xs, b.ys, b.whole)
            out.append((len(k), b.places[k], b.xs[k], b.ys[k]))
        if out:
            n, at, x, y = zip(*out)
            of = np.repeat(np.arange(len(n)), n)
            head = batch[["ring", "block"]].iloc[of].reset_index(drop=True)
            yield head.assign(at=np.concatenate(at), x=np.concatenate(x), y=np.concatenate(y))


def despiked(vertices: DataFrame, block: int = BLOCK) -> DataFrame:
    """Open rings (ring, place, x, y, size) without repeated vertices and without sides that run out and back, one inside the other too, also across the seam.

    What is left of a ring does not depend on the order in which sides cancel, but for the vertex that it starts from. Rings with fewer than three
    vertices left vanish.

    A ring of up to `block` vertices is walked whole in one task. Longer ones are walked in blocks; what is left is numbered anew and
    turned by half a block for the next round, until two rounds in a row take nothing away.
    """
    kind = vertices.schema["ring"].dataType.simpleString()
    done, state, turn, idle = [], checkpointed(vertices.select("ring", "place", "x", "y", "size")), 0, 0
    while not state.isEmpty():
        whole = F.col("size") <= block
        rows = state.withColumn("at", F.pmod(F.col("place") + F.when(whole, 0).otherwise(turn), F.col("size"))).withColumn("whole", whole)
        point = F.struct("at", "x", "y")
        listed = rows.groupBy("ring", "whole", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(point)).alias("p"))
        listed = listed.select("ring", "whole", "block", F.col("p.at").alias("places"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
        left = _renumbered(listed.mapInPandas(_blocks, f"ring {kind}, block long, at long, x double, y double"), F.col("at"))
        left = checkpointed(left.join(sorted_side(rows.filter("NOT whole").groupBy("ring").agg(F.max("size").alias("was"))), "ring", "left"))
        done.append(left.filter("was IS NULL").select("ring", "place", "x", "y", "size"))
        state = left.filter("was IS NOT NULL")
        idle = 0 if not state.filter("size < was").isEmpty() else idle + 1
        turn = block // 2 - turn
        state = state.select("ring", "place", "x", "y", "size")
        if idle == 2:
            done.append(state)
            break
    out = done[0] if done else state
    for d in done[1:]:
        out = out.unionByName(d)
    return out.filter("size > 2")
