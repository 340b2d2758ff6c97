"""Simplification of lines by their farthest points: long lines in rounds over all tasks, short segments whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.plans.materialise import checkpointed

#: Segments with at most so many inner points are finished in one task: 50 MB of places and coordinates.
BLOCK = 1 << 21
#: Points of a run whose bounding box tells whether the farthest point may be among them.
RUN = 1024


def distance2(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The squared distance of a point from a segment; the same steps as in `_distances2`, so that both give the same doubles."""
    ux, uy, px, py = bx - ax, by - ay, x - ax, y - ay
    length2, along, across = ux * ux + uy * uy, px * ux + py * uy, ux * py - uy * px
    qx, qy = x - bx, y - by
    return F.when((length2 == 0) | (along <= 0), px * px + py * py).when(along >= length2, qx * qx + qy * qy).otherwise(across * across / length2)


def _distances2(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    ux, uy, px, py = bx - ax, by - ay, x - ax, y - ay
    length2, along, across = ux * ux + uy * uy, px * ux + py * uy, ux * py - uy * px
    qx, qy = x - bx, y - by
    inner = across * across / (length2 or 1.0)
    return np.where((along <= 0) | (length2 == 0), px * px + py * py, np.where(along >= length2, qx * qx + qy * qy, inner))


class _Runs:
    """The farthest point of a segment without a look at all its points.

    Distance from a segment is convex, so no point of a run is farther than a corner of the run's box. Runs are looked at by falling bounds
    until none can hold a farther point. Bounds get room for rounding; where coordinates are whole and small the steps
    are exact, and runs that can only equal an earlier point are left out too.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, run: int = RUN) -> None:
        self.x, self.y, self.run = x, y, run
        n = len(x) // run
        boxes = [f(c[: n * run].reshape(n, run), axis=1) for c in (x, y) for f in (np.min, np.max)]
        self.corners = np.stack([boxes[0], boxes[0], boxes[1], boxes[1]]), np.stack([boxes[2], boxes[3], boxes[2], boxes[3]])
        self.extent = max(np.ptp(x), np.ptp(y), np.abs(x).max(), np.abs(y).max())
        self.exact = bool(self.extent < 2**24 and (x == np.floor(x)).all() and (y == np.floor(y)).all())

    def farthest(self, i: int, j: int) -> tuple[float, int]:
        """The squared distance and the index of the farthest point between `i` and `j`, the first of equals."""
        x, y, run = self.x, self.y, self.run
        ends = x[i], y[i], x[j], y[j]
        best, at = -1.0, -1

        def look(lo: int, hi: int) -> None:
            nonlocal best, at
            if lo < hi:
                d2 = _distances2(x[lo:hi], y[lo:hi], *ends)
                k = int(d2.argmax())
                if d2[k] > best or (d2[k] == best and lo + k < at):
                    best, at = d2[k], lo + k

        first, last = -(-(i + 1) // run), j // run
        if last - first < 2:
            look(i + 1, j)
            return best, at
        look(i + 1, first * run)
        look(last * run, j)
        cx, cy = (c[:, first:last] for c in self.corners)
        bounds = _distances2(cx, cy, *ends).max(axis=0)
        ux, uy = ends[2] - ends[0], ends[3] - ends[1]
        length2 = ux * ux + uy * uy
        start = np.arange(first, last) * run
        if self.exact:
            along = (cx - ends[0]) * ux + (cy - ends[1]) * uy
            settled = ((along > 0) & (along < length2)).all(axis=0)
            bounds = np.where(settled, bounds, bounds * (1 + 1e-9))
        else:
            room = 2.0**-46 * self.extent * (self.extent / np.sqrt(length2) if length2 > 0 else 1.0)
            bounds, settled = (np.sqrt(bounds) * (1 + 1e-9) + room) ** 2, False
        while True:
            bounds[(bounds < best) | (settled & (bounds == best) & (start > at))] = -1.0
            k = int(bounds.argmax())
            if bounds[k] < 0:
                return best, at
            look(int(start[k]), int(start[k]) + run)
            bounds[k] = -1.0


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The points to keep inside segments, each a row with its inner points in order."""
    for batch in batches:
        out = []
        for s in batch.itertuples(index=False):
            x, y = (np.concatenate(([a], inner, [b])) for a, inner, b in ((s.ax, s.xs, s.bx), (s.ay, s.ys, s.by)))
            keep, todo, runs = [], [(0, len(x) - 1, s.must)], _Runs(x, y)
            while todo:
                i, j, must = todo.pop()
                if j - i > 1:
                    d2, k = runs.farthest(i, j)
                    if d2 > s.tolerance * s.tolerance or (must > 0 and d2 > 0):
                        keep.append(k)
                        todo += [(i, k, must - 1), (k, j, must - 1)]
            if keep:
                k = np.array(sorted(keep))
                out.append(pd.DataFrame({"line": s.line, "place": s.places[k - 1], "x": x[k], "y": y[k]}))
        if out:
            yield pd.concat(out)


def simplified(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(line, place, x, y) of the points (line, place, x, y, tolerance) that Douglas and Peucker's rule keeps, x and y as doubles.

    A line is its points by place; its ends stay. Of the points between two kept ones the farthest from their segment (the first among
    equals) is kept if it lies more than the line's least tolerance away, and parts what is left. A closed line also keeps the farthest point
    of the whole and of both halves, wherever they are apart, so that no ring vanishes. Of rows with an equal place the
    greatest counts; rows with a null, and NaN coordinates, take no part.

    In a round every point knows its segment's ends, the farthest points come from an aggregation with partial maxima, and each segment that
    splits tells its points so: a line that holds most points is spread over all tasks. Segments with up to `block` inner points leave the
    rounds and are finished whole.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rows = points.select("line", F.col("place").cast("long").alias("place"), x.alias("x"), y.alias("y"), F.col("tolerance").cast("double").alias("tolerance")).na.drop().filter("NOT isnan(x) AND NOT isnan(y)")
    rows = checkpointed(rows.groupBy("line", "place").agg(F.max(F.struct("x", "y")).alias("p"), F.min("tolerance").alias("tolerance")).select("line", "place", "p.x", "p.y", "tolerance"))
    point = F.struct("place", "x", "y")
    ends = rows.groupBy("line").agg(F.min(point).alias("a"), F.max(point).alias("b"), F.min("tolerance").alias("tolerance"))
    closed = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    ends = ends.select("line", "tolerance", F.when(closed, 2).otherwise(0).alias("must"), F.col("a.place").alias("a"), F.col("b.place").alias("b"), *[F.col(f"{e}.{c}").alias(e + c) for e in "ab" for c in "xy"])
    kept = [ends.select("line", F.explode(F.array(*[F.struct(F.col(e).alias("place"), F.col(e + "x").alias("x"), F.col(e + "y").alias("y")) for e in "ab"])).alias("p")).select("line", "p.*").distinct()]
    short, state = [], rows.drop("tolerance").join(ends, "line").filter("place > a AND place < b")
    d2 = distance2(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))
    state = checkpointed(state)
    while True:
        far = state.groupBy("line", "a").agg(F.count("*").alias("n"), F.max(F.struct(d2.alias("d2"), (-F.col("place")).alias("back"), "x", "y")).alias("f"))
        far = checkpointed(far.select("line", "a", "n", F.col("f.d2").alias("d2"), (-F.col("f.back")).alias("at"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy")))
        short.append(state.join(far.filter(F.col("n") <= block).select("line", "a"), ["line", "a"], "left_semi"))
        if far.filter(F.col("n") > block).isEmpty():
            break
        apart = (F.col("d2") > F.col("tolerance") * F.col("tolerance")) | ((F.col("must") > 0) & (F.col("d2") > 0))
        split = checkpointed(state.join(far.filter(F.col("n") > block), ["line", "a"]).filter(apart))
        kept.append(split.filter("place = at").select("line", "place", "x", "y"))
        first = F.col("place") < F.col("at")
        state = split.filter("place <> at").select(
            "line", "place", "x", "y", "tolerance", (F.col("must") - 1).alias("must"),
            *[F.when(first, F.col(c)).otherwise(F.col(f)).alias(c) for c, f in (("a", "at"), ("ax", "fx"), ("ay", "fy"))], *[F.when(first, F.col(f)).otherwise(F.col(c)).alias(c) for c, f in (("b", "at"), ("bx", "fx"), ("by", "fy"))],
        )
    whole = short[0]
    for s in short[1:]:
        whole = whole.unionByName(s)
    segment = ["line", "a", "ax", "ay", "bx", "by", "tolerance", "must"]
    listed = whole.groupBy(*segment).agg(F.sort_array(F.collect_list(point)).alias("p")).select(*segment, F.col("p.place").alias("places"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    out = listed.mapInPandas(_finished, rows.select("line", "place", "x", "y").schema)
    for k in kept:
        out = out.unionByName(k)
    return out
