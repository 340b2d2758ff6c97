"""Exact nearest owners of cells in two passes, rows and then columns, and the poles of areas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.plans.materialise import checkpointed


def _in_column(y: np.ndarray, row: np.ndarray, g2: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, owner's code) for cells at y in one column, from what each row offers there: (row, g2, code).

    Looks at the rows k above and below while k * k is not beyond the best distance found, so that equals are all seen.
    """
    low, height = row.min(), row.max() - row.min() + 1
    offer, who = np.full(height, np.iinfo(np.int64).max // 2), np.zeros(height, dtype=np.int64)
    order = np.lexsort((code, g2))[::-1]  # the least offer of a row is written last
    offer[row[order] - low], who[row[order] - low] = g2[order], code[order]
    best, owner = np.full(len(y), np.iinfo(np.int64).max // 2), np.zeros(len(y), dtype=np.int64)
    outside = np.maximum(np.maximum(low - y, y - low - height + 1), 0)
    active, k = np.arange(len(y)), int(outside.min())
    while active.size:
        for step in {k, -k}:
            at = y[active] - low + step
            seen = active[(at >= 0) & (at < height)]
            at = y[seen] - low + step
            d2 = offer[at] + k * k
            better = (d2 < best[seen]) | ((d2 == best[seen]) & (who[at] < owner[seen]))
            best[seen[better]], owner[seen[better]] = d2[better], who[at[better]]
        k += 1
        active = active[(k * k <= best[active]) & (k <= np.maximum(np.abs(y[active] - low), np.abs(y[active] - low - height + 1)))]
    return best, owner


def nearest_split(cells: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, owner, d2) of distinct cells (by, x, y): the seed (by, x, y, owner) whose cell is nearest, of equals the one of the least
    owner, and the squared distance. Groups are apart; cells of a group without seeds are left out, as are rows with a null.

    First each seed takes the columns of its own row to which no other seed of the row is nearer, within the range of the group's cells; then a
    column sees the one or two offers of each row. Both passes shuffle on a key with at most as many rows as a map has rows or
    columns (twice that on ties), so no task's memory grows with the input, and there are no rounds.
    """
    by = list(by)
    cells = cells.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).na.drop().distinct()
    seeds = seeds.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "owner").na.drop().groupBy(*by, "x", "y").agg(F.min("owner").alias("owner"))
    if by:
        reach = cells.groupBy(*by).agg(F.min("x").alias("west"), F.max("x").alias("east"))
        rows = seeds.join(reach, by)
    else:
        west, east = cells.agg(F.min("x"), F.max("x")).first()
        rows = seeds.withColumns({"west": F.lit(west).cast("long"), "east": F.lit(east).cast("long")}).filter("west IS NOT NULL")
    w = Window.partitionBy(*by, "y").orderBy("x")
    lo = F.greatest(F.coalesce(F.ceil((F.lag("x").over(w) + F.col("x")) / 2), F.col("west")), F.col("west"))
    hi = F.least(F.coalesce(F.floor((F.lead("x").over(w) + F.col("x")) / 2), F.col("east")), F.col("east"))
    spread = rows.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").withColumn("at", F.explode(F.sequence("lo", "hi")))
    offers = spread.select(*by, F.col("at").alias("x"), "y", ((F.col("at") - F.col("x")) * (F.col("at") - F.col("x"))).alias("g2"), "owner")
    columns = [*by, "x", "y", "owner", "d2"]
    schema = cells.join(seeds.select("owner").limit(0)).select(*by, "x", "y", "owner", F.lit(0).cast("long").alias("d2")).schema

    def column(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame(columns=columns)
        owners, code = np.unique(offered["owner"].to_numpy(), return_inverse=True)
        d2, owner = _in_column(asked["y"].to_numpy(), offered["y"].to_numpy(), offered["g2"].to_numpy(), code)
        return asked.assign(owner=owners[owner], d2=d2)[columns]

    return cells.groupBy(*by, "x").cogroup(offers.groupBy(*by, "x")).applyInPandas(column, schema)


def poles(cells: DataFrame) -> DataFrame:
    """(owner, x, y, d2): of each owner's cells (x, y, owner) the one farthest from all cells that are not its own, the least (x, y) among equals.

    The nearest cell outside an area touches one of its sides, so only such cells are seeds.
    """
    cells = checkpointed(cells.select("owner", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).na.drop().distinct())
    sides = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    beside = cells.withColumn("s", sides).select("owner", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()
    outside = beside.join(cells, ["owner", "x", "y"], "left_anti").select(F.col("owner").alias("area"), "x", "y", F.lit(0).alias("owner"))
    far = nearest_split(cells.select(F.col("owner").alias("area"), "x", "y"), outside, ["area"])
    top = far.groupBy("area").agg(F.max(F.struct("d2", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("p"))
    return top.select(F.col("area").alias("owner"), (-F.col("p.x")).alias("x"), (-F.col("p.y")).alias("y"), F.col("p.d2").alias("d2"))
