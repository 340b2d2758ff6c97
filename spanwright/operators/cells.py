"""Set algebra of areas as sets of cells: carving, assignment, clipping, opening and snapping are joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NINE = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def assigned(claims: DataFrame, priority: str) -> DataFrame:
    """(x, y, owner): each claimed cell with the owner of the claim that comes last (greatest priority, then owner)."""
    top = F.max(F.struct(priority, "owner")).alias("t")
    return claims.groupBy("x", "y").agg(top).select("x", "y", F.col("t.owner").alias("owner"))


def carved(cells: DataFrame, by: DataFrame) -> DataFrame:
    """The cells that no cell of `by` takes."""
    return cells.join(by.select("x", "y").distinct(), ["x", "y"], "left_anti")


def clipped(cells: DataFrame, land: DataFrame) -> DataFrame:
    """(owner, cells, on_land, status) of each owner's cells against land: ok, partly or lost."""
    marked = cells.join(land.select("x", "y", F.lit(1).alias("hit")).distinct(), ["x", "y"], "left")
    out = marked.groupBy("owner").agg(F.count("*").alias("cells"), F.count("hit").alias("on_land"))
    return out.withColumn("status", F.when(F.col("on_land") == 0, "lost").when(F.col("on_land") < F.col("cells"), "partly").otherwise("ok"))


def _around(cells: DataFrame) -> DataFrame:
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NINE]))
    return cells.select("x", "y", step.alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


def opened(cells: DataFrame) -> DataFrame:
    """Cells that survive an erosion by one cell and the dilation after it."""
    cells = cells.select("x", "y").distinct()
    kernel = _around(cells).groupBy("x", "y").count().filter("count = 9").join(cells, ["x", "y"], "left_semi")
    return _around(kernel).distinct()


def nearest_owner(cells: DataFrame, owners: DataFrame, reach: int) -> DataFrame:
    """(x, y, owner) of unowned cells: the nearest owned cell within `reach` rings, the least owner among equals."""
    steps = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    asked = cells.select("x", "y").distinct().select("x", "y", step.alias("s"))
    met = asked.join(owners.withColumnsRenamed({"x": "ox", "y": "oy"}), (F.col("x") + F.col("s.dx") == F.col("ox")) & (F.col("y") + F.col("s.dy") == F.col("oy")))
    d2 = F.col("s.dx") * F.col("s.dx") + F.col("s.dy") * F.col("s.dy")
    return met.groupBy("x", "y").agg(F.min(F.struct(d2.alias("d"), "owner")).alias("b")).select("x", "y", F.col("b.owner").alias("owner"))


def snapped(points: DataFrame, size: float) -> DataFrame:
    """(id, lon, lat): each point moved to the least-numbered point of its cell and the eight around it."""
    cx, cy = F.floor(F.col("lon") / size).cast("int"), F.floor(F.col("lat") / size).cast("int")
    celled = points.withColumn("x", cx).withColumn("y", cy)
    first = celled.groupBy("x", "y").agg(F.min(F.struct("id", "lon", "lat")).alias("f"))
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NINE]))
    near = first.select("f", step.alias("s"), "x", "y").select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "f")
    best = near.groupBy("x", "y").agg(F.min("f").alias("f"))
    return celled.join(best, ["x", "y"]).select("id", F.col("f.lon").alias("lon"), F.col("f.lat").alias("lat"))


def sliver(area: Column, perimeter: Column, least: float = 1e-4, width: float = 2e-3) -> Column:
    """Too small, or too thin for its length: twice the area over the perimeter is the mean width (km)."""
    return (area < least) | (2 * area / perimeter < width)


def simplify_interval(area_km2: Column, parts: Column, tolerance: float, least: float = 0.005) -> Column:
    """The tolerance of a feature (km): the given one, or less for small features, never below `least`."""
    return F.least(F.lit(tolerance), F.greatest(F.lit(least), F.sqrt(area_km2 / parts) / 50))
