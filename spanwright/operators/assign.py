"""Assigning areas to holders in many frames at once: later entries win, and losers give up their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.intervals import interval_join


def assign(holdings: DataFrame, frames: DataFrame, entries: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((frame, record, pid, tier, x, y), (frame, entry, status, straddles, cells, won)) after all entries in one plan.

    `holdings` are the cells of each record in each frame, `frames` (frame, from_year, to_year), `entries` (entry, place, pid,
    from_year, to_year) and `areas` (entry, x, y). An entry gives its area, in the frames that it overlaps, to the largest record of
    tier 0 of its pid (the least record among equals), looked up before any entry is applied; every other record of tier 0 loses these cells, other
    tiers keep theirs. Of entries that claim a cell the last place wins, then the greater entry. A record that lost all of its cells has no row.
    The log has a row for each entry and frame: `stale` without a record of the pid, `error` with records of other tiers alone, `empty`
    without an area, else `applied`; `straddles` where the entry's years cut the frame; its cells, and those it won.
    """
    sizes = holdings.groupBy("frame", "record", "pid", "tier").agg(F.count("*").alias("n"))
    largest = F.max(F.when(F.col("tier") == 0, F.struct("n", (-F.col("record")).alias("minus"))))
    targets = sizes.groupBy("frame", "pid").agg(largest.alias("top")).select("frame", "pid", (-F.col("top.minus")).alias("target"), F.lit(True).alias("known"))
    active = interval_join(entries, frames.select("frame", F.col("from_year").alias("f0"), F.col("to_year").alias("f1")), ("from_year", "to_year"), ("f0", "f1"))
    active = active.withColumn("straddles", (F.col("from_year") > F.col("f0")) | (F.col("to_year") < F.col("f1"))).join(targets, ["frame", "pid"], "left")
    taken = areas.select("entry", "x", "y").distinct()
    claims = active.filter("target IS NOT NULL").select("frame", "entry", "place", "pid", "target").join(taken, "entry")
    winners = claims.groupBy("frame", "x", "y").agg(F.max(F.struct("place", "entry", "target", "pid")).alias("w")).select("frame", "x", "y", "w.entry", "w.target", "w.pid")
    ground = holdings.filter("tier = 0").join(winners.select("frame", "x", "y"), ["frame", "x", "y"], "left_anti")
    given = winners.select("frame", F.col("target").alias("record"), "pid", F.lit(0).alias("tier"), "x", "y")
    columns = ("frame", "record", "pid", "tier", "x", "y")
    after = holdings.filter("tier <> 0").select(*columns).unionByName(ground.select(*columns)).unionByName(given)
    won = winners.groupBy("frame", "entry").agg(F.count("*").alias("won"))
    area = taken.groupBy("entry").agg(F.count("*").alias("cells"))
    status = F.when(F.col("known").isNull(), "stale").when(F.col("target").isNull(), "error").when(F.col("cells").isNull(), "empty").otherwise("applied")
    log = active.join(area, "entry", "left").join(won, ["frame", "entry"], "left")
    return after, log.select("frame", "entry", status.alias("status"), "straddles", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cells", "won")])
