"""Quiz logic as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_insertion(df: DataFrame, key: str, order: str, date: str, asked: Column) -> DataFrame:
    """Places of each key's timeline (0 before the first) at which a date may be inserted; equal dates fit on either side."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, F.col(date).alias("d"), asked.alias("q"), F.row_number().over(w).alias("place"), F.lead(date).over(w).alias("nxt"))
    after = rows.filter((F.col("d") <= F.col("q")) & (F.col("nxt").isNull() | (F.col("q") <= F.col("nxt")))).select(key, "place")
    first = rows.filter((F.col("place") == 1) & (F.col("q") <= F.col("d"))).select(key, F.lit(0).alias("place"))
    return after.unionByName(first)


def judged(selection: Column, groups: Column) -> Column:
    """correct, one-away or wrong for four selected items against an array of groups (arrays); invalid unless four distinct."""
    shared = F.transform(groups, lambda g: F.size(F.array_intersect(g, selection)))
    most = F.array_max(shared)
    return F.when((F.size(selection) != 4) | (F.size(F.array_distinct(selection)) != 4), "invalid").when(most == 4, "correct").when(most == 3, "one-away").otherwise("wrong")


def daily_counter(df: DataFrame, key: str, ts: str) -> DataFrame:
    """How often each key moved on: distinct calendar days seen, less the first."""
    return df.groupBy(key).agg((F.count_distinct(F.col(ts).cast("date")) - 1).alias("position"), F.max(F.col(ts).cast("date")).alias("last_day"))


def throttled(df: DataFrame, key: str, ts: str, limit: int = 10, minutes: int = 15) -> DataFrame:
    """(key, window number, attempts, blocked) over fixed windows."""
    number = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (60 * minutes))
    counted = df.groupBy(key, number.alias("window")).agg(F.count("*").alias("attempts"))
    return counted.withColumn("blocked", F.greatest(F.lit(0), F.col("attempts") - limit).cast("long"))
