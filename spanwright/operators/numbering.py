"""Sequential numbers and suffixes without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.plans.materialise import checkpointed


def numbered(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """1..n in the given order: rows are ranged into partitions, counted there, and numbered from each offset."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").count()
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__n", local).join(F.broadcast(offsets.drop("count")), "__part").withColumn(name, (F.col("__n") + F.col("__offset")).cast("long")).drop("__part", "__n", "__offset")


def suffixed(df: DataFrame, base: Column, order: Sequence[Column], name: str) -> DataFrame:
    """`base`, then 'base#2', 'base#3' and so on for rows that share it."""
    k = F.row_number().over(Window.partitionBy("__base").orderBy(*order))
    out = df.withColumn("__base", base).withColumn("__k", k)
    return out.withColumn(name, F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("#"), F.col("__k").cast("string")))).drop("__base", "__k")
