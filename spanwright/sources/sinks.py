"""Writers: Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, properties: list[str], geometry: str) -> None:
    """One GeoJSON feature a line, properties in the given order."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col(geometry).alias("geometry"))
    df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder for each chunk; chunks that `df` does not hold stay as they are."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def to_sync(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action) that brings a listing (path, size, modified) in line with another: copy or delete."""
    s, t = source.alias("s"), target.alias("t")
    both = s.join(t, F.col("s.path") == F.col("t.path"), "full_outer")
    changed = F.col("t.path").isNull() | (F.col("s.size") != F.col("t.size")) | (F.col("s.modified") != F.col("t.modified"))
    action = F.when(F.col("s.path").isNull(), "delete").when(changed, "copy")
    return both.select(F.coalesce("s.path", "t.path").alias("path"), action.alias("action")).filter("action IS NOT NULL")
