"""The driver's tables, and the relations derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.years import from_astronomical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as validity records: (id, pid, from_year, to_year, kind, tier, a), from 1200 years before the first day."""
    o = table(spark, sf_dir, "orders")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) - 1200
    o = o.withColumn("s", start).withColumn("e", (F.col("s") + F.col("o_orderkey") % 90).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("pid"),
        from_astronomical(F.col("s")).cast("int").alias("from_year"),
        from_astronomical(F.col("e")).cast("int").alias("to_year"),
        F.col("o_orderstatus").alias("kind"),
        F.when(F.col("o_orderpriority").like("1%"), 1).otherwise(0).alias("tier"),
        F.col("o_totalprice").alias("a"),
    )


RECORDS_SQL = """recs AS (SELECT o_orderkey AS id, 'cust:' || o_custkey AS pid,
  (CASE WHEN s <= 0 THEN s - 1 ELSE s END)::INT AS from_year, (CASE WHEN e <= 0 THEN e - 1 ELSE e END)::INT AS to_year,
  o_orderstatus AS kind, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS tier, o_totalprice AS a
  FROM (SELECT *, s + o_orderkey % 90 AS e FROM (SELECT *, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) - 1200 AS s FROM orders)))"""


def points(df: DataFrame, key: str) -> DataFrame:
    """Whole-degree points from a key: lon in [-180, 180), lat in [-80, 80)."""
    k = F.col(key)
    return df.withColumn("lon", ((k * 37) % 360 - 180).cast("double")).withColumn("lat", ((k * 17) % 160 - 80).cast("double"))


def points_sql(key: str) -> str:
    return f"(({key} * 37) % 360 - 180)::DOUBLE AS lon, (({key} * 17) % 160 - 80)::DOUBLE AS lat"


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One GeoJSON feature a line: properties and geometry, with lines that do not parse in _corrupt_record."""
    return spark.read.schema(f"type string, properties {schema}, geometry struct<type:string,coordinates:string>, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_feature_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The features of GeoJSON collections."""
    whole = spark.read.schema(f"features array<struct<type:string,properties:{schema},geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    return whole.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, head, body) of Markdown files: the block between the first two lines of three dashes, and the rest."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    return raw.select("path", F.regexp_extract("value", pattern, 1).alias("head"), F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def verified(spark: SparkSession, path: str, sums: DataFrame) -> DataFrame:
    """(name, ok) of files against a table (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return sums.join(files, "name", "left").select("name", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))
