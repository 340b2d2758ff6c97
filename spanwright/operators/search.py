"""Ranked name search over a table of names, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions import text as T


def keys_of(names: DataFrame) -> DataFrame:
    """(pid, pos, key, alt) of rows (pid, name, alt_names): the name first, then its alternatives, each form once."""
    every = F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))
    keys = names.select("pid", F.posexplode(every).alias("pos", "raw")).filter("raw IS NOT NULL").withColumn("key", T.normalize_text(F.col("raw")))
    first = keys.filter("key <> ''").groupBy("pid", "key").agg(F.min(F.struct("pos", "raw")).alias("f"))
    return first.select("pid", F.col("f.pos").alias("pos"), "key", F.when(F.col("f.pos") > 0, F.col("f.raw")).alias("alt"))


def search(names: DataFrame, query: str, limit: int = 10, extent: Column | None = None) -> DataFrame:
    """The best `limit` of (pid, name, alt_names) for a typed query: strict matches, then near ones while places are left.

    Near matches are looked for only if fewer than `limit` names match strictly, a count of at most `limit`.
    """
    spark, q = names.sparkSession, query.strip()
    folded = spark.range(1).select(T.normalize_text(F.lit(q)).alias("q")).first()["q"]
    columns = "pid string, name string, score int, matched string"
    if not folded or limit <= 0:
        return spark.createDataFrame([], columns)
    size = F.lit(0.0) if extent is None else extent
    keys = keys_of(names)
    score = lambda r: (2 * r + F.when(F.col("pos") == 0, 0).otherwise(1)).cast("int")
    ranked = keys.withColumn("score", score(T.rank(F.col("key"), folded))).filter("score IS NOT NULL")
    strict = ranked.groupBy("pid").agg(F.min(F.struct("score", "pos", "alt")).alias("b")).select("pid", F.col("b.score").alias("score"), F.col("b.alt").alias("matched"))
    hits = strict
    if any(T.typo_tolerant(t) for t in folded.split(" ")) and strict.limit(limit).count() < limit:
        rest = keys.join(strict, "pid", "left_anti").filter(T.near(F.col("key"), folded))
        loose = rest.groupBy("pid").agg(F.min(F.struct("pos", "alt")).alias("b")).select("pid", (2 * T.NEAR + F.when(F.col("b.pos") == 0, 0).otherwise(1)).cast("int").alias("score"), F.col("b.alt").alias("matched"))
        hits = strict.unionByName(loose)
    shown = hits.join(names.select("pid", "name", size.alias("extent")), "pid")
    order = [F.col("score"), F.desc("extent"), F.length("name"), F.col("name"), F.col("pid")]
    return shown.orderBy(*order).limit(limit).select("pid", "name", "score", "matched")


def reranked(results: DataFrame, query: str, alive: Column, limit: int = 20) -> DataFrame:
    """Results of a search with exact names first, then those alive, then the rest, each in the order they came (`prior`)."""
    tier = F.when(F.lower("name") == query.lower(), 0).when(alive, 1).otherwise(2)
    return results.withColumn("tier", tier).orderBy("tier", "prior").limit(limit)
