"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Spark reads it, so any path that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder named by spark.checkpoint.dir.

    The copy outlives executors, so what is built on it never recomputes the lineage above. Where the setting is
    unset, a temporary folder will do on one machine; on a cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return resized(df.checkpoint())


#: Bits of a size in bytes that Spark may estimate; it takes 2^63 - 1 for what it has no estimate of.
SIZE_BITS = 63


def resized(df: DataFrame) -> DataFrame:
    """A checkpoint, without Spark's estimate of its size if that is beyond all measure.

    The estimate of a join is the product of those of its sides, and a checkpoint carries it on. In a loop of joins and checkpoints
    its digits double from round to round, until these numbers alone fill the driver.
    """
    plan = df._jdf.queryExecution().logical()
    # a number of more digits than Python reads is a ValueError
    with contextlib.suppress(ValueError):
        if plan.stats().sizeInBytes() < 1 << SIZE_BITS:
            return df
    spark = df.sparkSession
    return type(df)(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), df._jdf.schema(), False), spark)


def released(spark: SparkSession) -> None:
    """To be called between the rounds of a loop. Spark removes shuffle files, broadcasts and checkpoints when the driver collects what
    refers to them, and a driver whose heap fills with the plans of past rounds does so late: until then disk and heap only grow."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, however often and wherever the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


#: Items that `folded` takes at once: appending to an array copies it, so arrays that grow stay this short.
FOLD = 256


def folded(items: Column, start: Column, step, kind: str) -> Column:
    """All that `step(carry, item) -> (carry, array)` gives over the items in order, as one array of type `kind`.

    Items are taken in blocks, so that the time grows with their number and not with its square.
    """
    none = F.array().cast(kind)

    def item(state: Column, x: Column) -> Column:
        carry, out = step(state["carry"], x)
        return F.struct(carry.alias("carry"), F.concat(state["out"], out).alias("out"))

    def block(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["carry"].alias("carry"), none.alias("out")), item)
        return let(done, lambda d: F.struct(d["carry"].alias("carry"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def all_of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FOLD).cast("int")), lambda b: F.slice(xs, b * FOLD + 1, FOLD))
        parts = F.aggregate(blocks, F.struct(start.alias("carry"), F.array().cast(f"array<{kind}>").alias("out")), block, lambda state: state["out"])
        return F.when(F.size(xs) > 0, F.flatten(parts)).otherwise(none)

    return let(items, all_of)


def as_row(df: DataFrame) -> Column:
    """All columns in one struct, so that columns put beside it cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def no_text(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Actions inside hand at most `n` rows to Python at once, where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of a broadcast table that keeps most rows without partner out of a shuffle; a full table only keeps fewer out.
BITS = 1 << 24


def thinned(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among `keys`: a table of `BITS` bits, in words of 64, is broadcast.

    An exact join has to follow, an inner one: Spark moves a semi-join below this one.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    at, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(__bit % 64 AS int))")
    table = keys.select(bit.alias("__bit")).select(F.shiftright("__bit", 6).alias("__at"), mask.alias("__mask")).groupBy("__at").agg(F.bit_or("__mask").alias("__bits"))
    met = rows.withColumn("__at", at).withColumn("__bit", bit).join(F.broadcast(table), "__at")
    return met.filter(F.col("__bits").bitwiseAND(mask) != 0).drop("__at", "__bit", "__bits")


def fitted(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """`df` in as many partitions as its number of rows asks for, so that short tables don't make a file for each of many tasks."""
    return df.coalesce(max(1, math.ceil(rows / each)))
