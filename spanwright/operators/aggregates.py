"""Indexes, argmax labels, shares and totals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.years import span_years
from spanwright.operators.intervals import coalesced

#: Rows whose pairs one task makes and adds up.
ROWS_OF_A_TASK = 200_000


def argmax(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[Column, bool]], take: Sequence[str]) -> DataFrame:
    """Of each key the row that comes first by `order` (column, descending?), in one aggregation without a sort.

    Descending columns must be numeric.
    """
    parts = [(-c if down else c).alias(f"o{i}") for i, (c, down) in enumerate(order)]
    best = F.min(F.struct(*parts, *[F.col(c).alias(f"t_{c}") for c in take])).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.t_{c}").alias(c) for c in take])


def polity_index(records: DataFrame) -> DataFrame:
    """One row for each pid: its first and last year, united spans, years alive, peak year, kind of the last record, size."""
    spans = coalesced(records, ["pid"]).groupBy("pid").agg(F.count("*").alias("n_spans"), F.sum(span_years(F.col("from_year"), F.col("to_year"))).alias("years"))
    last = F.max(F.struct("from_year", "id", "kind"))
    peak = F.min(F.struct((-F.col("a")).alias("minus"), F.col("from_year")))
    whole = records.groupBy("pid").agg(F.min("from_year").alias("first_year"), F.max("to_year").alias("last_year"), last.alias("l"), peak.alias("p"), F.count("*").alias("records"))
    return whole.join(spans, "pid").select("pid", "first_year", "last_year", "records", "n_spans", "years", F.col("l.kind").alias("last_kind"), F.col("p.from_year").alias("peak"))


def pair_weights(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """(a, b, n_groups, weight): unordered pairs of items that share a group, and the lesser of their weights summed.

    Items of a group are pre-aggregated; groups must be small by nature, as lines of an order are. Pairs are more than the rows
    that Spark sizes tasks by, so the number of tasks is that of the rows: what one task holds does not grow with them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_OF_A_TASK))
    one = df.select(group, item, weight).repartition(tasks, group).groupBy(group, item).agg(F.sum(weight).alias("w"))
    left = one.select(group, F.col(item).alias("a"), F.col("w").alias("wa"))
    right = one.select(group, F.col(item).alias("b"), F.col("w").alias("wb"))
    pairs = left.join(right, group).filter("a < b")
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n_groups"), F.sum(F.least("wa", "wb")).alias("weight"))


def majority(df: DataFrame, key: str, part: str, weight: str, least: float = 0.5, others: float = 0.1) -> DataFrame:
    """The largest part of each key, its share and the next one's, and whether it is a clear majority."""
    sums = df.groupBy(key, part).agg(F.sum(weight).alias("w"))
    two = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("w", (-F.col(part)).alias("minus"))))), 1, 2)
    top = sums.groupBy(key).agg(F.sum("w").alias("total"), two.alias("t"))
    share = F.col("t")[0]["w"] / F.col("total")
    second = F.coalesce(F.get("t", F.lit(1))["w"], F.lit(0.0)) / F.col("total")
    return top.select(key, (-F.col("t")[0]["minus"]).alias("top"), share.alias("share"), second.alias("second"), ((share >= least) & (second < others)).alias("clear"))


def collisions(df: DataFrame, name: str, key: str) -> DataFrame:
    """Rows whose name several keys share, with an ordinal suffix in the order of the keys."""
    shared = df.groupBy(name).agg(F.count_distinct(key).alias("n")).filter("n > 1")
    order = F.row_number().over(Window.partitionBy(name).orderBy(key))
    distinct = df.select(name, key).distinct()
    return distinct.join(shared, name).withColumn("ordinal", order).select(name, key, F.concat(F.col(name), F.lit(" ("), F.col("ordinal").cast("string"), F.lit(")")).alias("label"))


def mode_by_votes(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value with the most rows of each key; the greatest of equals."""
    votes = df.groupBy(key, value).count()
    return votes.groupBy(key).agg(F.max(F.struct("count", value)).alias("b")).select(key, F.col(f"b.{value}").alias(value), F.col("b.count").alias("votes"))


def running_first_seen(df: DataFrame, frame: str, item: str, cost: str) -> DataFrame:
    """For each frame the items seen for the first time, and the running total of their costs."""
    first = df.groupBy(item).agg(F.min(frame).alias(frame), F.min(F.col(cost)).alias("c"))
    per = first.groupBy(frame).agg(F.count("*").alias("new_items"), F.sum("c").alias("c"))
    w = Window.orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)  # frames are few
    return per.select(frame, "new_items", F.sum("new_items").over(w).alias("items"), F.round(F.sum("c").over(w), 2).alias("cost"))


def smallest_arc(df: DataFrame, key: str, lon: str) -> DataFrame:
    """(key, west, east): the shortest arc of longitudes that holds all points; east below west crosses 180."""
    points = df.select(key, lon).distinct()
    w = Window.partitionBy(key).orderBy(lon)
    whole = Window.partitionBy(key)
    nxt = F.coalesce(F.lead(lon).over(w), F.min(lon).over(whole) + 360)
    gaps = points.withColumn("nxt", nxt).withColumn("gap", nxt - F.col(lon))
    top = gaps.groupBy(key).agg(F.max(F.struct("gap", (-F.col(lon)).alias("minus"), "nxt")).alias("g"))
    wrap = lambda x: F.when(x >= 180, x - 360).otherwise(x)
    return top.select(key, wrap(F.col("g.nxt")).alias("west"), (-F.col("g.minus")).alias("east"), (360 - F.col("g.gap")).alias("width"))


def with_totals(df: DataFrame, keys: Sequence[str], measures: Sequence[Column], total: str = "total") -> DataFrame:
    """Grouped rows and a row of totals, in one pass; keys of the total read `total`. Keys hold no nulls."""
    out = df.rollup(*keys).agg(F.grouping_id().alias("__g"), *measures)
    return out.filter(F.col("__g").isin(0, 2 ** len(keys) - 1)).withColumns({k: F.coalesce(F.col(k), F.lit(total)) for k in keys}).drop("__g")


def full_diff(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, action) of two versions of a table: add, remove, update or same, by all the values. Null is a key and a value like others."""
    state = lambda df, n: df.select(F.col(key).alias(f"__k{n}"), F.struct(*values).alias(f"__v{n}"))
    both = state(old, "o").join(state(new, "n"), F.col("__ko").eqNullSafe(F.col("__kn")), "full_outer")
    o, n = F.col("__vo"), F.col("__vn")
    action = F.when(o.isNull(), "add").when(n.isNull(), "remove").when(~o.eqNullSafe(n), "update").otherwise("same")
    return both.select(F.coalesce("__ko", "__kn").alias(key), action.alias("action"))


def missing_references(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(key, missing_in): keys of either side that the other lacks."""
    a = left.select(key).distinct().join(right, key, "left_anti").withColumn("missing_in", F.lit(right_name))
    b = right.select(key).distinct().join(left, key, "left_anti").withColumn("missing_in", F.lit(left_name))
    return a.unionByName(b)
