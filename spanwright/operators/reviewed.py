"""Regeneration of tables that people review: a merge of what was generated, what is generated now and what reviewers made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes whose rows leave the table.
DROPPED = ("gone", "removed", "removed, changed")


def reviewed_merge(before: DataFrame, now: DataFrame, reviewed: DataFrame, key: str, decisions: Sequence[str]) -> DataFrame:
    """(key, content, decisions, outcome): one row for each key of the three tables; rows whose outcome is in DROPPED tell what goes.

    `before` and `now` hold the key and the content that generation gave the last time and gives now; `reviewed` also the columns `decisions`, null
    where nobody has decided. A row is reviewed where a decision is set, and edited where its content is not what was generated before. Both
    keep their content and decisions, as `kept` where nothing is generated for them now, as `agreed` (decided) or `same` (edited) where that
    equals theirs, as `edited` where it is as before, else as `conflict`. Others follow the generation: `new`, `same`, `updated` or `gone`. What reviewers took out stays out: `removed`, or `removed, changed` where generation gives something else now.

    The three tables are stacked and grouped by the key, so there is one shuffle and no join. Of rows of a table with equal key the
    greatest counts; a null key is a key like others. Nulls are equal to nulls.
    """
    content = [c for c in now.columns if c != key]
    types = dict(reviewed.dtypes)
    none = [F.lit(None).cast(types[c]).alias(c) for c in decisions]

    def side(df: DataFrame, name: str, decided: Sequence[Column]) -> DataFrame:
        return df.select(F.col(key), F.lit(name).alias("__side"), F.struct(*content).alias("__c"), F.struct(*decided).alias("__d"))

    stacked = side(before, "b", none).unionByName(side(now, "n", none)).unionByName(side(reviewed, "r", [F.col(c) for c in decisions]))
    of = lambda name: F.max(F.when(F.col("__side") == name, F.struct("__c", "__d"))).alias(f"__{name}")
    rows = stacked.groupBy(key).agg(of("b"), of("n"), of("r"))
    b, n, r = F.col("__b.__c"), F.col("__n.__c"), F.col("__r.__c")
    has = {s: F.col(f"__{s}").isNotNull() for s in "bnr"}
    as_before = has["b"] & n.eqNullSafe(b)
    decided = F.greatest(*[F.col(f"__r.__d.`{c}`").isNotNull() for c in decisions], F.lit(False), F.lit(False))
    edited = ~has["b"] | ~r.eqNullSafe(b)
    outcome = (
        F.when(~has["r"] & ~has["n"], "gone")
        .when(~has["r"] & has["b"], F.when(as_before, "removed").otherwise("removed, changed"))
        .when(~has["r"], "new")
        .when(~has["n"], F.when(decided | edited, "kept").otherwise("gone"))
        .when(decided | edited, F.when(n.eqNullSafe(r), F.when(decided, "agreed").otherwise("same")).when(as_before, "edited").otherwise("conflict"))
        .otherwise(F.when(n.eqNullSafe(r), "same").otherwise("updated"))
    )
    held = rows.withColumn("outcome", outcome)
    mine = F.col("outcome").isin("kept", "agreed", "edited", "conflict")
    chosen = F.when(mine, r).otherwise(F.coalesce(n, r, b))
    return held.withColumn("__c", chosen).select(key, *[F.col(f"__c.`{c}`").alias(c) for c in content], *[F.col(f"__r.__d.`{c}`").alias(c) for c in decisions], "outcome")
