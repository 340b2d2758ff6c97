"""A reviewed table that is generated again."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.query import Query
from spanwright.operators.reviewed import reviewed_merge
from spanwright.sources.tables import table


def regenerated(spark, d):
    """Parts as entries: sizes differ from run to run, reviewers have changed some, decided on others and taken a few out."""
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    content = lambda s: [k, F.col("p_brand").alias("brand"), s.alias("size")]
    before = p.filter("p_partkey % 10 <> 0").select(*content(size))
    now = p.filter("p_partkey % 10 <> 1").select(*content(F.when(k % 3 == 0, size + 1).otherwise(size)))
    reviewed = p.filter("p_partkey % 13 <> 2").select(*content(F.when(k % 7 == 0, size + 100).when(k % 21 == 3, size + 1).otherwise(size)), F.when(k % 5 == 0, "active").alias("status"), F.when(k % 15 == 0, "reader").alias("verified_by"))
    return reviewed_merge(before, now, reviewed, "p_partkey", ["status", "verified_by"])


Q = [
    Query("reviewed_regeneration", "K24", regenerated, """WITH b AS (SELECT p_partkey, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 10 <> 0),
        n AS (SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 10 <> 1),
        r AS (SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 100 WHEN p_partkey % 21 = 3 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 5 = 0 THEN 'active' END AS status, CASE WHEN p_partkey % 15 = 0 THEN 'reader' END AS verified_by FROM part WHERE p_partkey % 13 <> 2),
        j AS (SELECT p_partkey, b.size AS bs, n.size AS ns, r.size AS rs, coalesce(r.brand, n.brand, b.brand) AS brand, status, verified_by, status IS NOT NULL OR verified_by IS NOT NULL AS decided, r.size IS NOT NULL AND r.size IS DISTINCT FROM b.size AS edited
              FROM b FULL JOIN n USING (p_partkey) FULL JOIN r USING (p_partkey)),
        o AS (SELECT *, CASE WHEN rs IS NULL THEN CASE WHEN ns IS NULL THEN 'gone' WHEN bs IS NULL THEN 'new' WHEN ns = bs THEN 'removed' ELSE 'removed, changed' END
                WHEN ns IS NULL THEN CASE WHEN decided OR edited THEN 'kept' ELSE 'gone' END
                WHEN ns = rs THEN CASE WHEN decided THEN 'agreed' ELSE 'same' END WHEN NOT (decided OR edited) THEN 'updated'
                WHEN ns IS NOT DISTINCT FROM bs THEN 'edited' ELSE 'conflict' END AS outcome FROM j)
        SELECT p_partkey, brand, (CASE WHEN outcome IN ('kept', 'agreed', 'edited', 'conflict') THEN rs ELSE coalesce(ns, rs, bs) END)::INT AS size, status, verified_by, outcome FROM o"""),
]
