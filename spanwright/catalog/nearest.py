"""Cells split among the nearest owners, and the poles of the areas that come of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.areas import _cells, _cells_sql
from spanwright.catalog.query import Query
from spanwright.functions import geo as G
from spanwright.operators import nearest as N
from spanwright.sources.tables import points, points_sql, table


def nearest_split(spark, d):
    """Each customer's cell with the nation of the nearest supplier's."""
    x, y = G.cell(F.col("lon"), F.col("lat"), 4.0)
    seeds = points(table(spark, d, "supplier"), "s_suppkey").select(x.alias("x"), y.alias("y"), F.col("s_nationkey").alias("owner"))
    return N.nearest_split(_cells(spark, d, 4.0), seeds)


SPLIT_SQL = f"""{_cells_sql(4)}, seeds AS (SELECT floor(lon / 4)::BIGINT AS x, floor(lat / 4)::BIGINT AS y, s_nationkey AS owner FROM (SELECT *, {points_sql("s_suppkey")} FROM supplier)),
split AS (SELECT c.x, c.y, min((d2, s.owner)) AS m FROM (SELECT DISTINCT x::BIGINT AS x, y::BIGINT AS y FROM cells) c, LATERAL (SELECT (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2, s.owner FROM seeds s) s GROUP BY c.x, c.y),
areas AS (SELECT x, y, m[2] AS owner, m[1] AS d2 FROM split)"""

Q = [
    Query("nearest_split", "J11", nearest_split, f"WITH {SPLIT_SQL} FROM areas"),
    Query("area_poles", "J6", lambda s, d: N.poles(nearest_split(s, d)), f"""WITH {SPLIT_SQL}, owners AS (SELECT DISTINCT owner FROM areas), box AS (SELECT unnest(range(-48, 49)) AS x, y FROM (SELECT unnest(range(-24, 25)) AS y)),
        outside AS (SELECT o.owner, b.x, b.y FROM owners o CROSS JOIN box b WHERE NOT EXISTS (FROM areas a WHERE a.owner = o.owner AND a.x = b.x AND a.y = b.y)),
        far AS (SELECT a.owner, a.x, a.y, min((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)) AS d2 FROM areas a JOIN outside o USING (owner) GROUP BY ALL)
        SELECT owner, arg_max(x, (d2, -x, -y)) AS x, arg_max(y, (d2, -x, -y)) AS y, max(d2) AS d2 FROM far GROUP BY owner"""),
]
