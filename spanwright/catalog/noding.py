"""Rings of customers noded with each other and freed of spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.query import Query
from spanwright.operators import noding as N
from spanwright.sources.tables import table

EPS, CELL = 0.25, 1.0


def ring_points(spark, d):
    """A box for each customer, in tenths of a degree off the grid; some with a way out and back, a repeated vertex, or no area."""
    k = F.col("c_custkey")
    x, y, w, h = (k * 37) % 360 - 180 + (k % 3) / 10, (k * 17) % 160 - 80 + (k % 4) / 10, k % 7 + 1, k % 5 + 1
    p = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    a, b, c, e = p(F.lit(0), F.lit(0)), p(w, F.lit(0)), p(w, h), p(F.lit(0), h)
    box = F.when(k % 10 == 0, F.array(a, c, a)).when(k % 4 == 1, F.array(a, b, c, p(w + 9, h), p(w + 9, h + 2), p(w + 9, h), c, e, a)).when(k % 9 == 2, F.array(a, b, b, c, e, a)).otherwise(F.array(a, b, c, e, a))
    return table(spark, d, "customer").select(k.alias("ring"), F.posexplode(box).alias("place", "p")).select("ring", "place", "p.*")


def noded_rings(spark, d):
    return N.noded(N.open_rings(ring_points(spark, d)), EPS, cell=CELL).select("ring", "place", "x", "y")


def cleaned_rings(spark, d):
    """The sides of the rings that are left; which vertex a ring starts from is not said."""
    clean = N.despiked(N.noded(N.open_rings(ring_points(spark, d)), EPS, cell=CELL))
    return N.sides(clean).select("ring", "ax", "ay", "bx", "by")


#: The rings with what is near their sides, found by comparing vertices with all sides whose bounding box they are near to.
NODED_SQL = f"""k AS (SELECT c_custkey AS k, (c_custkey * 37) % 360 - 180 + (c_custkey % 3)::DOUBLE / 10 AS x, (c_custkey * 17) % 160 - 80 + (c_custkey % 4)::DOUBLE / 10 AS y, c_custkey % 7 + 1 AS w, c_custkey % 5 + 1 AS h FROM customer),
boxes AS (SELECT k, CASE WHEN k % 10 = 0 THEN [[x, y], [x + w, y + h]] WHEN k % 4 = 1 THEN [[x, y], [x + w, y], [x + w, y + h], [x + w + 9, y + h], [x + w + 9, y + h + 2], [x + w + 9, y + h], [x + w, y + h], [x, y + h]]
  WHEN k % 9 = 2 THEN [[x, y], [x + w, y], [x + w, y], [x + w, y + h], [x, y + h]] ELSE [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] END AS p FROM (SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM k)),
v AS (SELECT k AS ring, i - 1 AS place, p[i][1] AS x, p[i][2] AS y, p[i % len(p) + 1][1] AS bx, p[i % len(p) + 1][2] AS by FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM boxes)),
near AS (SELECT *, px * ux + py * uy AS along FROM (SELECT s.ring, s.place, q.x, q.y, s.bx - s.x AS ux, s.by - s.y AS uy, q.x - s.x AS px, q.y - s.y AS py, q.x - s.bx AS qx, q.y - s.by AS qy
  FROM v s JOIN (SELECT DISTINCT x, y FROM v) q ON q.x BETWEEN least(s.x, s.bx) - 1 AND greatest(s.x, s.bx) + 1 AND q.y BETWEEN least(s.y, s.by) - 1 AND greatest(s.y, s.by) + 1)),
noded AS (SELECT ring, row_number() OVER (PARTITION BY ring ORDER BY place, along, x, y) - 1 AS place, x, y FROM (SELECT ring, place, 0.0::DOUBLE AS along, x, y FROM v
  UNION ALL SELECT ring, place, along, x, y FROM near WHERE along > 0 AND along < ux * ux + uy * uy AND (ux * py - uy * px) * (ux * py - uy * px) <= {EPS * EPS}::DOUBLE * (ux * ux + uy * uy) AND px * px + py * py > {EPS * EPS}::DOUBLE AND qx * qx + qy * qy > {EPS * EPS}::DOUBLE))"""

#: A walk along each ring that takes back repeats and ways out and back, then the seam from both ends.
CLEANED_SQL = """walked AS (SELECT ring, list_reduce(list([{x: x, y: y}] ORDER BY place), lambda w, p: CASE WHEN w[-1] = p[1] THEN w WHEN len(w) > 1 AND w[-2] = p[1] THEN w[:-2] ELSE w || p END) AS w FROM noded GROUP BY ring),
seam AS (SELECT ring, w, false AS ended FROM walked UNION ALL SELECT ring,
  CASE WHEN len(w) < 2 THEN w WHEN w[1] = w[-1] OR w[1] = w[-2] THEN w[:-2] WHEN w[2] = w[-1] THEN w[2:] ELSE w END,
  len(w) < 2 OR NOT (w[1] = w[-1] OR w[1] = w[-2] OR w[2] = w[-1]) FROM seam WHERE NOT ended),
clean AS (SELECT ring, w FROM seam WHERE ended AND len(w) > 2)
SELECT ring, w[i].x AS ax, w[i].y AS ay, w[i % len(w) + 1].x AS bx, w[i % len(w) + 1].y AS by FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM clean)"""

Q = [
    Query("noded_rings", "J13", noded_rings, f"WITH {NODED_SQL} SELECT ring, place, x, y FROM noded"),
    Query("cleaned_rings", "J13", cleaned_rings, f"WITH RECURSIVE {NODED_SQL}, {CLEANED_SQL}"),
]
