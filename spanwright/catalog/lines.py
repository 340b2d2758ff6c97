"""Lines in order: simplified arcs of cell maps and simplified histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.areas import SIDES_SQL, _map
from spanwright.catalog.query import Query
from spanwright.operators import cells as C
from spanwright.operators import lines as L
from spanwright.operators import rings as R
from spanwright.plans.materialise import checkpointed
from spanwright.sources.tables import table


def arc_points(spark, d):
    """The corners and ends of the map's arcs in the walk of the lesser owner, with the tolerance (cells) that suits the smaller area of both."""
    cells = checkpointed(_map(spark, d))
    walks = checkpointed(R.arcs(cells))
    size = C.simplify_interval(F.count("*") * 36, F.lit(1), 1.5, 0.5)
    tolerance = cells.groupBy("owner").agg(size.alias("tolerance"))
    across = tolerance.select(F.col("owner").alias("other"), F.col("tolerance").alias("tolerance_across"))
    lesser = walks.groupBy("arc").agg(F.min("owner").alias("owner"))
    item = F.col("item")
    at = walks.join(lesser, ["arc", "owner"]).join(tolerance, "owner").join(across, "other", "left").select(
        "arc", "rank", (item % 4).cast("int").alias("d"), (F.floor(item / 4) % (2 * R.HALF) - R.HALF).cast("int").alias("y"), (F.floor(item / (8 * R.HALF)) - R.HALF).cast("int").alias("x"),
        F.least("tolerance", "tolerance_across").alias("tolerance"),
    )
    px, py = R.start_of(at)
    step = lambda one, back: F.when(F.col("d") == one, 1).when(F.col("d") == back, -1).otherwise(0)
    ends = F.array(F.struct(F.col("rank").alias("place"), px.alias("x"), py.alias("y")), F.struct((F.col("rank") + 1).alias("place"), (px + step(0, 2)).alias("x"), (py + step(1, 3)).alias("y")))
    return at.select(F.col("arc").alias("line"), F.explode(ends).alias("p"), "tolerance").select("line", "p.*", "tolerance")


def event_points(spark, d):
    """The values of each type of event over their numbers: a few long lines."""
    return table(spark, d, "events").select(F.col("event_type").alias("line"), F.col("event_id").alias("place"), F.col("event_id").alias("x"), F.floor(F.col("value")).alias("y"), F.lit(60.0).alias("tolerance"))


ARC_POINTS_SQL = f"""{SIDES_SQL}, u AS (SELECT *, least(item, across) AS side FROM sides),
meet AS (SELECT px, py FROM (SELECT px, py, side FROM u UNION SELECT px + dx, py + dy, side FROM u) GROUP BY px, py HAVING count(*) > 2),
ahead AS (SELECT s.item, CASE WHEN (n.px, n.py) NOT IN (SELECT (px, py) FROM meet) THEN s.next END AS next, (s.px, s.py) IN (SELECT (px, py) FROM meet) AS starts FROM sides s JOIN sides n ON n.item = s.next),
straight AS (SELECT item AS head, item, 0 AS rank FROM ahead WHERE starts UNION ALL SELECT w.head, a.next, w.rank + 1 FROM straight w JOIN ahead a USING (item) WHERE a.next IS NOT NULL),
rest AS (SELECT item, next FROM ahead WHERE item NOT IN (SELECT item FROM straight)),
around AS (SELECT item, next AS step FROM rest UNION SELECT w.item, r.next FROM around w JOIN rest r ON w.step = r.item),
round_heads AS (SELECT item FROM around GROUP BY item HAVING min(step) = item),
circle AS (SELECT item AS head, item, 0 AS rank FROM round_heads UNION ALL SELECT w.head, r.next, w.rank + 1 FROM circle w JOIN rest r USING (item) WHERE r.next <> w.head),
walk AS (SELECT * FROM (FROM straight UNION ALL FROM circle) JOIN u USING (item)),
named AS (SELECT *, min(side) OVER (PARTITION BY head) AS arc FROM walk), chosen AS (SELECT *, min(owner) OVER (PARTITION BY arc) AS lesser FROM named),
size AS (SELECT owner, least(1.5::DOUBLE, greatest(0.5::DOUBLE, sqrt(count(*) * 36) / 50)) AS tol FROM map GROUP BY owner),
sided AS (SELECT c.*, least(s.tol, o.tol) AS tol FROM chosen c JOIN size s ON s.owner = c.owner LEFT JOIN size o ON o.owner = c.other WHERE c.owner = lesser),
pts AS (SELECT DISTINCT line, place, x, y, tol FROM (SELECT arc AS line, rank AS place, px AS x, py AS y, tol FROM sided UNION ALL SELECT arc, rank + 1, px + dx, py + dy, tol FROM sided)),"""

#: Segments of the lines in `pts` and the parts that they are split into; their ends are what stays.
SIMPLIFIED_SQL = """p AS (SELECT line, place::BIGINT AS place, x::DOUBLE AS x, y::DOUBLE AS y, tol FROM pts),
seg AS (SELECT line, min(place) AS a, max(place) AS b, CASE WHEN arg_min(x, place) = arg_max(x, place) AND arg_min(y, place) = arg_max(y, place) THEN 2 ELSE 0 END AS must FROM p GROUP BY line
  UNION ALL SELECT line, unnest([a, mid]), unnest([mid, b]), must - 1 FROM (
    SELECT line, a, b, must, arg_max(place, (d2, -place)) AS mid, max(d2) AS d2, any_value(tol) AS tol FROM (
      SELECT *, CASE WHEN ux * ux + uy * uy = 0 OR px * ux + py * uy <= 0 THEN px * px + py * py WHEN px * ux + py * uy >= ux * ux + uy * uy THEN qx * qx + qy * qy ELSE (ux * py - uy * px) * (ux * py - uy * px) / (ux * ux + uy * uy) END AS d2
      FROM (SELECT s.line, s.a, s.b, s.must, i.place, i.tol, b.x - a.x AS ux, b.y - a.y AS uy, i.x - a.x AS px, i.y - a.y AS py, i.x - b.x AS qx, i.y - b.y AS qy
            FROM seg s JOIN p a ON a.line = s.line AND a.place = s.a JOIN p b ON b.line = s.line AND b.place = s.b JOIN p i ON i.line = s.line AND i.place > s.a AND i.place < s.b))
    GROUP BY line, a, b, must) WHERE d2 > tol * tol OR (must > 0 AND d2 > 0))
SELECT p.line, p.place, p.x, p.y FROM p JOIN (SELECT line, a AS place FROM seg UNION SELECT line, b FROM seg) USING (line, place)"""

Q = [
    Query("simplified_arcs", "J14 J15", lambda s, d: L.simplified(arc_points(s, d)), f"WITH RECURSIVE {ARC_POINTS_SQL} {SIMPLIFIED_SQL}"),
    Query("simplified_values", "J14", lambda s, d: L.simplified(event_points(s, d)), f"WITH RECURSIVE pts AS (SELECT event_type AS line, event_id AS place, event_id AS x, floor(value) AS y, 60.0::DOUBLE AS tol FROM events), {SIMPLIFIED_SQL}"),
]
