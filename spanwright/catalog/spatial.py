"""Points, cells, rings and arcs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.query import Query
from spanwright.functions import geo as G
from spanwright.operators import spatial as S
from spanwright.sources.tables import points, points_sql, table


def _customers(spark, d):
    return points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lon", "lat")


def _suppliers(spark, d):
    return points(table(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), "lon", "lat")


PTS = f"c AS (SELECT c_custkey AS id, {points_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey AS id, {points_sql('s_suppkey')} FROM supplier)"


def cell_join(spark, d):
    return S.counted_within(_customers(spark, d), _suppliers(spark, d), 5.0)


def knn_ratio(spark, d):
    return S.nearest_unless_ambiguous(_customers(spark, d), _suppliers(spark, d), 12.0, 1.5)


def _polygons(spark, d):
    n = table(spark, d, "nation")
    x, y = (F.col("n_nationkey") * 53 % 300 - 150).cast("double"), (F.col("n_nationkey") * 29 % 120 - 60).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return n.select(F.col("n_nationkey").alias("poly"), F.array(at(-20.5, -15.5), at(20.5, -10.5), at(5.25, 0.25), at(18.5, 17.5), at(-12.5, 14.5), at(-20.5, -15.5)).alias("ring"))


def point_in_polygon(spark, d):
    return S.points_in_polygons(_customers(spark, d), _polygons(spark, d), 10.0)


def ring_areas(spark, d):
    return _polygons(spark, d).select("poly", F.round(G.ring_area_km2(F.col("ring")), 2).alias("km2"))


RING = """r AS (SELECT n_nationkey AS poly, (n_nationkey * 53 % 300 - 150)::DOUBLE AS x, (n_nationkey * 29 % 120 - 60)::DOUBLE AS y FROM nation),
o AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([-20.5, 20.5, 5.25, 18.5, -12.5, -20.5]::DOUBLE[]) AS dx, unnest([-15.5, -10.5, 0.25, 17.5, 14.5, -15.5]::DOUBLE[]) AS dy),
v AS (SELECT poly, i, x + dx AS x, y + dy AS y FROM r, o), e AS (SELECT a.poly, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bby FROM v a JOIN v b ON a.poly = b.poly AND b.i = a.i + 1)"""


def mercator_tiles(spark, d):
    x, y = G.mercator_tile(F.col("lon"), F.col("lat"), 4)
    return _customers(spark, d).groupBy(x.alias("tx"), y.alias("ty")).agg(F.count("*").alias("n"))


def _cells(spark, d, size=4.0):
    cx, cy = G.cell(F.col("lon"), F.col("lat"), size)
    return _customers(spark, d).select(cx.alias("x"), cy.alias("y")).distinct()


def _owned(spark, d):
    """Cells of eight degrees, each with the nation of its least customer."""
    cx, cy = G.cell(F.col("lon"), F.col("lat"), 8.0)
    c = points(table(spark, d, "customer"), "c_custkey")
    return c.groupBy(cx.alias("x"), cy.alias("y")).agg(F.min_by("c_nationkey", "c_custkey").alias("owner"))


def arc_uses(spark, d):
    uses = S.classified_arcs(S.cell_sides(_owned(spark, d), "owner"))
    return uses.groupBy("use").agg(F.count("*").alias("n"))


def distances(spark, d):
    """Each customer's distance to the supplier with its key in the supplier's range, and what a guess there scores."""
    c, s = _customers(spark, d), _suppliers(spark, d).withColumnsRenamed({"id": "s_id", "lon": "slon", "lat": "slat"})
    n = s.agg(F.max("s_id").alias("m"))
    joined = c.crossJoin(F.broadcast(n)).withColumn("s_id", F.col("id") % F.col("m") + 1).join(s, "s_id")
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    score = F.when(km <= 10, 5000).otherwise(F.floor(5000 * F.exp(-(km - 10) / 1200) + 0.5))
    return joined.select("id", F.round(km, 4).alias("km"), score.cast("long").alias("place_score"))


def extents(spark, d):
    box = _customers(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id").groupBy("c_nationkey").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return box.select("c_nationkey", F.round(G.box_extent(F.col("w"), F.col("s"), F.col("e"), F.col("n")), 4).alias("extent"))


Q = [
    Query("spatial_cell_join", "C20 D10 D11 J16", cell_join, f"WITH {PTS} SELECT s.id AS r_id, count(*) AS n, min(pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2)) AS d2, min(c.id) AS first_id FROM c JOIN s ON pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2) <= 25 GROUP BY 1"),
    Query("knn_ratio", "D12 D13 J11", knn_ratio, f"""WITH {PTS}, p AS (SELECT c.id, s.id AS r, pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2) AS d FROM c JOIN s ON pow(c.lon - s.lon, 2) + pow(c.lat - s.lat, 2) <= 144),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r) AS k FROM p), t AS (SELECT id, max(r) FILTER (WHERE k = 1) AS r, max(d) FILTER (WHERE k = 1) AS d1, max(d) FILTER (WHERE k = 2) AS d2 FROM k GROUP BY id),
        x AS (SELECT c.id, t.r, CASE WHEN t.r IS NULL THEN 'none' WHEN d2 IS NULL THEN 'alone' WHEN d1 * 2.25 <= d2 THEN 'nearer' ELSE 'ambiguous' END AS reason FROM c LEFT JOIN t USING (id))
        SELECT id, CASE WHEN reason IN ('alone', 'nearer') THEN r END AS nearest, reason FROM x"""),
    Query("point_in_polygon", "D12 J3", point_in_polygon, f"""WITH {PTS}, {RING} SELECT c.id, poly FROM c JOIN e ON (ay > lat) <> (bby > lat) AND lon < (bx - ax) * (lat - ay) / (bby - ay) + ax GROUP BY c.id, poly HAVING count(*) % 2 = 1"""),
    Query("ring_areas", "J1 J4", ring_areas, f"WITH {RING} SELECT poly, round(abs(sum(radians(bx - ax) * (2 + sin(radians(bby)) + sin(radians(ay))))) * 6371.0 * 6371.0 / 2, 2) AS km2 FROM e GROUP BY poly"),
    Query("mercator_tiles", "J18 K23", mercator_tiles, f"""WITH {PTS}, t AS (SELECT floor((lon + 180) / 360 * 16)::INT AS tx, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 16)::INT AS ty FROM c)
        SELECT least(15, greatest(0, tx))::INT AS tx, least(15, greatest(0, ty))::INT AS ty, count(*) AS n FROM t GROUP BY 1, 2"""),
    Query("raster_components", "J17 D29", lambda s, d: S.raster_components(_cells(s, d)).groupBy("component").agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.max("y").alias("y1")), f"""WITH RECURSIVE {PTS}, n AS (SELECT DISTINCT floor(lon / 4)::INT AS x, floor(lat / 4)::INT AS y FROM c),
        w AS (SELECT *, (x + 100000)::BIGINT * 1000000 + y + 100000 AS node FROM n), g AS (SELECT node, node AS m FROM w UNION SELECT b.node, g.m FROM g JOIN w a ON a.node = g.node JOIN w b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
        l AS (SELECT node, min(m) AS component FROM g GROUP BY node) SELECT component, count(*) AS cells, min(x) AS x0, max(y) AS y1 FROM l JOIN w USING (node) GROUP BY component"""),
    Query("arc_uses", "E18 J15 J19", arc_uses, f"""WITH {PTS}, o AS (SELECT floor(lon / 8)::INT AS x, floor(lat / 8)::INT AS y, arg_min(c_nationkey, c_custkey) AS owner FROM c JOIN customer ON c_custkey = id GROUP BY 1, 2),
        d AS (SELECT owner, x || ':' || y || ':h' AS arc, 1 AS d FROM o UNION ALL SELECT owner, (x + 1) || ':' || y || ':v', 1 FROM o UNION ALL SELECT owner, x || ':' || (y + 1) || ':h', -1 FROM o UNION ALL SELECT owner, x || ':' || y || ':v', -1 FROM o),
        n AS (SELECT arc, owner, sum(d) AS net FROM d GROUP BY ALL HAVING sum(d) <> 0), p AS (SELECT arc, count(*) AS n, sum(net) AS s FROM n GROUP BY arc)
        SELECT CASE WHEN n = 1 THEN 'coast' WHEN n = 2 AND s = 0 THEN 'border' ELSE 'overlap' END AS use, count(*) AS n FROM p GROUP BY 1"""),
    Query("where_when_score", "I18 I19 K34 J2", distances, f"""WITH {PTS}, j AS (SELECT c.id, 6371 * 2 * asin(sqrt(least(1, greatest(0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))) AS km FROM c JOIN s ON s.id = c.id % (SELECT max(id) FROM s) + 1)
        SELECT id, round(km, 4) AS km, (CASE WHEN km <= 10 THEN 5000 ELSE floor(5000 * exp(-(km - 10) / 1200) + 0.5) END)::BIGINT AS place_score FROM j"""),
    Query("box_extents", "J5 J10", extents, f"""WITH {PTS}, b AS (SELECT c_nationkey, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM c JOIN customer ON c_custkey = id GROUP BY 1)
        SELECT c_nationkey, round((e - w) * (n - s) * cos(radians((s + n) / 2)), 4) AS extent FROM b"""),
]
