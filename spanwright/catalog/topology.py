"""Arcs, overlaps between owners, merged attributes and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.catalog.domain import CLAIMS, _claims
from spanwright.catalog.intervals import YEAR
from spanwright.catalog.query import Query
from spanwright.functions import geo as G
from spanwright.functions import years as Y
from spanwright.operators import aggregates as A
from spanwright.operators import cells as C
from spanwright.operators import graph
from spanwright.operators import intervals as I
from spanwright.operators import spatial as S
from spanwright.sources.tables import RECORDS_SQL, points, points_sql, records, table


def decoded_arcs(spark, d):
    """Orders as delta-encoded arcs: absolute positions are running sums along each arc, scaled and moved."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum("l_quantity").over(w).alias("x"))
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.max("x") * 0.5 - 180, 4).alias("east"), F.round(F.sum("x"), 2).alias("sum_x"))


def conflicts(spark, d):
    """Overlapping records of one pid whose kinds differ."""
    r = records(spark, d).select("id", "pid", "from_year", "to_year", "kind")
    other = r.withColumnsRenamed({"id": "id2", "from_year": "f2", "to_year": "t2", "kind": "kind2"})
    pairs = I.interval_join(r, other, ("from_year", "to_year"), ("f2", "t2"), by=["pid"])
    return pairs.filter((F.col("id") < F.col("id2")) & (F.col("kind") != F.col("kind2"))).select("pid", "id", "id2", "kind", "kind2")


def lookup_by_year(spark, d):
    """For each pid and asked year the area alive, of tier 0 if there is any, else of the others."""
    asked = spark.createDataFrame([(-900, -900), (-1, -1), (1, 1), (700, 700)], "y0 int, y1 int")
    j = I.interval_join(records(spark, d), asked, ("from_year", "to_year"), ("y0", "y1"))
    per = j.groupBy("pid", F.col("y0").alias("year")).agg(F.sum(F.when(F.col("tier") == 0, F.col("a"))).alias("main"), F.sum("a").alias("any"))
    return per.select("pid", "year", F.round(F.coalesce("main", "any"), 2).alias("area"))


def overlap_losers(spark, d):
    """Pairs of owners that claim the same cells; the one with fewer cells keeps them (the lesser name among equals)."""
    c = _claims(spark, d).select("x", "y", "owner").distinct()
    size = c.groupBy("owner").agg(F.count("*").alias("n"))
    a = c.join(size, "owner").withColumnsRenamed({"owner": "a", "n": "na"})
    b = c.join(size, "owner").withColumnsRenamed({"owner": "b", "n": "nb"})
    pairs = a.join(b, ["x", "y"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("cells"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pairs.select("a", "b", "cells", F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("loser"))


def dissolved(spark, d):
    """One row for each kind and century: the first values in order, and whether members disagree."""
    r = records(spark, d).withColumn("power", F.when(F.col("tier") == 1, F.col("pid")))
    g = r.groupBy("kind", Y.century(F.col("from_year")).alias("century"))
    return g.agg(F.min_by("pid", F.struct("from_year", "id")).alias("lead"), F.min(F.when(F.col("power").isNotNull(), F.struct("from_year", "id", "power"))).alias("p"), (F.count_distinct("power") > 1).alias("disagree"), F.count("*").alias("members")).select("kind", "century", "lead", F.col("p.power").alias("power"), "disagree", "members")


def shared_borders(spark, d):
    """Lengths of sides that two owners share, in cells."""
    sides = S.cell_sides(C.assigned(_claims(spark, d), "at"), "owner")
    a = sides.filter("direction = 1").select("arc", F.col("owner").alias("a"))
    b = sides.filter("direction = -1").select("arc", F.col("owner").alias("b"))
    return a.join(b, "arc").filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("length"))


def normalised(spark, d):
    """Leaf records with the root of their customer's chain (half the key, down to 8), dropped ones counted by reason."""
    r = records(spark, d)
    reason = F.when(F.col("kind") == "P", "composite").when(F.col("from_year") > 1100, "late").otherwise("kept")
    pid = F.regexp_extract("pid", r"([0-9]+)$", 1).cast("long")
    root = F.floor(pid / F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(pid / 8.0))))).cast("long")
    return r.groupBy(reason.alias("reason"), root.alias("root")).agg(F.count("*").alias("n"), F.max(F.least("to_year", F.lit(1100))).alias("last_year"))


def cap_cull(spark, d):
    """Customers within forty degrees of a centre on the sphere."""
    c = points(table(spark, d, "customer"), "c_custkey")
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(170.0))
    return c.filter(km <= 40 * 3.141592653589793 / 180 * G.EARTH_KM).select("c_custkey", F.round(km, 3).alias("km"))


def watch_list(spark, d):
    p = table(spark, d, "part")
    digits = F.floor(F.log10("p_retailprice")) - 1
    rough = F.when(F.col("p_retailprice") >= 1000, F.floor(F.col("p_retailprice") / F.pow(F.lit(10.0), digits) + 0.5) * F.pow(F.lit(10.0), digits)).otherwise(F.floor(F.col("p_retailprice") + 0.5))
    return p.filter((F.col("p_retailprice") < 950) | F.col("p_size").isin(1, 50)).select("p_partkey", F.concat(F.lit("≈ "), rough.cast("bigint").cast("string")).alias("price_text"))


def visible_units(spark, d):
    """Brands visible through at least one small part; parts visible through their brand."""
    p = table(spark, d, "part")
    small = p.filter("p_size <= 3").select("p_brand").distinct()
    return p.join(small, "p_brand", "left_semi").groupBy("p_brand").agg(F.count("*").alias("parts"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


def prebaked_frame(spark, d):
    """One year's payload in contract order, with label."""
    alive = records(spark, d).filter(Y.alive(F.col("from_year"), F.col("to_year"), YEAR))
    label = A.argmax(alive, ["pid"], [(F.col("tier"), False), (F.col("a"), True), (F.col("id"), False)], ["id"]).withColumnRenamed("id", "label_id")
    return alive.join(label, "pid").select("id", "pid", "from_year", "to_year", "kind", "tier", F.round("a", 2).alias("a"), (F.col("id") == F.col("label_id")).alias("is_label"))


def cross_check(spark, d):
    """Users seen with several kinds of events, and their events whose properties are no JSON."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count(F.when(F.get_json_object("props", "$").isNull(), 1)).alias("bad_props"))


def archive_list(spark, d):
    """Earlier numbers, newest first, a puzzle at most once, for a rotation of five."""
    n = table(spark, d, "nation").select("n_nationkey")
    earlier = F.filter(F.sequence(F.col("n_nationkey") - 1, F.col("n_nationkey") - 4, F.lit(-1)), lambda x: x >= 0)
    return n.select("n_nationkey", F.posexplode(earlier).alias("pos", "number"))


def map_parts(spark, d):
    """Connected customers of a segment: cells that touch, as parts with their size."""
    c = _claims(spark, d).select("x", "y").distinct()
    parts = S.raster_components(c)
    return parts.groupBy("component").agg(F.count("*").alias("cells")).groupBy("cells").agg(F.count("*").alias("parts"))


def trade_roots(spark, d):
    """Suppliers and customers of a nation as one graph: members by component."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + 10_000_000).cast("long").alias("b"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 20_000_000).alias("a"), (F.col("s_nationkey") + 10_000_000).cast("long").alias("b"))
    return graph.components(c.unionByName(s)).groupBy("component").agg(F.count("*").alias("members"))


Q = [
    Query("decoded_arcs", "A8 A9 I38", decoded_arcs, """WITH x AS (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS x FROM lineitem)
        SELECT l_orderkey, count(*) AS n, round(max(x) * 0.5 - 180, 4)::DOUBLE AS east, round(sum(x), 2) AS sum_x FROM x GROUP BY 1"""),
    Query("attribute_conflicts", "D22", conflicts, f"""WITH {RECORDS_SQL} SELECT a.pid, a.id, b.id AS id2, a.kind, b.kind AS kind2 FROM recs a JOIN recs b ON a.pid = b.pid AND a.id < b.id AND a.kind <> b.kind AND a.from_year <= b.to_year AND b.from_year <= a.to_year"""),
    Query("lookup_by_year", "D8", lookup_by_year, f"""WITH {RECORDS_SQL}, y AS (SELECT unnest([-900, -1, 1, 700])::INT AS year) SELECT pid, year, round(coalesce(sum(a) FILTER (WHERE tier = 0), sum(a)), 2) AS area FROM recs JOIN y ON from_year <= year AND to_year >= year GROUP BY 1, 2"""),
    Query("overlap_losers", "D14 L3", overlap_losers, f"""WITH {CLAIMS}, c AS (SELECT DISTINCT x, y, owner FROM claims), n AS (SELECT owner, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.owner AS a, b.owner AS b, count(*) AS cells FROM c a JOIN c b ON a.x = b.x AND a.y = b.y AND a.owner < b.owner GROUP BY 1, 2)
        SELECT a, b, cells, CASE WHEN x.n <= y.n THEN b ELSE a END AS loser FROM p JOIN n x ON x.owner = a JOIN n y ON y.owner = b"""),
    Query("dissolved", "E10 E9 K15", dissolved, f"""WITH {RECORDS_SQL} SELECT kind, (CASE WHEN from_year > 0 THEN ceil(from_year / 100) ELSE -ceil(-from_year / 100) END)::INT AS century, arg_min(pid, (from_year, id)) AS lead,
        arg_min(pid, (from_year, id)) FILTER (WHERE tier = 1) AS power, count(DISTINCT CASE WHEN tier = 1 THEN pid END) > 1 AS disagree, count(*) AS members FROM recs GROUP BY 1, 2"""),
    Query("shared_borders", "J20 J19", shared_borders, f"""WITH {CLAIMS}, o AS (SELECT x, y, arg_max(owner, seq) AS owner FROM claims GROUP BY x, y),
        p AS (SELECT a.owner AS u, b.owner AS v FROM o a JOIN o b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1) WHERE a.owner <> b.owner) SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS length FROM p GROUP BY 1, 2"""),
    Query("normalised_records", "K1 C6 D9", normalised, f"""WITH {RECORDS_SQL}, k AS (SELECT *, regexp_extract(pid, '([0-9]+)$', 1)::BIGINT AS p FROM recs)
        SELECT CASE WHEN kind = 'P' THEN 'composite' WHEN from_year > 1100 THEN 'late' ELSE 'kept' END AS reason, floor(p / pow(2, greatest(0, floor(log2(p / 8.0)))))::BIGINT AS root, count(*) AS n, max(least(to_year, 1100))::INT AS last_year FROM k GROUP BY 1, 2"""),
    Query("cap_cull", "C21 I18", cap_cull, f"""WITH c AS (SELECT c_custkey, {points_sql("c_custkey")} FROM customer), k AS (SELECT c_custkey, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, greatest(0, pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(170 - lon) / 2), 2))))) AS km FROM c)
        SELECT c_custkey, round(km, 3) AS km FROM k WHERE km <= 40 * 3.141592653589793::DOUBLE / 180 * 6371"""),
    Query("watch_list", "C23 I23", watch_list, """WITH p AS (SELECT *, pow(10, floor(log10(p_retailprice)) - 1) AS u FROM part WHERE p_retailprice < 950 OR p_size IN (1, 50))
        SELECT p_partkey, '≈ ' || (CASE WHEN p_retailprice >= 1000 THEN floor(p_retailprice / u + 0.5) * u ELSE floor(p_retailprice + 0.5) END)::BIGINT AS price_text FROM p"""),
    Query("visible_units", "C8 C11 A14", visible_units, "SELECT p_brand, count(*) AS parts, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size <= 3) GROUP BY 1"),
    Query("prebaked_frame", "C15 K31 K32", prebaked_frame, f"""WITH {RECORDS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tier, a DESC, id) = 1 AS is_label FROM recs WHERE from_year <= {YEAR} AND to_year >= {YEAR}) SELECT id, pid, from_year, to_year, kind, tier, round(a, 2) AS a, is_label FROM a"""),
    Query("cross_check", "E12", cross_check, "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE NOT json_valid(props)) AS bad_props FROM events GROUP BY 1"),
    Query("archive_list", "G13", archive_list, "WITH e AS (SELECT n_nationkey, unnest(range(0, 4)) AS pos FROM nation) SELECT n_nationkey, pos::INT AS pos, (n_nationkey - 1 - pos)::INT AS number FROM e WHERE n_nationkey - 1 - pos >= 0"),
    Query("map_parts", "J17", map_parts, None),
    Query("trade_roots", "D29", trade_roots, "SELECT min(c_custkey) AS component, count(*) + (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) + 1 AS members FROM customer GROUP BY c_nationkey"),
]
