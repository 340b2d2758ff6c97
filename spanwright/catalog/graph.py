"""Graphs, greedy plans, quiz logic, colours and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.intervals import ASTRO
from spanwright.catalog.query import Query
from spanwright.functions import colour as C
from spanwright.functions.text import fnv1a
from spanwright.functions.years import to_astronomical
from spanwright.operators import games, graph
from spanwright.plans.materialise import sorted_side
from spanwright.plans.packing import collected_costs, furthest_within
from spanwright.sources.tables import RECORDS_SQL, records, table


def _tree(spark, d):
    """Each customer below the one with half its key."""
    return table(spark, d, "customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"))


def reachability(spark, d):
    return graph.reachable(_tree(spark, d)).groupBy("a").agg(F.count("*").alias("ancestors"), F.min("b").alias("root"))


def topological_levels(spark, d):
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").filter("c_custkey > 1").select(F.explode(F.array(F.floor(k / 2), F.greatest(F.lit(1), F.floor(k / 3)))).alias("a"), k.alias("b"))
    return graph.levels(edges)[0]


def order_components(spark, d):
    """Parts bought together, counted by component."""
    x = table(spark, d, "lineitem")
    first = x.groupBy("l_orderkey").agg(F.min("l_partkey").alias("b"))
    edges = x.join(sorted_side(first), "l_orderkey").select(F.col("l_partkey").alias("a"), "b")
    return graph.components(edges).groupBy("component").agg(F.count("*").alias("parts"))


def recipe_route(spark, d):
    """Items 3 to 12, a catalogue of recipes: k is made of k - 1 and k / 2, starting from items 1 and 2."""
    k = F.col("p_partkey")
    recipes = table(spark, d, "part").filter("p_partkey BETWEEN 3 AND 12").select((k - 1).alias("x"), F.floor(k / 2).alias("y"), k.alias("result"))
    known = table(spark, d, "part").filter("p_partkey BETWEEN 1 AND 2").select(F.col("p_partkey").alias("item"))
    return graph.recipe_costs(recipes, known)


def recipe_route_all(spark, d):
    """All parts as recipes: k is made of k / 2 and k / 3, starting from the items up to 2."""
    k = F.col("p_partkey")
    recipes = table(spark, d, "part").filter("p_partkey > 2").select(F.floor(k / 2).alias("x"), F.floor(k / 3).alias("y"), k.alias("result"))
    return graph.recipe_costs(recipes, table(spark, d, "part").filter("p_partkey <= 2").select(k.alias("item")))


def greedy_chunks(spark, d):
    """Decades packed into chunks of at most 1200 records and 30 decades, with a break at the year 1."""
    decade = F.floor(to_astronomical(F.col("from_year")) / 10).cast("int")
    at, costs = collected_costs(records(spark, d).groupBy(decade.alias("decade")).agg(F.count("*").alias("n")), "decade", "n")
    ranges = furthest_within(costs, 1200, 30, [i for i, x in enumerate(at) if x >= 0][:1])
    rows = [(i, at[a], at[z], int(sum(costs[a : z + 1]))) for i, (a, z) in enumerate(ranges)]
    return spark.createDataFrame(rows, "chunk int, first_decade int, last_decade int, records long")


def dsatur_colours(spark, d):
    """Nations coloured by the trade between them: customers' and suppliers' nations of line items."""
    x, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    edges = x.join(o, x.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("a <> b")
    edges = edges.groupBy("a", "b").agg(F.count("*").alias("w"))
    return spark.createDataFrame(sorted(graph.coloured(edges, 6).items()), "nation int, slot int")


def insertion_valid(spark, d):
    o = table(spark, d, "orders").withColumn("rank", F.struct("o_orderdate", "o_orderkey"))
    return games.valid_insertion(o, "o_custkey", "rank", "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_custkey", "place")


def judge_groups(spark, d):
    """The first four suppliers of each order against the suppliers of four return flags and statuses."""
    x = table(spark, d, "lineitem").withColumn("grp", F.concat("l_returnflag", "l_linestatus"))
    lines = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "grp"))).alias("x"))
    four = F.slice(F.transform("x", lambda r: r["l_suppkey"]), 1, 4)
    names = F.array_distinct(F.transform("x", lambda r: r["grp"]))
    groups = F.transform(names, lambda g: F.transform(F.filter("x", lambda r: r["grp"] == g), lambda r: r["l_suppkey"]))
    return lines.select("l_orderkey", games.judged(four, groups).alias("verdict"))


def nation_colours(spark, d):
    n = table(spark, d, "nation")
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(fnv1a(F.col("n_nationkey").cast("string")) % 16777216)), 6, "0"))
    n = n.select("n_nationkey", colour.alias("colour"))
    return n.select("n_nationkey", "colour", F.round(C.luminance(F.col("colour")), 6).alias("luminance"), F.round(C.contrast(F.col("colour"), F.lit("#ffffff")), 4).alias("contrast"), C.mixed(F.col("colour"), F.lit("#ffffff"), 0.5).alias("pale"))


def fnv_slot(spark, d):
    return table(spark, d, "customer").select("c_custkey", fnv1a(F.col("c_custkey").cast("string")).alias("hash"), (fnv1a(F.col("c_custkey").cast("string")) % 12).alias("slot"))


HASH = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
LIN = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"
Q = [
    Query("reachability", "K27 D9", reachability, """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a, count(*) AS ancestors, min(b) AS root FROM r GROUP BY a"""),
    Query("topological_levels", "G8", topological_levels, """WITH RECURSIVE e AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_custkey > 1 UNION SELECT greatest(1, c_custkey // 3), c_custkey FROM customer WHERE c_custkey > 1),
        l AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT e.b, l.level + 1 FROM l JOIN e ON e.a = l.node) SELECT node, max(level)::INT AS level FROM l GROUP BY node"""),
    Query("order_components", "D15 D29", order_components, None),
    Query("recipe_route", "K36", recipe_route, """WITH RECURSIVE c AS (SELECT 2 AS k, [0, 0]::BIGINT[] AS cost UNION ALL SELECT k + 1, list_append(cost, 1 + cost[k] + CASE WHEN k = (k + 1) // 2 THEN 0 ELSE cost[(k + 1) // 2] END) FROM c WHERE k < 12)
        SELECT unnest(range(1, 13))::BIGINT AS item, unnest(cost) AS cost FROM c WHERE k = 12"""),
    Query("recipe_route_all", "K36", recipe_route_all, None),
    Query("greedy_chunks", "F16 F17 O1", greedy_chunks, f"""WITH RECURSIVE {RECORDS_SQL}, c AS (SELECT decade, n, row_number() OVER (ORDER BY decade) AS i FROM (SELECT floor({ASTRO.format("from_year")} / 10.0)::INT AS decade, count(*) AS n FROM recs GROUP BY 1)),
        b AS (SELECT min(i) AS i FROM c WHERE decade >= 0),
        w AS (SELECT i, decade, n, 0 AS chunk, n AS total, 1 AS len FROM c WHERE i = 1 UNION ALL
          SELECT c.i, c.decade, c.n, CASE WHEN w.len >= 30 OR c.i = b.i OR w.total + c.n > 1200 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.len >= 30 OR c.i = b.i OR w.total + c.n > 1200 THEN c.n ELSE w.total + c.n END, CASE WHEN w.len >= 30 OR c.i = b.i OR w.total + c.n > 1200 THEN 1 ELSE w.len + 1 END
          FROM w JOIN c ON c.i = w.i + 1, b)
        SELECT chunk, min(decade) AS first_decade, max(decade) AS last_decade, sum(n)::BIGINT AS records FROM w GROUP BY chunk"""),
    Query("dsatur_colours", "K17 K18", dsatur_colours, None),
    Query("insertion_valid", "K35", insertion_valid, """WITH r AS (SELECT o_custkey, o_orderdate AS d, row_number() OVER w AS place, lead(o_orderdate) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT o_custkey, place::INT AS place FROM r WHERE d <= TIMESTAMP '1998-01-01' AND (nxt IS NULL OR TIMESTAMP '1998-01-01' <= nxt) UNION ALL SELECT o_custkey, 0 FROM r WHERE place = 1 AND TIMESTAMP '1998-01-01' <= d"""),
    Query("judge_groups", "K37 E24", judge_groups, """WITH l AS (SELECT l_orderkey, l_suppkey, l_returnflag || l_linestatus AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem),
        s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS dn FROM l WHERE k <= 4 GROUP BY l_orderkey),
        g AS (SELECT l_orderkey, grp, count(DISTINCT l_suppkey) AS hit FROM l WHERE (l_orderkey, l_suppkey) IN (SELECT (l_orderkey, l_suppkey) FROM l WHERE k <= 4) GROUP BY ALL),
        m AS (SELECT l_orderkey, max(hit) AS most FROM g GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN n <> 4 OR dn <> 4 THEN 'invalid' WHEN most = 4 THEN 'correct' WHEN most = 3 THEN 'one-away' ELSE 'wrong' END AS verdict FROM s JOIN m USING (l_orderkey)"""),
    Query("daily_counter", "F23 I21 M3", lambda s, d: games.daily_counter(table(s, d, "events"), "user_id", "ts"), "SELECT user_id, count(DISTINCT ts::DATE) - 1 AS position, max(ts::DATE) AS last_day FROM events GROUP BY user_id"),
    Query("throttle_windows", "M4", lambda s, d: games.throttled(table(s, d, "events"), "user_id", "ts", 3, 60 * 24), "SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS window, count(*) AS attempts, greatest(0, count(*) - 3)::BIGINT AS blocked FROM events GROUP BY 1, 2"),
    Query("nation_colours", "I24", nation_colours, f"""WITH h AS (SELECT n_nationkey, ({HASH.format("n_nationkey::VARCHAR")} % 16777216)::BIGINT AS v FROM nation), c AS (SELECT n_nationkey, v // 65536 AS r, (v // 256) % 256 AS g, v % 256 AS b FROM h),
        l AS (SELECT *, 0.2126::DOUBLE * {LIN.format("(r / 255)")} + 0.7152::DOUBLE * {LIN.format("(g / 255)")} + 0.0722::DOUBLE * {LIN.format("(b / 255)")} AS y FROM c)
        SELECT n_nationkey, printf('#%02x%02x%02x', r, g, b) AS colour, round(y, 6) AS luminance, round(1.05::DOUBLE / (y + 0.05), 4) AS contrast,
          printf('#%02x%02x%02x', floor(r + (255 - r) * 0.5 + 0.5)::BIGINT, floor(g + (255 - g) * 0.5 + 0.5)::BIGINT, floor(b + (255 - b) * 0.5 + 0.5)::BIGINT) AS pale FROM l"""),
    Query("fnv_slot", "I17", fnv_slot, f"SELECT c_custkey, {HASH.format('c_custkey::VARCHAR')}::BIGINT AS hash, ({HASH.format('c_custkey::VARCHAR')} % 12)::BIGINT AS slot FROM customer"),
]
