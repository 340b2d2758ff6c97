"""Composite operators: cells, series, rankings, texts and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.catalog.intervals import ASTRO, FRAMES, POINTS, YEAR, _frames
from spanwright.catalog.query import Query
from spanwright.functions import geo as G
from spanwright.functions import similarity as S
from spanwright.functions import years as Y
from spanwright.operators import cells as C
from spanwright.operators import intervals as I
from spanwright.sources.tables import RECORDS_SQL, points, points_sql, records, table


def _claims(spark, d):
    """Each customer claims a cell of eight degrees for its segment; later customers come first."""
    x, y = G.cell(F.col("lon"), F.col("lat"), 8.0)
    return points(table(spark, d, "customer"), "c_custkey").select(x.alias("x"), y.alias("y"), F.col("c_mktsegment").alias("owner"), F.col("c_custkey").alias("at"))


def _land(spark, d):
    x, y = G.cell(F.col("lon"), F.col("lat"), 8.0)
    return points(table(spark, d, "supplier"), "s_suppkey").select(x.alias("x"), y.alias("y")).distinct()


CLAIMS = f"claims AS (SELECT floor(lon / 8)::INT AS x, floor(lat / 8)::INT AS y, c_mktsegment AS owner, c_custkey AS seq FROM (SELECT *, {points_sql('c_custkey')} FROM customer))"
LAND = f"land AS (SELECT DISTINCT floor(lon / 8)::INT AS x, floor(lat / 8)::INT AS y FROM (SELECT {points_sql('s_suppkey')} FROM supplier))"
NINE = "(SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b"


def cell_clip(spark, d):
    return C.clipped(C.assigned(_claims(spark, d), "at"), _land(spark, d))


def cell_carve(spark, d):
    return C.carved(C.assigned(_claims(spark, d), "at"), _land(spark, d))


def cell_fallback(spark, d):
    owned = C.carved(C.assigned(_claims(spark, d), "at"), _land(spark, d))
    return C.nearest_owner(_land(spark, d), owned, 1)


def partition_check(spark, d):
    """Per column of cells, the owners' areas summed against the area of their union; ok where overlaps are below a ten-thousandth."""
    cells = _claims(spark, d).select("x", "y", "owner").distinct()
    by = cells.groupBy("x").agg(F.count("*").alias("parts"), F.countDistinct("y").alias("whole"))
    return by.select("x", "parts", "whole", ((F.col("parts") - F.col("whole")) / F.col("whole") < 1e-4).alias("ok"))


def regional_series(spark, d):
    """Shares of open records by region in sampled years."""
    years = spark.range(-1000, 1300, 100).select(F.when(F.col("id") == 0, 1).otherwise(F.col("id")).cast("int").alias("y0")).withColumn("y1", F.col("y0"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("pid"), F.col("n_regionkey").alias("region"))
    j = I.interval_join(records(spark, d).join(c, "pid"), years, ("from_year", "to_year"), ("y0", "y1"))
    out = j.groupBy("region", F.col("y0").alias("year")).agg(F.sum("a").alias("all"), F.sum(F.when(F.col("kind") == "O", F.col("a")).otherwise(0.0)).alias("open"))
    return out.select("region", "year", F.round(F.col("open") / F.col("all"), 6).alias("share"))


def century_groups(spark, d):
    r = records(spark, d).groupBy("kind", Y.century(F.col("from_year")).alias("century")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return r.withColumn("of_kind", F.sum("n").over(Window.partitionBy("kind")))


def worst_lists(spark, d):
    """The three most dear and the three cheapest parts of each brand against the brand's mean, with how many lie within 1 %."""
    p = table(spark, d, "part")
    mean = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    off = p.join(mean, "p_brand").withColumn("off", F.round((F.col("p_retailprice") - F.col("mean")) / F.col("mean"), 6))
    within = off.groupBy("p_brand").agg(F.count(F.when(F.abs("off") < 0.01, 1)).alias("within"))
    top = off.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.abs("off")), "p_partkey"))).filter("k <= 3")
    return top.join(within, "p_brand").select("p_brand", "p_partkey", "off", "k", "within")


def hotspot_tiles(spark, d):
    """Of each segment the four tiles with most customers; a tile goes to the first segment that picks it."""
    x, y = G.mercator_tile(F.col("lon"), F.col("lat"), 3)
    t = points(table(spark, d, "customer"), "c_custkey").groupBy("c_mktsegment", x.alias("tx"), y.alias("ty")).agg(F.count("*").alias("n"))
    picked = t.withColumn("k", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "tx", "ty"))).filter("k <= 4")
    return picked.groupBy("tx", "ty").agg(F.min("c_mktsegment").alias("segment"))


def natural_order(spark, d):
    """Customer names in the order of their letters and numbers."""
    c = table(spark, d, "customer")
    letters, digits = F.lower(F.regexp_replace("c_name", "[0-9]+", "")), F.regexp_extract("c_name", "([0-9]+)", 1).try_cast("bigint")
    return c.select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(letters, F.coalesce(digits, F.lit(-1)), "c_custkey")).alias("place"))


def longest_streaks(spark, d):
    """The longest run of purchases of each user, and how many runs there were."""
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") == "purchase")
    return I.runs(e, "user_id", ["ts", "event_id"], "hit", "ts").filter("hit").groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("streaks"))


def date_validity(spark, d):
    """Strict dates: typed texts of order days, some of them impossible."""
    o = table(spark, d, "orders")
    typed = F.when(F.col("o_orderkey") % 5 == 0, F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd"), "-[0-9]{2}$", "-31")).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = F.try_to_date(typed, "yyyy-MM-dd")
    valid = typed.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(day, "yyyy-MM-dd") == typed, F.lit(False))
    return o.select("o_orderkey", typed.alias("typed"), valid.alias("valid"))


def url_state(spark, d):
    """Host, path, page and a same-site target of page addresses."""
    u = F.col("url")
    page = F.regexp_extract(u, r"[?&]page=([0-9]+)", 1).try_cast("int")
    path = F.regexp_extract(u, r"^https?://[^/?#]+(/[^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), path.alias("path"), F.greatest(F.lit(1), F.least(F.lit(99), F.coalesce(page, F.lit(1)))).alias("page"), F.when(path.rlike(r"^/(?![/\\])"), path).otherwise("/").alias("target"))


def significance(spark, d):
    """Scores of polities by records and years alive, ranked."""
    spans = I.coalesced(records(spark, d), ["pid"]).groupBy("pid").agg(F.sum(Y.span_years(F.col("from_year"), F.col("to_year"))).alias("years"))
    n = records(spark, d).groupBy("pid").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "P", 1).otherwise(0)).alias("p"))
    score = F.round(F.col("n") * F.least(F.log2(2 + F.col("years") / 10), F.lit(6.0)) * F.when(F.col("p") == 1, 1.5).otherwise(1.0), 4)
    scored = n.join(spans, "pid").select("pid", score.alias("score"))
    return scored.orderBy(F.desc("score"), "pid").limit(200)


def lod_choice(spark, d):
    """The level of detail for each zoom: the last whose least zoom is not above it."""
    lods = spark.createDataFrame([("l0", 0), ("l1", 3), ("l2", 5)], "lod string, z int")
    return I.as_of(spark.range(0, 9).select(F.col("id").cast("int").alias("zoom")), lods, "zoom", "z").select("zoom", "lod")


def geometry_equality(spark, d):
    """Parts that are equal as sets of sizes and prices, by a hash of their sorted coordinates."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.sha1(F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",")).alias("hash"), F.count_distinct("p_size").alias("n"))
    return p


def name_similarity(spark, d):
    """Types against names of parts, the best similarity of each brand."""
    p = table(spark, d, "part").select("p_brand", F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.groupBy("p_brand").agg(F.max(S.similarity(F.col("a"), F.col("b"))).alias("best"))


def token_jaccard(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(S.token_similarity(F.col("p_name"), F.lit("small red ring")), 6).alias("similarity"))


def snapped_points(spark, d):
    s = points(table(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), "lon", "lat")
    return C.snapped(s, 20.0)


def tile_thresholds(spark, d):
    """Checks of a threshold table against measured shares."""
    x = table(spark, d, "lineitem")
    shares = x.agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.avg((F.col("l_discount") > 0.08).cast("double")).alias("discounted"), F.avg((F.col("l_tax") < 0).cast("double")).alias("untaxed"))
    measured = shares.unpivot([], ["returned", "discounted", "untaxed"], "rule", "value")
    limits = spark.createDataFrame([("returned", 0.5), ("discounted", 0.05), ("untaxed", 0.0)], "rule string, most double")
    return measured.join(limits, "rule").select("rule", F.round("value", 6).alias("value"), (F.col("value") <= F.col("most")).alias("ok"))


def union_of_stores(spark, d):
    """Keys of both sides with where they come from, each once, and which of them are on both."""
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    both = c.intersect(s).withColumn("side", F.lit("both"))
    return both.unionByName(c.subtract(s).withColumn("side", F.lit("customer"))).unionByName(s.subtract(c).withColumn("side", F.lit("supplier")))


def slivers(spark, d):
    p = table(spark, d, "part")
    area, around = F.col("p_retailprice") / 1e6, F.col("p_size") * 0.5
    return p.select("p_partkey", C.sliver(area, around).alias("sliver"), F.round(C.simplify_interval(area * 1000, F.col("p_size"), 0.02), 6).alias("interval"))


TOK = "list_distinct(string_split({0}, ' '))"
Q = [
    Query("cell_assign", "K5 H5 J8 O3", lambda s, d: C.assigned(_claims(s, d), "at"), f"WITH {CLAIMS} SELECT x, y, arg_max(owner, seq) AS owner FROM claims GROUP BY x, y"),
    Query("cell_carve", "K4 H5 J8", cell_carve, f"WITH {CLAIMS}, {LAND}, o AS (SELECT x, y, arg_max(owner, seq) AS owner FROM claims GROUP BY x, y) SELECT * FROM o WHERE (x, y) NOT IN (SELECT (x, y) FROM land)"),
    Query("cell_clip", "K12 D10 E7 L4", cell_clip, f"""WITH {CLAIMS}, {LAND}, o AS (SELECT x, y, arg_max(owner, seq) AS owner FROM claims GROUP BY x, y), m AS (SELECT owner, count(*) AS cells, count(l.x) AS on_land FROM o LEFT JOIN land l USING (x, y) GROUP BY owner)
        SELECT *, CASE WHEN on_land = 0 THEN 'lost' WHEN on_land < cells THEN 'partly' ELSE 'ok' END AS status FROM m"""),
    Query("cell_fallback", "J11 K16", cell_fallback, f"""WITH {CLAIMS}, {LAND}, o AS (SELECT x, y, arg_max(owner, seq) AS owner FROM claims WHERE (x, y) NOT IN (SELECT (x, y) FROM land) GROUP BY x, y)
        SELECT l.x, l.y, arg_min(owner, (dx * dx + dy * dy, owner)) AS owner FROM land l, {NINE}, o WHERE o.x = l.x + dx AND o.y = l.y + dy GROUP BY l.x, l.y"""),
    Query("cell_opening", "J12", lambda s, d: C.opened(_claims(s, d).select(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"))), f"""WITH {CLAIMS}, c AS (SELECT DISTINCT floor(x / 2)::INT AS x, floor(y / 2)::INT AS y FROM claims), k AS (SELECT x, y FROM c WHERE (SELECT count(*) FROM c o WHERE abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1) = 9)
        SELECT DISTINCT (x + dx)::INT AS x, (y + dy)::INT AS y FROM k, {NINE}"""),
    Query("partition_check", "L2 L3", partition_check, f"""WITH {CLAIMS}, c AS (SELECT DISTINCT x, y, owner FROM claims)
        SELECT x, count(*) AS parts, count(DISTINCT y) AS whole, (count(*) - count(DISTINCT y)) / count(DISTINCT y) < 1e-4 AS ok FROM c GROUP BY x"""),
    Query("regional_series", "E22 F19", regional_series, f"""WITH {RECORDS_SQL}, y AS (SELECT (CASE WHEN y = 0 THEN 1 ELSE y END)::INT AS year FROM (SELECT unnest(range(-1000, 1300, 100)) AS y))
        SELECT n_regionkey AS region, year, round(sum(CASE WHEN kind = 'O' THEN a ELSE 0 END) / sum(a), 6) AS share FROM recs JOIN customer ON pid = 'cust:' || c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN y ON from_year <= year AND to_year >= year GROUP BY 1, 2"""),
    Query("century_groups", "E23 E13 I30", century_groups, f"""WITH {RECORDS_SQL}, g AS (SELECT kind, (CASE WHEN from_year > 0 THEN ceil(from_year / 100) ELSE -ceil(-from_year / 100) END)::INT AS century, count(*) AS n, min(id) AS first_id FROM recs GROUP BY 1, 2)
        SELECT *, (sum(n) OVER (PARTITION BY kind))::BIGINT AS of_kind FROM g"""),
    Query("worst_lists", "E25 G5 G6 L5", worst_lists, """WITH m AS (SELECT p_brand, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1), o AS (SELECT p_brand, p_partkey, round((p_retailprice - mean) / mean, 6) AS off FROM part JOIN m USING (p_brand)),
        w AS (SELECT p_brand, count(*) FILTER (WHERE abs(off) < 0.01) AS within FROM o GROUP BY 1)
        SELECT p_brand, p_partkey, off, k, within FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(off) DESC, p_partkey)::INT AS k FROM o) JOIN w USING (p_brand) WHERE k <= 3"""),
    Query("hotspot_tiles", "C22", hotspot_tiles, f"""WITH c AS (SELECT c_mktsegment, {points_sql("c_custkey")} FROM customer), r AS (SELECT c_mktsegment, floor((lon + 180) / 360 * 8)::INT AS tx, least(7, greatest(0, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8)))::INT AS ty FROM c),
        t AS (SELECT c_mktsegment, least(7, greatest(0, tx))::INT AS tx, ty, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, tx, ty) AS k FROM t)
        SELECT tx, ty, min(c_mktsegment) AS segment FROM k WHERE k <= 4 GROUP BY 1, 2"""),
    Query("natural_order", "G3 G4 G12", natural_order, """SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(regexp_replace(c_name, '[0-9]+', '', 'g')), coalesce(try_cast(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), -1), c_custkey)::INT AS place FROM customer"""),
    Query("longest_streaks", "K43 F3", longest_streaks, """WITH m AS (SELECT *, event_type = 'purchase' AS hit, CASE WHEN lag(event_type = 'purchase') OVER w = (event_type = 'purchase') THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, hit, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m), n AS (SELECT user_id, run, count(*) AS n FROM r WHERE hit GROUP BY ALL)
        SELECT user_id, max(n) AS longest, count(*) AS streaks FROM n GROUP BY user_id"""),
    Query("date_validity", "I20", date_validity, r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m') || '-31' WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS typed FROM orders)
        SELECT o_orderkey, typed, regexp_matches(typed, '^\d{4}-\d{2}-\d{2}$') AND try_cast(typed AS DATE) IS NOT NULL AS valid FROM t"""),
    Query("url_state", "I26 I27 I33", url_state, r"""WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT) AS p FROM pages)
        SELECT page_id, host, path, greatest(1, least(99, coalesce(p, 1)))::INT AS page, CASE WHEN regexp_matches(path, '^/([^/\\]|$)') THEN path ELSE '/' END AS target FROM u"""),
    Query("significance_rank", "I14 F12 G11 K25", significance, f"""WITH {RECORDS_SQL}, m AS (SELECT *, max({ASTRO.format("to_year")}) OVER (PARTITION BY pid ORDER BY from_year, to_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM recs),
        i AS (SELECT *, sum(CASE WHEN b IS NULL OR {ASTRO.format("from_year")} > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY from_year, to_year ROWS UNBOUNDED PRECEDING) AS run FROM m),
        s AS (SELECT pid, min(from_year) AS x, max(to_year) AS y FROM i GROUP BY pid, run), y AS (SELECT pid, sum(y - x + 1 - CASE WHEN x < 0 AND y > 0 THEN 1 ELSE 0 END) AS years FROM s GROUP BY pid),
        n AS (SELECT pid, count(*) AS n, max(CASE WHEN kind = 'P' THEN 1 ELSE 0 END) AS p FROM recs GROUP BY pid)
        SELECT pid, round(n * least(log2(2 + years / 10), 6) * CASE WHEN p = 1 THEN 1.5::DOUBLE ELSE 1 END, 4)::DOUBLE AS score FROM n JOIN y USING (pid) ORDER BY score DESC, pid LIMIT 200"""),
    Query("lod_choice", "I29 D5", lod_choice, "SELECT zoom::INT AS zoom, CASE WHEN zoom >= 5 THEN 'l2' WHEN zoom >= 3 THEN 'l1' ELSE 'l0' END AS lod FROM (SELECT unnest(range(0, 9)) AS zoom)"),
    Query("set_hash_equality", "J21 I34 H4", geometry_equality, "SELECT p_brand, sha1(string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR)) AS hash, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand"),
    Query("name_similarity", "I12 D24", name_similarity, None),
    Query("token_jaccard", "I12 I13", token_jaccard, f"""WITH t AS (SELECT p_partkey, {TOK.format("p_name")} AS x, ['small', 'red', 'ring'] AS y FROM part),
        m AS (SELECT *, least(len(list_filter(x, lambda u: starts_with('small', u) OR starts_with(u, 'small') OR starts_with('red', u) OR starts_with(u, 'red') OR starts_with('ring', u) OR starts_with(u, 'ring'))),
          (SELECT count(*) FROM unnest(y) s(v) WHERE len(list_filter(x, lambda u: starts_with(u, v) OR starts_with(v, u))) > 0)) AS s FROM t)
        SELECT p_partkey, round(s / (len(x) + 3 - s), 6) AS similarity FROM m"""),
    Query("snapped_points", "J13 J7", snapped_points, f"""WITH s AS (SELECT s_suppkey AS id, {points_sql("s_suppkey")} FROM supplier), c AS (SELECT *, floor(lon / 20)::INT AS x, floor(lat / 20)::INT AS y FROM s)
        SELECT c.id, arg_min(o.lon, o.id) AS lon, arg_min(o.lat, o.id) AS lat FROM c JOIN c o ON abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 GROUP BY c.id"""),
    Query("threshold_checks", "L11", tile_thresholds, """WITH s AS (SELECT avg((l_returnflag = 'R')::INT) AS returned, avg((l_discount > 0.08)::INT) AS discounted, avg((l_tax < 0)::INT) AS untaxed FROM lineitem), u AS (UNPIVOT s ON returned, discounted, untaxed INTO NAME rule VALUE value)
        SELECT rule, round(value, 6) AS value, value <= CASE rule WHEN 'returned' THEN 0.5 WHEN 'discounted' THEN 0.05 ELSE 0 END AS ok FROM u"""),
    Query("set_operations", "H1 H2 H3", union_of_stores, """SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN 'supplier' WHEN s_suppkey IS NULL THEN 'customer' ELSE 'both' END AS side FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON c_custkey = s_suppkey"""),
    Query("sliver_filter", "C17 J14", slivers, """SELECT p_partkey, p_retailprice / 1e6 < 1e-4 OR 2 * (p_retailprice / 1e6) / (p_size * 0.5::DOUBLE) < 2e-3 AS sliver, round(least(0.02::DOUBLE, greatest(0.005::DOUBLE, sqrt(p_retailprice / 1e6 * 1000 / p_size) / 50)), 6) AS "interval" FROM part"""),
]
