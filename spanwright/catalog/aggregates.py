"""Indexes, labels, shares, totals and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog.intervals import SPANS, YEAR
from spanwright.catalog.query import Query
from spanwright.functions.text import fnv1a, unordered_key
from spanwright.operators import aggregates as A
from spanwright.sources.tables import RECORDS_SQL, points, records, table

ALIVE = f"alive AS (SELECT * FROM recs WHERE from_year <= {YEAR} AND to_year >= {YEAR})"


def _alive(spark, d):
    return records(spark, d).filter((F.col("from_year") <= YEAR) & (F.col("to_year") >= YEAR))


def rows_per_polity(spark, d):
    top = F.min(F.struct((-F.col("a")).alias("minus"), "id", "kind")).alias("t")
    return _alive(spark, d).groupBy("pid").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("area"), top).select("pid", "n", "area", F.col("t.kind").alias("kind"))


def label_argmax(spark, d):
    return A.argmax(_alive(spark, d), ["pid"], [(F.col("tier"), False), (F.col("a"), True), (F.col("id"), False)], ["id", "tier", "a"])


def adjacency_weights(spark, d):
    return A.pair_weights(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def majority_share(spark, d):
    m = A.majority(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")
    return m.select("l_partkey", "top", F.round("share", 6).alias("share"), F.round("second", 6).alias("second"), "clear")


def status_pivot(spark, d):
    o = table(spark, d, "orders")
    count = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s.lower())
    return A.with_totals(o, ["o_orderpriority"], [count("F"), count("O"), count("P"), F.count("*").alias("n")])


def grouped_totals(spark, d):
    x = table(spark, d, "lineitem")
    out = A.with_totals(x, ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("ratio")])
    return out.withColumn("ratio", F.round("ratio", 4))


def confusion_counts(spark, d):
    pairs = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    whole = pairs.groupBy("l_returnflag").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return pairs.join(whole, "l_returnflag").select("l_returnflag", "l_linestatus", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(1 - F.col("most") / F.col("total"), 6).alias("minority"))


def running_distinct_cost(spark, d):
    x = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("frame"), "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return A.running_first_seen(x, "frame", "l_partkey", "p_retailprice")



def customer_arcs(spark, d):
    return A.smallest_arc(points(table(spark, d, "supplier"), "s_suppkey").withColumn("k", F.col("s_nationkey")), "k", "lon")


def version_diff(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return A.full_diff(old, new, "k", ["nation"])


def missing_refs(spark, d):
    return A.missing_references(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id", "documents", "labels")


def priority_lookup(spark, d):
    """The first of several keys that a dimension knows, else a slot by hash."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    named = c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.when(F.col("n_regionkey") == 1, F.col("n_name")).alias("by_nation"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("builder")).alias("by_segment"))
    slot = F.concat(F.lit("slot"), (fnv1a(F.col("o_custkey").cast("string")) % 12).cast("string"))
    return o.join(named, o.o_custkey == named.c_custkey, "left").select("o_orderkey", F.coalesce("by_nation", "by_segment", slot).alias("colour"))


def unordered_pairs(spark, d):
    x = table(spark, d, "lineitem").groupBy(unordered_key(F.col("l_returnflag"), F.col("l_linestatus")).alias("pair")).agg(F.count("*").alias("n"))
    return x


def records_qa(spark, d):
    """Violations of the record contract: repeated ids, year 0, ends before starts, non-positive ids."""
    r = records(spark, d)
    rules = {"year_zero": (F.col("from_year") == 0) | (F.col("to_year") == 0), "reversed": F.col("from_year") > F.col("to_year"), "bad_id": F.col("id") <= 0}
    counts = r.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in rules.items()], (F.count("*") - F.count_distinct("id")).alias("repeated_ids"))
    return counts.unpivot([], [*rules, "repeated_ids"], "rule", "violations").withColumn("ok", F.col("violations") == 0)


def gate_cascade(spark, d):
    """The first gate that a candidate fails, with counts: place, dates, order, window."""
    o = records(spark, d)
    reason = F.when(F.col("a") < 1000, "place").when(F.col("to_year") - F.col("from_year") < 2, "dates").when(F.col("kind") == "P", "order").when(~F.col("from_year").between(-1000, 1000), "window").otherwise("kept")
    return o.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
CUST = FNV.format("o_custkey::VARCHAR")
Q = [
    Query("polity_index", "E1 E2 E12 F6", lambda s, d: A.polity_index(records(s, d)), f"""WITH {RECORDS_SQL}, {SPANS},
        s AS (SELECT pid, count(*) AS n_spans, sum(to_year - from_year + 1 - CASE WHEN from_year < 0 AND to_year > 0 THEN 1 ELSE 0 END)::BIGINT AS years FROM spans GROUP BY pid),
        w AS (SELECT pid, min(from_year) AS first_year, max(to_year) AS last_year, count(*) AS records, arg_max(kind, (from_year, id)) AS last_kind, arg_min(from_year, (-a, from_year)) AS peak FROM recs GROUP BY pid)
        SELECT * FROM w JOIN s USING (pid)"""),
    Query("rows_per_polity", "E3", rows_per_polity, f"WITH {RECORDS_SQL}, {ALIVE} SELECT pid, count(*) AS n, round(sum(a), 2) AS area, arg_min(kind, (-a, id)) AS kind FROM alive GROUP BY pid"),
    Query("label_argmax", "E4 G9", label_argmax, f"WITH {RECORDS_SQL}, {ALIVE} SELECT pid, id, tier, a FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tier, a DESC, id) AS k FROM alive) WHERE k = 1"),
    Query("adjacency_weights", "E5 E6 D23", adjacency_weights, """WITH o AS (SELECT l_orderkey AS k, l_partkey AS p, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
        SELECT x.p AS a, y.p AS b, count(*) AS n_groups, sum(least(x.w, y.w)) AS weight FROM o x JOIN o y ON x.k = y.k AND x.p < y.p GROUP BY ALL"""),
    Query("majority_share", "E7 E8", majority_share, """WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, l_suppkey) AS k, sum(w) OVER (PARTITION BY l_partkey) AS t FROM s),
        x AS (SELECT l_partkey, max(l_suppkey) FILTER (WHERE k = 1) AS top, max(w / t) FILTER (WHERE k = 1) AS share, coalesce(max(w / t) FILTER (WHERE k = 2), 0) AS second FROM r GROUP BY l_partkey)
        SELECT l_partkey, top, round(share, 6) AS share, round(second, 6) AS second, share >= 0.5 AND second < 0.1 AS clear FROM x"""),
    Query("collision_groups", "E11 E26", lambda s, d: A.collisions(table(s, d, "part"), "p_name", "p_partkey"), """WITH c AS (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1)
        SELECT p_name, p_partkey, p_name || ' (' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) || ')' AS label FROM (SELECT DISTINCT p_name, p_partkey FROM part) JOIN c USING (p_name)"""),
    Query("status_pivot", "E14 K10 K41", status_pivot, """SELECT coalesce(o_orderpriority, 'total') AS o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)"""),
    Query("grouped_totals", "E15 E20", grouped_totals, """SELECT coalesce(l_returnflag, 'total') AS l_returnflag, coalesce(l_linestatus, 'total') AS l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice) / sum(l_quantity), 4) AS ratio
        FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())"""),
    Query("confusion_counts", "E16", confusion_counts, """WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, n, round(n / sum(n) OVER w, 6) AS share, round(1 - max(n) OVER w / sum(n) OVER w, 6) AS minority FROM p WINDOW w AS (PARTITION BY l_returnflag)"""),
    Query("vote_mode", "E21", lambda s, d: A.mode_by_votes(table(s, d, "events"), "user_id", "event_type"), "WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, event_type)) AS event_type, max(n) AS votes FROM v GROUP BY user_id"),
    Query("running_distinct_cost", "E17", running_distinct_cost, """WITH f AS (SELECT l_partkey, min(strftime(l_shipdate, '%Y-%m')) AS frame, min(p_retailprice) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey),
        p AS (SELECT frame, count(*) AS new_items, sum(c) AS c FROM f GROUP BY frame)
        SELECT frame, new_items, (sum(new_items) OVER w)::BIGINT AS items, round(sum(c) OVER w, 2) AS cost FROM p WINDOW w AS (ORDER BY frame ROWS UNBOUNDED PRECEDING)"""),
    Query("circular_bbox", "E19 J5", customer_arcs, """WITH p AS (SELECT DISTINCT s_nationkey AS k, ((s_suppkey * 37) % 360 - 180)::DOUBLE AS lon FROM supplier),
        g AS (SELECT k, lon, coalesce(lead(lon) OVER (PARTITION BY k ORDER BY lon), min(lon) OVER (PARTITION BY k) + 360) AS nxt FROM p), t AS (SELECT k, arg_max((nxt, lon), (nxt - lon, -lon)) AS b FROM g GROUP BY k)
        SELECT k, CASE WHEN b[1] >= 180 THEN b[1] - 360 ELSE b[1] END AS west, b[2] AS east, 360 - (b[1] - b[2]) AS width FROM (SELECT k, [struct_extract(b, 1), struct_extract(b, 2)] AS b FROM t)"""),
    Query("full_diff", "D18 D28 H6 H3", version_diff, """SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN 'add' WHEN s_suppkey IS NULL THEN 'remove' WHEN c_nationkey <> s_nationkey THEN 'update' ELSE 'same' END AS action
        FROM customer FULL JOIN supplier ON c_custkey = s_suppkey"""),
    Query("missing_refs", "D17 D19 D20 L1 L10", missing_refs, """SELECT DISTINCT doc_id, 'labels' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'documents' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""),
    Query("priority_lookup", "D27 D30 I17 I25 I35 C16", priority_lookup, f"""SELECT o_orderkey, coalesce(CASE WHEN n_regionkey = 1 THEN n_name END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END, 'slot' || ({CUST} % 12)) AS colour
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    Query("unordered_pairs", "D31 H4", unordered_pairs, "SELECT least(l_returnflag, l_linestatus) || '|' || greatest(l_returnflag, l_linestatus) AS pair, count(*) AS n FROM lineitem GROUP BY 1"),
    Query("record_checks", "L6 L7", records_qa, f"""WITH {RECORDS_SQL}, c AS (SELECT count(*) FILTER (WHERE from_year = 0 OR to_year = 0) AS year_zero, count(*) FILTER (WHERE from_year > to_year) AS reversed, count(*) FILTER (WHERE id <= 0) AS bad_id, count(*) - count(DISTINCT id) AS repeated_ids FROM recs)
        SELECT rule, violations, violations = 0 AS ok FROM (UNPIVOT c ON year_zero, reversed, bad_id, repeated_ids INTO NAME rule VALUE violations)"""),
    Query("gate_cascade", "C6 C19", gate_cascade, f"""WITH {RECORDS_SQL} SELECT CASE WHEN a < 1000 THEN 'place' WHEN to_year - from_year < 2 THEN 'dates' WHEN kind = 'P' THEN 'order' WHEN from_year NOT BETWEEN -1000 AND 1000 THEN 'window' ELSE 'kept' END AS reason, count(*) AS n FROM recs GROUP BY 1"""),
]
