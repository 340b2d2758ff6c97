"""Interval algebra over the records derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.catalog.query import Query
from spanwright.functions import years as Y
from spanwright.operators import intervals as I
from spanwright.operators.numbering import numbered, suffixed
from spanwright.sources.tables import RECORDS_SQL, records, table

LO, HI, PRESENT, CUTOVER, YEAR = -1300, 1400, 2026, 900, 100
HIST = "(CASE WHEN {0} <= 0 THEN {0} - 1 ELSE {0} END)"
ASTRO = "(CASE WHEN {0} < 0 THEN {0} + 1 ELSE {0} END)"


def add(y: str, n: int) -> str:
    return HIST.format(f"({ASTRO.format(y)} + {n})")


POINTS = f"""pts AS (SELECT DISTINCT y::INT AS y FROM (SELECT from_year AS y FROM recs UNION ALL SELECT {add("to_year", 1)} FROM recs
  UNION ALL SELECT {LO} UNION ALL SELECT {CUTOVER}) WHERE y BETWEEN {LO} AND {HI} AND y <> 0)"""
FRAMES = f"frm AS (SELECT y AS f0, coalesce({add('lead(y) OVER (ORDER BY y)', -1)}, {PRESENT})::INT AS f1 FROM pts)"


def _points(spark, d):
    return I.change_points(records(spark, d), LO, HI, [CUTOVER])


def _frames(spark, d):
    return I.frames(_points(spark, d), PRESENT)


def alive_at_year(spark, d):
    return records(spark, d).filter(Y.alive(F.col("from_year"), F.col("to_year"), YEAR) & (F.col("tier") == 0)).select("id", "pid", "from_year", "to_year", "a")


def frame_alive_join(spark, d):
    f = _frames(spark, d).select(F.col("from_year").alias("f0"), F.col("to_year").alias("f1"), F.col("from_year").alias("at"))
    # records of equal years are one row first, and frames begin in distinct years of [LO, HI]: what is joined is bounded by years, not by records
    top = F.max(F.struct(F.col("a"), (-F.col("id")).alias("minus"), F.col("pid"))).alias("top")
    spans = records(spark, d).groupBy("from_year", "to_year").agg(F.count("*").alias("n"), F.sum("a").alias("a"), top)
    alive = I.interval_join(spans, F.broadcast(f), ("from_year", "to_year"), ("at", "at")).groupBy("f0", "f1").agg(F.sum("n").alias("n_alive"), F.round(F.sum("a"), 2).alias("area"), F.max("top").alias("top"))
    return alive.select("f0", "f1", "n_alive", "area", F.col("top.pid").alias("top_pid"))


def _chunks(spark):
    starts = spark.range(-6, 7).select((F.col("id") * 250).cast("int").alias("s"))
    return starts.select(Y.from_astronomical(F.col("s")).alias("c0"), Y.from_astronomical(F.col("s") + 249).alias("c1"))


CHUNKS = f"chunks AS (SELECT {HIST.format('s')}::INT AS c0, {HIST.format('(s + 249)')}::INT AS c1 FROM (SELECT unnest(range(-6, 7)) * 250 AS s))"


def overlap_chunks(spark, d):
    pairs = I.interval_join(records(spark, d), _chunks(spark), ("from_year", "to_year"), ("c0", "c1"), width=250)
    inside = Y.span_years(F.greatest("from_year", "c0"), F.least("to_year", "c1"))
    return pairs.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.sum(inside).alias("years")).withColumn("chunk_id", Y.chunk_id(F.col("c0"), F.col("c1")))


def frame_of_year(spark, d):
    asked = spark.range(-1400, 1500, 50).select(F.when(F.col("id") == 0, 1).otherwise(F.col("id")).cast("int").alias("year"))
    f = _frames(spark, d).withColumnsRenamed({"from_year": "f0", "to_year": "f1"})
    return I.as_of(asked, f, "year", "f0").select("year", "f0", "f1")


def last_large_event(spark, d):
    """Each event with the last large one of its type up to it: a few types share all rows."""
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    large = events.filter("value > 90").select("event_type", F.col("event_id").alias("large_id"))
    return I.as_of(events, large, "event_id", "large_id", ["event_type"], 4096).select("event_id", "large_id")


def prev_next_change(spark, d):
    return I.previous_and_next(_points(spark, d), records(spark, d).select(F.col("from_year")), "from_year")


def _spans(spark, d):
    return I.coalesced(records(spark, d), ["pid"])


def nearest_year_in_spans(spark, d):
    near = F.when(F.col("from_year") > YEAR, F.col("from_year")).when(F.col("to_year") < YEAR, F.col("to_year")).otherwise(YEAR)
    best = F.min(F.struct(Y.year_distance(near, F.lit(YEAR)).alias("distance"), near.alias("year")))
    return _spans(spark, d).groupBy("pid").agg(best.alias("b")).select("pid", F.col("b.year").cast("int").alias("year"), F.col("b.distance").cast("int").alias("distance"))


SPANS = f"""marked AS (SELECT *, CASE WHEN max({ASTRO.format("to_year")}) OVER w IS NULL OR {ASTRO.format("from_year")} > max({ASTRO.format("to_year")}) OVER w + 1 THEN 1 ELSE 0 END AS st
  FROM recs WINDOW w AS (PARTITION BY pid ORDER BY from_year, to_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  islands AS (SELECT *, sum(st) OVER (PARTITION BY pid ORDER BY from_year, to_year ROWS UNBOUNDED PRECEDING) AS run FROM marked),
  spans AS (SELECT pid, min(from_year)::INT AS from_year, max(to_year)::INT AS to_year FROM islands GROUP BY pid, run)"""


def span_text(spark, d):
    one = F.concat_ws("..", F.col("from_year").cast("string"), F.col("to_year").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("from_year", one.alias("t")))), lambda x: x["t"])
    return _spans(spark, d).groupBy("pid").agg(F.array_join(parts, ", ").alias("spans"), F.sum(Y.span_years(F.col("from_year"), F.col("to_year"))).alias("years"))


def run_length_states(spark, d):
    out = I.runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "ts", [F.round(F.sum("value"), 2).alias("total")])
    return out.select("user_id", "event_type", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n", "total")


RUNS = """m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


def merge_identical_records(spark, d):
    return I.coalesced(records(spark, d), ["pid", "kind", "tier"], extra=[F.count("*").alias("n")])


def merge_sql() -> str:
    return f"""WITH {RECORDS_SQL}, m AS (SELECT *, max({ASTRO.format("to_year")}) OVER (PARTITION BY pid, kind, tier ORDER BY from_year, to_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM recs),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR {ASTRO.format("from_year")} > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pid, kind, tier ORDER BY from_year, to_year ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT pid, kind, tier, min(from_year)::INT AS from_year, max(to_year)::INT AS to_year, count(*) AS n FROM i GROUP BY pid, kind, tier, run"""


def split_edit(spark, d):
    out = I.split(records(spark, d).select("id", "pid", "from_year", "to_year"), -50, 60)
    return out.withColumn("rid", F.when(F.col("piece").isin("head", "whole"), F.col("pid")).otherwise(F.concat("pid", F.lit("@"), F.col("from_year").cast("string"))))


SPLIT = f"""p AS (SELECT id, pid, kind, tier, a, unnest([{{'piece': 'head', 'x': from_year, 'y': least(to_year, -51)}}, {{'piece': 'mid', 'x': greatest(from_year, -50), 'y': least(to_year, 60)}}, {{'piece': 'tail', 'x': greatest(from_year, 61), 'y': to_year}}]) AS q
  FROM recs WHERE from_year <= 60 AND to_year >= -50),
cut AS (SELECT id, pid, kind, tier, a, q.x::INT AS from_year, q.y::INT AS to_year, q.piece AS piece FROM p WHERE q.x <= q.y
  UNION ALL SELECT id, pid, kind, tier, a, from_year, to_year, 'whole' FROM recs WHERE NOT (from_year <= 60 AND to_year >= -50))"""


def record_edits(spark, d):
    entries = [("update", -50, 60, F.col("tier") == 0, {"kind": F.lit("X"), "tier": F.col("tier") + 1}), ("delete", -50, 60, F.col("kind") == "P", None)]
    return I.edited_in_order(records(spark, d), entries).select("id", "pid", "from_year", "to_year", "kind", "tier")


EDITS = f"""WITH {RECORDS_SQL}, {SPLIT}
SELECT id, pid, from_year, to_year, CASE WHEN piece = 'mid' AND tier = 0 THEN 'X' ELSE kind END AS kind, CASE WHEN piece = 'mid' AND tier = 0 THEN 1 ELSE tier END AS tier FROM cut
WHERE kind <> 'P' AND (piece = 'whole' OR tier = 0)
UNION ALL SELECT id, pid, from_year, to_year, kind, tier FROM recs WHERE kind <> 'P' AND tier <> 0 AND from_year <= 60 AND to_year >= -50
UNION ALL SELECT id, pid, from_year, to_year, kind, tier FROM cut WHERE kind = 'P' AND piece <> 'mid'"""


def timeline_violations(spark, d):
    return I.contiguity(records(spark, d), ["pid"], ["from_year", "to_year", "id"]).groupBy("pid", "violation").agg(F.count("*").alias("n"))


def sequential_rids(spark, d):
    order = [F.col("from_year"), F.col("pid"), F.col("tier"), F.col("to_year"), -F.col("a"), F.col("id")]
    named = suffixed(records(spark, d), F.concat("pid", F.lit("@"), F.col("from_year").cast("string")), [F.col("tier"), F.col("to_year"), F.col("id")], "rid")
    return numbered(named, order, "seq").select("id", "seq", "rid")


def year_expansion_recompact(spark, d):
    return I.holders(records(spark, d), "pid", ["from_year", "id"], "kind")


def coverage_check(spark, d):
    return I.contiguity(_chunks(spark).withColumn("k", F.lit(1)), ["k"], ["c0"], ("c0", "c1")).select("c0", "c1", "violation")


def scale_interpolation(spark, d):
    """Years on a piecewise-linear axis: stops every 250 years, each of them as long as the records that begin in it."""
    astro = Y.to_astronomical(F.col("from_year"))
    counts = records(spark, d).groupBy(F.floor(astro / 250).cast("int").alias("b")).agg(F.count("*").alias("n"))
    w = Window.orderBy("b")
    stops = counts.withColumn("t0", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = records(spark, d).select("from_year", astro.alias("y")).distinct().withColumn("b", F.floor(F.col("y") / 250).cast("int"))
    return asked.join(stops, "b").select("from_year", F.round(F.col("t0") + (F.col("y") - F.col("b") * 250) / 250 * F.col("n"), 4).alias("t"))


def year_text(spark, d):
    lo, hi = F.col("from_year"), F.col("to_year")
    return records(spark, d).select("id", Y.format_year(lo).alias("label"), Y.format_year(lo, "BC", True).alias("ad_label"), Y.format_span(lo, hi).alias("span"), Y.span_years(lo, hi).alias("years"), Y.century(lo).alias("century"), Y.date_tolerance(lo, hi).alias("tolerance"))


def parse_year(spark, d):
    shown = Y.format_year(F.col("from_year"))
    typed = F.when(F.col("id") % 4 == 0, F.upper(shown)).when(F.col("id") % 4 == 1, F.regexp_replace(shown, "BCE", "b.c.")).when(F.col("id") % 4 == 2, F.concat(F.lit("-"), shown)).otherwise(F.concat(F.lit("ad "), shown))
    return records(spark, d).select("id", Y.parse_year(typed).alias("year"))


FMT = "CASE WHEN {0} < 0 THEN (-{0}) || ' BCE' ELSE {0}::VARCHAR END"
Q = [
    Query("alive_at_year", "C1 C2 C7 K29", alive_at_year, f"WITH {RECORDS_SQL} SELECT id, pid, from_year, to_year, a FROM recs WHERE from_year <= {YEAR} AND to_year >= {YEAR} AND tier = 0"),
    Query("change_points", "F1 K8", _points, f"WITH {RECORDS_SQL}, {POINTS} SELECT y FROM pts"),
    Query("frame_spans", "F2", _frames, f"WITH {RECORDS_SQL}, {POINTS}, {FRAMES} SELECT f0 AS from_year, f1 AS to_year FROM frm"),
    Query("frame_alive_join", "D1 E13 K14 F24", frame_alive_join, f"WITH {RECORDS_SQL}, {POINTS}, {FRAMES} SELECT f0, f1, count(*) AS n_alive, round(sum(a), 2) AS area, arg_max(pid, (a, -id)) AS top_pid FROM frm JOIN recs ON from_year <= f0 AND to_year >= f0 GROUP BY f0, f1"),
    Query("overlap_chunks", "C4 C5 D2 I3 I31", overlap_chunks, f"""WITH {RECORDS_SQL}, {CHUNKS}, j AS (SELECT *, greatest(from_year, c0) AS x, least(to_year, c1) AS y FROM recs JOIN chunks ON from_year <= c1 AND c0 <= to_year)
        SELECT c0, c1, count(*) AS n, sum(y - x + 1 - CASE WHEN x < 0 AND y > 0 THEN 1 ELSE 0 END)::BIGINT AS years,
          (CASE WHEN c0 < 0 THEN (-c0) || 'bce' ELSE c0::VARCHAR END) || '-' || (CASE WHEN c1 < 0 THEN (-c1) || 'bce' ELSE c1::VARCHAR END) AS chunk_id FROM j GROUP BY c0, c1"""),
    Query("frame_of_year", "D3 D4 D5 F19", frame_of_year, f"""WITH {RECORDS_SQL}, {POINTS}, {FRAMES}, asked AS (SELECT (CASE WHEN y = 0 THEN 1 ELSE y END)::INT AS year FROM (SELECT unnest(range(-1400, 1500, 50)) AS y))
        SELECT year, f0, f1 FROM asked LEFT JOIN frm ON f0 <= year AND year < coalesce((SELECT min(f.f0) FROM frm f WHERE f.f0 > frm.f0), 99999)"""),
    Query("last_large_event", "D3 D5", last_large_event, """SELECT e.event_id, l.event_id AS large_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE value > 90) l ON e.event_type = l.event_type AND e.event_id >= l.event_id"""),
    Query("prev_next_change", "D6", prev_next_change, f"""WITH {RECORDS_SQL}, {POINTS}, asked AS (SELECT DISTINCT from_year FROM recs)
        SELECT from_year, (SELECT max(y) FROM pts WHERE y < from_year) AS prev_change, (SELECT min(y) FROM pts WHERE y > from_year) AS next_change FROM asked"""),
    Query("nearest_year_in_spans", "D7 C3 I4", nearest_year_in_spans, f"""WITH {RECORDS_SQL}, {SPANS}, n AS (SELECT pid, CASE WHEN from_year > {YEAR} THEN from_year WHEN to_year < {YEAR} THEN to_year ELSE {YEAR} END AS year FROM spans),
        k AS (SELECT pid, year, abs({ASTRO.format("year")} - {YEAR}) AS distance FROM n) SELECT pid, arg_min(year, (distance, year))::INT AS year, min(distance)::INT AS distance FROM k GROUP BY pid"""),
    Query("span_union", "F6 F3", _spans, f"WITH {RECORDS_SQL}, {SPANS} SELECT * FROM spans"),
    Query("span_gaps", "F7 D16 K11", lambda s, d: I.complement(records(s, d), ["pid"], -1000, 1000), f"""WITH {RECORDS_SQL.replace("recs AS", "every AS")}, recs AS (SELECT * REPLACE (greatest(from_year, -1000) AS from_year, least(to_year, 1000) AS to_year) FROM every WHERE from_year <= 1000 AND to_year >= -1000), {SPANS},
        g AS (SELECT pid, coalesce({add("lag(to_year) OVER (PARTITION BY pid ORDER BY from_year)", 1)}, -1000) AS x, {add("from_year", -1)} AS y FROM spans UNION ALL SELECT pid, {add("max(to_year)", 1)}, 1000 FROM spans GROUP BY pid)
        SELECT pid, x::INT AS from_year, y::INT AS to_year FROM g WHERE x <= y AND x <= 1000 AND y >= -1000"""),
    Query("span_text", "F15 I5", span_text, f"WITH {RECORDS_SQL}, {SPANS} SELECT pid, string_agg(from_year || '..' || to_year, ', ' ORDER BY from_year) AS spans, sum(to_year - from_year + 1 - CASE WHEN from_year < 0 AND to_year > 0 THEN 1 ELSE 0 END)::BIGINT AS years FROM spans GROUP BY pid"),
    Query("run_length_states", "F3 F4 M2", run_length_states, f"WITH {RUNS} SELECT user_id, event_type, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY user_id, run, event_type"),
    Query("merge_identical_records", "F5 K20", merge_identical_records, merge_sql()),
    Query("split_edit", "F8", split_edit, f"WITH {RECORDS_SQL}, {SPLIT} SELECT id, pid, from_year, to_year, piece, CASE WHEN piece IN ('head', 'whole') THEN pid ELSE pid || '@' || from_year END AS rid FROM cut"),
    Query("record_edits", "K2 K3 K7 O5 C18", record_edits, EDITS),
    Query("timeline_violations", "F9 L6 L9", timeline_violations, f"""WITH {RECORDS_SQL}, w AS (SELECT pid, {ASTRO.format("from_year")} - lag({ASTRO.format("to_year")}) OVER (PARTITION BY pid ORDER BY from_year, to_year, id) AS gap FROM recs)
        SELECT pid, CASE WHEN gap <= 0 THEN 'overlap' WHEN gap > 1 THEN 'gap' ELSE 'ok' END AS violation, count(*) AS n FROM w WHERE gap IS NOT NULL GROUP BY ALL"""),
    Query("sequential_rids", "F10 F11 K19 G7", sequential_rids, f"""WITH {RECORDS_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY from_year, pid, tier, to_year, -a, id) AS seq, pid || '@' || from_year AS base, row_number() OVER (PARTITION BY pid, from_year ORDER BY tier, to_year, id) AS k FROM recs)
        SELECT id, seq, CASE WHEN k = 1 THEN base ELSE base || '#' || k END AS rid FROM n"""),
    Query("year_expansion_recompact", "F13 F14 E21", year_expansion_recompact, f"""WITH {RECORDS_SQL}, e AS (SELECT pid, id, kind, from_year, unnest(range({ASTRO.format("from_year")}, {ASTRO.format("to_year")} + 1)) AS astro FROM recs),
        h AS (SELECT pid, astro, arg_max(kind, (from_year, id)) AS kind FROM e GROUP BY pid, astro), i AS (SELECT *, astro - row_number() OVER (PARTITION BY pid, kind ORDER BY astro) AS grp FROM h)
        SELECT pid, kind, {HIST.format("min(astro)")}::INT AS from_year, {HIST.format("max(astro)")}::INT AS to_year FROM i GROUP BY pid, kind, grp"""),
    Query("coverage_check", "F18 L8", coverage_check, f"""WITH {CHUNKS}, w AS (SELECT *, {ASTRO.format("c0")} - lag({ASTRO.format("c1")}) OVER (ORDER BY c0) AS gap FROM chunks)
        SELECT c0, c1, CASE WHEN gap <= 0 THEN 'overlap' WHEN gap > 1 THEN 'gap' ELSE 'ok' END AS violation FROM w WHERE gap IS NOT NULL"""),
    Query("scale_interpolation", "F20 F21", scale_interpolation, f"""WITH {RECORDS_SQL}, y AS (SELECT from_year, {ASTRO.format("from_year")} AS y FROM recs), c AS (SELECT floor(y / 250.0)::INT AS b, count(*) AS n FROM y GROUP BY 1),
        s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM c)
        SELECT from_year, round(t0 + (y - b * 250) / 250 * n, 4)::DOUBLE AS t FROM (SELECT DISTINCT * FROM y) JOIN s ON b = floor(y / 250.0)::INT"""),
    Query("year_text", "I1 I2 I5 I15 I30", year_text, f"""WITH {RECORDS_SQL}, s AS (SELECT *, to_year - from_year + 1 - CASE WHEN from_year < 0 AND to_year > 0 THEN 1 ELSE 0 END AS years FROM recs)
        SELECT id, {FMT.format("from_year")} AS label, CASE WHEN from_year < 0 THEN (-from_year) || ' BC' ELSE 'AD ' || from_year END AS ad_label,
          CASE WHEN from_year = to_year THEN {FMT.format("from_year")} ELSE {FMT.format("from_year")} || CASE WHEN from_year < 0 THEN ' – ' ELSE '–' END || CASE WHEN to_year >= 2026 THEN 'present' ELSE {FMT.format("to_year")} END END AS span,
          years, (CASE WHEN from_year > 0 THEN ceil(from_year / 100) ELSE -ceil(-from_year / 100) END)::INT AS century, greatest(25, round_even(years * 0.1, 0)::INT) AS tolerance FROM s"""),
    Query("parse_year", "I6 I16", parse_year, f"""WITH {RECORDS_SQL} SELECT id, (CASE WHEN id % 4 IN (0, 1) THEN from_year WHEN id % 4 = 2 THEN CASE WHEN from_year > 0 THEN -from_year END ELSE CASE WHEN from_year > 0 THEN from_year END END)::BIGINT AS year FROM recs"""),
]
