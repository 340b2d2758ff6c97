"""Operators on small tables with values worked out by hand."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import text as T
from spanwright.functions import years as Y
from spanwright.operators import aggregates, graph, intervals, search
from spanwright.plans.packing import furthest_within, near_equal_blocks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def records(spark, rows):
    return spark.createDataFrame(rows, "id int, pid string, from_year int, to_year int")


def test_years_skip_zero(spark):
    assert one(spark, Y.add_years(F.lit(-1), 1), Y.add_years(F.lit(1), -1), Y.add_years(F.lit(-5), 10)) == (1, -1, 6)
    assert one(spark, Y.norm_year(F.lit(0)), Y.norm_year(F.lit(0), True)) == (1, -1)
    assert one(spark, *[Y.span_years(F.lit(a), F.lit(b)) for a, b in ((-5, 5), (1, 10), (-10, -1))]) == (10, 10, 10)
    assert one(spark, Y.year_distance(F.lit(-1), F.lit(1))) == (1,)
    assert one(spark, *[Y.date_tolerance(F.lit(a), F.lit(b)) for a, b in ((1310, 1490), (1000, 1600))]) == (25, 60)


@pytest.mark.parametrize(
    ("typed", "year"),
    [("1453", 1453), ("-500", -500), ("500 BC", -500), ("500 B.C.", -500), ("AD 33", 33), ("33 CE", 33), ("3,400 BCE", -3400), ("−500", -500), ("0", None), ("-500 BC", None), ("AD 33 AD", None), ("1453.5", None), ("", None)],
)
def test_parse_year(spark, typed, year):
    assert one(spark, Y.parse_year(F.lit(typed))) == (year,)


def test_clamp_year(spark):
    assert one(spark, *[Y.clamp_year(F.lit(y), -10, 10) for y in (0.2, -0.2, 99.0, -99.0, 2.5)]) == (1, -1, 10, -10, 3)


def test_frames(spark):
    r = records(spark, [(1, "a", -100, -1), (2, "b", 1, 50), (3, "c", -20, 30)])
    points = intervals.change_points(r, -100, 100)
    assert sorted(x.y for x in points.collect()) == [-100, -20, 1, 31, 51]
    spans = sorted(tuple(x) for x in intervals.frames(points, 2026).collect())
    assert spans[1:3] == [(-20, -1), (1, 30)]


def test_interval_join_is_complete(spark):
    random.seed(3)
    rows = [(i, "x", *sorted(random.choices([y for y in range(-300, 300) if y], k=2))) for i in range(60)]
    left, right = records(spark, rows[:30]), records(spark, rows[30:]).toDF("id2", "p2", "lo", "hi")
    got = sorted((r.id, r.id2) for r in intervals.interval_join(left, right, ("from_year", "to_year"), ("lo", "hi"), 50).collect())
    assert got == sorted((a[0], b[0]) for a, b in itertools.product(rows[:30], rows[30:]) if a[2] <= b[3] and b[2] <= a[3])


def test_split_then_coalesce_is_identity(spark):
    r = records(spark, [(1, "a", -70, 90), (2, "b", 5, 9), (3, "c", -3, 200)])
    pieces = intervals.split(r, -2, 40)
    assert {(x.pid, x.from_year, x.to_year) for x in pieces.filter("pid = 'a'").collect()} == {("a", -70, -3), ("a", -2, 40), ("a", 41, 90)}
    back = intervals.coalesced(pieces, ["pid"]).select("pid", "from_year", "to_year")
    assert sorted(map(tuple, back.collect())) == [("a", -70, 90), ("b", 5, 9), ("c", -3, 200)]
    assert pieces.filter("from_year = 0 OR to_year = 0").count() == 0


def test_complement(spark):
    r = records(spark, [(1, "a", -50, -1), (2, "a", 11, 20)])
    assert sorted((x.from_year, x.to_year) for x in intervals.complement(r, ["pid"], -60, 30).collect()) == [(-60, -51), (1, 10), (21, 30)]


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 10), ("j", 1)], "key string, t int")
    right = spark.createDataFrame([("k", 6, "x"), ("k", 9, "y")], "key string, at int, v string")
    assert sorted((r.key, r.t, r.v) for r in intervals.as_of(left, right, "t", "at", ["key"]).collect()) == [("j", 1, None), ("k", 5, None), ("k", 10, "y")]


def test_runs(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate("aabba")], "k int, t int, s string")
    assert sorted((r.start, r.end, r.s) for r in intervals.runs(df, "k", ["t"], "s", "t").collect()) == [(0, 1, "a"), (2, 3, "b"), (4, 4, "a")]


def test_normalize_text(spark):
    for raw, key in (("Đại Việt", "dai viet"), ("Hawaiʻi", "hawaii"), ("Straße & Co.", "strasse co"), ("  Łódź—Ma'rib ", "lodz marib")):
        assert one(spark, T.normalize_text(F.lit(raw))) == (key,)


def test_near_prefix(spark):
    for token, word, hit in (("rome", "roman", True), ("ottomon", "ottoman", True), ("byzantnie", "byzantine", True), ("rom", "ram", False), ("xome", "rome", False), ("rome", "paris", False)):
        assert one(spark, T.near(F.lit(word), token)) == (hit,), token


def test_search(spark):
    names = spark.createDataFrame([("p1", "Kingdom of France", ["Francia"]), ("p2", "France", None), ("p3", "Frankish Empire", []), ("p4", None, ["France Antarctique"])], "pid string, name string, alt_names array<string>")
    got = [(r.pid, r.score, r.matched) for r in search.search(names, "france").collect()]
    assert got == [("p2", 0, None), ("p1", 2, None), ("p4", 5, "France Antarctique")]
    assert [r.pid for r in search.search(names, "farnce").collect()][:2] == ["p2", "p1"]
    assert search.search(names, "  ").count() == 0


def test_components_levels_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert {tuple(r) for r in graph.reachable(edges).collect()} == {(1, 2), (1, 3), (2, 3), (5, 6)}
    done, cyclic = graph.levels(edges.union(spark.createDataFrame([(8, 9), (9, 8)], "a long, b long")))
    assert {tuple(r) for r in done.collect()} == {(1, 0), (2, 1), (3, 2), (5, 0), (6, 1)}
    assert {r.node for r in cyclic.collect()} == {8, 9}


def test_recipe_costs(spark):
    recipes = spark.createDataFrame([("a", "b", "c"), ("c", "c", "d"), ("x", "a", "e")], "x string, y string, result string")
    known = spark.createDataFrame([("a",), ("b",)], "item string")
    assert {tuple(r) for r in graph.recipe_costs(recipes, known).collect()} == {("a", 0), ("b", 0), ("c", 1), ("d", 2)}


def test_colouring(spark):
    edges = spark.createDataFrame([("a", "b", 10), ("b", "c", 5), ("a", "c", 7), ("c", "d", 1)], "a string, b string, w int")
    weight = lambda c: sum(w for a, b, w in edges.collect() if c[a] == c[b])
    assert weight(graph.coloured(edges, 3)) == 0
    assert weight(graph.coloured(edges, 2)) == 5


def test_smallest_arc_wraps(spark):
    df = spark.createDataFrame([("k", 170.0), ("k", -175.0), ("k", 179.0)], "k string, lon double")
    assert tuple(aggregates.smallest_arc(df, "k", "lon").first()) == ("k", 170.0, -175.0, 15.0)


def test_plans():
    assert furthest_within([1, 1, 1, 5, 1], 3, 10) == [(0, 2), (3, 3), (4, 4)]
    assert furthest_within([1] * 5, 10, 10, breaks=[2]) == [(0, 1), (2, 4)]
    assert furthest_within([1] * 4, 4, 10, measure=lambda a, z: 2.0 * (z - a + 1)) == [(0, 1), (2, 3)]
    blocks = near_equal_blocks([1] * 100, 5)
    assert blocks == sorted(blocks) and max(map(blocks.count, set(blocks))) <= 21


def test_recipe_route_of_all_parts(spark):
    from spanwright import registry

    sf = "/root/testdata/sf0.001"
    keys = sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    cost = {}
    for k in keys:
        cost[k] = 0 if k <= 2 else 1 + cost[k // 2] + (cost[k // 3] if k // 3 != k // 2 else 0)
    assert len(keys) > 12 and {r.item: r.cost for r in registry.queries()["recipe_route_all"](spark, sf).collect()} == cost


def test_ids_without_their_work_are_not_claimed():
    from spanwright import registry

    assert not {"K22", "K30", "K33", "K39", "L12"} & set(registry.coverage())


def as_of_by_hand(left, right, by):
    out = []
    for row in left:
        k, at = row["k"], row["at"]
        fits = [r for r in right if r["since"] is not None and at is not None and r["since"] <= at and (not by or k is not None and r["k"] == k)]
        best = max(fits, key=lambda r: (r["since"], r["v"]), default=None)
        out.append((k, at, best and best["v"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("by", [["k"], []])
def test_as_of_against_brute_force(spark, by):
    rng = random.Random(7)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", "left only"])
    left = [{"k": key(), "at": rng.randint(-900, 900)} for _ in range(400)] + [{"k": None, "at": 3}, {"k": "hot", "at": None}, {"k": "hot", "at": -100_000}, {"k": "hot", "at": 256}]
    right = [{"k": rng.choice(["hot"] * 8 + ["a", "b", "right only"]), "since": rng.randint(-900, 900), "v": i} for i in range(120)] + [{"k": "hot", "since": 256, "v": 500}, {"k": "hot", "since": 256, "v": 501}, {"k": None, "since": 1, "v": 502}, {"k": "hot", "since": None, "v": 503}]
    l, r = spark.createDataFrame(left, "k string, at int").repartition(4), spark.createDataFrame(right, "k string, since int, v int").repartition(3)
    r = r if by else r.drop("k")
    for some in (l, l.limit(0)):
        for width in (256, 10):
            got = sorted(((x.k, x.at, x.v) for x in intervals.as_of(some, r, "at", "since", by, width).collect()), key=str)
            assert got == (as_of_by_hand(left, right, by) if some is l else [])
    none = intervals.as_of(l, r.limit(0), "at", "since", by)
    assert none.filter("v IS NULL").count() == len(left) == none.count()


def test_as_of_of_sparse_keys(spark):
    """Each key holds one right row, far before its only left row: as many rows as places come out of it, not one for each bucket between."""
    n = 100_000
    left = spark.range(n).select(F.col("id").alias("k"), F.lit(10**15).alias("at"))
    right = spark.range(0, n, 2).select(F.col("id").alias("k"), (F.col("id") % 7).alias("since"), F.col("id").alias("v"))
    got = intervals.as_of(left, right, "at", "since", ["k"], 16)
    assert got.agg(F.count("*"), F.count("v"), F.sum((F.col("v") == F.col("k")).cast("int"))).first()[:] == (n, n // 2, n // 2)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_interval_join_by_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aab"), lo, lo + rng.randint(0, 200)) for i in range(80) for lo in [rng.randint(1, 900)]]
    df = spark.createDataFrame(rows, "id int, k string, lo int, hi int")
    other = df.withColumnsRenamed({"id": "id2", "lo": "lo2", "hi": "hi2"})
    got = intervals.interval_join(df, other, ("lo", "hi"), ("lo2", "hi2"), by=["k"]).select("id", "id2").collect()
    expected = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert len(got) == len(expected) and {tuple(x) for x in got} == expected


def test_full_diff_with_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "e"), (None, "n")], "k int, v string")
    got = {r.k: r.action for r in aggregates.full_diff(old, new, "k", ["v"]).collect()}
    assert got == {1: "same", 2: "update", 3: "update", 4: "remove", 5: "add", None: "same"}
