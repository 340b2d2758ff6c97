"""Steps that failed, or would have, on larger tables: joins through the driver, pairs of equal points, large rounds."""

from __future__ import annotations

import os

import numpy as np
import pytest

from spanwright import registry
from spanwright.catalog import overrides
from spanwright.operators import aggregates, graph, intervals, lines, noding, spatial, specs
from spanwright.plans import materialise

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans that the operators checkpoint."""
    seen: list[str] = []

    def noted(df):
        seen.append(_plan(df))
        return materialise.checkpointed(df)

    for module in (graph, noding):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


@pytest.mark.parametrize("name", ["noded_rings", "cleaned_rings", "topological_levels", "recipe_route_all", "reachability", "order_components"])
def test_growing_sides_are_not_broadcast(spark, plans, name):
    plans.append(_plan(registry.queries()[name](spark, SF)))
    assert not [p for p in plans if "BroadcastExchange" in p]


@pytest.mark.parametrize("kind", ["whole", "flat", "steep", "real", "tiny"])
def test_farthest_by_boxes_of_runs(kind):
    rng = np.random.default_rng(3)
    x = np.arange(900.0)
    y = {"whole": rng.integers(0, 90, 900) * 1.0, "flat": rng.integers(0, 3, 900) * 1.0, "steep": rng.integers(0, 90, 900) * 100.0, "real": rng.normal(size=900), "tiny": 1e7 + rng.random(900) * 1e-3}[kind]
    if kind in ("steep", "tiny"):
        x = np.cumsum(rng.integers(-3, 4, 900)) * (1.0 if kind == "steep" else 1e-3)
    runs = lines._Runs(x, y, 16)
    for _ in range(400):
        i, j = sorted(rng.choice(900, 2, replace=False))
        if j - i > 1:
            d2 = lines._distances2(x[i + 1 : j], y[i + 1 : j], x[i], y[i], x[j], y[j])
            assert runs.farthest(i, j) == (d2.max(), i + 1 + d2.argmax())


def test_a_line_that_parts_near_its_ends_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(lines, "checkpointed", lambda df: rounds.append(1) or materialise.checkpointed(df))
    rows = spark.range(20_000).selectExpr("'a' AS line", "id AS place", "id AS x", "(id * 7919) % 100 AS y", "60.0 AS tolerance")
    assert lines.simplified(rows).count() > 100 and len(rounds) < 6


def test_equal_points_meet_once_for_a_place(spark):
    """Forty thousand points at four places: by points these were 400 million pairs."""
    left = spark.range(20_000).selectExpr("id", "CAST(id % 4 AS double) AS lon", "0.0 AS lat")
    right = spark.range(20_000).selectExpr("id", "CAST(id % 2 * 20 AS double) AS lon", "0.5 AS lat")
    got = {r[:] for r in spatial.nearest_unless_ambiguous(left, right, 3.0, 1.5).select("nearest", "reason").distinct().collect()}
    assert got == {(None, "ambiguous"), (None, "none")}
    one = right.filter("id < 2")
    got = {r[:] for r in spatial.nearest_unless_ambiguous(left, one, 3.0, 1.5).collect()}
    assert got == {(i, 0 if i % 4 < 3 else None, "alone" if i % 4 < 3 else "none") for i in range(20_000)}
    assert {r[1:] for r in spatial.counted_within(left, right, 2.5).collect()} == {(15_000, 0.25, 0)}


def test_frames_meet_years_and_not_records(spark):
    plan = registry.queries()["frame_alive_join"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # from the top down: the last aggregate, the join, and below it the aggregate of records of equal years
    assert "strategy=broadcast" in plan and plan.index("Join Inner") < plan.index("Aggregate [from_year")


def test_override_texts_do_not_take_a_file_each(spark):
    folder = overrides.written(spark, "/root/testdata/sf0.01").removeprefix("file:")
    files = [f for _, _, names in os.walk(folder) for f in names if f.startswith("part-")]
    assert spark.read.parquet(folder).count() == 59 > len(files)


def test_problems_of_specifications_need_no_areas(spark, monkeypatch):
    monkeypatch.setattr(specs, "_level", lambda *_: pytest.fail("areas of operations"))
    assert registry.queries()["spec_problems"](spark, SF).count() > 0


def test_a_child_of_many_operations_is_dealt_to_tasks(spark, monkeypatch):
    plans: list[str] = []
    monkeypatch.setattr(specs, "checkpointed", lambda df: plans.append(_plan(df)) or materialise.checkpointed(df))
    edges = spark.range(1000).selectExpr("concat('k', id) AS key", "'difference' AS op", "IF(id % 2 = 0, 'p', 'q') AS child", "true AS base")
    edges = edges.unionByName(edges.selectExpr("key", "op", "'q' AS child", "false AS base"))
    areas = spark.createDataFrame([(k, x, 0) for k, x in (("p", 1), ("p", 2), ("q", 2), ("q", 3))], "key string, x int, y int")
    got = {r[:] for r in specs._level(edges, areas).collect()}
    assert got == {(f"k{i}", 1, 0) for i in range(0, 1000, 2)}
    assert "share" in _plan(specs._level(edges, areas)) and not [p for p in plans if "BroadcastExchange" in p]


def test_holders_meet_change_points_and_not_years(spark):
    """Lives of a million years each, and rows around the missing year 0: a row for each year would be 400 million."""
    rows = spark.range(400).selectExpr("IF(id % 2 = 0, 'a', 'b') AS key", "id", "CAST(-1000000 + id AS int) AS from_year", "CAST(10 + id AS int) AS to_year", "IF(id < 200, 'x', 'y') AS kind")
    got = {r[:] for r in intervals.holders(rows, "key", ["from_year", "id"], "kind").collect()}
    assert got == {("a", "x", -1000000, -999801), ("a", "y", -999800, 408), ("b", "x", -999999, -999800), ("b", "y", -999799, 409)}


def test_holders_as_year_by_year(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        a = int(rng.integers(-40, 40))
        b = a + int(rng.integers(-2, 25))
        rows.append((f"k{rng.integers(0, 9)}", i // 2, *(y - 1 if y <= 0 else y for y in (a, b)), "xyz"[rng.integers(0, 3)]))
    rows += [("k1", None, 1, 5, "x"), ("k1", 9, None, 5, "x"), ("k2", 900, 100, 100, None)]
    held: dict = {}
    for key, i, a, b, kind in rows:
        if a is not None:
            for y in (y for y in range(a, b + 1) if y):
                top = (a, i is not None, i or 0, kind is not None, kind or "")
                held[key, y] = max(held.get((key, y), top), top)
    wanted, last = [], None
    for (key, y), top in sorted(held.items()):
        kind = top[4] or None
        if last and last[:2] == [key, kind] and last[3] == (y - 1 or -1):
            last[3] = y
        else:
            last = [key, kind, y, y]
            wanted.append(last)
    df = spark.createDataFrame(rows, "key string, id int, from_year int, to_year int, kind string")
    assert {r[:] for r in intervals.holders(df, "key", ["from_year", "id"], "kind").collect()} == {tuple(w) for w in wanted}


def test_tasks_of_pairs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "ROWS_OF_A_TASK", 100, raising=False)
    rows = spark.range(3000).selectExpr("id DIV 4 AS k", "id AS p", "1.0 AS w")
    pairs = aggregates.pair_weights(rows, "k", "p", "w")
    assert pairs.count() == 4500 and pairs.rdd.getNumPartitions() == 30
