"""Nearest owners and poles against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from spanwright.operators import nearest as N


@pytest.mark.parametrize("by", [[], ["g"]])
def test_nearest_split_against_all_pairs(spark, by):
    rng = random.Random(3)
    group = lambda: rng.choice("aab") if by else "a"
    cells = [(group(), rng.randint(-40, 40), rng.randint(-25, 60)) for _ in range(700)] + [("a", 5, 900), ("a", -700, 2)]
    seeds = [(group(), rng.randint(-50, 30), rng.randint(-20, 30), rng.choice(["p", "q", "r", "é", "Z"])) for _ in range(60)] + [("a", 0, 0, "q"), ("a", 0, 0, "p"), ("a", 4, 0, "Z")]
    odd_cells, odd_seeds = [(None, 1, 1), ("a", None, 1), ("c", 1, 1)] if by else [("a", 1, None)], [("a", None, 0, "A"), ("a", 0, 1, None)] + [(None, 0, 0, "A"), ("d", 0, 0, "A")] * bool(by)
    got = N.nearest_split(spark.createDataFrame(cells * 2 + odd_cells, "g string, x int, y int").repartition(3), spark.createDataFrame(seeds + odd_seeds, "g string, x int, y int, owner string").repartition(3), by).collect()
    want = {(*([g] if by else []), x, y, *min(((x - a) ** 2 + (y - b) ** 2, o) for h, a, b, o in seeds if h == g)[::-1]) for g, x, y in cells}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nearest_split_of_nothing(spark):
    cells, seeds = spark.createDataFrame([(1, 1)], "x int, y int"), spark.createDataFrame([(1, 1, "a")], "x int, y int, owner string")
    assert N.nearest_split(cells.limit(0), seeds).count() == N.nearest_split(cells, seeds.limit(0)).count() == 0
    assert N.poles(seeds.limit(0)).count() == 0 and N.poles(seeds).first()[:] == ("a", 1, 1, 1)


def test_poles_against_all_pairs(spark):
    rng = random.Random(4)
    middles = [(rng.randint(0, 39), rng.randint(0, 29), f"o{k}") for k in range(9)]
    owner = {(x, y): min(((x - a) ** 2 + (y - b) ** 2, o) for a, b, o in middles)[1] for x in range(40) for y in range(30) if rng.random() < 0.995}
    got = {tuple(r) for r in N.poles(spark.createDataFrame([(x, y, o) for (x, y), o in owner.items()], "x int, y int, owner string").repartition(3)).collect()}
    box = [(x, y) for x in range(-1, 41) for y in range(-1, 31)]
    want = set()
    for o in set(owner.values()):
        outside = [c for c in box if owner.get(c) != o]
        d2 = {(x, y): min((x - a) ** 2 + (y - b) ** 2 for a, b in outside) for (x, y), w in owner.items() if w == o}
        x, y = min(c for c in d2 if d2[c] == max(d2.values()))
        want.add((o, x, y, d2[x, y]))
    assert got == want and len(want) == 9
