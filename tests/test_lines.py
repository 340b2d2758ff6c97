"""Simplification of lines against recursion in plain Python."""

from __future__ import annotations

import random

import pytest

from spanwright.operators import lines as L

SCHEMA = "line string, place int, x double, y double, tolerance double, note string"


def kept(points: list[tuple], tolerance: float, must: int) -> list[int]:
    """Places of the inner points to keep, by recursion over (place, x, y) in order."""
    (_, ax, ay), (_, bx, by) = points[0], points[-1]
    ux, uy = bx - ax, by - ay
    best, at = 0.0, None
    for i, (_, x, y) in enumerate(points[1:-1], 1):
        along, length2 = (x - ax) * ux + (y - ay) * uy, ux * ux + uy * uy
        if length2 == 0 or along <= 0:
            d2 = (x - ax) ** 2 + (y - ay) ** 2
        elif along >= length2:
            d2 = (x - bx) ** 2 + (y - by) ** 2
        else:
            d2 = (ux * (y - ay) - uy * (x - ax)) ** 2 / length2
        if d2 > best:
            best, at = d2, i
    if at is None or not (best > tolerance**2 or must > 0):
        return []
    return kept(points[: at + 1], tolerance, must - 1) + [points[at][0]] + kept(points[at:], tolerance, must - 1)


def lines() -> dict[str, tuple[float, list[tuple]]]:
    rng = random.Random(5)
    out = {}
    for n in range(40):
        x = y = 0
        points = []
        for k in range(rng.choice([1, 2, 3, 9, 20] if n else [200])):
            points.append((k * 3, float(x), float(y)))
            x, y = x + rng.randint(-2, 3), y + rng.randint(-3, 3)
        if n % 4 == 0:
            points.append((len(points) * 3, points[0][1], points[0][2]))
        out[f"l{n}"] = (rng.choice([0.0, 1.0, 2.5, 50.0]), points)
    out["straight"] = (0.0, [(k, float(k), float(2 * k)) for k in range(50)])
    out["one place"] = (1.0, [(k, 4.0, 4.0) for k in range(20)])
    out["zigzag"] = (1.0, [(k, float(k), float(k % 2) * 1000 + k) for k in range(160)])
    return out


@pytest.mark.parametrize("block", [2, 150, 4096])
def test_simplified_against_recursion(spark, block):
    want, rows = set(), []
    for name, (tolerance, points) in lines().items():
        if block < 100 and name in ("zigzag", "l0"):  # many rounds
            continue
        ends = {points[0][0], points[-1][0]}
        closed = points[0][1:] == points[-1][1:]
        want |= {(name, p) for p in ends | set(kept(points, tolerance, 2 if closed else 0))}
        rows += [(name, *p, tolerance, "x") for p in points]
    random.Random(1).shuffle(rows)
    got = [(r["line"], r["place"]) for r in L.simplified(spark.createDataFrame(rows, SCHEMA).repartition(5), block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 60 < len(want) < len(rows) - 60


def test_simplified_on_odd_rows(spark):
    rows = [
        (None, 1, 0.0, 0.0, 1.0, ""), ("a", None, 0.0, 0.0, 1.0, ""), ("a", 1, None, 0.0, 1.0, ""), ("a", 2, float("nan"), 0.0, 1.0, ""), ("a", 3, 0.0, 0.0, None, ""),
        ("b", 1, 0.0, 0.0, 1.0, ""), ("b", 2, 1.0, 0.0, 1.0, ""), ("b", 2, 1.0, 9.0, 1.0, ""), ("b", 2, 1.0, 9.0, 1.0, ""), ("b", 3, 2.0, 0.0, 7.0, ""), ("c", 5, 1.0, 2.0, 0.0, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[:] for r in L.simplified(df).collect()) == [("b", 1, 0.0, 0.0), ("b", 2, 1.0, 9.0), ("b", 3, 2.0, 0.0), ("c", 5, 1.0, 2.0)]
    assert L.simplified(df.limit(0)).count() == 0


def test_a_ring_does_not_vanish(spark):
    ring = [("r", k, *p, 100.0, "") for k, p in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    assert L.simplified(spark.createDataFrame(ring, SCHEMA)).count() == 5
