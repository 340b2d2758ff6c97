"""Noding and despiking against plain Python."""

from __future__ import annotations

import random

import pytest

from spanwright.operators import noding as N

SCHEMA = "ring string, place int, x double, y double, note string"


def frame(spark, rings):
    rows = [(name, 3 * i, float(x), float(y), "") for name, points in rings.items() for i, (x, y) in enumerate(points)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def collected(df):
    out = {}
    for r in df.orderBy("ring", "place").collect():
        assert r["place"] == len(out.setdefault(r["ring"], []))
        out[r["ring"]].append((r["x"], r["y"]))
    assert all(r["size"] == len(out[r["ring"]]) for r in df.collect())
    return out


def with_near(rings, eps):
    """All vertices against all sides."""
    points = {p for ring in rings.values() for p in ring}
    out = {}
    for name, ring in rings.items():
        out[name] = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            out[name].append((ax, ay))
            length2, found = (bx - ax) ** 2 + (by - ay) ** 2, []
            for x, y in points:
                along, across = (x - ax) * (bx - ax) + (y - ay) * (by - ay), (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                ends = min((x - ax) ** 2 + (y - ay) ** 2, (x - bx) ** 2 + (y - by) ** 2)
                if 0 < along < length2 and across**2 <= eps**2 * length2 and ends > eps**2:
                    found.append((along, x, y))
            out[name] += [(x, y) for _, x, y in sorted(found)]
    return out


def reduced(ring):
    """A ring's vertices, one cancellation after the other, anywhere, from its least rotation."""
    ring, changed = list(ring), True
    while changed and len(ring) > 1:
        changed = False
        for i in range(len(ring)):
            if ring[i] == ring[i - 1]:
                del ring[i]
                changed = True
                break
            if ring[i - 2] == ring[i] and len(ring) > 2:
                for j in sorted({(i - 1) % len(ring), i}, reverse=True):
                    del ring[j]
                changed = True
                break
    return min(ring[i:] + ring[:i] for i in range(len(ring))) if len(ring) > 2 else []


@pytest.mark.parametrize("cell", [0.5, 3.0, 50.0])
def test_noded_against_all_pairs(spark, cell):
    rng = random.Random(2)
    rings = {f"r{n}": [(rng.randint(-40, 40) / 2, rng.randint(-40, 40) / 2) for _ in range(rng.choice([3, 4, 9]))] for n in range(25)}
    rings["long"] = [(-20.0, -20.1), (20.0, 19.9), (20.0, -20.0)]
    rings["level"] = [(-20.0, 3.0), (20.0, 3.0), (20.0, 3.2), (-20.0, 3.2)]
    want = with_near(rings, 0.3)
    assert collected(N.noded(N.open_rings(frame(spark, rings)), 0.3, cell=cell)) == want
    assert sum(map(len, want.values())) > sum(map(len, rings.values())) + 100


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_despiked_against_single_steps(spark, block):
    rng = random.Random(4)
    rings = {}
    for n in range(40):
        ring = [(rng.randint(0, 2), rng.randint(0, 1)) for _ in range(rng.choice([1, 2, 3, 8, 30]))]
        for _ in range(rng.randint(0, 4)):  # ways out and back, deep ones too
            at, way = rng.randrange(len(ring)), [(rng.randint(3, 9), 5) for _ in range(rng.randint(1, 12))]
            ring[at + 1 : at + 1] = way + way[-2::-1] + [ring[at]]
        at = rng.randrange(len(ring))
        rings[f"r{n}"] = ring[at:] + ring[:at]
    got = collected(N.despiked(N.open_rings(frame(spark, rings)), block))
    want = {k: v for k, v in ((k, reduced([tuple(map(float, p)) for p in v])) for k, v in rings.items()) if v}
    assert {k: min(v[i:] + v[:i] for i in range(len(v))) for k, v in got.items()} == want
    assert 8 < len(want) < 40


def test_odd_rows(spark):
    rows = [
        (None, 1, 0.0, 0.0, ""), ("a", None, 0.0, 0.0, ""), ("a", 1, None, 0.0, ""), ("a", 2, float("nan"), 0.0, ""), ("a", 2, float("inf"), 0.0, ""), ("one", 7, 1.0, 1.0, ""),
        ("b", 1, 0.0, 0.0, ""), ("b", 5, 4.0, 0.0, ""), ("b", 5, 4.0, -1.0, ""), ("b", 9, 4.0, 4.0, ""), ("b", 9, 4.0, 4.0, ""), ("b", 12, 0.0, 0.0, ""), ("still", 1, 2.0, 2.0, ""), ("still", 2, 2.0, 2.0, ""),
    ]
    rings = N.open_rings(spark.createDataFrame(rows, SCHEMA))
    want = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    assert collected(rings) == {"b": want, "one": [(1.0, 1.0)], "still": [(2.0, 2.0)]}
    # the diagonal of b passes the vertex of `one` and that of `still`
    assert collected(N.noded(rings, 0.1)) == {"b": want + [(2.0, 2.0), (1.0, 1.0)], "one": [(1.0, 1.0)], "still": [(2.0, 2.0)]}
    assert collected(N.despiked(rings)) == {"b": want}
    none = N.open_rings(spark.createDataFrame([], SCHEMA))
    assert N.noded(none, 0.1).count() == 0 and N.despiked(none).count() == 0
