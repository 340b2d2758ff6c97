"""Specifications, assignment, coast rules and rings against plain Python on small random maps."""

from __future__ import annotations

import random

import pytest

from spanwright.operators import assign as A
from spanwright.operators import coast as K
from spanwright.operators import rings as R
from spanwright.operators import specs as S

NODES = "tree int, node string, parent string, place int, op string, kind string, codes array<string>, pid string, year int"
NAMED, RECORDS = "kind string, code string, x int, y int", "pid string, from_year int, to_year int, x int, y int"


def random_tree(rng: random.Random, tree: int, depth: int, names: list, parent=None, place=0) -> list[tuple]:
    name = f"n{len(names)}"
    names.append(name)
    if depth == 0 or rng.random() < 0.15:
        if rng.random() < 0.3:
            return [(tree, name, parent, place, "record", None, None, *rng.choice([("p", -3), ("p", 1), ("p", 7), ("q", 7), ("r", -3)] * 9 + [("r", 1)]))]
        return [(tree, name, parent, place, "codes", rng.choice(["a", "b"]), rng.choices(["1", "2", "3", "4"] + ["9"] * (rng.random() < 0.02), k=rng.randrange(1, 3)), None, None)]
    op = rng.choice(["union", "intersection", "difference"])
    rows = [(tree, name, parent, place, op, None, None, None, None)]
    for k in range(rng.randrange(2, 4)):
        rows += random_tree(rng, tree, depth - 1, names, name, k)
    return rows


def evaluated(rows, named, records):
    """The area of a tree by recursion, None where a part has a problem."""
    children = {}
    for r in rows:
        children.setdefault(r[2], []).append(r)

    def area(r):
        if r[4] == "codes":
            known = {(k, c) for k, c, _, _ in named}
            return None if any((r[5], c) not in known for c in r[6]) else {(x, y) for k, c, x, y in named if k == r[5] and c in r[6]}
        if r[4] == "record":
            return {(x, y) for p, lo, hi, x, y in records if p == r[7] and lo <= r[8] <= hi} or None
        parts = [area(c) for c in sorted(children[r[1]], key=lambda c: c[3])]
        if any(p is None for p in parts):
            return None
        return set.union(*parts) if r[4] == "union" else set.intersection(*parts) if r[4] == "intersection" else parts[0].difference(*parts[1:])

    return area(children[None][0])


def test_specs_against_recursion(spark):
    rng = random.Random(1)
    named = [(k, c, x, y) for k in "ab" for c in "1234" for x in range(6) for y in range(5) if rng.random() < 0.4]
    records = [("p", -5, 5, 1, 1), ("p", -5, 5, 2, 1), ("p", 6, 9, 3, 3), ("q", 1, 9, 4, 4), ("q", 1, 9, 4, 4), ("r", -9, -3, 0, 0)]
    trees = {t: random_tree(rng, t, 5, []) for t in range(60)}
    areas, problems = S.resolved(spark.createDataFrame([r for rows in trees.values() for r in rows], NODES), spark.createDataFrame(named, NAMED), spark.createDataFrame(records, RECORDS))
    got: dict = {}
    for r in areas.collect():
        got.setdefault(r["tree"], []).append((r["x"], r["y"]))
    bad = {r["tree"] for r in problems.collect()}
    want = {t: evaluated(rows, named, records) for t, rows in trees.items()}
    assert bad == {t for t, a in want.items() if a is None} and 0 < len(bad) < 50
    assert {t: set(c) for t, c in got.items()} == {t: a for t, a in want.items() if a} and all(len(c) == len(set(c)) for c in got.values())


def test_spec_problems(spark):
    leaf = lambda t, n, p, k, codes=("1",): (t, n, p, k, "codes", "a", codes and list(codes), None, None)
    op = lambda t, n, p, k, kind: (t, n, p, k, kind, None, None, None, None)
    rows = [
        op(1, "a", None, 0, "union"), op(2, "a", None, 0, "difference"), leaf(2, "b", "a", 1), op(3, "a", None, 0, "difference"), leaf(3, "b", "a", 0),
        leaf(4, "a", None, 0, ()), leaf(5, "a", None, 0, None), leaf(6, "a", None, 0, ("1", "7")), (7, "a", None, 0, "record", None, None, "p", None), (8, "a", None, 0, "record", None, None, "p", 50), (9, "a", None, 0, None, None, None, None, None),
        leaf(10, "a", None, 0), leaf(10, "b", None, 0), op(11, "a", "b", 0, "union"), op(11, "b", "a", 0, "union"), leaf(12, "a", "zz", 0), leaf(13, "a", None, 0), leaf(13, "b", "a", 0),
        op(14, "a", None, 0, "union"), leaf(14, "b", "a", 0), op(14, "c", "a", 1, "intersection"), leaf(14, "d", "c", 0), leaf(14, "e", "c", 1, ("2", "1", "2")), leaf(15, "a", None, 0, ("1", None)),
    ]
    areas, problems = S.resolved(spark.createDataFrame(rows, NODES), spark.createDataFrame([("a", "1", 0, 0), ("a", "2", 0, 1)], NAMED), spark.createDataFrame([("p", 1, 9, 3, 3)], RECORDS))
    found = {(r["tree"], r["node"]): r["problem"] for r in problems.collect()}
    assert found == {
        (1, "a"): "no parts", (2, "a"): "no base", (3, "a"): "nothing to take away", (4, "a"): "no codes", (5, "a"): "no codes", (6, "a"): "unknown code 7", (7, "a"): "record without id or year", (8, "a"): "no record alive",
        (9, "a"): "unknown operation null", (10, None): "not one root", (11, "a"): "below or on a cycle, or over a problem", (11, "b"): "below or on a cycle, or over a problem", (11, None): "not one root",
        (12, "a"): "parent is missing or a leaf", (12, None): "not one root", (13, "b"): "parent is missing or a leaf", (15, "a"): "unknown code null",
    }
    assert {tuple(r) for r in areas.collect()} == {(14, 0, 0)}


def test_specs_without_rows(spark):
    areas, problems = S.resolved(spark.createDataFrame([], NODES), spark.createDataFrame([], NAMED), spark.createDataFrame([], RECORDS))
    assert areas.isEmpty() and problems.isEmpty()


def by_rules(land, owned, near, ratio, share, gap):
    """The rules cell by cell."""
    rule = {c: (o, "claim", 0) for c, o in owned.items()}

    def parts(cells):
        left, out = set(cells), []
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                c = todo.pop()
                group.add(c)
                for n in ((c[0] + dx, c[1] + dy) for dx, dy in K.FOUR):
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            out.append(group)
        return out

    islands = parts(land)
    for island in islands:
        counts = {}
        for c in island & owned.keys():
            counts[owned[c]] = counts.get(owned[c], 0) + 1
        top = max(counts, key=lambda o: (counts[o], o), default=None)
        if top is not None and counts[top] > share * len(island):
            rule.update({c: (top, "majority", 0) for c in island - owned.keys()})
    waiting, k = [i for i in islands if not i & owned.keys()], 0
    while waiting:
        k, won = k + 1, []
        for island in waiting:
            far = {}
            for c in island:
                for o, (owner, *_) in rule.items():
                    d2 = (c[0] - o[0]) ** 2 + (c[1] - o[1]) ** 2
                    if d2 <= (near * ratio) ** 2:
                        far[owner] = min(far.get(owner, d2), d2)
            best = sorted((d, o) for o, d in far.items())[:2]
            if best and best[0][0] <= near**2 and (len(best) == 1 or best[1][0] >= ratio**2 * best[0][0]):
                won.append((island, best[0][1]))
        if not won:
            break
        for island, owner in won:
            rule.update({c: (owner, "island", k) for c in island})
            waiting.remove(island)
    for part in parts(land - rule.keys()):
        around = {rule[n][0] for c in part for n in ((c[0] + dx, c[1] + dy) for dx, dy in K.FOUR) if n in rule}
        if len(around) == 1:
            rule.update({c: (around.copy().pop(), "pocket", 0) for c in part})
    before, of = dict(rule), {c: i for i, island in enumerate(islands) for c in island}
    for c in land - before.keys():
        close = [((c[0] - o[0]) ** 2 + (c[1] - o[1]) ** 2, v[0]) for o, v in before.items() if of[o] == of[c] and (c[0] - o[0]) ** 2 + (c[1] - o[1]) ** 2 <= gap**2]
        rule[c] = (min(close)[1], "gap", 0) if close else (None, "unclaimed", 0)
    return {(*c, *v) for c, v in rule.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_coast_rules_cell_by_cell(spark, seed):
    rng = random.Random(seed)
    land = {(x, y) for x in range(-8, 14) for y in range(-6, 10) if rng.random() < (0.3, 0.45)[seed]}
    owned = {c: rng.choice("ABC") for c in sorted(land) if rng.random() < (0.06, 0.2)[seed]}
    got = K.settled(spark.createDataFrame(sorted(land), "x int, y int"), spark.createDataFrame([(*c, o) for c, o in owned.items()], "x int, y int, owner string"), share=0.4)
    assert {(r["x"], r["y"], r["owner"], r["rule"], r["round"]) for r in got.collect()} == by_rules(land, owned, 3, 2, 0.4, 1)


def test_coast_chain_and_tie(spark):
    """Islands two apart follow each other from A; one in the middle between A and B is left."""
    land = [(x, 0) for x in range(0, 13, 2)] + [(0, 20), (3, 20), (6, 20)]
    got = {(r["x"], r["y"]): (r["owner"], r["rule"], r["round"]) for r in K.settled(spark.createDataFrame(land, "x int, y int"), spark.createDataFrame([(0, 0, "A"), (0, 20, "A"), (6, 20, "B"), (50, 50, "C")], "x int, y int, owner string")).collect()}
    assert got[2, 0] == ("A", "island", 1)
    assert all(got[x, 0][0] == "A" for x in range(0, 13, 2)) and got[12, 0][2] > got[4, 0][2] >= 1
    assert got[3, 20] == (None, "unclaimed", 0)
    empty = K.settled(spark.createDataFrame([], "x int, y int"), spark.createDataFrame([], "x int, y int, owner string"))
    assert empty.isEmpty()


def test_assign_in_order(spark):
    """Later entries win, the largest record of tier 0 is the target, losers give up cells, other tiers keep theirs."""
    holdings = [("f", 1, "p", 0, 0, 0), ("f", 1, "p", 0, 1, 0), ("f", 2, "p", 0, 5, 5), ("f", 3, "q", 0, 2, 0), ("f", 4, "r", 1, 2, 0), ("g", 5, "q", 0, 2, 0)]
    frames = [("f", -10, -1), ("g", 1, 10)]
    entries = [(1, 1, "p", -10, -1), (2, 2, "q", -10, 10), (3, 3, "r", -10, -1), (4, 4, "none", -10, -1), (5, 5, "q", -3, -1), (6, 6, "q", -10, -1)]
    areas = [(1, 2, 0), (1, 3, 0), (1, 3, 0), (2, 3, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 9, 9)]
    after, log = A.assign(
        spark.createDataFrame(holdings, "frame string, record int, pid string, tier int, x int, y int"), spark.createDataFrame(frames, "frame string, from_year int, to_year int"),
        spark.createDataFrame(entries, "entry int, place int, pid string, from_year int, to_year int"), spark.createDataFrame(areas, "entry int, x int, y int"),
    )
    assert {(r["frame"], r["record"], r["tier"], r["x"], r["y"]) for r in after.collect()} == {
        ("f", 1, 0, 1, 0), ("f", 1, 0, 2, 0), ("f", 2, 0, 5, 5), ("f", 3, 0, 3, 0), ("f", 3, 0, 0, 0), ("f", 3, 0, 9, 9), ("f", 4, 1, 2, 0), ("g", 5, 0, 2, 0), ("g", 5, 0, 3, 0), ("g", 5, 0, 0, 0),
    }
    assert {(r["frame"], r["entry"]): (r["status"], r["straddles"], r["cells"], r["won"]) for r in log.collect()} == {
        ("f", 1): ("applied", False, 2, 1), ("f", 2): ("applied", False, 2, 2), ("g", 2): ("applied", False, 2, 2), ("f", 3): ("error", False, 1, 0), ("f", 4): ("stale", False, 1, 0), ("f", 5): ("applied", True, 1, 1), ("f", 6): ("empty", False, 0, 0),
    }


def test_lists_and_cycles_are_ranked(spark):
    rng, links, want = random.Random(2), [], set()
    ids = rng.sample(range(10_000), 700)
    for n, closed in ((1, False), (1, True), (2, True), (3, True), (64, True), (65, False), (100, True), (129, False), (200, True), (5, False)):
        some, ids = ids[:n], ids[n:]
        links += [(x, some[k - 1] if k or closed else None) for k, x in enumerate(some)]
        start = some.index(min(some)) if closed else 0
        want |= {(some[(start + k) % n], some[start], k) for k in range(n)}
    assert {tuple(r) for r in R.ranked(spark.createDataFrame(links, "item long, prev long")).collect()} == want


def walked(owner: dict) -> set[tuple]:
    """Rings of a map by walking: (owner, sides, corners, area) and the first side's number."""
    steps, out, done = R.STEPS, set(), set()
    right_of = lambda x, y, d: (x + (0, 1, 0, -1)[d], y + (-1, 0, 1, 0)[d])
    num = lambda x, y, d: ((x + R.HALF) * (2 * R.HALF) + y + R.HALF) * 4 + d
    for (x, y), o in owner.items():
        for d in range(4):
            if owner.get(right_of(x, y, d)) == o or (x, y, d) in done:
                continue
            at, ring = (x, y, d), []
            while at not in done:
                done.add(at)
                ring.append(at)
                cx, cy, k = at
                ahead = (cx + steps[k][0], cy + steps[k][1])
                across = right_of(*ahead, k)
                at = (cx, cy, (k + 1) % 4) if owner.get(ahead) != o else (*across, (k + 3) % 4) if owner.get(across) == o else (*ahead, k)
            area = 0
            for cx, cy, k in ring:
                px, py = cx + (k in (1, 2)), cy + (k in (2, 3))
                area += px * steps[k][1] - py * steps[k][0]
            out.add((o, min(num(*s) for s in ring), len(ring), sum(a[2] != b[2] for a, b in zip(ring, ring[1:] + ring[:1])), area // 2))
    return out


@pytest.mark.parametrize("owners", ["A", "ABC"])
def test_rings_against_a_walk(spark, owners):
    rng = random.Random(3)
    owner = {(x, y): rng.choice(owners) for x in range(-5, 7) for y in range(-4, 6) if rng.random() < 0.75}
    cells = spark.createDataFrame([(*c, o) for c, o in owner.items()], "x int, y int, owner string")
    rings = {tuple(r) for r in R.ring_table(cells).collect()}
    assert rings == walked(owner)
    # outer rings less holes are the areas
    for o in owners:
        assert sum(r[4] for r in rings if r[0] == o) == sum(v == o for v in owner.values())
    arcs = R.arcs(cells).collect()
    sides = {r["item"] for r in R.border_sides(cells).collect()}
    assert {r["item"] for r in arcs} == sides and len(arcs) == len(sides)
    walks = {}
    for r in arcs:
        walks.setdefault((r["arc"], r["owner"], r["other"]), []).append(r["rank"])
    assert all(sorted(k) == list(range(len(k))) for k in walks.values())
    for (arc, one, two), ranks in walks.items():
        assert two is None or len(walks[arc, two, one]) == len(ranks)


def test_maps_without_cells(spark):
    empty = spark.createDataFrame([], "x int, y int, owner string")
    assert R.ring_table(empty).isEmpty() and R.arcs(empty).isEmpty()
