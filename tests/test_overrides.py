"""The scan of override files against a walk over the same folder in plain Python."""

from __future__ import annotations

import json
import os
import random

from spanwright.sources import overrides as O

PRESENT = 2026


def years_of(v):
    """((from, to), error)"""
    if not isinstance(v, list) or len(v) != 2:
        return (None, None), "years must be [from, to]"
    a, b = (PRESENT if x == "present" else x for x in v)
    if not all(isinstance(x, int) and not isinstance(x, bool) for x in (a, b)):
        return (None, None), 'years must be integers or "present"'
    if 0 in (a, b):
        return (None, None), "there is no year 0"
    return ((a, b), None) if a <= b else ((None, None), "years run backwards")


def walk(root):
    files, entries, units, problems = [], [], [], []
    for kind in O.KINDS:
        names = sorted(os.listdir(root / kind)) if (root / kind).exists() else []
        for name in (n for n in names if n.endswith(".json")):
            file = f"{kind}/{name}"
            try:
                data = json.loads((root / kind / name).read_text())
            except ValueError:
                problems.append((file, None, "cannot read file"))
                continue
            if not isinstance(data, dict):
                problems.append((file, None, "file is not a JSON object"))
                continue
            if data.get("kind") != kind:
                problems.append((file, None, f"kind is {data.get('kind') or 'missing'}, read as {kind}"))
            if kind != "modern" and data.get("units"):
                problems.append((file, None, "units are read from modern files only"))
            n_units = 0
            for lists, key, what, out in (("entries", "id", "entry", entries), ("units", "unit", "unit", units)):
                for i, raw in enumerate(data.get(lists) or []) if lists == "entries" or kind == "modern" else ():
                    body = raw if isinstance(raw, dict) else {}
                    span, error = years_of(body.get("years"))
                    name_ = body.get(key) or f"{file}#{i}"
                    error = f"{what} is not an object" if not isinstance(raw, dict) else error or (None if body.get(key) else f"{what} has no {key}")
                    first = next((x for x in out if x[3] == name_), None)
                    if first:
                        problems.append((file, name_, f"{'id' if key == 'id' else 'unit'} is first in {first[0]}{'' if key == 'id' else ', this one is ignored'}"))
                        if key == "unit":
                            continue
                    n_units += key == "unit"
                    out.append((file, kind, i, name_, *span, body.get("status"), error))
            files.append((file, kind, data.get("region"), len(data.get("entries") or []), n_units))
    return files, entries, units, problems


def given(spark, root):
    return O.overrides(O.override_files(spark, str(root)), PRESENT)


def check(spark, root):
    got, want = given(spark, root), walk(root)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = [got.files.collect(), got.entries.drop("body").collect(), got.units.drop("body").collect(), got.problems.collect()]
    for ours, theirs in zip(rows, want):
        assert sorted((tuple(r) for r in ours), key=key) == sorted(theirs, key=key)
    return want


def test_random_folders(spark, tmp_path):
    rng = random.Random(3)

    def item(key):
        return rng.choice([7, "text", None, [1]]) if rng.random() < 0.08 else {
            **({key: f"{key}{rng.randint(0, 60)}"} if rng.random() < 0.9 else rng.choice([{}, {key: ""}])),
            "years": rng.choice([[1, 5], [-4, "present"], [5, 1], [0, 3], [3], "x", None, [1.5, 2], ["1", 2], [-9, -9], [1, 2, 3], [True, 4], [[1], 2]]),
            "note": 'a "quoted" {brace', **({"status": "active"} if rng.random() < 0.5 else {}),
        }

    for kind in (*O.KINDS, "other"):
        (tmp_path / kind).mkdir()
        for n in range(9):
            data = {"kind": kind if rng.random() < 0.8 else rng.choice(["early", None]), "region": rng.choice(["r1", "r2"])}
            for lists, key in (("entries", "id"), ("units", "unit")):
                if rng.random() < 0.8:
                    data[lists] = [item(key) for _ in range(rng.randint(0, 9))]
            text = json.dumps(data, indent=rng.choice([None, 2]))
            name = f"{rng.choice('abcABC')} +é%{n}.json"
            (tmp_path / kind / name).write_text(rng.choice([text[:-1], f"[{text}]", " ", "3"]) if rng.random() < 0.2 else text)
    (tmp_path / "early" / "notes.txt").write_text("{}")
    _, entries, units, problems = check(spark, tmp_path)
    assert len(entries) > 60 and len(units) > 10 and len({p[2].split(" in ")[0].split(",")[0] for p in problems}) >= 5


def test_order_of_kinds_and_names(spark, tmp_path):
    for kind, name, unit in (("modern", "b", 2), ("modern", "a", 1), ("early", "z", 0)):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(json.dumps({"kind": kind, "entries": [{"id": "x", "years": [1, 2]}], "units": [{"unit": "u", "years": [unit + 1, 9]}]}))
    check(spark, tmp_path)
    got = given(spark, tmp_path)
    assert [(r.file, r.from_year) for r in got.units.collect()] == [("modern/a.json", 2)]
    assert {(r.file, r.detail) for r in got.problems.filter("id = 'x'").collect()} == {("modern/a.json", "id is first in early/z.json"), ("modern/b.json", "id is first in early/z.json")}


def test_odd_rows(spark):
    none = spark.createDataFrame([], "kind string, name string, value string")
    assert [df.count() for df in O.overrides(none, PRESENT)] == [0, 0, 0, 0]
    odd = spark.createDataFrame([("early", "n.json", None, 1), (None, "m.json", "{}", 1), ("early", None, '{"kind":"early"}', 1), ("early", "l.json", '{"kind":"early","entries":5}', 1)], "kind string, name string, value string, file int")
    got = O.overrides(odd, PRESENT)
    assert sorted(r[0] for r in got.files.collect()) == ["early"]
    assert {tuple(r) for r in got.problems.collect()} == {("early/n.json", None, "cannot read file"), ("early/l.json", None, "cannot read file")}
