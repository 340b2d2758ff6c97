"""The merge of a regenerated table with its reviews, case by case."""

from __future__ import annotations

from spanwright.operators.reviewed import reviewed_merge

GENERATED, REVIEWED = "id string, v int", "id string, v int, status string, by string"


def test_reviewed_merge(spark):
    cases = {  # generated before, generated now, reviewed, result
        "new": (None, 1, None, (1, None, None, "new")),
        "same": (1, 1, (1, None, None), (1, None, None, "same")),
        "updated": (1, 2, (1, None, None), (2, None, None, "updated")),
        "gone": (1, None, (1, None, None), (1, None, None, "gone")),
        "gone before": (1, None, None, (1, None, None, "gone")),
        "removed": (1, 1, None, (1, None, None, "removed")),
        "removed, changed": (1, 2, None, (2, None, None, "removed, changed")),
        "kept for its decision": (1, None, (1, "active", None), (1, "active", None, "kept")),
        "kept for its edit": (1, None, (5, None, None), (5, None, None, "kept")),
        "by hand": (None, None, (5, None, None), (5, None, None, "kept")),
        "edited": (1, 1, (5, None, None), (5, None, None, "edited")),
        "edited and decided": (1, 1, (5, None, "x"), (5, None, "x", "edited")),
        "decided": (1, 1, (1, "no", "x"), (1, "no", "x", "agreed")),
        "decided, changed": (1, 2, (1, "no", "x"), (1, "no", "x", "conflict")),
        "edited, changed": (1, 2, (5, None, None), (5, None, None, "conflict")),
        "edited alike": (1, 2, (2, None, None), (2, None, None, "same")),
        "by hand alike": (None, 2, (2, "ok", None), (2, "ok", None, "agreed")),
        "by hand, other": (None, 2, (3, None, None), (3, None, None, "conflict")),
        None: (1, 2, (1, None, None), (2, None, None, "updated")),
    }
    b = spark.createDataFrame([(k, c[0]) for k, c in cases.items() if c[0]] + [("same", 0)], GENERATED)
    n = spark.createDataFrame([(k, c[1]) for k, c in cases.items() if c[1]] + [("null", None)], GENERATED)
    r = spark.createDataFrame([(k, *c[2]) for k, c in cases.items() if c[2]] + [("null", None, None, None)], REVIEWED)
    got = {row["id"]: tuple(row)[1:] for row in reviewed_merge(b, n, r, "id", ["status", "by"]).collect()}
    assert got == {k: c[3] for k, c in cases.items()} | {"null": (None, None, None, "same")}
    assert reviewed_merge(b.limit(0), n.limit(0), r.limit(0), "id", ["status", "by"]).count() == 0
