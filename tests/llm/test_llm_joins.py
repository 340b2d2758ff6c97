"""Hard negatives, the n-gram Jaccard join and spelling variants: odd rows against SQL, and groups of every size."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from spanwright.llm import hard_negatives, jaccard_join, spelling

DOCS = "doc_id long, text string, node string, n long, word string, prefix string, component string"
VECTORS = "vec_id long, embedding array<float>, label int, key long, codes string, n long"


def against_sql(df, table, run, sql):
    con = duckdb.connect()
    con.register("t", df.toArrow())
    con.sql(f"CREATE TABLE {table} AS SELECT * FROM t")
    same(run(df), con, sql)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", None, None) for i, t in rows], DOCS)


def negatives(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label=moved)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def random_vectors(n: int, kinds: int) -> list:
    rng = np.random.default_rng(5)
    return [(i, [float(x) for x in rng.normal(size=10) + (i % kinds)], int(rng.integers(0, kinds))) for i in range(n)]


ODD_VECTORS = [
    *random_vectors(450, 4),
    (100, [1.0] * 10, 1), (100, [1.0] * 10, 1), (100, [1.0] * 10, 1), (200, [1.0] * 10, 1), (7, [1.0] * 10, 0), (9, [1.0] * 10, 2), (9, [1.0] * 10, 2),
    (300, None, 1), (300, [1.0, None], 1), (300, [float("nan")], 1), (300, [float("inf")], 1), (None, [1.0], 1), (300, [1.0], None), (300, [], 1), (400, [0.5, 2.0], 3), (-100, [0.1] * 10, 2),
]


@pytest.mark.parametrize("rows", [ODD_VECTORS, [], [(100, [1.0, 2.0], 1)], [(100, [-1.0, 2.0], 1), (101, [1.0, -2.0], 1), (102, [1.0, -2.0], 3), (103, [0.0, 0.0], 1)]])
def test_hard_negatives_edges(spark, rows):
    against_sql(vectors(spark, rows), "embeddings", negatives, hard_negatives.SQL)


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATE_CELLS", 1024)
    monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", 36)
    monkeypatch.setattr(hard_negatives, "SLAB_SCORES", 64)
    against_sql(vectors(spark, ODD_VECTORS), "embeddings", negatives, hard_negatives.SQL)


def test_bounds_hold_the_scores_and_rule_out_rows():
    """The true score lies within the bound of the decoded one, whatever the codebooks, and most rows of far clusters are ruled out."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(600, 16)) * 20 + rng.integers(-3, 4, (600, 1)) * 400).astype(np.int64)
    import pandas as pd

    for fitted_to in (v, v[:3], np.zeros((0, 16), np.int64)):
        books = hard_negatives.codebooks(fitted_to)
        parts = v.reshape(600, -1, 4).astype(float)
        codes = np.stack([hard_negatives.nearest(parts[:, m], books[m]) for m in range(4)], axis=1).astype(np.uint8)
        rest = np.stack([np.sqrt(((parts[:, m] - books[m][codes[:, m]]) ** 2).sum(1)) for m in range(4)], axis=1)
        rows = pd.DataFrame({"vec_id": range(600), "label": 0, "key": range(600), "copy": 0, "v": [x.tobytes() for x in v], "codes": [x.tobytes() for x in codes], "rest": [x.tobytes() for x in rest]})
        block = hard_negatives.Block(rows)
        scores, reach = block.bounds(v[:50], books)
        assert (np.abs(v[:50] @ v.T - scores) <= reach).all()
        if fitted_to is v:
            least = hard_negatives.kth_highest(scores - reach, 5)
            assert (scores + reach >= least[:, None]).mean() < 0.4


WORDS = [f"w{i}" for i in range(400)]


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def families(sizes=(60, 45, 3, 2), length=90) -> list[tuple[int, str]]:
    """Families of edited copies around the threshold, and texts that share a long passage with nothing else."""
    rng, out = random.Random(4), []
    for n in sizes:
        base = [rng.choice(WORDS) for _ in range(length)]
        out += [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(n)]
    passage = [rng.choice(WORDS) for _ in range(60)]
    out += [" ".join(passage + [rng.choice(WORDS) for _ in range(rng.randrange(2, 60))]) for _ in range(40)]
    out += [out[0], out[0].upper(), out[5]]
    rng.shuffle(out)
    return list(enumerate(out, start=10))


ODD_DOCS = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a b c d e"), (5, "A B C D E"), (5, "a b c d e"), (5, "other words stand here now"), (6, "other words stand here now"),
    (None, "a b c d e"), (None, None), (7, "one two"), (8, "ONE\ttwo"), (9, "two one"), (10, "É a b c"), (11, "é a b c"), (12, "x y z"), (13, "x y z"), (14, "x y z"),
    (15, "deep sea " * 1_500), (16, "deep sea " * 1_500 + "end"), (17, "deep sea"),
]


@pytest.mark.parametrize("rows", [ODD_DOCS, [], [(1, None)], families()])
def test_jaccard_join_edges(spark, rows):
    against_sql(documents(spark, rows), "documents", jaccard_join.similar_classes, jaccard_join.SQL)


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Buckets of more than four groups go through leaders and blocks, which are small here, and so do groups of more than four sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 50)
    against_sql(documents(spark, families()), "documents", lambda d: jaccard_join.similar_classes(d, small=4), jaccard_join.SQL)


def test_jaccard_join_of_one_large_group(spark, monkeypatch):
    """Sets with the same prefix: the sketch counts nothing, so that hashes alone order shingles, and small sets have one shingle as prefix."""
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(9))) for i in range(250)]
    against_sql(documents(spark, rows), "documents", lambda d: jaccard_join.similar_classes(d, small=2), jaccard_join.SQL)


def test_sets_that_counts_rule_out_are_not_read_again(spark, monkeypatch):
    """Texts with a long passage in common and nothing else: all of them were read again, and moved whole for their pairs and blocks."""
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    whole, before = [], jaccard_join.checkpointed

    def noted(df):
        done = before(df)
        if "h" in done.columns:
            whole.append(done.count())
        return done

    monkeypatch.setattr(jaccard_join, "checkpointed", noted)
    rng = random.Random(6)
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = [(i, " ".join(passage + [rng.choice(WORDS) for _ in range(45)])) for i in range(50)]
    rows += [(60, rows[7][1].upper()), (61, rows[8][1] + " end")]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_classes(documents(spark, rows), small=4).collect()}
    assert {i: c for i, c in got.items() if i != c} == {60: 7, 61: 8} and len(got) == 52
    assert sum(whole) <= 4


def test_counts_by_part_lose_no_similar_set():
    rng = np.random.default_rng(8)
    for n in (1, 7, 90, 700, 60_000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for k in (0, 1, n // 14, n // 12, n // 8, n // 2):
            y = np.unique(np.concatenate([x[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)]))
            shared = len(np.intersect1d(x, y))
            counts = (np.frombuffer(jaccard_join.by_part(h), np.uint8)[None] for h in (x, y))
            if 100 * shared >= 85 * (len(x) + len(y) - shared):
                assert jaccard_join.counts_allow(85, *counts, np.array([len(x)]), np.array([len(y)])).all()


def test_counts_of_large_sets_rule_out_pairs():
    """No similar set of any size is lost; large sets that share half their shingles were not ruled out by 128 parts."""
    rng = np.random.default_rng(9)
    draw = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    allow = lambda x, y: jaccard_join.allowed(85, *(jaccard_join._counts([jaccard_join.by_part(h, jaccard_join.parts_of(len(h)))])[0] for h in (x, y)), len(x), np.array([len(y)]))[0]
    for n in (1, 63, 64, 1030, 4100, 70_000):
        x = np.unique(draw(n))
        for k, more in ((0, 0), (0, n // 8), (n // 14, 0), (n // 7, 0), (n // 20, n // 20)):
            y = np.unique(np.concatenate([x[k:], draw(more)]))
            if 100 * (shared := len(np.intersect1d(x, y))) >= 85 * (len(x) + len(y) - shared):
                assert allow(x, y) and allow(y, x)
        if n > 1000:
            assert not allow(x, np.unique(np.concatenate([x[n // 2 :], draw(n // 2)])))
    full = np.full((1, 8), 255, np.uint8)
    assert (jaccard_join.merged_parts(full, 4) == 255).all() and (jaccard_join.merged_parts(np.full((1, 8), 200, np.uint8), 4) == 255).all()


def test_overlaps_of_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 200, 30)]
    jaccard_join.COLUMNS, before = 64, jaccard_join.COLUMNS
    try:
        found = jaccard_join.overlaps(sets[:10], sets[10:])
    finally:
        jaccard_join.COLUMNS = before
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]


def variants(df):
    return spelling.variants(spelling.word_counts(spelling.runs(df).select(spelling.altered(199).alias("word"))))


def misspelt() -> list[tuple[int, str]]:
    rng, out = random.Random(6), []
    letters = "abcdeÉé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "babababa"]
    for i in range(400):
        chosen = [rng.choice(words) if rng.random() < 0.7 else words[0] for _ in range(12)]
        chosen = [w[:k] + rng.choice(letters) + w[k + rng.randrange(2) :] if rng.random() < 0.4 else w for w in chosen for k in [rng.randrange(len(w))]]
        out.append((i, " 1".join(chosen) + " Aaaaaaa AAAAAAA" * (i % 3)))
    return out


ODD_TEXTS = [
    *((i, t) for i, t in enumerate([None, "", "123 !?", "letters ×÷ßÿ Letters LETTERS", "lettersĀletters", "lettersx lettersx lettersx lettersx lettersx"])),
    (None, "letters lettres"), (3, "letters"), (3, "letters"), (4, "x" * 5000 + " " + "x" * 5001), *[(i, "x" * 5000) for i in range(10, 16)], *[(i, "x" * 5001) for i in range(20, 26)],
]


@pytest.mark.parametrize("rows", [ODD_TEXTS, [], misspelt()])
def test_spelling_edges(spark, rows):
    against_sql(documents(spark, rows), "documents", variants, spelling.SQL)


def brute_near(words: list[str]) -> set[tuple[str, str]]:
    """Pairs at an edit distance of one, by the full table of distances."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    return {(a, b) for a in words for b in words if a < b and distance(a, b) == 1}


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_near_words_against_distances(spark, most):
    """Groups cut down to one open letter, in part, or not at all find the same pairs."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(150)} | {"abcdefgh" + c for c in "abcdefgh"})
    found = spelling.near_words(spark.createDataFrame([(w, 9) for w in words], "word string, n long"), most)
    assert {tuple(sorted((r["a"], r["b"]))) for r in found.collect()} == brute_near(words)


def test_roots_follow_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3"), ("b", "z")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w11") for i in range(11)} | {("a", "w11"), ("b", "z")}
