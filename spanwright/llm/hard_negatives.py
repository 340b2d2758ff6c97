"""Hard negatives by product quantisation with stored residual norms.

1. Vectors become integers, floor(scale * x). Codebooks, one for each group of dimensions, are fitted by k-means to a bounded
   sample (`SAMPLE` rows of least hash); every row is indexed: its codes, and the norm of what each code leaves over.
2. Anchors and candidates are dealt into blocks of bounded size by a hash of the row, and every block of anchors meets every
   block of candidates once. In a task, look-up tables give all scores of the decoded rows; a score differs from that by at most the sum
   of the products of the anchor's norm and the residual's in each group of dimensions. These bounds rule out rows that cannot be
   among the first, and the rest get their exact integer score.
3. A first pass finds each anchor's positives, the best rows of its label. The second finds, for each positive's window
   of scores, the best rows of other labels inside it: rows whose bounds leave the window, or that lie below as many rows as
   are asked for and that are surely inside, are ruled out. Windows over the blocks' few rows merge them.

The bounds hold whatever the codebooks are, so neither the sample nor its bound changes a result.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part; a shorter vector
lacks zeros; rows that repeat an id are rows of their own (equal rows too: each is an anchor and a candidate for the others, but not for
itself); ties go to the smaller id; an anchor without another row of its label has no row; an empty table gives an empty result;
other columns are ignored. Scores are 64-bit integers; those of vectors beyond 2^52 in norm are not told apart by the bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import checkpointed, table

#: Rows that fit the codebooks, centres of a codebook, dimensions of a group, rounds of k-means.
SAMPLE, CENTRES, GROUP, ROUNDS = 4096, 64, 4, 8
#: Components of a block of candidates and of one of anchors, and scores that are alive at once in a task.
CANDIDATE_CELLS, ANCHOR_CELLS, SLAB_SCORES = 1 << 21, 1 << 20, 1 << 20
BLOCKS_A_CORE, LEAST_BLOCK = 2, 1024
#: Share of a bound that covers rounding of sums of doubles.
SLACK = 1e-9


def whole_rows(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, v array<long>, n) of the rows that take part; n counts rows that are the same."""
    x = F.col(vector)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    kept = vectors.filter(F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, finite))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v).groupBy("vec_id", "label", "v").agg(F.count("*").alias("n"))


def codebooks(sample: np.ndarray, seed: int = 11) -> np.ndarray:
    """(groups, centres, dimensions of a group): k-means on each group of dimensions of the sample."""
    rng, parts = np.random.default_rng(seed), sample.shape[1] // GROUP
    books = np.zeros((parts, CENTRES, GROUP))
    for m in range(parts):
        x = sample[:, m * GROUP : (m + 1) * GROUP].astype(np.float64)
        if not len(x):
            continue
        centres = x[rng.integers(0, len(x), CENTRES)]
        for _ in range(ROUNDS):
            near = nearest(x, centres)
            n = np.bincount(near, minlength=CENTRES)
            sums = np.stack([np.bincount(near, x[:, d], CENTRES) for d in range(GROUP)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books[m] = centres
    return books


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def padded(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _index(books):
    def run(batches):
        b = books.value
        width = b.shape[0] * GROUP
        for batch in batches:
            v = padded(batch.column(2).to_pylist(), width)
            parts = v.reshape(len(v), -1, GROUP).astype(np.float64)
            codes = np.stack([nearest(parts[:, m], b[m]) for m in range(len(b))], axis=1).astype(np.uint8) if len(v) else np.zeros((0, len(b)), np.uint8)
            rest = np.stack([np.sqrt(((parts[:, m] - b[m][codes[:, m]]) ** 2).sum(1)) for m in range(len(b))], axis=1) if len(v) else np.zeros((0, len(b)))
            rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows(v), rows(codes), rows(rest), batch.column(3)], names=["vec_id", "label", "v", "codes", "rest", "n"])

    return run


class Block:
    """A block of candidates, in order of their ids."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("vec_id", kind="stable")
        self.ids, self.labels, self.keys = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["key"].to_numpy()
        self.v, self.codes, self.rest = stacked(rows["v"], np.int64), stacked(rows["codes"], np.uint8), stacked(rows["rest"], np.float64)
        self.first = rows["copy"].to_numpy() == 0

    def bounds(self, asked: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the decoded candidates with each asked row, and how far the true ones may be from them."""
        parts = asked.reshape(len(asked), -1, GROUP).astype(np.float64)
        scores = np.zeros((len(asked), len(self.ids)))
        for m in range(len(books)):
            scores += (parts[:, m] @ books[m].T)[:, self.codes[:, m]]
        norms = np.sqrt((parts**2).sum(2))
        reach = norms @ self.rest.T
        return scores, reach + SLACK * (np.abs(scores) + reach + 1)

    def exact(self, asked: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for at in range(0, len(row), 1 << 16):
            some = slice(at, at + (1 << 16))
            out[some] = np.einsum("ij,ij->i", asked[row[some]], self.v[col[some]])
        return out

    def best(self, row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of each row."""
        order = np.lexsort((col, -score, row))
        r = row[order]
        return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def stacked(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def kth_highest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, minus infinity where a row is shorter."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def _found(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in columns.items()})


def _positives(books, k: int):
    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("key", "positive_id", "positive_score")}
        if len(candidates) and len(anchors):
            block, asked, keys, labels = Block(candidates), stacked(anchors["v"], np.int64), anchors["key"].to_numpy(), anchors["label"].to_numpy()
            slab = max(1, SLAB_SCORES // len(block.ids))
            for at in range(0, len(asked), slab):
                q = asked[at : at + slab]
                scores, reach = block.bounds(q, books.value)
                other = (labels[at : at + slab, None] == block.labels) & ~((keys[at : at + slab, None] == block.keys) & block.first)
                least = kth_highest(np.where(other, scores - reach, -np.inf), k)
                row, col = np.nonzero(other & (scores + reach >= least[:, None]))
                exact = block.exact(q, row, col)
                kept = block.best(row, col, exact, k)
                out["key"].append(keys[at + row[kept]])
                out["positive_id"].append(block.ids[col[kept]])
                out["positive_score"].append(exact[kept])
        return _found(out)

    return run


def _negatives(books, k: int, low: int, high: int):
    """Rows of other labels with low * positive <= 100 * score <= high * positive."""

    def run(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("key", "place", "negative_id", "negative_score")}
        if len(candidates) and len(anchors):
            block, asked, keys, labels = Block(candidates), stacked(anchors["v"], np.int64), anchors["key"].to_numpy(), anchors["label"].to_numpy()
            of = list(anchors["scores"])
            slab = max(1, SLAB_SCORES // len(block.ids))
            for at in range(0, len(asked), slab):
                q, mine = asked[at : at + slab], of[at : at + slab]
                scores, reach = block.bounds(q, books.value)
                other = labels[at : at + slab, None] != block.labels
                lower, upper = scores - reach, scores + reach
                for place in range(max(map(len, mine))):
                    has = np.array([i for i, s in enumerate(mine) if place < len(s)])
                    positive = np.array([mine[i][place] for i in has], np.int64)
                    floor, ceiling = low * positive[:, None] / 100, high * positive[:, None] / 100
                    edge = SLACK * (np.abs(floor) + np.abs(ceiling) + 1)
                    lo, up = lower[has], upper[has]
                    sure = other[has] & (lo >= floor + edge) & (up <= ceiling - edge)
                    least = kth_highest(np.where(sure, lo, -np.inf), k)
                    row, col = np.nonzero(other[has] & (up >= floor - edge) & (lo <= ceiling + edge) & (up >= least[:, None]))
                    exact = block.exact(q, has[row], col)
                    inside = (low * positive[row] <= 100 * exact) & (100 * exact <= high * positive[row])
                    row, col, exact = row[inside], col[inside], exact[inside]
                    kept = block.best(row, col, exact, k)
                    out["key"].append(keys[at + has[row[kept]]])
                    out["place"].append(np.full(len(kept), place + 1))
                    out["negative_id"].append(block.ids[col[kept]])
                    out["negative_score"].append(exact[kept])
        return _found(out)

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_copy, positive_place).

    `is_anchor` is a condition on the column `vec_id`; `low` and `high` are percentages of the positive's score.
    """
    spark = vectors.sparkSession
    rows = checkpointed(whole_rows(vectors, scale, vec_id, vector, F.col("label") if label is None else label))
    n, n_anchor, width = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v"))).first()
    width = GROUP * max(1, math.ceil((width or 1) / GROUP))
    sample = rows.orderBy(F.xxhash64("vec_id", "label", "v")).select("v").limit(SAMPLE).toPandas()["v"]
    books = spark.sparkContext.broadcast(codebooks(padded(sample, width)))
    index = rows.mapInArrow(_index(books), "vec_id long, label long, v binary, codes binary, rest binary, n long").withColumn("key", F.xxhash64("vec_id", "label", "v"))
    index = checkpointed(index)
    at_least = BLOCKS_A_CORE * spark.sparkContext.defaultParallelism
    c_blocks = max(1, math.ceil(n * width / CANDIDATE_CELLS), min(at_least, n // LEAST_BLOCK))
    a_blocks = max(1, math.ceil(n_anchor * width / ANCHOR_CELLS))
    block = lambda seed, blocks, *more: F.pmod(F.xxhash64("key", *more, F.lit(seed)), F.lit(blocks)).cast("int")
    to_all = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # of rows that are the same, an anchor can need as many as are asked for beside its own
    copies = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(max(positives, negatives))).cast("int"))))
    candidates = copies.select("vec_id", "label", "v", "codes", "rest", "key", "copy", to_all(a_blocks).alias("ab"), block(2, c_blocks, "copy").alias("cb")).groupBy("cb", "ab")
    anchors = index.filter(is_anchor).select("key", "label", "v", "n", "vec_id")

    def asked(rows: DataFrame):
        dealt = rows.withColumn("ab", block(1, a_blocks)).withColumn("cb", to_all(c_blocks))
        return dealt.select(*[F.col(c).alias(c) for c in dealt.columns]).groupBy("cb", "ab")

    first = candidates.cogroup(asked(anchors.drop("n", "vec_id"))).applyInPandas(_positives(books, positives), "key long, positive_id long, positive_score long")
    by_score = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    chosen = checkpointed(first.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives))
    scores = chosen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    second = candidates.cogroup(asked(anchors.drop("n", "vec_id").join(scores, "key"))).applyInPandas(_negatives(books, negatives, low, high), "key long, place int, negative_id long, negative_score long")
    by_score = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    each = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("anchor_copy")
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"), each)
    out = ranked.join(chosen, ["key", "place"]).join(named, "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_copy", F.col("place").alias("positive_place"))


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


SQL = """
WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT row_number() OVER () AS row, vec_id, label, list_resize(v, (SELECT greatest(1, max(len(v))) FROM fine), 0) AS v,
             row_number() OVER (PARTITION BY vec_id, label, v)::INT AS copy FROM fine),
pairs AS (SELECT a.row, a.vec_id AS anchor_id, a.copy AS anchor_copy, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
          FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS place FROM pairs WHERE same),
windows AS (SELECT p.anchor_id, p.anchor_copy, p.vec_id AS positive_id, p.place AS positive_place, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.row, p.place ORDER BY n.score DESC, n.vec_id)::INT AS rank
            FROM positives p JOIN pairs n ON p.row = n.row WHERE p.place <= 5 AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_copy, positive_place FROM windows WHERE rank <= 5
"""
