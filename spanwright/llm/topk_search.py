"""Exact top-k inner products by term-at-a-time accumulation.

Vectors become integers, floor(scale * x). Queries and candidates are dealt into blocks of bounded size by a
hash of the vector; every block of queries meets every block of candidates once, in a task that keeps
the candidates as postings by term (dimension), lets each query's non-zero terms scatter weight * weight
into a dense array of scores, and selects the k highest by partition. A window then merges the blocks' lists.

Defined results: a vector that is null, or holds a null or a component that is not finite, takes no part, nor
does a row without an id; an empty vector counts as zeros, as do the components that a shorter one lacks; rows
that repeat an id are candidates and queries each for itself (`query_copy` numbers the lists of repeated
query rows), and a query never meets its own row; equal scores rank by the smaller id; a query with fewer than
k candidates gets them all; an empty table gives an empty result; other columns are ignored. Scores are 64-bit
integers and wrap beyond that range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.llm.common import table

#: Components of a block of candidates and of one of queries, and scores that are alive at once in a task.
CANDIDATE_CELLS, QUERY_CELLS, SLAB_SCORES = 1 << 21, 1 << 19, 1 << 22
#: Smaller tables are dealt to this many blocks for each core, as long as these hold as many rows.
BLOCKS_A_CORE, LEAST_BLOCK = 2, 1024


def quantised(vectors: DataFrame, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, v array<long>, n long) of the rows that take part; n counts rows that are the same."""
    x = F.col(vector)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    return (
        vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, finite))
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
        .groupBy("vec_id", "v")
        .agg(F.count("*").alias("n"))
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(k: int):
    def block(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query", "query_n", "vec_id", "score")})
        if candidates.empty or queries.empty:
            return empty
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids, keys = candidates["vec_id"].to_numpy(), candidates["key"].to_numpy()
        width = max(1, max(map(len, candidates["v"])), max(map(len, queries["v"])))
        weights, asked = _matrix(candidates["v"], width), _matrix(queries["v"], width)
        # a posting list for each term: the candidates that have it and their weights
        postings = [(p, weights[p, t]) for t in range(width) for p in [np.flatnonzero(weights[:, t])]]
        own_row = dict(zip(keys[candidates["copy"] == 0], np.flatnonzero(candidates["copy"] == 0)))
        own = np.array([own_row.get(q, -1) for q in queries["key"]])
        take, slab_rows, found = min(k + 1, len(ids)), max(1, SLAB_SCORES // len(ids)), []
        for at in range(0, len(asked), slab_rows):
            slab, mine = asked[at : at + slab_rows], own[at : at + slab_rows]
            scores = np.zeros((len(slab), len(ids)), dtype=np.int64)
            for t, (where, w) in enumerate(postings):
                has = np.flatnonzero(slab[:, t])
                if len(where) == len(ids):
                    scores[has] += slab[has, t][:, None] * w
                elif len(where) and len(has):
                    scores[np.ix_(has, where)] += slab[has, t][:, None] * w
            least = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
            row, col = np.nonzero(scores >= least[:, None])
            other = mine[row] != col
            row, col = row[other], col[other]
            s = scores[row, col]
            order = np.lexsort((col, -s, row))  # ids ascend with the columns, so ties go to the smaller
            row, col, s = row[order], col[order], s[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            q = queries.iloc[at + row[best]]
            found.append(pd.DataFrame({"query_id": q["vec_id"].to_numpy(), "query": q["key"].to_numpy(), "query_n": q["n"].to_numpy(), "vec_id": ids[col[best]], "score": s[best]}))
        return pd.concat(found)

    return block


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, query_copy): the k highest integer inner products of each query row.

    `is_query` is a condition on the column `vec_id` of the quantised rows.
    """
    # a key that tells the distinct rows of an id apart; rows that are the same share it
    rows = quantised(vectors, scale, vec_id, vector).withColumn("key", F.xxhash64("vec_id", "v"))
    sizes = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.greatest(F.lit(1), F.size(vector)).alias("size"))
    n, n_query, width = sizes.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max("size")).first()
    at_least = BLOCKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(1, math.ceil(n * (width or 1) / CANDIDATE_CELLS), min(at_least, n // LEAST_BLOCK))
    q_blocks = max(1, math.ceil(n_query * (width or 1) / QUERY_CELLS))
    block = lambda seed, blocks, *more: F.pmod(F.xxhash64("vec_id", "key", *more, F.lit(seed)), F.lit(blocks)).cast("int")
    queries = rows.filter(is_query).select("vec_id", "key", "n", "v", block(1, q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    # of rows that are the same, a query can need k beside its own
    copies = rows.select("vec_id", "key", "v", F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))).alias("copy"))
    candidates = copies.select("vec_id", "key", "copy", "v", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block(2, c_blocks, "copy").alias("cb"))
    lists = candidates.groupBy("cb", "qb").cogroup(queries.groupBy("cb", "qb")).applyInPandas(_search(k), "query_id long, query long, query_n long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1), F.col("query_n").cast("int"))).alias("query_copy")
    return ranked.select("query_id", "rank", "vec_id", "score", each)


def op1_topk_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT row_number() OVER () AS row, vec_id, list_resize(v, (SELECT greatest(1, max(len(v))) FROM fine), 0) AS v,
             row_number() OVER (PARTITION BY vec_id, v)::INT AS copy FROM fine),
pairs AS (SELECT q.row, q.vec_id AS query_id, q.copy AS query_copy, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score, query_copy FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""
