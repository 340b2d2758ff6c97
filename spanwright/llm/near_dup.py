"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all words are counted over all documents, into a table that stays in Spark. Words in
   at least `COMMON` of the documents go to the tasks, so their number is bounded by the mean count of distinct
   words over `COMMON` and does not grow with the corpus, and with them a sketch of `IDF_CELLS` sums of the others' counts.
2. One scan hashes each whole text: its five-word shingles, weighted by term frequency times the mean
   inverse document frequency of their words, its consistent weighted samples in bands, and a key of its
   words. Rows with the same key are one text from here on; its node is the least of their ids. Here alone a rare
   word's frequency is read from the sketch, which is never too low: it moves the chance that two texts meet a little, and no similarity.
   Texts that met get the exact frequencies of their rare words by a join on the word, and their vectors from those.
3. Texts that share a band's samples meet in that bucket. The leader of a bucket, the text whose buckets are
   the fullest, is compared with the others: pairs grow with the members, not with their square. Weighted
   Jaccard similarity of the whole shingle vectors decides; connected texts form a class.
4. Rounds go on until no bucket holds texts of two classes that were never compared. Texts that have led are
   done with their bucket. In buckets of at most `SMALL` texts left every pair of different classes is
   compared. Larger ones, as a passage that many texts share makes them, are split without loss: two texts
   at the threshold share a shingle among each one's rarest, those that hold the first 1 - threshold of its weight, so
   these shingles are the new buckets. Where one of those is large too, the fullest texts of each class lead, from 16 up to
   `LEADERS` together, against blocks of the members, so that a member's vector moves once a round and not once a pair. Weights summed by parts of the
   hash, the more the longer the text, meet first in blocks and in pairs, as they bound the similarity; only vectors that they leave move.

Defined results: a text of fewer than five words is one shingle of all its words; null texts and texts
without a word are in no class but their own; repeated rows share a class; rows with a null id have a null
class; an empty table gives an empty result; further columns are kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import arrow_rows, checkpointed, fitted, no_text, released, table, thinned
from spanwright.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^3)^10 = 0.9992.
BANDS, ROWS = 10, 3
COMMON = 0.001
#: Texts of a bucket whose pairs are listed, and in larger ones those that lead at once and that form a block.
SMALL, LEADERS, BLOCK = 12, 128, 128
#: Parts of the hash by which weights are summed before whole vectors move: a power of two that leaves a part `EACH` shingle at most on average, within limits.
PARTS, LEAST_PARTS, MOST_PARTS, EACH = 256, 32, 1 << 16, 1
#: What a byte of a sketch stands for: nothing, powers of `STEP` from 1 on, or any more.
STEP = 1.02
LEVELS = np.concatenate([[0], 1.000001 * STEP ** np.arange(254), [np.inf]]).astype(np.float32)
#: Cells of the sketch of the other words' frequencies.
IDF_CELLS = 1 << 18
#: Words that a task remembers, and texts hashed together.
WORD_MEMORY, TEXTS = 250_000, 64
#: Cells of the sketch that says which shingles are rare; any order of shingles is right, the sketch's is a good one.
CELLS = 1 << 18
#: Rows that Python gets at once: a long text's vector is as large as the text.
ARROW_ROWS = 512

_rng = np.random.default_rng(20240229)
_TABLE = 1 << 16
_gamma = lambda: (-np.log(_rng.random(_TABLE) * _rng.random(_TABLE) + 1e-30)).astype(np.float32)
#: Draws of the sampling scheme, looked up by bits of the shingle's hash: r, ln c and beta.
_R, _LN_C, _BETA = _gamma(), np.log(_gamma()), _rng.random(_TABLE).astype(np.float32)
_ODD = _rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def inverse(counts: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(np.maximum(1, n / np.maximum(1, counts)))).astype(np.float32)


def listed(hashes: np.ndarray, values: np.ndarray, h: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The value of each of `h` in a list ordered by hash, or what stands in `otherwise`."""
    if not len(hashes):
        return otherwise
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, values[at], otherwise)


class Idf:
    """Inverse document frequency by word hash: of the common words exact, of others by the sketch or by a text's own list of counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, cells: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.n, self.hashes, self.values = n, hashes[order], inverse(counts[order], n)
        self.cells = np.full(IDF_CELLS, inverse(np.ones(1), n)[0]) if cells is None else inverse(np.minimum(cells, max(1, COMMON * n)), n)

    def of(self, h: np.ndarray) -> np.ndarray:
        return listed(self.hashes, self.values, h, self.cells[(h % np.uint64(IDF_CELLS)).astype(np.int64)])

    def rare(self, h: np.ndarray) -> np.ndarray:
        """The words that are not common, each once."""
        h = np.unique(h)
        return h[~listed(self.hashes, np.ones(len(self.hashes), bool), h, np.zeros(len(h), bool))]

    def exact(self, h: np.ndarray, rare: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """With the counts of the text's rare words; what is in neither list stands in one text alone."""
        order = np.argsort(rare)
        own = listed(rare[order], inverse(counts[order], self.n), h, np.full(len(h), inverse(np.ones(1), self.n)[0]))
        return listed(self.hashes, self.values, h, own)


class Words(dict):
    """Row number by word of its hash and inverse document frequency."""

    def __init__(self, idf: Idf):
        self.idf = idf
        self.hashes, self.weights = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self) > WORD_MEMORY:
            self.clear()
            self.hashes, self.weights = self.hashes[:0], self.weights[:0]
        new = [w for w in words if w not in self]
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in new], dtype=np.uint64)
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.hashes, self.weights = np.concatenate([self.hashes, h]), np.concatenate([self.weights, self.idf.of(h)])

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, weights) of the words of each text."""
        split = [t.lower().split() for t in texts]
        self.learn(set().union(*split))
        rows = [np.fromiter(map(self.__getitem__, s), dtype=np.int64, count=len(s)) for s in split]
        return [(self.hashes[r], self.weights[r]) for r in rows]


def vector(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, TF-IDF weights) of a text with words."""
    n = min(SHINGLE, len(hashes))
    m = len(hashes) - n + 1
    h, w = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for j in range(n):
        h += hashes[j : j + m] * _PLACE[j]
        w += weights[j : j + m]
    h, first, tf = np.unique(_mixed(h), return_index=True, return_counts=True)
    return h, (w[first] / np.float32(n)) * tf.astype(np.float32)


def samples(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One consistent weighted sample for each vector (row) and draw (column), as a 64-bit value."""
    h, ln_w = np.concatenate([v[0] for v in vectors]), np.log(np.concatenate([v[1] for v in vectors]))
    sizes = np.array([len(v[0]) for v in vectors])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(vectors)), sizes)
    out = np.zeros((len(vectors), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        m = h * _ODD[k]
        r, beta = _R[m >> np.uint64(48)], _BETA[(m >> np.uint64(16)) & np.uint64(0xFFFF)]
        t = np.floor(ln_w / r + beta)
        ln_a = _LN_C[(m >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        hit = np.flatnonzero(ln_a == np.minimum.reduceat(ln_a, at)[owner])
        hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
        out[:, k] = _mixed(h[hit] + t[hit].astype(np.int64).view(np.uint64) * _MIX)
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sampled), BANDS), np.uint64)
    for b in range(BANDS):
        for j in range(ROWS):
            out[:, b] = _mixed(out[:, b] * _MIX + sampled[:, b * ROWS + j] + np.uint64(b + 1))
    return out.view(np.int64)


def _sign(idf):
    def sign(batches):
        words = Words(idf.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            keys, rows = [], []
            for at in range(0, len(texts), TEXTS):
                read = words.read(texts[at : at + TEXTS])
                some = [i for i, (h, _) in enumerate(read) if len(h)]
                signed = iter(bands(samples([vector(*read[i]) for i in some])).tolist() if some else [])
                for h, _ in read:
                    keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                    rows.append(next(signed) if len(h) else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    return sign


def _rare_words(idf):
    def run(batches):
        words = Words(idf.value)
        for batch in batches:
            found = [idf.value.rare(h) for h, _ in words.read(batch.column(1).to_pylist())]
            sizes = [len(x) for x in found]
            h = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), h], names=["node", "h"])

    return run


def _vectors(idf):
    def run(batches):
        words = Words(idf.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                found = []
                for (h, _), rare, counts in zip(words.read(some.column(1).to_pylist()), some.column(2), some.column(3)):
                    own = [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in (rare, counts)]
                    found.append(vector(h, idf.value.exact(h, own[0].view(np.uint64), own[1])))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["node", "h", "w"])

    return run


def weighted_vectors(texts: DataFrame, idf, counts: DataFrame) -> DataFrame:
    """(node, h, w) of texts (node, text), one a node: full TF-IDF weights, from the table (h, n) of document frequencies.

    The rare words of a text meet their frequencies by a join on the word. No key of it is hot, as common words take no part, and a word that
    only one text has is not in the table.
    """
    rare = texts.mapInArrow(_rare_words(idf), "node long, h long").join(counts, "h")
    own = rare.groupBy("node").agg(F.collect_list(F.struct("h", "n")).alias("rare")).select("node", F.col("rare.h").alias("rare"), F.col("rare.n").alias("counts"))
    return texts.select("node", "text").join(own, "node", "left").select("node", "text", "rare", "counts").mapInArrow(_vectors(idf), "node long, h binary, w binary")


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _verify(batches):
    for batch in batches:
        a, b, *parts = (batch.column(i) for i in range(6))
        of = lambda i: weighted_jaccard(*(np.frombuffer(p[i].as_buffer(), t) for p, t in zip(parts, (np.uint64, np.float32) * 2)))
        yield pa.RecordBatch.from_arrays([a, b, pa.array([of(i) for i in range(batch.num_rows)], pa.float64())], names=["a", "b", "similarity"])


def by_part(h: np.ndarray, w: np.ndarray, parts: int = PARTS) -> bytes:
    """Weight of a vector by part of the hash."""
    return np.bincount((h >> np.uint64(40)).astype(np.int64) % parts, w, parts).astype(np.float32).tobytes()


def parts_of(n: int) -> int:
    """Parts for n shingles. With as many for texts of any length, a part of a long text holds so many shingles that all long texts look alike."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << (n // EACH).bit_length()))


def sketched(h: np.ndarray, w: np.ndarray) -> bytes:
    """Weight by part as a byte for one of `LEVELS`, never less than it is."""
    sums = np.frombuffer(by_part(h, w, parts_of(len(h))), np.float32)
    return np.searchsorted(LEVELS, sums).astype(np.uint8).tobytes()


def merged_parts(sums: np.ndarray, parts: int) -> np.ndarray:
    """The last axis for fewer parts; both numbers are powers of two. There may be no rows, so that no length can be left to numpy."""
    return sums.reshape(*sums.shape[:-1], sums.shape[-1] // parts, parts).sum(axis=-2)


def _by_part(batches):
    for batch in batches:
        vectors = [(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32)) for h, w in zip(batch.column(1), batch.column(2))]
        totals = pa.array([float(w.sum(dtype=np.float64)) for _, w in vectors], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), totals, pa.array([sketched(*v) for v in vectors], pa.binary())], names=["node", "total", "sums"])


def at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A bound of the similarities of a vector and of each of others, from their sums by part: in a part no more is shared than the lesser sum."""
    return bound(x, y, x.sum(dtype=np.float64), y.sum(axis=1, dtype=np.float64))


def bound(x: np.ndarray, y: np.ndarray, of_x: float, of_y: np.ndarray) -> np.ndarray:
    """`at_most` where sums are rounded up and the whole weights are at hand; parts may differ in number."""
    parts = min(x.shape[-1], y.shape[-1])
    x, y = (s if s.shape[-1] == parts else merged_parts(s, parts) for s in (x, y))
    shared = np.minimum(np.minimum(x, y).sum(axis=1, dtype=np.float64), np.minimum(of_x, of_y))
    return shared / (of_x + of_y - shared)


def _sums(column) -> list[np.ndarray]:
    return [LEVELS[np.frombuffer(s, np.uint8)] for s in column]


def _may_be_similar(threshold: float):
    """The pairs whose sums allow the similarity."""
    # sums are in single precision
    least = threshold - 1e-4

    def run(batches):
        for batch in batches:
            x, y = (_sums(batch.column(c).to_pylist()) for c in ("sa", "sb"))
            of_x, of_y = (batch.column(c).to_numpy() for c in ("ta", "tb"))
            near = [bound(x[i], y[i][None], of_x[i], of_y[i : i + 1])[0] >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _may_meet(threshold: float):
    """(bucket, part, node) of the leaders and the members of a block that may be similar to one of another class."""
    # sums are in single precision
    least = threshold - 1e-4

    def run(leaders: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if leaders.empty or members.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("bucket", "part", "node")})
        (x, of_x, cx), (y, of_y, cy) = ((_sums(side["sums"]), side["total"].to_numpy(), side["component"].to_numpy()) for side in (leaders, members))
        left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
        sizes = np.array([len(s) for s in y])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            block = np.stack([y[j] for j in at])
            for i in range(len(x)):
                may = np.flatnonzero((cx[i] != cy[at]) & (least * of_x[i] <= of_y[at]) & (least * of_y[at] <= of_x[i]))
                near = at[may[bound(x[i], block[may], of_x[i], of_y[at[may]]) >= least]]
                left[i] |= len(near) > 0
                right[near] = True
        nodes = np.unique(np.concatenate([leaders["node"].to_numpy()[left], members["node"].to_numpy()[right]]))
        return pd.DataFrame({"bucket": np.full(len(nodes), members["bucket"].iloc[0]), "part": np.full(len(nodes), members["part"].iloc[0]), "node": nodes})

    return run


def _led(threshold: float):
    """Similar (a, b) of different classes among a bucket's leaders and a block of its members."""
    # the similarity is at most the lesser total weight over the greater
    least = threshold - 1e-6

    def read(rows: pd.DataFrame) -> list[tuple]:
        vectors = ((n, c, np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)) for n, c, h, w in zip(rows["node"], rows["component"], rows["h"], rows["w"]))
        return [(*v, float(v[3].sum(dtype=np.float64))) for v in vectors]

    def run(leaders: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found, block = [], read(members)
        for a, own, ha, wa, of_a in read(leaders):
            near = (x for x in block if x[1] != own and least * of_a <= x[4] and least * x[4] <= of_a)
            found += [(a, b) for b, _, hb, wb, _ in near if weighted_jaccard(ha, wa, hb, wb) >= threshold]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _cells(batches):
    """(cell, n): how many of a task's vectors have a shingle in each cell of the sketch."""
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for h in batch.column(0):
            seen += np.bincount((np.frombuffer(h.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], names=["cell", "n"])


def rarest(h: np.ndarray, w: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles of a vector that hold the first 1 - `threshold` of its weight, rare ones first, and that others may have.

    If two vectors share none of these, what they share lies in one's remainder, whose weight is less than
    `threshold` of its total, and their similarity is less than `threshold`.
    """
    n = counts[(h % np.uint64(CELLS)).astype(np.int64)]
    order = np.lexsort((h, n))
    left = w[order].astype(np.float64)[::-1].cumsum()[::-1]
    chosen = order[left >= (threshold - 1e-6) * left[0]]
    return h[chosen[n[chosen] > 1]]


def _rarest(counts, threshold: float):
    def run(batches):
        for batch in batches:
            found = [rarest(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32), counts.value, threshold) for h, w in zip(batch.column(1), batch.column(2))]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64())], names=["bucket", "node"]
            )

    return run


def split_buckets(vectors: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, fill) of vectors (node, h, w): two at the threshold meet in a bucket, those that share frequent shingles alone do not."""
    cells = vectors.select("h").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast(counts)
    placed = checkpointed(vectors.mapInArrow(_rarest(shared, threshold), "bucket long, node long"))
    # buckets of the same texts are one
    texts = (F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    buckets = placed.groupBy("bucket").agg(*texts).filter("n > 1").groupBy("n", "sum", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    met = checkpointed(placed.join(buckets.select("bucket", "n"), "bucket"))
    rows = met.count()
    return checkpointed(fitted(met.join(met.groupBy("node").agg(F.sum("n").alias("fill")), "node").select("bucket", "node", "fill"), rows))


def word_idf(docs: DataFrame) -> tuple[Idf, DataFrame]:
    """What tasks know of the document frequencies, bounded by `COMMON` and `IDF_CELLS`, and the table (h, n) of those above 1."""
    n = docs.count()

    def count(batches):
        seen: Counter = Counter()

        def rows():
            h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in seen], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seen.values(), pa.int64())], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(text.lower().split()))
                if len(seen) > WORD_MEMORY:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = checkpointed(counted)
    frequent = F.col("n") >= max(2, COMMON * n)
    common = counted.filter(frequent).toArrow()
    others = counted.filter(~frequent)
    # the remainder of the hash as it is without a sign
    cell = F.col("h").bitwiseAND(IDF_CELLS - 1).alias("cell")
    sums, cells = others.groupBy(cell).agg(F.sum("n").alias("n")).toArrow(), np.ones(IDF_CELLS, np.float32)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return Idf(common["h"].to_numpy().view(np.uint64), common["n"].to_numpy().astype(np.float64), n, cells), others


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of each row: the least id of its class, and the similar texts it was linked to."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _classes(docs, threshold, doc_id, text)


def _classes(docs: DataFrame, threshold: float, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"))
    known, counts = word_idf(chosen)
    idf = spark.sparkContext.broadcast(known)
    signed = checkpointed(chosen.mapInArrow(_sign(idf), "doc_id long, key binary, bands array<long>"))
    keyed = signed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    exact = keyed.groupBy("key").agg(F.min("doc_id").alias("node"))
    # the rows of a key have the same bands; one of them stands for all
    texts = keyed.join(exact, "key").filter("doc_id = node").dropDuplicates(["node"]).select("node", "bands")
    exploded = texts.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = checkpointed(exploded.join(shared, "bucket"))
    rows = met.count()
    met = fitted(met, rows)
    met = checkpointed(fitted(met.join(met.groupBy("node").agg(F.sum("n").alias("fill")), "node"), rows))
    wanted = met.select("node").distinct()
    one = checkpointed(thinned(chosen.select(F.col("doc_id").alias("node"), "text"), wanted, "node").join(wanted, "node").dropDuplicates(["node"]))
    vectors = checkpointed(weighted_vectors(one, idf, counts))
    sums = checkpointed(vectors.select("node", "h", "w").mapInArrow(_by_part, "node long, total double, sums binary"))
    del one  # else the copy of these texts stays on disk during the rounds

    def similar(pairs: DataFrame) -> DataFrame:
        own = thinned(vectors, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        a, b = (own.select(F.col("node").alias(s), F.col("h").alias(f"h{s}"), F.col("w").alias(f"w{s}")) for s in "ab")
        joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ha", "wa", "hb", "wb")
        return joined.mapInArrow(_verify, "a long, b long, similarity double").filter(F.col("similarity") >= threshold).select("a", "b")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs whose sums by part allow the similarity."""
        a, b = (sums.select(F.col("node").alias(s), F.col("total").alias(f"t{s}"), F.col("sums").alias(f"s{s}")) for s in "ab")
        wide = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb", "sa", "sb")
        return checkpointed(wide.mapInArrow(_may_be_similar(threshold), "a long, b long"))

    def joined(classes: DataFrame, found: DataFrame) -> DataFrame:
        """`classes` after further links; what was joined before is not looked at again."""
        a, b = (classes.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
        merged = components(found.join(a, "a").join(b, "b").select("ca", "cb"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("least"))
        return checkpointed(fitted(classes.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component")), rows))

    def by_blocks(leaders: DataFrame, members: DataFrame, values: DataFrame, columns: list[str], function, schema: str, kept: DataFrame | None = None) -> DataFrame:
        """`function` of a bucket's leaders and each block of its members, those in `kept` (bucket, part, node) alone, with `columns` of `values` beside them."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        taken = lambda rows, part: rows.select("bucket", part.alias("part"), "node", "component")
        heads, others = taken(leaders, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))), taken(members, F.pmod(F.xxhash64("node"), blocks))
        if kept is not None:
            heads, others = (rows.join(kept, ["bucket", "part", "node"]) for rows in (heads, others))
        own = [F.col(c).alias(c) for c in ("bucket", "part", "node", "component", *columns)]
        heads, others = (rows.join(values, "node").select(*own).groupBy("bucket", "part") for rows in (heads, others))
        return heads.cogroup(others).applyInPandas(function, schema)

    # the fullest text of a bucket leads, the least id among equals
    standing = F.struct(F.col("fill"), (-F.col("node")).alias("minus"))
    leaders = met.groupBy("bucket").agg(F.max(standing).alias("top"))
    pairs = met.join(leaders, "bucket").select((-F.col("top.minus")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    links = checkpointed(similar(fitted(pairs, rows)))
    waiting = met.join(leaders, "bucket").filter(F.col("node") != -F.col("top.minus")).select("bucket", "node", "fill")
    classes = checkpointed(fitted(vectors.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), rows))
    share, bands_alone = 1, True
    released(spark)
    while True:
        placed = waiting.join(classes, "node")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("bucket", "n")
        placed = checkpointed(fitted(placed.join(mixed, "bucket"), rows))
        if placed.isEmpty():
            break
        few, large = placed.filter(F.col("n") <= SMALL).select("bucket", "node", "component"), placed.filter(F.col("n") > SMALL)
        other = few.select("bucket", F.col("node").alias("a"), F.col("component").alias("own"))
        pairs = few.join(other, "bucket").filter("a < node AND component <> own").select("a", F.col("node").alias("b"))
        found = similar(close(fitted(pairs.distinct(), rows)))
        if bands_alone:
            found, bands_alone = checkpointed(found), False
            links, classes = links.unionByName(found), joined(classes, found)
            if large.isEmpty():
                break
            waiting = split_buckets(vectors.join(large.select("node").distinct(), "node", "left_semi"), threshold)
            released(spark)
            continue
        turn = large.withColumn("turn", F.row_number().over(Window.partitionBy("bucket", "component").orderBy(standing.desc()))).filter(F.col("turn") <= share)
        turn = turn.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("turn", standing.desc()))).filter(F.col("place") <= min(LEADERS, 16 * share))
        turn = checkpointed(fitted(turn.select("bucket", "node", "component", "n"), rows))
        if not turn.isEmpty():
            near = checkpointed(by_blocks(turn, large, sums, ["total", "sums"], _may_meet(threshold), "bucket long, part long, node long"))
            released(spark)
            own = thinned(vectors, near.select("node").distinct(), "node")
            led = by_blocks(turn, large, own, ["h", "w"], _led(threshold), "a long, b long", near)
            found = found.unionByName(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        found = checkpointed(fitted(found.distinct(), rows))
        links, classes = links.unionByName(found), joined(classes, found)
        waiting = checkpointed(fitted(large.join(turn, ["bucket", "node"], "left_anti").select("bucket", "node", "fill"), rows))
        share = min(LEADERS, 4 * share)
        released(spark)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    per_text = exact.join(classes, "node", "left").join(degree, "node", "left").select("key", F.coalesce("component", "node").alias("__class"), F.coalesce("links", F.lit(0)).cast("long").alias("__links"))
    with_words = signed.filter("key IS NOT NULL").join(per_text, "key", "left").select("doc_id", F.coalesce("__class", "doc_id").alias("class_id"), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"))
    # texts without a word share no key, so that a table full of them fills no single task
    return with_words.unionByName(signed.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the least id of each class; rows without an id, or that repeat the least one, all stay."""
    gone = near_duplicates(docs, threshold, doc_id, text).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


def op3_near_dup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
