"""Classes of documents by an exact Jaccard join of their word n-grams: the grouped prefix join.

1. One scan counts shingles in a sketch of `CELLS` cells; it orders shingles, rare ones first. Any order is right, this one makes short lists.
2. A second scan hashes each whole text to its set of shingles. Rows with the same set are one from here on. Of a set of n
   shingles in that order the first n - ceil(percent n / 100) + 1 are its prefix: two sets that are similar enough share a shingle of both prefixes.
3. Sets of one size with the same prefix are collapsed into one group. Prefix shingles shared by groups are buckets. A pair of
   groups is a candidate where sizes allow the similarity and what follows the shared shingle in both can still make up the overlap,
   which holds at the first shingle that a similar pair shares.
4. Of a bucket, the group whose buckets are fullest leads, and its pairs with the others are listed; buckets of at most `SMALL` groups list all
   candidate pairs. Pairs are expanded to the members of the groups, and so are pairs inside a group. Counts of
   shingles by parts of their hash, the more the larger the set, kept by the second scan, rule out most pairs before a text is read again. Whole sets of the leaders' pairs are
   compared first and give classes; of the other pairs, those of different classes are compared after them, so that families of copies are not compared through.
5. Links join sets to classes. In large buckets, all sets outside of the bucket's largest class still have to meet the sets of other
   classes: both are dealt into blocks of bounded size. The counts by parts meet first; the sets that they leave meet whole, where
   a task counts the overlaps of two blocks by products of 0-1 matrices.
   Only classes are joined there, so no pair of copies is listed. Groups of more than `SMALL` sets are such buckets too.

What stays quadratic are large numbers of sets with a rare shingle in common that are similar to no other, a matrix product for two blocks.

Defined results: a text with fewer words than a shingle has is one shingle of all its words; null texts and texts without a word have
no shingles and are in no class but their own; a row with a null id has a null class and joins nothing; rows that repeat an id count each;
an empty table gives an empty result; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import checkpointed, fitted, no_text, released, table, thinned
from spanwright.llm.graph import components

SHINGLE, PERCENT = 4, 85
#: Cells of the sketch; groups of a bucket whose pairs are listed; sets and shingles of a block; columns of a matrix.
CELLS, SMALL, BLOCK, BLOCK_SHINGLES, COLUMNS = 1 << 18, 32, 256, 1 << 20, 4096
#: Parts of the hash by which shingles are counted before whole sets move, as bytes: a power of two that leaves a part `EACH` shingles at most on
#: average, within limits. Sets whose counts form a block, and their shingles.
PARTS, MOST_PARTS, EACH = 128, 1 << 16, 1
COUNTED, COUNTED_SHINGLES = 2048, 1 << 24
#: Words that a task remembers, texts hashed together.
WORD_MEMORY, TEXTS = 250_000, 64

_PLACE = np.random.default_rng(20240412).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Row number by word of its hash. Bytes split at the six ASCII spaces, and `lower` changes A to Z alone."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)

    def shingles(self, texts: list[bytes], size: int) -> list[np.ndarray]:
        """The hashes of each text's shingles."""
        split = [t.lower().split() for t in texts]
        if len(self) > WORD_MEMORY:
            self.clear()
            self.hashes = self.hashes[:0]
        new = [w for w in set().union(*split) if w not in self]
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, 7) for w in new], dtype=np.uint64)])
        return [self._hashed(np.fromiter(map(self.__getitem__, s), dtype=np.int64, count=len(s)), size) for s in split]

    def _hashed(self, rows: np.ndarray, size: int) -> np.ndarray:
        words, n = self.hashes[rows], min(size, len(rows))
        if not n:
            return words
        h = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            h += words[j : j + len(h)] * _PLACE[j]
        return _mixed(h)


def _read(batches, size: int, column: int):
    """(batch, shingles) of slices of few texts."""
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            yield some, words.shingles(some.column(column).to_pylist(), size)


def cells_of(h: np.ndarray, all_cells: int) -> np.ndarray:
    return (h % np.uint64(all_cells)).astype(np.int64)


def _count(size: int, all_cells: int):
    def run(batches):
        seen = np.zeros(all_cells, np.int64)
        for _, hashed in _read(batches, size, 0):
            seen += np.bincount(cells_of(np.concatenate(hashed), all_cells), minlength=all_cells)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], names=["cell", "n"])

    return run


def prefix(h: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set in order of hashes, one of which each set that is similar enough has among its own rarest."""
    order = np.argsort(counts[cells_of(h, len(counts))], kind="stable")
    return h[order[: len(h) - -(-percent * len(h) // 100) + 1]]


def named(sets: list[np.ndarray]) -> pa.Array:
    """A 64-bit name of each set, null for the empty one."""
    return pa.array([int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True) if len(h) else None for h in sets], pa.int64())


def _sign(counts, size: int, percent: int):
    def run(batches):
        for batch, hashed in _read(batches, size, 1):
            sets = [np.unique(h) for h in hashed]
            first = [prefix(h, counts.value, percent) if len(h) else h for h in sets]
            n = np.array([len(h) for h in sets], np.int64)
            groups = named([np.append(f, m) if m else f for f, m in zip(first, n.astype(np.uint64))])
            counted = pa.array([by_part(h, parts_of(len(h))) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), named(sets), groups, pa.array([h.view(np.int64) for h in first], pa.list_(pa.int64())), counted], names=["doc_id", "n", "node", "g", "prefix", "counts"])

    return run


def _sets(size: int):
    def run(batches):
        for _, hashed in _read(batches, size, 0):
            sets = [np.unique(h) for h in hashed]
            yield pa.RecordBatch.from_arrays([named(sets), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "h"])

    return run


def by_part(h: np.ndarray, parts: int = PARTS) -> bytes:
    """Shingles of a set by part of the hash, a byte each; 255 stands for any more too."""
    return np.minimum(np.bincount((h >> np.uint64(40)).astype(np.int64) % parts, minlength=parts), 255).astype(np.uint8).tobytes()


def parts_of(n: int) -> int:
    """Parts for n shingles. With as many for sets of any size, a part of a large set holds so many shingles that all large sets look alike."""
    return min(MOST_PARTS, max(PARTS, 1 << (n // EACH).bit_length()))


def merged_parts(counts: np.ndarray, parts: int) -> np.ndarray:
    """Rows of counts for fewer parts; both numbers are powers of two."""
    counts = counts.reshape(len(counts), -1, parts)
    return np.where((counts == 255).any(axis=1), 255, np.minimum(counts.sum(axis=1, dtype=np.int64), 255)).astype(np.uint8)


def counts_allow(percent: int, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with the counts x and y may be similar: in a part, no more are common than the lesser count."""
    least = np.minimum(x, y)
    most = np.where((least == 255).any(axis=1), np.minimum(n, m), np.minimum(least.sum(axis=1, dtype=np.uint32).astype(np.int64), np.minimum(n, m)))
    return 100 * most >= percent * (n + m - most)


def allowed(percent: int, x: np.ndarray, y: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """`counts_allow` of a set and others, whose parts may differ in number from its own."""
    parts = min(x.shape[1], y.shape[1])
    x, y = (c if c.shape[1] == parts else merged_parts(c, parts) for c in (x, y))
    return counts_allow(percent, x, y, n, m)


def _counts(column) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint8)[None] for c in column]


def _may_be_similar(percent: int):
    """The pairs whose counts allow the similarity."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            x, y = (_counts(batch.column(c).to_pylist()) for c in ("ca", "cb"))
            kept = [bool(allowed(percent, x[i], y[i], n[i], m[i : i + 1])[0]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "led")], names=["a", "b", "led"]).filter(pa.array(kept, pa.bool_()))

    return run


def _may_meet(percent: int):
    """(bucket, node) of the sets in two blocks that have one of another class whose counts allow the similarity."""

    def run(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if probes.empty or members.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("bucket", "node")})
        (x, n, cx), (y, m, cy) = ((_counts(side["counts"]), side["n"].to_numpy(), side["class"].to_numpy()) for side in (probes, members))
        left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)
        # few parts are compared first, all parts of those that they leave then
        short_x, short_y = (np.concatenate([merged_parts(c, PARTS) for c in side]) for side in (x, y))
        sizes = np.array([c.shape[1] for c in y])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            block, short = np.concatenate([y[j] for j in at]), short_y[at]
            for i in range(len(x)):
                may = np.flatnonzero((cx[i] != cy[at]) & (100 * np.minimum(n[i], m[at]) >= percent * np.maximum(n[i], m[at])))
                may = may[counts_allow(percent, short_x[i], short[may], n[i], m[at[may]])]
                if left[i]:  # what is known to meet need not be found again
                    may = may[~right[at[may]]]
                if len(may):
                    near = at[may[allowed(percent, x[i], block[may], n[i], m[at[may]])]]
                    left[i] |= len(near) > 0
                    right[near] = True
        nodes = np.unique(np.concatenate([probes["node"].to_numpy()[left], members["node"].to_numpy()[right]]))
        return pd.DataFrame({"bucket": np.full(len(nodes), probes["bucket"].iloc[0]), "node": nodes})

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            near = []
            for i in range(batch.num_rows):
                hx, hy = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
                shared = int((hy[at] == hx).sum())
                near.append(100 * shared >= percent * (len(hx) + len(hy) - shared))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each left set has in common with each right one, by products of 0-1 matrices of `COLUMNS` shingles."""
    out = np.zeros((len(left), len(right)), np.int64)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        hit = shared[at] == h
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    def matrix(at: np.ndarray, owner: np.ndarray, rows: int, first: int) -> np.ndarray:
        lo, hi = np.searchsorted(at, (first, first + COLUMNS))
        m = np.zeros((rows, COLUMNS), np.float32)
        m[owner[lo:hi], at[lo:hi] - first] = 1
        return m

    if len(shared):
        l, r = places(left), places(right)  # noqa: E741
        for first in range(0, len(shared), COLUMNS):
            out += (matrix(*l, len(left), first) @ matrix(*r, len(right), first).T).astype(np.int64)
    return out


def _joined(percent: int):
    """Pairs of classes that have similar sets in two blocks, each once."""

    def run(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if probes.empty or members.empty:
            return none
        x, y = ([np.frombuffer(h, np.uint64) for h in side["h"]] for side in (probes, members))
        cx, cy = probes["class"].to_numpy(), members["class"].to_numpy()
        shared = overlaps(x, y)
        total = np.array([len(h) for h in x])[:, None] + np.array([len(h) for h in y])
        i, j = np.nonzero((100 * shared >= percent * (total - shared)) & (cx[:, None] != cy))
        pairs = np.unique(np.stack([np.minimum(cx[i], cy[j]), np.maximum(cx[i], cy[j])], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def can_be(percent: int, a: str, b: str) -> Column:
    """Sizes and places of a shared shingle in two sets (structs of n and pos) allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))


def similar_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, small: int = SMALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the least id that links of similar sets lead to."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).cast("binary").alias("text"))
    counts = np.zeros(CELLS, np.int64)
    cells = chosen.select("text").mapInArrow(_count(size, CELLS), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    sketch = spark.sparkContext.broadcast(counts)
    signed = checkpointed(chosen.mapInArrow(_sign(sketch, size, percent), "doc_id long, n long, node long, g long, prefix array<long>, counts binary"))

    # one row for each set, whatever its number of copies, and for each group how many sets it has and the first of them
    with_words = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    sets = checkpointed(with_words.groupBy("node").agg(F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("doc_id", "n", "g")]))
    groups = sets.groupBy("g").agg(F.count("*").alias("members"), F.min("node").alias("lead"))
    stands = checkpointed(sets.select("g", "node").join(groups, "g"))
    postings = with_words.select("g", "n", F.posexplode("prefix").alias("pos", "bucket"))
    shared = checkpointed(postings.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("bucket"))
    met = checkpointed(thinned(postings, shared, "bucket").distinct().join(shared, "bucket"))
    rows = met.count()
    met = fitted(met, rows)
    met = checkpointed(fitted(met.join(met.groupBy("bucket").agg(F.count("*").alias("all")), "bucket"), rows))

    few = met.filter(F.col("all") <= small).select("bucket", F.struct("g", "n", "pos").alias("x"))
    listed = few.join(few.select("bucket", F.col("x").alias("y")), "bucket").filter("x.g < y.g").filter(can_be(percent, "x", "y")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"))
    many = met.filter(F.col("all") > small)
    fullest = met.groupBy("g").agg(F.sum("all").alias("fill"))
    leaders = met.join(fullest, "g").groupBy("bucket").agg(F.max(F.struct("fill", "g", "n", "pos")).alias("x"))
    led = met.select("bucket", F.struct("g", "n", "pos").alias("y")).join(leaders, "bucket").filter("x.g <> y.g").filter(can_be(percent, "x", "y")).select(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b"))
    marked = listed.withColumn("led", F.lit(False)).unionByName(led.withColumn("led", F.lit(True)))
    pairs = checkpointed(marked.groupBy("a", "b").agg(F.max("led").alias("led")))

    # pairs of groups become pairs of their sets; a large group's first set stands for it here, the others meet in step 5
    limited = stands.filter((F.col("members") <= small) | (F.col("node") == F.col("lead")))
    of = lambda s: limited.select(F.col("g").alias(s), F.col("node").alias(f"of_{s}"))
    wide = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"), "led")
    twice = stands.filter((F.col("members") > 1) & (F.col("members") <= small))
    inside = twice.select("g", F.col("node").alias("a")).join(twice.select("g", F.col("node").alias("b")), "g").filter("a < b").select("a", "b")
    large = stands.filter(F.col("members") > small)
    first = large.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    expanded = checkpointed(wide.unionByName(inside.unionByName(first).withColumn("led", F.lit(True))))

    # step 5 takes the sets of large buckets, of buckets with a large group, and of each large group
    open_buckets = many.select("bucket").unionByName(met.join(large.select("g").distinct(), "g", "left_semi").select("bucket")).distinct()
    open_sets = met.select("bucket", "g").join(open_buckets, "bucket", "left_semi").join(stands, "g").select("bucket", "node")
    open_sets = checkpointed(open_sets.unionByName(large.select(F.xxhash64("g", F.lit("group")).alias("bucket"), "node")))

    nodes_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def counted(nodes: DataFrame) -> DataFrame:
        """(node, n, counts) of some sets, and of a few others."""
        return thinned(signed.select("node", "n", "counts"), nodes, "node").dropDuplicates(["node"])

    def vectors_of(nodes: DataFrame) -> DataFrame:
        """(node, h) of some sets, from the whole text of the first document of each."""
        wanted = checkpointed(sets.join(nodes, "node", "left_semi").select("node", "doc_id"))
        ids = wanted.select("doc_id").distinct()
        # where an id repeats, its other texts are read too and go
        read = thinned(chosen, ids, "doc_id").join(ids, "doc_id").select("text").mapInArrow(_sets(size), "node long, h binary")
        return checkpointed(read.join(wanted.select("node"), "node").dropDuplicates(["node"]))

    met_counts = checkpointed(counted(nodes_of(expanded)))
    x, y = (met_counts.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"c{s}")) for s in "ab")
    expanded = checkpointed(expanded.join(y, "b").join(x, "a").select("a", "b", "led", "na", "nb", "ca", "cb").mapInArrow(_may_be_similar(percent), "a long, b long, led boolean"))
    released(spark)
    vectors = vectors_of(nodes_of(expanded))

    def linked(some: DataFrame) -> DataFrame:
        own = thinned(vectors, nodes_of(some), "node")
        x, y = (own.select(F.col("node").alias(s), F.col("h").alias(f"h{s}")) for s in "ab")
        return checkpointed(some.join(y, "b").join(x, "a").select("a", "b", "ha", "hb").mapInArrow(_similar(percent), "a long, b long"))

    found = components(linked(expanded.filter("led")))
    classes = checkpointed(sets.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("class")))

    def merged(classes: DataFrame, pairs: DataFrame) -> DataFrame:
        further = components(checkpointed(pairs.distinct())).select(F.col("node").alias("class"), F.col("component").alias("further"))
        return checkpointed(classes.join(further, "class", "left").select("node", F.coalesce("further", "class").alias("class")))

    of_a, of_b = (classes.select(F.col("node").alias(s), F.col("class").alias(f"class_{s}")) for s in "ab")
    apart = checkpointed(expanded.filter("NOT led").select("a", "b").join(of_a, "a").join(of_b, "b").filter("class_a <> class_b"))
    if not apart.isEmpty():
        classes = merged(classes, linked(apart.select("a", "b")).join(apart, ["a", "b"]).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))

    placed = open_sets.join(classes, "node")
    by_class = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    mixed = by_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class"))["class"].alias("main")).filter("classes > 1").select("bucket", "main")
    heavy = checkpointed(placed.join(mixed, "bucket").select("bucket", "node", "class", (F.col("class") != F.col("main")).alias("probe")))

    def by_blocks(rows: DataFrame, sets_of_block: int, shingles: int, columns: list[str], function, schema: str) -> DataFrame:
        """`function` of each block of a bucket's probes and each block of its sets."""
        blocks = F.greatest(F.ceil(F.count("*") / sets_of_block), F.ceil(F.sum("n") / shingles)).cast("int")
        shape = rows.groupBy("bucket").agg(blocks.alias("mb")).join(rows.filter("probe").groupBy("bucket").agg(blocks.alias("pb")), "bucket")
        dealt = rows.join(shape, "bucket")
        to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
        part = lambda some, p, m: some.select(p.alias("p"), m.alias("m"), *[F.col(c).alias(c) for c in ("bucket", *columns)]).groupBy("bucket", "p", "m")
        probes, others = part(dealt.filter("probe"), own("pb", 1), to_all("mb")), part(dealt, to_all("pb"), own("mb", 2))
        return probes.cogroup(others).applyInPandas(function, schema)

    if not heavy.isEmpty():
        rows = heavy.join(counted(heavy.select("node").distinct()), "node")
        near = by_blocks(rows, COUNTED, COUNTED_SHINGLES, ["node", "class", "n", "counts"], _may_meet(percent), "bucket long, node long").distinct()
        heavy = checkpointed(heavy.join(near, ["bucket", "node"]).join(sets.select("node", "n"), "node"))
    released(spark)
    if not heavy.isEmpty():
        rows = heavy.join(vectors_of(heavy.select("node").distinct()), "node")
        classes = merged(classes, by_blocks(rows, BLOCK, BLOCK_SHINGLES, ["class", "h"], _joined(percent), "a long, b long"))

    of_set = sets.select("node", "doc_id", "copies").join(classes, "node")
    least = of_set.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    of_set = checkpointed(of_set.join(least, "class").select("node", "component_id", "copies"))
    # sets with many copies are few: a thousandth of all rows each at least
    total = max(1, signed.count())
    often, rare = of_set.filter(F.col("copies") * 1000 > total).drop("copies"), of_set.filter(F.col("copies") * 1000 <= total).drop("copies")
    marked = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(F.broadcast(often), "node", "left")
    common = marked.filter("component_id IS NOT NULL").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    rest = marked.filter("component_id IS NULL AND node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "node").join(rare, "node").select("doc_id", "n_shingles", "component_id")
    alone = marked.filter("component_id IS NULL AND (node IS NULL OR doc_id IS NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return common.unionByName(rest).unionByName(alone)


def op12_jaccard_join(spark, sf_dir):
    return similar_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
each AS (SELECT row, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL),
links AS (SELECT a.row AS a, b.row AS b FROM each a JOIN each b ON a.x = b.x AND a.row <> b.row GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT row AS a, row AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN reach r ON s.row = r.a JOIN s o ON o.row = r.b GROUP BY s.row, s.doc_id, len(s.s)
"""
