"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

1. All words of all documents are counted. The most frequent are tokens of their own; every other word is spelled
   in pieces, those of a public tokenizer's first merges, down to bytes. So every token of every text is in the
   vocabulary and is predicted; none is unknown.
2. Training covers the whole corpus: in each of `ROUNDS` passes every task masks another share of the tokens of
   its documents, so that all are masked once over the passes, and descends along the gradient of predicting
   them from the tokens on either side. Spark averages the tasks' networks as vectors in two steps,
   weighted by tokens, and the average starts the next pass. The network is bounded; what is gathered (counts
   of all words, one network a task) grows with the input.
3. Texts are read as tokens once and kept in the checkpoint folder. A last scan masks every token of each whole text in turn and sums the conditional log-probabilities.

The softmax has two levels, a block of tokens and a token inside its block, so a prediction costs twice the
square root of the vocabulary.

Defined results: null texts and texts without a word have no tokens, log-probability 0 and a null mean; a
repeated row gives a repeated result and counts again in training; a null doc_id is passed on; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import checkpointed, no_text, table
from spanwright.llm.packing import Tokens, default_tokenizer

#: Tokens, a square number: padding (id 0), the tokenizer's letters and first merges, and frequent words.
VOCABULARY, BLOCK, LETTERS, MERGES = 2304, 48, 512, 1024
WORDS = VOCABULARY - 1 - LETTERS - MERGES
#: Width of the network, and the tokens it sees.
HIDDEN, OFFSETS = 12, (-2, -1, 1, 2)
ROUNDS, RATE, BATCH = 2, 0.2, 16_384
#: Distinct words that a task counts at once, and tokens of a slab of texts.
WORD_MEMORY, SLAB = 300_000, 60_000
#: Parameters of a row of a network on its way to the average, and rows that meet in one group of its first step.
PART, FAN_IN = 8192, 64


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters by name. The last row of `block` and of each `token` matrix is a bias, met by a state that is 1."""
    rng = np.random.default_rng(seed)
    blocks = VOCABULARY // BLOCK
    draw = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
    return {"embedding": draw(0.3, VOCABULARY, HIDDEN), "place": draw(0.25, len(OFFSETS), HIDDEN, HIDDEN), "hidden": np.zeros(HIDDEN, np.float32), "block": draw(0.1, HIDDEN + 1, blocks), "token": draw(0.1, blocks, HIDDEN + 1, BLOCK)}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in initial().items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


#: Arrays of a batch, kept from one to the next: fresh memory for each costs more than what is computed in it.
_kept: dict[str, np.ndarray] = {}


def _room(name: str, rows: int, columns: int) -> np.ndarray:
    if name not in _kept or _kept[name].shape[0] < rows or _kept[name].shape[1] != columns:
        _kept[name] = np.empty((max(rows, BATCH), columns), np.float32)
    return _kept[name][:rows]


def _exp(x: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """(sums of e^x by row, what was taken off x before), with x overwritten by its exponentials."""
    top = np.float32(0) if x.max() < 80 else x.max(axis=1)
    if np.ndim(top):
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ ones, top


def _contexts(p: dict) -> np.ndarray:
    """What each token adds to the state of a position, by its place beside it."""
    return np.stack([p["embedding"] @ p["place"][j] for j in range(len(OFFSETS))])


def _hidden(p: dict, contexts: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """States of the positions from the tokens around them, and a 1; the token at a position is not looked at."""
    out, h, more = _room("out", len(at), HIDDEN + 1), _room("h", len(at), HIDDEN), _room("more", len(at), HIDDEN)
    np.take(contexts[0], seq[at + OFFSETS[0]], axis=0, out=h, mode="clip")
    for j in range(1, len(OFFSETS)):
        h += np.take(contexts[j], seq[at + OFFSETS[j]], axis=0, out=more, mode="clip")
    h += p["hidden"]
    np.tanh(h, out=out[:, :HIDDEN])
    out[:, HIDDEN] = 1
    return out


def _by_block(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of the positions by block, (block, first, behind the last) of each block)."""
    block = (seq[at] // BLOCK).astype(np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=VOCABULARY // BLOCK))])
    return np.argsort(block, kind="stable"), [(b, a, z) for b, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])) if z > a]


def log_probabilities(p: dict, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the tokens at the positions `at`, each masked from its own prediction."""
    out, contexts, ones = np.zeros(len(at), np.float32), _contexts(p), np.ones(BLOCK, np.float32)

    def log_softmax(x: np.ndarray, which: np.ndarray) -> np.ndarray:
        chosen = x[np.arange(len(x)), which]
        total, top = _exp(x, ones)
        return chosen - top - np.log(total)

    for i in range(0, len(at), BATCH):
        some = at[i : i + BATCH]
        order, blocks = _by_block(seq, some)
        some = some[order]
        h, (block, token) = _hidden(p, contexts, seq, some), np.divmod(seq[some], BLOCK)
        lp = log_softmax(np.matmul(h, p["block"], out=_room("x", len(some), BLOCK)), block)
        for b, a, z in blocks:
            lp[a:z] += log_softmax(h[a:z] @ p["token"][b], token[a:z])
        out[i + order] = lp
    return out


class Trainer:
    """Adagrad on batches of masked positions."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.p, self.rate = {k: v.copy() for k, v in p.items()}, rate
        self.seen = {k: np.full(v.shape, 1e-8, np.float32) for k, v in p.items()}

    def descend(self, gradients: dict[str, np.ndarray]) -> None:
        for name, g in gradients.items():
            seen = self.seen[name]
            seen += g * g
            self.p[name] -= self.rate * g / np.sqrt(seen)

    def step(self, seq: np.ndarray, at: np.ndarray) -> None:
        self.descend(self.gradients(seq, at))

    def gradients(self, seq: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of minus the log-probabilities."""
        p, n, contexts, ones = self.p, np.float32(len(at)), _contexts(self.p), np.ones(BLOCK, np.float32)
        order, blocks = _by_block(seq, at)
        at = at[order]
        h, (block, token) = _hidden(p, contexts, seq, at), np.divmod(seq[at], BLOCK)
        rows = np.arange(len(at))

        def error(x: np.ndarray, which: np.ndarray) -> np.ndarray:
            total, _ = _exp(x, ones)
            x *= (1 / total)[:, None]
            x[rows[: len(x)], which] -= 1
            return x

        e = error(np.matmul(h, p["block"], out=_room("x", len(at), BLOCK)), block)
        dh = np.matmul(e, p["block"][:HIDDEN].T, out=_room("dh", len(at), HIDDEN))
        g = {"block": h.T @ e / n, "token": np.zeros_like(p["token"])}
        for b, a, z in blocks:
            e = error(h[a:z] @ p["token"][b], token[a:z])
            dh[a:z] += e @ p["token"][b][:HIDDEN].T
            np.matmul(h[a:z].T, e, out=g["token"][b])
        g["token"] /= n
        h = h[:, :HIDDEN]
        dh *= 1 - h * h
        dh /= n
        g |= {"hidden": dh.sum(axis=0), "place": np.zeros_like(p["place"]), "embedding": np.zeros_like(p["embedding"])}
        columns = dh.T.astype(np.float64)
        for j, offset in enumerate(OFFSETS):
            ids = seq[at + offset]
            d_context = np.stack([np.bincount(ids, c, VOCABULARY) for c in columns], axis=1).astype(np.float32)
            g["embedding"] += d_context @ p["place"][j].T
            g["place"][j] = p["embedding"].T @ d_context
        return g


def pieces_of(path: str):
    """The public tokenizer at `path` with its first `MERGES` merges alone."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    model["vocab"] = {piece: i for piece, i in model["vocab"].items() if i < LETTERS + MERGES}
    model["merges"], whole["added_tokens"] = model["merges"][:MERGES], []
    return Tokenizer.from_str(json.dumps(whole))


class Words(Tokens):
    """The tokens of each word that was met: its own, or those of its pieces."""

    def __init__(self, frequent: list[str], tokenizer: str):
        super().__init__(pieces_of(tokenizer))
        self.frequent = {w: array("I", [LETTERS + MERGES + i]).tobytes() for i, w in enumerate(frequent)}

    def __missing__(self, c: str) -> bytes:
        known = self.frequent.get(c.lower())
        if known is None:
            return super().__missing__(c)
        self[c] = known
        return known

    def tokens(self, text: str) -> bytes:
        """As 16-bit numbers, from 1 on."""
        return (np.frombuffer(self.of(text), "<u4") + 1).astype(np.uint16).tobytes()


def slabs(rows: pa.Array):
    """(tokens with padding around each text, positions of real ones, tokens of each text) of binary `rows`."""
    pad, i = np.zeros(2, np.int64), 0
    while i < len(rows):
        some, n = [], 0
        while i < len(rows) and n < SLAB:
            some.append(np.frombuffer(rows[i].as_buffer(), np.uint16))
            n += len(some[-1])
            i += 1
        sizes = np.array([len(r) for r in some])
        at = np.arange(n) + np.repeat(2 * np.arange(len(some)) + 2, sizes)
        yield np.concatenate([pad, *[x for r in some for x in (r, pad)]]).astype(np.int64), at, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks count what they see before anything moves."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.lower().split())
                if len(seen) > WORD_MEMORY:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame) -> list[str]:
    """The `WORDS` most frequent words, from the counts of all words."""
    return [r["word"] for r in word_counts(docs).orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.asarray(p, dtype=np.float64) * n for p, n in zip(rows["p"], rows["n"]))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "n": [rows["n"].sum()], "p": [(total / rows["n"].sum()).astype(np.float32)]})


def average(networks: DataFrame) -> np.ndarray | None:
    """The mean of the networks' parts (task, part, n, p), weighted by n; at most `FAN_IN` tasks' parts meet at first."""
    tasks = networks.agg(F.max("task")).first()[0]
    if tasks is None:
        return None
    schema = "part int, n double, p array<float>"
    first = networks.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("some")).applyInPandas(lambda rows: _summed(rows), schema)
    mean = (first.groupBy("part").applyInPandas(lambda rows: _summed(rows), schema) if tasks >= FAN_IN else first).toPandas()
    return np.concatenate(mean.sort_values("part")["p"].tolist())


def tokenised(docs: DataFrame, frequent: list[str], tokenizer: str) -> DataFrame:
    """(doc_id, tokens) of (doc_id, text), tokens as 16-bit numbers."""

    def run(batches):
        words = Words(frequent, tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.tokens(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "tokens"])

    return docs.mapInArrow(run, "doc_id long, tokens binary")


def train(tokens: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after `rounds` passes over all rows (doc_id, tokens), averaged over tasks after each."""
    context, p = tokens.sparkSession.sparkContext, initial()
    for done in range(rounds):
        start = context.broadcast(p)

        def descend(batches, done=done, start=start):
            from pyspark import TaskContext

            trainer, n, rng = Trainer(start.value, RATE / (1 + done)), 0, np.random.default_rng(done)
            for batch in batches:
                for seq, at, _ in slabs(batch.column(0)):
                    chosen = rng.permutation(at[at % rounds == done])
                    n += len(chosen)
                    for i in range(0, len(chosen), BATCH):
                        trainer.step(seq, chosen[i : i + BATCH])
            if n:
                values = flat(trainer.p)
                parts = [values[i : i + PART] for i in range(0, len(values), PART)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([float(n)] * len(parts)), pa.array(parts, pa.list_(pa.float32()))], names=["task", "part", "n", "p"]
                )

        networks = checkpointed(tokens.select("tokens").mapInArrow(descend, "task int, part int, n double, p array<float>"))
        mean = average(networks)
        start.unpersist()
        if mean is None:
            break
        p = unflat(mean)
    return p


def scored(tokens: DataFrame, model) -> DataFrame:
    """(doc_id, n_tokens, log_probability) of (doc_id, tokens) under a broadcast network."""

    def score(batches):
        p = model.value
        for batch in batches:
            sums, counts = [], []
            for seq, at, sizes in slabs(batch.column(1)):
                lp = log_probabilities(p, seq, at).astype(np.float64)
                sums.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), lp, len(sizes)))
                counts.append(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(np.concatenate(sums) if sums else [], pa.float64())], names=["doc_id", "n_tokens", "log_probability"])

    return tokens.mapInArrow(score, "doc_id long, n_tokens long, log_probability double")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean_log_probability) of each row."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"))
    tokens = checkpointed(tokenised(chosen, frequent_words(chosen), tokenizer or default_tokenizer()))
    model = docs.sparkSession.sparkContext.broadcast(train(tokens))
    return scored(tokens, model).withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))


def op8_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
