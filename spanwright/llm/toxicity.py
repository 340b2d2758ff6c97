"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as its own hashed embedding next to the mean embedding of its hashed character
n-grams, so that a spelling never seen in training still has its parts. Words of a text are read in
overlapping windows; one network runs over each window from both sides, an attention layer pools its states
and a logistic unit scores the window. A text's score is that of its highest window: one passage suffices.

Training happens on the driver, on a sample of labelled rows bounded by `Sample`: the first toxic and the
first clean ones in the order of a hash of the id, among rows outside the held-out fold, whole and of any
length until their texts reach the bound. Labels belong to
texts, not to windows, so each round of training takes the highest window of every toxic text as positive
and windows of clean texts as negative; character and word embeddings start from log-odds of document
counts in the sample. Steps hide three in ten words, so that no single one decides. An eighth of the sample is kept
from the network and calibrates the scores. Scoring is one scan without a shuffle.

Defined results: null and empty texts have no window and get the score of an empty window; a repeated row
gives a repeated result; a null doc_id is passed on and counts as not held out; without a positive or a
negative label every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import no_text, table


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of each class, and code points of all its texts together."""

    toxic: int = 1500
    clean: int = 2500
    chars: int = 16_000_000


WINDOW, STRIDE = 32, 24
#: Hash buckets of the embeddings, their width, the network's width, and the lengths of n-grams.
BUCKETS, WIDTH, HIDDEN, GRAMS = 1 << 18, 4, 12, (3, 4, 5)
#: Longer words count as several of at most this many characters.
WORD_CHARS = 24
#: Words whose gate inputs a task remembers, and windows that run through the network at once.
WORD_MEMORY, SLAB = 300_000, 1024
#: One in this many texts of the sample is kept from training and calibrates the scores.
CALIBRATED = 8
MARKS = ".,;:!?\"'()[]{}|#$%&*<>-_=+/\\~`^@"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of its n-grams padded with 0, how many of these count)."""
    own = np.array([zlib.crc32(w.encode()) % (BUCKETS - 1) + 1 for w in words], dtype=np.int64)
    codes = np.zeros((len(words), WORD_CHARS + 2), dtype=np.uint64)
    flat = np.frombuffer("".join(f"\x02{w}\x03".ljust(WORD_CHARS + 2, "\0") for w in words).encode("utf-32-le"), dtype="<u4")
    codes[:] = flat.reshape(len(words), -1)
    grams, valid = [], []
    for n in GRAMS:
        h = np.full((len(words), codes.shape[1] - n + 1), n, dtype=np.uint64)
        for j in range(n):
            h = (h * np.uint64(1_000_003)) ^ codes[:, j : codes.shape[1] - n + 1 + j]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        there = codes[:, n - 1 :] > 0
        grams.append((h % np.uint64(BUCKETS - 1) + np.uint64(1)) * there)
        valid.append(there.sum(axis=1))
    return own, np.concatenate([g.astype(np.int32) for g in grams], axis=1), np.maximum(1, np.sum(valid, axis=0))


def normal(chunk: str) -> list[str]:
    w = chunk.lower().strip(MARKS) or chunk[:1]
    return [w[i : i + WORD_CHARS] for i in range(0, len(w), WORD_CHARS)]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows that cover all ids; 0 pads the last one."""
    n = max(1, -(-max(0, len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=ids.dtype)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters `p` and what is computed from them. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"words": draw(BUCKETS, WIDTH) / 10, "grams": draw(BUCKETS, WIDTH) / 10, "attend": draw(2 * HIDDEN, HIDDEN), "focus": draw(HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in (0, 1):
            self.p |= {f"in{d}": draw(2 * WIDTH, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": draw(HIDDEN, 3 * HIDDEN)}
        for t in ("words", "grams"):
            self.p[t][0] = 0

    def inputs(self, own: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["words"][own], self.p["grams"][grams].sum(axis=1) / count[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.p[f"in{d}"] + self.p[f"b{d}"] for d in (0, 1))

    def run(self, gates: tuple[np.ndarray, np.ndarray], windows: np.ndarray, keep: bool = False):
        """Logits of windows of row numbers into `gates`, row 0 being padding; with `keep` what training needs."""
        n, there = len(windows), windows > 0
        states, tape = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32), {0: [], 1: []}
        for d in (0, 1):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g, hu, on = gates[d][windows[:, t]], h @ u, there[:, t, None]
                rz = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = np.where(on, c + z * (h - c), h)
                if keep:
                    tape[d].append((t, h, r, z, c, hu, on))
                h = new
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["attend"])
        e = np.where(there.T, a @ self.p["focus"], np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (states, tape, a, w, pooled, there)) if keep else logit

    def gradients(self, x: np.ndarray, windows: np.ndarray, wanted: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean cross-entropy by parameter and by input row."""
        logit, (states, tape, a, w, pooled, there) = self.run(self.gates(x), windows, keep=True)
        p, n = _sigmoid(logit), len(windows)
        error = ((p - wanted) / n).astype(np.float32)
        g = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(axis=2)
        d_e = np.where(there.T, w * (d_w - (w * d_w).sum(axis=0)), 0).astype(np.float32)
        g["focus"] = np.einsum("tn,tnh->h", d_e, a)
        d_a = d_e[:, :, None] * self.p["focus"] * (1 - a * a)
        g["attend"] = np.einsum("tni,tnj->ij", states, d_a, optimize=True)
        d_states += d_a @ self.p["attend"].T
        dx = np.zeros_like(x)
        for d in (0, 1):
            u, dh = self.p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            du, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, r, z, c, hu, on in reversed(tape[d]):
                dh = dh + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                dn = np.where(on, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
                into = np.concatenate([dr, dz, dc], axis=1)
                back = np.concatenate([dr, dz, dc * r], axis=1)
                du += h.T @ back
                np.add.at(d_gates, windows[:, t], into)
                dh = np.where(on, dn * z, dh) + back @ u.T
            d_gates[0] = 0
            g |= {f"u{d}": du, f"in{d}": x.T @ d_gates, f"b{d}": d_gates.sum(axis=0)}
            dx += d_gates @ self.p[f"in{d}"].T
        loss = float(-np.mean(wanted * np.log(p + 1e-7) + (1 - wanted) * np.log(1 - p + 1e-7)))
        return g, dx, loss


def train(texts: list[str], toxic: list[int], epochs: int = 6, batch: int = 256, rate: float = 0.01, hide: float = 0.3, seed: int = 7) -> Network:
    """A step hides the share `hide` of its words, so that the network reads their surroundings too."""
    rng, net = np.random.default_rng(seed), Network(seed)
    chunks = sorted({w for t in texts for c in t.split() for w in normal(c)})
    number = {w: i + 1 for i, w in enumerate(chunks)}
    own, grams, count = word_features(["", *chunks])
    own[0], grams[0] = 0, 0
    ids = [np.array([number[w] for c in t.split() for w in normal(c)], dtype=np.int32) for t in texts]
    y = np.asarray(toxic)
    aside = np.zeros(len(y), bool)  # texts of either class that the network doesn't learn from, for the calibration
    for label in (0, 1):
        own_class = np.flatnonzero(y == label)
        aside[own_class[np.arange(len(own_class)) % CALIBRATED == CALIBRATED - 1]] = True
    for name, of in (("words", own[:, None]), ("grams", grams)):
        # documents of either class that hold a bucket
        held = np.ones((2, BUCKETS)) * 0.5
        for i, t in enumerate(ids):
            if aside[i]:
                continue
            held[y[i]][np.unique(of[np.unique(t)])] += 1
        odds = np.log(held[1] / (np.sum(y[~aside] == 1) + 1)) - np.log(held[0] / (np.sum(y[~aside] == 0) + 1))
        net.p[name][:, 0] = np.where(held.sum(axis=0) > 2, np.clip(odds, -2, 4), 0)
        net.p[name][0] = 0
    windows = [windows_of(t) for t in ids]
    every, owner = np.concatenate(windows), np.repeat(np.arange(len(ids)), [len(w) for w in windows])
    at = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
    x = net.inputs(own, grams, count)
    odds = x[:, 0] + x[:, WIDTH]
    score = np.where(every > 0, odds[every], np.float32(-9)).max(axis=1)  # until the network can tell
    moments: dict[str, list[np.ndarray]] = {}
    step = 0
    for epoch in range(epochs):
        best = np.array([at[i] + int(np.argmax(score[at[i] : at[i + 1]])) for i in range(len(ids))])
        negatives = np.flatnonzero((y[owner] == 0) & ~aside[owner])
        chosen = np.concatenate([best[~aside], rng.choice(negatives, min(len(negatives), 3 * int(np.sum(y == 1)) + 1), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            part, step = chosen[i : i + batch], step + 1
            used, local = np.unique(np.concatenate([[0], every[part].ravel()]), return_inverse=True)
            x = net.inputs(own[used], grams[used], count[used])
            hidden = rng.random(len(x)) < hide
            x[hidden] = 0
            g, dx, _ = net.gradients(x, local[1:].reshape(len(part), WINDOW), y[owner[part]].astype(np.float32))
            for k, v in g.items():
                m = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                m[0], m[1] = 0.9 * m[0] + 0.1 * v, 0.99 * m[1] + 0.01 * v * v
                net.p[k] -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            dx[hidden] = 0
            np.subtract.at(net.p["words"], own[used], rate * 20 * dx[:, :WIDTH])
            spread = np.repeat(dx[:, None, WIDTH:] / count[used][:, None, None], grams.shape[1], axis=1)
            np.subtract.at(net.p["grams"], grams[used].ravel(), (rate * 20 * spread.reshape(-1, WIDTH)).astype(np.float32))
            net.p["words"][0] = net.p["grams"][0] = 0
        gates = net.gates(net.inputs(own, grams, count))
        score = np.concatenate([net.run(gates, every[i : i + SLAB]) for i in range(0, len(every), SLAB)])
    if set(y[aside]) == {0, 1}:
        slope, shift = calibration(np.maximum.reduceat(score, at[:-1])[aside], y[aside])
        net.p["out"] *= np.float32(slope)
        net.p["bias"] = (slope * net.p["bias"] + shift).astype(np.float32)
    return net


def calibration(logit: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, shift) of a logistic regression of the labels on the logits, by Newton's method, held towards (1, 0)."""
    x, w, prior = np.stack([logit, np.ones(len(logit))], axis=1).astype(np.float64), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * (w - prior))
        w = w - step / max(1.0, np.abs(step).max())
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Words(dict):
    """Row number of the gate inputs for each blank-free chunk of text."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows: dict[str, int] = {}
        self.gates = tuple(np.zeros((WORD_MEMORY // 4, 3 * HIDDEN), np.float32) for _ in (0, 1))

    def learn(self, chunks: set[str]) -> None:
        parts = {c: normal(c) for c in chunks if c not in self}
        new = list({w for ws in parts.values() for w in ws if w not in self.rows})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            g, first = self.net.gates(self.net.inputs(*word_features(some))), len(self.rows) + 1
            while first + len(some) > len(self.gates[0]):
                self.gates = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.gates)
            for have, add in zip(self.gates, g):
                have[first : first + len(some)] = add
            self.rows.update(zip(some, range(first, first + len(some))))
        for c, ws in parts.items():
            self[c] = self.rows[ws[0]] if len(ws) == 1 else tuple(self.rows[w] for w in ws)

    def ids(self, text: str) -> np.ndarray:
        chunks = text.split()
        try:
            out = [self[c] for c in chunks]
        except KeyError:
            self.learn(set(chunks))
            out = [self[c] for c in chunks]
        if tuple in set(map(type, out)):  # long words have several numbers
            out = [n for x in out for n in (x if isinstance(x, tuple) else (x,))]
        return np.array(out, dtype=np.int32)


def score_texts(net: Network, words: Words, texts: list[str]) -> np.ndarray:
    """The highest window's probability for each text."""
    out, i = np.zeros(len(texts), np.float64), 0
    while i < len(texts):
        if len(words) > WORD_MEMORY:
            words.forget()
        pending, owners, n = [], [], 0
        while i < len(texts) and n < SLAB:
            w = windows_of(words.ids(texts[i]))
            pending.append(w)
            owners.append((i, n))
            n += len(w)
            i += 1
        every = np.concatenate(pending)
        logit = np.concatenate([net.run(words.gates, every[j : j + SLAB]) for j in range(0, n, SLAB)])
        out[owners[0][0] : i] = _sigmoid(np.maximum.reduceat(logit, [at for _, at in owners]).astype(np.float64))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> pd.DataFrame:
    """(text, toxic) of at most the sample's rows. The broadcast holds its ids alone, whatever the tables' sizes."""
    fold = labels.filter(~held_out(doc_id) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__toxic"))
    some = lambda v, n: fold.filter(F.col("__toxic") == v).orderBy(F.xxhash64("__id"), "__id").limit(n)
    rows = some(1, sample.toxic).unionByName(some(0, sample.clean)).collect()
    if not rows:
        return pd.DataFrame({"text": [], "toxic": []})
    spark, keyed = docs.sparkSession, docs.select(F.col(doc_id).alias("__id"), no_text(text).alias("text"))
    of = lambda some: keyed.join(F.broadcast(spark.createDataFrame(some, "__id long, __toxic int")), "__id")
    sizes = {r["__id"]: r["n"] for r in of(rows).groupBy("__id").agg(F.sum(F.length("text")).alias("n")).collect()}
    total, chosen = 0, []
    for r in sorted(rows, key=lambda r: zlib.crc32(str(r["__id"]).encode())):  # classes in turn as they come
        if r["__id"] in sizes and total + sizes[r["__id"]] <= sample.chars:
            total += sizes[r["__id"]]
            chosen.append(r)
    if not chosen:
        return pd.DataFrame({"text": [], "toxic": []})
    found = of(chosen).select("__id", "text", F.col("__toxic").alias("toxic")).toPandas()
    return found.sort_values(["__id", "text"]).drop_duplicates("__id")[["text", "toxic"]]


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    rows = training_sample(docs, labels, sample, doc_id, text)
    net = train(rows["text"].tolist(), rows["toxic"].astype(int).tolist()) if rows["toxic"].nunique() == 2 else None
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = model.value
        words = Words(net) if net else None
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score_texts(net, words, b["text"].tolist()) if net else np.zeros(len(b))})

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), no_text(text).alias("text")).mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
