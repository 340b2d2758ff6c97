"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A scan tokenises every whole text (ids, then the id 0) and cuts only documents longer than a sequence.
Pieces, without their ids unless these are asked for, are dealt by a hash of document and piece into
buckets of bounded size, and each bucket is packed by itself: a sequence is filled greedily with the longest
piece that still fits; if a gap remains, the smallest document of the sequence gives way to two unpacked
ones that together fit the widened gap more tightly.

Defined results: a null or empty text is the one token 0; a repeated row is packed as often as it occurs; a
null doc_id is passed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from bisect import bisect_right
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import no_text, table

SEQUENCE = 2048
#: Bytes of text that one bucket answers for, and so about how many pieces a task packs.
BUCKET_BYTES = 24 << 20
#: Tokenised words that a worker remembers; beyond that it keeps a generation of their letters.
WORD_MEMORY = 350_000
#: Longer words are tokenised each time, so that the memory is bounded in bytes too.
LONGEST = 64
#: Characters of a run of marks; apostrophes are none, since contractions have pre-tokens of their own.
MARKS = ".,;:!?#$%&*|+-/()"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> str:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return "".join(chr(i) if i in plain else chr(256 + i - sum(j < i for j in plain)) for i in range(256))


class Tokens(dict):
    """Little-endian 32-bit ids by blank-free chunk of text. Neither normalising nor merging crosses a blank.

    Letters up to U+00FF and a run of marks after them are two pre-tokens that normalising only lowers, so the
    letters go to the tokenizer's model directly and are kept once for any case and marks; other chunks take
    the whole way.
    """

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.letters, self.older = tokenizer, {}, {}
        self.model, self.bytes = self.tokenizer.model, dict(enumerate(_byte_letters()))
        self.closing, self.letters[""] = {"": b""}, b""

    def encoded(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def marks(self, marks: str) -> bytes:
        """The ids of a run of marks, which is one pre-token."""
        if (known := self.closing.get(marks)) is None:
            if len(self.closing) > WORD_MEMORY:
                self.closing = {"": b""}
            known = self.encoded([marks])[0]
            if len(marks) <= LONGEST:
                self.closing[marks] = known
        return known

    def run(self, run: str) -> bytes:
        """The ids of lower-case letters up to U+00FF."""
        if (known := self.letters.get(run)) is None:
            known = self.older.get(run)
            if known is None:
                byte_text = run if run.isascii() else run.encode().decode("latin-1").translate(self.bytes)
                known = array("I", [t.id for t in self.model.tokenize(byte_text)]).tobytes()
            if len(run) <= LONGEST:
                self.letters[run] = known
        return known

    def __missing__(self, c: str) -> bytes:
        if len(self) > WORD_MEMORY:  # letters still in use come back from the older generation
            self.older, self.letters = self.letters, {"": b""}
            self.clear()
        bare = c.rstrip(MARKS)
        if not bare or bare.isalpha() and (bare.isascii() or max(bare) <= "ÿ"):
            known = self.run(bare.lower())
            if len(bare) < len(c):
                known += self.marks(c[len(bare) :])
        else:
            known = self.encoded([c])[0]
        if len(c) <= LONGEST:
            self[c] = known
        return known

    def of(self, text: str) -> bytes:
        """The ids of a text."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def tokens_of(path: str) -> Tokens:
    """One memory for all tasks of a Python worker."""
    from tokenizers import Tokenizer

    return Tokens(Tokenizer.from_file(path))


def _cut(path: str, length: int, with_ids: bool):
    def cut(batches):
        tokens = tokens_of(path)
        for batch in batches:
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(doc_ids, texts):
                ids = tokens.of(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        if name != "ids" or with_ids:
                            out[name].append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)][: 5 + with_ids], names=list(out)[: 5 + with_ids])

    return cut


class Unpacked:
    """Pieces still to pack, by length."""

    def __init__(self, lengths: np.ndarray, longest: int):
        order = np.argsort(lengths, kind="stable")
        at = np.searchsorted(lengths[order], np.arange(longest + 2))
        self.by = [list(order[at[n] : at[n + 1]][::-1]) for n in range(longest + 1)]
        self.sizes = [n for n in range(longest + 1) if self.by[n]]

    def fitting(self, room: int) -> int:
        """The greatest length present of at most `room`, 0 if there is none."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, n: int) -> int:
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.sizes[bisect_right(self.sizes, n) - 1]
        return piece

    def put(self, n: int, piece: int) -> None:
        if not self.by[n]:
            self.sizes.insert(bisect_right(self.sizes, n), n)
        self.by[n].append(piece)

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Lengths of two pieces that fill `room` best, if together above `more_than`; the longer first."""
        lo, hi, best, pair = 0, bisect_right(self.sizes, room) - 1, more_than, None
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room or (lo == hi and len(self.by[a]) < 2):
                hi -= 1
                continue
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == room:
                    break
            lo += 1
        return pair


def best_two_fit(lengths: np.ndarray, room: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Lengths lie between 1 and `room`."""
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left, s = Unpacked(lengths, room), 0
    while left.sizes:
        inside, gap = [], room
        while n := left.fitting(gap):
            inside.append((n, left.take(n)))
            gap -= n
        if gap:  # the smallest went in last
            n, piece = inside[-1]
            if pair := left.two(gap + n, n):
                inside[-1:] = [(m, left.take(m)) for m in pair]
                left.put(n, piece)
        at = 0
        for n, piece in inside:
            sequence[piece], offset[piece] = s, at
            at += n
        s += 1
    return sequence, offset


def _pack(length: int):
    def pack(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence, offset = best_two_fit(bucket["length"].to_numpy(), length)
        return bucket.assign(sequence_id=sequence + bucket["bucket"].astype("int64") * 2**32, offset=offset).drop(columns="bucket")

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: its place in its document and in its sequence, and with `with_ids` its ids as bytes."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), no_text(text).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    schema = SCHEMA + (", ids binary" if with_ids else "")
    pieces = chosen.mapInArrow(_cut(tokenizer, length, with_ids), schema)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandas(_pack(length), schema + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
