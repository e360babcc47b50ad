"""Quality by supervised subword embeddings.

Words, word pairs and the character n-grams of words are hashed to buckets, each
with a learned vector. A document is the mean of its features' vectors, and a
softmax over labels reads it. Learning is stochastic gradient descent in numpy,
in parallel shards of a labelled sample of a stated size, whose models are
averaged after every round. Scores read whole texts: the output layer is folded
into the vectors first, so a feature costs one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import Scratch, prepare, text_of
from tablekit.llm.quality import labelled_sample

# Texts are read in pieces of about so many bytes, cut at blanks, so that a long one needs no more memory.
PIECE = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")
STEP, PAIR = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
# What tells the kinds of features apart: words, pairs, pairs of one word whatever it is, the end of a text.
WORD, TWO, SAME, END = (np.uint32(k) for k in (101, 102, 103, 104))


@dataclass(frozen=True)
class Subwords:
    """Settings of the features and the learner. A round is one pass over each shard of ``shard_rows`` texts."""

    bits: int = 16  # of a bucket's number
    size: int = 8
    shortest: int = 2
    longest: int = 4
    labels: int = 2
    rate: float = 0.5
    rounds: int = 4
    passes: int = 2
    shard_rows: int = 2_500
    sample_rows: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Embeddings:
    """Vectors of the buckets, and the output layer."""

    vectors: np.ndarray  # buckets x size
    output: np.ndarray  # labels x size
    how: Subwords

    def probabilities(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Softmax over the labels of a text with these features."""
        mean = (self.vectors[buckets] * counts[:, None]).sum(axis=0, dtype=float) / counts.sum()
        return softmax(self.output.astype(float) @ mean)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def buckets_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Scramble 32-bit values and keep the upper ``bits``."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (h >> np.uint32(32 - bits)).astype(np.intp)


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE and (blank := BLANK.search(text, at + PIECE)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


def features(text: bytes, how: Subwords) -> Iterator[np.ndarray]:
    """Buckets of the features of a text, with repeats, piece by piece.

    They are: its end; every word; every character n-gram of a word, whose ends
    count as a blank; every pair of neighbouring words, where two equal words
    share one bucket whichever word it is.
    """
    yield buckets_of(np.array([END]), how.bits)
    before = None
    for piece in pieces(text):
        codes = np.frombuffer(f" {piece.decode('utf-8', 'replace')} ".encode("utf-32-le"), dtype=np.uint32)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        once = np.append(True, ~(blank[1:] & blank[:-1]))
        blank = blank[once]
        letters = np.where(blank, np.uint32(32), codes[once])
        edges = np.flatnonzero(blank)
        if len(edges) < 2:
            continue
        parts, grams = [], letters
        for width in range(2, how.longest + 1):
            grams = grams[:-1] * STEP + letters[width - 1 :]
            if width > 2:
                # No blank inside: a gram lies in one word and its ends.
                apart = apart[:-1] & ~blank[width - 2 : -1]  # noqa: F821
            else:
                apart = np.ones(len(grams), dtype=bool)
            if width >= how.shortest:
                parts.append(grams[apart] + np.uint32(width))
        place = np.arange(len(letters)) - np.repeat(edges, np.diff(edges, append=len(letters)))
        power = np.cumprod(np.full(int(place.max()) + 1, STEP), dtype=np.uint32)
        words = np.add.reduceat((letters + np.uint32(1)) * power[place], edges, dtype=np.uint32)[:-1]
        parts.append(words + WORD)
        near = words if before is None else np.append(before, words)
        parts.append(np.where(near[:-1] == near[1:], SAME, near[:-1] * PAIR + near[1:] + TWO))
        before = words[-1]
        yield buckets_of(np.concatenate(parts), how.bits)


def counted(text: bytes, how: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each comes."""
    total = np.zeros(1 << how.bits, dtype=np.int64)
    for part in features(text, how):
        total += np.bincount(part, minlength=len(total))
    found = np.flatnonzero(total)
    return found, total[found]


class Scorer:
    """The same probabilities from folded vectors: the output layer is multiplied in once."""

    def __init__(self, model: Embeddings, label: int):
        others = np.delete(np.arange(len(model.output)), label)
        # One row for each other label: its logit less that of ``label``.
        self.folded = (model.output[others] - model.output[label]).astype(float) @ model.vectors.astype(float).T
        self.how = model.how

    def __call__(self, text: bytes) -> float:
        total, n = np.zeros(len(self.folded)), 0
        for part in features(text, self.how):
            total += [row.take(part).sum() for row in self.folded]
            n += len(part)
        return float(1.0 / (1.0 + np.exp(np.clip(total / n, -500, 500)).sum()))


def start(how: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and output layer before learning, the same everywhere."""
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1.0 / how.size, 1.0 / how.size, (1 << how.bits, how.size)).astype(np.float32)
    return vectors, np.zeros((how.labels, how.size), dtype=np.float32)


def descend(rows: list, labels: np.ndarray, vectors: np.ndarray, output: np.ndarray, how: Subwords, rate: float, last: float) -> None:
    """Pass over ``rows`` of (buckets, counts), changing both layers; the rate falls evenly to ``last``."""
    steps = max(1, how.passes * len(rows))
    for step in range(how.passes * len(rows)):
        buckets, counts = rows[step % len(rows)]
        now = rate + (last - rate) * step / steps
        share = (counts / counts.sum()).astype(np.float32)
        mine = vectors[buckets]
        mean = np.einsum("i,ij->j", share, mine)
        error = softmax(output @ mean)
        error[labels[step % len(rows)]] -= 1
        # A feature moves by its share of the text; the root keeps rare ones of long texts learning.
        vectors[buckets] = mine - now * np.sqrt(share)[:, None] * (error @ output)
        output -= now * np.outer(error, mean)


def fit_embeddings(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    how: Subwords = Subwords(),
) -> Embeddings:
    """Vectors learnt from about ``how.sample_rows`` labelled documents, chosen by a hash of the key.

    Labels are 0 to ``how.labels`` - 1. Null keys and labels are left out, a
    key with several labels has the largest; every row that repeats a labelled
    key is learnt from. Without labelled rows every label is equally likely.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    chosen = labelled_sample(labels, key, label, how.sample_rows)
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text")).join(
        # Bounded by sample_rows, so it may be sent to every task.
        F.broadcast(chosen), F.col("key") == F.col("labelled_key")
    )
    shards = max(1, round(min(how.sample_rows, chosen.count()) / how.shard_rows))
    shard = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int").alias("shard")
    turn = F.xxhash64("key", "text", F.lit(9)).alias("turn")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t.as_py(), how) for t in batch.column(3)]
            lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["shard", "turn", "label", "buckets", "counts"])
        pa.default_memory_pool().release_unused()

    # Texts are read once; what the rounds read again are buckets and counts.
    found = rows.select(shard, turn, "label", "text").mapInArrow(
        hashed, "shard int, turn bigint, label int, buckets array<int>, counts array<int>"
    )
    sample = scratch.store(found, "sample")
    vectors, output = start(how)
    for k in range(how.rounds):
        vectors, output = _round(sample, vectors, output, how, how.rate * (1 - k / how.rounds), how.rate * (1 - (k + 1) / how.rounds))
    scratch.drop("sample")
    return Embeddings(vectors, output, how)


def _round(sample: DataFrame, vectors: np.ndarray, output: np.ndarray, how: Subwords, rate: float, last: float):
    """All shards descend from the same model. A bucket becomes the mean over the shards that moved it,
    the output layer the mean over all."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("turn").to_numpy(), kind="stable")
        y = table.column("label").to_numpy()[order].astype(np.int64)
        rows = list(zip(_views(table.column("buckets")), _views(table.column("counts"))))
        mine, out = vectors.copy(), output.copy()
        descend([rows[i] for i in order], y, mine, out, how, rate, last)
        moved = np.flatnonzero((mine != vectors).any(axis=1))
        # Buckets from 0 on, the rows of the output layer below 0.
        values = np.concatenate([mine[moved], out])
        pa.default_memory_pool().release_unused()
        return pa.table({"at": np.concatenate([moved, -1 - np.arange(len(out))])} | {f"v{i}": values[:, i] for i in range(how.size)})

    means = [F.avg(f"v{i}").alias(f"v{i}") for i in range(how.size)]
    schema = ", ".join(["at bigint", *(f"v{i} float" for i in range(how.size))])
    got = sample.groupBy("shard").applyInArrow(run, schema).groupBy("at").agg(*means).toArrow()
    at = got.column("at").to_numpy()
    values = np.stack([got.column(f"v{i}").to_numpy() for i in range(how.size)], axis=1).astype(np.float32)
    vectors, output = vectors.copy(), output.copy()
    vectors[at[at >= 0]] = values[at >= 0]
    output[-1 - at[at < 0]] = values[at < 0]
    return vectors, output


def _views(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists of a column as views of its own memory."""
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        for start, stop in zip(offsets[:-1], offsets[1:]):
            yield values[start:stop]


def chance(model: Embeddings, text: str = "text", label: int = 1) -> Column:
    """The chance of ``label`` of a text column; a null text scores as an empty one."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model, label)
        for batch in batches:
            yield pa.array([scorer(t.as_py()) for t in batch], pa.float64())

    return score(text_of(text).cast("binary"))


def score_quality(docs: DataFrame, model: Embeddings, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Key, ``score`` (chance of label 1) and ``predicted`` (1 from ``least`` on) of every row.

    Only the whole text counts. A null, empty or blank text has the closing
    mark as its one feature; null keys and repeated rows are rows like others;
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scored = docs.select(F.col(key).alias(key), chance(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
