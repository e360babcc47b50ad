"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning runs in parallel shards of a labelled sample of a stated size; after
every round the shards' per-coordinate states are averaged and sent out again.
L1 leaves few weights, so the model is a short sorted list of 64-bit features
that every task gets. Scores read whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import ALNUM, SMALL_BATCH, Scratch, WordHashes, mixed, prepare, release, text_of
from tablekit.llm.quality import labelled_sample

BIAS = np.uint64(1)
# Words a task remembers, and places of the table that finds features too rare to learn.
MEMO, RARE = 1 << 16, 1 << 22
# Where the range of features is cut to count them part by part.
SLICES = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
STEMS = re.compile(rb"^(?:[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]+){4}")


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner. Features in fewer than ``least_rows`` rows of a shard, or in more than
    ``most_share`` of them, are not learnt."""

    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    rounds: int = 2
    passes: int = 2
    shard_rows: int = 5000
    least_rows: int = 3
    most_share: float = 0.5
    sample_rows: int = 20_000


class Features:
    """Hashes of words, word stems, word pairs and pairs that skip one or two words."""

    def __init__(self):
        self.words, self.stems = WordHashes(MEMO), {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(ALNUM).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self.words(words)
        parts = [h, self._stems(words)]
        for gap in (1, 2, 3):
            if len(h) > gap:
                # Pairs that skip as many words are one kind of feature, whatever they skip.
                parts.append(mixed(h[:-gap] * np.uint64(3) + mixed(h[gap:]) + np.uint64(min(gap, 2))))
        return np.concatenate(parts)

    def _stems(self, words: list[bytes]) -> np.ndarray:
        known = self.stems
        if len(known) > MEMO:
            known.clear()
        for w in set(words).difference(known):
            head = STEMS.match(w)
            known[w] = head[0] + b"-" if head else w + b"-"
        return self.words([known[w] for w in words])


@dataclass(frozen=True)
class Weights:
    """Sorted features and their weights; ``bias`` is added once."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def filter(self) -> np.ndarray:
        """Which values of the low 20 bits any feature has: most words of a text end here."""
        hit = np.zeros(1 << 20, dtype=bool)
        hit[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return hit

    def score(self, found: np.ndarray, hit: np.ndarray) -> float:
        """Chance of label 1 of a text with these features, each counted once."""
        total = self.bias
        if len(self.features) and len(found):
            near = np.unique(found[hit[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.features, near), len(self.features) - 1)
            total += float(self.weights[at[self.features[at] == near]].sum())
        return float(1.0 / (1.0 + np.exp(-min(max(total, -500.0), 500.0))))


def weight(z: np.ndarray, n: np.ndarray, how: Ftrl) -> np.ndarray:
    """Weights of FTRL-proximal states: zero unless ``z`` is beyond L1."""
    w = -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
    return np.where(np.abs(z) > how.l1, w, 0.0)


def learn(rows: list[np.ndarray], y: np.ndarray, z: np.ndarray, n: np.ndarray, how: Ftrl) -> None:
    """Pass over ``rows`` (places of each row's features) and change the states ``z`` and ``n``."""
    for _ in range(how.passes):
        for at, label in zip(rows, y):
            w = weight(z[at], n[at], how)
            g = 1.0 / (1.0 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    how: Ftrl = Ftrl(),
) -> Weights:
    """Weights learnt from about ``how.sample_rows`` labelled documents, chosen by a hash of the key.

    Null keys and labels are left out, a key with several labels has the
    largest; every row that repeats a labelled key is learnt from. A null or
    empty text has the bias alone. Without labelled rows there are no weights.
    """
    scratch = Scratch(prepare(docs.sparkSession, SMALL_BATCH))
    chosen = labelled_sample(labels, key, label, how.sample_rows)
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text")).join(
        # Bounded by sample_rows, so it may be sent to every task.
        F.broadcast(chosen), F.col("key") == F.col("labelled_key")
    )
    shards = max(1, round(min(how.sample_rows, chosen.count()) / how.shard_rows))
    shard = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int").alias("shard")

    turn = F.xxhash64("key", "text", F.lit(9)).alias("turn")

    def hashed(table: pa.Table) -> pa.Table:
        # The texts of a shard are gathered, not their features, of which nearly all are too rare to learn.
        used, places = common_features(table.column("text"), how.least_rows, max(how.least_rows, how.most_share * len(table)))
        # A shard's features are sent once, in a row without a label; texts have places among them.
        first = {"shard": table.column("shard")[0].as_py(), "turn": 0, "label": None}
        columns = {n: pa.chunked_array([pa.array([v], table.column(n).type), *table.column(n).chunks]) for n, v in first.items()}
        columns["features"] = pa.array([used.tobytes(), *(p.tobytes() for p in places)], pa.binary())
        table = pa.table(columns)
        del used, places, columns
        release()
        return in_parts(table, 256)

    found = rows.select(shard, turn, "label", "text").groupBy("shard").applyInArrow(
        hashed, "shard int, turn bigint, label int, features binary"
    )
    sample = scratch.store(found, "sample")
    state: tuple[np.ndarray, ...] = tuple(np.zeros(0, dtype=t) for t in (np.uint64, float, float))
    for _ in range(how.rounds):
        state = _round(sample, state, how)
    scratch.drop("sample")
    features, z, n = state
    w = weight(z, n, how)
    own = features == BIAS
    keep = (w != 0) & ~own
    return Weights(features[keep], w[keep], float(w[own].sum()))


def common_features(texts: Iterable[pa.Scalar], least: int, most: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted features that at least ``least`` and at most ``most`` of the texts have, with the bias, and their places in each text.

    The texts are read twice: a table of counts by the features' low bits drops
    nearly all rare ones at the second reading, so they never lie side by side.
    The others are counted by slices of their range.
    """
    low, read = np.uint64(RARE - 1), Features()
    table = np.zeros(RARE, dtype=np.uint8)
    for t in texts:
        at = np.unique((read(t.as_py()) & low).astype(np.int64))
        table[at] += table[at] < least
    kept = []
    for t in texts:
        found = read(t.as_py())
        kept.append(np.unique(found[table[(found & low).astype(np.int64)] >= least]))
    del read, table
    used = [BIAS.reshape(1)]
    for parts in zip(*(np.split(found, np.searchsorted(found, SLICES)) for found in kept)):
        every, counts = np.unique(np.concatenate(parts), return_counts=True)
        used.append(every[(counts >= least) & (counts <= most)])
    used = np.unique(np.concatenate(used))
    for i, found in enumerate(kept):
        kept[i] = _places(found, used).astype(np.int32)
    return used, kept


def in_parts(table: pa.Table, rows: int) -> pa.Table:
    """The same table in batches of at most ``rows`` rows, which go to the JVM one by one."""
    return pa.Table.from_batches(table.to_batches(rows), table.schema)


def _round(sample: DataFrame, state: tuple[np.ndarray, ...], how: Ftrl) -> tuple[np.ndarray, ...]:
    """All shards learn from ``state``; the mean of their states is the next one."""
    known, known_z, known_n = state

    def run(table: pa.Table) -> pa.Table:
        # Views of the table's own bytes.
        found = [v.as_buffer() for v in table.column("features")]
        labels = table.column("label").to_numpy()
        used = np.frombuffer(found[int(np.flatnonzero(np.isnan(labels))[0])], dtype=np.uint64)
        order = np.argsort(table.column("turn").to_numpy(), kind="stable")
        order = order[~np.isnan(labels[order])]
        y = labels[order].astype(float)
        bias = np.searchsorted(used, BIAS).astype(np.int32)
        rows = [np.append(np.frombuffer(found[i], dtype=np.int32), bias) for i in order]
        z, n = np.zeros(len(used)), np.zeros(len(used))
        if len(known):
            at = np.minimum(np.searchsorted(known, used), len(known) - 1)
            same = known[at] == used
            z[same], n[same] = known_z[at[same]], known_n[at[same]]
        learn(rows, y, z, n, how)
        del found, rows
        release()
        return in_parts(pa.table({"feature": used.view(np.int64), "z": z, "n": n}), 1 << 16)

    # States with a weight, and the bias: what L1 holds at zero starts anew.
    means = (
        sample.groupBy("shard")
        .applyInArrow(run, "feature bigint, z double, n double")
        .groupBy("feature")
        .agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
        .where((F.abs("z") > how.l1) | (F.col("feature") == int(BIAS)))
        .toArrow()
    )
    features = means.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(features)
    return features[order], means.column("z").to_numpy()[order], means.column("n").to_numpy()[order]


def _places(found: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Places in the sorted ``used`` of those of ``found`` that are in it."""
    at = np.minimum(np.searchsorted(used, found), len(used) - 1)
    return at[used[at] == found]


def toxicity(model: Weights, text: str = "text") -> Column:
    """The chance of label 1 of a text column; a null text scores as an empty one."""
    hit = model.filter()

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Features()
        for batch in batches:
            yield pa.array([model.score(read(t.as_py()), hit) for t in batch], pa.float64())
        del read
        release()

    return score(text_of(text).cast("binary"))


def score_toxicity(docs: DataFrame, model: Weights, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """Key, ``score`` and ``predicted`` (1 from ``least`` on) of every row.

    Only the text counts. A null or empty text has the bias alone; null keys and
    repeated rows are rows like others; an empty table gives no rows.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    rows = docs.select(F.col(key).alias(key), text_of(text).alias("text"))
    scored = rows.select(key, toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def drop_toxic(docs: DataFrame, model: Weights, text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns."""
    prepare(docs.sparkSession, SMALL_BATCH)
    return docs.where(toxicity(model, text) < least)
