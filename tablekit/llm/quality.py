"""Quality verdicts by gradient-boosted trees over document statistics.

Trees grow level by level on histograms, with monotonic constraints on chosen
statistics, and are flattened into numpy node arrays: a batch of documents goes
down all trees at once. The fit sees a sample of labelled rows of a stated size;
statistics and verdicts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import WordHashes, prepare, shingles, text_of

# The symbols that are counted, and the blanks between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LENGTH_OF = np.zeros(256, dtype=np.uint8)
LENGTH_OF[:128] = LENGTH_OF[192:] = 1  # bytes that begin a character
IS_BLANK = np.isin(np.arange(256), [ord(c) for c in BLANKS])
IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
IS_UPPER = np.isin(np.arange(256), range(65, 91))
IS_DIGIT = np.isin(np.arange(256), range(48, 58))
IS_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
IS_BANG = np.isin(np.arange(256), [ord(c) for c in "!?"])

# Counts that are reported, and ratios the trees look at; the sign says which way
# the chance of good quality may move as the ratio grows (0: either way).
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = {
    "log_words": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 0,
    "top_word_share": 0,
    "upper_per_char": 0,
    "digits_per_char": -1,
    "stops_per_word": 0,
    "bangs_per_word": -1,
    "words_per_line": 0,
}


def statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``RATIOS`` of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    raw = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = int((raw * LENGTH_OF).sum() - raw[IS_BLANK].sum())
    symbols = int(raw[IS_SYMBOL].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    ids = hashes(words)
    repeated = 0
    if n >= 3:
        _, inverse, counts = np.unique(shingles(ids, 3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : i + n - 2] |= twice
        repeated = int(covered.sum())
    kinds = np.unique(ids, return_counts=True)[1]
    ratios = [
        float(np.log2(n)),
        chars / n,
        symbols / n,
        dup_lines / len(lines),
        repeated / n,
        len(kinds) / n,
        float(kinds.max()) / n,
        float(raw[IS_UPPER].sum()) / chars,
        float(raw[IS_DIGIT].sum()) / chars,
        float(raw[IS_STOP].sum()) / n,
        float(raw[IS_BANG].sum()) / n,
        n / len(lines),
    ]
    return [n, chars, symbols, dup_lines, repeated], ratios


@dataclass(frozen=True)
class Boosting:
    """How the trees are grown."""

    trees: int = 40
    depth: int = 3
    bins: int = 64
    rate: float = 0.2
    penalty: float = 1.0
    least_rows: int = 5


@dataclass(frozen=True)
class Trees:
    """All trees as arrays: inner node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray  # rows with a larger value go right
    value: np.ndarray  # trees x 2^depth
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, how: Boosting = Boosting()) -> Trees:
    """Fit logistic loss. With no rows, or one label alone, the trees hold the base rate."""
    inner, leaves, features = 2**how.depth - 1, 2**how.depth, x.shape[1]
    rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    feature = np.zeros((how.trees, inner), dtype=np.int64)
    threshold = np.full((how.trees, inner), np.inf)
    value = np.zeros((how.trees, leaves))
    if len(y) and 0 < y.sum() < len(y):
        quantiles = np.linspace(0, 1, how.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(features)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for t in range(how.trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            node, leaf = _one_tree(binned, p - y, p * (1 - p), edges, signs, how, feature[t], threshold[t])
            value[t] = leaf * how.rate
            margin += value[t][node - inner]
    return Trees(feature, threshold, value, base)


def _one_tree(binned, gradient, hessian, edges, signs, how, feature, threshold):
    inner, bins = len(feature), how.bins + 1
    node = np.zeros(len(gradient), dtype=np.int64)
    low, high = {0: -np.inf}, {0: np.inf}
    for level in range(how.depth):
        first, width = 2**level - 1, 2**level
        local = node - first
        best = {}
        for f, cuts in enumerate(edges):
            slot = local * bins + binned[:, f]
            sums = [np.bincount(slot, w, minlength=width * bins).reshape(width, bins) for w in (gradient, hessian, None)]
            left_g, left_h, left_n = (np.cumsum(s, axis=1)[:, : len(cuts)] for s in sums)
            for k in range(width):
                i = first + k
                if not len(cuts) or i not in low:
                    continue
                g, h, n = sums[0][k].sum(), sums[1][k].sum(), sums[2][k].sum()
                lg, lh, ln = left_g[k], left_h[k], left_n[k]
                left = np.clip(-lg / (lh + how.penalty), low[i], high[i])
                right = np.clip(-(g - lg) / (h - lh + how.penalty), low[i], high[i])
                gain = -(lg * left + 0.5 * (lh + how.penalty) * left**2) - (
                    (g - lg) * right + 0.5 * (h - lh + how.penalty) * right**2
                )
                allowed = (ln >= how.least_rows) & (n - ln >= how.least_rows) & (signs[f] * (right - left) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                at = int(np.argmax(gain))
                whole = np.clip(-g / (h + how.penalty), low[i], high[i])
                rest = -(g * whole + 0.5 * (h + how.penalty) * whole**2)
                if gain[at] > rest + 1e-9 and gain[at] > best.get(i, (-np.inf,))[0]:
                    best[i] = (gain[at], f, cuts[at], left[at], right[at], at)
        go_right = np.zeros(len(node), dtype=bool)
        for k in range(width):
            i = first + k
            if i not in low:
                continue
            a, b = 2 * i + 1, 2 * i + 2
            low[a], high[a], low[b], high[b] = low[i], high[i], low[i], high[i]
            if i in best:
                _, f, cut, left, right, at = best[i]
                feature[i], threshold[i] = f, cut
                own = node == i
                go_right[own] = binned[own, f] > at
                if signs[f]:
                    middle = (left + right) / 2
                    if signs[f] > 0:
                        high[a], low[b] = middle, middle
                    else:
                        low[a], high[b] = middle, middle
        node = 2 * node + 1 + go_right
    g = np.bincount(node - inner, gradient, minlength=inner + 1)
    h = np.bincount(node - inner, hessian, minlength=inner + 1)
    bounds = np.array([[low[inner + k], high[inner + k]] for k in range(inner + 1)])
    return node, np.clip(-g / (h + how.penalty), bounds[:, 0], bounds[:, 1])


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``COUNTS`` and an array ``ratios`` for every row; a null or blank text has 0 everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            both = [statistics(t.as_py(), hashes) for t in batch.column(1)]
            counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array([r for _, r in both], pa.list_(pa.float64()))],
                names=["key", *COUNTS, "ratios"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, ratios array<double>"
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled keys, chosen by a hash of the key; all of them where there are fewer.

    Null keys and labels are left out, a key with several labels has the larger.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    share = min(1.0, rows / max(1, known.count()))
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    return (
        known.where(spot < F.lit(int(share * (1 << 20))))
        .groupBy(F.col(key).alias("labelled_key"))
        .agg(F.max(label).cast("int").alias("label"))
    )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 20_000,
    how: Boosting = Boosting(),
) -> Trees:
    """Trees fitted to about ``sample_rows`` labelled documents; their ratios are all that is collected."""
    chosen = labelled_sample(labels, key, label, sample_rows)
    # Bounded by sample_rows, so it may be sent to every task.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("key") == F.col("labelled_key")
    )
    marked = with_statistics(rows.select(F.struct("key", "label").alias("key"), "text"), "key", "text")
    got = marked.select(F.col("key.key"), F.col("key.label"), "ratios").orderBy("key", "ratios").collect()
    x = np.array([r["ratios"] for r in got], dtype=float).reshape(-1, len(RATIOS))
    y = np.array([r["label"] for r in got], dtype=float)
    return grow(x, y, np.array(list(RATIOS.values())), how)


def judge(
    docs: DataFrame,
    trees: Trees,
    key: str = "doc_id",
    text: str = "text",
    base_failed: Column | None = None,
    least: float = 0.5,
) -> DataFrame:
    """``COUNTS``, ``base_failed``, ``score`` (chance of good quality) and ``kept`` for every row.

    Kept are rows that the base rule does not fail and whose score is at least
    ``least``. A null or blank text has 0 words, which the base rule fails. Null
    keys and repeated rows are rows like others; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    if base_failed is None:
        base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            both = [statistics(t.as_py(), hashes) for t in batch.column(1)]
            counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
            score = trees.probability(np.array([r for _, r in both]).reshape(-1, len(RATIOS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(score)],
                names=["key", *COUNTS, "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    scored = rows.mapInArrow(run, f"key {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, score double")
    return scored.select(
        F.col("key").alias(key), *COUNTS, base_failed.alias("base_failed"), "score", (~base_failed & (F.col("score") >= least)).alias("kept")
    )
