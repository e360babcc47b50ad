"""Benchmark decontamination by SimHash over item-sized windows.

For every distinct length of an item, each window of that many words (a text of
fewer words as a whole) gets a 64-bit SimHash of its weighted shingles. A multi-index over four 16-bit blocks
gives all items whose fingerprint lies within ``RADIUS``: among 4 blocks one has
at most RADIUS // 4 of the differing bits, and the index lists, for every value of a
block, the items so near to it. Candidates are verified by the exact weighted
Jaccard similarity of the shingle multisets.

A window whose shingles from the benchmark weigh less than the wanted share of
its own weight cannot reach that similarity with any item, so it gets no
fingerprint. Items are taken in blocks of a stated size, so what goes to the tasks is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import ALNUM, SMALL_BATCH, WordHashes, prepare, release, shingles, text_of, tidy

WIDTH = 5
LEAST = 0.8
RADIUS = 23
BLOCK_ITEMS = 2000
BITS = np.arange(64, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII."""
    return text.decode(errors="replace").lower().encode().translate(ALNUM).split()


def weights(sizes: np.ndarray, width: int) -> np.ndarray:
    """Weight of each run of ``width`` words: the bytes in its words."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return (total[width:] - total[:-width]).astype(np.int64)


def signed(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of 64 numbers per shingle: its weight, with the sign of each bit of its hash."""
    bits = ((hashes[:, None] >> BITS) & np.uint64(1)).astype(np.int64)
    return (2 * bits - 1) * weight[:, None]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash of each row of 64 sums."""
    return ((sums > 0).astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


def similarity(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> float:
    """Weighted Jaccard of two multisets {shingle: (count, weight)}."""
    common = sum(w * min(n, b[s][0]) for s, (n, w) in a.items() if s in b)
    total = sum(w * n for n, w in a.values()) + sum(w * n for n, w in b.values()) - common
    return common / total


def multiset(hashes: np.ndarray, weight: np.ndarray) -> dict[int, tuple[int, int]]:
    counts = Counter(hashes.tolist())
    weigh = dict(zip(hashes.tolist(), weight.tolist()))
    return {s: (n, weigh[s]) for s, n in counts.items()}


class Items:
    """Fingerprints and index of a block of items whose shingles are ``width`` words long."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int, radius: int):
        read = WordHashes()
        self.width, self.radius = width, radius
        self.keys = [k for k, _ in items]
        self.lengths = np.array([len(words) for _, words in items])
        prints, self.sets, every = [], [], []
        for _, words in items:
            hashes = shingles(read(words), width)
            weight = weights(np.array([len(w) for w in words]), width)
            prints.append(fingerprints(signed(hashes, weight).sum(axis=0)[None, :])[0])
            self.sets.append(multiset(hashes, weight))
            every.append(hashes)
        self.prints = np.array(prints, dtype=np.uint64)
        self.shingles = np.unique(np.concatenate(every))
        self.first = np.zeros(1 << 20, dtype=bool)
        self.first[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # index[length][block][value]: bit set of the items of that length near to the value.
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        values = np.arange(1 << 16, dtype=np.uint16)
        for length in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == length)
            near = np.zeros((4, 1 << 16, (len(own) + 7) // 8), dtype=np.uint8)
            for block in range(4):
                part = ((self.prints[own] >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.uint16)
                for i, value in enumerate(part):
                    near[block, :, i // 8] |= (np.bitwise_count(values ^ value) <= radius // 4).astype(np.uint8) << (i % 8)
            self.index[int(length)] = own, near

    def within(self, length: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all items of ``length`` within the radius of each window's fingerprint."""
        own, near = self.index[length]
        hit = np.zeros((len(prints), near.shape[2]), dtype=np.uint8)
        for block in range(4):
            hit |= near[block, ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)]
        window, item = np.nonzero(np.unpackbits(hit, axis=1, bitorder="little")[:, : len(own)])
        item = own[item]
        exact = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return zip(window[exact].tolist(), item[exact].tolist())

    def find(self, words: list[bytes], hashed: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """The best window of every item found: its similarity and first word."""
        if len(words) < self.width:
            return {}
        hashes = shingles(hashed, self.width)
        maybe = np.flatnonzero(self.first[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
        known = maybe[self.shingles[at] == hashes[maybe]]
        if not len(known):
            return {}
        weight = weights(np.array([len(w) for w in words]), self.width)
        total = np.concatenate([[0], np.cumsum(weight)])
        own = np.zeros(len(hashes), dtype=np.int64)
        own[known] = weight[known]
        own = np.concatenate([[0], np.cumsum(own)])
        best: dict[int, tuple[float, int]] = {}
        for length in self.index:
            # A text shorter than the item is its own only window.
            span = min(length - self.width + 1, len(hashes))
            share = (own[span:] - own[:-span]) >= least * (total[span:] - total[:-span])
            for a, b in _runs(np.flatnonzero(share)):
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed(hashes[a : b + span], weight[a : b + span]), axis=0)])
                prints = fingerprints(sums[span:] - sums[:-span])
                for window, item in self.within(length, prints):
                    start = a + window
                    score = similarity(self.sets[item], multiset(hashes[start : start + span], weight[start : start + span]))
                    if score >= least and (-score, start) < (-best.get(item, (0.0, 0))[0], best.get(item, (0.0, 0))[1]):
                        best[item] = score, start
        return best


def _runs(places: np.ndarray, longest: int = 4096) -> Iterator[tuple[int, int]]:
    """First and last place of each run of neighbours, long runs in parts."""
    if len(places):
        for run in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
            for i in range(0, len(run), longest):
                part = run[i : i + longest]
                yield int(part[0]), int(part[-1])


def blocks_of(items: DataFrame, key: str, text: str, radius: int, block_items: int) -> Iterator[list[Items]]:
    """Indexes of the items, ``block_items`` at a time; equal items once, items without words not at all."""
    rows = items.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text")).distinct()
    parts = max(1, -(-rows.count() // block_items))
    part = F.pmod(F.xxhash64("key", "text"), F.lit(parts))
    for p in range(parts):
        found: dict[int, list[tuple[object, list[bytes]]]] = {}
        for r in rows.where(part == p).orderBy("key", "text").collect():
            words = words_of(bytes(r["text"]))
            if words:
                found.setdefault(min(WIDTH, len(words)), []).append((r["key"], words))
        if found:
            yield [Items(some, width, radius) for width, some in sorted(found.items())]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least: float = LEAST,
    radius: int = RADIUS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Items that stand in texts, with a weighted similarity of at least ``least`` to a window of their length,
    or to the whole of a text that is shorter.

    Words are lower-cased runs of ASCII letters and digits and of characters beyond
    ASCII. Returns one row per row of ``docs`` and item found: both keys,
    ``similarity`` of the best window, its first word (from 0, the earliest of equals)
    and number of words. An item of fewer than five words is one shingle, so it
    must stand there whole. Null or empty texts and items match nothing; null keys and
    repeated rows are rows like others; without items the result is empty.
    """
    spark = prepare(docs.sparkSession, SMALL_BATCH)
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField(item_key, items.schema[item_key].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("window_words", T.LongType()),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in blocks_of(items, item_key, item_text, radius, block_items):
        out = out.unionByName(_found(rows, block, schema, least))
    return out


def _found(rows: DataFrame, block: list[Items], schema: T.StructType, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, read = to_arrow_schema(schema), WordHashes()
        for batch in batches:
            found = []
            for k, t in zip(batch.column(0), batch.column(1)):
                words = words_of(t.as_py())
                hashed = read(words)
                for some in block:
                    for item, (score, start) in some.find(words, hashed, least).items():
                        found.append((k.as_py(), some.keys[item], score, start, min(int(some.lengths[item]), len(words))))
            columns = list(zip(*found)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return rows.mapInArrow(tidy(run), schema)


def leaks(block: list[Items], text: str = "text", least: float = LEAST) -> Column:
    """Whether a text holds an item of a block."""

    @F.arrow_udf(T.BooleanType())
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = WordHashes()
        for batch in batches:
            out = []
            for t in batch:
                words = words_of(t.as_py())
                hashed = read(words)
                out.append(any(some.find(words, hashed, least) for some in block))
            yield pa.array(out, pa.bool_())
        del read
        release()

    return holds(text_of(text).cast("binary"))


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    least: float = LEAST,
    radius: int = RADIUS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` finds no item, with all their columns."""
    prepare(docs.sparkSession, SMALL_BATCH)
    for block in blocks_of(items, item_key, item_text, radius, block_items):
        docs = docs.where(~leaks(block, text, least))
    return docs
