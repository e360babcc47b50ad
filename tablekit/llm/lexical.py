"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

A shard holds the postings of a bounded run of documents. A posting list is cut
into blocks of delta-coded bytes, and every block carries its last place and its
largest impact. A search reads the lists of the query terms alone, shard by
shard, and keeps one heap per query over all shards of a task; heaps meet in a
last ranking. Lists whose largest impacts together cannot reach the heap are not
essential: their blocks are unpacked only for candidates that block maxima
leave in reach. Scores are whole numbers and equal those of a full evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm.base import ALNUM, Scratch, prepare, text_of, texts

# Fixed values of the ranking.
LENGTH_PERCENT = 50
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A shard ends at so many terms (with repeats) or documents; one longer document is a shard of its own.
SHARD_TERMS, SHARD_DOCS = 2_000_000, 1 << 15
BLOCK = 128
# Queries go through the index in blocks of at most so many items and terms, which bounds what tasks get.
QUERY_ITEMS, QUERY_TERMS = 2_000, 100_000
INDEX = (
    "shard bigint, term string, df bigint, last array<int>, top array<int>, size array<int>, postings binary, "
    "keys binary, unknown binary, lengths binary"
)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and terms with repeats of all of them."""

    documents: int
    terms: int


@dataclass(frozen=True)
class Index:
    """One row per shard and term, and per shard one row without a term that holds its documents."""

    rows: DataFrame
    corpus: Corpus


class Numbers(dict):
    """Words to numbers, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def damped(lengths: np.ndarray, corpus: Corpus) -> np.ndarray:
    return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * corpus.documents) // max(corpus.terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def term_weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each and the high bit set but on the last, and how many each took."""
    width = np.ones(len(values), dtype=np.int64)
    for i in range(1, 10):
        width += values >> np.int64(7 * i) > 0
    ends = np.cumsum(width)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width, width)
    low = (np.repeat(values, width) >> (7 * at)) & 127
    return (low | np.where(at < np.repeat(width, width) - 1, 128, 0)).astype(np.uint8), width


def unpack(data: np.ndarray) -> np.ndarray:
    """The whole numbers that ``pack`` wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def count_corpus(docs: DataFrame, text: str = "text") -> Corpus:
    n = F.regexp_count(text_of(text), F.lit(TERM))
    got = docs.agg(F.count_if(n > 0), F.coalesce(F.sum(n.cast("bigint")), F.lit(0))).first()
    return Corpus(*got)


def build_index(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all whole texts, stored; keys are whole numbers or null."""
    corpus = count_corpus(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shards = TaskContext.get().partitionId(), 0
        keys, counts, found, words, held = [], [], [], Numbers(), 0

        def shard() -> pa.RecordBatch:
            return _shard_rows((task << 32) + shards, keys, counts, found, words, corpus)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), texts(batch)):
                terms = value.translate(ALNUM).split()
                if keys and (held + len(terms) > SHARD_TERMS or len(keys) >= SHARD_DOCS):
                    yield shard()
                    shards += 1
                    keys, counts, found, words, held = [], [], [], Numbers(), 0
                if terms:
                    keys.append(k)
                    counts.append(len(terms))
                    found.append(np.fromiter(map(words.__getitem__, terms), dtype=np.int32, count=len(terms)))
                    held += len(terms)
        if keys:
            yield shard()

    read = docs.select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    return Index(scratch.store(read.mapInArrow(run, INDEX), "index"), corpus)


def _shard_rows(shard: int, keys: list, counts: list, found: list, words: Numbers, corpus: Corpus) -> pa.RecordBatch:
    lengths = np.array(counts, dtype=np.int64)
    # Sorted by term, then place: equal neighbours are repeats of a term in a document.
    both = np.concatenate(found).astype(np.int64) << 32 | np.repeat(np.arange(len(keys)), lengths)
    both.sort()
    both, tf = np.unique(both, return_counts=True)
    term, place = both >> 32, both & 0xFFFFFFFF
    starts = np.searchsorted(term, np.arange(len(words) + 1))
    inside = np.arange(len(term)) - np.repeat(starts[:-1], np.diff(starts))
    opens = np.flatnonzero(inside % BLOCK == 0)
    delta = place.copy()
    delta[1:] -= np.where(inside[1:] % BLOCK > 0, place[:-1], 0)
    data, width = pack(np.stack([delta, tf], axis=1).ravel())
    ends = np.cumsum(width)[1::2]
    closes = np.append(opens[1:], len(term)) - 1
    block_ends = ends[closes]
    sizes = np.diff(block_ends, prepend=0)
    top = np.maximum.reduceat(impact(tf, damped(lengths[place], corpus)), opens)
    first_block = np.searchsorted(opens, starts)
    term_ends = np.concatenate([[0], ends])[starts]

    def per_block(values: np.ndarray) -> pa.Array:
        # The row without a term has no blocks.
        return pa.ListArray.from_arrays(np.append(first_block, first_block[-1]).astype(np.int32), pa.array(values.astype(np.int32)))

    n = len(words)
    own = lambda value: pa.array([None] * n + [value], pa.binary())
    unknown = np.array([k is None for k in keys])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, shard, dtype=np.int64)),
            pa.array([*words, None], pa.binary()).cast(pa.string()),
            pa.array([*np.diff(starts).tolist(), None], pa.int64()),
            per_block(place[closes]),
            per_block(top),
            per_block(sizes),
            pa.Array.from_buffers(
                pa.binary(), n + 1, [None, pa.py_buffer(np.append(term_ends, term_ends[-1]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
            ),
            own(np.array([0 if k is None else k for k in keys], dtype=np.int64).tobytes()),
            own(unknown.astype(np.uint8).tobytes()),
            own(lengths.tobytes()),
        ],
        names=["shard", "term", "df", "last", "top", "size", "postings", "keys", "unknown", "lengths"],
    )


class Postings:
    """The list of one term in one shard; blocks are unpacked when first looked at."""

    def __init__(self, weight: int, last: np.ndarray, top: np.ndarray, size: np.ndarray, data: np.ndarray, m: np.ndarray):
        self.last, self.top, self.data, self.m, self.weight = last, top.astype(np.int64) * weight, data, m, weight
        self.ends = np.cumsum(size)
        self.bound = int(self.top.max())
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weighted impacts of block ``i``."""
        if i not in self.blocks:
            values = unpack(self.data[self.ends[i - 1] if i else 0 : self.ends[i]]).reshape(-1, 2)
            place = np.cumsum(values[:, 0])
            self.blocks[i] = place, self.weight * impact(values[:, 1], self.m[place])
        return self.blocks[i]

    def every(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in range(len(self.ends))]
        return parts[0] if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts]))

    def reach(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each place, and that block's largest value; 0 beyond the last block."""
        at = np.searchsorted(self.last, places)
        return at, np.append(self.top, 0)[at]

    def add(self, places: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Add to ``score`` the values at ``places``, which lie in the blocks ``at``."""
        for i in np.unique(at[at < len(self.ends)]):
            here = np.flatnonzero(at == i)
            place, value = self.block(int(i))
            found = np.minimum(np.searchsorted(place, places[here]), len(place) - 1)
            hit = place[found] == places[here]
            score[here[hit]] += value[found[hit]]


class Heap:
    """The best rows of one query so far, equal scores by key, null keys last."""

    def __init__(self, size: int):
        self.size = size
        self.score, self.key, self.unknown = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a row must reach; with the same score its key decides."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.size else 1

    def push(self, score: np.ndarray, key: np.ndarray, unknown: np.ndarray) -> None:
        score, key, unknown = (np.concatenate(x) for x in ((self.score, score), (self.key, key), (self.unknown, unknown)))
        best = np.lexsort((key, unknown, -score))[: self.size]
        self.score, self.key, self.unknown = score[best], key[best], unknown[best]


def best_of_shard(lists: list[Postings], heap: Heap, keys: np.ndarray, unknown: np.ndarray) -> None:
    """Put into ``heap`` what the documents of one shard with these lists bring."""
    lists = sorted(lists, key=lambda p: p.bound)
    least = heap.least()
    # The longest run of lists from the weakest on that cannot reach the heap together.
    bounds = np.cumsum([p.bound for p in lists])
    weak = int(np.searchsorted(bounds, least, side="left"))
    if weak == len(lists):
        return
    total = np.zeros(len(keys), dtype=np.int64)
    for p in lists[weak:]:
        place, value = p.every()
        total[place] += value
    places = np.flatnonzero(total)
    score = total[places]
    reaches = [p.reach(places) for p in lists[:weak]]
    rest = sum((top for _, top in reaches), np.zeros(len(places), dtype=np.int64))
    for i in range(weak - 1, -1, -1):
        alive = score + rest >= least
        if not alive.all():
            places, score, rest = places[alive], score[alive], rest[alive]
            reaches = [(at[alive], top[alive]) for at, top in reaches[: i + 1]]
        if not len(places):
            return
        at, top = reaches[i]
        rest = rest - top
        lists[i].add(places, at, score)
    enough = score >= least
    heap.push(score[enough], keys[places[enough]], unknown[places[enough]])


def search(index: Index, queries: DataFrame, scratch: Scratch, key: str = "item_id", text: str = "text", best: int = 50) -> DataFrame:
    """``item``, ``rank``, ``doc_id`` and ``score``: the best rows of the index for every query.

    The queries are a stated set: they go through the index in blocks, so what
    a task gets of them is bounded. Every row is a query of its own.
    """
    spark = queries.sparkSession
    kind = queries.schema[key].dataType.simpleString()
    terms = F.array_distinct(F.regexp_extract_all(F.translate(text_of(text), _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0)))
    asked = scratch.store(queries.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("item"), terms.alias("terms")), "queries")
    named = asked.where(F.size("terms") > 0).select("row", "terms")
    found = None
    for k, block in enumerate(_blocks(named.toLocalIterator())):
        heaps = scratch.store(_search_block(index, block, best), f"heaps-{k}")
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return spark.createDataFrame([], f"item {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(asked.select("row", "item"), "row").select("item", "rank", "doc_id", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _blocks(rows: Iterator) -> Iterator[list[tuple[int, list[str]]]]:
    block, held = [], 0
    for row in rows:
        if block and (len(block) >= QUERY_ITEMS or held + len(row["terms"]) > QUERY_TERMS):
            yield block
            block, held = [], 0
        block.append((row["row"], list(row["terms"])))
        held += len(row["terms"])
    if block:
        yield block


def _search_block(index: Index, block: list[tuple[int, list[str]]], best: int) -> DataFrame:
    spark, corpus = index.rows.sparkSession, index.corpus
    wanted = spark.createDataFrame([(t,) for t in sorted({t for _, ts in block for t in ts})], "wanted string")
    # Bounded by QUERY_TERMS, so they may go to every task.
    lists = index.rows.join(F.broadcast(wanted), F.col("term") == F.col("wanted"), "left_semi")
    weights = {r["term"]: term_weight(corpus.documents, r["df"]) for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    asked = [(row, [t for t in ts if weights.get(t, 0) > 0]) for row, ts in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {row: Heap(best) for row, _ in asked}
        for rows in _shards(batches):
            head = next(r for r in rows if r["term"] is None)
            keys = np.frombuffer(head["keys"], dtype=np.int64)
            unknown = np.frombuffer(head["unknown"], dtype=np.uint8).astype(bool)
            m = damped(np.frombuffer(head["lengths"], dtype=np.int64), corpus)
            here = {
                r["term"]: Postings(weights[r["term"]], *(np.array(r[c]) for c in ("last", "top", "size")), np.frombuffer(r["postings"], dtype=np.uint8), m)
                for r in rows
                if weights.get(r["term"], 0) > 0
            }
            for row, ts in asked:
                if own := [here[t] for t in ts if t in here]:
                    best_of_shard(own, heaps[row], keys, unknown)
        for row, heap in heaps.items():
            if n := len(heap.score):
                doc = pa.array(heap.key, pa.int64(), mask=heap.unknown)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), doc, pa.array(heap.score)], names=["row", "doc_id", "score"])

    every = lists.unionByName(index.rows.where(F.col("term").isNull()))
    # A shard is bounded, and all of it meets in one task; a task goes through its shards one after another.
    dealt = every.repartition("shard").sortWithinPartitions("shard", "term")
    return dealt.mapInArrow(run, "row bigint, doc_id bigint, score bigint")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one shard after another."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[-1]["shard"] != row["shard"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def rank_documents(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = 50
) -> DataFrame:
    """The ``best`` documents of every query row: the item's key, ``rank``, ``doc_id`` and ``score``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. A null, empty or blank text has none: as a document it is not
    counted, as a query it has no results. Equal scores go by ascending key,
    null keys last; repeated rows are documents, or queries, of their own. An
    empty table of either kind gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    index = build_index(docs, scratch, key, text)
    found = search(index, queries, scratch, item, item_text, best)
    if "index" in scratch.folders:
        scratch.drop("index")
    return found.select(F.col("item").alias(item), "rank", "doc_id", "score")
