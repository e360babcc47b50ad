"""Hidden Markov language model over words, trained by Baum-Welch across partitions.

Words become symbols: frequent ones have their own, all others one by their
ending. States emit symbols; a word then has its share of its symbol, from the
word counts of the training texts with one added. So a text's probability is
the exact probability of its symbols, by the scaled forward recursion, times
that of its words given their symbols.

The word counts grow with the corpus and stay a table: the most frequent words,
at most a stated number, go to every task, the rest is joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import LOWER, Scratch, prepare, text_of

END = b"\n"  # the end token; no word holds a line end


@dataclass(frozen=True)
class Settings:
    """Size of the model. ``head_words`` bounds what is sent to every task."""

    states: int = 8
    own_symbols: int = 8192
    endings: int = 1024
    head_words: int = 1 << 17
    rounds: int = 4
    prior: float = 50.0
    block_tokens: int = 400_000


@dataclass(frozen=True)
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII blanks, and the end token."""
    return [*text.translate(LOWER).split(), END]


def ending(word: bytes, settings: Settings) -> int:
    """The symbol of a word without its own: by its last three bytes."""
    return settings.own_symbols + zlib.crc32(word[-3:]) % settings.endings


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n`` over all texts, counted per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
            )

        for batch in batches:
            for t in batch.column(0):
                counts.update(words_of(t.as_py()))
            if len(counts) > 1 << 19:
                yield out()
                counts.clear()
        yield out()

    rows = docs.select(text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Symbols and counts of the frequent words, and the totals of all."""

    def __init__(self, counts: DataFrame, settings: Settings):
        spark = counts.sparkSession
        total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
        self.tokens, self.words = total["tokens"] or 0, total["words"]
        # Words by the log of their count: a few hundred rows whatever the corpus.
        step = F.floor(8 * F.log2("n")).alias("step")
        steps = counts.groupBy(step).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).orderBy(F.desc("step"))
        self.least, taken = 1 << 62, 0
        for r in steps.collect():
            taken += r["k"]
            if taken > settings.head_words:
                break
            self.least = r["low"]
        head = counts.where(F.col("n") >= self.least).orderBy(F.desc("n"), "word").collect()
        table: dict[bytes, tuple[int, int]] = {}
        for rank, r in enumerate(head):
            word = bytes(r["word"])
            # Symbol 0 is the end token's.
            own = 0 if word == END else rank + 1 if rank + 1 < settings.own_symbols else ending(word, settings)
            table[word] = own, r["n"]
        table.setdefault(END, (0, 0))
        self.symbols = settings.own_symbols + settings.endings
        symbol_counts = np.zeros(self.symbols)
        symbol_words = np.zeros(self.symbols)
        for symbol, n in table.values():
            symbol_counts[symbol] += n
            symbol_words[symbol] += 1
        for r in _ending_totals(counts.where(F.col("n") < self.least), settings).collect():
            symbol_counts[r["symbol"]] += r["n"]
            symbol_words[r["symbol"]] += r["words"]
        self.table = spark.sparkContext.broadcast(table)
        # Every ending may yet meet a new word: one is added as for the words in it.
        self.unigram = (symbol_counts + 1.0) / (symbol_counts.sum() + self.symbols)
        self.divisor = np.zeros(self.symbols)
        tail = slice(settings.own_symbols, None)
        self.divisor[tail] = np.log10(symbol_counts[tail] + symbol_words[tail] + 1)


def _ending_totals(counts: DataFrame, settings: Settings) -> DataFrame:
    """Tokens and distinct words of every ending's symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(settings.endings, dtype=np.int64), np.zeros(settings.endings, dtype=np.int64)
        for batch in batches:
            at = np.array([ending(w.as_py(), settings) for w in batch.column(0)], dtype=np.int64) - settings.own_symbols
            n += np.bincount(at, batch.column(1).to_numpy(), minlength=settings.endings).astype(np.int64)
            words += np.bincount(at, minlength=settings.endings)
        found = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"symbol": found + settings.own_symbols, "n": n[found], "words": words[found]})

    made = counts.select("word", "n").mapInArrow(run, "symbol bigint, n bigint, words bigint")
    return made.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


class Places(dict):
    """Places of words: the frequent ones first, then others as they come, with arrays of what is known at each place.

    ``renew`` forgets the others once there are more than ``most``; a batch of texts never outgrows the arrays unseen.
    """

    def __init__(self, table: dict[bytes, tuple[int, int]], settings: Settings, most: int = 1 << 16):
        super().__init__(zip(table, range(len(table))))
        self.head, self.most, self.settings, self.table = len(table), most, settings, table
        n = np.array([n for _, n in table.values()], dtype=float)
        self.symbol = np.array([s for s, _ in table.values()], dtype=np.uint16)
        self.log, self.seen, self.hash = np.log10(n + 1), n > 0, np.zeros(len(n), dtype=np.int64)
        self._grow(most)

    def _grow(self, by: int) -> None:
        self.symbol, self.log, self.seen, self.hash = (
            np.append(a, np.zeros(by, dtype=a.dtype)) for a in (self.symbol, self.log, self.seen, self.hash)
        )

    def renew(self) -> None:
        if len(self) - self.head > self.most:
            self.clear()
            self.update(zip(self.table, range(self.head)))

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.symbol):
            self._grow(self.most)
        self.symbol[at] = ending(word, self.settings)
        self.hash[at] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        self[word] = at
        return at


def encoded(docs: DataFrame, key: str, text: str, train: Column, lexicon: Lexicon, settings: Settings) -> DataFrame:
    """Texts as symbols, with sums over the frequent words and the hashes of all others.

    ``row`` tells rows apart; it is stored with the rest, so it holds for good.
    """
    table, divisor = lexicon.table, lexicon.divisor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(table.value, settings)
        for batch in batches:
            places.renew()
            symbols, tokens, sure, logs, parts, rest = [], [], [], [], [], []
            for t in batch.column(3):
                words = words_of(t.as_py())
                at = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
                seq, plus = places.symbol[at], places.log[at]
                symbols.append(seq.tobytes())
                tokens.append(len(words))
                sure.append(int(places.seen[at].sum()))
                logs.append(float(plus.sum()))
                # What words with an ending's symbol add to the score, but for the counts of the others.
                parts.append(float((plus * (seq >= settings.own_symbols) - divisor[seq]).sum()))
                rest.append(places.hash[at[at >= places.head]])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(symbols, pa.binary()),
                    pa.array(tokens, pa.int64()),
                    pa.array(sure, pa.int64()),
                    pa.array(logs, pa.float64()),
                    pa.array(parts, pa.float64()),
                    pa.array(rest, pa.list_(pa.int64())),
                ],
                names=["row", "key", "train", "symbols", "tokens", "known", "log_counts", "word_part", "others"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        train.alias("train"),
        text_of(text).cast("binary").alias("text"),
    )
    schema = (
        f"row bigint, key {docs.schema[key].dataType.simpleString()}, train boolean, symbols binary, tokens bigint, "
        "known bigint, log_counts double, word_part double, others array<bigint>"
    )
    return rows.mapInArrow(run, schema)


def blocks(sequences: list[np.ndarray], settings: Settings) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sequences of like lengths together, longest first: (their places, the sequences)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        width = max(1, settings.block_tokens // len(sequences[order[at]]))
        own = order[at : at + width]
        yield np.array(own), [sequences[i] for i in own]
        at += width


def steps_of(block: list[np.ndarray], settings: Settings) -> int:
    """Steps of a part of a block: the whole block, unless one text alone is longer than ``block_tokens``."""
    return max(1, settings.block_tokens // len(block))


def segment(block: list[np.ndarray], first: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of the steps from ``first`` on, of the sequences that go so far."""
    lengths = np.array([len(s) for s in block])
    active = int((lengths > first).sum())
    size = np.minimum(lengths[:active] - first, steps)
    symbols = np.zeros((int(size[0]), active), dtype=np.uint16)
    for i in range(active):
        symbols[: size[i], i] = block[i][first : first + size[i]]
    return symbols, size


def forward(model: Model, emits: np.ndarray, size: np.ndarray, before: np.ndarray | None, keep: bool = True):
    """Scaled forward probabilities (None unless ``keep``), scales, and the last probabilities of every sequence.

    ``emits``: the emission probabilities of a segment's steps; ``before``: the
    last probabilities of the segment before.
    """
    steps, width, states = emits.shape
    alpha = np.zeros_like(emits) if keep else None
    scale = np.ones((steps, width), dtype=emits.dtype)
    move, ones = model.move.astype(emits.dtype), np.ones(states, dtype=emits.dtype)
    last = np.repeat(model.start.astype(emits.dtype)[None, :], width, axis=0) if before is None else before[:width].copy()
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    for t in range(steps):
        n = active[t]
        now = last[:n] if t == 0 and before is None else last[:n] @ move
        now = now * emits[t, :n]
        scale[t, :n] = now @ ones
        now /= scale[t, :n, None]
        last[:n] = now
        if keep:
            alpha[t, :n] = now
    return alpha, scale, last


def log10_likelihood(model: Model, sequences: list[np.ndarray], settings: Settings) -> np.ndarray:
    """log10 of the exact probability of every sequence."""
    out = np.zeros(len(sequences))
    emit = model.emit.T.copy()
    for places, block in blocks(sequences, settings):
        before, steps = None, steps_of(block, settings)
        for first in range(0, len(block[0]), steps):
            symbols, size = segment(block, first, steps)
            _, scale, before = forward(model, emit[symbols], size, before, keep=False)
            out[places[: len(size)]] += np.log10(scale).sum(axis=0)
    return out


def expected(model: Model, sequences: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions, in single precision within a block.

    A text longer than ``block_tokens`` goes in parts: forward over all of them,
    keeping the probabilities at the joints, then backward from the last part
    on, so the backward probabilities go over the joints too.
    """
    states, symbols_n = model.emit.shape
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols_n))
    emit, back = model.emit.T.astype(np.float32), model.move.T.astype(np.float32)
    for _, block in blocks(sequences, settings):
        steps = steps_of(block, settings)
        firsts = range(0, len(block[0]), steps)
        joints: list[np.ndarray | None] = [None]
        for first in firsts[:-1]:
            symbols, size = segment(block, first, steps)
            joints.append(forward(model, emit[symbols], size, joints[-1], keep=False)[2])
        after = np.zeros((0, states), dtype=np.float32)
        for first, joint in zip(reversed(firsts), reversed(joints)):
            symbols, size = segment(block, first, steps)
            seen = emit[symbols]
            alpha, scale, _ = forward(model, seen, size, joint)
            seen /= scale[:, :, None]
            beta = np.ones((len(size), states), dtype=np.float32)
            beta[: len(after)] = after
            active = np.searchsorted(-size, -np.arange(len(symbols)), side="left")
            here = np.zeros((states, states))
            for t in range(len(symbols) - 1, -1, -1):
                n = active[t]
                ahead = beta[:n] * seen[t, :n]
                # From here on this step of alpha holds the state probabilities.
                alpha[t, :n] *= beta[:n]
                if t:
                    here += alpha[t - 1, :n].T @ ahead
                elif joint is not None:
                    here += joint[:n].T @ ahead
                beta[:n] = ahead @ back
            moves += here
            after = beta
            if joint is None:
                starts += alpha[0].sum(axis=0, dtype=float)
            flat = symbols.ravel()
            for k in range(states):
                emits[k] += np.bincount(flat, alpha[:, :, k].ravel(), minlength=symbols_n)
    return starts, moves * model.move, emits


def first_model(lexicon: Lexicon, settings: Settings) -> Model:
    """States that stay put and emit the symbols' frequencies, each a little otherwise."""
    k = settings.states
    emit = lexicon.unigram[None, :] * np.random.default_rng(7).uniform(0.2, 1.8, (k, lexicon.symbols))
    move = np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    return Model(np.full(k, 1.0 / k), move, emit / emit.sum(axis=1, keepdims=True))


def baum_welch(train: DataFrame, lexicon: Lexicon, settings: Settings) -> Model:
    """Rounds of expected counts over all partitions; a model of bounded size goes out, sums of its size come back."""
    model = first_model(lexicon, settings)
    for _ in range(settings.rounds):
        model = _round(train, model, lexicon, settings)
    return model


def _round(train: DataFrame, model: Model, lexicon: Lexicon, settings: Settings) -> Model:
    k, s = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + k * s)
        for batch in batches:
            rows = [np.frombuffer(x.as_py(), dtype=np.uint16) for x in batch.column(0)]
            starts, moves, emits = expected(model, rows, settings)
            total += np.concatenate([starts, moves.ravel(), emits.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    sums = train.select("symbols").mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(k + k * k + k * s)
    total[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    starts, moves, emits = total[:k] + 1.0, total[k : k + k * k].reshape(k, k) + 1.0, total[k + k * k :].reshape(k, s)
    emits = emits + settings.prior * lexicon.unigram[None, :]
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))


def score_texts(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Learn from the rows where ``train`` holds, and score all.

    Returns one row per row of ``docs``: the key, ``held_out`` (not ``train``; null
    counts as held out), ``n_tokens`` (words and the end), ``n_known`` (tokens seen
    in training), ``train_tokens``, ``base_score`` (log10 of (c + 1) / (N + 1 * (V + 1)), summed over
    tokens) and ``score`` (log10 probability of the whole text). A null text is empty and
    is the end token alone. Without training rows all words are new and all states
    alike. Null keys and repeated rows are rows like others.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    train = F.coalesce(train, F.lit(False))
    counts = scratch.store(word_counts(docs.where(train), text), "counts")
    lexicon = Lexicon(counts, settings)
    rows = scratch.store(encoded(docs, key, text, train, lexicon, settings), "rows")
    model = baum_welch(rows.where("train"), lexicon, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), dtype=np.uint16) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(log10_likelihood(model, sequences, settings)), *(batch.column(i) for i in range(2, batch.num_columns))],
                names=["row", "symbol_part", "key", "train", "tokens", "known", "log_counts", "word_part"],
            )

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.select("row", "symbols", "key", "train", "tokens", "known", "log_counts", "word_part").mapInArrow(
        run,
        f"row bigint, symbol_part double, key {kind}, train boolean, tokens bigint, known bigint, log_counts double, word_part double",
    )
    # The rarer words: counted per text and word, then joined with their counts; new words add nothing.
    rare = rows.select("row", F.explode("others").alias("hash"))
    table = _hashed(counts.where(F.col("n") < lexicon.least))
    more = (
        rare.join(table, "hash")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    )
    extra = F.coalesce("more", F.lit(0.0))
    base = F.col("log_counts") + extra - F.col("tokens") * F.log10(F.lit(float(lexicon.tokens + lexicon.words + 1)))
    return scored.join(more, "row", "left").select(
        F.col("key").alias(key),
        (~F.col("train")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("symbol_part") + F.col("word_part") + extra).alias("score"),
    )


def _hashed(counts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [xxhash.xxh3_64_intdigest(w.as_py()) - (1 << 63) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(1)], names=["hash", "n"])

    return counts.select("word", "n").mapInArrow(run, "hash bigint, n bigint")
