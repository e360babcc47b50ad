"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every task packs its own stream of examples, block by block, so nothing is
shuffled and memory follows the block, not the table. A bin takes, again and
again, the example with the largest dot product between its demand and what the
bin has left (all three limits scaled to 1); what one block leaves over goes
into the next. A third of all rows in one key or copy changes nothing here.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import SMALL_BATCH, prepare, text_of, tidy


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence. ``min_cut``: a gap of at least so many tokens that no whole example
    fills is filled with the head of a longer one; None keeps examples whole, as instruction data needs."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    min_cut: int | None = 16
    block_tokens: int = 1 << 22


def added_tokens(tokenizer: str | None = None) -> dict[str, int]:
    """Texts that a ``tokenizers`` file (by default the public 50k byte-level one) gives an id of their own."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def encoder(vocabulary: str, pattern: str, added: dict[str, int]) -> Callable[[str], list[int]]:
    """Byte-level BPE ids of a text; each text of ``added`` in it becomes its id, other names of special tokens are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return partial(encoding.encode, allowed_special="all") if added else encoding.encode_ordinary


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray  # 1 where a token bears loss
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.key, self.start, self.ids[:n], self.loss[:n], self.total),
            Piece(self.key, self.start + n, self.ids[n:], self.loss[n:], self.total),
        )


def within(piece: Piece, limits: Limits) -> Iterator[Piece]:
    """The piece, cut wherever it alone would break a limit."""
    while len(piece.ids) > limits.tokens or piece.loss.sum() > limits.loss:
        n = min(len(piece.ids), limits.tokens)
        n = min(n, max(1, int(np.searchsorted(np.cumsum(piece.loss[:n]), limits.loss, side="right"))))
        head, piece = piece.cut(n)
        yield head
    # The rest waits for its block to fill; a view would keep all ids of its document until then.
    yield Piece(piece.key, piece.start, piece.ids.copy(), piece.loss.copy(), piece.total) if piece.start else piece


def fill(pieces: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences made of ``pieces``, and the pieces left over for the next block (none if ``last``).

    Pieces with equal demands are one kind; each choice looks at all kinds once.
    """
    kinds: dict[tuple[int, int], list[Piece]] = {}
    for piece in pieces:
        kinds.setdefault((len(piece.ids), int(piece.loss.sum())), []).append(piece)
    demand = np.array(list(kinds), dtype=np.int64).reshape(-1, 2)
    stock = list(kinds.values())
    there = np.array([len(s) for s in stock])
    left_tokens = int((demand[:, 0] * there).sum())
    bins: list[list[Piece]] = []

    def add(piece: Piece) -> None:
        """Put the rest of a cut piece back on stock."""
        nonlocal demand, there
        kind = (len(piece.ids), int(piece.loss.sum()))
        at = np.flatnonzero((demand[:, 0] == kind[0]) & (demand[:, 1] == kind[1]))
        if len(at):
            stock[at[0]].append(piece)
            there[at[0]] += 1
        else:
            demand, there = np.vstack([demand, [kind]]), np.append(there, 1)
            stock.append([piece])

    while there.any() and (last or left_tokens >= limits.tokens):
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        content: list[Piece] = []
        while segments and tokens:
            fits = (there > 0) & (demand[:, 0] <= tokens) & (demand[:, 1] <= loss)
            if fits.any():
                dot = (
                    demand[:, 0] * (tokens / limits.tokens**2)
                    + segments / limits.segments**2
                    + demand[:, 1] * (loss / limits.loss**2)
                )
                at = int(np.argmax(np.where(fits, dot, -1.0)))
                piece = stock[at].pop()
                there[at] -= 1
            elif limits.min_cut is not None and tokens >= limits.min_cut and there.any():
                at = int(np.argmax(np.where(there > 0, demand[:, 0], -1)))
                n = min(tokens, len(stock[at][-1].ids) - 1)
                n = int(np.searchsorted(np.cumsum(stock[at][-1].loss[:n]), loss, side="right"))
                if n < limits.min_cut:
                    break
                piece, rest = stock[at].pop().cut(n)
                there[at] -= 1
                add(rest)
            else:
                break
            content.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - int(piece.loss.sum())
            left_tokens -= len(piece.ids)
        bins.append(content)
        if len(there) > 64 and (there > 0).sum() * 2 < len(there):
            keep = np.flatnonzero(there)
            demand, there, stock = demand[keep], there[keep], [stock[i] for i in keep]
    return bins, [piece for some in stock for piece in some]


def packed(examples: Iterator[tuple[object, np.ndarray, np.ndarray]], limits: Limits) -> Iterator[list[Piece]]:
    """Sequences of one task's examples (key, ids, loss mask)."""
    waiting: list[Piece] = []
    size = 0
    for key, ids, loss in examples:
        for piece in within(Piece(key, 0, ids, loss, len(ids)), limits):
            if len(piece.ids) == limits.tokens:
                yield [piece]
            elif len(piece.ids):
                waiting.append(piece)
                size += len(piece.ids)
        if size >= limits.block_tokens:
            bins, waiting = fill(waiting, limits, last=False)
            size = sum(len(p.ids) for p in waiting)
            yield from bins
    yield from fill(waiting, limits, last=True)[0]


def _pack(df: DataFrame, read: Callable, key_type: T.DataType, key_name: str, limits: Limits) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(key_name, key_type),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("loss_tokens", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        size = 0
        for content in packed((example for batch in batches for example in read(batch)), limits):
            offset = 0
            for p in content:
                rows.append((p.key, p.start, p.ids.tobytes(), int(p.loss.sum()), p.total, number, offset))
                offset += len(p.ids)
            size += offset
            number += 1
            if size >= 1 << 20:
                yield _batch(rows, out)
                rows, size = [], 0
        yield _batch(rows, out)

    return df.mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end: int = 1,
    limits: Limits = Limits(),
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pack whole texts: each becomes its ids and then ``end``, cut and placed into sequences.

    Returns one row per piece: the key, ``start`` (ids of the document before it),
    ``ids`` (little-endian unsigned 32 bits), ``loss_tokens`` (all but a document's
    first id), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    A null text is empty and gives the end id alone. Null keys and repeated rows
    are packed like any other row, an empty table gives no rows, other columns
    are ignored. ``vocabulary`` is a file of base64 tokens and ranks that every
    worker can read; by default the public 50k byte-level one. ``added`` gives
    texts that become one id wherever they stand (see ``added_tokens``); by default none do.
    """
    prepare(docs.sparkSession, SMALL_BATCH)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        nonlocal encode
        if encode is None:
            import public_tokenizers

            encode = encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added or {})
        for k, t in zip(batch.column(0), batch.column(1)):
            ids = np.array([*encode(t.as_py()), end], dtype="<u4")
            loss = np.ones(len(ids), dtype=np.uint8)
            loss[0] = 0
            yield k.as_py(), ids, loss

    encode: Callable[[str], list[int]] | None = None
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return _pack(rows, read, docs.schema[key].dataType, key, limits)


def pack_examples(
    examples: DataFrame, key: str, ids: str, loss: str, limits: Limits = Limits(min_cut=None)
) -> DataFrame:
    """Pack instruction examples: ``ids`` an array of ids, ``loss`` an array of 0 and 1 of equal length.

    Examples stay whole unless one alone breaks a limit. Rows as in
    ``pack_documents``; a null or empty ``ids`` gives no piece, a null or shorter
    ``loss`` counts as 0 where it has nothing.
    """
    prepare(examples.sparkSession, SMALL_BATCH)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for k, i, m in zip(*(batch.column(n) for n in range(3))):
            row = np.array(i.as_py() or [], dtype="<u4")
            mask = np.zeros(len(row), dtype=np.uint8)
            given = np.array([x or 0 for x in (m.as_py() or [])], dtype=np.uint8)[: len(row)]
            mask[: len(given)] = given != 0
            yield k.as_py(), row, mask

    rows = examples.select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.col(loss).alias("loss"))
    return _pack(rows, read, examples.schema[key].dataType, key, limits)
