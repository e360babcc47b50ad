"""Line deduplication by a deletion-neighbourhood join, over words.

Two lines are close when at most one word is put in, left out or replaced. A
line goes when an equal or close line stands earlier. Equal lines are brought
together by their hash. Lines that share half of their words with another line
(close lines always do) then emit all variants with one word left out:

- lines that give the same variant by leaving out the word at the same place
  are all close to each other, so the earliest of them speaks for all;
- a line that is itself a variant of another is close to it.

So earliest lines per variant replace pairs, and a variant that a third of all
lines share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import tee

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import LOWER, SMALL_BATCH, Scratch, grouped, hashed_texts, mixed, prepare, text_of, tidy, word_hashes

ORDER = ("no_id", "doc", "content", "line")
# A list of documents and lines of at most so many bytes is sent to every task; a longer one is joined by a shuffle.
SENT_BYTES = 32 << 20
# A line that makes up more than this part of all lines is common; there can be no more common lines than the inverse.
COMMON = 1 / 2000
ODD = 0xD6E8FEB86659FD93


def names_of(digests: Iterable[bytes]) -> list[pa.Array]:
    """Two columns of signed numbers that name sequences of 8-byte word hashes, from their 16-byte digests."""
    found = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(found[:, i]) for i in (0, 1)]


def halves(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Four keys a line, of which two close lines share one: the first or second half of the shorter, as it lies in each.

    The lines are ``n`` of the word hashes ``words`` each, from ``start`` on. Different halves
    may now and then have one key: it brings lines together, their variants tell.
    """
    # A run of words is a polynomial of an odd number, modulo 2**64: a difference of two sums over all words.
    power = np.full(len(words) + 1, ODD, dtype=np.uint64)
    back = np.full(len(words) + 1, pow(ODD, -1, 1 << 64), dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
    a, b = n // 2, np.maximum(n - 1, 0) // 2
    runs = ((0 * n, a, 2 * n), (a, n, 2 * n + 1), (0 * n, b, 2 * n - 2), (np.minimum(b + 1, n), n, 2 * n - 1))
    keys = [(sums[start + j] - sums[start + i]) * back[start + i] ^ mixed(mark.astype(np.uint64)) for i, j, mark in runs]
    return mixed(np.stack(keys, axis=1)).view(np.int64)


def variants(words: bytes) -> list[bytes]:
    """Digests of a line's word hashes, then of those with the word at place 0, 1, ... left out."""
    # Never all variants side by side: those of a long line take the square of its length.
    digest = xxhash.xxh3_128_digest
    return [digest(words), *(digest(words[:i] + words[i + 8 :]) for i in range(0, len(words), 8))]


def close(a: bytes, b: bytes) -> bool:
    """Whether at most one word differs between two lines."""
    x, y = sorted((a.translate(LOWER).split(), b.translate(LOWER).split()), key=len)
    if len(y) - len(x) > 1:
        return False
    head = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    skip = head + (len(x) == len(y))
    return x[skip:] == y[head + 1 :] if head < len(y) else True


def _content(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows as documents: rows with equal key and text are the same one."""
    return docs.select(F.col(key).alias("doc"), text_of(text).alias("text")).withColumn("content", F.xxhash64("text"))


def _lines(docs: DataFrame, kind: str, min_words: int, near_words: int) -> DataFrame:
    """Lines of at least ``min_words`` words: their place, hash, and keys of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in grouped(t.as_py() for t in batch.column(1)):
                data = b"\n".join(group).translate(LOWER)
                words, at = word_hashes(data)
                # A line's words go from one of these bounds to the next.
                breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
                bounds = np.concatenate([[0], np.searchsorted(at, breaks), [len(at)]])
                n = np.diff(bounds)
                # The first line of each text, and of what would come after the last.
                first = np.searchsorted(breaks, np.cumsum([0, *(len(t) + 1 for t in group)]))
                first[-1] = len(n)
                own = np.repeat(np.arange(len(group)), np.diff(first))
                kept = np.flatnonzero(n >= min_words)
                rows = pa.array(own[kept] + done)
                every = words.tobytes()
                names = [xxhash.xxh3_128_digest(every[i:j]) for i, j in zip((8 * bounds[kept]).tolist(), (8 * bounds[kept + 1]).tolist())]
                near = n[kept] >= near_words
                keys = halves(words, bounds[kept[near]], n[kept[near]])
                # Four keys a line, or none and null.
                ends = pa.array(np.concatenate([[0], np.cumsum(4 * near)]), pa.int32())
                found = pa.ListArray.from_arrays(ends, pa.array(keys.ravel(), pa.int64()), mask=pa.array(~near))
                number = pa.array((np.arange(len(n)) - first[own])[kept], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), number, *names_of(names), found],
                    names=["doc", "content", "line", "h1", "h2", "halves"],
                )
                done += len(group)

    rows = docs.select("doc", F.col("text").cast("binary").alias("text"), "content")
    return rows.mapInArrow(tidy(run), f"doc {kind}, content bigint, line int, h1 bigint, h2 bigint, halves array<bigint>")


def _variants(docs: DataFrame, kind: str) -> DataFrame:
    """Variants of the lines that ``docs`` names in its array ``lines``; the line's own words come with its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
            for r in range(batch.num_rows):
                lines = batch.column(1)[r].as_py().translate(LOWER).split(b"\n")
                for number in batch.column(3)[r].as_py():
                    yield r, number, lines[number]

        for batch in batches:
            rows: list[tuple] = []
            made: list[bytes] = []
            places, texts = tee(named(batch))
            # The second one runs ahead by a group of texts.
            for (r, number, line), words in zip(places, hashed_texts(line for _, _, line in texts)):
                own = variants(words.tobytes())
                made += own
                rows.append((r, number, len(own), line))
                if len(made) > 50_000:
                    yield _variant_batch(batch, rows, made)
                    rows, made = [], []
            yield _variant_batch(batch, rows, made)

    rows = docs.select("doc", F.col("text").cast("binary").alias("text"), "content", "lines")
    return rows.mapInArrow(tidy(run), f"doc {kind}, content bigint, line int, place int, v1 bigint, v2 bigint, words binary")


def _variant_batch(batch: pa.RecordBatch, rows: list[tuple], made: list[bytes]) -> pa.RecordBatch:
    """A row for each digest of ``made``, the variants of the lines ``rows``, one line after the other."""
    r, number, sizes, words = zip(*rows) if rows else ((),) * 4
    sizes = np.array(sizes, dtype=np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] - 1
    at = pa.array(np.array(r, dtype=np.int64)[of])
    numbers = pa.array(np.array(number, dtype=np.int32)[of])
    # The line's words come with its own row only.
    lines = pa.array(words, pa.binary()).take(pa.array(of, mask=place >= 0))
    columns = [batch.column(0).take(at), batch.column(2).take(at), numbers, pa.array(place, pa.int32()), *names_of(made), lines]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "content", "line", "place", "v1", "v2", "words"])


def _order() -> Column:
    """Where a line stands: by key, rows without a key last, then text and line."""
    return F.struct(F.col("doc").isNull().alias("no_id"), "doc", "content", "line")


def _sent(small: DataFrame, lines: str) -> DataFrame:
    """``small`` marked for sending to every task if its keys and its arrays ``lines`` are short, else as it is."""
    size = small.agg(F.coalesce(F.sum(48 + 4 * F.size(lines)), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= SENT_BYTES else small


def repeated_lines(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", min_words: int = 1, near_words: int = 5
) -> DataFrame:
    """The lines that go, per document: ``doc``, ``content`` (hash of the text) and ``dropped`` (line numbers from 0).

    Lines with fewer than ``min_words`` words always stay; lines with fewer than
    ``near_words`` go only when equal. A-Z count as a-z, blanks do not count.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = _content(docs, key, text)
    lines = scratch.store(_lines(rows, kind, min_words, near_words), "lines")
    kinds = scratch.store(
        lines.groupBy("h1", "h2").agg(
            F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("halves").alias("halves")
        ),
        "kinds",
    )
    # Lines that share half of their words with another one; only they can be close to any.
    half = kinds.where("halves is not null").select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    maybe = half.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(F.any_value("first").alias("first"))
    by_document = scratch.store(
        maybe.groupBy(F.col("first.doc").alias("of"), F.col("first.content").alias("with")).agg(
            F.collect_set("first.line").alias("lines")
        ),
        "maybe",
    )
    named = rows.join(
        _sent(by_document, "lines"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("content") == F.col("with"))
    ).dropDuplicates(["doc", "content"])
    made = scratch.store(_variants(named, kind).withColumn("at", _order()).drop(*ORDER[1:]), "variants")

    own = made.where("place < 0")
    cut = made.where("place >= 0").drop("words")
    same_place = cut.groupBy("v1", "v2", "place").agg(F.min("at").alias("by"), F.count(F.lit(1)).alias("n")).where("n > 1")
    as_cut = cut.groupBy("v1", "v2").agg(F.min("at").alias("by"))
    links = (
        cut.join(same_place.drop("n"), ["v1", "v2", "place"])
        .select("at", "by")
        .unionByName(cut.join(own.select("v1", "v2", F.col("at").alias("by")), ["v1", "v2"]).select("at", "by"))
        .unionByName(own.join(as_cut, ["v1", "v2"]).select("at", "by"))
        .where(F.col("by") < F.col("at"))
        .groupBy("at")
        .agg(F.min("by").alias("by"))
    )

    @F.arrow_udf(T.BooleanType())
    def verified(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([close(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.bool_())

    words = own.select("at", "words")
    near = (
        links.join(words.withColumnRenamed("words", "own_words"), "at")
        .join(words.select(F.col("at").alias("by"), F.col("words").alias("by_words")), "by")
        .where(verified("own_words", "by_words"))
        .join(own.select("at", F.col("v1").alias("h1"), F.col("v2").alias("h2")), "at")
        .select("h1", "h2", F.lit(True).alias("near"))
    )
    verdicts = kinds.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 or near")
    verdicts = scratch.store(verdicts, "verdicts")
    places = lines.drop("halves")
    # The places of a common line would all meet in one task, so common lines are sent to the places instead.
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common, others = verdicts.where(F.col("n") > total * COMMON), verdicts.where(F.col("n") <= total * COMMON)
    met = places.join(F.broadcast(common), ["h1", "h2"]).unionByName(
        places.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"], "left_anti").join(others, ["h1", "h2"])
    )
    goes = met.where(F.coalesce(F.col("near"), F.lit(False)) | (_order() != F.col("first")))
    dropped = goes.groupBy("doc", "content").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    out = scratch.store(dropped, "dropped")
    scratch.drop("lines", "kinds", "maybe", "variants", "verdicts")
    return out


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, near_words: int = 5
) -> DataFrame:
    """Every document with its number of lines, the lines that go and the text that stays.

    Returns one row per row of ``docs``: the key, ``n_lines``, ``dropped`` (line
    numbers from 0, in order) and ``kept`` (the other lines, joined again). A line
    goes when an equal or close one (see the module) stands earlier: in an earlier
    line of the same text, or in a document with a smaller key; rows with equal keys
    stand in the order of a hash of their texts, null keys last, and fully repeated rows count
    as one. A null text is empty and has one empty line, which stays.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    goes = repeated_lines(docs, Scratch(docs.sparkSession), key, text, min_words, near_words)
    goes = _sent(goes.select(F.col("doc").alias("of"), F.col("content").alias("with"), "dropped"), "dropped")
    rows = _content(docs, key, text).join(
        goes, F.col("doc").eqNullSafe(F.col("of")) & (F.col("content") == F.col("with")), "left"
    )
    return rows.select(
        F.col("doc").alias(key),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        # Only texts that change go to Python.
        F.coalesce(without(F.when(F.col("dropped").isNotNull(), F.col("text")), "dropped"), "text").alias("kept"),
    )


@F.arrow_udf(T.StringType())
def without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    """A text without the lines of the given numbers; unchanged where these are null, null where it is null."""
    out = []
    for t, d in zip(text, dropped):
        gone = set(d.as_py() or ()) if t.is_valid else ()
        lines = t.as_py().split("\n") if gone else ()
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t.as_py())
    return pa.array(out, pa.string())


def keep_first_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", min_words: int = 1, near_words: int = 5
) -> DataFrame:
    """``docs`` without the lines that go, ``size`` set to the new length.

    A document all of whose words go is left out; one without words, null and
    empty texts included, stays. Ties are settled as in ``dedup_lines``: of
    equal lines the earliest stays, fully repeated rows all keep theirs. An
    empty table gives no rows. Columns of any names are carried along.
    """
    prepare(docs.sparkSession, SMALL_BATCH)
    goes = repeated_lines(docs, Scratch(docs.sparkSession), key, text, min_words, near_words)
    # Names longer than any of the rows' own cannot clash with them.
    own = "_" * (1 + max(map(len, docs.columns)))
    goes = _sent(goes.select(F.col("doc").alias(own + "of"), F.col("content").alias(own + "with"), F.col("dropped").alias(own + "gone")), own + "gone")
    same = F.col(key).eqNullSafe(F.col(own + "of")) & (F.xxhash64(text_of(text)) == F.col(own + "with"))
    changed = F.col(own + "gone").isNotNull()
    # Not to be run again by the filter below, which would take a second worker per task.
    kept = without.asNondeterministic()(F.when(changed, F.col(text)), F.col(own + "gone"))
    kept = F.when(changed, kept).otherwise(F.col(text))
    rows = docs.join(goes, same, "left").withColumn(own + "kept", kept)
    left = {text: F.col(own + "kept"), size: F.when(changed, F.length(own + "kept").cast("long")).otherwise(F.col(size))} if size in docs.columns else {text: F.col(own + "kept")}
    rows = rows.where(~changed | F.col(own + "kept").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[left.get(c, F.col(c)).alias(c) for c in docs.columns])
