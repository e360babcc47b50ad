"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.session import new_folder, remove, tune

# ASCII bytes that are no word character under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
# become blanks and A-Z become a-z; bytes of other characters stay.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
# A-Z become a-z, nothing else changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# One dictionary of words holds this many entries, then it starts anew.
MEMO_WORDS = 1 << 17
_MIX = (
    np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB),
    np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB),
)
SIGN = np.uint64(1 << 63)
# The bytes at which ``bytes.split`` splits.
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
# Words of more bytes are hashed one by one; texts go through the hashing in groups of about so many bytes.
LONG_WORD, GROUP_BYTES = 64, 1 << 20
# Arrow batches of operators that read texts one by one and gain nothing from large ones.
SMALL_BATCH = 4 << 20
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def prepare(spark: SparkSession, batch_bytes: int = 16 << 20) -> SparkSession:
    """Session settings for jobs that move whole texts.

    Arrow batches are bounded in rows and bytes, so long texts do not pile up
    in a worker or in the memory that the JVM takes beside its heap; shuffle
    files go as soon as the action that wrote them ends.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


class Scratch:
    """Tables written to the shared folder and read back; ``drop`` them when nothing reads them any more.

    Writing cuts the lineage, gives Catalyst the true size of a table, and lets
    a job go on after executors are lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(self.spark)
        df.write.parquet(folder)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.folders.pop(name))


def release() -> None:
    """Give freed memory back to the system: a Python worker goes on to other tasks and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    # Not every C library has it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A batch function that gives its memory back once it has ended."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(batch, name: str = "text") -> Iterator[bytes]:
    """The values of a string column of an Arrow batch as UTF-8, null as empty."""
    import pyarrow as pa

    for value in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()):
        yield value.as_py() or b""


class WordHashes:
    """64-bit hashes of words, remembered for at most ``limit`` words seen before."""

    def __init__(self, limit: int = MEMO_WORDS):
        self.memo: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        found = [memo.get(w) for w in words]
        if None in found:
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(found):
                if h is None:
                    found[i] = memo[words[i]] = digest(words[i])
        return np.array(found, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``data``, eight bytes at a time, and the place of each word's first byte."""
    edges = np.flatnonzero(np.diff(BLANK[np.frombuffer(data, dtype=np.uint8)], prepend=True, append=True))
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), 0, (1,))
    out = mixed(size.astype(np.uint64) * _MIX[0])
    at = np.arange(len(out))
    for done in range(0, LONG_WORD, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        part = eight[start[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
        out[at] = mixed((out[at] ^ part) * _MIX[0])
    for i in at[size[at] > LONG_WORD].tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return out, start


def grouped(texts: Iterable[bytes], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, in groups of at most about ``most`` bytes or one text."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def hashed_texts(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text; A-Z count as a-z."""
    for group in grouped(texts):
        found, start = word_hashes(b"\n".join(group).translate(LOWER))
        ends = np.cumsum([len(t) + 1 for t in group])
        yield from np.split(found, np.searchsorted(start, ends[:-1]))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words; a shorter text is one run, an empty one none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * _MIX[0] + words[i : i + n])
    return out


def key_of(parts: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that identify a sequence of hashes."""
    digest = xxhash.xxh3_128_digest(parts.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)

