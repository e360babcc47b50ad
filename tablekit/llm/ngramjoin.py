"""Similarity join of word-shingle sets by token-combination prefixes.

A token is a shingle's hash. Sets of equal tokens are one class. With size n, a
set may miss at most t(n) = n - ceil(s * n) tokens of a set it links with. All sets
list their tokens in hash order, and extend the usual prefix until

    rare tokens + sum over classes of (frequent tokens of the class - 1) >= t(n) + K

Frequent tokens fall into classes by hash, as many as half of t(n) rounded down to a
power of two (sets near a change of that number use both). Rare tokens of the prefix
are indexed alone, frequent ones as pairs of one class. Of two linked sets look at
the one whose prefix ends first: what the two share of it lies in the other's prefix
too. If that were fewer than K rare tokens and no pair, the set would miss more than
t(n) tokens of the other; so every link shares K rare tokens or a pair, and only such
pairs of sets are verified (K is 1 for small sets).

Frequent means: among the tokens that a prefix can reach in more than ``FREQUENT`` sets.
No prefix goes further, as every class costs one token more, so only these are counted.
No list of a rare token is longer than that.

Lists of an indexed pair are not expanded. Their members are compared with the hub of the list first (the
member with the largest share of usual tokens), and only members that then
still lie in different components are compared with each other. A token that no other
member of any such list has cannot be shared, so two sets of n and m tokens, of which
a and b are met elsewhere, can link only if min(a, b) >= s * (n + m - min(a, b)).
Members that share a token of at most ``SCARCE`` members are looked up by it; for any
others the bound holds with a and b counting only tokens of more members than that.
And a set has ``BITS`` bits: whether it holds an odd number of the tokens that fall to
the bit. Where the bits of two sets differ, one holds a token that the other lacks, so
two sets can link only if no more bits differ than tokens may.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.llm.base import SIGN, SMALL_BATCH, Scratch, hashed_texts, key_of, mixed, prepare, shingles, text_of, tidy
from tablekit.llm.graph import components

FREQUENT = 8
SHARED = 3  # K
SCARCE = 10
BITS = 1024
SMALL = 24  # sets with fewer tokens use K = 1
# A list of documents of at most so many rows is sent to every task; a longer one is joined by a shuffle.
SENT_ROWS = 200_000


def needed(n: int, num: int, den: int) -> int:
    """How many tokens a set of ``n`` must share with any it links with."""
    return -(-num * n // den)


def token_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text as signed numbers, in ascending order."""
    for words in hashed_texts(texts):
        yield np.unique((shingles(words, width) ^ SIGN).view(np.int64))


def odd_bits(tokens: np.ndarray) -> np.ndarray:
    """The bits to which an odd number of the tokens fall, 64 to a number."""
    counts = np.bincount(tokens & (BITS - 1), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def front(n: int, num: int, den: int) -> int:
    """The tokens that a prefix can reach: the usual ones, and one more for every class of frequent tokens."""
    miss = n - needed(n, num, den)
    return min(n, miss + SHARED + max(1, -(-miss // 2)))


def classes_of(miss: int) -> int:
    """Power of two of the number of classes of frequent tokens, at most half of ``miss``."""
    return max(1, miss // 2).bit_length() - 1


def signatures(n: int, place: np.ndarray, token: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[list[int], list[int]]:
    """Rare tokens of the prefix, and hashes of its pairs of frequent tokens.

    ``place`` numbers the given tokens in the set; the tokens not given are rare
    ones that no other set can reach.
    """
    low = needed(n, num, den)
    want = n - low + (SHARED if n >= SMALL else 1)
    spot = mixed(token[frequent].view(np.uint64))
    at, common = place[frequent].tolist(), token[frequent].tolist()
    stop, pairs = want, []
    # Also as the smaller partners divide their frequent tokens.
    for level in range(classes_of(low - needed(low, num, den)), classes_of(n - low) + 1):
        end = want
        members: dict[int, list[int]] = {}
        for p, t, c in zip(at, common, (spot % np.uint64(1 << level)).tolist()):
            if p >= end:
                break
            end += c not in members
            members.setdefault(c, []).append(t)
        stop = max(stop, end)
        for own in members.values():
            for i, a in enumerate(own):
                pairs += [key_of(np.array([level, a, b], dtype=np.int64))[0] for b in own[i + 1 :]]
    return token[~frequent & (place < stop)].tolist(), pairs


class Join:
    """One run: its tables, in the order in which they are made."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, num: int, den: int):
        self.spark = prepare(docs.sparkSession, SMALL_BATCH)
        self.scratch = Scratch(self.spark)
        self.kind = docs.schema[key].dataType.simpleString()
        self.width, self.num, self.den = width, num, den
        self.docs = docs.select(F.col(key).alias("doc"), text_of(text).alias("text")).withColumn(
            "content", F.xxhash64("text")
        )

    def run(self) -> DataFrame:
        """``doc``, ``content``, ``n``, and ``component``: what all linked classes are known by, null without tokens."""
        sets = self.scratch.store(self.sets(), "sets")
        first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "content")).alias("first")
        classes = self.scratch.store(
            sets.where("n > 0")
            .groupBy("s1", "s2")
            .agg(first, F.any_value("n").alias("n"), F.any_value("front").alias("front"))
            .select(F.col("s1").alias("id"), "first", "n", "front"),
            "classes",
        )
        names = self.scratch.store(sets.drop("front", "s2"), "names")
        self.scratch.drop("sets")
        lists = self.lists(classes)
        firsts = self.scratch.store(classes.select("id", "first"), "firsts")
        self.scratch.drop("classes")
        edges = self.linked(lists, firsts)
        own = components(edges, self.scratch).select(F.col("node").alias("s1"), "component")
        return names.join(own, "s1", "left").select(
            "doc", "content", "n", F.when(F.col("n") > 0, F.coalesce("component", "s1")).alias("component")
        )

    def sets(self) -> DataFrame:
        """Size, name and counted part of every document's set."""
        width, num, den = self.width, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, names, fronts = [], [], []
                for tokens in token_sets((t.as_py() for t in batch.column(1)), width):
                    n.append(len(tokens))
                    names.append(key_of(tokens))
                    fronts.append(tokens[: front(len(tokens), num, den)].copy())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(n, pa.int32()),
                        pa.array([a for a, _ in names], pa.int64()),
                        pa.array([b for _, b in names], pa.int64()),
                        pa.array(fronts, pa.list_(pa.int64())),
                    ],
                    names=["doc", "content", "n", "s1", "s2", "front"],
                )

        rows = self.docs.select("doc", F.col("text").cast("binary").alias("text"), "content")
        return rows.mapInArrow(tidy(run), f"doc {self.kind}, content bigint, n int, s1 bigint, s2 bigint, front array<bigint>")

    def whole(self, ids: DataFrame, name: str) -> DataFrame:
        """All tokens of the classes ``ids`` (id, first), worked out again from the texts, and their ``odd_bits``."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.int64())
            for batch in batches:
                tokens = list(token_sets((t.as_py() for t in batch.column(1)), width))
                columns = [batch.column(0), pa.array(tokens, kind), pa.array([odd_bits(t) for t in tokens], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tokens", "odd"])

        named = ids.select("id", F.col("first.doc").alias("of"), F.col("first.content").alias("with"))
        few = named.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        rows = self.docs.join(
            F.broadcast(named) if few else named,
            F.col("doc").eqNullSafe(F.col("of")) & (F.col("content") == F.col("with")),
        )
        made = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "id bigint, tokens array<bigint>, odd array<bigint>")
        # Fully repeated rows name the same class twice.
        return self.scratch.store(made.dropDuplicates(["id"]), name)

    def lists(self, classes: DataFrame) -> DataFrame:
        """Index entries: ``sig``, ``id``, ``n``, and whether the list is of a pair."""
        spread = classes.select("id", "n", F.posexplode("front").alias("place", "token"))
        counts = self.scratch.store(
            spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts"
        )
        at = F.struct("place", "token", (F.col("df") > FREQUENT).alias("frequent"))
        rows = spread.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(at)).alias("tokens"))
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for r in range(batch.num_rows):
                    i, n = (batch.column(c)[r].as_py() for c in range(2))
                    place, token, frequent = (
                        np.array(batch.column(c)[r].as_py(), dtype=t) for c, t in ((2, np.int64), (3, np.int64), (4, bool))
                    )
                    for pair, sigs in enumerate(signatures(n, place, token, frequent, num, den)):
                        out += [(s, i, n, bool(pair)) for s in sigs]
                columns = list(zip(*out)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sig", "id", "n", "pair"])

        parts = [F.col(f"tokens.{f}").alias(f) for f in ("place", "token", "frequent")]
        made = rows.select("id", "n", *parts).mapInArrow(tidy(run), "sig bigint, id bigint, n int, pair boolean")
        out = self.scratch.store(made, "lists")
        self.scratch.drop("counts")
        return out

    def linked(self, lists: DataFrame, classes: DataFrame) -> DataFrame:
        """Edges that join all linked classes: components of the first verified links, and the links found after."""
        sizes = lists.groupBy("sig", "pair").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        lists = self.scratch.store(lists.join(sizes, ["sig", "pair"]), "sized")
        self.scratch.drop("lists")
        # All pairs of a rare token's list, of which none is long.
        expand = lists.where("not pair").select("sig", "id", "n")
        other = expand.select("sig", F.col("id").alias("b"), F.col("n").alias("n_b"))
        enough = F.when((F.col("n") >= SMALL) & (F.col("n_b") >= SMALL), SHARED).otherwise(1)
        rare = (
            expand.join(other, "sig")
            .where((F.col("id") < F.col("b")) & self.alike("n", "n_b"))
            .groupBy(F.col("id").alias("a"), "b", "n", "n_b")
            .agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") >= enough)
            .select("a", "b")
        )
        long = lists.where("pair").select("sig", "id", "n", "size")
        met, scarce, odd = self.met(long, classes)
        long = self.scratch.store(long.join(met, "id"), "long")
        # The member with the largest share of usual tokens stands for the list, of several that in most lists.
        weight = long.groupBy("id").agg(F.sum("size").alias("weight"))
        rank = F.struct((F.col("usual") / F.col("n")).alias("share"), "weight", "id", "n", "met")
        hubs = (
            long.join(weight, "id")
            .groupBy("sig")
            .agg(F.max(rank).alias("hub"))
            .select("sig", F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.met").alias("met_b"))
        )
        stars = self.pairs(long.join(hubs, "sig").where(self.can_link()))
        tried = self.scratch.store(rare.unionByName(stars).distinct(), "tried")
        edges = self.verified(tried, classes, "1")
        # What still lies apart in a list is compared one with another.
        own = self.scratch.store(components(edges, self.scratch), "own")
        # No set has a link if even one without tokens of its own would lie too far from it.
        apart = self.scratch.store(
            long.where(self.den * F.col("met") >= self.num * F.col("n"))
            .join(own, F.col("id") == F.col("node"), "left")
            .join(odd, "id")
            .select("sig", "id", "n", "met", "usual", "odd", F.coalesce("component", "id").alias("component")),
            "apart",
        )
        split = apart.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        apart = apart.join(split.select("sig"), "sig", "left_semi")
        other = [F.col(c).alias(f"{c}_b") for c in ("n", "met", "usual", "odd", "component")]
        differ = (F.col("id") < F.col("b")) & (F.col("component") != F.col("component_b"))
        usual = apart.where(self.den * F.col("usual") >= self.num * F.col("n"))
        near = usual.join(usual.select("sig", F.col("id").alias("b"), *other), "sig")
        near = self.pairs(near.where(differ & self.can_link("usual") & self.few_odd()))
        having = scarce.join(apart.dropDuplicates(["id"]).drop("sig"), "id")
        also = having.join(having.select("token", F.col("id").alias("b"), *other), "token")
        also = self.pairs(also.where(differ & self.can_link() & self.few_odd()))
        rest = near.unionByName(also).distinct().join(tried, ["a", "b"], "left_anti")
        more = self.verified(self.scratch.store(rest, "rest"), classes, "2")
        return own.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)

    def met(self, long: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """How many tokens of a member of long lists stand in any other member (``met``), and in more than
        ``SCARCE`` (``usual``); the tokens of 2 to ``SCARCE`` members with
        each of these; and all members' ``odd_bits``."""
        tokens = self.whole(classes.select("id", "first").join(long.select("id").distinct(), "id", "left_semi"), "members")
        spread = tokens.select("id", F.explode("tokens").alias("token"))
        few = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(f"df <= {SCARCE}")
        few = self.scratch.store(spread.join(few, "token"), "few")
        own = few.groupBy("id").agg(F.count(F.lit(1)).alias("few"), F.count_if(F.col("df") == 1).alias("own"))
        sizes = tokens.select("id", F.size("tokens").alias("size")).join(own, "id", "left")
        count = sizes.select(
            "id", *((F.col("size") - F.coalesce(c, F.lit(0))).alias(m) for m, c in (("met", "own"), ("usual", "few")))
        )
        return count, few.where("df > 1").select("id", "token"), tokens.select("id", "odd")

    def few_odd(self):
        """Whether no more bits differ than tokens of two sets of linked members can: (1 - s) / (1 + s) of both sizes."""
        differ = sum(F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(BITS // 64))
        return (self.den + self.num) * differ <= (self.den - self.num) * (F.col("n") + F.col("n_b"))

    def can_link(self, count: str = "met"):
        """Whether two members could link if all tokens that both meet elsewhere were the same ones."""
        both = F.least(count, f"{count}_b")
        return self.den * both >= self.num * (F.col("n") + F.col("n_b") - both)

    def alike(self, a: str, b: str):
        """Whether two sizes allow a link."""
        return self.den * F.least(F.col(a), F.col(b)) >= self.num * F.greatest(F.col(a), F.col(b))

    def pairs(self, found: DataFrame) -> DataFrame:
        """Distinct pairs (id, b) of different members whose sizes allow a link, smaller first."""
        return (
            found.where((F.col("id") != F.col("b")) & self.alike("n", "n_b"))
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
            .distinct()
        )

    def verified(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets are similar enough, by their whole sets."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        tokens = self.whole(classes.select("id", "first").join(ids, "id", "left_semi"), f"tokens-{name}")
        num, den = self.num, self.den

        @F.arrow_udf(T.BooleanType())
        def similar(x: pa.Array, y: pa.Array) -> pa.Array:
            out = []
            for a, b in zip(x, y):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(den * both >= num * (len(a) + len(b) - both))
            return pa.array(out, pa.bool_())

        joined = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(
            tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b"
        )
        out = self.scratch.store(joined.where(similar("x", "y")).select("a", "b"), f"links-{name}")
        self.scratch.drop(f"tokens-{name}")
        return out


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least num / den.

    Words are split at ASCII blanks, A-Z count as a-z; a text of fewer than ``width``
    words is one shingle. Returns one row per row of ``docs``: the key, ``n_shingles``
    and ``component_id``, the smallest key reachable by links (its own included). A
    null or blank text has no shingles and links with nothing. Rows with a null key
    come last; a component of such rows alone has a null id. Repeated rows, and rows with
    equal keys, are documents of their own. An empty table gives no rows.
    """
    found = Join(docs, key, text, width, num, den).run()
    least = found.where("component is not null").groupBy("component").agg(F.min("doc").alias("component_id"))
    return found.join(least, "component", "left").select(
        F.col("doc").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that with the smallest key.

    Rows with equal keys stand in the order of a hash of their texts, null keys last;
    of fully repeated rows one stays. Rows without words all stay.
    """
    join = Join(docs, key, text, width, num, den)
    found = join.scratch.store(join.run().where("n > 0"), "found")
    at = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "content")
    first = found.groupBy("component").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Names longer than any of the rows' own cannot clash with them.
    own = "_" * (1 + max(map(len, docs.columns)))
    names = F.col("doc").alias(own + "of"), F.col("content").alias(own + "with")
    goes = found.join(first, "component").where(at != F.col("first")).select(*names).distinct()
    goes = join.scratch.store(goes, "goes")
    few = goes.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    rows = docs.withColumn(own + "content", F.xxhash64(text_of(text)))
    same = F.col(key).eqNullSafe(F.col(own + "of")) & (F.col(own + "content") == F.col(own + "with"))
    rows = rows.join(F.broadcast(goes) if few else goes, same, "left_anti")
    again = found.groupBy("doc", "content").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = join.scratch.store(again.select(*names), "again")
    if again.isEmpty():
        return rows.drop(own + "content")
    place = F.row_number().over(Window.partitionBy(key, own + "content").orderBy(F.lit(1)))
    one = rows.join(again, same, "left_semi").withColumn(own + "place", place).where(F.col(own + "place") == 1).drop(own + "place")
    return rows.join(again, same, "left_anti").unionByName(one).drop(own + "content")
