"""Joins: user joins with column collision rules, lookups, rule ladders, anti joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import col, text
from tablekit.operators.edit import small
from tablekit.operators.rows import ROW


def join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str | None = None,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in which the right side's value wins for a shared column name.

    ``how`` is ``left`` or anything else for inner. Where a left row has no
    match its own values stay. Keys of different types are compared as text.
    The physical join is left to the optimizer, which splits a hot key.
    """
    right_key = right_key or left_key
    how = "left" if how == "left" else "inner"
    r = right.select([col(c).alias("_r_" + c) for c in right.columns] + [F.lit(True).alias("_hit")])
    lk, rk = col(left_key), col("_r_" + right_key)
    if left.schema[left_key].dataType != right.schema[right_key].dataType:
        lk, rk = text(lk), text(rk)
    out = left.join(r, lk.eqNullSafe(rk) if null_safe else lk == rk, how)

    def pick(c: str) -> Column:
        if c not in right.columns:
            return col(c)
        theirs = col("_r_" + c)
        return theirs.alias(c) if how == "inner" else F.when(F.col("_hit"), theirs).otherwise(
            col(c)
        ).alias(c)

    return out.select(
        [pick(c) for c in left.columns]
        + [col("_r_" + c).alias(c) for c in right.columns if c not in left.columns]
    )


def keep_last(df: DataFrame, keys: Sequence[str], row: str = ROW) -> DataFrame:
    """One row per key, the last in row order."""
    return _keep_one(df, keys, F.col(row).desc())


def keep_first(df: DataFrame, keys: Sequence[str], row: str = ROW) -> DataFrame:
    """One row per key, the first in row order."""
    return _keep_one(df, keys, F.col(row).asc())


def _keep_one(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    # "row number = 1" is planned with a limit per group before the shuffle, so
    # each task sends at most one row per key however often a key occurs.
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def comparison_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    row: str = ROW,
    normalise: Callable[[Column], Column] = text,
) -> DataFrame:
    """Full outer join on a key, last duplicate winning, as structs ``a`` and ``b``.

    Both sides hold one row per key after the dedup, so no key can be hot. Null
    keys compare as the empty text.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        normal = [
            F.coalesce(normalise(col(k)), F.lit("")).alias(f"_key{i}") for i, k in enumerate(keys)
        ]
        data = [col(c) for c in df.columns if c != row]
        slim = df.select(*normal, F.struct(*data).alias(name), F.col(row).alias("_order"))
        names = [f"_key{i}" for i in range(len(keys))]
        return keep_last(slim, names, "_order").drop("_order")

    names = [f"_key{i}" for i in range(len(keys))]
    return side(a, "a").join(side(b, "b"), names, "full_outer")


def positional_join(a: DataFrame, b: DataFrame, row: str = ROW) -> DataFrame:
    """Align two tables by dense row number, as structs ``a`` and ``b``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(row), F.struct(*[col(c) for c in df.columns if c != row]).alias(name))

    return side(a, "a").join(side(b, "b"), row, "full_outer")


def only_in_left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def lookup(
    df: DataFrame,
    key: str,
    table: DataFrame,
    index: int,
    out: str = "lookup",
    row: str = ROW,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Exact lookup: column number ``index`` (from 1) of the first row whose first column is the key.

    No match gives ``#N/A``; a column number outside the table gives ``#REF!``.
    Pass the table's counted rows as ``broadcast_rows`` to let a small one be broadcast.
    """
    names = [c for c in table.columns if c != row]
    if not 1 <= index <= len(names):
        return df.withColumn(out, F.lit("#REF!"))
    slim = table.select(col(names[0]).alias("_k"), col(names[index - 1]).alias("_v"), F.col(row))
    first = keep_first(slim, ["_k"], row).select("_k", F.struct("_v").alias("_s"))
    if broadcast_rows is not None:
        first = small(first, broadcast_rows)
    return (
        df.join(first, col(key) == F.col("_k"), "left")
        .withColumn(
            out,
            F.when(F.col("_s").isNull(), F.lit("#N/A")).otherwise(text(F.col("_s")["_v"])),
        )
        .drop("_k", "_s")
    )


class RuleIndex:
    """Finds the first of many patterns that a text holds.

    Every pattern lies under one of its grams, the one that fewest patterns
    share, so a text tests only patterns of which it has that gram.
    """

    GRAM = 3

    def __init__(self, patterns: Sequence[str]):
        grams = [sorted({p[i : i + self.GRAM] for i in range(max(1, len(p) - self.GRAM + 1))}) for p in patterns]
        shared = Counter(g for own in grams for g in own)
        self.under: dict[str, list[tuple[int, str]]] = {}
        for number, (pattern, own) in enumerate(zip(patterns, grams)):
            self.under.setdefault(min(own, key=shared.__getitem__), []).append((number, pattern))
        self.widths = sorted({len(g) for g in self.under})

    def first(self, text: str) -> int | None:
        best = None
        for width in self.widths:
            for gram in {text[i : i + width] for i in range(len(text) - width + 1)}:
                for number, pattern in self.under.get(gram, ()):
                    if best is not None and number >= best:
                        break
                    if pattern in text:
                        best = number
                        break
        return best


def first_rule(
    c: Column, rules: Sequence[tuple[str, str]], default: Column | None = None, regex: bool = False
) -> Column:
    """The value of the first rule whose pattern the text holds.

    A pattern is a case-insensitive part of the text, or with ``regex`` a
    regular expression. Parts are looked up in an index that goes out with the
    tasks, whatever their number, so no join is needed and each row is read
    once; both sides are lower-cased by the engine. A null text counts as empty.
    """
    value = F.coalesce(c, F.lit(""))
    miss = default if default is not None else F.lit(None).cast("string")
    if not rules:
        return miss
    if regex:
        ladder = None
        for pattern, result in rules:
            hit = value.rlike(pattern)
            ladder = F.when(hit, result) if ladder is None else ladder.when(hit, result)
        return ladder.otherwise(miss)
    spark = SparkSession.active()
    listed = spark.createDataFrame(list(enumerate(p for p, _ in rules)), "n int, p string")
    lowered = {r["n"]: r["p"] for r in listed.select("n", F.lower("p").alias("p")).collect()}
    index = RuleIndex([lowered[n] for n in range(len(rules))])

    results = [[r] for _, r in rules]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            numbers = [index.first(t) for t in batch.to_pylist()]
            yield pa.array([None if n is None else results[n] for n in numbers], pa.list_(pa.string()))

    # One result in an array: a rule may give null, which is not the same as no rule.
    found = first(F.lower(value))
    return F.when(found.isNull(), miss).otherwise(F.get(found, F.lit(0)))
