"""Grouping, pivots, frequencies, distinct keys and exact medians."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.coerce import col, dtype, half_up, number, text, truthy
from tablekit.operators.rows import ROW, running_total

MISSING = "(null)"


def aggregate(
    df: DataFrame, op: str, name: str | None, row: str = ROW, blank_as_zero: bool = False
) -> Column:
    """One aggregate: count, sum, avg, min, max, first or last."""
    if op == "count":
        return F.count(F.lit(1))
    if op == "first":
        return F.min_by(col(name), F.col(row))
    if op == "last":
        return F.max_by(col(name), F.col(row))
    value = number(col(name), dtype(df, name), blank_as_zero)
    if op == "sum":
        return half_up(F.sum(value))
    if op == "avg":
        return half_up(F.avg(value))
    if op == "min":
        return F.min(value)
    if op == "max":
        return F.max(value)
    raise ValueError(f"unknown aggregate {op}")


def group_by(
    df: DataFrame,
    cols: str | Sequence[str],
    aggs: Mapping[str, tuple[str, str | None]],
    row: str = ROW,
    blank_as_zero: bool = False,
    missing: str | None = MISSING,
) -> DataFrame:
    """``aggs`` is ``{output: (op, column)}``; a missing group value is labelled ``(null)``.

    Every aggregate has a partial form, so a hot group costs one row per task
    in the shuffle.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    keys = [
        (F.coalesce(text(col(c)), F.lit(missing)) if missing is not None else col(c)).alias(c)
        for c in cols
    ]
    return df.groupBy(*keys).agg(
        *[aggregate(df, op, c, row, blank_as_zero).alias(out) for out, (op, c) in aggs.items()]
    )


def pivot(
    df: DataFrame,
    row_key: str,
    col_key: str,
    value: str,
    how: str = "sum",
    values: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Cross table with sorted column values; empty cells are 0 (null for ``first``)."""
    header = F.coalesce(text(col(col_key)), F.lit("null"))
    if values is None:
        # The header of the result, so bounded by what a table can be wide.
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = df.select(header.alias("v")).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{col_key} has more than {limit} values, too many for columns")
        values = sorted(r["v"] for r in found)
    t = dtype(df, value)
    if how == "count":
        cell, fill = F.count(F.lit(1)), F.lit(0)
    elif how == "sum":
        cell, fill = F.sum(F.coalesce(number(col(value), t), F.lit(0.0))), F.lit(0.0)
    elif how == "first":
        # The first value that counts as set, by row order.
        kept = F.when(truthy(col(value), t), F.col(row))
        cell, fill = F.min_by(col(value), kept), None
    else:
        raise ValueError(f"unknown pivot aggregate {how}")
    # One aggregate per (row, column) first: the wide step then only moves those.
    cells = df.groupBy(col(row_key), header.alias("_c")).agg(cell.alias("_v"))
    wide = cells.groupBy(row_key).pivot("_c", list(values)).agg(F.first("_v"))
    if fill is None:
        return wide
    finish = (lambda c: half_up(F.coalesce(c, fill))) if how == "sum" else (lambda c: F.coalesce(c, fill))
    return wide.select(col(row_key), *[finish(col(v)).alias(v) for v in values])


def cardinality(df: DataFrame, key: str | Column) -> DataFrame:
    """Value frequencies, most frequent first; an absent value is ``(undefined)``."""
    c = col(key) if isinstance(key, str) else key
    return (
        df.groupBy(F.coalesce(text(c), F.lit("(undefined)")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(col(c)).alias(c) for c in cols])


def distinct_keys(df: DataFrame, json_col: str) -> DataFrame:
    """The union of the object keys of a JSON text column."""
    return df.select(F.explode(F.json_object_keys(col(json_col))).alias("key")).distinct()


# Pieces a group is ranked in before its best rows meet.
PIECES = 32


def top_k(df: DataFrame, group: str, spread_by: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    A group is ranked in pieces first, so a group that holds most rows is not
    one task; at most ``k`` rows of each piece are ranked again.
    """
    piece = F.pmod(F.xxhash64(spread_by), F.lit(PIECES))
    pieces = Window.partitionBy(group, "_piece").orderBy(*order)
    best = df.withColumn("_piece", piece).withColumn("_rn", F.row_number().over(pieces)).filter(F.col("_rn") <= k)
    whole = Window.partitionBy(group).orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).drop("_piece", "_rn")


def top_values(long: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` values per column of a long table ``(column, value, _row)``; ties go to the value seen first."""
    counts = (
        long.groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.min(ROW).alias("_first"))
    )
    return top_k(counts, "column", "value", [F.desc("count"), "_first"], k).drop("_first")


# Share of the rows on each side of the middle that the bracket holds, and the
# sketch accuracy, whose error (1 / ACCURACY) is well inside it.
BRACKET = 0.001
ACCURACY = 10_000


def median(df: DataFrame, cols: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group, with no group held or sorted in one task.

    A sketch per group gives two values that are sure to enclose the middle.
    Rows below them are counted; only values between them, about 0.2 % of the
    rows, are placed by a running total over (group, value), and the one or two
    that cover the middle are kept.
    """
    names = [f"_g{i}" for i in range(len(cols))]
    v = number(col(value), dtype(df, value))
    data = df.select(*[col(c).alias(n) for c, n in zip(cols, names)], v.alias("_v")).filter(F.col("_v").isNotNull())
    bounds = data.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_size"),
        F.percentile_approx("_v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("_b"),
    )
    if names:
        marks = bounds.select(*[F.col(n).alias("_m" + n) for n in names], "_size", "_b")
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col("_m" + n)) for n in names])
        near = data.join(marks, same)
    else:
        near = data.withColumn("_s", bounds.select(F.struct("_size", "_b").alias("s")).scalar()).select("_v", "_s.*")
    low, high = F.col("_b")[0], F.col("_b")[1]
    # All values below the bracket count as one, so their rows are only counted.
    counts = (
        near.filter(F.col("_v") <= high)
        .groupBy(*names, "_size", F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running_total(counts, [*names, "_v"], F.col("_n"), "_before")
    starts = placed.groupBy(*names).agg(F.min("_before").alias("_start"))
    if names:
        firsts = starts.select(*[F.col(n).alias("_f" + n) for n in names], "_start")
        both = placed.join(firsts, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col("_f" + n)) for n in names]))
    else:
        both = placed.withColumn("_start", starts.scalar())
    at = F.col("_before") - F.col("_start")
    lower, upper = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    middle = both.filter(F.col("_v").isNotNull() & (at <= upper) & (at + F.col("_n") > lower))
    return (
        middle.groupBy(*names)
        .agg(F.avg("_v").alias(out))
        .select(*[F.col(n).alias(c) for n, c in zip(names, cols)], out)
    )
