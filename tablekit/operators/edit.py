"""Projection, filtering, row edits, sorting and union."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import (
    col,
    dtype,
    holds,
    is_number_type,
    natural_key,
    number,
    timestamp,
)
from tablekit.operators.rows import ROW, dense_rows

Predicate = Callable[[DataFrame], Column] | Column | Mapping[str, Any]


# --- projection -------------------------------------------------------------


def select(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep ``cols`` in that order; a name the table lacks becomes a null column."""
    have = set(df.columns)
    return df.select(
        [col(c) if c in have else F.lit(None).cast("string").alias(c) for c in cols]
    )


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    first = [c for c in order if c in df.columns]
    return df.select([col(c) for c in first + [c for c in df.columns if c not in first]])


# A driver-side list up to this length is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a table whose exact row count is known and low."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def reorder_rows(df: DataFrame, positions: Sequence[int], row: str = ROW) -> DataFrame:
    """Pick rows by dense position; repeats allowed, unknown positions skipped.

    ``row`` is the dense position column; the result gets new positions.
    """
    picks = df.sparkSession.createDataFrame(
        list(enumerate(positions)), "_new long, _old long"
    )
    return (
        df.join(small(picks, len(positions)), df[row] == F.col("_old"))
        .withColumn(row, F.col("_new"))
        .drop("_new", "_old")
    )


def transform(df: DataFrame, mapping: Mapping[str, Any]) -> DataFrame:
    """Build one output column per entry.

    A string is a column name or a dotted path into structs or variants, a
    callable takes the DataFrame and gives a Column, and a nested mapping
    becomes a struct.
    """
    return df.select([_mapped(df, v).alias(k) for k, v in mapping.items()])


def _mapped(df: DataFrame, source: Any) -> Column:
    if isinstance(source, Column):
        return source
    if callable(source):
        return source(df)
    if isinstance(source, Mapping):
        return F.struct(*[_mapped(df, v).alias(k) for k, v in source.items()])
    if source in df.columns:
        return col(source)
    head, _, rest = str(source).partition(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(dtype(df, head), T.VariantType):
        return F.try_variant_get(col(head), "$." + rest, "string")
    return F.col(str(source))


# --- filters ----------------------------------------------------------------


def like(c: Column, pattern: str, escape: bool = False) -> Column:
    """Case-insensitive contains-match where ``%`` stands for any text.

    Other regular-expression characters stay live unless ``escape`` is set.
    """
    parts = pattern.split("%")
    if escape:
        parts = [r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" if p else "" for p in parts]
    return c.cast("string").rlike("(?is)" + ".*".join(parts))


def _compare(c: Column, op: str, value: Any) -> Column:
    if op == "$eq":
        return c.eqNullSafe(F.lit(value))
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(value))
    if op == "$gt":
        return c > value
    if op == "$gte":
        return c >= value
    if op == "$lt":
        return c < value
    if op == "$lte":
        return c <= value
    if op == "$in":
        known = [v for v in value if v is not None]
        match = c.isin(known) if known else F.lit(False)
        return (match | c.isNull()) if len(known) < len(value) else match
    if op == "$like":
        return like(c, value)
    raise ValueError(f"unknown comparison {op}")


def predicate(df: DataFrame, where: Predicate) -> Column:
    """A Column from a callable, a Column, or ``{column: value | {op: value}}``."""
    if isinstance(where, Column):
        return where
    if callable(where):
        return where(df)
    tests: list[Column] = []
    for name, want in where.items():
        c = col(name) if name in df.columns else F.lit(None)
        if isinstance(want, Mapping):
            tests += [_compare(c, op, value) for op, value in want.items()]
        else:
            tests.append(c.eqNullSafe(F.lit(want)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_rows(df: DataFrame, where: Predicate) -> DataFrame:
    return df.filter(predicate(df, where))


# --- edits ------------------------------------------------------------------


def update(df: DataFrame, where: Predicate, values: Mapping[str, Any]) -> DataFrame:
    """Set ``values`` on the rows that match; new names become columns."""
    hit = holds(predicate(df, where))
    return df.withColumns(
        {
            name: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(
                col(name) if name in df.columns else F.lit(None)
            )
            for name, v in values.items()
        }
    )


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; the columns become the union of both sides."""
    return df.unionByName(rows, allowMissingColumns=True)


union_all = insert


def delete(df: DataFrame, where: Predicate) -> DataFrame:
    """Remove matching rows; a row whose test is unknown stays."""
    return df.filter(~holds(predicate(df, where)))


# --- order ------------------------------------------------------------------


def sort_key(df: DataFrame, name: str, kind: str = "auto") -> list[Column]:
    c, t = col(name), dtype(df, name)
    if kind == "number":
        return [number(c, t)]
    if kind == "date":
        return [c if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else timestamp(c)]
    if kind == "string" or (kind == "natural"):
        return [natural_key(c)]
    if isinstance(t, T.StringType):
        # Numbers by value first, then dates by time, then text in natural order.
        # The leading group number is null for a null cell, so nulls sort as nulls.
        n, d = number(c), timestamp(c)
        group = F.when(c.isNull(), None).when(n.isNotNull(), 0).when(d.isNotNull(), 1).otherwise(2)
        return [group, n, d, natural_key(c)]
    return [c]


def sort_order(
    df: DataFrame, name: str, direction: str = "asc", kind: str = "auto", nulls_last: bool = False
) -> list[Column]:
    """Sort orders: nulls first ascending and last descending, or always last."""
    descending = direction.lower() == "desc"
    keys = sort_key(df, name, kind)
    if nulls_last:
        return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    return [k.desc() if descending else k.asc() for k in keys]


def sort(
    df: DataFrame,
    name: str,
    direction: str = "asc",
    kind: str = "auto",
    nulls_last: bool = False,
    row: str = ROW,
) -> DataFrame:
    """Stable sort: ties keep the order of ``row`` when the table has it."""
    ties = [F.col(row)] if row in df.columns else []
    return df.orderBy(*sort_order(df, name, direction, kind, nulls_last), *ties)


def sort_sheet(df: DataFrame, name: str, direction: str = "asc", row: str = ROW) -> DataFrame:
    """Sheet order: nulls last in both directions."""
    return sort(df, name, direction, nulls_last=True, row=row)


def sort_transactions(
    df: DataFrame, name: str, direction: str = "asc", account: str = "account", row: str = ROW
) -> DataFrame:
    """Order transactions inside each account; amounts by value, the rest as text."""
    numeric = is_number_type(dtype(df, name))
    key = col(name) if numeric else F.coalesce(col(name).cast("string"), F.lit(""))
    ties = [F.col(row)] if row in df.columns else []
    return df.orderBy(
        F.col(account), key.desc() if direction.lower() == "desc" else key.asc(), *ties
    )


def with_position(df: DataFrame, order_by: Sequence[Column | str], name: str = "position") -> DataFrame:
    """The dense place of every row in a sort order."""
    return dense_rows(df, order_by, name)


def head(df: DataFrame, n: int = 15) -> DataFrame:
    """First rows only: the sampling verb."""
    return df.limit(n)


def head_items(c: Column, n: int = 50) -> Column:
    """First items of an array column."""
    return F.slice(c, 1, n)
