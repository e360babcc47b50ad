"""Row order: ordinals, dense positions and running totals without a global window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.session import cut

ROW = "_row"


def with_row(df: DataFrame, name: str = ROW) -> DataFrame:
    """Add an ordinal that grows with read order; it has gaps."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


# Rows of a table that one task gets for costly row-local work.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deal a table over all cores, ``rows`` rows a task at most.

    For costly row-local work. The partitions of a scan tell little: a file of
    few row groups is cut into many, of which most are empty. The rows are
    counted (which takes the file footers) and dealt in turn, so a task's work
    stays the same however large the table is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def running_total(
    df: DataFrame, order_by: Sequence[str | Column], weight: Column | Mapping[str, Column], out: str = ""
) -> DataFrame:
    """Add the sum of ``weight`` over all rows that sort before this one.

    The rows are range-partitioned on ``order_by`` (which must identify a row,
    so that no key can fill one partition), written once, and summed inside
    each partition. Only one row per partition takes part in the step that
    turns partition sums into offsets. Several sums are given as ``{out: weight}``.
    """
    weights = dict(weight) if isinstance(weight, Mapping) else {out: weight}
    w = {name: f"_rt_w{i}" for i, name in enumerate(weights)}
    placed = _placed(df.withColumns({w[n]: c for n, c in weights.items()}), order_by).withColumn(
        "_rt_part", F.shiftright("_rt_id", 33)
    )
    sums = placed.groupBy("_rt_part").agg(*[F.sum(w[n]).alias("_rt_s" + n) for n in weights])
    # One row per partition: its size is the partition count, never the data.
    before = Window.orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_rt_part",
        *[F.coalesce(F.sum("_rt_s" + n).over(before), F.lit(0)).alias("_rt_o" + n) for n in weights],
    )
    inside = Window.partitionBy("_rt_part").orderBy("_rt_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = {
        n: (F.col("_rt_o" + n) + F.coalesce(F.sum(w[n]).over(inside), F.lit(0))).cast("bigint") for n in weights
    }
    return (
        placed.join(F.broadcast(offsets), "_rt_part")
        .withColumns(totals)
        .drop("_rt_id", "_rt_part", *w.values(), *["_rt_o" + n for n in weights])
    )


def dense_rows(
    df: DataFrame, order_by: Sequence[str | Column], name: str = ROW, start: int = 0
) -> DataFrame:
    """Number the rows 0, 1, 2 … in the given order.

    Needs no window: after the range sort the low 33 bits of the row id are the
    place inside the partition.
    """
    placed = _placed(df, order_by)
    part = F.shiftright("_rt_id", 33)
    sizes = placed.groupBy(part.alias("_rt_part")).agg(F.count(F.lit(1)).alias("_rt_n"))
    # One row per partition: its size is the partition count, never the data.
    before = Window.orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_rt_part", F.coalesce(F.sum("_rt_n").over(before), F.lit(0)).alias("_rt_offset")
    )
    local = F.col("_rt_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_rt_part", part)
        .join(F.broadcast(offsets), "_rt_part")
        .withColumn(name, F.col("_rt_offset") + local + F.lit(start))
        .drop("_rt_id", "_rt_part", "_rt_offset")
    )


def _placed(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """The rows range-sorted and written once, with ``_rt_id`` = partition * 2^33 + place."""
    return cut(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_rt_id", F.monotonically_increasing_id())
    )
