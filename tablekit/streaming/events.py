"""The table verbs on streams.

Row-local verbs (filters, edits, trimming, filling, row rules without
``unique``) take a streaming DataFrame as it is. What needs state has a
watermark, so that the state stays bounded and late rows are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.operators import rules
from tablekit.operators.ledger import MONEY
from tablekit.operators.profile import log_level, log_template


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what has arrived since the last run with this checkpoint, and give the whole result so far.

    Both folders must be shared by all executors. A run that is cut short goes
    on where it stopped; results are written once.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def validate(stream: DataFrame, row_rules: Mapping[str, Mapping[str, Any]], row: str) -> DataFrame:
    """Row rules on a stream; ``unique`` needs the whole table and is refused."""
    if any(r.get("unique") for r in row_rules.values()):
        raise ValueError("unique needs all rows; use deduplicate on a stream")
    return rules.validate(stream, row_rules, row)


def deduplicate(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Keep one row per key among rows that arrive within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def cashflow(stream: DataFrame, time: str, window: str = "1 day", delay: str = "1 day", amount: str = "amount") -> DataFrame:
    """Inflow, outflow and net per window."""
    a = F.col(amount).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, window))
    return grouped.agg(
        F.sum(F.when(a > 0, a).otherwise(zero)).alias("inflow"),
        F.sum(F.when(a <= 0, -a).otherwise(zero)).alias("outflow"),
        F.sum(a).alias("net"),
    ).select("window.start", "window.end", "inflow", "outflow", "net")


def log_counts(stream: DataFrame, time: str, line: str = "value", window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Lines per level and template in each window."""
    marked = stream.withWatermark(time, delay).select(
        time, log_level(F.col(line)).alias("level"), log_template(F.col(line)).alias("template")
    )
    return marked.groupBy(F.window(time, window), "level", "template").agg(F.count(F.lit(1)).alias("lines")).select(
        "window.start", "window.end", "level", "template", "lines"
    )
