"""Column profiles, dataset anomalies, file overviews and log audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import (
    BOOL_CELL,
    FLOAT_CELL,
    INT_CELL,
    blank_cell,
    col,
    half_up,
    is_date_text,
    strip,
)
from tablekit.operators.agg import top_k
from tablekit.operators.rows import ROW


def long_cells(df: DataFrame, cols: Sequence[str] | None = None, row: str = ROW) -> DataFrame:
    """One row per cell: ``column, value, _row``; blank cells have a null value."""
    cols = [c for c in (cols or df.columns) if c != row]
    keep = [F.col(row).alias(ROW)] if row in df.columns else []
    cells = df.select(*keep, *[F.nullif(strip(col(c)), F.lit("")).alias(c) for c in cols])
    return cells.unpivot([ROW] if keep else [], [col(c) for c in cols], "column", "value")


def cell_class(value: Column) -> Column:
    """boolean, integer, float, date or string."""
    return (
        F.when(value.rlike(BOOL_CELL), "boolean")
        .when(value.rlike(INT_CELL), "integer")
        .when(value.rlike(FLOAT_CELL), "float")
        .when(is_date_text(value), "date")
        .otherwise("string")
    )


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, row: str = ROW) -> DataFrame:
    """How often each value of each column occurs, and where it is first seen."""
    cells = long_cells(df, cols, row)
    first = [F.min(ROW).alias("first_row")] if ROW in cells.columns else []
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *first)


def column_profile(
    df: DataFrame, cols: Sequence[str] | None = None, row: str = ROW, counts: DataFrame | None = None
) -> DataFrame:
    """Counts, type classes, distinct values and number or length statistics per column.

    Equal values are counted first; everything else about a value depends on
    the value alone, so the tests run once per distinct value and the exact
    distinct count is a plain row count. Pass ``counts`` to share that step.
    """
    counts = counts if counts is not None else value_counts(df, cols, row)
    present = F.col("value").isNotNull()
    kind = F.when(present, cell_class(F.col("value")))
    classed = counts.withColumn("kind", kind).withColumn(
        "num", F.when(F.col("kind").isin("integer", "float"), F.col("value").try_cast("double"))
    )

    def n_of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    length = F.when(present, F.length("value"))
    totals = classed.groupBy("column").agg(
        F.sum("n").alias("total"),
        n_of(present).alias("non_null"),
        n_of(~present).alias("missing"),
        F.count("value").alias("distinct_values"),
        *[
            n_of(F.col("kind") == k).alias(f"{k}_cells")
            for k in ("integer", "float", "boolean", "date", "string")
        ],
        F.min("num").alias("_min"),
        F.max("num").alias("_max"),
        F.sum(F.col("num") * F.col("n")).alias("_sum"),
        F.min(length).alias("_short"),
        F.max(length).alias("_long"),
    )
    some = F.col("non_null")
    numbers = F.col("integer_cells") + F.col("float_cells")
    inferred = (
        F.when(some == 0, "string")
        .when(F.col("integer_cells") == some, "integer")
        .when(numbers == some, "number")
        .when(F.col("boolean_cells") == some, "boolean")
        .when(F.col("date_cells") == some, "date")
        .when(numbers / some > 0.8, "mixed (predominantly numeric)")
        .otherwise("string")
    )
    textual = (numbers == 0) & (some > 0)
    return totals.select(
        "column",
        "total",
        "non_null",
        "missing",
        (F.col("missing") / F.col("total")).alias("missing_rate"),
        "distinct_values",
        F.when(some > 0, half_up(F.col("distinct_values") / some)).otherwise(0.0).alias("cardinality_ratio"),
        "integer_cells",
        "float_cells",
        "boolean_cells",
        "date_cells",
        "string_cells",
        inferred.alias("inferred_type"),
        F.col("_min").alias("min_value"),
        F.col("_max").alias("max_value"),
        F.when(numbers > 0, half_up(F.col("_sum") / numbers)).alias("avg_value"),
        half_up(F.col("_sum")).alias("sum_value"),
        F.when(textual, F.col("_short")).alias("min_length"),
        F.when(textual, F.col("_long")).alias("max_length"),
    )


def top_frequencies(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    k: int = 3,
    row: str = ROW,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` most frequent values per column, ties to the first seen."""
    counts = counts if counts is not None else value_counts(df, cols, row)
    ties = ["first_row"] if "first_row" in counts.columns else ["value"]
    # One row per column of the table.
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    best = top_k(counts.filter(F.col("value").isNotNull()), "column", "value", [F.desc("n"), *ties], k)
    return best.join(F.broadcast(totals), "column").select(
        "column",
        "rank",
        "value",
        F.col("n").alias("count"),
        half_up(F.col("n") / F.col("total") * 100, 0).cast("int").alias("percentage"),
    )


def duplicate_rows(df: DataFrame, row: str = ROW) -> DataFrame:
    """How many rows repeat an earlier one."""
    data = [col(c) for c in df.columns if c != row]
    return df.groupBy(*data).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )


def anomalies(df: DataFrame, row: str = ROW, threshold: float = 0.5) -> DataFrame:
    """DUPLICATE_ROWS and HIGH_MISSING_RATE findings: ``type, column, count, rate``."""
    repeats = (
        duplicate_rows(df, row)
        .filter("duplicates > 0")
        .select(
            F.lit("DUPLICATE_ROWS").alias("type"),
            F.lit(None).cast("string").alias("column"),
            F.col("duplicates").alias("count"),
            F.lit(None).cast("double").alias("rate"),
        )
    )
    return repeats.unionByName(
        missing_rates(df, row)
        .filter(F.col("rate") > threshold)
        .select(F.lit("HIGH_MISSING_RATE").alias("type"), "column", F.col("missing").alias("count"), "rate")
    )


def missing_rates(df: DataFrame, row: str = ROW, blank: bool = True) -> DataFrame:
    """Missing cells per column, ``column, missing, rate``, from one aggregate row."""
    cols = [c for c in df.columns if c != row]
    test = (lambda c: blank_cell(df, c)) if blank else (lambda c: col(c).isNull())
    one = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(test(c)).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)]
    return (
        one.select("_total", F.inline(F.array(*entries)))
        .withColumn("rate", F.when(F.col("_total") > 0, F.col("missing") / F.col("_total")).otherwise(0.0))
        .drop("_total")
    )


# Fixed value: share of the raw size a compressed text file is expected to take.
GZIP_SHARE = 0.35


# --- logs -------------------------------------------------------------------

LOG_LEVEL = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b"


def log_level(line: Column) -> Column:
    level = F.upper(F.regexp_extract(line, "(?i)" + LOG_LEVEL, 1))
    return F.when(level == "", "NONE").when(level == "WARNING", "WARN").otherwise(level)


def log_template(line: Column) -> Column:
    """The message with quoted texts, hexadecimal ids and numbers replaced by marks."""
    out = F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "<text>")
    out = F.regexp_replace(out, r"\b0x[0-9a-fA-F]+\b", "<hex>")
    return F.regexp_replace(out, r"\d+(\.\d+)?", "<n>")


def log_audit(df: DataFrame, line_col: str = "value") -> DataFrame:
    """Lines per level and message template, with the first example by text order."""
    line = col(line_col)
    return (
        df.select(log_level(line).alias("level"), log_template(line).alias("template"), line.alias("_line"))
        .groupBy("level", "template")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("_line").alias("example"))
    )
