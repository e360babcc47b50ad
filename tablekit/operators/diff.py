"""Table, schema, page, cell-grid and line differences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import col, strip, text
from tablekit.operators.joins import comparison_join, positional_join
from tablekit.operators.rows import ROW


def normal(c: Column, ignore_whitespace: bool = True, ignore_case: bool = False) -> Column:
    """The text two cells are compared by; null compares as empty."""
    value = strip(c) if ignore_whitespace else text(c)
    value = F.lower(value) if ignore_case else value
    return F.coalesce(value, F.lit(""))


def table_diff(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] | None = None,
    row: str = ROW,
    ignore_whitespace: bool = True,
    ignore_case: bool = False,
) -> DataFrame:
    """Status per row and the changed cells: ``status, changes, a, b`` plus the key.

    With ``keys`` rows are matched on them (last duplicate wins), otherwise by
    dense position ``row``. ``changes`` lists ``(column, old, new)`` over the
    common columns.
    """

    def norm(c: Column) -> Column:
        return normal(c, ignore_whitespace, ignore_case)

    common = [c for c in a.columns if c in b.columns and c != row]
    if keys:
        paired = comparison_join(a, b, keys, row, norm)
        compared = [c for c in common if c not in keys]
    else:
        paired, compared = positional_join(a, b, row), common
    cells = [
        F.when(
            norm(F.col("a")[c]) != norm(F.col("b")[c]),
            F.struct(
                F.lit(c).alias("column"), text(F.col("a")[c]).alias("old"), text(F.col("b")[c]).alias("new")
            ),
        )
        for c in compared
    ]
    changes = F.array_compact(F.array(*cells)) if cells else F.array().cast(
        "array<struct<column:string,old:string,new:string>>"
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    with_changes = paired.withColumn("changes", F.when(both, changes))
    status = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(F.size("changes") > 0, "modified")
        .otherwise("unchanged")
    )
    lead = [c for c in paired.columns if c not in ("a", "b")]
    named = {f"_key{i}": k for i, k in enumerate(keys or [])}
    return with_changes.select(
        *[F.col(c).alias(named.get(c, c)) for c in lead], status.alias("status"), "changes", "a", "b"
    )


def cell_changes(diff: DataFrame) -> DataFrame:
    """One row per changed cell of a table diff."""
    lead = [c for c in diff.columns if c not in ("status", "changes", "a", "b")]
    return diff.filter("status = 'modified'").select(*[col(c) for c in lead], F.inline("changes"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Totals per status and whether both tables hold the same rows."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return diff.agg(
        F.count("a").alias("total_a"),
        F.count("b").alias("total_b"),
        n("added").alias("added"),
        n("removed").alias("removed"),
        n("modified").alias("modified"),
        n("unchanged").alias("unchanged"),
        (F.count_if(F.col("status") != "unchanged") == 0).alias("identical"),
    )


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added, removed or common, and whether both lists are the same in order."""
    same = a.columns == b.columns
    rows = (
        [("added", c, same) for c in b.columns if c not in a.columns]
        + [("removed", c, same) for c in a.columns if c not in b.columns]
        + [("common", c, same) for c in a.columns if c in b.columns]
    )
    return a.sparkSession.createDataFrame(rows, "status string, column string, identical boolean")


# --- pages ------------------------------------------------------------------


def page_diff(
    a: DataFrame, b: DataFrame, doc: str = "doc", page: str = "page_no"
) -> DataFrame:
    """Pages added, removed or modified between two page tables, with what differs.

    Page size is compared when both tables have ``width`` and ``height``.
    """
    sized = all(c in t.columns for t in (a, b) for c in ("width", "height"))
    cols = ["text"] + (["width", "height"] if sized else [])
    left = a.select(doc, page, F.struct(*cols).alias("a"))
    right = b.select(doc, page, F.struct(*cols).alias("b"))
    size_match = (
        F.col("a.width").eqNullSafe(F.col("b.width")) & F.col("a.height").eqNullSafe(F.col("b.height"))
        if sized
        else F.lit(True)
    )
    text_match = strip(F.col("a.text")).eqNullSafe(strip(F.col("b.text")))
    joined = left.join(right, [doc, page], "full_outer")
    change = (
        F.when(F.col("a").isNull(), "ADDED_PAGE")
        .when(F.col("b").isNull(), "REMOVED_PAGE")
        .when(~(size_match & text_match), "MODIFIED")
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.select(
        doc,
        page,
        change.alias("change"),
        F.when(both, size_match).alias("size_match"),
        F.when(both, text_match).alias("text_match"),
    ).filter(F.col("change").isNotNull())


# --- cell grids -------------------------------------------------------------


def grid_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Value and formula changes per cell address of two cells tables."""
    key = ["workbook", "sheet", "row", "col"]
    left = a.select(*key, F.struct("value", "formula").alias("a"))
    right = b.select(*key, F.struct("value", "formula").alias("b"))
    joined = left.join(right, key, "full_outer")
    value_change = ~F.col("a.value").eqNullSafe(F.col("b.value"))
    formula_change = ~F.col("a.formula").eqNullSafe(F.col("b.formula"))
    return joined.filter(value_change | formula_change).select(
        *key,
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .otherwise("modified")
        .alias("status"),
        F.col("a.value").alias("old_value"),
        F.col("b.value").alias("new_value"),
        F.col("a.formula").alias("old_formula"),
        F.col("b.formula").alias("new_formula"),
    )


def sheet_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sheets that only one of two workbooks has."""
    key = ["workbook", "sheet"]
    left = a.select(*key).distinct().withColumn("_a", F.lit(True))
    right = b.select(*key).distinct().withColumn("_b", F.lit(True))
    return (
        left.join(right, key, "full_outer")
        .filter(F.col("_a").isNull() | F.col("_b").isNull())
        .select(*key, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("status"))
    )


# --- text lines -------------------------------------------------------------


def lines_of(
    c: Column, ignore_whitespace: bool = False, ignore_case: bool = False, ignore_endings: bool = True
) -> Column:
    """The lines of a text as an array, normalised as asked."""
    out = F.split(c, r"\r\n|\r|\n" if ignore_endings else "\n", -1)
    if ignore_whitespace:
        out = F.transform(out, lambda s: F.regexp_replace(strip(s), r"\s+", " "))
    if ignore_case:
        out = F.transform(out, F.lower)
    return out


def line_counts_diff(
    a: DataFrame, b: DataFrame, doc: str, text_col: str = "text", **options
) -> DataFrame:
    """Lines added to and removed from each document, by how often each line occurs.

    One counting pass over both sides: a line that repeats costs one row per task.
    """

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            doc, F.explode(lines_of(col(text_col), **options)).alias("line"), F.lit(sign).alias("_s")
        )

    return (
        side(a, -1)
        .unionByName(side(b, 1))
        .groupBy(doc, "line")
        .agg(F.sum("_s").alias("_n"))
        .filter("_n <> 0")
        .select(
            doc,
            "line",
            F.when(F.col("_n") > 0, "added").otherwise("removed").alias("status"),
            F.abs("_n").alias("times"),
        )
    )


def line_edits(
    a: DataFrame, b: DataFrame, doc: str, text_col: str = "text", **options
) -> DataFrame:
    """Ordered edit script per document pair: ``op, old_line, new_line, text``.

    Spark pairs the documents; each pair is compared inside its own row.
    """
    pairs = a.select(doc, lines_of(col(text_col), **options).alias("_old")).join(
        b.select(doc, lines_of(col(text_col), **options).alias("_new")), doc
    )
    changed = pairs.filter(F.col("_old") != F.col("_new"))
    key_type = a.schema[doc].dataType.simpleString()

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, old, new in zip(batch[doc], batch["_old"], batch["_new"]):
                out.extend((key, *e) for e in _edit_script(list(old), list(new)))
            yield pd.DataFrame(out, columns=[doc, "op", "old_line", "new_line", "text"]).astype(
                {"old_line": "Int64", "new_line": "Int64"}
            )

    return changed.mapInPandas(
        edits, f"`{doc}` {key_type}, op string, old_line long, new_line long, text string"
    )


def _edit_script(old: list[str], new: list[str]) -> Iterator[tuple]:
    """Deletions and insertions that turn ``old`` into ``new``, in order (1-based lines)."""
    import difflib

    match = difflib.SequenceMatcher(None, old, new, autojunk=False)
    for op, a0, a1, b0, b1 in match.get_opcodes():
        if op != "equal":
            for i in range(a0, a1):
                yield "delete", i + 1, None, old[i]
            for j in range(b0, b1):
                yield "insert", None, j + 1, new[j]


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
