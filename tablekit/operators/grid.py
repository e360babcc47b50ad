"""Spreadsheet cells as a long table.

``workbook, sheet, row, col, value (text), vtype, formula`` with rows and
columns counted from 1. ``vtype`` is number, string, boolean, date, error or
empty.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import BOOL_CELL, NUMBER_CELL, col, strip
from tablekit.operators.edit import small

SHEET = ["workbook", "sheet"]
# Tasks that one sheet's rows are spread over when joined with its header.
SPREAD = 32


def has_content(with_formula: bool = False) -> Column:
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    return filled | F.col("formula").isNotNull() if with_formula else filled


def records(cells: DataFrame) -> DataFrame:
    """Rows below the header as ``workbook, sheet, row, record map<string,string>``.

    Row 1 is the header, a blank header becomes ``col_N``, blank rows are left
    out. A sheet that holds most rows is spread over several tasks: its header
    is repeated once per spread, the rows are not.
    """
    body = cells.filter("row > 1").groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_cells"),
        F.max(has_content()).alias("_filled"),
    )
    width = cells.groupBy(*SHEET).agg(F.max("col").alias("_width"))
    heads = (
        cells.filter("row = 1")
        .groupBy(*SHEET)
        .agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_head"))
        .join(width, SHEET, "right")
    )
    names = F.transform(
        F.sequence(F.lit(1), F.col("_width")),
        lambda i: F.coalesce(
            F.trim(F.try_element_at("_head", i)), F.concat(F.lit("col_"), i.cast("string"))
        ),
    )
    heads = heads.select(*SHEET, names.alias("_names")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    )
    salted = body.filter("_filled").withColumn("_salt", (F.col("row") % SPREAD).cast("int"))
    pairs = F.transform(
        F.col("_names"), lambda n, i: F.struct(n.alias("k"), F.try_element_at("_cells", i + 1).alias("v"))
    )
    # The last of two equal headers wins.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice("_names", i + 2, F.size("_names")), lambda n: n == p["k"]))
    return salted.join(heads, [*SHEET, "_salt"]).select(
        *SHEET, "row", F.map_from_entries(last).alias("record")
    )


def record_columns(recs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records as columns, for a sheet whose header is known."""
    return recs.select(*SHEET, "row", *[F.try_element_at("record", F.lit(n)).alias(n) for n in names])


def cell_type(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(strip(value).rlike(NUMBER_CELL), "number")
        .when(strip(value).rlike(BOOL_CELL), "boolean")
        .otherwise("string")
    )


def cells_of(df: DataFrame, workbook: str, sheet: str, row: str) -> DataFrame:
    """Cells of a table: header in row 1, data below by dense position ``row`` from 0."""
    names = [c for c in df.columns if c != row]
    data = df.select(
        (F.col(row) + 2).cast("int").alias("row"),
        F.posexplode(F.array(*[col(c).cast("string") for c in names])).alias("i", "value"),
    )
    head = df.sparkSession.createDataFrame([(1, i, n) for i, n in enumerate(names)], "row int, i int, value string")
    return head.unionByName(data).select(
        F.lit(workbook).alias("workbook"),
        F.lit(sheet).alias("sheet"),
        "row",
        (F.col("i") + 1).alias("col"),
        "value",
        cell_type(F.col("value")).alias("vtype"),
        F.lit(None).cast("string").alias("formula"),
    )


# --- addresses --------------------------------------------------------------


def parse_address(address: str) -> tuple[int, int]:
    """Row and column of an address such as ``B12`` or ``$B$12``."""
    found = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", address.strip())
    if not found or int(found[2]) < 1:
        raise ValueError(f"bad cell address {address!r}")
    number = 0
    for letter in found[1].upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return int(found[2]), number


def column_letters(c: Column) -> Column:
    """Letters of a column number; sheets have at most three."""
    n = c - 1
    one = F.char(F.lit(65) + n % 26)
    two = F.char(F.lit(65) + F.floor(n / 26 - 1) % 26)
    three = F.char(F.lit(65) + F.floor(n / 676 - 1 / 26 - 1) % 26)
    return F.when(n < 26, one).when(n < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def address(row: Column, c: Column) -> Column:
    return F.concat(column_letters(c), row.cast("string"))


def column_number(letters: Column) -> Column:
    """The number of a column from its letters."""
    place = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(F.filter(place, lambda n: n > 0), F.lit(0), lambda total, n: total * 26 + n)


def set_cells(
    cells: DataFrame, workbook: str, sheet: str, values: Mapping[str, Any], formulas: Mapping[str, str] | None = None
) -> DataFrame:
    """Set values or formulas at addresses; cells that are not there yet are added."""
    rows = [(*parse_address(a), None if v is None else _cell_text(v), None) for a, v in values.items()]
    rows += [(*parse_address(a), None, f.removeprefix("=")) for a, f in (formulas or {}).items()]
    edits = cells.sparkSession.createDataFrame(rows, "row int, col int, _value string, _formula string").select(
        F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), "*"
    )
    key = [*SHEET, "row", "col"]
    kept = cells.join(small(edits.select(*key), len(rows)), key, "left_anti")
    new = edits.select(
        *key,
        F.col("_value").alias("value"),
        cell_type(F.col("_value")).alias("vtype"),
        F.col("_formula").alias("formula"),
    )
    return kept.unionByName(new)


def _cell_text(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


# --- sheets -----------------------------------------------------------------


def rename_sheets(cells: DataFrame, names: Mapping[str, str]) -> DataFrame:
    new = F.col("sheet")
    for old, to in names.items():
        new = F.when(F.col("sheet") == old, to).otherwise(new)
    return cells.withColumn("sheet", new)


def order_sheets(cells: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``sheet_no``: the listed sheets first, the others after them."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("sheet"))
    return cells.withColumn("sheet_no", F.when(place > 0, place).otherwise(len(order) + 1))


def dimensions(cells: DataFrame) -> DataFrame:
    """Used range per sheet."""
    return cells.groupBy(*SHEET).agg(
        F.max("row").alias("rows"), F.max("col").alias("cols"), F.count(F.lit(1)).alias("cells")
    ).withColumn("range", F.concat(F.lit("A1:"), address(F.col("rows"), F.col("cols"))))


# Rows and columns of a tile, by which cells meet the ranges over them.
TILE = (256, 16)


def merged_ranges(merges: DataFrame, ref: str = "ref") -> DataFrame:
    """``workbook, sheet, merge, row1, col1, row2, col2`` of ranges such as ``B2:D4``, each once.

    Corners may come in any order, with or without ``$``; ``merge`` names the
    range from its upper left to its lower right cell. What is no range is left out.
    """
    corner = r"^\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?$"
    text = F.upper(F.trim(ref))
    part = lambda i: F.regexp_extract(text, corner, i)
    a, b = column_number(part(1)), part(2).cast("int")
    c = F.when(part(3) != "", column_number(part(3))).otherwise(a)
    d = F.when(part(4) != "", part(4).try_cast("int")).otherwise(b)
    found = merges.filter(text.rlike(corner)).select(
        *SHEET, F.least(b, d).alias("row1"), F.least(a, c).alias("col1"), F.greatest(b, d).alias("row2"), F.greatest(a, c).alias("col2")
    )
    name = F.concat(address(F.col("row1"), F.col("col1")), F.lit(":"), address(F.col("row2"), F.col("col2")))
    return found.distinct().select(*SHEET, name.alias("merge"), "row1", "col1", "row2", "col2")


def with_merges(cells: DataFrame, merges: DataFrame, ref: str = "ref") -> DataFrame:
    """Cells with ``merge``, the merged range that covers them, and ``master``, whether they are its upper left cell.

    Ranges and cells meet by the tiles of the sheet that they lie in, so a large
    sheet is spread over many tasks. Of ranges that overlap the one that begins
    first, by row and then column, counts.
    """
    tall, wide = TILE
    tiles = merged_ranges(merges, ref).withColumn("_tr", F.explode(F.sequence(F.floor(F.col("row1") / tall), F.floor(F.col("row2") / tall))))
    tiles = tiles.withColumn("_tc", F.explode(F.sequence(F.floor(F.col("col1") / wide), F.floor(F.col("col2") / wide))))
    placed = cells.select(*SHEET, "row", "col", F.floor(F.col("row") / tall).alias("_tr"), F.floor(F.col("col") / wide).alias("_tc"))
    inside = F.col("row").between(F.col("row1"), F.col("row2")) & F.col("col").between(F.col("col1"), F.col("col2"))
    covered = placed.join(tiles, [*SHEET, "_tr", "_tc"]).filter(inside).groupBy(*SHEET, "row", "col").agg(
        F.min(F.struct("row1", "col1", "row2", "col2", "merge")).alias("_m")
    )
    master = (F.col("row") == F.col("_m.row1")) & (F.col("col") == F.col("_m.col1"))
    return cells.join(covered, [*SHEET, "row", "col"], "left").withColumns(
        {"merge": F.col("_m.merge"), "master": F.coalesce(master, F.lit(False))}
    ).drop("_m")


def profile(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Cell counts by type per sheet, with dimensions; with ``merges`` also the number of merged ranges."""
    if merges is not None:
        counts = merged_ranges(merges).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("merges"))
        return profile(cells).join(counts, SHEET, "left").withColumn("merges", F.coalesce("merges", F.lit(0)))
    filled = has_content()

    def n(kind: str) -> Column:
        return F.count_if(filled & (F.col("vtype") == kind))

    return cells.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("cells"),
        n("number").alias("numbers"),
        (n("string") + n("error")).alias("strings"),
        n("boolean").alias("booleans"),
        n("date").alias("dates"),
        F.count("formula").alias("formulas"),
        F.count_if(~filled).alias("empties"),
        F.max("row").alias("rows"),
        F.max("col").alias("cols"),
    )


def formula_inventory(cells: DataFrame) -> DataFrame:
    name = F.upper(F.regexp_replace(F.split("formula", r"\(")[0], "^=", ""))
    return (
        cells.filter(F.col("formula").isNotNull()).groupBy(*SHEET, name.alias("function")).agg(F.count(F.lit(1)).alias("uses"))
    )


def clean(cells: DataFrame, trim: bool = True, headers: bool = False) -> DataFrame:
    """Trim texts, drop blank rows and number the rest without gaps per sheet.

    Gaps are closed by counting the kept rows before each row; the count runs
    over one entry per row, range-sorted, so a large sheet is not one task.
    """
    from tablekit.operators.rows import dense_rows

    out = cells
    if trim:
        out = out.withColumn("value", F.when(F.col("vtype") == "string", strip(F.col("value"))).otherwise(F.col("value")))
    if headers:
        tidy = F.regexp_replace(F.lower(F.trim("value")), r"[^a-z0-9]+", "_")
        out = out.withColumn("value", F.when(F.col("row") == 1, tidy).otherwise(F.col("value")))
    filled = out.groupBy(*SHEET, "row").agg(F.max(has_content()).alias("_f")).filter("_f").drop("_f")
    placed = dense_rows(filled, [*SHEET, "row"], "_pos")
    first = placed.groupBy(*SHEET).agg(F.min("_pos").alias("_first"))
    new = placed.join(first, SHEET).select(*SHEET, "row", (F.col("_pos") - F.col("_first") + 1).cast("int").alias("_new"))
    return out.join(new, [*SHEET, "row"]).withColumn("row", F.col("_new")).drop("_new")


def trim_to_used(cells: DataFrame) -> DataFrame:
    """Drop empty cells past the last row and column that hold anything."""
    used = cells.filter(has_content(True)).groupBy(*SHEET).agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    return cells.join(used, SHEET).filter((F.col("row") <= F.col("_r")) & (F.col("col") <= F.col("_c"))).drop("_r", "_c")


# --- dates ------------------------------------------------------------------

# Fixed value: the day that serial number 0 stands for.
EPOCH = "1899-12-30"
EPOCH_SECONDS = -2209161600


def serial_to_timestamp(c: Column) -> Column:
    """Instant of a serial number, to the millisecond."""
    millis = F.round(c.cast("double") * 86400000).cast("bigint")
    return F.timestamp_millis(millis + EPOCH_SECONDS * 1000)


def timestamp_to_serial(c: Column) -> Column:
    """Serial number of an instant, with the time of day as a fraction."""
    millis = F.unix_millis(c.cast("timestamp"))
    return (millis - EPOCH_SECONDS * 1000) / 86400000.0


def date_to_serial(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit(EPOCH).cast("date"))
