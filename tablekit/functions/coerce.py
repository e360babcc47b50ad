"""Coercion, rounding and blank rules shared by every operator.

The rules follow spreadsheet and CSV practice where it differs from SQL; each
helper returns a Column, so all of them stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell classes. These must equal the established ones for the
# same cells to be counted as the same type.
INT_CELL = r"^-?\d+$"
FLOAT_CELL = r"^-?\d+\.\d+([eE][+-]?\d+)?$"
BOOL_CELL = r"(?i)^(true|false)$"
NUMBER_CELL = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"

# Text formats.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HTTP_URL = r"(?i)^https?://[^\s$.?#].[^\s]*$"
ANY_URL = r"^[a-zA-Z][a-zA-Z0-9+-.]*://[^\s/$.?#].[^\s]*$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"

# Date texts that are recognised next to ISO dates and times; tried in order.
TIMESTAMP_FORMATS = ("yyyy/M/d", "yyyy/M/d HH:mm:ss", "M/d/yyyy", "M/d/yyyy HH:mm:ss", "MMM d, yyyy", "d MMM yyyy")
ISO_START = r"^\d{4}-\d{1,2}-\d{1,2}"


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def text(c: Column) -> Column:
    return c.cast("string")


# The characters that count as white space at a cell's ends.
WHITE = " \t\n\r\x0b\x0c\u00a0\u2028\u2029\ufeff"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.trim(text(c), F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def blank_cell(df: DataFrame, name: str) -> Column:
    """Blank test of a table's column; only text can be blank without being null."""
    c = col(name)
    return is_blank(c) if isinstance(dtype(df, name), T.StringType) else c.isNull()


def holds(pred: Column) -> Column:
    """A predicate with unknown taken as false."""
    return F.coalesce(pred, F.lit(False))


def number(c: Column, t: T.DataType | None = None, blank_as_zero: bool = False) -> Column:
    """Numeric value of a cell, null when it is not a number."""
    if t is not None and is_number_type(t):
        value = c.cast("double")
    elif isinstance(t, T.BooleanType):
        value = c.cast("int").cast("double")
    else:
        cell = strip(c)
        value = F.when(cell.rlike(NUMBER_CELL), cell.try_cast("double"))
        if blank_as_zero:
            value = F.when(F.lower(cell) == "true", F.lit(1.0)).when(
                F.lower(cell) == "false", F.lit(0.0)
            ).otherwise(value)
    if blank_as_zero:
        value = F.when(is_blank(c), F.lit(0.0)).otherwise(value)
    return value


def half_up(c: Column, places: int = 2) -> Column:
    """Round half toward plus infinity, as a double."""
    scale = float(10**places)
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale


def timestamp(c: Column) -> Column:
    """The instant a text names, null when it is neither ISO nor in a listed format."""
    cell = strip(c)
    others = [F.try_to_timestamp(cell, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.when(cell.rlike(ISO_START), cell.try_cast("timestamp")).when(
        cell.rlike(r"\d{4}"), F.coalesce(*others)
    )


def is_date_text(c: Column) -> Column:
    cell = strip(c)
    return (F.length(cell) >= 8) & cell.rlike("[/-]") & timestamp(c).isNotNull()


def natural_key(c: Column) -> Column:
    """Sort key under which digit runs compare by value and letters by base form."""
    tokens = F.regexp_extract_all(text(c), F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=.)", "")
        padded = F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(token.rlike(r"^\d"), padded).otherwise(F.lower(token))

    return F.collate(F.array_join(F.transform(tokens, part), ""), "UNICODE_CI_AI")


def truthy(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return c.isNotNull() & (c != "")
    if is_number_type(t):
        return c.isNotNull() & (c != 0)
    if isinstance(t, T.BooleanType):
        return holds(c)
    return c.isNotNull()
