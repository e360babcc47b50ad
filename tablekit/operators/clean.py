"""Cleaning of tables: trimming, headers, dedup, empty rows and columns, filling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import blank_cell, col, dtype, strip
from tablekit.operators.joins import keep_first
from tablekit.operators.rows import ROW


def trim_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    names = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(col(c)) for c in names})


def header_name(name: str, style: str) -> str:
    """A header in ``snake_case``, ``camelCase``, ``lower`` or ``upper`` style."""
    name = name.strip()
    if style == "lower":
        return name.lower()
    if style == "upper":
        return name.upper()
    if style == "snake_case":
        split = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name)
        return re.sub(r"[^A-Za-z0-9_]+", "_", split).lower().strip("_")
    if style == "camelCase":
        first, *rest = [w for w in re.split(r"[^A-Za-z0-9]+", name) if w] or [""]
        return first[:1].lower() + first[1:] + "".join(w[0].upper() + w[1:] for w in rest)
    return name


def normalise_headers(df: DataFrame, style: str = "snake_case") -> DataFrame:
    return df.toDF(*unique_headers([c if c == ROW else header_name(c, style) for c in df.columns]))


def unique_headers(names: Sequence[str]) -> list[str]:
    """Blank headers become ``column``; repeats get ``_2``, ``_3`` …"""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = name or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def dedup(df: DataFrame, by: str | Sequence[str] | None = None, row: str = ROW) -> DataFrame:
    """Keep the first row of each key, or of each distinct row."""
    keys = [by] if isinstance(by, str) else list(by or [c for c in df.columns if c != row])
    if row not in df.columns:
        return df.dropDuplicates(keys)
    if by is None:
        return df.groupBy(*[col(k) for k in keys]).agg(F.min(row).alias(row)).select(
            *[col(c) for c in df.columns]
        )
    return keep_first(df, keys, row)


def drop_empty_rows(df: DataFrame, row: str = ROW) -> DataFrame:
    blank = F.lit(True)
    for c in df.columns:
        if c != row:
            blank = blank & blank_cell(df, c)
    return df.filter(~blank)


def drop_empty_columns(df: DataFrame, row: str = ROW) -> DataFrame:
    """Drop columns without any value; one aggregate row decides."""
    names = [c for c in df.columns if c != row]
    seen = df.agg(*[F.max(~blank_cell(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return df.drop(*[c for i, c in enumerate(names) if not seen[f"c{i}"]])


def fill_missing(df: DataFrame, fill: Any | Mapping[str, Any]) -> DataFrame:
    """Replace null and blank cells by one value, or by a value per column.

    A value that does not fit a typed column is skipped for that column.
    """
    per_column = fill if isinstance(fill, Mapping) else {c: fill for c in df.columns if c != ROW}
    out = {}
    for name, value in per_column.items():
        if name in df.columns:
            t = dtype(df, name)
            new = F.lit(value).try_cast(t)
            out[name] = F.when(blank_cell(df, name), F.coalesce(new, col(name))).otherwise(col(name))
    return df.withColumns(out)


def fit_width(df: DataFrame, cells: str, headers: Sequence[str]) -> DataFrame:
    """Columns from an array of cells: short rows are padded with blanks, long ones cut."""
    names = unique_headers(headers)
    rest = [col(c) for c in df.columns if c != cells]
    return df.select(
        *rest, *[F.coalesce(F.get(col(cells), F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    )


def clean(
    df: DataFrame,
    trim: bool = True,
    headers: str | None = None,
    empty_rows: bool = True,
    deduplicate: bool = False,
    by: str | None = None,
    fill: Any = None,
    empty_columns: bool = False,
    row: str = ROW,
) -> DataFrame:
    """All cleaning steps in their fixed order."""
    if trim:
        df = trim_cells(df)
    if headers:
        df = normalise_headers(df, headers)
    if empty_rows:
        df = drop_empty_rows(df, row)
    if deduplicate or by:
        df = dedup(df, by, row)
    if fill is not None:
        df = fill_missing(df, fill)
    return drop_empty_columns(df, row) if empty_columns else df
