"""Declarative row rules: one error row per violation."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import EMAIL, HTTP_URL, col, dtype, number, text, timestamp
from tablekit.operators.rows import ROW

ERROR = "struct<column:string,rule:string,message:string,value:string>"


def _type_fails(c: Column, t: T.DataType, rule: Mapping[str, Any]) -> Column | None:
    kind = str(rule["type"]).lower()
    value, num = text(c), number(c, t)
    is_text = isinstance(t, T.StringType)
    if kind == "number":
        return num.isNull()
    if kind == "integer":
        return num.isNull() | (num != F.floor(num))
    if kind == "boolean":
        return ~value.isin("true", "false", "TRUE", "FALSE") if is_text else F.lit(not isinstance(t, T.BooleanType))
    if kind == "date":
        return timestamp(c).isNull() if is_text else F.lit(
            not isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
        )
    if kind == "email":
        return ~value.rlike(EMAIL)
    if kind == "url":
        return ~value.rlike(HTTP_URL)
    if kind == "regex" and rule.get("pattern"):
        return ~value.rlike(rule["pattern"])
    return None


def column_errors(df: DataFrame, name: str, rule: Mapping[str, Any]) -> list[Column]:
    """The checks of one column that need nothing but the row, each an error struct or null."""
    if name not in df.columns:
        c, t = F.lit(None).cast("string"), T.StringType()
    else:
        c, t = col(name), dtype(df, name)
    value = text(c)
    empty = c.isNull() | (value == "")
    out: list[Column] = []

    def add(test: Column, kind: str, message: str) -> None:
        out.append(
            F.when(
                test,
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(kind).alias("rule"),
                    F.lit(message).alias("message"),
                    value.alias("value"),
                ),
            )
        )

    if rule.get("required"):
        add(empty, "required", f"{name} is required")
    if rule.get("type"):
        fails = _type_fails(c, t, rule)
        if fails is not None:
            add(~empty & fails, "type", f"{name} is not a valid {rule['type']}")
    is_text = isinstance(t, T.StringType)
    num = number(c, t)
    for key, test in (("min", lambda lim: num < lim), ("max", lambda lim: num > lim)):
        if rule.get(key) is not None:
            add(~empty & test(rule[key]), key, f"{name} breaks {key} {rule[key]}")
    if is_text:
        # A cell that reads as a number, boolean or null is not a text.
        textual = ~empty & num.isNull() & ~value.isin("true", "false", "TRUE", "FALSE", "null", "NULL")
        for key, test in (
            ("minLength", lambda lim: F.length(value) < lim),
            ("maxLength", lambda lim: F.length(value) > lim),
        ):
            if rule.get(key) is not None:
                add(textual & test(rule[key]), key, f"{name} breaks {key} {rule[key]}")
    if rule.get("enum") is not None:
        add(~empty & ~c.isin(list(rule["enum"])), "enum", f"{name} is not an allowed value")
    return out


def validate(df: DataFrame, rules: Mapping[str, Mapping[str, Any]], row: str = ROW) -> DataFrame:
    """Errors as ``_row, column, rule, message, value``.

    All row-local checks run in one pass over the table. ``unique`` reports
    every repeat after the first; see :func:`repeats`.
    """
    checks = [e for name, rule in rules.items() for e in column_errors(df, name, rule)]
    if checks:
        local = df.select(
            F.col(row).alias(ROW), F.inline(F.array_compact(F.array(*checks)).cast(f"array<{ERROR}>"))
        )
    else:
        local = df.sparkSession.createDataFrame([], f"{ROW} bigint, column string, rule string, message string, value string")
    for name, rule in rules.items():
        # An absent column is blank in every row, and blanks repeat nothing.
        if rule.get("unique") and name in df.columns:
            local = local.unionByName(
                repeats(df, name, row).select(
                    F.col(row).alias(ROW),
                    F.lit(name).alias("column"),
                    F.lit("unique").alias("rule"),
                    F.lit(f"{name} repeats an earlier value").alias("message"),
                    text(col(name)).alias("value"),
                )
            )
    return local


def repeats(df: DataFrame, name: str, row: str = ROW) -> DataFrame:
    """Rows whose value was seen in an earlier row.

    The first row of each value is found by a partial minimum; the rest are the
    rows whose number is not among them. The join is on the row number, which
    is unique, so a value that fills a third of the table stays spread out.
    """
    value = text(col(name))
    filled = df.filter(col(name).isNotNull() & (value != ""))
    firsts = filled.groupBy(value.alias("_v")).agg(F.min(row).alias(row)).select(row)
    return filled.join(firsts, row, "left_anti")


def violation_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("errors"))
