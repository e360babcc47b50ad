"""Paths into JSON documents and type helpers over VARIANT columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_KEY = re.compile(r"^[A-Za-z0-9_ \-$@#]+$")


def tokens(path: str | Sequence[str | int]) -> list[str]:
    """Path parts of ``a.b[0]``, ``a['b']`` or the pointer ``/a/b/0``."""
    if not isinstance(path, str):
        return [str(p) for p in path]
    if path.startswith("/"):
        return [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
    found = re.findall(r"""\[\s*(?:'([^']*)'|"([^"]*)"|([^\]]*))\s*\]|([^.\[\]]+)""", path.removeprefix("$"))
    return [next((g for g in groups if g), "") for groups in found]


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def child(v: Column, key: str) -> Column:
    """The member or array item a token names; null when there is none."""
    if SAFE_KEY.match(key):
        named = F.try_variant_get(v, f"$['{key}']", "variant")
    else:
        named = F.try_element_at(as_map(v), F.lit(key))
    if key.isdigit():
        return F.coalesce(F.try_variant_get(v, f"$[{key}]", "variant"), named)
    return named


def descend(v: Column, path: str | Sequence[str | int]) -> Column:
    for key in tokens(path):
        v = child(v, key)
    return v


# What the engine calls a value's type, and what JSON calls it.
JSON_NAMES = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
}


def json_type(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null when absent."""
    names = F.create_map(*[F.lit(x) for pair in JSON_NAMES.items() for x in pair])
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(v.isNotNull(), F.try_element_at(names, kind))


def bind(v: Column, body: Callable[[Column], Column]) -> Column:
    """``body(v)`` with ``v`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def as_text(v: Column) -> Column:
    """A scalar as text, without quotes."""
    return F.try_variant_get(v, "$", "string")


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def same_scalar(a: Column, b: Column) -> Column:
    """Whether two values are one number, or have one text.

    Whole and decimal numbers are compared digit by digit, whatever their
    size; floating-point ones by value.
    """
    kinds = [F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0) for v in (a, b)]
    floats = kinds[0].isin("DOUBLE", "FLOAT") | kinds[1].isin("DOUBLE", "FLOAT")
    numbers = (json_type(a) == "number") & (json_type(b) == "number")
    exact = F.to_json(a) == F.to_json(b)
    return F.coalesce(F.when(numbers & floats, as_double(a) == as_double(b)).otherwise(exact), F.lit(False))


def bracket_depth(json: Column) -> Column:
    """How deep the brackets of a JSON text nest, strings left out."""
    brackets = F.regexp_replace(json, r'(?s)"(?:[^"\\]++|\\.)*+"|[^"\[\]{}]++', "")
    steps = F.transform(
        F.split(brackets, ""),
        lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(
        steps,
        zero,
        lambda acc, s: F.struct(
            (acc["now"] + s).alias("now"), F.greatest(acc["top"], acc["now"] + s).alias("top")
        ),
        lambda acc: acc["top"],
    )
