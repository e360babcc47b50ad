"""JSON Schema checks, turned into one Column per schema.

The recursion is over the schema, which is finite, never over the documents:
the result is an expression that yields the list of errors of a document.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import ANY_URL, EMAIL, IPV4, UUID, col, timestamp
from tablekit.functions.jsonpaths import as_array, as_double, as_map, as_text, bind, child, json_type, same_scalar
from tablekit.operators.jsondoc import variant

ERRORS = "array<struct<path:string,keyword:string,message:string,expected:string,actual:string>>"


def validate(df: DataFrame, json_col: str, schema: Mapping[str, Any], keep: Sequence[str]) -> DataFrame:
    """One row per violation: ``keep, path, keyword, message, expected, actual``."""
    # The generator takes the expression itself: over a named column the
    # optimizer would add a filter that works the whole check out a second time.
    return df.select(*[col(k) for k in keep], F.inline(errors(variant(df, json_col), schema)))


def errors(v: Column, schema: Mapping[str, Any]) -> Column:
    """The errors of a VARIANT under a schema, as an array of structs."""
    return _check(v, schema, F.lit(""), schema, ())


def _none() -> Column:
    return F.array().cast(ERRORS)


def _error(path: Column, keyword: str, message: str, expected: Any, actual: Column) -> Column:
    return F.array(
        F.struct(
            path.alias("path"),
            F.lit(keyword).alias("keyword"),
            F.lit(message).alias("message"),
            F.lit(expected if isinstance(expected, str) else json.dumps(expected)).alias("expected"),
            actual.cast("string").alias("actual"),
        )
    ).cast(ERRORS)


def _under(path: Column, name: Column | str) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _equals(v: Column, want: Any) -> Column:
    return same_scalar(v, F.parse_json(F.lit(json.dumps(want))))


def _is_format(text: Column, name: str) -> Column:
    if name == "email":
        return text.rlike(EMAIL)
    if name in ("uri", "url"):
        return text.rlike(ANY_URL)
    if name == "uuid":
        return text.rlike(UUID)
    if name == "ipv4":
        return text.rlike(IPV4)
    if name == "date":
        return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & timestamp(text).isNotNull()
    if name == "date-time":
        return timestamp(text).isNotNull()
    return F.lit(True)


def _resolve(schema: Any, root: Mapping[str, Any], seen: tuple[str, ...]) -> tuple[Any, tuple[str, ...]]:
    """Follow ``$ref`` inside the same schema; a schema that holds itself is refused."""
    while isinstance(schema, Mapping) and "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen:
            raise ValueError(f"{ref} refers to itself, which has no finite check")
        if not ref.startswith("#"):
            raise ValueError(f"{ref} is outside this schema")
        seen = (*seen, ref)
        target: Any = root
        for part in ref[1:].split("/")[1:]:
            target = target[part.replace("~1", "/").replace("~0", "~")]
        rest = {k: val for k, val in schema.items() if k != "$ref"}
        schema = {**target, **rest} if isinstance(target, Mapping) else target
    return schema, seen


def _check(v: Column, schema: Any, path: Column, root: Mapping[str, Any], seen: tuple[str, ...]) -> Column:
    schema, seen = _resolve(schema, root, seen)
    if schema is False:
        return _error(path, "false", "no value is allowed", "nothing", F.to_json(v))
    if not isinstance(schema, Mapping) or not schema:
        return _none()
    here = F.struct(v.alias("v"), json_type(v).alias("kind"), path.alias("path"))
    return bind(here, lambda s: _check_here(s["v"], s["kind"], schema, s["path"], root, seen))


def _check_here(
    v: Column, kind: Column, schema: Mapping[str, Any], path: Column, root: Mapping[str, Any], seen: tuple[str, ...]
) -> Column:
    num, text, arr = as_double(v), as_text(v), as_array(v)
    found: list[Column] = []

    def add(fails: Column, keyword: str, message: str, expected: Any, actual: Column, at: Column | None = None) -> None:
        found.append(F.when(fails, _error(at if at is not None else path, keyword, message, expected, actual)))

    if "const" in schema:
        add(~_equals(v, schema["const"]), "const", "value is not the constant", schema["const"], F.to_json(v))
    if isinstance(schema.get("enum"), list):
        any_of = reduce(lambda a, b: a | b, [_equals(v, e) for e in schema["enum"]], F.lit(False))
        add(~any_of, "enum", "value is not in the list", schema["enum"], F.to_json(v))

    is_num, is_text = kind == "number", kind == "string"
    numeric = {
        "minimum": lambda lim: num < lim,
        "maximum": lambda lim: num > lim,
        "exclusiveMinimum": lambda lim: num <= lim,
        "exclusiveMaximum": lambda lim: num >= lim,
    }
    for key, fails in numeric.items():
        lim = schema.get(key)
        if isinstance(lim, (int, float)) and not isinstance(lim, bool):
            add(is_num & fails(float(lim)), key, f"number breaks {key}", lim, text)
    if schema.get("multipleOf"):
        # Decimals, so that 0.3 is a multiple of 0.1.
        step = F.lit(str(schema["multipleOf"])).cast("decimal(38,12)")
        rest = F.try_variant_get(v, "$", "decimal(38,12)") % step
        add(is_num & (rest != 0), "multipleOf", "number is not a multiple", schema["multipleOf"], text)

    if "minLength" in schema:
        add(is_text & (F.length(text) < schema["minLength"]), "minLength", "text is too short", schema["minLength"], F.length(text))
    if "maxLength" in schema:
        add(is_text & (F.length(text) > schema["maxLength"]), "maxLength", "text is too long", schema["maxLength"], F.length(text))
    if "pattern" in schema:
        add(is_text & ~text.rlike(schema["pattern"]), "pattern", "text does not match", schema["pattern"], text)
    if "format" in schema:
        add(is_text & ~_is_format(text, schema["format"]), "format", "text has another format", schema["format"], text)

    if any(k in schema for k in ("minItems", "maxItems", "uniqueItems", "items", "prefixItems")):
        found += _array_checks(arr, schema, path, root, seen)
    object_keys = (
        "required", "properties", "additionalProperties", "minProperties", "maxProperties", "dependentRequired"
    )
    if any(k in schema for k in object_keys):
        found += _object_checks(v, schema, path, root, seen)
    found += _combined(v, schema, path, root, seen)

    out = F.flatten(F.array(*[F.coalesce(f, _none()) for f in found])) if found else _none()
    if "type" not in schema:
        return out
    allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    whole = is_num & (num == F.floor(num))
    fits = reduce(
        lambda a, b: a | b, [whole if t == "integer" else kind == t for t in allowed], F.lit(False)
    )
    # A value of another type gets this one error and is not looked into.
    wrong = _error(path, "type", "value has another type", "|".join(allowed), kind)
    return F.when(fits, out).otherwise(wrong) if found else F.when(~fits, wrong).otherwise(_none())


def _array_checks(arr: Column, schema: Mapping, path: Column, root: Mapping, seen: tuple) -> list[Column]:
    found = []
    size = F.size(arr)

    def at(i: Column) -> Column:
        return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

    if "minItems" in schema:
        found.append(F.when(size < schema["minItems"], _error(path, "minItems", "too few items", schema["minItems"], size)))
    if "maxItems" in schema:
        found.append(F.when(size > schema["maxItems"], _error(path, "maxItems", "too many items", schema["maxItems"], size)))
    if schema.get("uniqueItems") is True:
        texts = F.transform(arr, lambda x: F.to_json(x))
        # Only the first repeat is reported.
        places = F.transform(texts, lambda x, i: F.when(F.array_position(texts, x) < i + 1, i))
        first = F.get(F.array_compact(places), F.lit(0))
        found.append(
            F.when(
                F.size(F.array_distinct(texts)) < size,
                _error(at(first), "uniqueItems", "item repeats an earlier one", "unique items", F.get(texts, first)),
            )
        )
    items, prefix = schema.get("items"), schema.get("prefixItems")
    if isinstance(items, list):
        items, prefix = None, items
    for i, one in enumerate(prefix or []):
        item = F.get(arr, F.lit(i))
        found.append(F.when(size > i, _check(item, one, at(F.lit(i)), root, seen)))
    if items is not None and items is not True:
        skip = len(prefix or [])
        each = F.transform(
            arr, lambda x, i: F.when(i >= skip, _check(x, items, at(i), root, seen)).otherwise(_none())
        )
        found.append(F.flatten(each))
    return found


def _object_checks(v: Column, schema: Mapping, path: Column, root: Mapping, seen: tuple) -> list[Column]:
    found = []
    members = as_map(v)
    is_object = members.isNotNull()
    for name in schema.get("required", []):
        gone = is_object & child(v, name).isNull()
        found.append(F.when(gone, _error(_under(path, name), "required", "member is missing", name, F.lit(None))))
    properties = schema.get("properties") or {}
    for name, below in properties.items():
        value = child(v, name)
        found.append(F.when(is_object & value.isNotNull(), _check(value, below, _under(path, name), root, seen)))
    extra = schema.get("additionalProperties")
    if extra is False or isinstance(extra, Mapping):
        known = F.array(*[F.lit(n) for n in properties]).cast("array<string>")
        others = F.map_entries(F.map_filter(members, lambda k, _: ~F.array_contains(known, k)))
        if extra is False:
            each = F.transform(
                others,
                lambda e: _error(
                    _under(path, e["key"]), "additionalProperties", "member is not allowed", "no other members", e["key"]
                ),
            )
        else:
            each = F.transform(others, lambda e: _check(e["value"], extra, _under(path, e["key"]), root, seen))
        found.append(F.flatten(each))
    size = F.size(members)
    if "minProperties" in schema:
        found.append(F.when(size < schema["minProperties"], _error(path, "minProperties", "too few members", schema["minProperties"], size)))
    if "maxProperties" in schema:
        found.append(F.when(size > schema["maxProperties"], _error(path, "maxProperties", "too many members", schema["maxProperties"], size)))
    for name, needs in (schema.get("dependentRequired") or {}).items():
        for other in needs:
            gone = is_object & child(v, name).isNotNull() & child(v, other).isNull()
            found.append(
                F.when(gone, _error(_under(path, other), "dependentRequired", f"{name} needs this member", other, F.lit(None)))
            )
    return found


def _combined(v: Column, schema: Mapping, path: Column, root: Mapping, seen: tuple) -> list[Column]:
    found = []

    def passes(s: Any) -> Column:
        return F.size(_check(v, s, path, root, seen)) == 0

    for s in schema.get("allOf", []):
        found.append(_check(v, s, path, root, seen))
    for key in ("anyOf", "oneOf"):
        if schema.get(key):
            hits = reduce(lambda a, b: a + b, [passes(s).cast("int") for s in schema[key]])
            fails = hits == 0 if key == "anyOf" else hits != 1
            found.append(F.when(fails, _error(path, key, f"value does not meet {key}", key, hits)))
    if "not" in schema:
        found.append(F.when(passes(schema["not"]), _error(path, "not", "value meets a schema it must not", "not", F.lit(None))))
    return found
