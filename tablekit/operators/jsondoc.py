"""JSON documents in bulk: node table, paths, queries, diffs, patches, profiles.

A document is a text or VARIANT column. A walk happens inside the row: a fold
opens the containers found last until none is left, so one scan of the table
gives all nodes, whatever their depth. There is no shuffle, no loop over jobs,
no pass that measures depth first, and no Python.
"""

from __future__ import annotations

import json as jsonlib
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import ANY_URL, EMAIL, UUID, col, dtype, half_up, timestamp
from tablekit.functions.jsonpaths import (
    as_array,
    as_double,
    as_map,
    as_text,
    bind,
    bracket_depth,
    child,
    descend,
    json_type,
    same_scalar,
)


def variant(df: DataFrame, name: str) -> Column:
    """The column as VARIANT; a text that is not JSON gives null."""
    c = col(name)
    if isinstance(dtype(df, name), T.VariantType):
        return c
    return F.try_parse_json(c)


def levels_of(df: DataFrame, name: str, most: int | None = None) -> Column:
    """How deep the brackets of each row's document nest, at most ``most``."""
    c = col(name)
    depth = bracket_depth(F.to_json(c) if isinstance(dtype(df, name), T.VariantType) else c)
    return depth if most is None else F.least(depth, F.lit(most))


# --- node table -------------------------------------------------------------

NODE = "struct<path:string,pointer:string,parent:string,depth:int,key:string,idx:int,place:string,far:int,v:variant>"
# A place is a pointer with array numbers as ``*``; a key that is a star itself is written so.
ITEM, STAR = "*", "~2"


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unfold(first: Column, kind: str, levels: Column, children: Callable[[Column], Column]) -> Column:
    """``first`` and everything below it, level by level: an array of ``kind``.

    ``children`` gives the array below one element, null where there is none.
    Only what the last step found is opened, as often as ``levels`` says.
    """
    state = f"struct<all:array<{kind}>,new:array<{kind}>>"
    start = F.struct(F.array(first).alias("all"), F.array(first).alias("new")).cast(state)
    nothing = F.array().cast(f"array<{kind}>")

    def step(acc: Column, _: Column) -> Column:
        found = F.flatten(F.transform(acc["new"], lambda n: F.coalesce(children(n).cast(f"array<{kind}>"), nothing)))
        return bind(found, lambda x: F.struct(F.concat(acc["all"], x).alias("all"), x.alias("new"))).cast(state)

    times = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(times, start, step, lambda acc: acc["all"])


def walked(df: DataFrame, json: str, keep: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """``keep`` and ``_nodes``, all nodes of each row's document; its root has a null ``v`` where the text is no JSON."""
    root = F.struct(
        F.lit("$").alias("path"),
        F.lit("").alias("pointer"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(1).alias("depth"),
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("int").alias("idx"),
        F.lit("").alias("place"),
        F.lit(0).alias("far"),
        F.col("_v").alias("v"),
    )
    kept = [col(k) for k in keep]
    read = df.select(*kept, variant(df, json).alias("_v"), levels_of(df, json, max_depth).alias("_levels"))
    return read.select(*kept, unfold(root, NODE, F.col("_levels"), _children).alias("_nodes"))


def _children(n: Column) -> Column:
    members = F.transform(
        F.map_entries(as_map(n["v"])),
        lambda e: F.struct(
            F.concat(n["path"], F.lit("."), e["key"]),
            F.concat(n["pointer"], F.lit("/"), _escaped(e["key"])),
            n["pointer"],
            n["depth"] + 1,
            e["key"],
            F.lit(None).cast("int"),
            F.concat(n["place"], F.lit("/"), F.when(e["key"] == ITEM, STAR).otherwise(_escaped(e["key"]))),
            n["far"],
            e["value"],
        ),
    ).cast(f"array<{NODE}>")
    items = F.transform(
        as_array(n["v"]),
        lambda x, i: F.struct(
            F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")),
            F.concat(n["pointer"], F.lit("/"), i.cast("string")),
            n["pointer"],
            n["depth"] + 1,
            F.lit(None).cast("string"),
            i,
            F.concat(n["place"], F.lit("/" + ITEM)),
            F.greatest(n["far"], i),
            x,
        ),
    ).cast(f"array<{NODE}>")
    return F.coalesce(members, items)


def _nodes(df: DataFrame, json: str, keep: Sequence[str], max_depth: int | None = None) -> DataFrame:
    kept = [col(k) for k in keep]
    # Texts that are no JSON are dropped here: an earlier filter would parse twice.
    each = walked(df, json, keep, max_depth).select(*kept, F.explode("_nodes").alias("_n"))
    return each.filter(F.col("_n.v").isNotNull()).select(*kept, "_n.*")


def node_table(
    df: DataFrame, json: str, keep: Sequence[str], max_depth: int | None = None
) -> DataFrame:
    """One row per JSON node: ``keep``, ``path, pointer, parent, depth, key, idx, v``.

    The root has depth 1. ``max_depth`` bounds the bracket nesting to walk;
    left out, no node is missed.
    """
    return _nodes(df, json, keep, max_depth).drop("place", "far")


def typed_nodes(nodes: DataFrame) -> DataFrame:
    """Node table with ``type`` and, for scalars, ``value`` as text."""
    kind = json_type(F.col("v"))
    return nodes.withColumn("type", kind).withColumn(
        "value", F.when(~F.col("type").isin("object", "array"), as_text(F.col("v")))
    )


def find_paths(nodes: DataFrame, test: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """Nodes for which a predicate over the node table holds."""
    return nodes.filter(test(nodes) if callable(test) else test)


# --- paths ------------------------------------------------------------------


def get(v: Column, path: str | Sequence[str | int], default: Any = None, as_type: str = "string") -> Column:
    """The value at a path; the default where there is none."""
    value = F.try_variant_get(descend(v, path), "$", as_type)
    return value if default is None else F.coalesce(value, F.lit(default))


def has(v: Column, path: str | Sequence[str | int]) -> Column:
    """Whether a path exists, even with a null value."""
    return descend(v, path).isNotNull()


def stringify(c: Column) -> Column:
    return F.to_json(c)


def flatten(df: DataFrame, json: str, keep: Sequence[str], delimiter: str = ".", max_depth: int | None = None) -> DataFrame:
    """Leaf rows ``keep, name, value``; value is JSON text, empty containers included."""
    nodes = node_table(df, json, keep, max_depth)
    leaf = F.coalesce(F.size(as_map(F.col("v"))), F.size(as_array(F.col("v"))), F.lit(0)) == 0
    parts = F.transform(
        F.split(F.substr(F.col("pointer"), F.lit(2)), "/"),
        lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")),
    )
    return nodes.filter(leaf).select(
        *[col(k) for k in keep],
        F.array_join(parts, delimiter).alias("name"),
        F.to_json("v").alias("value"),
    )


def to_table(df: DataFrame, json: str, keep: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """One column per key of the objects, null where a record lacks it.

    The keys become the header, so there can be no more of them than a table
    may be wide; beyond ``spark.sql.pivotMaxValues`` the call fails.
    """
    v = variant(df, json)
    if keys is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = (
            df.select(F.explode(F.map_keys(as_map(v))).alias("k")).distinct().limit(limit + 1).collect()
        )
        if len(found) > limit:
            raise ValueError(f"more than {limit} keys, too many for columns")
        keys = sorted(r["k"] for r in found)
    return df.select(*[col(k) for k in keep], v.alias("_v")).select(
        *[col(k) for k in keep], *[as_text(child(F.col("_v"), k)).alias(k) for k in keys]
    )


def from_table(df: DataFrame, out: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """One JSON object per row, nulls written out."""
    data = [col(c) for c in df.columns if c not in keep]
    return df.select(*[col(k) for k in keep], F.to_json(F.struct(*data), {"ignoreNullFields": "false"}).alias(out))


# --- JSONPath ---------------------------------------------------------------

PATH_PART = re.compile(r"\.?\[\s*([^\]]*?)\s*\]|\.?(\*)|\.?([^.\[*]+)")
FILTER = re.compile(r"@\.([A-Za-z0-9_$]+)\s*(==|!=|<=|>=|<|>)\s*(.*)")


def query(df: DataFrame, json: str, keep: Sequence[str], path: str, max_depth: int | None = None) -> DataFrame:
    """Rows ``keep, value`` (JSON text) selected by a JSONPath.

    Property, index, ``*``, leading ``..key`` and ``[?(@.k op value)]``.
    """
    return batch_query(df, json, keep, {"": path}, max_depth).drop("name")


def _selected(v: Column, nodes: Column, path: str) -> Column:
    """The array of values that a JSONPath selects below ``v``."""
    path = path.strip().removeprefix("$")
    if path.startswith(".."):
        found = F.filter(nodes, lambda n: n["v"].isNotNull() & F.coalesce(n["key"] == path[2:], F.lit(False)))
        return F.transform(found, lambda n: n["v"])
    found = F.array(v)
    for part in PATH_PART.findall(path):
        found = F.filter(_one_step(found, *part), lambda x: x.isNotNull())
    return F.filter(found, lambda x: x.isNotNull())


def _one_step(found: Column, inside: str, star: str, name: str) -> Column:
    nothing = F.array().cast("array<variant>")
    if star or inside == "*":
        return F.flatten(F.transform(found, lambda x: F.coalesce(F.map_values(as_map(x)), as_array(x), nothing)))
    if inside.startswith("?("):
        test = inside[2:].removesuffix(")").strip()
        items = F.flatten(F.transform(found, lambda x: F.coalesce(as_array(x), nothing)))
        return F.filter(items, lambda x: _filter_test(x, test))
    if inside.isdigit():
        return F.transform(found, lambda x: F.try_variant_get(x, f"$[{inside}]", "variant"))
    return F.transform(found, lambda x: child(x, (inside or name).strip("'\"")))


def _filter_test(item: Column, expression: str) -> Column:
    """Comparison of a member with a literal; missing members differ from everything."""
    container = as_map(item).isNotNull() | as_array(item).isNotNull()
    found = FILTER.match(expression)
    if not found:
        return container
    key, op, raw = found.groups()
    member = child(item, key)
    raw = raw.strip().strip("'\"")
    if raw == "null":
        same = F.coalesce(json_type(member) == "null", F.lit(True))
        test = same if op == "==" else ~same if op == "!=" else F.lit(False)
        return container & test
    if raw in ("true", "false"):
        left, right = F.try_variant_get(member, "$", "boolean"), F.lit(raw == "true")
    else:
        try:
            left, right = as_double(member), F.lit(float(raw))
        except ValueError:
            left, right = as_text(member), F.lit(raw)
    tests = {
        "==": left == right,
        "!=": ~F.coalesce(left == right, F.lit(False)),
        "<": left < right,
        "<=": left <= right,
        ">": left > right,
        ">=": left >= right,
    }
    return container & F.coalesce(tests[op], F.lit(False))


def batch_query(
    df: DataFrame, json: str, keep: Sequence[str], paths: Mapping[str, str], max_depth: int | None = None
) -> DataFrame:
    """Several JSONPaths at once, in one scan, as rows ``keep, name, value``."""
    kept = [col(k) for k in keep]
    if any(p.strip().removeprefix("$").startswith("..") for p in paths.values()):
        read = walked(df, json, keep, max_depth).select(*kept, "_nodes", F.col("_nodes")[0]["v"].alias("_v"))
    else:
        read = df.select(*kept, F.lit(None).alias("_nodes"), variant(df, json).alias("_v"))
    def named(name: str, path: str) -> Column:
        found = _selected(F.col("_v"), F.col("_nodes"), path)
        return F.transform(found, lambda x: F.struct(F.lit(name).alias("name"), F.to_json(x).alias("value")))

    lists = [named(name, path) for name, path in paths.items()]
    return read.select(*kept, F.explode(F.concat(*lists)).alias("_q")).select(*kept, "_q.name", "_q.value")


# --- diff and patch ---------------------------------------------------------


def paired_leaves(
    a: DataFrame,
    b: DataFrame,
    doc: Sequence[str],
    json: str,
    max_depth: int | None = None,
    unequal_arrays_whole: bool = False,
    equal: bool = True,
) -> DataFrame:
    """Walk two versions of each document together, after one join on the document.

    Only containers of the same kind on both sides are opened, so a subtree
    that is new, gone or of another type stays one row: ``path, pointer, a, b``.
    Without ``equal`` neither is a subtree opened nor a row given where both
    sides have the same JSON text.
    """
    pairs = _paired(a, b, doc, json, max_depth, unequal_arrays_whole, equal)
    return pairs.select(*[col(k) for k in doc], "path", "pointer", "a", "b")


def _paired(
    a: DataFrame, b: DataFrame, doc: Sequence[str], json: str, max_depth: int | None, unequal_arrays_whole: bool, equal: bool
) -> DataFrame:
    """The rows of ``paired_leaves`` with ``old`` and ``new``, both sides as JSON text."""
    kind = "struct<path:string,pointer:string,a:variant,b:variant,old:string,new:string,open:boolean>"
    kept = [col(k) for k in doc]

    def below(sides: Column, path: Column, pointer: Column) -> Column:
        """One pair; ``open`` where both sides hold containers of one kind to go into."""
        # Every text is made once and tells both the kind and whether anything below differs.
        return bind(
            F.struct(sides["a"].alias("a"), sides["b"].alias("b"), F.to_json(sides["a"]).alias("x"), F.to_json(sides["b"]).alias("y")),
            lambda p: F.struct(
                path.alias("path"), pointer.alias("pointer"), p["a"].alias("a"), p["b"].alias("b"),
                p["x"].alias("old"), p["y"].alias("new"), opened(p).alias("open"),
            ),
        )

    def opened(p: Column) -> Column:
        arrays = p["x"].startswith("[") & p["y"].startswith("[")
        if unequal_arrays_whole:
            arrays = F.when(arrays, F.size(as_array(p["a"])) == F.size(as_array(p["b"])))
        both = F.coalesce((p["x"].startswith("{") & p["y"].startswith("{")) | arrays, F.lit(False))
        return both if equal else both & (p["x"] != p["y"])

    def children(p: Column) -> Column:
        # Members of both sides by name, and items of both sides by place.
        members = F.transform(
            F.map_entries(
                F.map_zip_with(as_map(p["a"]), as_map(p["b"]), lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))
            ),
            lambda e: below(
                e["value"],
                F.concat(p["path"], F.lit("."), e["key"]), F.concat(p["pointer"], F.lit("/"), _escaped(e["key"])),
            ),
        )
        items = F.transform(
            F.zip_with(as_array(p["a"]), as_array(p["b"]), lambda x, y: F.struct(x.alias("a"), y.alias("b"))),
            lambda e, i: below(
                e,
                F.concat(p["path"], F.lit("["), i.cast("string"), F.lit("]")),
                F.concat(p["pointer"], F.lit("/"), i.cast("string")),
            ),
        )
        found = F.when(p["old"].startswith("{"), members).otherwise(items)
        if not equal:
            found = F.filter(found, lambda c: ~F.coalesce(c["old"] == c["new"], F.lit(False)))
        return F.when(p["open"], found)

    # Texts go through the join as they are and are parsed behind it.
    left, right = a.select(*kept, col(json).alias("_a")), b.select(*kept, col(json).alias("_b"))
    both = left.join(right, list(doc))
    read = both.select(*kept, variant(both, "_a").alias("a"), variant(both, "_b").alias("b"))
    read = read.select(*kept, F.struct("a", "b").alias("_s"), F.to_json("a").alias("_x"), F.to_json("b").alias("_y"))
    # What is open on both sides is no deeper than either of them; what is equal is not opened.
    levels = bracket_depth(F.when(F.length("_x") <= F.length("_y"), F.col("_x")).otherwise(F.col("_y")))
    levels = levels if max_depth is None else F.least(levels, F.lit(max_depth))
    read = read.select(*kept, "_s", F.when(F.lit(equal) | (F.col("_x") != F.col("_y")), levels).otherwise(0).alias("_levels"))
    every = unfold(below(F.col("_s"), F.lit("$"), F.lit("")), kind, F.col("_levels"), children)
    shown = lambda p: ~p["open"] if equal else ~p["open"] & ~F.coalesce(p["old"] == p["new"], F.lit(False))
    pairs = read.select(*kept, F.explode(F.filter(every, shown)).alias("_p"))
    return pairs.select(*kept, "_p.path", "_p.pointer", "_p.a", "_p.b", "_p.old", "_p.new")


def json_diff(
    a: DataFrame, b: DataFrame, doc: Sequence[str], json: str, max_depth: int | None = None
) -> DataFrame:
    """Structural changes per document: ``path, pointer, status, details, old, new``.

    Documents on one side only are a matter for a table diff, not for this one.
    """
    return _changed(_paired(a, b, doc, json, max_depth, unequal_arrays_whole=False, equal=False), doc)


def _changed(pairs: DataFrame, doc: Sequence[str]) -> DataFrame:
    # The type of a container takes a look at all of it, its text begins with it.
    kind = lambda v, text: F.when(text.startswith("{"), "object").when(text.startswith("["), "array").otherwise(json_type(v))
    typed = pairs.withColumn("_ta", kind(F.col("a"), F.col("old"))).withColumn("_tb", kind(F.col("b"), F.col("new")))
    ta, tb = F.col("_ta"), F.col("_tb")
    same_value = (F.col("old") == F.col("new")) | same_scalar(F.col("a"), F.col("b"))
    status = (
        F.when(ta.isNull(), "added")
        .when(tb.isNull(), "removed")
        .when((ta != tb) | ~same_value, "modified")
    )
    return typed.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        *[col(k) for k in doc],
        "path",
        "pointer",
        "status",
        F.when(ta != tb, F.concat(F.lit("type changed from "), ta, F.lit(" to "), tb)).alias("details"),
        "old",
        "new",
    )


def create_patch(
    a: DataFrame, b: DataFrame, doc: Sequence[str], json: str, max_depth: int | None = None
) -> DataFrame:
    """A JSON Patch text per document pair; ``[]`` when both are equal.

    What is collected per document is a part of that document's own text.
    """
    changes = _changed(_paired(a, b, doc, json, max_depth, unequal_arrays_whole=True, equal=False), doc)
    op = F.when(F.col("status") == "modified", "replace").when(F.col("status") == "added", "add").otherwise("remove")
    pointer = F.to_json(F.col("pointer").cast("variant"))
    entry = F.concat(
        F.lit('{"op":"'), op, F.lit('","path":'), pointer,
        F.when(F.col("status") != "removed", F.concat(F.lit(',"value":'), F.col("new"))).otherwise(""),
        F.lit("}"),
    )
    rank = F.when(F.col("status") == "removed", 0).otherwise(1)
    listed = changes.groupBy(*[col(k) for k in doc]).agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("pointer"), entry.alias("e")))).alias("_l")
    )
    text = F.concat(F.lit("["), F.array_join(F.col("_l.e"), ","), F.lit("]"))
    return (
        a.select(*doc).join(b.select(*doc), list(doc)).join(listed, list(doc), "left")
        .select(*[col(k) for k in doc], F.coalesce(text, F.lit("[]")).alias("patch"))
    )


# --- profiles ---------------------------------------------------------------


def document_metrics(df: DataFrame, json: str, doc: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Node counts by type, keys, depth, number and string statistics, one row per document.

    Everything is worked out inside the row, from the one array of its nodes.
    """
    kept = [col(k) for k in doc]
    typed = F.transform(
        "_nodes",
        lambda n: F.struct(
            json_type(n["v"]).alias("type"), n["v"].alias("v"), n["key"].alias("key"), n["depth"].alias("depth")
        ),
    )
    read = walked(df, json, doc, max_depth).filter(F.col("_nodes")[0]["v"].isNotNull()).select(*kept, typed.alias("_t"))
    of = lambda kind: F.filter("_t", lambda n: n["type"] == kind)
    numbers = F.transform(of("number"), lambda n: as_double(n["v"]))
    strings = F.transform(of("string"), lambda n: as_text(n["v"]))
    read = read.select(
        *kept, "_t", numbers.alias("_num"), strings.alias("_str"),
        F.filter(F.transform("_t", lambda n: n["key"]), lambda k: k.isNotNull()).alias("_keys"),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = lambda sums, c: F.when(F.size(c) > 0, sums / F.size(c)).otherwise(F.lit(0.0))
    hits = lambda test: F.size(F.filter("_str", test)).cast("bigint")
    return read.select(
        *kept,
        F.size("_t").cast("bigint").alias("nodes"),
        *[
            F.size(of(kind)).cast("bigint").alias(f"{kind}s")
            for kind in ("object", "array", "string", "number", "boolean", "null")
        ],
        F.size("_keys").cast("bigint").alias("keys_total"),
        F.size(F.array_distinct("_keys")).cast("bigint").alias("keys_unique"),
        F.array_max(F.transform("_t", lambda n: n["depth"])).alias("max_depth"),
        F.coalesce(F.array_min("_num"), F.lit(0.0)).alias("num_min"),
        F.coalesce(F.array_max("_num"), F.lit(0.0)).alias("num_max"),
        total("_num").alias("num_sum"),
        mean(total("_num"), "_num").alias("num_mean"),
        mean(total(F.transform("_str", lambda x: F.length(x).cast("double"))), "_str").alias("avg_string_length"),
        hits(lambda x: x.rlike(EMAIL)).alias("emails"),
        hits(lambda x: x.rlike(ANY_URL)).alias("urls"),
        hits(lambda x: timestamp(x).isNotNull() & x.rlike("[-/]")).alias("dates"),
        hits(lambda x: x.rlike(UUID)).alias("uuids"),
        # The root holds the whole document.
        F.octet_length(F.to_json(F.col("_t")[0]["v"])).alias("minified_bytes"),
    )


SCHEMA_FORMATS = (
    ("email", EMAIL),
    ("uri", ANY_URL),
    ("uuid", UUID),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("date-time", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
)


def schema_paths(
    df: DataFrame, json: str, max_depth: int | None = None, first_items: int | None = None
) -> DataFrame:
    """Types, formats and presence per place in the documents: the schema as a tree, one row per node.

    ``pointer`` names a place by its keys, array numbers as ``*`` (a key that is
    a star is ``~2``, a slash ``~1``, a tilde ``~0``), so keys with dots or
    brackets are told apart; ``place`` shows it as ``$.a[].b``. ``parent`` is the
    pointer of the place above, ``key`` the member's name (null for items and
    the root). Every task merges the places of its rows before they are
    shuffled, so what is shuffled is the schema, not the documents.
    ``first_items`` looks at the first items of each array only.
    """
    nodes = typed_nodes(_nodes(df, json, [], max_depth))
    if first_items is not None:
        # An item that is skipped hides everything below it as well.
        nodes = nodes.filter(F.col("far") < first_items)
    whole = as_double(F.col("v")) == F.floor(as_double(F.col("v")))
    kind = F.when((F.col("type") == "number") & whole, "integer").otherwise(F.col("type"))
    fmt = None
    for name, pattern in SCHEMA_FORMATS:
        hit = (F.col("type") == "string") & F.col("value").rlike(pattern)
        fmt = F.when(hit, name) if fmt is None else fmt.when(hit, name)
    typed = nodes.select("place", kind.alias("type"), fmt.alias("format"))
    # At most a handful of types and formats exist, so these sets stay small.
    merged = typed.groupBy(F.col("place").alias("pointer")).agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if(F.col("type") == "object").alias("objects"),
        F.sort_array(F.collect_set("type")).alias("types"),
        F.sort_array(F.collect_set("format")).alias("formats"),
        F.count_if((F.col("type") == "string") & F.col("format").isNull()).alias("plain_strings"),
    )
    last = F.substring_index("pointer", "/", -1)
    shown = F.transform(
        F.split("pointer", "/"),
        lambda p, i: F.when(i == 0, "$").when(p == ITEM, "[]").otherwise(F.concat(F.lit("."), _plain(p))),
    )
    return merged.select(
        "pointer",
        F.array_join(shown, "").alias("place"),
        F.when(F.col("pointer") != "", F.regexp_replace("pointer", "/[^/]*$", "")).alias("parent"),
        F.when((F.col("pointer") != "") & (last != ITEM), _plain(last)).alias("key"),
        "present", "objects", "types", "formats", "plain_strings",
    )


def _plain(part: Column) -> Column:
    """A key as it was before it became part of a place."""
    text = F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.when(part == STAR, ITEM).otherwise(text)


def schema_rows(df: DataFrame, json: str, max_depth: int | None = None) -> DataFrame:
    """A Draft-07 JSON Schema of the documents, one row per place of any number of them.

    Rows ``pointer, parent, key, place, types, format, required``: ``types``
    without ``integer`` where other numbers occur, ``format`` where all strings
    share one, ``required`` where every object above has the key. ``present``
    and ``objects`` count the values and the objects among them.
    """
    paths = schema_paths(df, json, max_depth)
    above = paths.select(F.col("pointer").alias("parent"), F.col("objects").alias("_owners"))
    types = F.when(F.array_contains("types", "number"), F.array_remove("types", "integer")).otherwise(F.col("types"))
    one = (F.size("formats") == 1) & (F.col("plain_strings") == 0)
    required = F.col("key").isNotNull() & F.coalesce(F.col("present") == F.col("_owners"), F.lit(False))
    return paths.join(above, "parent", "left").select(
        "pointer", "parent", "key", "place", types.alias("types"), F.when(one, F.col("formats")[0]).alias("format"),
        required.alias("required"), "present", "objects",
    )


def infer_schema(df: DataFrame, json: str, title: str = "InferredSchema", max_depth: int | None = None) -> dict:
    """The rows of ``schema_rows`` as one Draft-07 document.

    A schema file is one document by its nature; the places come in one
    partition at a time, parents before their children. For schemas too large
    for that, work with the rows.
    """
    order = F.split("pointer", "/")
    nodes: dict[str, dict] = {}
    for r in schema_rows(df, json, max_depth).orderBy(F.size(order), "pointer").toLocalIterator():
        node: dict[str, Any] = {"type": r["types"][0] if len(r["types"]) == 1 else list(r["types"])}
        if r["format"]:
            node["format"] = r["format"]
        if "array" in r["types"]:
            node["items"] = {}
        if "object" in r["types"]:
            node |= {"properties": {}, "additionalProperties": True}
        nodes[r["pointer"]] = node
        if r["parent"] is None:
            continue
        owner = nodes[r["parent"]]
        if r["key"] is None:
            owner["items"] = node
        else:
            owner["properties"][r["key"]] = node
            if r["required"]:
                owner.setdefault("required", []).append(r["key"])
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": title, **nodes.get("", {})}


def collection_anomalies(df: DataFrame, json: str) -> DataFrame:
    """Keys missing in some records, keys of mixed type, and records that are no objects.

    Rows ``issue, key, present, missing, percentage, types``.
    """
    docs = df.select(variant(df, json).alias("v"))
    members = docs.select(F.explode(as_map(F.col("v"))).alias("key", "item"))
    keys = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("present"),
        F.sort_array(F.collect_set(json_type(F.col("item")))).alias("types"),
    )
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = keys.withColumn("total", total)
    missing = F.col("total") - F.col("present")
    nothing = F.lit(None)
    absent = keys.filter(missing > 0).select(
        F.lit("missing key").alias("issue"),
        "key",
        "present",
        missing.alias("missing"),
        half_up(missing / F.col("total") * 100, 0).cast("int").alias("percentage"),
        nothing.cast("string").alias("types"),
    )
    named = F.array_remove("types", "null")
    mixed = keys.filter(F.size(named) > 1).select(
        F.lit("mixed types").alias("issue"),
        "key",
        "present",
        nothing.cast("bigint").alias("missing"),
        nothing.cast("int").alias("percentage"),
        F.array_join("types", ",").alias("types"),
    )
    others = docs.filter(as_map(F.col("v")).isNull()).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("not an object").alias("issue"),
        nothing.cast("string").alias("key"),
        F.col("n").alias("present"),
        nothing.cast("bigint").alias("missing"),
        nothing.cast("int").alias("percentage"),
        nothing.cast("string").alias("types"),
    )
    return absent.unionByName(mixed).unionByName(others)


def outline(df: DataFrame, json: str, doc: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Shape of each document: type, size, item types and a 30-character preview.

    Arrays are shown by their first item.
    """
    nodes = typed_nodes(node_table(df, json, doc, max_depth))
    first_only = ~F.col("path").rlike(r"\[(?!0\])\d+\]")
    item_types = F.array_distinct(F.transform(as_array(F.col("v")), json_type))
    return nodes.filter(first_only).select(
        *[col(k) for k in doc],
        "path",
        "depth",
        "type",
        F.coalesce(F.size(as_map(F.col("v"))), F.size(as_array(F.col("v")))).alias("size"),
        F.array_join(item_types, ",").alias("item_types"),
        F.left("value", F.lit(30)).alias("preview"),
    )


def dumps(value: Any) -> str:
    return jsonlib.dumps(value, ensure_ascii=False, separators=(",", ":"))
