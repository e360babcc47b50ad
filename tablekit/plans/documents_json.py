"""Queries over JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.functions.jsonpaths import as_double, as_text
from tablekit.operators import jsondoc, jsonedit, jsonschema
from tablekit.operators.rows import spread
from tablekit.plans.registry import query

# One nested document per event, as the same text on both sides.
DOC = """'{"id":' || event_id || ',"user":{"n":' || user_id || ',"tags":["' || event_type || '",null,true]},"p":' || props
  || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"v":' || CASE WHEN event_id % 6 = 0 THEN '"none"' ELSE CAST(value AS VARCHAR) END END || ',"e":[],"o":{}}'"""
DOCS = f"docs AS (SELECT event_id, {DOC} AS doc FROM events)"


def docs(t):
    s = lambda c: F.col(c).cast("string")
    i = F.col("event_id")
    v = F.when(i % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"v":'), F.when(i % 6 == 0, F.lit('"none"')).otherwise(s("value")))
    )
    text = F.concat(
        F.lit('{"id":'), s("event_id"), F.lit(',"user":{"n":'), s("user_id"), F.lit(',"tags":["'), F.col("event_type"),
        F.lit('",null,true]},"p":'), F.col("props"), v, F.lit(',"e":[],"o":{}}'),
    )
    # Walking documents is costly per row, so small files go to all cores.
    return spread(t.events).select("event_id", text.alias("doc"))


TYPE = """CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'NULL' THEN 'null' ELSE 'number' END"""


@query(
    "jsn1_node_table",
    f"""WITH {DOCS} SELECT event_id, fullkey AS path, len(regexp_extract_all(fullkey, '[.\\[]')) + 1 AS depth, {TYPE} AS type,
       CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN type = 'BOOLEAN' THEN CAST(atom AS VARCHAR) ELSE regexp_replace(json_value_text, '[.]0$', '') END AS value
       FROM (SELECT event_id, j.fullkey, j.type, j.atom, json_extract_string(doc, j.fullkey) AS json_value_text FROM docs, json_tree(doc) j)""",
)
def _(t):
    nodes = jsondoc.typed_nodes(jsondoc.node_table(docs(t), "doc", ["event_id"]))
    return nodes.select("event_id", "path", F.col("depth").cast("bigint").alias("depth"), "type", "value")


@query(
    "jsn2_get",
    f"""WITH {DOCS} SELECT event_id, json_extract_string(doc, '$.user.tags[0]') AS tag, coalesce(CAST(json_extract_string(doc, '$.p.k') AS BIGINT), -1) AS k,
       coalesce(regexp_replace(json_extract_string(doc, '$.v'), '[.]0$', ''), 'n/a') AS v FROM docs""",
)
def _(t):
    v = F.col("d")
    return docs(t).select("event_id", F.parse_json("doc").alias("d")).select(
        "event_id",
        jsondoc.get(v, "user.tags[0]").alias("tag"),
        jsondoc.get(v, "/p/k", -1, "bigint").alias("k"),
        jsondoc.get(v, "['v']", "n/a").alias("v"),
    )


@query(
    "jsn3_has",
    f"""WITH {DOCS} SELECT event_id, json_exists(doc, '$.user.tags[1]') AS second_tag, json_exists(doc, '$.v') AS v, json_exists(doc, '$.user.x') AS x FROM docs""",
)
def _(t):
    v = F.col("d")
    return docs(t).select("event_id", F.parse_json("doc").alias("d")).select(
        "event_id",
        jsondoc.has(v, "user.tags[1]").alias("second_tag"),
        jsondoc.has(v, "v").alias("v"),
        jsondoc.has(v, "user.x").alias("x"),
    )


@query(
    "jsn4_set",
    f"""WITH {DOCS} SELECT event_id, event_id % 4 <> 0 AS had_v, 'new' AS v, 'x' AS deep, json_array_length(doc, '$.user.tags') + 1 AS tags FROM docs""",
)
def _(t):
    c = jsonedit.set_value(F.col("doc"), "v", "new")
    c = jsonedit.set_value(jsonedit.set_value(c, "a.b[1]", "x"), "/user/tags/-", 1)
    return docs(t).select("event_id", jsondoc.has(F.try_parse_json("doc"), "v").alias("had_v"), F.parse_json(c).alias("d")).select(
        "event_id",
        "had_v",
        jsondoc.get(F.col("d"), "v").alias("v"),
        jsondoc.get(F.col("d"), "a.b[1]").alias("deep"),
        F.size(jsondoc.get(F.col("d"), "user.tags", as_type="array<variant>")).cast("bigint").alias("tags"),
    )


@query(
    "jsn5_delete",
    f"""WITH {DOCS} SELECT event_id, false AS has_v, json_array_length(doc, '$.user.tags') - 1 AS tags, 'true' AS last_tag FROM docs""",
)
def _(t):
    c = jsonedit.delete_value(jsonedit.delete_value(F.col("doc"), "v"), "user.tags[1]")
    return docs(t).select("event_id", F.parse_json(c).alias("d")).select(
        "event_id",
        jsondoc.has(F.col("d"), "v").alias("has_v"),
        F.size(jsondoc.get(F.col("d"), "user.tags", as_type="array<variant>")).cast("bigint").alias("tags"),
        jsondoc.get(F.col("d"), "user.tags[1]").alias("last_tag"),
    )


# The second version of each document: other texts, types, members and items.
DOC_B = f"""CASE event_id % 5 WHEN 0 THEN replace({DOC}, '"none"', '"other"') WHEN 1 THEN replace({DOC}, ',null,true]', ']')
  WHEN 2 THEN replace({DOC}, '"p":' || props, '"p":7') WHEN 3 THEN replace({DOC}, '"o":{{}}', '"q":{{"a":[1]}}') ELSE {DOC} END"""


def docs_b(t):
    doc, i = F.col("doc"), F.col("event_id")
    r = lambda old, new: F.replace(doc, old, F.lit(new))
    text = (
        F.when(i % 5 == 0, r(F.lit('"none"'), '"other"'))
        .when(i % 5 == 1, r(F.lit(",null,true]"), "]"))
        .when(i % 5 == 2, F.regexp_replace(doc, r'"p":\{[^}]*\}', '"p":7'))
        .when(i % 5 == 3, r(F.lit('"o":{}'), '"q":{"a":[1]}'))
        .otherwise(doc)
    )
    return docs(t).withColumn("doc", text)


@query(
    "dif5_json_diff",
    """SELECT event_id, '$.v' AS path, 'modified' AS status FROM events WHERE event_id % 30 IN (6, 18) AND event_id % 5 = 0
       UNION ALL SELECT event_id, '$.v', 'modified' FROM events WHERE event_id % 6 = 0 AND event_id % 4 <> 0 AND event_id % 5 = 0
       UNION ALL SELECT event_id, unnest(['$.user.tags[1]', '$.user.tags[2]']), 'removed' FROM events WHERE event_id % 5 = 1
       UNION ALL SELECT event_id, '$.p', 'modified' FROM events WHERE event_id % 5 = 2
       UNION ALL SELECT event_id, '$.o', 'removed' FROM events WHERE event_id % 5 = 3
       UNION ALL SELECT event_id, '$.q', 'added' FROM events WHERE event_id % 5 = 3""",
)
def _(t):
    return jsondoc.json_diff(docs(t), docs_b(t), ["event_id"], "doc").select("event_id", "path", "status")


@query(
    "jsn8_diff_values",
    f"""WITH n AS (SELECT event_id, json_extract_string(doc, '$.p.k') AS old FROM (SELECT event_id, {DOC} AS doc FROM events))
       SELECT event_id, 'type changed from object to number' AS details, '{{"k":' || old || '}}' AS old, '7' AS new FROM n WHERE event_id % 5 = 2""",
)
def _(t):
    found = jsondoc.json_diff(docs(t), docs_b(t), ["event_id"], "doc")
    return found.filter("path = '$.p'").select("event_id", "details", "old", "new")


@query(
    "jsn7_create_patch",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 6 = 0 AND event_id % 4 <> 0 THEN '[{"op":"replace","path":"/v","value":"other"}]' ELSE '[]' END
       WHEN 1 THEN '[{"op":"replace","path":"/user/tags","value":["' || event_type || '"]}]' WHEN 2 THEN '[{"op":"replace","path":"/p","value":7}]'
       WHEN 3 THEN '[{"op":"remove","path":"/o"},{"op":"add","path":"/q","value":{"a":[1]}}]' ELSE '[]' END AS patch FROM events""",
)
def _(t):
    return jsondoc.create_patch(docs(t), docs_b(t), ["event_id"], "doc")


@query(
    "jsn6_apply_patch",
    """SELECT event_id, true AS same, CAST(NULL AS VARCHAR) AS error FROM events""",
)
def _(t):
    a, b = docs(t), docs_b(t)
    patches = jsondoc.create_patch(a, b, ["event_id"], "doc")
    both = a.join(b.withColumnRenamed("doc", "want"), "event_id").join(patches, "event_id")
    out = both.select("event_id", "want", jsonedit.apply_patch(F.col("doc"), F.col("patch")).alias("r"))
    same = F.to_json(F.parse_json("r.result")) == F.to_json(F.parse_json("want"))
    return out.select("event_id", same.alias("same"), F.col("r.error").alias("error"))


@query(
    "jsn9_flatten",
    f"""WITH {DOCS} SELECT event_id, replace(replace(replace(substr(fullkey, 3), '[', '/'), ']', ''), '.', '/') AS name,
         CASE WHEN type = 'DOUBLE' THEN regexp_replace(CAST(atom AS VARCHAR), '[.]0$', '') ELSE CAST(value AS VARCHAR) END AS value
       FROM (SELECT event_id, j.* FROM docs, json_tree(doc) j)
       WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('[]', '{{}}')""",
)
def _(t):
    return jsondoc.flatten(docs(t), "doc", ["event_id"], "/")


@query(
    "jsn10_unflatten",
    """SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS second FROM events""",
)
def _(t):
    flat = F.concat(
        F.lit('{"a.b.0":"'), F.col("event_type"), F.lit('","a.b.1":'), F.col("user_id").cast("string"), F.lit("}")
    )
    return t.events.select("event_id", F.parse_json(jsonedit.unflatten(flat)).alias("d")).select(
        "event_id", jsondoc.get(F.col("d"), "a.b[0]").alias("kind"), jsondoc.get(F.col("d"), "a.b[1]").alias("second")
    )


@query(
    "jsn11_rename_key",
    f"""WITH {DOCS} SELECT event_id, replace(replace(doc, '"n":', '"number":'), '"k": ', '"k":') AS doc FROM docs""",
)
def _(t):
    return docs(t).select("event_id", jsonedit.rename_key(F.col("doc"), "n", "number").alias("doc"))


@query(
    "jsn12_deep_merge",
    """SELECT event_id, '{"a":{"x":1,"y":' || user_id || '},"t":["p","' || event_type || '"],"z":' || event_id || '}' AS doc FROM events""",
)
def _(t):
    right = F.concat(
        F.lit('{"a":{"y":'), F.col("user_id").cast("string"), F.lit('},"t":["'), F.col("event_type"), F.lit('"],"z":'),
        F.col("event_id").cast("string"), F.lit("}"),
    )
    return t.events.select("event_id", jsonedit.deep_merge(F.lit('{"a":{"x":1,"y":0},"t":["p"]}'), right).alias("doc"))


@query(
    "jsn13_reorder_keys",
    """SELECT event_id, '{"z":{"c":3,"a":1},"b":"' || event_type || '","a":[{"z":1,"y":2}]}' AS reordered,
       '{"a":[{"y":2,"z":1}],"b":"' || event_type || '","z":{"a":1,"c":3}}' AS sorted FROM events""",
)
def _(t):
    doc = F.concat(F.lit('{"b":"'), F.col("event_type"), F.lit('","a":[{"y":2,"z":1}],"z":{"a":1,"c":3}}'))
    df = t.events.select("event_id", doc.alias("doc"))
    return df.select(
        "event_id",
        jsonedit.reorder_keys(F.col("doc"), ["z", "c"]).alias("reordered"),
        jsonedit.sort_keys(F.col("doc")).alias("sorted"),
    )


@query(
    "jsn14_jsonpath",
    f"""WITH {DOCS} SELECT event_id, CAST(json_extract(doc, '$.user.n') AS VARCHAR) AS value FROM docs
       WHERE CAST(json_extract(doc, '$.p.k') AS BIGINT) > 50""",
)
def _(t):
    # The document is put into an array, filtered by a member and walked on.
    df = docs(t).select("event_id", F.concat(F.lit('{"items":['), F.regexp_replace("doc", r'"p":\{"k"', r'"k"').alias("doc"), F.lit("]}")).alias("doc"))
    fixed = df.withColumn("doc", F.regexp_replace("doc", r'("k":\s*\d+)\}', "$1"))
    return jsondoc.query(fixed, "doc", ["event_id"], "$.items[?(@.k > 50)].user.n")


@query(
    "jsn15_batch_query",
    f"""WITH {DOCS} SELECT event_id, 'who' AS name, CAST(json_extract(doc, '$.user.n') AS VARCHAR) AS value FROM docs
       UNION ALL SELECT event_id, 'tags', unnest([CAST(json_extract(doc, '$.user.tags[0]') AS VARCHAR), 'null', 'true']) FROM docs
       UNION ALL SELECT event_id, 'deep', CAST(json_extract(doc, '$.p.k') AS VARCHAR) FROM docs""",
)
def _(t):
    return jsondoc.batch_query(docs(t), "doc", ["event_id"], {"who": "$.user.n", "tags": "$.user.tags[*]", "deep": "$..k"})


@query(
    "jsn16_find_paths",
    f"""WITH {DOCS} SELECT event_id, j.fullkey AS path FROM docs, json_tree(doc) j WHERE j.type IN ('BIGINT', 'UBIGINT') AND CAST(j.atom AS BIGINT) > 40""",
)
def _(t):
    nodes = jsondoc.typed_nodes(jsondoc.node_table(docs(t), "doc", ["event_id"]))
    whole = as_double(F.col("v")) == F.floor(as_double(F.col("v")))
    hits = jsondoc.find_paths(nodes, lambda n: (n["type"] == "number") & whole & ~F.col("path").endswith(".v") & (as_double(n["v"]) > 40))
    return hits.select("event_id", "path")


@query(
    "jsn17_to_table",
    f"""WITH {DOCS} SELECT event_id, json_extract_string(doc, '$.id') AS id, regexp_replace(json_extract_string(doc, '$.v'), '[.]0$', '') AS v FROM docs""",
)
def _(t):
    return jsondoc.to_table(docs(t), "doc", ["event_id"]).select("event_id", "id", "v")


@query(
    "jsn18_stringify",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":' || coalesce('"' || nullif(o_orderstatus, 'P') || '"', 'null') || '}' AS json FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    rows = df.select("o_orderkey", F.struct("o_orderkey", "status").alias("s"))
    return rows.select("o_orderkey", F.to_json("s", {"ignoreNullFields": "false"}).alias("json"))


# --- profiles ---------------------------------------------------------------


@query(
    "prf6_document_metrics",
    f"""WITH {DOCS}, n AS (SELECT event_id, j.type, j.key, j.fullkey, j.atom FROM docs, json_tree(doc) j)
       SELECT event_id, count(*) AS nodes, count(*) FILTER (type = 'OBJECT') AS objects, count(*) FILTER (type = 'ARRAY') AS arrays,
         count(*) FILTER (type = 'VARCHAR') AS strings, count(*) FILTER (type IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS numbers,
         count(*) FILTER (type = 'BOOLEAN') AS booleans, count(*) FILTER (type = 'NULL') AS nulls,
         count(*) FILTER (NOT ends_with(fullkey, ']') AND fullkey <> '$') AS keys_total,
         max(len(regexp_extract_all(fullkey, '[.\\[]')) + 1) AS max_depth,
         max(CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(atom AS VARCHAR) AS DOUBLE) END) AS num_max
       FROM n GROUP BY event_id""",
)
def _(t):
    m = jsondoc.document_metrics(docs(t), "doc", ["event_id"])
    return m.select(
        "event_id", "nodes", "objects", "arrays", "strings", "numbers", "booleans", "nulls", "keys_total",
        F.col("max_depth").cast("bigint").alias("max_depth"), "num_max",
    )


@query(
    "prf7_schema_paths",
    f"""WITH {DOCS}, n AS (SELECT regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS place, {TYPE.replace('type', 'j.type')} AS t,
         CASE WHEN j.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(j.atom AS VARCHAR) AS DOUBLE) END AS x FROM docs, json_tree(doc) j),
       k AS (SELECT place, CASE WHEN x = floor(x) THEN 'integer' ELSE t END AS t FROM n)
       SELECT place, count(*) AS present, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM k GROUP BY place""",
)
def _(t):
    return jsondoc.schema_paths(docs(t), "doc").select("place", "present", F.array_join("types", ",").alias("types"))


@query(
    "prf7_schema_tree",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS v FROM events)
       SELECT unnest(['', '/a.b', '/a', '/a/b', '/s~1t', '/s~1t/*', '/s~1t/*/~2', '/s~1t/*/*', '/v']) AS pointer,
         unnest([NULL, '', '', '/a', '', '/s~1t', '/s~1t/*', '/s~1t/*', '']) AS parent,
         unnest([NULL, 'a.b', 'a', 'b', 's/t', NULL, '*', NULL, 'v']) AS key,
         unnest(['object', 'integer', 'object', 'string', 'array', 'array,object', 'number', 'boolean', 'null']) AS types,
         unnest([false, true, true, true, true, false, true, false, false]) AS required,
         unnest([n, n, n, n, n, 2 * n, n, n, v]) AS present FROM c""",
)
def _(t):
    """Keys with dots, slashes and a star, told apart by their place in the tree."""
    i = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{"a.b":'), i, F.lit(',"a":{"b":"'), F.col("event_type"), F.lit('"},"s/t":[{"*":'), i,
        F.when(F.col("event_id") % 2 == 0, "").otherwise(".5"), F.lit("},[true]]"),
        F.when(F.col("event_id") % 3 == 0, ',"v":null').otherwise(""), F.lit("}"),
    )
    rows = jsondoc.schema_rows(spread(t.events).select(text.alias("doc")), "doc")
    return rows.select("pointer", "parent", "key", F.array_join("types", ",").alias("types"), "required", "present")


@query(
    "dif5_large_integers",
    """SELECT event_id, '/n' AS pointer, CAST(9007199254740992 + event_id AS VARCHAR) AS old, CAST(9007199254740993 + event_id AS VARCHAR) AS new
       FROM events WHERE event_id % 2 = 1""",
)
def _(t):
    """Whole numbers beyond 2^53 that differ in their last digit; equal numbers in other spellings do not."""
    n = lambda add: F.concat(
        F.lit('{"n":'), (F.lit(9007199254740992) + F.col("event_id") + add).cast("string"), F.lit(',"e":'), F.lit("1e2" if add is ODD else "100.0"), F.lit("}")
    )
    ODD = F.col("event_id") % 2
    a, b = (spread(t.events).select("event_id", n(add).alias("doc")) for add in (F.lit(0), ODD))
    return jsondoc.json_diff(a, b, ["event_id"], "doc").select("event_id", "pointer", "old", "new")


@query(
    "prf8_collection_anomalies",
    f"""WITH {DOCS}, c AS (SELECT count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS v, count(*) FILTER (event_id % 9 = 0) AS arrays,
         count(*) FILTER (event_id % 4 <> 0 AND event_id % 9 <> 0) AS v_in FROM docs)
       SELECT 'missing key' AS issue, k AS key, CASE k WHEN 'v' THEN v_in ELSE n - arrays END AS present,
         CASE k WHEN 'v' THEN n - v_in ELSE arrays END AS missing,
         CAST(floor(CASE k WHEN 'v' THEN n - v_in ELSE arrays END / n * 100 + 0.5) AS INTEGER) AS percentage, CAST(NULL AS VARCHAR) AS types
       FROM c, (SELECT unnest(['id', 'user', 'p', 'v', 'e', 'o']) AS k)
       UNION ALL SELECT 'mixed types', 'v', v_in, NULL, NULL, 'number,string' FROM c
       UNION ALL SELECT 'not an object', NULL, arrays, NULL, NULL, NULL FROM c""",
)
def _(t):
    df = docs(t).withColumn("doc", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("["), "doc", F.lit("]"))).otherwise(F.col("doc")))
    return jsondoc.collection_anomalies(df, "doc")


@query(
    "prf9_outline",
    f"""WITH {DOCS} SELECT event_id, j.fullkey AS path, {TYPE.replace('type', 'j.type')} AS type,
         CAST(CASE j.type WHEN 'ARRAY' THEN json_array_length(j.value) WHEN 'OBJECT' THEN len(json_keys(j.value)) END AS INTEGER) AS size
       FROM docs, json_tree(doc) j WHERE NOT regexp_matches(j.fullkey, '\\[[1-9]')""",
)
def _(t):
    return jsondoc.outline(docs(t), "doc", ["event_id"]).select("event_id", "path", "type", "size")


# --- syntax and schema ------------------------------------------------------


@query(
    "val8_json_syntax",
    """SELECT event_id, CAST(1 AS INTEGER) AS line, CAST(6 + length(CAST(event_id AS VARCHAR)) AS INTEGER) AS col FROM events WHERE event_id % 5 = 0""",
)
def _(t):
    broken = F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, " x").otherwise("}"))
    df = t.events.select("event_id", broken.alias("doc"))
    out = df.select("event_id", jsonedit.syntax_error(F.col("doc")).alias("e")).filter("e is not null")
    return out.select("event_id", F.col("e.line").alias("line"), (F.col("e.col") - 1).alias("col"))


def _violations(t, schema):
    return jsonschema.validate(docs(t), "doc", schema, ["event_id"]).select("event_id", "path", "keyword")


@query(
    "val9_schema_type_const_enum",
    """SELECT event_id, 'v' AS path, 'type' AS keyword FROM events WHERE event_id % 6 = 0 AND event_id % 4 <> 0
       UNION ALL SELECT event_id, 'user.tags[0]', 'enum' FROM events WHERE event_type NOT IN ('click', 'view')
       UNION ALL SELECT event_id, 'p.k', 'const' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 7""",
)
def _(t):
    return _violations(
        t,
        {
            "type": "object",
            "properties": {
                "v": {"type": ["number", "null"]},
                "p": {"properties": {"k": {"type": "integer", "const": 7}}},
                "user": {"properties": {"tags": {"items": [{"enum": ["click", "view"]}]}}},
            },
        },
    )


@query(
    "val10_schema_numbers",
    """WITH e AS (SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 4 <> 0 AND event_id % 6 <> 0 AS has_v FROM events)
       SELECT event_id, 'p.k' AS path, 'minimum' AS keyword FROM e WHERE k < 10 UNION ALL SELECT event_id, 'p.k', 'maximum' FROM e WHERE k > 90
       UNION ALL SELECT event_id, 'p.k', 'multipleOf' FROM e WHERE k % 3 <> 0
       UNION ALL SELECT event_id, 'user.n', 'exclusiveMinimum' FROM e WHERE user_id <= 5
       UNION ALL SELECT event_id, 'user.n', 'exclusiveMaximum' FROM e WHERE user_id >= 100
       UNION ALL SELECT event_id, 'v', 'multipleOf' FROM e WHERE has_v AND CAST(value AS DECIMAL(18, 4)) % 0.05 <> 0""",
)
def _(t):
    return _violations(
        t,
        {
            "properties": {
                "p": {"properties": {"k": {"minimum": 10, "maximum": 90, "multipleOf": 3}}},
                "user": {"properties": {"n": {"exclusiveMinimum": 5, "exclusiveMaximum": 100}}},
                "v": {"multipleOf": 0.05},
            }
        },
    )


@query(
    "val11_schema_strings",
    """SELECT event_id, 'user.tags[0]' AS path, 'minLength' AS keyword FROM events WHERE length(event_type) < 5
       UNION ALL SELECT event_id, 'user.tags[0]', 'maxLength' FROM events WHERE length(event_type) > 6
       UNION ALL SELECT event_id, 'user.tags[0]', 'pattern' FROM events WHERE NOT regexp_matches(event_type, '^[c-p]')
       UNION ALL SELECT event_id, 'user.tags[0]', 'format' FROM events""",
)
def _(t):
    return _violations(
        t,
        {
            "properties": {
                "user": {
                    "properties": {
                        "tags": {"prefixItems": [{"minLength": 5, "maxLength": 6, "pattern": "^[c-p]", "format": "email"}]}
                    }
                }
            }
        },
    )


@query(
    "val12_schema_arrays",
    """SELECT event_id, 'e' AS path, 'minItems' AS keyword FROM events UNION ALL SELECT event_id, 'user.tags', 'maxItems' FROM events
       UNION ALL SELECT event_id, 'user.tags[1]', 'type' FROM events UNION ALL SELECT event_id, 'user.tags[2]', 'type' FROM events""",
)
def _(t):
    return _violations(
        t,
        {
            "properties": {
                "e": {"minItems": 1, "uniqueItems": True},
                "user": {"properties": {"tags": {"maxItems": 2, "uniqueItems": True, "items": {"type": "string"}}}},
            }
        },
    )


@query(
    "val13_schema_objects",
    """SELECT event_id, 'v' AS path, 'required' AS keyword FROM events WHERE event_id % 4 = 0
       UNION ALL SELECT event_id, unnest(['e', 'o']), 'additionalProperties' FROM events
       UNION ALL SELECT event_id, 'user.tags', 'type' FROM events""",
)
def _(t):
    return _violations(
        t,
        {
            "required": ["id", "v"],
            "properties": {"id": True, "p": {}, "v": {}, "user": {"additionalProperties": {"type": "number"}}},
            "additionalProperties": False,
        },
    )


@query(
    "val14_schema_combined",
    """SELECT event_id, 'v' AS path, 'anyOf' AS keyword FROM events WHERE event_id % 4 <> 0 AND event_id % 6 <> 0 AND value < 5
       UNION ALL SELECT event_id, 'user.n', 'oneOf' FROM events WHERE user_id BETWEEN 10 AND 20
       UNION ALL SELECT event_id, 'p.k', 'not' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7
       UNION ALL SELECT event_id, 'v', 'dependentRequired' FROM events WHERE event_id % 4 = 0
       UNION ALL SELECT event_id, '', 'maxProperties' FROM events WHERE event_id % 4 <> 0
       UNION ALL SELECT event_id, 'p.k', 'minimum' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 3""",
)
def _(t):
    return _violations(
        t,
        {
            "$defs": {"low": {"minimum": 3}},
            "maxProperties": 5,
            "dependentRequired": {"id": ["v"]},
            "properties": {
                "v": {"anyOf": [{"type": "string"}, {"minimum": 5}]},
                "user": {"properties": {"n": {"oneOf": [{"minimum": 10}, {"maximum": 20}]}}},
                "p": {"properties": {"k": {"not": {"const": 7}, "allOf": [{"$ref": "#/$defs/low"}]}}},
            },
        },
    )


# --- cleaning ---------------------------------------------------------------


@query(
    "cln8_json_clean",
    """SELECT event_id, '{"a":"x","n":' || user_id || ',"t":["' || event_type || '"]}' AS doc FROM events""",
)
def _(t):
    raw = F.concat(
        F.lit('{"z":null,"t":["'), F.col("event_type"), F.lit(' ","",null],"n":"'), F.col("user_id").cast("string"),
        F.lit('","e":{"x":[]},"a":" x "}'),
    )
    c = jsonedit.clean_json(raw, strip_nulls=True, strip_empty=True, trim=True, sort_keys=True, coerce=True)
    return t.events.select("event_id", c.alias("doc"))


@query(
    "cln9_json_repair",
    """SELECT event_id, '{"a": "it' || chr(39) || 's",  "b": [1, 2], "c": null,' || chr(10) || '"d": ' || user_id || '}' AS doc FROM events""",
)
def _(t):
    raw = F.concat(
        F.lit("{a: 'it\\'s', /* note */ 'b': [1, 2,], c: undefined\n\"d\": "), F.col("user_id").cast("string"), F.lit(",} // end")
    )
    return t.events.select("event_id", jsonedit.repair(raw).alias("doc"))


@query(
    "cln10_json_format",
    """SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS doc FROM events""",
)
def _(t):
    return t.events.select("event_id", jsonedit.format_json(F.col("props"), 2).alias("doc"))


@query(
    "cln16_mask_sensitive",
    """SELECT c_custkey, '{"name":"' || c_name || '","apiKey":"********","in":[{"AuthCode":"********","x":1}]}' AS doc, '********' AS secret FROM customer""",
)
def _(t):
    raw = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","apiKey":"k1","in":[{"AuthCode":{"v":2},"x":1}]}'))
    df = t.customer.select("c_custkey", raw.alias("doc"), F.struct(F.col("c_name").alias("secretName")).alias("s"))
    masked = jsonedit.struct_masked(F.col("s"), df.schema["s"].dataType)
    return df.select("c_custkey", jsonedit.mask_sensitive(F.col("doc")).alias("doc"), masked["secretName"].alias("secret"))


@query(
    "snk16_compact_json",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS doc FROM events""",
)
def _(t):
    return t.events.select("event_id", jsonedit.minify(F.col("props")).alias("doc"))


@query("fx8_unescape", """SELECT p_partkey, p_name || chr(10) || '"' || p_brand AS text FROM part""")
def _(t):
    escaped = F.concat(F.lit('"'), "p_name", F.lit('\\n\\"'), "p_brand", F.lit('"'))
    return t.part.select("p_partkey", as_text(F.try_parse_json(escaped)).alias("text"))
