"""Operators on small literal inputs, and properties that must hold."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablekit.functions import fx
from tablekit.functions.coerce import natural_key
from tablekit.functions.jsonpaths import tokens
from tablekit.operators import agg, clean, diff, edit, impute, joins, jsondoc, jsonedit, jsonschema, ledger, pagetext, profile, rules, xmldoc
from tablekit.operators.rows import dense_rows, running_total


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


# --- rows -------------------------------------------------------------------


def test_dense_rows_and_running_total(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = column(spark, values, "bigint").repartition(7)
    assert all(r.p == 499 - r.c for r in dense_rows(df, [F.col("c").desc()], "p").collect())
    total = running_total(df, ["c"], F.col("c"), "before").collect()
    assert all(r.before == r.c * (r.c - 1) // 2 for r in total)


def test_hot_value_medians(spark):
    """A third of all rows hold one value; the medians stay exact."""
    rng = random.Random(2)
    rows = [(rng.choice("ab"), 7.0 if rng.random() < 0.34 else rng.uniform(0, 20)) for _ in range(3001)]
    got = {r.g: r.m for r in agg.median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    for g in "ab":
        assert got[g] == statistics.median(v for k, v in rows if k == g)


def test_natural_order(spark):
    df = column(spark, ["item10", "Item2", "item02b", "item1", "Äpfel", "apfel2"])
    got = [r.c for r in df.orderBy(natural_key(F.col("c")), "c").collect()]
    assert got == ["Äpfel", "apfel2", "item1", "Item2", "item02b", "item10"]


# --- edits and joins --------------------------------------------------------


def test_like_and_missing_columns(spark):
    df = column(spark, ["a.b", "axb", "A%B", None])
    assert df.filter(edit.like(F.col("c"), "a.b")).count() == 3
    assert [r.c for r in df.filter(edit.like(F.col("c"), "a.b", escape=True)).collect()] == ["a.b"]
    assert edit.select(df, ["zz"]).columns == ["zz"]
    assert edit.delete(df, lambda d: d.c == "axb").count() == 3
    assert edit.filter_rows(df, {"c": {"$ne": "axb"}}).count() == 3


def test_null_safe_join_and_lookup_errors(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert joins.join(a, b, "k").count() == 1
    assert joins.join(a, b, "k", null_safe=True).count() == 2
    table = spark.createDataFrame([("x", "first", 0), ("x", "second", 1)], "k string, n string, _row int")
    out = {r.k: r.lookup for r in joins.lookup(a, "k", table, 2).collect()}
    assert out == {None: "#N/A", "x": "first"}
    assert joins.lookup(a, "k", table, 3).first().lookup == "#REF!"


def test_first_rule_long_list(spark):
    df = column(spark, ["has R250 and r251", "none"])
    many = [(f"r{i}", str(i)) for i in range(100, 400)]
    assert [r.c for r in df.select(joins.first_rule(F.col("c"), many).alias("c")).collect()] == ["250", None]
    assert df.select(joins.first_rule(F.col("c"), [(r"R\d+ and", "yes")], regex=True).alias("c")).first().c == "yes"


def test_diff_of_a_table_with_itself_and_swapped(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, " y", 1), (2, "z", 2)], "k int, v string, _row int")
    b = spark.createDataFrame([(1, "X", 0), (3, "n", 1)], "k int, v string, _row int")
    assert diff.diff_summary(diff.table_diff(a, a, ["k"])).first().identical
    one = diff.diff_summary(diff.table_diff(a, b, ["k"])).first()
    two = diff.diff_summary(diff.table_diff(b, a, ["k"])).first()
    assert (one.added, one.removed, one.modified) == (two.removed, two.added, two.modified) == (1, 1, 1)
    assert diff.diff_summary(diff.table_diff(a, b, ["k"], ignore_case=True)).first().unchanged == 1


def test_line_edits_rebuild_the_text(spark):
    rng = random.Random(3)
    old = [rng.choice("abcd") for _ in range(60)]
    new = [x for x in old if rng.random() > 0.2] + ["tail"]
    a = spark.createDataFrame([(1, "\n".join(old))], "d int, text string")
    b = spark.createDataFrame([(1, "\n".join(new))], "d int, text string")
    rows = diff.line_edits(a, b, "d").collect()
    gone = {r.old_line for r in rows if r.op == "delete"}
    kept = iter([x for i, x in enumerate(old, 1) if i not in gone])
    put = {r.new_line: r.text for r in rows if r.op == "insert"}
    assert [put[i] if i in put else next(kept) for i in range(1, len(new) + 1)] == new


# --- profile, clean, rules --------------------------------------------------


def test_profile_types(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", "true", " "), ("2.5", "1/31/2024", "FALSE", None), ("x", "2024-02-30", "yes", "")],
        "n string, d string, b string, e string",
    )
    p = {r.column: r for r in profile.column_profile(df).collect()}
    assert (p["n"].integer_cells, p["n"].float_cells, p["n"].string_cells, p["n"].sum_value) == (1, 1, 1, 3.5)
    assert (p["d"].date_cells, p["d"].string_cells) == (2, 1)
    assert p["b"].boolean_cells == 2 and p["e"].missing_rate == 1.0


def test_headers_and_dedup(spark):
    assert clean.header_name("First Name (x)", "snake_case") == "first_name_x"
    assert clean.header_name("First name-x", "camelCase") == "firstNameX"
    assert clean.unique_headers(["a", "", "a", ""]) == ["a", "column", "a_2", "column_2"]
    df = spark.createDataFrame([(i, "hot" if i % 3 else str(i), 1) for i in range(90)], "_row int, k string, v int")
    once = clean.dedup(df, "k")
    assert once.count() == 31 and clean.dedup(once, "k").count() == 31
    assert once.filter("k = 'hot'").first()._row == 1


def test_repeats_of_a_hot_value(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else str(i)) for i in range(100)], "_row int, k string")
    found = rules.validate(df, {"k": {"unique": True}}).collect()
    assert len(found) == 49 and min(r._row for r in found) == 3


# --- JSON -------------------------------------------------------------------

DOCS = [
    '{"a":{"b":[1,{"c":null}],"x~/y":"s"},"t":true}',
    '{"a":{"b":[1,{"c":2},3],"n":1.5},"u":[]}',
    "[1,[2,[3]]]",
    '"text"',
    "not json",
]


def docs(spark, texts=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), "d int, j string")


def walk(node, path="$"):
    yield path
    items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for k, v in items:
        yield from walk(v, f"{path}.{k}" if isinstance(node, dict) else f"{path}[{k}]")


def test_node_table_finds_every_node(spark):
    got = sorted((r.d, r.path) for r in jsondoc.node_table(docs(spark), "j", ["d"]).collect())
    want = sorted((i, p) for i, t in enumerate(DOCS[:4]) for p in walk(json.loads(t)))
    assert got == want


def test_patch_round_trip(spark):
    pairs = [(0, 1), (1, 0), (2, 2), (0, 3), (3, 2)]
    a = spark.createDataFrame([(i, DOCS[x]) for i, (x, _) in enumerate(pairs)], "d int, j string")
    b = spark.createDataFrame([(i, DOCS[y]) for i, (_, y) in enumerate(pairs)], "d int, j string")
    patches = jsondoc.create_patch(a, b, ["d"], "j")
    done = a.join(patches, "d").select("d", "patch", jsonedit.apply_patch(F.col("j"), F.col("patch")).alias("r")).orderBy("d").collect()
    for (_, y), r in zip(pairs, done):
        assert r.r.error is None and json.loads(r.r.result) == json.loads(DOCS[y]), r.patch
    assert jsondoc.json_diff(a, a, ["d"], "j").count() == 0


def test_json_diff_opens_only_what_differs(spark):
    a = spark.createDataFrame([(1, '{"u":{"t":[1,2],"n":{"k":"[{\\"}"}},"v":1.0,"g":[1,{"x":1}]}')], "d int, j string")
    b = spark.createDataFrame([(1, '{"g":[1,{"x":2}],"v":1e0,"u":{"n":{"k":"[{\\"}"},"t":[1,2]},"a/\\"b":null}')], "d int, j string")
    leaves = jsondoc.paired_leaves(a, b, ["d"], "j")
    assert sorted(r.pointer for r in leaves.collect()) == ['/a~1"b', "/g/0", "/g/1/x", "/u/n/k", "/u/t/0", "/u/t/1", "/v"]
    walked = jsondoc.paired_leaves(a, b, ["d"], "j", equal=False)
    # Values of other text may still be equal, as 1.0 and 1e0; subtrees of the same text are not gone into.
    assert sorted(r.pointer for r in walked.collect()) in (['/a~1"b', "/g/1/x"], ['/a~1"b', "/g/1/x", "/v"])
    changed = {(r.pointer, r.status, r.old, r.new) for r in jsondoc.json_diff(a, b, ["d"], "j").collect()}
    assert changed == {('/a~1"b', "added", None, "null"), ("/g/1/x", "modified", "1", "2")}
    assert [r.patch for r in jsondoc.create_patch(a, b, ["d"], "j").collect()] == [
        '[{"op":"add","path":"/a~1\\"b","value":null},{"op":"replace","path":"/g/1/x","value":2}]'
    ]


def test_flatten_and_back(spark):
    df = docs(spark, [DOCS[1]])
    flat = {r.name: json.loads(r.value) for r in jsondoc.flatten(df, "j", ["d"]).collect()}
    assert flat == {"a.b.0": 1, "a.b.1.c": 2, "a.b.2": 3, "a.n": 1.5, "u": []}
    text = column(spark, [json.dumps(flat)])
    assert json.loads(text.select(jsonedit.unflatten(F.col("c"))).first()[0]) == json.loads(DOCS[1])


def test_patch_errors_and_paths(spark):
    df = spark.createDataFrame([('{"a":[1]}', p) for p in (
        '[{"op":"replace","path":"/b","value":1}]', '[{"op":"test","path":"/a/0","value":2}]',
        '[{"op":"move","from":"/a","path":"/c/d"},{"op":"copy","from":"/c/d/0","path":"/e"}]', '[{"op":"add","path":"/a/0","value":9}]',
    )], "d string, p string")
    rows = [r[0] for r in df.select(jsonedit.apply_patch(F.col("d"), F.col("p"))).collect()]
    assert [r.error is None for r in rows] == [False, False, True, True]
    assert [r.result for r in rows[2:]] == ['{"c":{"d":[1]},"e":1}', '{"a":[9]}']
    assert tokens("a['x.y'][0].b") == ["a", "x.y", "0", "b"] and tokens("/a~1b/~0") == ["a/b", "~"]


def test_jsonpath(spark):
    df = docs(spark, ['{"items":[{"n":1,"s":"a"},{"n":5,"s":"b"},{"s":"b"}],"o":{"n":7}}'])

    def q(path):
        return sorted(r.value for r in jsondoc.query(df, "j", [], path).collect())

    assert q("$.items[*].n") == ["1", "5"] and q("$..n") == ["1", "5", "7"]
    assert q("$.items[?(@.s == 'b')].n") == ["5"] and q("$.items[?(@.n != 5)].s") == ['"a"', '"b"']
    assert q("$.items[?(@.n == null)].s") == ['"b"'] and q("$['o']['n']") == ["7"] and q("$.items[9]") == []


def test_schema_of_profile(spark):
    schema = {
        "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "minimum": 1},
            "name": {"type": "string", "minLength": 3, "pattern": "^[a-z]+$"},
            "mail": {"format": "email"},
            "roles": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": ["a", "b"]}},
            "share": {"multipleOf": 0.01},
        },
    }
    texts = [
        '{"id":1,"name":"abc","mail":"x@y.zz","roles":["a","b"],"share":0.29}',
        '{"id":0,"name":"A","mail":"no","roles":["a","a","c"],"more":1}',
        '{"name":5,"roles":[]}',
        "[]",
    ]
    rows = jsonschema.validate(docs(spark, texts), "j", schema, ["d"]).collect()
    got = sorted((r.d, r.path, r.keyword) for r in rows)
    assert got == sorted([
        (1, "id", "minimum"), (1, "name", "minLength"), (1, "name", "pattern"), (1, "mail", "format"), (1, "roles[1]", "uniqueItems"),
        (1, "roles[2]", "enum"), (1, "more", "additionalProperties"), (2, "id", "required"), (2, "name", "type"), (2, "roles", "minItems"), (3, "", "type"),
    ])
    with pytest.raises(ValueError):
        jsonschema.errors(F.lit(None), {"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"})


def test_inferred_schema(spark):
    s = jsondoc.infer_schema(docs(spark, ['{"a":1,"m":"x@y.zz","l":[{"k":1}]}', '{"a":1.5,"l":[]}']), "j")
    assert s["properties"]["a"] == {"type": "number"} and s["required"] == ["a", "l"]
    assert s["properties"]["m"]["format"] == "email" and s["properties"]["l"]["items"]["properties"]["k"] == {"type": "integer"}


def test_json_repair_and_mask(spark):
    messy = column(spark, ["{a: 1, /* x */ 'b': 'say \"hi\"', c: [1,2,], d: undefined}", '{"ok":"http://x"}'])
    got = [json.loads(r[0]) for r in messy.select(jsonedit.repair(F.col("c"))).collect()]
    assert got == [{"a": 1, "b": 'say "hi"', "c": [1, 2], "d": None}, {"ok": "http://x"}]
    masked = column(spark, ['{"Password":"p","in":[{"apiToken":{"x":1},"n":1}]}']).select(jsonedit.mask_sensitive(F.col("c"))).first()[0]
    assert json.loads(masked) == {"Password": "********", "in": [{"apiToken": "********", "n": 1}]}


# --- the rest ---------------------------------------------------------------


def test_xml(spark):
    xml = '<r><a id="1" class="x y">t</a><a>2</a><b><c/></b><!-- n --></r>'
    df = column(spark, [xml])
    assert xmldoc.css_to_xpath("a.x > b, #i") .startswith("//a[contains(")
    assert df.select(xmldoc.css_all(F.col("c"), "a[class*=y], b")).first()[0][0] == "t"
    assert json.loads(df.select(xmldoc.to_json(F.col("c"))).first()[0]) == {
        "r": {"a": [{"@id": 1, "@class": "x y", "#text": "t"}, 2], "b": {"c": ""}}
    }
    sort = xmldoc.edit(F.col("c"), [("sort", ".", lambda e: e.tag == "a"), ("unset", "a", "class")])
    assert df.select(sort).first()[0] == '<r><b><c /></b><a id="1">t</a><a>2</a></r>'
    bad = column(spark, ["<a><b></a>", "", "<a/>", "<a><!-- x -- y --></a>"])
    assert [r[0] is not None for r in bad.select(xmldoc.faults(F.col("c"))).collect()] == [True, True, False, True]


def test_spreadsheet_functions(spark):
    df = column(spark, ["x"])
    one = lambda c: df.select(c).first()[0]
    assert one(fx.fx_round(-2.5)) == -2.0 and one(fx.fx_mod(-7, 3)) == -1.0 and one(fx.fx_mod(7, 0)) == 0.0
    assert one(fx.fx_sqrt(-1)) is None and one(fx.fx_divide(1, 0)) is None
    assert one(fx.fx_proper("don't STOP me-now")) == "Don'T STOP Me-Now" and one(fx.fx_mid("hello", 2, 3)) == "ell"
    assert one(fx.fx_ifs(F.lit(False), "a")) == "#N/A" and one(fx.fx_compare("10", ">", "9")) is True
    assert one(fx.fx_now()) is not None and one(fx.fx_today()) is not None and len(one(fx.fx_uuid())) == 36
    assert one(fx.xml_unescape(F.lit("&amp;lt;&#x41;&#66;"))) == "&lt;AB"


def test_payees_and_masks(spark):
    df = column(spark, ["POS *Shop LLC", "ach- Store #12 Main St", "  A   B Inc."])
    assert [r[0] for r in df.select(ledger.normal_payee(F.col("c"))).collect()] == ["Shop", "Store", "A B"]
    assert [r[0] for r in column(spark, ["123", "12345678", None]).select(ledger.mask(F.col("c"))).collect()] == ["****", "****5678", "****"]


def test_lines_from_items(spark):
    items = [
        ("d", 1, 50.0, 100.0, 30.0, 10.0, "world"), ("d", 1, 10.0, 101.0, 30.0, 10.0, "hello"),
        ("d", 1, 10.0, 80.0, 20.0, 10.0, "next"), ("d", 1, 30.5, 80.0, 20.0, 10.0, "word"), ("d", 2, 1.0, 5.0, 5.0, 5.0, "two"),
    ]
    df = spark.createDataFrame(items, "doc string, page int, x double, y double, width double, height double, text string")
    got = sorted(tuple(r) for r in pagetext.assemble_lines(df).collect())
    assert got == [("d", 1, 1, "hello world"), ("d", 1, 2, "nextword"), ("d", 2, 1, "two")]


def test_knn_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(30)), rng.uniform(0, 9) if rng.random() < 0.7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "_row int, f double, t double")
    got = {r._row: r.t for r in impute.knn(df, "t", "f", 3).collect()}
    donors = [r for r in rows if r[2] is not None]
    for i, f, t in rows:
        near = sorted((abs(f - d[1]), d[0], d[2]) for d in donors)[:3]
        assert got[i] == pytest.approx(t if t is not None else sum(n[2] for n in near) / 3)


def test_mice_recovers_a_line(spark):
    rows = [(float(i), 2.0 * i + 1 if i % 5 else None, None if i % 7 == 3 else 3.0 - i) for i in range(60)]
    out = impute.mice(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 3).collect()
    assert all(abs(r.b - (2 * r.a + 1)) < 0.1 and abs(r.c - (3 - r.a)) < 0.1 for r in out)


def test_guide_frame(spark):
    rows = [(25.0, 50.0, "HR"), (None, 60.0, "IT"), (30.0, None, None), (35.0, 80.0, "IT"), (None, None, "HR"), (40.0, 90.0, "IT")]
    df = spark.createDataFrame(rows, "Age double, Salary double, Department string")
    report = {r.column: r.missing for r in impute.missing_report(df).collect()}
    assert report == {"Age": 2, "Salary": 2, "Department": 1} and impute.listwise(df).count() == 3
    filled = impute.impute(df, {"Age": "mean", "Salary": "median", "Department": "mode"}).collect()
    assert filled[1].Age == 32.5 and filled[2].Salary == 70.0 and filled[2].Department == "IT"


def test_repair_leaves_strings_alone(spark):
    texts = ["{a: 'see // here', b: 2}", '{"x": "a /* b */ c", y: undefined, z: [1, 2,],} // end', '{"a": 1\n "b": {c: true}\n d: [1 2]}']
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [json.loads(r[0]) for r in df.select(jsonedit.repair(F.col("c"))).collect()]
    assert got == [
        {"a": "see // here", "b": 2},
        {"x": "a /* b */ c", "y": None, "z": [1, 2]},
        {"a": 1, "b": {"c": True}, "d": [1, 2]},
    ]


def test_spread_by_rows(spark):
    """A table in many partitions with all rows in one is dealt out, and large ones to as many tasks as they need."""
    from tablekit.operators.rows import spread

    lumped = spark.range(1000, numPartitions=1).union(spark.createDataFrame([], "id bigint").repartition(9))
    sizes = [len(p) for p in spread(lumped).rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 500
    sizes = [len(p) for p in spread(lumped, 20).rdd.glom().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 50 and max(sizes) <= 40
    assert spread(lumped.limit(0)).count() == 0
