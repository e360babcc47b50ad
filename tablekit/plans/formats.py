"""Queries over sources, sinks, XML and YAML.

Sources are fed with files that the query writes from the tables into the
shared folder, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekit.functions.coerce import col
from tablekit.operators import geo, jsondoc, xmldoc, yamldoc
from tablekit.operators.rows import spread
from tablekit.plans.ledgers import TX, sheet_of, transactions
from tablekit.plans.places import XY, sites
from tablekit.plans.registry import ORACLES, query
from tablekit.session import new_folder
from tablekit.sinks import statements as statement_sink
from tablekit.sinks import texts
from tablekit.sources import documents, statements, tables
from tablekit.sources.lines import pieces

# --- tables -----------------------------------------------------------------

NOTE = """CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'a, "b" ' || o_orderstatus ELSE 'two' || chr(10) || 'lines' END"""


def noted_orders(t):
    k = F.col("o_orderkey")
    note = F.when(k % 3 == 0, "plain").when(k % 3 == 1, F.concat(F.lit('a, "b" '), "o_orderstatus")).otherwise("two\nlines")
    return t.orders.select("o_orderkey", note.alias("note"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


@query(
    "src1_read_csv",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {NOTE} AS note, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders",
)
def _(t):
    folder = new_folder(t.spark)
    texts.write_csv(noted_orders(t).withColumnRenamed("o_orderpriority", " priority "), folder)
    return tables.read_csv(t.spark, folder).drop("_row")


@query(
    "src1_other_headers",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def _(t):
    """Files with other columns, and the same ones in another order."""
    folder = new_folder(t.spark)
    columns = (["o_orderkey", "o_orderstatus"], ["o_orderpriority", "o_orderstatus", "o_orderkey"], ["o_orderpriority", "o_orderkey"])
    for k, names in enumerate(columns):
        texts.write_csv(t.orders.filter(F.col("o_orderkey") % 3 == k).select(*names), f"{folder}/{k}")
    return tables.read_csv(t.spark, f"{folder}/*").drop("_row")


@query("udf3_header_function", "SELECT CAST(o_orderkey AS VARCHAR) AS ORDERKEY, o_orderstatus AS ORDERSTATUS FROM orders")
def _(t):
    folder = new_folder(t.spark)
    texts.write_csv(t.orders.select("o_orderkey", "o_orderstatus"), folder)
    return tables.read_csv(t.spark, folder, transform_header=lambda n: n.removeprefix("o_").upper()).drop("_row")


@query(
    "src2_typing",
    """SELECT event_id, CAST(NULLIF(user_id, 3) AS BIGINT) AS a, value AS b, event_id % 2 = 0 AS c, CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS d FROM events""",
)
def _(t):
    i = F.col("event_id")
    df = t.events.select(
        "event_id",
        F.when(F.col("user_id") == 3, "NULL").otherwise(F.col("user_id").cast("string")).alias("a"),
        F.col("value").cast("string").alias("b"),
        F.when(i % 2 == 0, "TRUE").otherwise("false").alias("c"),
        F.when(i % 2 == 0, F.col("event_type")).otherwise(i.cast("string")).alias("d"),
    )
    return tables.typed_columns(df)


@query(
    "src2_typed_cells",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'null' ELSE 'string' END AS type FROM events""",
)
def _(t):
    from tablekit.functions.jsonpaths import json_type

    i = F.col("event_id")
    cell = F.when(i % 4 == 0, "TRUE").when(i % 4 == 1, F.col("value").cast("string")).when(i % 4 == 2, "null").otherwise(F.col("props"))
    return t.events.select("event_id", json_type(tables.typed_cell(cell)).alias("type"))


@query("src3_detect_delimiter", "SELECT unnest(['comma', 'semi', 'tab']) AS name, unnest([',', ';', chr(9)]) AS delimiter")
def _(t):
    base = new_folder(t.spark)
    for name, d in (("comma", ","), ("semi", ";"), ("tab", "\t")):
        lines = texts.csv_lines(noted_orders(t).withColumn("note", F.lit("a,b")), delimiter=d)
        texts.write_lines(lines, f"{base}/{name}")
    lines = pieces(t.spark, f"{base}/*")
    found = tables.detect_delimiter(lines)
    return found.select(F.regexp_extract("file", r"([a-z]+)/[^/]*$", 1).alias("name"), "delimiter").distinct()


@query("src4_ndjson", "SELECT event_id, event_type, value FROM events")
def _(t):
    folder = new_folder(t.spark)
    texts.write_ndjson(t.events.select("event_id", "event_type", "value"), folder)
    v = F.col("v")
    return tables.read_ndjson(t.spark, folder).select(
        jsondoc.get(v, "event_id", as_type="bigint").alias("event_id"),
        jsondoc.get(v, "event_type").alias("event_type"),
        jsondoc.get(v, "value", as_type="double").alias("value"),
    )


@query("src5_lenient_json", "SELECT event_id, user_id AS n, event_type AS kind, CAST(2 AS BIGINT) AS items FROM events")
def _(t):
    messy = F.concat(
        F.lit("{n: "), F.col("user_id").cast("string"), F.lit(", // user\n'kind': '"), F.col("event_type"), F.lit("', 'list': [1, 2,],}")
    )
    read = tables.parse_lenient(messy, "n bigint, kind string, list array<int>")
    return t.events.select("event_id", read.alias("r")).select("event_id", "r.n", "r.kind", F.size("r.list").cast("bigint").alias("items"))


@query("src6_xml_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    folder = new_folder(t.spark)
    texts.write_xml(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), folder, row_tag="order")
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    return tables.read_xml_rows(t.spark, folder, "order", schema).drop("_row")


@query(
    "src7_yaml",
    """SELECT event_id, event_type AS kind, event_id % 2 = 0 AS flag, CAST(user_id AS VARCHAR) AS second FROM events""",
)
def _(t):
    folder = new_folder(t.spark)
    doc = F.concat(
        F.lit("--- # next\nid: "), F.col("event_id").cast("string"), F.lit("\nkind: "), F.col("event_type"),
        F.when(F.col("event_id") % 2 == 0, "\nflag: yes").otherwise("\nflag: off"), F.lit("\nlist:\n  - {a: 1}\n  - "), F.col("user_id").cast("string"),
    )
    texts.write_lines(t.events.select(doc.alias("text")), folder)
    v = F.col("v")
    return documents.read_yaml(t.spark, folder).select(
        jsondoc.get(v, "id", as_type="bigint").alias("event_id"),
        jsondoc.get(v, "kind").alias("kind"),
        jsondoc.get(v, "flag", as_type="boolean").alias("flag"),
        jsondoc.get(v, "list[1]").alias("second"),
    )


@query("src8_geojson", f"SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, lon, lat FROM ({XY})")
def _(t):
    folder = new_folder(t.spark)
    shape = geo.geojson_text(geo.point(F.col("lon"), F.col("lat")))
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"key":'), F.col("s_suppkey").cast("string"),
        F.lit('},"geometry":'), shape, F.lit("}]}"),
    )
    texts.write_lines(sites(t).select(text.alias("text")), folder)
    p = geo.positions(F.col("geometry"))[0]
    return documents.read_geojson(t.spark, folder, lines=True).select(
        F.col("properties")["key"].cast("bigint").alias("s_suppkey"), p[0].alias("lon"), p[1].alias("lat")
    )


@query(
    "src8_geojson_large_files",
    f"""SELECT CAST(row_number() OVER (PARTITION BY s_suppkey % 8 ORDER BY s_suppkey) - 1 AS INTEGER) AS index, CAST(s_suppkey AS BIGINT) AS s_suppkey,
         'a }} ] {{ "' AS note, lon, lat FROM ({XY})""",
)
def _(t):
    """Eight files with an eighth of the features each, in which other members hold objects too."""
    folder = new_folder(t.spark)
    shape = geo.geojson_text(geo.point(F.col("lon"), F.col("lat")))
    nested = '{"type":"GeometryCollection","geometries":['
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"key":'), F.col("s_suppkey").cast("string"), F.lit(',"note":"a } ] { \\""},"geometry":'),
        F.lit(nested + nested), shape, F.lit("]}]}}"),
    )
    own = Window.partitionBy("f")
    listed = sites(t).withColumn("f", F.col("s_suppkey") % 8).withColumns(
        {"n": F.row_number().over(own.orderBy("s_suppkey")), "last": F.count(F.lit(1)).over(own)}
    )
    head = F.when(F.col("n") == 1, '{"type":"FeatureCollection","crs":{"name":"x"},"list":[{"a":1},{}],"features":[').otherwise(",")
    tail = F.when(F.col("n") == F.col("last"), '],"more":[{"type":"Feature"}]}').otherwise("")
    lines = listed.sortWithinPartitions("f", "n").select("f", F.concat(head, feature, tail).alias("text"))
    lines.write.partitionBy("f").text(folder)
    p = geo.positions(F.col("geometry"))[0]
    key, note = F.col("properties")["key"].cast("bigint"), F.col("properties")["note"]
    return documents.read_geojson(t.spark, folder).select(
        "index", key.alias("s_suppkey"), note.alias("note"), p[0].alias("lon"), p[1].alias("lat")
    )


def _write_accounts(lines, folder):
    """Whole accounts per file, about one a file, as a file is sorted by one task."""
    lines.repartitionByRange(40, "account").sortWithinPartitions("account", "part", "_row").select("text").write.text(folder)


FIELDS = "date, amount, payee, memo, check_number"


@query(
    "src9_read_qif",
    f"SELECT {FIELDS}, category, CASE WHEN amount < 0 THEN 'DEBIT' WHEN amount > 0 THEN 'CREDIT' ELSE 'OTHER' END AS type, 'Bank' AS account_type FROM ({TX})",
)
def _(t):
    folder = new_folder(t.spark)
    tx = transactions(t).withColumn("account", F.pmod("account", F.lit(20)).cast("string"))
    _write_accounts(statement_sink.qif_lines(tx), folder)
    return statements.read_qif(t.spark, folder).select(
        "date", "amount", "payee", "memo", "check_number", "category", "type", "account_type"
    )


@query(
    "src10_read_ofx",
    f"SELECT CAST(CAST(account AS BIGINT) % 20 AS VARCHAR) AS account, CAST(id AS VARCHAR) AS id, 'USD' AS currency, 'CHECKING' AS account_type, {FIELDS} FROM ({TX})",
)
def _(t):
    folder = new_folder(t.spark)
    tx = transactions(t).withColumn("account", (F.col("account").cast("bigint") % 20).cast("string"))
    _write_accounts(statement_sink.ofx_lines(tx, now="20240101000000"), folder)
    return statements.read_ofx(t.spark, folder).select(
        "account", "id", "currency", "account_type", "date", "amount", "payee", "memo", "check_number"
    )


@query("src10_mixed_case", ORACLES["src10_read_ofx"])
def _(t):
    """Tags in any spelling, the mark at the end of a transaction included."""
    folder = new_folder(t.spark)
    tx = transactions(t).withColumn("account", (F.col("account").cast("bigint") % 20).cast("string"))
    lines = statement_sink.ofx_lines(tx, now="20240101000000")
    spelt = F.col("text")
    for tag, other in (("STMTTRN", "StmtTrn"), ("TRNAMT", "trnamt"), ("NAME", "Name"), ("FITID", "fitid")):
        for mark in ("<", "</"):
            spelt = F.replace(spelt, F.lit(f"{mark}{tag}>"), F.lit(f"{mark}{other if mark == '<' else other.lower()}>"))
    odd = F.crc32("text") % 3 > 0
    _write_accounts(lines.withColumn("text", F.when(odd, spelt).otherwise(F.col("text"))), folder)
    return statements.read_ofx(t.spark, folder).select(
        "account", "id", "currency", "account_type", "date", "amount", "payee", "memo", "check_number"
    )


@query("src11_detect_format", "SELECT unnest(['csv', 'ofx', 'qbo', 'qif']) AS name, unnest(['UNKNOWN', 'OFX', 'QBO', 'QIF']) AS format")
def _(t):
    base = new_folder(t.spark)
    tx = transactions(t)
    by_account = tx.withColumn("account", (F.col("account").cast("bigint") % 20).cast("string"))
    _write_accounts(statement_sink.qif_lines(by_account), f"{base}/qif")
    for form in ("OFX", "QBO"):
        head, _foot = statement_sink.ofx_frame(form)
        marked = statement_sink.ofx_lines(by_account, form, now="20240101000000").withColumn(
            "text", F.when(F.col("part") == 0, F.concat(F.lit(head + "\n"), "text")).otherwise(F.col("text"))
        )
        _write_accounts(marked, f"{base}/{form.lower()}")
    texts.write_lines(texts.csv_lines(tx.select("id", "amount")), f"{base}/csv")
    found = statements.detect_format(t.spark, f"{base}/*")
    return found.select(F.regexp_extract("file", r"([a-z]+)/[^/]*$", 1).alias("name"), "format").distinct()


@query("src13_read_markdown", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def _(t):
    folder = new_folder(t.spark)
    rows, head = texts.markdown_rows(t.part.select("p_partkey", "p_name", "p_brand"))
    # Every file is a table of its own, so the first row of each gets the head.
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = F.when(leads, F.concat(F.lit(head + "\n"), "text")).otherwise(F.col("text"))
    texts.write_lines(rows.select(text.alias("text")), folder)
    return tables.read_markdown(t.spark, folder).drop("_row")


@query("src16_read_records", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    folder = new_folder(t.spark)
    texts.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), folder)
    return tables.read_records(t.spark, folder).drop("_row")


@query("prf5_file_overview", "SELECT count(*) AS \"rows\", CAST(3 AS INTEGER) AS columns, ';' AS delimiter, 'LF' AS line_terminator, CAST(sum(length(o_orderkey || ';' || o_orderstatus || ';' || o_orderpriority) + 1) AS BIGINT) AS bytes FROM orders")
def _(t):
    folder = new_folder(t.spark)
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    texts.write_lines(texts.csv_lines(df, delimiter=";"), folder)
    files = tables.file_overview(t.spark, folder)
    return files.groupBy("columns", "delimiter", "line_terminator").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query(
    "val1_csv_structure",
    """SELECT 'row has 4 columns, the first has 3' AS message, count(*) AS n FROM orders WHERE o_orderkey % 10 = 3""",
)
def _(t):
    folder = new_folder(t.spark)
    odd = F.col("o_orderkey") % 10 == 3
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"two\nlines, one cell",'), "o_orderstatus", F.when(odd, ",x").otherwise(""))
    rows = t.orders.select(odd.alias("odd"), line.alias("text")).repartition(4).sortWithinPartitions("odd")
    texts.write_lines(rows, folder)
    return tables.csv_errors(t.spark, folder).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ------------------------------------------------------------------


@query(
    "snk1_csv_text",
    f"""SELECT o_orderkey, o_orderkey || ',' || CASE o_orderkey % 3 WHEN 0 THEN 'plain' ELSE '"' || replace({NOTE}, '"', '""') || '"' END || ',' || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'NA' END AS text,
         o_orderkey || ',"' || replace({NOTE}, '"', '""') || '",' || CASE WHEN o_orderkey % 5 <> 0 THEN '"' || lower(o_orderpriority) || '"' ELSE '' END AS quoted FROM orders""",
)
def _(t):
    df = noted_orders(t)
    out = texts.csv_lines(df, null_value="NA").withColumnRenamed("text", "_a")
    lower = {"o_orderpriority": F.lower("o_orderpriority")}
    out = texts.csv_lines(out, ["o_orderkey", "note", "o_orderpriority"], policy="nonnumeric", formatters=lower)
    return out.select("o_orderkey", F.col("_a").alias("text"), F.col("text").alias("quoted"))


@query(
    "snk2_json_text",
    """SELECT '{"n_nationkey":' || n_nationkey || ',"name":' || CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '"' || n_name || '"' END || '}' AS text FROM nation""",
)
def _(t):
    df = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"))
    return texts.json_lines(df).select("text")


@query(
    "snk3_json_to_csv",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN '{"k":' || json_extract_string(props, '$.k') || '}' END AS props FROM events""",
)
def _(t):
    i = F.col("event_id")
    doc = F.concat(
        F.lit('{"id":'), i.cast("string"), F.when(i % 2 == 0, F.concat(F.lit(',"kind":"'), "event_type", F.lit('"'))).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit(',"props":'), "props")).otherwise(""), F.lit("}"),
    )
    folder = new_folder(t.spark)
    texts.json_to_csv(t.events.select(doc.alias("doc")), folder, "doc")
    return tables.read_csv(t.spark, folder).select("id", "kind", "props")


def _xml(expr):
    return f"replace(replace({expr}, '&', '&amp;'), '<', '&lt;')"


@query(
    "snk4_xml_rows",
    f"""SELECT '  <row>' || chr(10) || '    <n_nationkey>' || n_nationkey || '</n_nationkey>' || chr(10) || '    <the_name>' || {_xml("n_name || '<&'")} || '</the_name>' || chr(10) || '  </row>' AS text FROM nation""",
)
def _(t):
    df = t.nation.select("n_nationkey", F.concat("n_name", F.lit("<&")).alias("the name"))
    return texts.xml_rows(df).select("text")


@query(
    "snk5_xml_attributes",
    """SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS id, n_name AS body, CAST(2 AS INTEGER) AS tags, 'b' AS second FROM nation""",
)
def _(t):
    s = F.struct(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("tag"))
    df = t.nation.select("n_nationkey", s.alias("s")).select("n_nationkey", texts.xml_of(F.col("s"), "nation").alias("xml"))
    return df.select(
        "n_nationkey",
        xmldoc.xpath_first(F.col("xml"), "/nation/@id").alias("id"),
        xmldoc.xpath_first(F.col("xml"), "/nation/name").alias("body"),
        xmldoc.xpath_count(F.col("xml"), "/nation/tag").alias("tags"),
        F.trim(xmldoc.xpath_first(F.col("xml"), "/nation/tag[last()]")).alias("second"),
    )


@query(
    "snk6_yaml_items",
    """SELECT '- n_nationkey: ' || n_nationkey || chr(10) || '  n_name: ' || CASE WHEN n_nationkey % 2 = 0 THEN '"x: ' || n_name || '"' ELSE n_name END || chr(10) || '  none: null' AS text FROM nation""",
)
def _(t):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("x: "), "n_name")).otherwise(F.col("n_name"))
    df = t.nation.select("n_nationkey", name.alias("n_name"), F.lit(None).cast("string").alias("none"))
    return texts.yaml_items(df).select("text")


@query(
    "snk7_markdown",
    """WITH w AS (SELECT greatest(max(length(n_name)), 6) AS w FROM nation)
       SELECT '| ' || lpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || ' | ' || rpad(n_name, CAST(w AS INTEGER), ' ') || ' |' AS text FROM nation, w""",
)
def _(t):
    rows, _head = texts.markdown_rows(t.nation, ["n_nationkey", "n_name"], {"n_nationkey": "right"})
    return rows.select("text")


@query("snk8_html", f"""SELECT '<tr><td>' || n_nationkey || '</td><td>' || {_xml("n_name || '&'")} || '</td></tr>' AS text FROM nation""")
def _(t):
    return texts.html_rows(t.nation.select("n_nationkey", F.concat("n_name", F.lit("&")).alias("name"))).select("text")


@query(
    "snk9_qif",
    f"""SELECT id AS _row, 'D' || strftime(date, '%m/%d/%Y') || chr(10) || 'T' || amount || chr(10) || CASE WHEN check_number <> '' THEN 'N' || check_number || chr(10) ELSE '' END
         || 'P' || payee || chr(10) || CASE WHEN memo <> '' THEN 'M' || memo || chr(10) ELSE '' END || CASE WHEN category <> '' THEN 'L' || category || chr(10) ELSE '' END || '^' AS text FROM ({TX})
       UNION ALL SELECT NULL, '!Type:Bank' FROM (SELECT DISTINCT account FROM ({TX}))""",
)
def _(t):
    return statement_sink.qif_lines(transactions(t)).select("_row", "text")


@query("fin2_statement_text", f"SELECT part, count(*) AS n FROM (SELECT account, unnest([0, 2]) AS part FROM (SELECT DISTINCT account FROM ({TX})) UNION ALL SELECT account, 1 FROM ({TX})) GROUP BY part")
def _(t):
    lines = statement_sink.ofx_lines(transactions(t), "QBO", now="20240101000000")
    return lines.filter("text is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk10_ofx",
    f"""WITH t AS ({TX}) SELECT account, 1 AS part, id AS _row, regexp_replace('          <STMTTRN>' || chr(10) || '            <TRNTYPE>' || CASE WHEN amount < 0 THEN 'DEBIT' ELSE 'CREDIT' END || '</TRNTYPE>' || chr(10)
         || '            <DTPOSTED>' || strftime(date, '%Y%m%d') || '</DTPOSTED>' || chr(10) || '            <TRNAMT>' || amount || '</TRNAMT>' || chr(10) || '            <FITID>' || id || '</FITID>' || chr(10)
         || CASE WHEN check_number <> '' THEN '            <CHECKNUM>' || check_number || '</CHECKNUM>' || chr(10) ELSE '' END || '            <NAME>' || payee || '</NAME>' || chr(10)
         || CASE WHEN memo <> '' THEN '            <MEMO>' || memo || '</MEMO>' || chr(10) ELSE '' END || '          </STMTTRN>', '~', '') AS text FROM t
       UNION ALL SELECT account, 0, NULL, array_to_string(['    <STMTTRNRS>', '      <TRNUID>1</TRNUID>', '      <STATUS><CODE>0</CODE><SEVERITY>INFO</SEVERITY></STATUS>',
         '      <STMTRS>', '        <CURDEF>USD</CURDEF>', '        <BANKACCTFROM>', '          <ACCTID>' || account || '</ACCTID>', '          <ACCTTYPE>CHECKING</ACCTTYPE>',
         '        </BANKACCTFROM>', '        <BANKTRANLIST>', '          <DTSTART>' || strftime(arg_min(date, id), '%Y%m%d') || '</DTSTART>',
         '          <DTEND>' || strftime(arg_max(date, id), '%Y%m%d') || '</DTEND>'], chr(10)) FROM t GROUP BY account
       UNION ALL SELECT account, 2, NULL, array_to_string(['        </BANKTRANLIST>', '        <LEDGERBAL>', '          <BALAMT>0.00</BALAMT>',
         '          <DTASOF>20240101000000</DTASOF>', '        </LEDGERBAL>', '      </STMTRS>', '    </STMTTRNRS>'], chr(10)) FROM t GROUP BY account""",
)
def _(t):
    return statement_sink.ofx_lines(transactions(t), now="20240101000000").select("account", "part", "_row", "text")


@query("snk11_feature_table", f"SELECT lat AS latitude, lon AS longitude, 'Point' AS geometry_type, s_name AS name FROM ({XY})")
def _(t):
    df = sites(t).select(geo.point(F.col("lon"), F.col("lat")).alias("geometry"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"))
    return texts.feature_rows(df, ["name"])


def _n(x):
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


@query(
    "snk12_kml",
    f"""SELECT '<Placemark><name>' || s_name || '</name><Point><coordinates>' || {_n('lon')} || ',' || {_n('lat')} || '</coordinates></Point></Placemark>' AS text FROM ({XY})""",
)
def _(t):
    df = sites(t).select(geo.point(F.col("lon"), F.col("lat")).alias("geometry"), F.create_map(F.lit("title"), F.col("s_name")).alias("properties"))
    return texts.kml_placemarks(df).select("text")


@query("snk13_sheet_json", """SELECT '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}' AS value FROM nation""")
def _(t):
    folder = new_folder(t.spark)
    texts.write_sheets(sheet_of(t), folder, "json")
    return t.spark.read.text(folder).select("value")


@query(
    "snk13_sheet_csv",
    "SELECT 0 AS part, 'n_nationkey,n_name,n_regionkey' AS value UNION ALL SELECT 1, n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation",
)
def _(t):
    folder = new_folder(t.spark)
    texts.write_sheets(sheet_of(t), folder, "csv")
    return t.spark.read.text(folder).select("part", "value")


@query(
    "snk13_sheet_xml",
    """SELECT '<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></row>' AS value FROM nation""",
)
def _(t):
    folder = new_folder(t.spark)
    texts.write_sheets(sheet_of(t), folder, "xml")
    return t.spark.read.text(folder).select("value")


@query(
    "snk14_sql_inserts",
    """SELECT 'INSERT INTO "nation" ("n_nationkey", "name") VALUES (' || n_nationkey || ', ' || CASE WHEN n_nationkey % 4 = 0 THEN 'NULL' ELSE '''' || n_name || '''''s''' END || ');' AS text FROM nation""",
)
def _(t):
    name = F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit("'s")))
    return texts.sql_inserts(t.nation.select("n_nationkey", name.alias("name")), "nation").select("text")


@query(
    "snk15_plain_text",
    """WITH w AS (SELECT greatest(max(length(n_name)), 6) AS w FROM nation)
       SELECT lpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || '  ' || rpad(n_name, CAST(w AS INTEGER), ' ') AS text FROM nation, w""",
)
def _(t):
    rows, _head = texts.plain_rows(t.nation, ["n_nationkey", "n_name"])
    return rows.select("text")


@query("snk16_compact_xml", "SELECT o_orderkey, '<order id=\"' || o_orderkey || '\"><status>' || o_orderstatus || '</status><note/></order>' AS xml FROM orders")
def _(t):
    return order_xml(t).select("o_orderkey", xmldoc.minify(F.col("small")).alias("xml"))


# --- XML --------------------------------------------------------------------


def order_xml(t):
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    small = F.concat(
        F.lit("<order id=\""), k, F.lit("\">\n  <!-- note -->\n  <status>"), s, F.lit("</status>\n  <note></note>\n</order>\n")
    )
    big = F.concat(
        F.lit('<order id="'), k, F.lit('" class="big '), F.lower(s), F.lit('"><item n="1">A</item><item n="2">'), F.col("o_orderpriority"),
        F.lit("</item><sum>"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</sum><note/><!-- c --><raw><![CDATA[<x>]]></raw></order>"),
    )
    return spread(t.orders).select("o_orderkey", "o_orderstatus", "o_orderpriority", small.alias("small"), big.alias("xml"))


@query(
    "xml1_xpath",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS second, 'A|' || o_orderpriority AS items, CAST(2 AS INTEGER) AS n, o_orderpriority AS by_attribute FROM orders",
)
def _(t):
    x = F.col("xml")
    return order_xml(t).select(
        "o_orderkey",
        xmldoc.xpath_first(x, "/order/@id").alias("id"),
        xmldoc.xpath_first(x, "/order/item[last()]").alias("second"),
        F.array_join(xmldoc.xpath_all(x, "//item"), "|").alias("items"),
        xmldoc.xpath_count(x, "//item[@n]").alias("n"),
        xmldoc.xpath_first(x, '//item[@n="2"]').alias("by_attribute"),
    )


@query(
    "xml2_css",
    "SELECT o_orderkey, 'A|' || o_orderpriority AS items, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE '' END AS in_class, 'A' AS by_id, o_orderpriority AS ends FROM orders",
)
def _(t):
    x = F.col("xml")
    css = lambda s: F.array_join(xmldoc.css_all(x, s), "|")
    return order_xml(t).select(
        "o_orderkey",
        css("order > item").alias("items"),
        css("order.f item[n='1']").alias("in_class"),
        css("order item[n^=1], sum > x").alias("by_id"),
        css("item[n$='2']").alias("ends"),
    )


@query(
    "xml3_to_json",
    """SELECT o_orderkey, '{"order":{"@id":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":""}}' AS json FROM orders""",
)
def _(t):
    return order_xml(t).select("o_orderkey", xmldoc.to_json(F.col("small")).alias("json"))


@query(
    "xml4_from_json",
    """SELECT o_orderkey, '<order id="' || o_orderkey || '"><status>' || o_orderstatus || '</status><tag>a</tag><tag>b</tag></order>' AS xml FROM orders""",
)
def _(t):
    doc = F.concat(
        F.lit('{"order":{"@id":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('","tag":["a","b"]}}')
    )
    return t.orders.select("o_orderkey", xmldoc.from_json(doc).alias("xml"))


@query(
    "xml5_edit",
    """SELECT o_orderkey, '<order id="' || o_orderkey || '" seen="yes"><state>new</state><more>1</more></order>' AS xml FROM orders""",
)
def _(t):
    edits = [
        ("text", "status", "new"), ("rename", "status", "state"), ("remove", "note"), ("set", ".", "seen", "yes"),
        ("append", ".", "<more>1</more>"),
    ]
    trimmed = xmldoc.clean(F.col("small"))
    return order_xml(t).select("o_orderkey", xmldoc.edit(trimmed, edits).alias("xml"))


@query(
    "xml6_schema_rows",
    """SELECT unnest(['order/o_orderkey', 'order/o_orderstatus', 'order/o_totalprice', 'order/tag']) AS path, unnest(['long', 'string', 'double', 'string']) AS type, unnest([false, false, false, true]) AS repeated""",
)
def _(t):
    folder = new_folder(t.spark)
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.array(F.lit("a"), F.lit("b")).alias("tag"))
    texts.write_xml(df, folder, row_tag="order")
    return xmldoc.schema_rows(t.spark, folder, "order")


@query(
    "prf10_xml_profile",
    """SELECT o_orderkey, CAST(6 AS BIGINT) AS elements, CAST(3 AS BIGINT) AS texts, CAST(1 AS BIGINT) AS comments, CAST(1 AS BIGINT) AS cdata, CAST(3 AS INTEGER) AS max_depth, CAST(5 AS BIGINT) AS tags, CAST(1 AS INTEGER) AS empty_elements FROM orders""",
)
def _(t):
    return xmldoc.profile(order_xml(t), "o_orderkey").select(
        "o_orderkey", "elements", "texts", "comments", "cdata", "max_depth", "tags", "empty_elements"
    )


@query(
    "prf10_tag_frequencies",
    """SELECT unnest(['tag', 'tag', 'tag', 'tag', 'tag', 'attribute', 'attribute', 'attribute']) AS kind, unnest(['order', 'item', 'sum', 'note', 'raw', 'id', 'class', 'n']) AS name,
         unnest([n, n * 2, n, n, n, n, n, n * 2]) AS count FROM (SELECT count(*) AS n FROM orders)""",
)
def _(t):
    return xmldoc.tag_frequencies(order_xml(t), "o_orderkey")


@query(
    "cln11_xml_clean",
    """SELECT o_orderkey, '<order id="' || o_orderkey || '"><status>' || o_orderstatus || '</status></order>' AS xml FROM orders""",
)
def _(t):
    return order_xml(t).select("o_orderkey", xmldoc.clean(F.col("small"), empty=True).alias("xml"))


@query(
    "dif6_xml_diff",
    """SELECT o_orderkey, '/order/@id' AS path, 'ATTR_CHANGED' AS type, CAST(o_orderkey AS VARCHAR) AS old, '0' AS "new" FROM orders WHERE o_orderkey % 4 = 1
       UNION ALL SELECT o_orderkey, '/order/item[1]', 'TEXT_CHANGED', 'A', 'B' FROM orders WHERE o_orderkey % 4 = 2
       UNION ALL SELECT o_orderkey, '/order/extra[6]', 'ELEMENT_ADDED', NULL, 'extra' FROM orders WHERE o_orderkey % 4 = 3""",
)
def _(t):
    a = order_xml(t)
    k, x = F.col("o_orderkey"), F.col("xml")
    b = a.withColumn(
        "xml",
        F.when(k % 4 == 1, F.regexp_replace(x, 'id="[0-9]+"', 'id="0"'))
        .when(k % 4 == 2, F.replace(x, F.lit(">A<"), F.lit(">B<")))
        .when(k % 4 == 3, F.replace(x, F.lit("</order>"), F.lit("<extra/></order>")))
        .otherwise(x),
    )
    return xmldoc.xml_diff(a, b, "o_orderkey").filter("old is null or new is null or old <> new")


@query(
    "val15_xml_faults",
    """SELECT o_orderkey, CAST(1 AS INTEGER) AS line FROM orders WHERE o_orderkey % 4 IN (1, 2) UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 4 = 3""",
)
def _(t):
    k = F.col("o_orderkey")
    xml = (
        F.when(k % 4 == 0, F.col("xml")).when(k % 4 == 1, "<a><b></a>").when(k % 4 == 2, '<a x="1" x="2"/>').otherwise("<a/>\n<b/>")
    )
    out = order_xml(t).select("o_orderkey", xmldoc.faults(xml).alias("f")).filter("f is not null")
    return out.select("o_orderkey", "f.line")


# --- YAML -------------------------------------------------------------------


def event_yaml(t):
    text = F.concat(
        F.lit("# head\nid: "), F.col("event_id").cast("string"), F.lit("\nkind: "), F.col("event_type"), F.lit(" # tail\nuser:\n  n: "),
        F.col("user_id").cast("string"), F.lit("\n  none: null\nlist: [a, b]"),
    )
    return spread(t.events).select("event_id", "event_type", "user_id", text.alias("yaml"))


@query(
    "cln12_yaml_comments",
    """SELECT event_id, 'id: ' || event_id || chr(10) || 'kind: ' || event_type || chr(10) || 'user:' || chr(10) || '  n: ' || user_id || chr(10) || '  none: null' || chr(10) || 'list: [a, b]' AS yaml FROM events""",
)
def _(t):
    return event_yaml(t).select("event_id", yamldoc.strip_comments(F.col("yaml")).alias("yaml"))


@query(
    "cln13_yaml_clean",
    """SELECT event_id, 'id: ' || event_id || chr(10) || 'kind: ' || event_type || chr(10) || 'user:' || chr(10) || '  n: ' || user_id || chr(10) || 'list:' || chr(10) || '- a' || chr(10) || '- b' AS yaml FROM events""",
)
def _(t):
    return event_yaml(t).select("event_id", yamldoc.clean(F.col("yaml")).alias("yaml"))


@query(
    "yml1_edit",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS n, 'x' AS after, false AS has_list FROM events""",
)
def _(t):
    y = F.col("yaml")
    changed = yamldoc.remove(yamldoc.set_value(y, "user.extra", "x"), "list")
    df = event_yaml(t).select("event_id", yamldoc.get(y, "user.n").alias("n"), yamldoc.to_json(changed).alias("j"))
    v = F.try_parse_json("j")
    return df.select("event_id", "n", jsondoc.get(v, "user.extra").alias("after"), jsondoc.has(v, "list").alias("has_list"))


@query(
    "yml2_convert",
    """SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","user":{"n":' || user_id || ',"none":null},"list":["a","b"]}' AS json,
         '<root><id>' || event_id || '</id><kind>' || event_type || '</kind><user><n>' || user_id || '</n><none></none></user><list>a</list><list>b</list></root>' AS xml FROM events""",
)
def _(t):
    y = F.col("yaml")
    return event_yaml(t).select("event_id", yamldoc.to_json(y).alias("json"), yamldoc.to_xml(y).alias("xml"))


@query("dif7_yaml_diff", "SELECT event_id, '$.list[1]' AS path, 'modified' AS status FROM events WHERE event_id % 3 = 0")
def _(t):
    a = event_yaml(t)
    b = a.withColumn("yaml", F.when(F.col("event_id") % 3 == 0, F.replace("yaml", F.lit("[a, b]"), F.lit("[a, c]"))).otherwise(F.col("yaml")))
    return yamldoc.diff(a, b, ["event_id"]).select("event_id", "path", "status")


@query("prf11_yaml_profile", "SELECT event_id, CAST(9 AS BIGINT) AS nodes, CAST(2 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS nulls FROM events")
def _(t):
    return yamldoc.profile(event_yaml(t), ["event_id"]).select("event_id", "nodes", "objects", "nulls")


@query("snk16_flow_yaml", """SELECT event_id, '{id: ' || event_id || ', kind: ' || event_type || ', user: {n: ' || user_id || ', none: null}, list: [a, b]}' AS yaml FROM events""")
def _(t):
    return event_yaml(t).select("event_id", yamldoc.minify(F.col("yaml")).alias("yaml"))


@query(
    "fin1_flatten",
    f"""SELECT account, 'Bank' AS account_type, 'USD' AS currency, id, amount FROM ({TX}) UNION ALL SELECT account, 'Bank', 'USD', -id, -amount FROM ({TX})""",
)
def _(t):
    from tablekit.operators import ledger

    # One statement per order, with a transaction and its reversal.
    pair = F.array(
        F.struct("id", "amount"), F.struct((-F.col("id")).alias("id"), (-F.col("amount")).cast("decimal(18,2)").alias("amount"))
    )
    accounts = transactions(t).select(
        col("account").alias("account_id"), F.lit("").alias("name"), F.lit(None).cast("string").alias("type"),
        F.lit("").alias("currency"), pair.alias("transactions"),
    )
    return ledger.flatten_statement(accounts)


@query("dif4_schema_diff", """SELECT unnest(['added', 'removed', 'removed', 'common', 'common']) AS status, unnest(['note', 'o_totalprice', 'o_orderdate', 'o_orderkey', 'o_custkey']) AS "column" """)
def _(t):
    from tablekit.operators import diff

    a = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    b = t.orders.select("o_custkey", "o_orderkey", F.lit("").alias("note"))
    return diff.schema_diff(a, b).select("status", "column")


