"""Files with the awkward parts of each format."""

import datetime
import json
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from tablekit.operators import grid
from tablekit.sources import documents, statements, tables
from tablekit.sources.lines import pieces


def put(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv_quirks(spark, tmp_path):
    path = put(
        tmp_path / "a.csv",
        '﻿id,name,,name\n# note\n1,"a, ""b""",x,y\n\n2,"two\nlines"\n3,p,q,r,too many\n',
    )
    rows = tables.read_csv(spark, path).drop("_row").collect()
    assert [list(r) for r in rows] == [
        ["1", 'a, "b"', "x", "y"],
        ["2", "two\nlines", None, None],
        ["3", "p", "q", "r"],
    ]
    assert tables.read_csv(spark, path).columns == ["id", "name", "column", "name_2", "_row"]
    upper = tables.read_csv(spark, path, transform_header=str.upper)
    assert upper.columns[0] == "ID"


def test_typing(spark):
    df = tables.from_rows(spark, ["a", "b", "c"], [["1", "TRUE", "x"], ["NULL", "false", "1"], ["", "true", None]])
    out = tables.typed_columns(df)
    assert dict(out.dtypes)["a"] == "bigint" and dict(out.dtypes)["b"] == "boolean" and dict(out.dtypes)["c"] == "string"
    assert [r.a for r in out.orderBy("_row").collect()] == [1, None, None]


def test_records_from_mappings(spark):
    df = tables.from_records(spark, [{"a": 1}, {"b": True, "a": None}])
    assert [tuple(r) for r in df.drop("_row").collect()] == [("1", None), (None, "True")]


def test_delimiters(spark, tmp_path):
    put(tmp_path / "comma.csv", "a,b;x\n1,2\n")
    put(tmp_path / "semi.csv", 'a;b;c\n"1,1,1";2;3\n')
    put(tmp_path / "tab.csv", "# x,y,z\na\tb\n1\t2\n")
    put(tmp_path / "none.csv", "abc\n")
    found = tables.detect_delimiter(pieces(spark, str(tmp_path))).collect()
    assert {r.file.rsplit("/", 1)[1]: r.delimiter for r in found} == {
        "comma.csv": ",", "semi.csv": ";", "tab.csv": "\t", "none.csv": ",",
    }


def test_csv_errors(spark, tmp_path):
    put(tmp_path / "open.csv", 'a,b\n1,2\n3,"never closed\n4,5\n')
    put(tmp_path / "odd.csv", 'a,b\n1,"x\ny, z"\n1,2,3\n7\n')
    put(tmp_path / "fine.csv", 'a,b\n1,"q ""q"" , q"\n')
    put(tmp_path / "blank.csv", "\n  \n")
    found = {}
    for r in tables.csv_errors(spark, str(tmp_path)).orderBy("file", "line").collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.col, r.message))
    assert found["odd.csv"] == [(4, None, "row has 3 columns, the first has 2"), (5, None, "row has 1 columns, the first has 2")]
    assert found["open.csv"] == [(3, 3, "quoted field is never closed")]
    assert found["blank.csv"] == [(1, 1, "file is empty")]
    assert "fine.csv" not in found


def test_overview(spark, tmp_path):
    path = put(tmp_path / "a.csv", "a;b\r\n1;2\r\n")
    r = tables.file_overview(spark, path).first()
    assert (r.rows, r.columns, r.delimiter, r.line_terminator, r.bytes, r.gzip_bytes) == (2, 2, ";", "CRLF", 10, 4)


def test_markdown(spark, tmp_path):
    path = put(tmp_path / "a.md", "text\n| a | b |\n|---|:-:|\n| 1 | x y |\n")
    assert [tuple(r) for r in tables.read_markdown(spark, path).drop("_row").collect()] == [("1", "x y")]


QIF = """!Type:Bank\r
D01/16'24\r
T-1,234.56\r
N101\r
PShop\r
MNote\r
LFood\r
SFood\r
$-1,000.00\r
Epart\r
SHome\r
$-234.56\r
^\r
D1/2/2023\r
T10\r
CX\r
^\r
!Type:CCard\r
D12.31.75\r
U5.5\r
^\r
"""


def test_qif(spark, tmp_path):
    path = put(tmp_path / "a.qif", QIF)
    rows = statements.read_qif(spark, path).orderBy("_row").collect()
    assert [(r.account, r.account_type, r.id, r.type) for r in rows] == [
        ("Default", "Bank", "qif-1", "DEBIT"), ("Default", "Bank", "qif-2", "CREDIT"), ("Account-2", "CCard", "qif-1", "CREDIT"),
    ]
    assert [r.date for r in rows] == [datetime.date(2024, 1, 16), datetime.date(2023, 1, 2), datetime.date(1975, 12, 31)]
    assert rows[0].amount == Decimal("-1234.56") and rows[1].cleared == "X"
    assert [tuple(s) for s in rows[0].splits] == [("Food", Decimal("-1000.00"), "part"), ("Home", Decimal("-234.56"), "")]


OFX = """OFXHEADER:100
<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><CURDEF>EUR<BANKACCTFROM><BANKID>9<ACCTID>77</BANKACCTFROM><BANKTRANLIST>
<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240105120000<TRNAMT>-5.25<FITID>f1<NAME>Shop</STMTTRN>
<STMTTRN><DTPOSTED>20240106<TRNAMT>7</TRNAMT><REFNUM>r2</STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>100.5<DTASOF>20240131</LEDGERBAL></STMTRS>
<CCSTMTRS><CCACCTFROM><ACCTID>cc</CCACCTFROM><STMTTRN><DTPOSTED>20240201<TRNAMT>1.00</STMTTRN></CCSTMTRS></OFX>
"""


def test_ofx(spark, tmp_path):
    path = put(tmp_path / "a.ofx", OFX)
    rows = statements.read_ofx(spark, path).orderBy("_row").collect()
    assert [(r.account, r.account_type, r.currency, r.id, r.type) for r in rows] == [
        ("77", "CHECKING", "EUR", "f1", "DEBIT"), ("77", "CHECKING", "EUR", "fit-2", "OTHER"), ("cc", "CREDITCARD", "USD", "fit-1", "OTHER"),
    ]
    assert [r.memo for r in rows] == ["", "r2", ""]
    assert (rows[0].balance, rows[0].balance_date) == (Decimal("100.50"), datetime.date(2024, 1, 31))
    assert rows[2].balance == 0
    assert statements.detect_format(spark, path).first().format == "OFX"


def test_yaml(spark, tmp_path):
    path = put(
        tmp_path / "a.yml",
        "# c\na: &x {n: 0x1F, t: yes}\nb: *x\nd: 2024-01-02\ni: .inf\ns: |\n  one\n  two\n---\n- off\n- 1.5\n",
    )
    got = [r.json for r in documents.read_yaml(spark, path).orderBy("_seq").collect()]
    assert got == [
        '{"a":{"n":31,"t":true},"b":{"n":31,"t":true},"d":"2024-01-02","i":null,"s":"one\\ntwo\\n"}', "[false,1.5]",
    ]


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><r><t>ab</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
            '<row r="2"><c r="A2"><v>3</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c></row>'
            '<row r="3"><c r="A3"><f>SUM(A2)</f><v>3</v></c><c r="B3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
        )
    cells = documents.read_xlsx(spark, str(path)).cache()
    got = {(r.row, r.col): (r.value, r.vtype, r.formula) for r in cells.collect()}
    assert got[2, 2] == ("2024-01-01 12:00:00", "date", None)
    assert got[2, 3] == ("true", "boolean", None) and got[3, 1] == ("3", "number", "SUM(A2)")
    assert got[3, 2] == ("#N/A", "error", None)
    recs = {r.row: r.record for r in grid.records(cells).collect()}
    assert recs[2] == {"id": "3", "abc": "2024-01-01 12:00:00", "col_3": "true"}


def test_geojson_of_every_type(spark):
    from tablekit.operators import geo

    shapes = [
        '{"type":"Point","coordinates":[1,2,3]}',
        '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}',
        '{"type":"LineString","coordinates":[[1,2],[3.5,4]]}',
        '{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6],[7,8]]]}',
        '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]]]]}',
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[1,2],[3,4]]}]}',
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string")
    g = geo.from_geojson(F.try_parse_json("s"))
    rows = df.select("i", "s", geo.geojson_text(g).alias("t"), geo.wkt(g).alias("w"), F.size(geo.errors(F.try_parse_json("s"))).alias("e")).orderBy("i").collect()
    assert [r.t for r in rows] == shapes
    assert rows[0].w == "POINT (1 2 3)" and rows[1].w == "MULTIPOINT ((1 2), (3 4))"
    assert rows[6].w == "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))"
    assert [r.e for r in rows] == [0] * 7
    nested = '{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]},{"type":"Point","coordinates":[3,4]}]}'
    both = spark.createDataFrame([(nested,)], "s string").select(geo.positions(geo.from_geojson(F.try_parse_json("s"))).alias("p")).first().p
    assert sorted(map(tuple, both)) == [(1.0, 2.0), (3.0, 4.0)]


def test_large_geojson_is_split(spark, tmp_path):
    """One file in many tasks: braces and quotes in strings, other members with objects, every kind of root."""
    from tablekit.sources import documents

    features = []
    for i in range(300):
        name = ["a } ] , { b", 'say \\"{\\" "', "back\\\\slash\\\\", "features\":[", "é{}"][i % 5]
        shape = {"type": "Polygon", "coordinates": [[[0, 0], [i, 0], [1, 1], [0, 0]]]} if i % 2 else {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [i, 1]}]}
        features.append({"type": "Feature", "properties": {"n": i, "name": name, "deep": {"x": [{"y": 1}, {}]}}, "geometry": shape})
    collection = {"type": "FeatureCollection", "crs": {"p": {"q": [1]}}, "list": [{"a": 1}, {"b": 2}], "features": features, "more": [{"type": "Feature"}, {"features": [{}]}], "last": {}}
    (tmp_path / "a.json").write_text(json.dumps(collection, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\ufeff" + json.dumps({"features": features[:3], "type": "FeatureCollection"}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps(features[4]))
    (tmp_path / "d.json").write_text(json.dumps({"type": "Point", "coordinates": [5, 6]}))
    (tmp_path / "e.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = documents.read_geojson(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted([(i, i, f["properties"]["name"]) for i, f in enumerate(features)] + [(i, i, f["properties"]["name"]) for i, f in enumerate(features[:3])] + [(0, 4, features[4]["properties"]["name"])])
    assert sorted((r["index"], int(r.properties["n"]), r.properties["name"]) for r in got if r.properties) == want
    assert [r.geometry.type for r in got if not r.properties] == ["Point"]
    assert all(r.geometry.type == ("Polygon" if int(r.properties["n"]) % 2 else "GeometryCollection") for r in got if r.properties)


def test_geo_faults(spark):
    from tablekit.operators import geo

    bad = {
        '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}': ["$.coordinates[0]"],
        '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}': ["$.coordinates[0]"],
        '{"type":"Point","coordinates":[200,-95]}': ["$.coordinates[0]", "$.coordinates[1]"],
        '{"type":"Feature","geometry":null,"properties":[1]}': ["$.properties"],
        '{"kind":"Point"}': ["$"],
        '{"type":"LineString"}': ["$.coordinates"],
        '{"type":"FeatureCollection"}': ["$.features"],
        '{"type":"FeatureCollection","bbox":[1],"features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[0,91]}},{"type":"Thing"},7]}': [
            "$.bbox", "$.features[0].geometry.coordinates[1]", "$.features[1].type", "$.features[2]",
        ],
        '{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[181,0]}]},{"type":"GeometryCollection"}]},{}]}': [
            "$.geometries[0].geometries[0].geometries[0].coordinates[0]", "$.geometries[0].geometries[1].geometries", "$.geometries[1]",
        ],
    }
    df = spark.createDataFrame([(s,) for s in bad], "s string")
    rows = df.select("s", F.transform(geo.errors(F.try_parse_json("s")), lambda e: e["path"]).alias("p")).collect()
    assert {r.s: sorted(r.p) for r in rows} == bad
