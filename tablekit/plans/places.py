"""Queries over geographic features, page text and missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import geo, impute, pagetext
from tablekit.plans.registry import query

XY = "SELECT s_suppkey, CAST(s_suppkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey * 17 % 180 - 90 AS DOUBLE) AS lat, s_name FROM supplier"


def sites(t):
    k = F.col("s_suppkey")
    return t.supplier.select(
        "s_suppkey", (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 17 % 180 - 90).cast("double").alias("lat"), "s_name"
    )


def shapes(t):
    """A point, a line and a polygon around every supplier."""
    x, y = F.col("lon"), F.col("lat")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    ring = F.array(p(0, 0), p(0, 1), p(1, 1), p(1, 0), p(0, 0))
    df = sites(t)
    return (
        df.select("s_suppkey", geo.point(x, y).alias("geometry"))
        .unionByName(df.select("s_suppkey", geo.line(F.array(p(0, 0), p(0.5, 0.25))).alias("geometry")))
        .unionByName(df.select("s_suppkey", geo.polygon(F.array(ring)).alias("geometry")))
    )


@query(
    "src14_point_features",
    f"""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, lon, lat, s_name FROM ({XY}) WHERE s_suppkey % 10 <> 0""",
)
def _(t):
    df = sites(t).withColumn("lat", F.when(F.col("s_suppkey") % 10 == 0, "none").otherwise(F.col("lat").cast("string")))
    pts = geo.point_features(df)
    pos = geo.positions(F.col("geometry"))[0]
    return pts.select(
        F.col("properties")["s_suppkey"].cast("bigint").alias("s_suppkey"), pos[0].alias("lon"), pos[1].alias("lat"),
        F.col("properties")["s_name"].alias("s_name"),
    )


@query("geo1_bbox", f"SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) + 1 AS max_lon, max(lat) + 1 AS max_lat FROM ({XY})")
def _(t):
    return geo.bbox(shapes(t))


def _n(x):
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


@query(
    "geo2_wkt",
    f"""SELECT s_suppkey, 'POINT (' || {_n('lon')} || ' ' || {_n('lat')} || ')' AS wkt FROM ({XY})
       UNION ALL SELECT s_suppkey, 'LINESTRING (' || {_n('lon')} || ' ' || {_n('lat')} || ', ' || {_n('lon + 0.5')} || ' ' || {_n('lat + 0.25')} || ')' FROM ({XY})
       UNION ALL SELECT s_suppkey, 'POLYGON ((' || {_n('lon')} || ' ' || {_n('lat')} || ', ' || {_n('lon')} || ' ' || {_n('lat + 1')} || ', ' || {_n('lon + 1')} || ' ' || {_n('lat + 1')}
         || ', ' || {_n('lon + 1')} || ' ' || {_n('lat')} || ', ' || {_n('lon')} || ' ' || {_n('lat')} || '))' FROM ({XY})""",
)
def _(t):
    return shapes(t).select("s_suppkey", geo.wkt(F.col("geometry")).alias("wkt"))


def _each_shape(point: str, line: str, polygon: str) -> str:
    """SQL of one row per shape and supplier."""
    return " UNION ALL ".join(
        f"SELECT s_suppkey, '{kind}' AS kind, {columns} FROM ({XY})"
        for kind, columns in (("Point", point), ("LineString", line), ("Polygon", polygon))
    )


def _kind():
    return F.col("geometry.type").alias("kind")


def _ends(g):
    """First and last position of a geometry, and how many there are."""
    p = geo.positions(g)
    last = F.element_at(p, -1)
    return p[0][0].alias("lon"), p[0][1].alias("lat"), last[0].alias("last_lon"), last[1].alias("last_lat"), F.size(p).alias("n")


def _ends_sql(x: str, y: str) -> str:
    """The same in SQL, for shapes whose places went through ``x`` and ``y``."""
    at = lambda dx, dy: (x.format(f"(lon + {dx})"), y.format(f"(lat + {dy})"))
    row = lambda first, last, n: f"{first[0]} AS lon, {first[1]} AS lat, {last[0]} AS last_lon, {last[1]} AS last_lat, CAST({n} AS INTEGER) AS n"
    return _each_shape(row(at(0, 0), at(0, 0), 1), row(at(0, 0), at(0.5, 0.25), 2), row(at(0, 0), at(0, 0), 5))


@query("geo3_from_wkt", f"SELECT *, true AS round_trip FROM ({_ends_sql('{}', '{}')})")
def _(t):
    g = geo.from_wkt(geo.wkt(F.col("geometry")))
    df = shapes(t).select("s_suppkey", "geometry", g.alias("g"))
    return df.select("s_suppkey", _kind(), *_ends(F.col("g")), (F.col("g") == F.col("geometry")).alias("round_trip"))


@query("geo4_translate", _ends_sql("{} + 1.5", "{} - 2"))
def _(t):
    return shapes(t).select("s_suppkey", _kind(), *_ends(geo.translate(F.col("geometry"), 1.5, -2)))


@query(
    "geo5_scale",
    f"""WITH b AS (SELECT (min(lon) + max(lon) + 1) / 2 AS x, (min(lat) + max(lat) + 1) / 2 AS y FROM ({XY}))
       SELECT s_suppkey, kind, x + (lon - x) * 0.5 AS lon, y + (lat - y) * 0.5 AS lat, x + (last_lon - x) * 0.5 AS last_lon,
         y + (last_lat - y) * 0.5 AS last_lat, n FROM ({_ends_sql('{}', '{}')}), b""",
)
def _(t):
    return geo.scale(shapes(t), 0.5).select("s_suppkey", _kind(), *_ends(F.col("geometry")))


def _members_sql(east: str, north: str) -> str:
    return f"lon AS west, lat AS south, {east} AS east, {north} AS north, 'no' AS checked, s_name AS name"


@query("geo6_members", _each_shape(_members_sql("lon", "lat"), _members_sql("lon + 0.5", "lat + 0.25"), _members_sql("lon + 1", "lat + 1")))
def _(t):
    df = shapes(t).join(sites(t).select("s_suppkey", "s_name"), "s_suppkey")
    df = df.withColumn("properties", F.create_map(F.lit("name"), F.col("s_name"), F.lit("checked"), F.lit("yes")))
    out = geo.set_properties(geo.set_bbox(df), {"checked": "no"})
    return out.select(
        "s_suppkey", _kind(), *[F.col("bbox")[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))],
        F.col("properties")["checked"].alias("checked"), F.col("properties")["name"].alias("name"),
    )


@query(
    "geo7_rewind",
    _each_shape(
        "CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS DOUBLE) AS ccw_x1, CAST(NULL AS DOUBLE) AS ccw_y1",
        "lon + 0.5 AS x1, lat + 0.25 AS y1, lon + 0.5 AS ccw_x1, lat + 0.25 AS ccw_y1",
        "lon AS x1, lat + 1 AS y1, lon + 1 AS ccw_x1, lat AS ccw_y1",
    ),
)
def _(t):
    """The second position of every shape: rings turn, points and lines stay."""
    second = lambda g: F.get(geo.positions(g), F.lit(1))
    cw, ccw = second(geo.rewind(F.col("geometry"))), second(geo.rewind(F.col("geometry"), clockwise=False))
    return shapes(t).select(
        "s_suppkey", _kind(), cw[0].alias("x1"), cw[1].alias("y1"), ccw[0].alias("ccw_x1"), ccw[1].alias("ccw_y1")
    )


@query(
    "geo8_simplify",
    f"SELECT s_suppkey, CAST(3 AS INTEGER) AS line_points, CAST(5 AS INTEGER) AS ring_points FROM ({XY})",
)
def _(t):
    x, y = F.col("lon"), F.col("lat")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    line = geo.line(F.array(p(0, 0), p(1, 0.0001), p(2, 0), p(2, 1), p(2, 2)))
    ring = geo.polygon(F.array(F.array(p(0, 0), p(0, 1), p(1, 1), p(1, 0), p(0, 0))))
    df = sites(t).select("s_suppkey", line.alias("a"), ring.alias("b"))
    return df.select(
        "s_suppkey",
        F.size(geo.positions(geo.simplify(F.col("a"), 0.01))).alias("line_points"),
        F.size(geo.positions(geo.simplify(F.col("b"), 100.0))).alias("ring_points"),
    )


@query(
    "geo9_clean",
    f"SELECT s_suppkey, CAST(5 AS INTEGER) AS points, lon AS last_lon, 'k' AS keys FROM ({XY}) WHERE s_suppkey % 9 <> 0",
)
def _(t):
    x, y = F.col("lon"), F.col("lat")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    ring = geo.polygon(F.array(F.array(p(0, 0), p(0, 0), p(0, 1), p(1, 1), p(1, 1), p(1, 0))))
    props = F.create_map(F.lit("k"), F.lit("v"), F.lit("blank"), F.lit(""), F.lit("none"), F.lit(None).cast("string"))
    df = sites(t).select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, ring).alias("geometry"), props.alias("properties"))
    out = geo.clean(df)
    pos = geo.positions(F.col("geometry"))
    return out.select("s_suppkey", F.size(pos).alias("points"), F.get(pos, F.size(pos) - 1)[0].alias("last_lon"), F.array_join(F.map_keys("properties"), ",").alias("keys"))


@query("geo10_round", f"SELECT s_suppkey, floor((lon / 7) * 1000 + 0.5) / 1000 AS lon, floor((lat / 7) * 1000 + 0.5) / 1000 AS lat FROM ({XY})")
def _(t):
    df = sites(t).select("s_suppkey", geo.point(F.col("lon") / 7, F.col("lat") / 7).alias("geometry"))
    p = geo.positions(geo.round_coords(F.col("geometry"), 3))[0]
    return df.select("s_suppkey", p[0].alias("lon"), p[1].alias("lat"))


@query(
    "prf13_geo_profile",
    f"""SELECT count(*) * 3 AS features, count(*) * 8 AS vertices, count(*) AS points, count(*) AS polygons, max(lon) + 1 - min(lon) AS width,
         (min(lat) + max(lat) + 1) / 2 AS center_lat FROM ({XY})""",
)
def _(t):
    out = geo.profile(shapes(t))
    return out.select("features", "vertices", F.col("Point").alias("points"), F.col("Polygon").alias("polygons"), "width", "center_lat")


@query(
    "dif8_feature_set_diff",
    f"""WITH a AS (SELECT * FROM ({XY})), b AS (SELECT * FROM a WHERE s_suppkey % 7 <> 0)
       SELECT (SELECT count(*) FROM b) * 3 - (SELECT count(*) FROM a) * 3 AS feature_delta, (SELECT min(lon) + 2 FROM b) - (SELECT min(lon) FROM a) AS delta_min_lon, true AS spatial_shift""",
)
def _(t):
    a = shapes(t)
    b = a.filter("s_suppkey % 7 <> 0").withColumn("geometry", geo.translate(F.col("geometry"), 2, 0))
    return geo.set_diff(a, b).select("feature_delta", "delta_min_lon", "spatial_shift")


@query(
    "val16_geo_errors",
    f"""SELECT s_suppkey, '$.geometry.coordinates[0]' AS path FROM ({XY}) WHERE lon + 10 > 180 AND s_suppkey % 6 <> 0
       UNION ALL SELECT s_suppkey, '$.type' FROM ({XY}) WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, '$.bbox' FROM ({XY}) WHERE s_suppkey % 5 = 0 AND s_suppkey % 6 <> 0""",
)
def _(t):
    body = F.concat(
        F.lit('{"type":"'), F.when(F.col("s_suppkey") % 6 == 0, "Thing").otherwise("Feature"), F.lit('","geometry":{"type":"Point","coordinates":['),
        (F.col("lon") + 10).cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"),
        F.when(F.col("s_suppkey") % 5 == 0, ',"bbox":[1,2,3]').otherwise(""), F.lit(',"properties":{"a":1}}'),
    )
    return sites(t).select("s_suppkey", F.inline(geo.errors(F.try_parse_json(body)))).select("s_suppkey", "path")


@query(
    "val16_collection_errors",
    f"""SELECT * FROM (SELECT s_suppkey, unnest([CASE WHEN lon + 10 > 180 THEN '$.features[0].geometry.geometries[1].geometries[0].coordinates[0]' END,
         CASE WHEN s_suppkey % 6 = 0 THEN '$.features[1].type' END, CASE WHEN s_suppkey % 7 = 0 THEN '$.features[0].geometry.geometries[0]' END]) AS path
       FROM ({XY}) WHERE s_suppkey % 5 <> 0) WHERE path IS NOT NULL
       UNION ALL SELECT s_suppkey, '$.features' FROM ({XY}) WHERE s_suppkey % 5 = 0""",
)
def _(t):
    """Faults at every level of nested collections."""
    k = F.col("s_suppkey")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), (F.col("lon") + 10).cast("string"), F.lit(",1]}"))
    inner = F.concat(
        F.lit('{"type":"GeometryCollection","geometries":['), F.when(k % 7 == 0, '{"a":1}').otherwise('{"type":"Point","coordinates":[1,1]}'),
        F.lit(',{"type":"GeometryCollection","geometries":['), point, F.lit("]}]}"),
    )
    body = F.concat(
        F.lit('{"type":"FeatureCollection","features":'),
        F.when(k % 5 == 0, "3").otherwise(
            F.concat(
                F.lit('[{"type":"Feature","properties":null,"geometry":'), inner, F.lit('},{"type":"'),
                F.when(k % 6 == 0, "Thing").otherwise("Point"), F.lit('","coordinates":[0,0]}]'),
            )
        ),
        F.lit("}"),
    )
    return sites(t).select("s_suppkey", F.inline(geo.errors(F.try_parse_json(body)))).select("s_suppkey", "path")


# --- pages ------------------------------------------------------------------


@query(
    "txt1_document_text",
    """SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""",
)
def _(t):
    return pagetext.document_text(t.conversations, "conv_id", "turn", first_page=0)


@query(
    "txt2_clean_text",
    r"""SELECT doc_id, regexp_replace(text, '[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{FFFD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g') AS clean FROM documents""",
)
def _(t):
    # Line feeds stay; the marks that are put in have to go.
    marked = F.concat(F.lit("\u0001\ufeff"), F.replace("text", F.lit(" "), F.lit(" \u200b")), F.lit("\ufffd\u007f"))
    return t.documents.select("doc_id", pagetext.clean_text(marked).alias("clean"))


@query(
    "prf15_page_profile",
    r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars,
         CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents""",
)
def _(t):
    return pagetext.page_profile(t.documents).select("doc_id", "chars", "words")


@query(
    "prf15_document_profile",
    r"""SELECT conv_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars,
         CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1""",
)
def _(t):
    return pagetext.document_profile(t.conversations, "conv_id")


@query(
    "txt3_lines",
    r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '[ \t\n\r\x0b\x0c]+'), lambda x: true) AS w FROM conversations),
         i AS (SELECT conv_id AS doc, turn AS page, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word, len(w) AS n FROM t)
       SELECT doc, page, CAST(floor(i / 8) + 1 AS BIGINT) AS line_no, string_agg(word || CASE WHEN i % 8 = 7 OR i = n - 1 OR length(word) <= 2 THEN '' ELSE ' ' END, '' ORDER BY i) AS text
       FROM i GROUP BY 1, 2, 3""",
)
def _(t):
    # Words of each conversation turn set on lines of eight, as positioned items.
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "text"))
    items = words.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"), ((F.col("i") % 8) * 60).cast("double").alias("x"),
        (800 - F.floor(F.col("i") / 8) * 12).cast("double").alias("y"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"), "text",
    )
    return pagetext.assemble_lines(items)


@query(
    "txt3_sloping_lines",
    r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '[ \t\n\r\x0b\x0c]+'), lambda x: true) AS w FROM conversations),
         i AS (SELECT conv_id AS doc, turn AS page, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word, len(w) AS n FROM t),
         k AS (SELECT *, i // 40 AS block, i % 40 AS j FROM i)
       SELECT doc, page, CAST(20 * block + j // 2 + 1 AS BIGINT) AS line_no,
         string_agg(word || CASE WHEN j % 2 = 1 OR i = n - 1 OR length(word) <= 2 THEN '' ELSE ' ' END, '' ORDER BY i) AS text
       FROM k GROUP BY 1, 2, 3""",
)
def _(t):
    """Words that each stand 3 lower than the one before: every third one is too far from the first of its line."""
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "text"))
    fall = (F.col("i") % 40) * 3 + F.floor(F.col("i") / 40) * 200
    items = words.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"), ((F.col("i") % 40) * 60).cast("double").alias("x"),
        (800 - fall).cast("double").alias("y"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"), "text",
    )
    return pagetext.assemble_lines(items)


PAGES = "SELECT conv_id AS doc, turn + 1 AS page_no, text FROM conversations"


def pages(t):
    return t.conversations.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_no"), "text")


@query(
    "txt4_select_pages",
    f"SELECT doc, CASE page_no WHEN 2 THEN 1 WHEN 1 THEN 2 END AS page_no, text FROM ({PAGES}) WHERE page_no IN (1, 2)",
)
def _(t):
    return pagetext.select_pages(pages(t), [2, 1])


@query(
    "txt4_drop_pages",
    f"SELECT doc, page_no - CASE WHEN page_no > 1 THEN 1 ELSE 0 END - CASE WHEN page_no > 3 THEN 1 ELSE 0 END AS page_no, text FROM ({PAGES}) WHERE page_no NOT IN (1, 3)",
)
def _(t):
    return pagetext.drop_pages(pages(t), [1, 3])


@query(
    "txt4_move_page",
    f"SELECT doc, CASE WHEN page_no = 1 THEN 2 WHEN page_no = 2 THEN 1 ELSE page_no END AS page_no, text FROM ({PAGES})",
)
def _(t):
    return pagetext.move_page(pages(t), 1, 2)


@query(
    "txt4_split",
    f"SELECT doc || '-' || CAST(floor((page_no - 1) / 2) + 1 AS BIGINT) AS doc, CAST((page_no - 1) % 2 + 1 AS BIGINT) AS page_no, text FROM ({PAGES})",
)
def _(t):
    return pagetext.split_documents(pages(t), 2)


@query(
    "txt4_merge",
    f"""SELECT 'all' AS doc, page_no + o AS page_no, CAST(doc AS VARCHAR) AS source, text FROM ({PAGES}) JOIN
       (SELECT doc, CAST(sum(max(page_no)) OVER (ORDER BY doc) - max(page_no) AS BIGINT) AS o FROM ({PAGES}) GROUP BY doc) USING (doc)""",
)
def _(t):
    return pagetext.merge_documents(pages(t), "all", F.col("doc"))


@query(
    "txt5_page_json",
    f"""SELECT doc, page_no, '{{"pageNumber":' || page_no || ',"textLength":' || length(text) || '}}' AS json FROM ({PAGES})""",
)
def _(t):
    out = pagetext.page_json(pages(t))
    v = F.from_json("json", "pageNumber long, textLength long, text string")
    same = pages(t).select("doc", "page_no", "text")
    parsed = out.select("doc", "page_no", v.alias("v")).join(same, ["doc", "page_no"]).filter("v.text = text")
    return parsed.select("doc", "page_no", F.to_json(F.struct("v.pageNumber", "v.textLength")).alias("json"))


@query(
    "txt5_export_xml",
    f"""WITH p AS ({PAGES}), n AS (SELECT doc, max(page_no) AS n FROM p GROUP BY doc)
       SELECT doc, page_no AS line_no, '<Page number="' || page_no || '"><Text>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</Text></Page>' AS text FROM p
       UNION ALL SELECT doc, 0, '<?xml version="1.0" encoding="UTF-8"?><Document version="1.7" pageCount="' || n || '"><Pages>' FROM n
       UNION ALL SELECT doc, n + 1, '</Pages></Document>' FROM n""",
)
def _(t):
    return pagetext.export_lines(pages(t), "xml")


@query("txt6_rotate", f"SELECT doc, page_no, CAST((page_no * 90 + 630) % 360 AS BIGINT) AS rotation FROM ({PAGES})")
def _(t):
    df = pages(t).withColumn("rotation", F.col("page_no") * 90)
    return pagetext.rotate(df, -90).select("doc", "page_no", F.col("rotation").cast("bigint").alias("rotation"))


# --- missing data -----------------------------------------------------------

GAPS = """SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 4 <> 0 THEN NULL ELSE value END AS sparse FROM events"""


def gaps(t):
    i = F.col("event_id")
    return t.events.select(
        "event_id", "user_id", F.when(i % 5 != 0, F.col("event_type")).alias("event_type"), F.when(i % 7 != 0, F.col("value")).alias("value"),
        F.when(i % 4 == 0, F.col("value")).alias("sparse"),
    )


@query(
    "imp1_missing_report",
    f"""SELECT unnest(['event_id', 'user_id', 'event_type', 'value', 'sparse']) AS "column",
         unnest([0, 0, count(*) - count(event_type), count(*) - count(value), count(*) - count(sparse)]) AS missing,
         unnest([0, 0, (count(*) - count(event_type)) / count(*), (count(*) - count(value)) / count(*), (count(*) - count(sparse)) / count(*)]) AS rate FROM ({GAPS})""",
)
def _(t):
    return impute.missing_report(gaps(t))


@query("imp2_listwise", f"SELECT * FROM ({GAPS}) WHERE event_type IS NOT NULL AND value IS NOT NULL AND sparse IS NOT NULL")
def _(t):
    return impute.listwise(gaps(t))


@query("imp3_drop_sparse", f"SELECT event_id, user_id, event_type, value FROM ({GAPS})")
def _(t):
    return impute.drop_sparse_columns(gaps(t), 0.6)


@query(
    "imp4_simple",
    f"""WITH g AS ({GAPS}) SELECT event_id, coalesce(value, (SELECT median(value) FROM g)) AS value, floor(coalesce(sparse, (SELECT avg(sparse) FROM g)) * 1e6 + 0.5) / 1e6 AS sparse,
         coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g""",
)
def _(t):
    out = impute.impute(gaps(t), {"value": "median", "sparse": "mean", "event_type": "mode"})
    return out.select("event_id", "value", (F.floor(F.col("sparse") * 1e6 + 0.5).cast("double") / 1e6).alias("sparse"), "event_type")


@query(
    "imp5_group_median",
    f"""WITH g AS ({GAPS}) SELECT event_id, coalesce(value, m) AS value FROM g JOIN (SELECT user_id, median(value) AS m FROM g GROUP BY 1) USING (user_id)""",
)
def _(t):
    return impute.group_median(gaps(t), "user_id", "value").select("event_id", "value")


@query("imp6_label", f"SELECT event_id, coalesce(event_type, 'Missing') AS event_type, event_type IS NULL AS event_type_missing FROM ({GAPS})")
def _(t):
    return impute.label(gaps(t).select("event_id", "event_type"), "event_type")


@query(
    "imp7_knn",
    f"""WITH g AS (SELECT event_id, value, CAST(event_id * 3 % 1009 AS DOUBLE) AS f FROM ({GAPS})),
         n AS (SELECT a.event_id, b.value FROM g a JOIN g b ON a.value IS NULL AND b.value IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.f - b.f), b.event_id) <= 5)
       SELECT event_id, coalesce(value, m) AS value FROM g LEFT JOIN (SELECT event_id, floor(avg(value) * 1e6 + 0.5) / 1e6 AS m FROM n GROUP BY 1) USING (event_id)""",
)
def _(t):
    df = gaps(t).withColumn("f", F.col("event_id").cast("double") * 3 % 1009)
    out = impute.knn(df, "value", "f", 5, row="event_id")
    return out.select("event_id", (F.floor(F.col("value") * 1e6 + 0.5).cast("double") / 1e6).alias("value"))


@query(
    "imp7_knn_features",
    f"""WITH g AS (SELECT event_id, value, CAST(event_id % 40 AS DOUBLE) AS f1, CAST(event_id * 7 % 31 AS DOUBLE) AS f2, CAST(user_id % 25 AS DOUBLE) AS f3
           FROM ({GAPS})),
         p AS (SELECT DISTINCT f1, f2, f3 FROM g WHERE value IS NULL),
         n AS (SELECT p.*, b.value FROM p JOIN g b ON b.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.f1, p.f2, p.f3
               ORDER BY sqrt((p.f1 - b.f1) * (p.f1 - b.f1) + (p.f2 - b.f2) * (p.f2 - b.f2) + (p.f3 - b.f3) * (p.f3 - b.f3)), b.event_id) <= 5),
         m AS (SELECT f1, f2, f3, floor(avg(value) * 1e6 + 0.5) / 1e6 AS m FROM n GROUP BY ALL)
       SELECT event_id, coalesce(value, m) AS value FROM g LEFT JOIN m USING (f1, f2, f3)""",
)
def _(t):
    """Three features with many ties and repeated points."""
    i = F.col("event_id")
    df = gaps(t).withColumns(
        {"f1": (i % 40).cast("double"), "f2": (i * 7 % 31).cast("double"), "f3": (F.col("user_id") % 25).cast("double")}
    )
    out = impute.knn(df, "value", ["f1", "f2", "f3"], 5, row="event_id")
    return out.select("event_id", (F.floor(F.col("value") * 1e6 + 0.5).cast("double") / 1e6).alias("value"))


MICE = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END AS q,
  CASE WHEN l_partkey % 8 <> 0 THEN l_extendedprice END AS p, l_discount AS d FROM lineitem"""


def _regressed(step: int, y: str, x: str) -> str:
    """One chained step in SQL: ``y`` on ``x`` and d, by the closed form for two predictors."""
    s = lambda a, b: f"covar_pop({a}, {b})"
    flat = f"({s(x, x)} * {s('d', 'd')} - {s(x, 'd')} * {s(x, 'd')})"
    return f"""f{step} AS (SELECT ({s(x, y)} * {s('d', 'd')} - {s('d', y)} * {s(x, 'd')}) / {flat} AS b,
        ({s('d', y)} * {s(x, x)} - {s(x, y)} * {s(x, 'd')}) / {flat} AS c, avg({y}) AS my, avg({x}) AS mx, avg(d) AS md
      FROM r{step - 1} WHERE NOT g{y}),
    r{step} AS (SELECT r.* REPLACE (CASE WHEN g{y} THEN my + b * ({x} - mx) + c * (d - md) ELSE {y} END AS {y}) FROM r{step - 1} r, f{step})"""


@query(
    "imp8_mice",
    f"""WITH m AS ({MICE}),
    r0 AS (SELECT l_orderkey, l_linenumber, q IS NULL AS gq, p IS NULL AS gp, coalesce(q, (SELECT avg(q) FROM m)) AS q,
      coalesce(p, (SELECT avg(p) FROM m)) AS p, d FROM m),
    {_regressed(1, "q", "p")}, {_regressed(2, "p", "q")}, {_regressed(3, "q", "p")}, {_regressed(4, "p", "q")}
    SELECT l_orderkey, l_linenumber, floor(q * 1e4 + 0.5) / 1e4 AS q, floor(p * 1e4 + 0.5) / 1e4 AS p, d FROM r4""",
)
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_partkey") % 8 != 0, F.col("l_extendedprice")).alias("p"), F.col("l_discount").alias("d"),
    )
    near = lambda c: (F.floor(F.col(c) * 1e4 + 0.5).cast("double") / 1e4).alias(c)
    return impute.mice(df, ["q", "p", "d"], 2).select("l_orderkey", "l_linenumber", near("q"), near("p"), "d")


@query(
    "imp8_one_gap_column",
    f"""WITH m AS ({MICE.replace("CASE WHEN l_partkey % 8 <> 0 THEN l_extendedprice END", "l_extendedprice")}),
    f AS (SELECT regr_slope(q, p) AS b, regr_intercept(q, p) AS a FROM m)
    SELECT l_orderkey, l_linenumber, floor(coalesce(q, a + b * p) * 1e4 + 0.5) / 1e4 AS q FROM m, f""",
)
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity")).alias("q"),
        F.col("l_extendedprice").alias("p"),
    )
    out = impute.mice(df, ["q", "p"], 3)
    return out.select("l_orderkey", "l_linenumber", (F.floor(F.col("q") * 1e4 + 0.5).cast("double") / 1e4).alias("q"))


@query(
    "imp9_fit_transform",
    f"""WITH g AS ({GAPS}) SELECT event_id, coalesce(value, (SELECT median(value) FROM g WHERE event_id % 3 <> 0)) AS value FROM g WHERE event_id % 3 = 0""",
)
def _(t):
    train, test = gaps(t).filter("event_id % 3 <> 0"), gaps(t).filter("event_id % 3 = 0")
    return impute.SimpleImputer({"value": "median"}).fit(train).transform(test).select("event_id", "value")
