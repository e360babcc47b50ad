"""Geographic features as rows: geometry edits, checks, profiles and text forms.

A geometry is ``struct<type, parts array<struct<type, coords>>>``: one part per
geometry, several for a collection. Coordinates always nest as polygon > ring >
position > number, so one expression serves all seven types; a point is one
polygon with one ring of one position.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import col
from tablekit.functions.jsonpaths import as_array, as_map, as_text
from tablekit.operators.jsondoc import unfold

COORDS = "array<array<array<array<double>>>>"
PART = f"struct<type:string,coords:{COORDS}>"
GEOMETRY = f"struct<type:string,parts:array<{PART}>>"

# Geometry types and how deep their coordinates nest.
DEPTH = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}
# The box that stands for "no coordinates".
WORLD = (-180.0, -90.0, 180.0, 90.0)


def point(lon: Column, lat: Column) -> Column:
    coords = F.array(F.array(F.array(F.array(lon, lat))))
    return geometry("Point", coords)


def geometry(kind: str, coords: Column) -> Column:
    part = F.struct(F.lit(kind).alias("type"), coords.alias("coords"))
    return F.struct(F.lit(kind).alias("type"), F.array(part).alias("parts")).cast(GEOMETRY)


def line(positions: Column) -> Column:
    return geometry("LineString", F.array(F.array(positions)))


def polygon(rings: Column) -> Column:
    return geometry("Polygon", F.array(rings))


def from_geojson(v: Column) -> Column:
    """The geometry of a GeoJSON geometry object given as VARIANT."""

    def part(g: Column) -> Column:
        kind = F.try_variant_get(g, "$.type", "string")

        def read(array_type: str) -> Column:
            return F.try_variant_get(g, "$.coordinates", array_type)

        p1, p2 = read("array<double>"), read("array<array<double>>")
        p3, p4 = read("array<array<array<double>>>"), read(COORDS)
        coords = (
            F.when(kind == "Point", F.array(F.array(F.array(p1))))
            .when(kind.isin("MultiPoint", "LineString"), F.array(F.array(p2)))
            .when(kind.isin("MultiLineString", "Polygon"), F.array(p3))
            .when(kind == "MultiPolygon", p4)
        )
        return F.struct(kind.alias("type"), coords.alias("coords")).cast(PART)

    kind = F.try_variant_get(v, "$.type", "string")
    inside = F.filter(members(v), lambda m: F.try_variant_get(m["v"], "$.type", "string") != "GeometryCollection")
    parts = F.when(kind == "GeometryCollection", F.transform(inside, lambda m: part(m["v"]))).otherwise(F.array(part(v)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")).cast(GEOMETRY))


MEMBER = "struct<path:string,v:variant>"


def members(v: Column, path: Column | None = None) -> Column:
    """``path, v`` of an object and of all geometries and features in it, collections in collections too."""
    root = F.struct((F.lit("$") if path is None else path).alias("path"), v.alias("v"))
    kinds = "GeometryCollection", "FeatureCollection"
    text = F.to_json(v)
    # A collection lies no deeper than there are collections.
    levels = F.lit(1)
    for kind in kinds:
        levels = levels + F.size(F.split(text, kind)) - 1

    def below(m: Column) -> Column:
        kind = F.try_variant_get(m["v"], "$.type", "string")

        def listed(name: str) -> Column:
            items = F.try_variant_get(m["v"], f"$.{name}", "array<variant>")
            return F.transform(
                items,
                lambda x, i: F.struct(F.concat(m["path"], F.lit(f".{name}["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")),
            )

        shape = F.try_variant_get(m["v"], "$.geometry", "variant")
        own = F.array(F.struct(F.concat(m["path"], F.lit(".geometry")).alias("path"), shape.alias("v")))
        return (
            F.when(kind == "GeometryCollection", listed("geometries"))
            .when(kind == "FeatureCollection", listed("features"))
            .when((kind == "Feature") & as_map(shape).isNotNull(), own)
        )

    # A feature is one level between its collection and its shape.
    return unfold(root, MEMBER, 2 * levels, below)


def features(df: DataFrame, json: str, keep: list[str] | None = None) -> DataFrame:
    """One row per feature of FeatureCollections, Features or bare geometries.

    ``keep, index, geometry, properties map<string,string>``.
    """
    v = F.try_parse_json(col(json))
    kind = F.try_variant_get(v, "$.type", "string")
    many = F.when(kind == "FeatureCollection", F.try_variant_get(v, "$.features", "array<variant>")).otherwise(
        F.array(v)
    )
    f = F.col("_f")
    bare = F.try_variant_get(f, "$.type", "string") != "Feature"
    shape = F.when(bare, f).otherwise(F.try_variant_get(f, "$.geometry", "variant"))
    props = F.transform_values(as_map(F.try_variant_get(f, "$.properties", "variant")), lambda _, x: as_text(x))
    return df.select(*[col(k) for k in keep or []], F.posexplode(many).alias("index", "_f")).select(
        *[col(k) for k in keep or []],
        "index",
        from_geojson(shape).alias("geometry"),
        F.when(~bare, props).alias("properties"),
    )


def point_features(df: DataFrame) -> DataFrame:
    """Points from a table with latitude and longitude columns, found by name.

    Rows without two numbers are left out; all other columns become properties.
    """
    import re

    lat = next(c for c in df.columns if re.fullmatch(r"(?i)lat|latitude|y", c))
    lon = next(c for c in df.columns if re.fullmatch(r"(?i)lon|lng|longitude|long|x", c))
    rest = [c for c in df.columns if c not in (lat, lon)]
    pairs = [x for c in rest for x in (F.lit(c), col(c).cast("string"))]
    x, y = col(lon).try_cast("double"), col(lat).try_cast("double")
    props = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(point(x, y).alias("geometry"), props.alias("properties")).filter(x.isNotNull() & y.isNotNull())


# --- coordinates ------------------------------------------------------------


def map_coords(g: Column, change: Callable[[Column], Column]) -> Column:
    """Apply a function to the coordinates of every part."""
    parts = F.transform(
        g["parts"], lambda p: F.struct(p["type"].alias("type"), change(p["coords"]).alias("coords"))
    )
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), parts.alias("parts")))


def map_positions(g: Column, change: Callable[[Column], Column]) -> Column:
    return map_coords(
        g, lambda c: F.transform(c, lambda poly: F.transform(poly, lambda ring: F.transform(ring, change)))
    )


def positions(g: Column) -> Column:
    """All positions of a geometry as one array."""
    return F.flatten(F.flatten(F.flatten(F.transform(g["parts"], lambda p: p["coords"]))))


def _moved(p: Column, x: Column, y: Column) -> Column:
    return F.concat(F.array(x, y), F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))))


def translate(g: Column, dx: float, dy: float) -> Column:
    return map_positions(g, lambda p: _moved(p, p[0] + F.lit(float(dx)), p[1] + F.lit(float(dy))))


def bbox_of(g: Column) -> Column:
    """``struct<min_lon, min_lat, max_lon, max_lat>`` of one geometry."""
    all_ = positions(g)
    xs, ys = F.transform(all_, lambda p: p[0]), F.transform(all_, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_lon"),
        F.array_min(ys).alias("min_lat"),
        F.array_max(xs).alias("max_lon"),
        F.array_max(ys).alias("max_lat"),
    )


def bbox(df: DataFrame, g: str = "geometry") -> DataFrame:
    """The box of all features, the world when there are no coordinates."""
    boxes = df.select(bbox_of(col(g)).alias("b"))
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    return boxes.agg(
        *[
            F.coalesce((F.min if n.startswith("min") else F.max)(f"b.{n}"), F.lit(w)).alias(n)
            for n, w in zip(names, WORLD)
        ]
    )


def scale(df: DataFrame, factor: float, g: str = "geometry") -> DataFrame:
    """Scale about the centre of the box of all features."""
    box = bbox(df, g).select(
        F.struct(
            ((F.col("min_lon") + F.col("max_lon")) / 2).alias("x"),
            ((F.col("min_lat") + F.col("max_lat")) / 2).alias("y"),
        ).alias("c")
    )
    c = F.col("_c")
    changed = map_positions(
        col(g),
        lambda p: _moved(p, c["x"] + (p[0] - c["x"]) * factor, c["y"] + (p[1] - c["y"]) * factor),
    )
    return df.withColumn("_c", box.scalar()).withColumn(g, changed).drop("_c")


def round_coords(g: Column, places: int = 5) -> Column:
    unit = float(10**places)
    return map_positions(g, lambda p: F.transform(p, lambda x: F.floor(x * unit + 0.5).cast("double") / unit))


def set_bbox(df: DataFrame, g: str = "geometry") -> DataFrame:
    """Add ``bbox`` [min lon, min lat, max lon, max lat] to every feature."""
    b = bbox_of(col(g))
    return df.withColumn("bbox", F.array(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]))


def set_properties(df: DataFrame, values: Mapping[str, Any], props: str = "properties") -> DataFrame:
    """Add or replace properties."""
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(str(v)))])
    old = F.map_filter(col(props), lambda k, _: ~k.isin(list(values)))
    return df.withColumn(props, F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), new))


def rewind(g: Column, clockwise: bool = True, same_for_holes: bool = False) -> Column:
    """Turn rings so that outer rings run clockwise and holes the other way.

    ``same_for_holes`` turns all rings alike.
    """

    def turned(ring: Column, want: Column) -> Column:
        ahead = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
        steps = F.zip_with(ring, ahead, lambda p, q: (q[0] - p[0]) * (q[1] + p[1]))
        area = F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        return F.when((area > 0) == want, ring).otherwise(F.reverse(ring))

    def rings(poly: Column) -> Column:
        def one(ring: Column, i: Column) -> Column:
            outer = F.lit(clockwise)
            return turned(ring, outer if same_for_holes else F.when(i == 0, outer).otherwise(~outer))

        return F.transform(poly, one)

    parts = F.transform(
        g["parts"],
        lambda p: F.struct(
            p["type"].alias("type"),
            F.when(p["type"].isin("Polygon", "MultiPolygon"), F.transform(p["coords"], rings))
            .otherwise(p["coords"])
            .alias("coords"),
        ),
    )
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), parts.alias("parts")))


# --- cleaning ---------------------------------------------------------------


def _without_repeats(ring: Column) -> Column:
    return F.filter(
        ring,
        lambda p, i: (i == 0)
        | (p[0] != F.get(ring, i - 1)[0])
        | (p[1] != F.get(ring, i - 1)[1]),
    )


def _closed(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    is_open = (F.size(ring) >= 3) & ((first[0] != last[0]) | (first[1] != last[1]))
    return F.when(is_open, F.concat(ring, F.array(F.array(first[0], first[1])))).otherwise(ring)


def clean_geometry(g: Column, repeats: bool = True, close_rings: bool = True) -> Column:
    """Drop repeated vertices of lines and polygons and close polygon rings."""

    def change(p: Column) -> Column:
        def ring(r: Column) -> Column:
            out = _without_repeats(r) if repeats else r
            return out

        tidy = F.transform(p["coords"], lambda poly: F.transform(poly, ring))
        closed = F.transform(tidy, lambda poly: F.transform(poly, _closed)) if close_rings else tidy
        return (
            F.when(p["type"] == "Polygon", closed).when(p["type"] == "LineString", tidy).otherwise(p["coords"])
        )

    # Only plain polygons and lines are touched, not the Multi types.
    parts = F.transform(
        g["parts"], lambda p: F.struct(p["type"].alias("type"), change(p).alias("coords"))
    )
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), parts.alias("parts")))


def clean(df: DataFrame, g: str = "geometry", props: str = "properties") -> DataFrame:
    """Clean geometries, drop blank properties and features without geometry."""
    out = df.filter(col(g).isNotNull()).withColumn(g, clean_geometry(col(g)))
    if props in df.columns:
        out = out.withColumn(props, F.map_filter(col(props), lambda _, v: v.isNotNull() & (v != "")))
    return out


def _thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: the points further than the tolerance from each chord."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(points) - 1)]
    while open_spans:
        lo, hi = open_spans.pop()
        if hi - lo < 2:
            continue
        start, chord = points[lo, :2], points[hi, :2] - points[lo, :2]
        offset = points[lo + 1 : hi, :2] - start
        size = float(chord @ chord)
        # Distance to the line through both ends, or to the end when they coincide.
        along = np.outer(offset @ chord / size, chord) if size else 0.0
        far = np.sqrt(((offset - along) ** 2).sum(axis=1))
        if far.max() > tolerance:
            mid = lo + 1 + int(far.argmax())
            keep[mid] = True
            open_spans += [(lo, mid), (mid, hi)]
    return points[keep]


def simplify(g: Column, tolerance: float = 0.001) -> Column:
    """Thin lines and polygon rings; a ring that would fall below four points stays."""

    @F.pandas_udf(COORDS)
    def run(kinds: pd.Series, coords: pd.Series) -> pd.Series:
        def ring(kind, points):
            if len(points) < 3:
                return [list(p) for p in points]
            thin = _thinned(np.array([list(p) for p in points], dtype=float), tolerance)
            kept = points if kind == "Polygon" and len(thin) < 4 else thin
            return [[float(x) for x in p] for p in kept]

        def one(kind, polys):
            if kind not in ("LineString", "Polygon") or polys is None:
                return None
            return [[ring(kind, r) for r in poly] for poly in polys]

        return pd.Series([one(k, c) for k, c in zip(kinds, coords)], dtype=object)

    # A single geometry has one part; collections are left as they are.
    part = F.get(g["parts"], F.lit(0))
    thin = run(part["type"], part["coords"])
    changed = F.struct(part["type"].alias("type"), F.coalesce(thin, part["coords"]).alias("coords"))
    return F.when(
        g["type"].isin("LineString", "Polygon"),
        F.struct(g["type"].alias("type"), F.array(changed).alias("parts")),
    ).otherwise(g)


# --- text forms -------------------------------------------------------------


def number_text(x: Column) -> Column:
    """A number in its short plain form: 5, not 5.0, and no exponent."""
    text = x.cast("string")
    plain = F.when(text.contains("E"), x.cast("decimal(38,18)").cast("string")).otherwise(text)
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def _joined(xs: Column, sep: str, each: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(xs, each), sep)


def wkt(g: Column) -> Column:
    """Well-known text of a geometry."""

    def pos(p: Column) -> Column:
        return _joined(p, " ", number_text)

    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), _joined(r, ", ", pos), F.lit(")"))

    def poly(c: Column) -> Column:
        return F.concat(F.lit("("), _joined(c, ", ", ring), F.lit(")"))

    def part(p: Column) -> Column:
        kind, first = p["type"], F.get(p["coords"], F.lit(0))
        body = (
            F.when(kind.isin("Point", "LineString"), ring(F.get(first, F.lit(0))))
            .when(
                kind == "MultiPoint",
                F.concat(
                    F.lit("("),
                    _joined(F.get(first, F.lit(0)), ", ", lambda x: F.concat(F.lit("("), pos(x), F.lit(")"))),
                    F.lit(")"),
                ),
            )
            .when(kind.isin("MultiLineString", "Polygon"), poly(first))
            .when(kind == "MultiPolygon", F.concat(F.lit("("), _joined(p["coords"], ", ", poly), F.lit(")")))
        )
        return F.concat(F.upper(kind), F.lit(" "), body)

    single = part(F.get(g["parts"], F.lit(0)))
    many = F.concat(F.lit("GEOMETRYCOLLECTION ("), _joined(g["parts"], ", ", part), F.lit(")"))
    return (
        F.when(g.isNull(), "GEOMETRYCOLLECTION EMPTY")
        .when(g["type"] == "GeometryCollection", many)
        .otherwise(F.coalesce(single, F.lit("GEOMETRYCOLLECTION EMPTY")))
    )


def from_wkt(c: Column) -> Column:
    """Geometry of POINT, LINESTRING or POLYGON text; null for anything else."""
    kind = F.upper(F.regexp_extract(c, r"(?is)^\s*([A-Z]+)\s*\(.*\)\s*$", 1))
    inner = F.trim(F.regexp_extract(c, r"(?is)^\s*[A-Z]+\s*\((.*)\)\s*$", 1))

    def pos(s: Column) -> Column:
        return F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("double"))

    def ring(s: Column) -> Column:
        return F.transform(F.split(s, ","), pos)

    rings = F.transform(
        F.split(F.regexp_replace(inner, r"^\(|\)$", ""), r"\)\s*,\s*\("), ring
    )
    return (
        F.when(kind == "POINT", geometry("Point", F.array(F.array(F.array(pos(inner))))))
        .when(kind == "LINESTRING", line(ring(inner)))
        .when(kind == "POLYGON", polygon(rings))
    )


def geojson_text(g: Column) -> Column:
    """A GeoJSON geometry object as text."""

    def arr(xs: Column, each: Callable[[Column], Column]) -> Column:
        return F.concat(F.lit("["), _joined(xs, ",", each), F.lit("]"))

    def pos(p: Column) -> Column:
        return arr(p, number_text)

    def ring(r: Column) -> Column:
        return arr(r, pos)

    def poly(c: Column) -> Column:
        return arr(c, ring)

    def part(p: Column) -> Column:
        kind, first = p["type"], F.get(p["coords"], F.lit(0))
        line_ = F.get(first, F.lit(0))
        body = (
            F.when(kind == "Point", pos(F.get(line_, F.lit(0))))
            .when(kind.isin("MultiPoint", "LineString"), ring(line_))
            .when(kind.isin("MultiLineString", "Polygon"), poly(first))
            .otherwise(arr(p["coords"], poly))
        )
        return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))

    many = F.concat(
        F.lit('{"type":"GeometryCollection","geometries":'), arr(g["parts"], part), F.lit("}")
    )
    return F.when(g["type"] == "GeometryCollection", many).otherwise(part(F.get(g["parts"], F.lit(0))))


# --- profile, diff, checks --------------------------------------------------


def profile(df: DataFrame, g: str = "geometry") -> DataFrame:
    """Feature, vertex and geometry counts, box, centre, width and height, in one row."""
    own = F.array(col(g)["type"])
    members = F.transform(col(g)["parts"], lambda p: p["type"])
    one = df.select(
        F.size(positions(col(g))).alias("vertices"),
        bbox_of(col(g)).alias("b"),
        F.when(col(g)["type"] == "GeometryCollection", F.concat(own, members)).otherwise(own).alias("kinds"),
    )
    kinds = [*DEPTH, "GeometryCollection"]
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    out = one.agg(
        F.count(F.lit(1)).alias("features"),
        F.coalesce(F.sum("vertices"), F.lit(0)).alias("vertices"),
        *[
            F.coalesce(F.sum(F.size("kinds") - F.size(F.array_remove("kinds", k))), F.lit(0)).alias(k)
            for k in kinds
        ],
        *[
            F.coalesce((F.min if n.startswith("min") else F.max)(f"b.{n}"), F.lit(w)).alias(n)
            for n, w in zip(names, WORLD)
        ],
    )
    return out.withColumns(
        {
            "width": F.col("max_lon") - F.col("min_lon"),
            "height": F.col("max_lat") - F.col("min_lat"),
            "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
        }
    )


def property_keys(df: DataFrame, props: str = "properties") -> DataFrame:
    return df.select(F.explode(F.map_keys(col(props))).alias("key")).distinct()


def set_diff(a: DataFrame, b: DataFrame, g: str = "geometry") -> DataFrame:
    """Feature count change and box shift between two feature sets, as one row."""
    names = ("min_lon", "min_lat", "max_lon", "max_lat")

    def one(df: DataFrame) -> Column:
        return profile(df, g).select(F.struct("features", *names).alias("s")).scalar()

    pair = a.sparkSession.range(1).select(one(a).alias("a"), one(b).alias("b"))
    shifts = [(F.col("b")[n] - F.col("a")[n]).alias("delta_" + n) for n in names]
    out = pair.select((F.col("b.features") - F.col("a.features")).alias("feature_delta"), *shifts)
    moved = F.lit(False)
    for n in names:
        moved = moved | (F.abs(F.col("delta_" + n)) > 1e-6)
    return out.withColumn("spatial_shift", moved)


ERROR = "array<struct<path:string,message:string>>"


def _err(test: Column, path: Column, message: str) -> Column:
    return F.when(test, F.struct(path.alias("path"), F.lit(message).alias("message")))


def errors(v: Column) -> Column:
    """Faults of a GeoJSON object, given as VARIANT, and of every feature and geometry in it."""
    found = F.transform(members(v), lambda m: _own_errors(m["v"], m["path"]))
    return F.flatten(found)


def _own_errors(v: Column, path: Column) -> Column:
    """Faults of one object, apart from those of the objects in it. One without a known type is not looked into."""
    kind = F.try_variant_get(v, "$.type", "string")
    known = kind.isin([*DEPTH, "GeometryCollection", "Feature", "FeatureCollection"])

    def member(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "variant")

    def at(name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))

    def wrong_object(name: str) -> Column:
        return member(name).isNotNull() & as_map(member(name)).isNull() & (F.schema_of_variant(member(name)) != "VOID")

    box = F.try_variant_get(v, "$.bbox", "array<double>")
    bad_box = box.isNull() | ~F.size(box).isin(4, 6) | F.exists(box, lambda x: x.isNull())
    own = F.array_compact(
        F.array(
            _err(member("bbox").isNotNull() & bad_box, at("bbox"), "bbox is not 4 or 6 numbers"),
            _err((kind == "Feature") & wrong_object("properties"), at("properties"), "properties are not an object"),
            _err((kind == "Feature") & wrong_object("geometry"), at("geometry"), "geometry is not an object"),
            _err((kind == "GeometryCollection") & as_array(member("geometries")).isNull(), at("geometries"), "geometries are not an array"),
            _err((kind == "FeatureCollection") & as_array(member("features")).isNull(), at("features"), "features are not an array"),
        )
    ).cast(ERROR)
    nameless = F.array(_err(F.lit(True), path, "type is missing")).cast(ERROR)
    unknown = F.array(_err(F.lit(True), at("type"), "unknown type")).cast(ERROR)
    return F.when(kind.isNull(), nameless).when(~known, unknown).otherwise(F.concat(own, _shape_errors(v, path)))


def _shape_errors(g: Column, path: Column) -> Column:
    kind = F.try_variant_get(g, "$.type", "string")
    at = F.concat(path, F.lit(".coordinates"))

    def index(p: Column, i: Column) -> Column:
        return F.concat(p, F.lit("["), i.cast("string"), F.lit("]"))

    def position(p: Column, where: Column) -> Column:
        return F.array_compact(
            F.array(
                _err(p.isNull(), where, "not an array"),
                _err(~F.size(p).isin(2, 3), where, "a position has 2 or 3 numbers"),
                _err(F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull(), where, "coordinates are not numbers"),
                _err(F.abs(F.get(p, F.lit(0))) > 180, index(where, F.lit(0)), "longitude outside -180..180"),
                _err(F.abs(F.get(p, F.lit(1))) > 90, index(where, F.lit(1)), "latitude outside -90..90"),
            )
        ).cast(ERROR)

    def deep(xs: Column, where: Column, depth: int) -> Column:
        if depth == 1:
            return position(xs, where)
        inner = F.flatten(F.transform(xs, lambda x, i: deep(x, index(where, i), depth - 1)))
        missing = F.array(_err(F.lit(True), where, "not an array")).cast(ERROR)
        return F.when(xs.isNull(), missing).otherwise(inner)

    def ring_errors(rings: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
            is_open = (first[0] != last[0]) | (first[1] != last[1])
            return F.array_compact(
                F.array(
                    _err(F.size(r) < 4, index(at, i), "a ring has at least 4 positions"),
                    _err((F.size(r) >= 4) & is_open, index(at, i), "ring is not closed"),
                )
            ).cast(ERROR)

        return F.flatten(F.transform(rings, one))

    types = {1: "array<double>", 2: "array<array<double>>", 3: "array<array<array<double>>>", 4: COORDS}
    out = F.when(F.lit(False), F.array().cast(ERROR))
    for depth, array_type in types.items():
        coords = F.try_variant_get(g, "$.coordinates", array_type)
        names = [k for k, d in DEPTH.items() if d == depth]
        found = deep(coords, at, depth)
        if depth == 3:
            rings = F.when(kind == "Polygon", ring_errors(coords))
            found = F.concat(found, F.coalesce(rings, F.array().cast(ERROR)))
        out = out.when(kind.isin(names), found)
    return F.coalesce(out, F.array().cast(ERROR))
