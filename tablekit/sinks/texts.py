"""Rows as text: CSV, JSON, XML, YAML, Markdown, HTML, SQL, plain text, KML.

Every exporter gives a ``text`` column (one row of the table, one or more lines
of the file) that is written by all tasks at once. What stands before and after
the rows is a head and a foot; :func:`write_framed` writes them around the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import NUMBER_CELL, col, is_number_type, strip, text
from tablekit.functions.fx import ENTITIES, xml_escape
from tablekit.operators import geo
from tablekit.operators.rows import ROW


def _names(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols else [c for c in df.columns if c != ROW]


def write_lines(df: DataFrame, path: str, name: str = "text") -> None:
    df.select(col(name)).write.mode("overwrite").text(path)


def write_framed(df: DataFrame, path: str, head: str, foot: str, order: Sequence[str] = ()) -> None:
    """Write head, rows and foot as files whose names sort in that order.

    With ``order`` the rows are range-sorted first, so that the files joined in
    name order are the whole export in row order.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    for part, frame in (
        ("1-head", spark.createDataFrame([(head,)], "text string").coalesce(1)),
        ("2-rows", rows.select("text")),
        ("3-foot", spark.createDataFrame([(foot,)], "text string").coalesce(1)),
    ):
        frame.write.mode("overwrite").text(f"{path}/{part}")


# --- CSV --------------------------------------------------------------------


def csv_field(c: Column, policy: str, delimiter: str = ",", quote: str = '"', escape: str = '"') -> Column:
    """One cell under a quote policy: minimal, all, nonnumeric or none."""
    s = text(c)
    quoted = F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(escape + quote)), F.lit(quote))
    if policy == "none":
        return s
    if policy == "all":
        return quoted
    special = reduce(lambda a, b: a | b, [s.contains(x) for x in (delimiter, quote, "\n", "\r")])
    if policy == "nonnumeric":
        special = special | ~strip(s).rlike(NUMBER_CELL)
    return F.when(special, quoted).otherwise(s)


def csv_lines(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    policy: str = "minimal",
    delimiter: str = ",",
    quote: str = '"',
    escape: str = '"',
    null_value: str = "",
    formatters: Mapping[str, Column] | None = None,
) -> DataFrame:
    """CSV text per row; ``formatters`` replace single columns by expressions."""
    formats = formatters or {}
    fields = [
        F.coalesce(csv_field(formats.get(c, col(c)), policy, delimiter, quote, escape), F.lit(null_value))
        for c in _names(df, cols)
    ]
    return df.select("*", F.concat_ws(delimiter, *fields).alias("text"))


def csv_header(names: Sequence[str], delimiter: str = ",", quote: str = '"') -> str:
    def one(n: str) -> str:
        return quote + n.replace(quote, quote * 2) + quote if any(x in n for x in (delimiter, quote, "\n", "\r")) else n

    return delimiter.join(one(n) for n in names)


def write_csv(
    df: DataFrame,
    path: str,
    cols: Sequence[str] | None = None,
    policy: str = "minimal",
    delimiter: str = ",",
    null_value: str = "",
    line_sep: str = "\n",
    formatters: Mapping[str, Column] | None = None,
) -> None:
    """Write CSV files, each with a header, in the built-in writer where it can quote as asked."""
    names = _names(df, cols)
    if policy in ("minimal", "all"):
        data = df.select(*[(formatters or {}).get(c, col(c)).alias(c) for c in names])
        data.write.mode("overwrite").csv(
            path, header=True, sep=delimiter, quoteAll=policy == "all", nullValue=null_value, emptyValue="",
            lineSep=line_sep, escape='"',
        )
    else:
        lines = csv_lines(df, names, policy, delimiter, null_value=null_value, formatters=formatters)
        lines.select("text").write.mode("overwrite").option("lineSep", line_sep).text(path)


# --- JSON -------------------------------------------------------------------


def json_lines(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row, nulls written out."""
    data = F.struct(*[col(c) for c in _names(df, cols)])
    return df.select("*", F.to_json(data, {"ignoreNullFields": "false"}).alias("text"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def json_to_csv(records: DataFrame, path: str, json: str, keep: Sequence[str] = ()) -> None:
    """JSON objects as CSV with the union of their keys as header; nested values as JSON text."""
    from tablekit.operators.jsondoc import to_table

    write_csv(to_table(records, json, list(keep)), path)


# --- XML --------------------------------------------------------------------


def tag_name(name: str) -> str:
    """A name with every character that a tag may not hold replaced."""
    import re

    return re.sub(r"[^a-zA-Z0-9_-]", "_", name)


def xml_rows(df: DataFrame, row_tag: str = "row", cols: Sequence[str] | None = None) -> DataFrame:
    """One element per row, one child element per column, five entities escaped."""
    cells = [
        F.concat(
            F.lit(f"    <{tag_name(c)}>"), xml_escape(F.coalesce(text(col(c)), F.lit(""))), F.lit(f"</{tag_name(c)}>")
        )
        for c in _names(df, cols)
    ]
    body = F.concat_ws("\n", F.lit(f"  <{row_tag}>"), *cells, F.lit(f"  </{row_tag}>"))
    return df.select("*", body.alias("text"))


def write_xml(df: DataFrame, path: str, root_tag: str = "dataset", row_tag: str = "row") -> None:
    """Write XML files with the built-in writer; nested columns become nested elements."""
    named = df.drop(ROW).toDF(*[tag_name(c) for c in df.columns if c != ROW])
    named.write.format("xml").options(rootTag=root_tag, rowTag=row_tag, attributePrefix="@", valueTag="#text").mode(
        "overwrite"
    ).save(path)


def xml_of(c: Column, row_tag: str = "root") -> Column:
    """XML text of a struct: ``@`` members are attributes, ``#text`` is text, arrays repeat the tag."""
    return F.to_xml(c, {"attributePrefix": "@", "valueTag": "#text", "rowTag": row_tag})


# --- other forms ------------------------------------------------------------


def yaml_items(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A list item per row; texts with ``:`` or ``#`` are quoted."""
    cells = []
    for i, c in enumerate(_names(df, cols)):
        s = text(col(c))
        value = s
        if isinstance(df.schema[c].dataType, T.StringType):
            value = F.when(s.contains(":") | s.contains("#"), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
        cells.append(F.concat(F.lit(f"{'- ' if i == 0 else '  '}{c}: "), F.coalesce(value, F.lit("null"))))
    return df.select("*", F.concat_ws("\n", *cells).alias("text"))


def column_widths(df: DataFrame, names: Sequence[str], least: int = 3) -> dict[str, int]:
    """Longest text per column, header included; one aggregate row."""
    r = df.agg(*[F.max(F.length(text(col(c)))).alias(f"w{i}") for i, c in enumerate(names)]).first()
    return {c: max(r[f"w{i}"] or 0, len(c), least) for i, c in enumerate(names)}


def _padded(c: Column, width: int, align: str) -> Column:
    s = F.coalesce(text(c), F.lit(""))
    if align == "right":
        return F.lpad(s, width, " ")
    if align == "center":
        left = F.floor((F.lit(width) - F.length(s)) / 2).cast("int")
        return F.rpad(F.concat(F.repeat(F.lit(" "), left), s), width, " ")
    return F.rpad(s, width, " ")


def markdown_rows(
    df: DataFrame, cols: Sequence[str] | None = None, align: Mapping[str, str] | None = None
) -> tuple[DataFrame, str]:
    """Aligned table rows as ``text``, and the two head lines."""
    names, align = _names(df, cols), align or {}
    widths = column_widths(df, names)
    cells = [_padded(col(c), widths[c], align.get(c, "left")) for c in names]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def rule(c: str) -> str:
        w, a = widths[c], align.get(c, "left")
        return ":" + "-" * (w - 2) + ":" if a == "center" else "-" * (w - 1) + ":" if a == "right" else "-" * w

    head = "| " + " | ".join(c.ljust(widths[c]) for c in names) + " |"
    return df.select("*", body.alias("text")), head + "\n| " + " | ".join(rule(c) for c in names) + " |"


def plain_rows(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """Fixed-width rows as ``text``, numbers to the right, and the head line."""
    names = _names(df, cols)
    widths = column_widths(df, names, 1)
    side = {c: "right" if is_number_type(df.schema[c].dataType) else "left" for c in names}
    body = F.concat_ws("  ", *[_padded(col(c), widths[c], side[c]) for c in names])
    head = "  ".join(c.rjust(widths[c]) if side[c] == "right" else c.ljust(widths[c]) for c in names)
    return df.select("*", body.alias("text")), head


# What HTML text may not hold.
HTML = (*ENTITIES[:4], ("'", "&#39;"))


def html_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cells = [
        F.concat(F.lit("<td>"), xml_escape(F.coalesce(text(col(c)), F.lit("")), HTML), F.lit("</td>"))
        for c in _names(df, cols)
    ]
    return df.select("*", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("text"))


def html_frame(names: Sequence[str], css_class: str | None = None) -> tuple[str, str]:
    import html

    cls = f' class="{css_class}"' if css_class else ""
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<table{cls}>\n<thead><tr>{head}</tr></thead>\n<tbody>", "</tbody>\n</table>"


def sql_literal(c: Column, t: T.DataType, flavour: str = "postgresql") -> Column:
    if is_number_type(t):
        out = text(c)
    elif isinstance(t, T.BooleanType):
        out = F.when(c, "1").otherwise("0") if flavour == "sqlite" else F.upper(text(c))
    else:
        s = F.replace(text(c), F.lit("'"), F.lit("''"))
        if flavour == "mysql":
            s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        out = F.concat(F.lit("'"), s, F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(out)


def sql_inserts(df: DataFrame, table: str, flavour: str = "postgresql", cols: Sequence[str] | None = None) -> DataFrame:
    """One INSERT statement per row, for mysql, postgresql or sqlite."""
    mark = "`" if flavour == "mysql" else '"'
    names = _names(df, cols)
    listed = ", ".join(mark + c.replace(mark, mark * 2) + mark for c in names)
    values = F.concat_ws(", ", *[sql_literal(col(c), df.schema[c].dataType, flavour) for c in names])
    head = f"INSERT INTO {mark}{table}{mark} ({listed}) VALUES ("
    return df.select("*", F.concat(F.lit(head), values, F.lit(");")).alias("text"))


# --- features ---------------------------------------------------------------


def feature_rows(df: DataFrame, keys: Sequence[str], g: str = "geometry", props: str = "properties") -> DataFrame:
    """Features as a table: latitude and longitude of points, geometry type, properties."""
    first = F.get(geo.positions(col(g)), F.lit(0))
    is_point = col(g)["type"] == "Point"
    return df.select(
        F.when(is_point, first[1]).alias("latitude"),
        F.when(is_point, first[0]).alias("longitude"),
        F.coalesce(col(g)["type"], F.lit("")).alias("geometry_type"),
        *[F.try_element_at(col(props), F.lit(k)).alias(k) for k in keys],
    )


def kml_placemarks(df: DataFrame, g: str = "geometry", props: str = "properties") -> DataFrame:
    """One Placemark per feature with a geometry; polygons show their outer ring."""
    shape = F.get(col(g)["parts"], F.lit(0))
    ring = F.get(F.get(shape["coords"], F.lit(0)), F.lit(0))
    coords = F.array_join(
        F.transform(ring, lambda p: F.concat_ws(",", geo.number_text(p[0]), geo.number_text(p[1]))), " "
    )
    kind = col(g)["type"]
    body = (
        F.when(kind == "Point", F.concat(F.lit("<Point><coordinates>"), coords, F.lit("</coordinates></Point>")))
        .when(kind == "LineString", F.concat(F.lit("<LineString><coordinates>"), coords, F.lit("</coordinates></LineString>")))
        .when(
            kind == "Polygon",
            F.concat(
                F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), coords,
                F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"),
            ),
        )
        .otherwise("")
    )

    def prop(k: str) -> Column:
        return F.nullif(F.try_element_at(col(props), F.lit(k)), F.lit(""))

    name = F.coalesce(prop("name"), prop("title"), F.lit("Feature"))
    mark = F.concat(F.lit("<Placemark><name>"), xml_escape(name), F.lit("</name>"), body, F.lit("</Placemark>"))
    return df.filter(col(g).isNotNull()).select("*", mark.alias("text"))


def kml_frame(name: str = "Export") -> tuple[str, str]:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    return f"{head}<name>{name}</name>", "</Document></kml>"


# --- sheets -----------------------------------------------------------------


def write_sheets(cells: DataFrame, path: str, form: str = "json") -> None:
    """Records of every sheet in a folder of its own, as JSON, CSV or XML lines.

    In the CSV form a sheet's header line lies in the folder ``part=0``, its
    rows in ``part=1``, so that files in name order are the whole sheet.
    """
    from tablekit.operators.grid import records

    recs = records(cells)
    if form == "json":
        line = F.to_json("record", {"ignoreNullFields": "false"})
    elif form == "csv":
        def joined(cells: Column) -> Column:
            return F.array_join(F.transform(cells, lambda v: F.coalesce(csv_field(v, "minimal"), F.lit(""))), ",")

        heads = recs.groupBy("workbook", "sheet").agg(F.min_by(joined(F.map_keys("record")), "row").alias("value"))
        lines = recs.select("workbook", "sheet", F.lit(1).alias("part"), joined(F.map_values("record")).alias("value"))
        lines = heads.select("workbook", "sheet", F.lit(0).alias("part"), "value").unionByName(lines)
        lines.write.mode("overwrite").partitionBy("workbook", "sheet", "part").text(path)
        return
    elif form == "xml":
        item = F.transform(
            F.map_entries("record"),
            lambda e: F.concat(
                F.lit("<"), F.regexp_replace(e["key"], "[^a-zA-Z0-9_-]", "_"), F.lit(">"),
                xml_escape(F.coalesce(e["value"], F.lit(""))), F.lit("</"),
                F.regexp_replace(e["key"], "[^a-zA-Z0-9_-]", "_"), F.lit(">"),
            ),
        )
        line = F.concat(F.lit("<row>"), F.array_join(item, ""), F.lit("</row>"))
    else:
        raise ValueError(f"unknown form {form}")
    recs.select("workbook", "sheet", line.alias("value")).write.mode("overwrite").partitionBy("workbook", "sheet").text(path)
