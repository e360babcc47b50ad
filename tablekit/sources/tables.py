"""Sources of tables: CSV, JSON lines, XML rows, Markdown tables, in-memory rows."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.coerce import NUMBER_CELL, col, strip
from tablekit.operators.clean import unique_headers
from tablekit.operators.profile import GZIP_SHARE
from tablekit.operators.rows import ROW, running_total, with_row
from tablekit.sources.lines import ORDER, pieces, without_bom


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    quote: str = '"',
    escape: str = '"',
    comment: str | None = "#",
    trim: bool | str = False,
    has_header: bool = True,
    transform_header: Callable[[str], str] | None = None,
    multi_line: bool = True,
    lenient: bool = True,
    numbered_blanks: bool = False,
) -> DataFrame:
    """All-text columns and ``_row``; short rows get nulls, long rows are cut.

    Blank headers become ``column``, or ``col_N`` with ``numbered_blanks``, and
    repeats get a number. Each file has its
    own header: files are read by groups of equal ones, and a column that a file
    lacks is null there. Files without line breaks inside cells should be read
    with ``multi_line=False``, which lets one large file be split over tasks.
    """
    sides = {True: "both", False: "none"}.get(trim, trim)
    options: dict[str, Any] = {
        "sep": delimiter,
        "quote": quote,
        "escape": escape,
        "multiLine": multi_line,
        "ignoreLeadingWhiteSpace": sides in ("both", "left"),
        "ignoreTrailingWhiteSpace": sides in ("both", "right"),
        "mode": "PERMISSIVE" if lenient else "FAILFAST",
        "encoding": "UTF-8",
    }
    if comment:
        options["comment"] = comment
    tables = [
        _one_header(spark, files, options, has_header, transform_header, numbered_blanks)
        for files in (_files_by_header(spark, path, comment) if has_header else [path])
    ]
    tables = [t for t in tables if t is not None]
    if not tables:
        return with_row(spark.createDataFrame([], "column string"))
    return with_row(functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables))


def _files_by_header(spark: SparkSession, path: str, comment: str | None) -> list[str | list[str]]:
    """The files of ``path`` in groups whose first line is the same, by the first file's name.

    Only several files are looked into. What comes back are file names, which
    the driver lists anyway.
    """
    if len(spark.read.text(path).inputFiles()) < 2:
        return [path]
    lines = without_bom(pieces(spark, path)).filter(strip(F.col("value")) != "")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    heads = lines.groupBy("file").agg(F.min_by(F.rtrim("value"), F.struct("block", "_seq")).alias("head"))
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if len(groups) < 2:
        return [path]
    return [[unquote(f) for f in r["files"]] for r in sorted(groups, key=lambda r: r["files"])]


def _one_header(
    spark: SparkSession, path: str | list[str], options: Mapping[str, Any], has_header: bool, transform: Callable[[str], str] | None,
    numbered_blanks: bool,
) -> DataFrame | None:
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        return None
    names = ["" if v is None else str(v) for v in first[0]]
    names[0] = names[0].removeprefix("﻿")
    if has_header:
        names = [transform(n) if transform else n.strip() for n in names]
        names = unique_headers([n or f"col_{i + 1}" for i, n in enumerate(names)] if numbered_blanks else names)
    else:
        names = [f"col_{i + 1}" for i in range(len(names))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(**options).schema(schema).csv(path, header=has_header, enforceSchema=True)


def typed_cell(c: Column) -> Column:
    """A cell as VARIANT: null, boolean or number where the text is one, otherwise the text."""
    number = F.when(c.rlike(NUMBER_CELL), F.try_parse_json(F.regexp_replace(c, r"^(-?)0+(?=\d)", "$1")))
    return (
        F.when(c.isin("null", "NULL"), F.parse_json(F.lit("null")))
        .when(c.isin("true", "TRUE"), F.parse_json(F.lit("true")))
        .when(c.isin("false", "FALSE"), F.parse_json(F.lit("false")))
        .when(number.isNotNull(), number)
        .otherwise(F.parse_json(_quoted(c)))
    )


def _quoted(c: Column) -> Column:
    """The JSON text of a string."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def typed_columns(df: DataFrame, row: str = ROW) -> DataFrame:
    """Cast each text column to the narrowest type all its filled cells fit.

    boolean, bigint, double or text; one aggregate row decides for all columns.
    ``null`` and ``NULL`` cells become nulls.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != row]
    tests = []
    for i, n in enumerate(names):
        c = strip(col(n))
        some = (c != "") & ~c.isin("null", "NULL")
        tests += [
            F.count_if(some).alias(f"n{i}"),
            F.count_if(some & c.isin("true", "TRUE", "false", "FALSE")).alias(f"b{i}"),
            F.count_if(some & c.rlike(r"^-?\d{1,18}$")).alias(f"i{i}"),
            F.count_if(some & c.rlike(NUMBER_CELL)).alias(f"d{i}"),
        ]
    if not tests:
        return df
    r = df.agg(*tests).first()
    casts = {}
    for i, n in enumerate(names):
        c = strip(col(n))
        clean = F.when(~c.isin("null", "NULL"), c)
        total = r[f"n{i}"]
        if total and r[f"b{i}"] == total:
            casts[n] = F.lower(clean).try_cast("boolean")
        elif total and r[f"i{i}"] == total:
            casts[n] = clean.try_cast("bigint")
        elif total and r[f"d{i}"] == total:
            casts[n] = clean.try_cast("double")
        else:
            casts[n] = F.when(~col(n).isin("null", "NULL"), col(n))
    return df.withColumns(casts)


def read_records(spark: SparkSession, path: str, has_header: bool = True, **options) -> DataFrame:
    """Second CSV reading: blank headers become ``col_N``, no comments, cells typed."""
    return typed_columns(
        read_csv(spark, path, comment=None, trim=True, has_header=has_header, numbered_blanks=True, **options)
    )


# --- delimiter and structure ------------------------------------------------

# Candidate delimiters in order of preference, lines looked at,
# and the weight of a delimiter that occurs equally often on every line.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 15
CONSISTENT = 2.5


def count_outside_quotes(line: Column, mark: str, quote: str = '"') -> Column:
    bare = F.regexp_replace(line, f"{re.escape(quote)}[^{re.escape(quote)}]*({re.escape(quote)}|$)", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """The likeliest delimiter per file: ``file, delimiter``."""
    # Planned with a per-task limit of lines per file ahead of the shuffle.
    w = Window.partitionBy("file").orderBy("block", "_seq")
    top = lines.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= SNIFF_LINES)
    used = top.filter((strip(F.col("value")) != "") & ~F.col("value").startswith("#"))
    counts = used.select(
        "file",
        "_rn",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), count_outside_quotes(F.col("value"), d).alias("n"))
                    for i, d in enumerate(DELIMITERS)
                ]
            )
        ),
    )
    scores = counts.groupBy("file", "i", "d").agg(
        F.sum("n").alias("total"), F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    even = (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)
    score = F.col("total") * F.when(even, CONSISTENT).otherwise(1.0)
    best = scores.groupBy("file").agg(
        F.max(F.when(F.col("total") > 0, F.struct(score.alias("s"), (-F.col("i")).alias("o"), F.col("d")))).alias("b")
    )
    files = lines.select("file").distinct()
    return files.join(best, "file", "left").select("file", F.coalesce("b.d", F.lit(",")).alias("delimiter"))


def file_overview(spark: SparkSession, path: str) -> DataFrame:
    """Lines, columns, delimiter, line terminator, bytes and expected compressed bytes per file."""
    lines = without_bom(pieces(spark, path))
    facts = lines.groupBy("file").agg(
        F.count_if(strip(F.col("value")) != "").alias("rows"),
        F.max("file_size").alias("bytes"),
        F.max(F.col("value").endswith("\r")).alias("_cr"),
        F.min_by("value", F.struct("block", "_seq")).alias("_head"),
    )
    fields = F.lit(None).cast("int")
    for d in DELIMITERS:
        fields = F.when(F.col("delimiter") == d, count_outside_quotes(F.col("_head"), d) + 1).otherwise(fields)
    return facts.join(detect_delimiter(lines), "file").select(
        "file",
        "rows",
        fields.alias("columns"),
        "delimiter",
        F.when(F.col("_cr"), "CRLF").otherwise("LF").alias("line_terminator"),
        "bytes",
        F.floor(F.col("bytes") * GZIP_SHARE + 0.5).alias("gzip_bytes"),
    )


def csv_errors(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """Structure faults per file: ``file, line, col, message, snippet``.

    Empty input, a quote that is never closed, rows with another number of
    columns than the first. Whether a line starts inside quotes follows from
    the number of quotes before it, a running total, so a large file is checked
    in pieces like any other table.
    """
    lines = without_bom(pieces(spark, path)).withColumn("value", F.regexp_replace("value", "\r$", ""))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    numbered = running_total(
        lines.withColumn("_q", quotes), ORDER, {"_before": F.col("_q"), "_line": F.lit(1)}
    )
    bounds = numbered.groupBy("file").agg(
        F.min("_before").alias("_b0"), F.min("_line").alias("_l0"), F.sum("_q").alias("_quotes"),
        F.max(strip(F.col("value")) != "").alias("_some"),
    )
    placed = numbered.join(bounds, "file").withColumns(
        {
            "line": F.col("_line") - F.col("_l0") + 1,
            "_inside": (F.col("_before") - F.col("_b0")) % 2 == 1,
        }
    )
    nothing = bounds.filter(~F.col("_some")).select(
        "file", F.lit(1).cast("bigint").alias("line"), F.lit(1).alias("col"),
        F.lit("file is empty").alias("message"), F.lit("").alias("snippet"),
    )
    # The field that stays open begins on the last line that goes from outside to inside.
    opens = ~F.col("_inside") & (F.col("_q") % 2 == 1)
    opener = (
        placed.filter((F.col("_quotes") % 2 == 1) & opens)
        .groupBy("file")
        .agg(F.max(F.struct("line", "value")).alias("o"))
        .select(
            "file", F.col("o.line").alias("line"), _open_quote(F.col("o.value"), quote).alias("col"),
            F.lit("quoted field is never closed").alias("message"), F.col("o.value").alias("snippet"),
        )
    )
    ends_open = F.col("_inside") != (F.col("_q") % 2 == 1)
    text = F.when(F.col("_inside"), F.concat(F.lit(quote), "value")).otherwise(F.col("value"))
    fields = placed.withColumns({"_d": count_outside_quotes(text, delimiter, quote), "_end": F.when(ends_open, 0).otherwise(1)})
    kept = fields.filter(F.col("_inside") | ((strip(F.col("value")) != "") & ~F.col("value").startswith("#")))
    records = running_total(
        kept.select("file", "line", "_d", "_end"), ["file", "line"], F.col("_end"), "_record"
    )
    sizes = records.groupBy("file", "_record").agg((F.sum("_d") + 1).alias("n"), F.min("line").alias("line"))
    heads = sizes.groupBy("file").agg(F.min_by("n", "_record").alias("want"))
    wrong = sizes.join(heads, "file").filter(F.col("n") != F.col("want")).select(
        "file", "line", F.lit(None).cast("int").alias("col"),
        F.concat(F.lit("row has "), F.col("n").cast("string"), F.lit(" columns, the first has "), F.col("want").cast("string")).alias("message"),
        F.lit(None).cast("string").alias("snippet"),
    )
    return nothing.unionByName(opener).unionByName(wrong)


def _open_quote(line: Column, quote: str) -> Column:
    """Place of the quote that opens the last field of a line that ends inside quotes."""
    chars = F.split(line, "")
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"))
    # A quote opens a field when none is open, and closes it otherwise.
    return F.aggregate(
        chars,
        state,
        lambda s, c: F.struct(
            F.when(c != quote, s["at"]).when(s["at"] > 0, 0).otherwise(s["i"] + 1).alias("at"), (s["i"] + 1).alias("i")
        ),
        lambda s: s["at"],
    )


# --- other tables -----------------------------------------------------------


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Markdown tables as columns, named by the first table row."""
    lines = pieces(spark, path).filter(strip(F.col("value")).startswith("|"))
    rows = lines.filter(~strip(F.col("value")).rlike(r"^\|\s*:?-+:?\s*\|"))
    raw = F.split(strip(F.col("value")), r"\|")
    cells = F.transform(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 2, F.lit(0))), lambda c: F.trim(c))
    table = rows.select(*ORDER, cells.alias("cells"))
    # One row: the header of the result.
    head = table.orderBy(*ORDER).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "column string")
    firsts = table.groupBy("file").agg(F.min(F.struct("block", "_seq")).alias("_first"))
    body = table.join(firsts, "file").filter(F.struct("block", "_seq") != F.col("_first"))
    names = unique_headers(head[0]["cells"])
    return body.select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], F.col("_seq").alias(ROW)
    )


def read_ndjson(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One VARIANT ``v`` per non-blank line; with ``strict`` a bad line is fatal."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parse = F.parse_json if strict else F.try_parse_json
    return with_row(lines.select(parse("value").alias("v")))


# Readings that strict JSON forbids: comments, other quotes, bare keys and odd numbers.
LENIENT = {
    "allowComments": "true",
    "allowSingleQuotes": "true",
    "allowUnquotedFieldNames": "true",
    "allowNonNumericNumbers": "true",
    "allowNumericLeadingZeros": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}


def parse_lenient(c: Column, schema: str | T.DataType) -> Column:
    """A JSON text of known shape, read strictly first and mended only if that fails."""
    from tablekit.operators.jsonedit import repair

    mended = F.when(F.try_parse_json(c).isNull(), repair(c)).otherwise(c)
    return F.from_json(mended, schema, LENIENT)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str = "row", schema: str | None = None) -> DataFrame:
    """Repeated elements as rows; the reader splits large files at row tags."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "#text")
    if schema:
        reader = reader.schema(schema)
    return with_row(reader.load(path))


def from_rows(
    spark: SparkSession, header: Sequence[str], rows: Sequence[Sequence[Any]], schema: str | None = None
) -> DataFrame:
    """A table from a header and rows; cells are text unless a schema is given."""
    names = unique_headers(list(header))
    if schema:
        return with_row(spark.createDataFrame([tuple(r) for r in rows], schema))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    data = [tuple(None if v is None else str(v) for v in (list(r) + [None] * len(names))[: len(names)]) for r in rows]
    return with_row(spark.createDataFrame(data, fields))


def from_records(spark: SparkSession, records: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A table from mappings; the columns are the union of the keys, first seen first."""
    names = list(dict.fromkeys(k for r in records for k in r))
    return from_rows(spark, names, [[r.get(n) for n in names] for r in records])
