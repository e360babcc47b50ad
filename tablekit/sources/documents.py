"""Sources of documents: YAML, GeoJSON, spreadsheets."""

from __future__ import annotations

import datetime
import functools
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.coerce import strip
from tablekit.operators import geo
from tablekit.operators.rows import running_total
from tablekit.sources.lines import ORDER, pieces, without_bom

# --- YAML -------------------------------------------------------------------


YAML = "tag:yaml.org,2002:"
# Texts up to this length have their tags remembered, this many at a time.
TAG_CHARS, TAG_MEMO = 40, 1 << 15


def remembered_tags(base: type) -> Callable[..., str]:
    """The ``resolve`` of a YAML loader or dumper that looks at a short plain text once."""
    whole = base.resolve

    @functools.lru_cache(TAG_MEMO)
    def known(kind: Any, value: str, implicit: tuple) -> str:
        return whole(base, kind, value, implicit)

    def resolve(self: Any, kind: Any, value: Any, implicit: Any) -> str:
        if type(value) is str and type(implicit) is tuple and len(value) <= TAG_CHARS:
            return known(kind, value, implicit)
        return whole(self, kind, value, implicit)

    return resolve


def yaml_to_json(c: Column) -> Column:
    """JSON text of a YAML text; null where it is no YAML.

    Dates stay text and numbers that JSON lacks become null.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import yaml

        base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        class Loader(base):
            pass

        Loader.yaml_implicit_resolvers = {
            first: [(tag, pattern) for tag, pattern in found if tag != "tag:yaml.org,2002:timestamp"]
            for first, found in base.yaml_implicit_resolvers.items()
        }

        Loader.resolve = remembered_tags(Loader)

        def plain(v: Any) -> Any:
            if isinstance(v, dict):
                return {_key(k): plain(x) for k, x in v.items()}
            if isinstance(v, (list, tuple, set)):
                return [plain(x) for x in v]
            if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
                return None
            return v if v is None or isinstance(v, (str, int, float, bool)) else str(v)

        def direct(loader: Any, node: Any) -> Any:
            """The plain value of a node of the usual tags with text keys; LookupError for others."""
            tag = node.tag
            if tag == YAML + "str" and isinstance(node, yaml.ScalarNode):
                return node.value
            if tag == YAML + "map" and isinstance(node, yaml.MappingNode):
                out = {}
                for k, v in node.value:
                    if k.tag != YAML + "str" or not isinstance(k, yaml.ScalarNode):
                        raise LookupError(k.tag)
                    out[k.value] = direct(loader, v)
                return out
            if tag == YAML + "seq" and isinstance(node, yaml.SequenceNode):
                return [direct(loader, v) for v in node.value]
            name = tag.removeprefix(YAML)
            if name not in ("int", "float", "bool", "null") or not isinstance(node, yaml.ScalarNode):
                raise LookupError(tag)
            return plain(getattr(loader, "construct_yaml_" + name)(node))

        def loaded(text: str) -> Any:
            loader = Loader(text)
            try:
                node = loader.get_single_node()
                if node is None:
                    return None
                try:
                    return direct(loader, node)
                except (LookupError, RecursionError):
                    return plain(loader.construct_document(node))
            finally:
                loader.dispose()

        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(loaded(text), ensure_ascii=False, separators=(",", ":"))
            except (yaml.YAMLError, ValueError):
                return None

        return texts.map(one)

    # Not to be run again where a later filter looks at the result.
    return run.asNondeterministic()(c)


def _key(k: Any) -> str:
    return {True: "true", False: "false", None: "null"}[k] if k is None or isinstance(k, bool) else str(k)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """One row per YAML document: ``file, json, v``; files are cut at document marks."""
    chunks = without_bom(pieces(spark, path, "\n---"))
    # The line end before a document mark went with the cut.
    text = F.concat(F.regexp_replace("value", r"^---", ""), F.lit("\n"))
    docs = chunks.withColumn("text", text).filter(strip(F.regexp_replace("text", r"(?m)^\s*#.*$", "")) != "")
    out = docs.select("file", "block", "_seq", yaml_to_json(F.col("text")).alias("json"))
    return out.withColumn("v", F.try_parse_json("json"))


# --- GeoJSON ----------------------------------------------------------------


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature, ``index`` counting the features of a document; with ``lines`` each line is a document.

    A file may be of any size: it is read in pieces by several tasks and cut
    into its features by how deep they lie. A file that is no FeatureCollection
    is one feature.
    """
    if lines:
        return geo.features(spark.read.text(path).filter(F.trim("value") != ""), "value")
    return geo.features(_feature_texts(spark, path), "value", ["file", "nth"]).select(
        F.col("nth").cast("int").alias("index"), "geometry", "properties"
    )


def _masked(value: Column, quoted: Column) -> Column:
    """A piece with everything inside quotes as dots, of the same length; ``quoted``: whether it begins inside."""
    plain = F.regexp_replace(value, r"(?s)\\.", "..")
    parts = F.transform(
        F.split(plain, '"'),
        lambda part, i: F.when((i + quoted.cast("int")) % 2 == 0, part).otherwise(F.repeat(F.lit("."), F.length(part))),
    )
    return F.array_join(parts, '"')


def _feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, nth, value``: the text of every feature.

    Pieces begin at braces. What a piece does to the quotes and to the depth is
    known from itself; running totals over the pieces before it tell where it
    begins. At depth one a brace opens a feature if the text since the last
    object is a comma and that was one, or opens the member "features".
    """
    read = without_bom(pieces(spark, path, "{")).withColumn("quotes", F.length(F.regexp_replace("value", r'(?s)\\.|[^"]', "")))
    read = running_total(read, ORDER, {"quotes_before": F.col("quotes"), "nth_piece": F.lit(1)})
    # Totals of the files before; one row per file.
    read = _from_file_start(read, ["quotes_before", "nth_piece"])
    quoted = F.col("quotes_before") % 2 == 1
    opens = (F.col("nth_piece") > 0) & ~quoted
    bare = _masked(F.col("value"), quoted)
    read = read.withColumns({"opens": opens.cast("int"), "bare": bare}).withColumn(
        "closes", F.length("bare") - F.length(F.replace("bare", F.lit("}"), F.lit("")))
    )
    read = _from_file_start(running_total(read, ORDER, F.col("opens") - F.col("closes"), "depth_before"), ["depth_before"])
    depth = F.col("depth_before") + F.col("opens")
    # Up to the brace that leads back to depth one the piece belongs to an object, from there on it leads to the next.
    inside = F.when(depth > 1, F.call_function("substring_index", F.col("bare"), F.lit("}"), (depth - 1).cast("int"))).otherwise("")
    stops = (depth > 1) & (depth - F.col("closes") <= 1)
    cut_at = F.when(stops, F.length(inside) + 1).otherwise(F.when(depth > 1, F.length("value")).otherwise(0))
    brace = F.when(F.col("nth_piece") > 0, "{").otherwise("")
    read = read.withColumns(
        {
            "starts": (F.col("opens") == 1) & (F.col("depth_before") == 1),
            "own": F.when(depth > 1, F.concat(brace, F.left("value", cut_at))),
            "lead": F.when(depth - F.col("closes") == 1, F.substring(F.col("value"), cut_at + 1, F.length("value"))),
        }
    )
    opened = F.col("lead").rlike(r'(?s)"features"\s*:\s*\[\s*$')
    # A lead that is no comma ends the run of objects before it.
    turns = F.col("lead").isNotNull() & (opened | ~F.col("lead").rlike(r"^\s*,\s*$"))
    read = running_total(
        read.withColumns({"turns": turns, "opened": opened & turns}), ORDER,
        {"run": F.col("turns").cast("int"), "nth": F.col("starts").cast("int")},
    )
    # One row per file and member that holds features.
    runs = read.filter("opened").select(
        F.col("file").alias("in_file"), (F.col("run") + 1).alias("in_run"), (F.col("nth") + F.col("starts").cast("int")).alias("first_nth")
    )
    place = F.struct(*ORDER).alias("place")
    parts = read.filter("own is not null").join(runs, (F.col("file") == F.col("in_file")) & (F.col("run") == F.col("in_run")))
    # A piece that starts an object is counted only in those after it.
    number = F.col("nth") - F.col("first_nth") - F.when(F.col("starts"), 0).otherwise(1)
    features = parts.select("file", number.alias("nth"), place, F.col("own").alias("part"))
    # A file without such a member is one feature as a whole.
    others = read.join(runs.select(F.col("in_file").alias("file")).distinct(), "file", "left_anti")
    whole = others.select("file", F.lit(0).cast("bigint").alias("nth"), place, F.concat(brace, "value").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"]), "")
    # What is collected is the text of one feature.
    return features.unionByName(whole).groupBy("file", "nth").agg(joined.alias("value")).filter(F.trim("value") != "")


def _from_file_start(df: DataFrame, totals: list[str]) -> DataFrame:
    """Running totals over all files as totals since the start of the row's file."""
    first = df.groupBy("file").agg(*[F.min_by(t, F.struct(*ORDER)).alias(f"start_{t}") for t in totals])
    rest = df.join(first, "file")
    return rest.withColumns({t: F.col(t) - F.col(f"start_{t}") for t in totals}).drop(*[f"start_{t}" for t in totals])


# --- spreadsheets -----------------------------------------------------------

CELLS = "workbook string, sheet string, row int, col int, value string, vtype string, formula string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Numbers of the built-in date formats.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
# Rows of one sheet that are handed on at a time.
BATCH = 20_000


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbooks, one task per file; rows are streamed, not gathered."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for cell in workbook_cells(name, content):
                    rows.append(cell)
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(cells, CELLS)


def workbook_cells(name: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in root.iter(MAIN + "si")]
        dated = _date_styles(book) if "xl/styles.xml" in parts else set()
        links = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            target = links[sheet.get(REL + "id")].lstrip("/")
            part = target if target.startswith("xl/") else "xl/" + target
            with book.open(part) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag == MAIN + "row":
                        for c in row.iter(MAIN + "c"):
                            yield (name, sheet.get("name"), *_cell(c, shared, dated))
                        row.clear()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))
        for f in root.iter(MAIN + "numFmt")
    }
    styles = root.find(MAIN + "cellXfs")
    out = set()
    for i, xf in enumerate(styles if styles is not None else []):
        number = int(xf.get("numFmtId", "0"))
        if number in DATE_FORMATS or re.search("[ymdhs]", own.get(number, ""), re.I):
            out.add(i)
    return out


def _cell(c: ElementTree.Element, shared: list[str], dated: set[int]) -> tuple:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    raw, formula = c.findtext(MAIN + "v"), c.findtext(MAIN + "f")
    kind = c.get("t", "n")
    if kind == "s" and raw is not None:
        value, vtype = shared[int(raw)], "string"
    elif kind == "inlineStr":
        value, vtype = "".join(t.text or "" for t in c.iter(MAIN + "t")), "string"
    elif kind == "b" and raw is not None:
        value, vtype = ("true" if raw == "1" else "false"), "boolean"
    elif kind == "e":
        value, vtype = raw, "error"
    elif kind == "n" and raw is not None and int(c.get("s", "0")) in dated:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(milliseconds=round(float(raw) * 86400000))
        value, vtype = moment.isoformat(sep=" "), "date"
    else:
        value, vtype = raw, "number" if kind == "n" and raw is not None else "string" if raw is not None else "empty"
    return int(digits), column, value, vtype, formula
