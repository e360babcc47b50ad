"""XML documents in bulk: queries, JSON form, profile, cleaning, diff, edits, checks.

Documents are a text column. Queries run in the built-in XPath functions; what
needs the whole tree of one document (edits, fault places, the JSON form with
its attribute order) is done inside that document's row in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablekit.functions.coerce import col
from tablekit.operators import jsondoc

# --- queries ----------------------------------------------------------------


def xpath_all(c: Column, path: str) -> Column:
    """Texts of all matches as an array."""
    leaf = path if re.search(r"(@[\w:-]+|text\(\))$", path) else path + "/text()"
    return F.xpath(c, F.lit(leaf))


def xpath_first(c: Column, path: str) -> Column:
    return F.xpath_string(c, F.lit(path))


def xpath_count(c: Column, path: str) -> Column:
    return F.xpath_int(c, F.lit(f"count({path})"))


SELECTOR_PART = re.compile(
    r"""(?P<tag>[\w:-]+|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|
        \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*]?=)\s*["']?(?P<value>[^"'\]]*)["']?)?\s*\]""",
    re.X,
)


def css_to_xpath(selector: str) -> str:
    """XPath for tag, ``#id``, ``.class``, attribute tests, descendants, ``>`` and commas."""
    return " | ".join(_one_selector(s.strip()) for s in selector.split(","))


def _one_selector(selector: str) -> str:
    path, axis = "", "//"
    for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", selector):
        if word == ">":
            axis = "/"
            continue
        path += axis + _step(word)
        axis = "//"
    return path


def _step(word: str) -> str:
    tag, tests = "*", []
    for m in SELECTOR_PART.finditer(word):
        if m["tag"]:
            tag = m["tag"]
        elif m["id"]:
            tests.append(f"@id='{m['id']}'")
        elif m["cls"]:
            tests.append(f"contains(concat(' ', normalize-space(@class), ' '), ' {m['cls']} ')")
        else:
            a, v = "@" + m["attr"], m["value"]
            length = f"string-length({a}) - {len(v or '') - 1}"
            tests.append(
                {
                    None: a,
                    "=": f"{a}='{v}'",
                    "^=": f"starts-with({a}, '{v}')",
                    "$=": f"substring({a}, {length})='{v}'",
                    "*=": f"contains({a}, '{v}')",
                }[m["op"]]
            )
    return tag + "".join(f"[{t}]" for t in tests)


def css_all(c: Column, selector: str) -> Column:
    """Texts of all elements a selector matches, selector by selector."""
    return F.concat(*[xpath_all(c, _one_selector(s.strip())) for s in selector.split(",")])


# --- JSON form --------------------------------------------------------------


def _parsed(text: str | None) -> ElementTree.Element | None:
    if text is None:
        return None
    try:
        return ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return None


def _per_document(change: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    return run


def _coerced(text: str) -> Any:
    words = {"true": True, "false": False, "null": None}
    if text in words:
        return words[text]
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?[0-9]+\.[0-9]+", text) else text


def _as_object(e: ElementTree.Element, value: Callable[[str], Any]) -> Any:
    out: dict[str, Any] = {f"@{k}": value(v) for k, v in e.attrib.items()}
    children = list(e)
    if not children:
        text = "".join(e.itertext()).strip()
        if not out:
            return value(text)
        return {**out, "#text": value(text)} if text else out
    for child in children:
        item = _as_object(child, value)
        if child.tag not in out:
            out[child.tag] = item
        elif isinstance(out[child.tag], list):
            out[child.tag].append(item)
        else:
            out[child.tag] = [out[child.tag], item]
    return out


def to_json(c: Column, coerce: bool = True) -> Column:
    """JSON text: ``@`` attributes, ``#text``, repeated tags as arrays, the root tag outermost."""
    value = _coerced if coerce else str

    def one(text: str) -> str | None:
        root = _parsed(text)
        return None if root is None else jsondoc.dumps({root.tag: _as_object(root, value)})

    return _per_document(one)(c)


def to_variant(c: Column) -> Column:
    """VARIANT by the built-in reader, whose types are inferred; the root tag is left out."""
    return F.from_xml(c, "variant", {"attributePrefix": "@", "valueTag": "#text"})


def from_json(c: Column) -> Column:
    """XML text of a JSON object with one member, the root."""

    def one(text: str) -> str | None:
        try:
            doc = json.loads(text)
        except ValueError:
            return None
        if not isinstance(doc, dict) or len(doc) != 1:
            doc = {"root": doc}
        (tag, value), = doc.items()
        return ElementTree.tostring(_as_element(tag, value), encoding="unicode", short_empty_elements=False)

    return _per_document(one)(c)


def _scalar(v: Any) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _as_element(tag: str, value: Any) -> ElementTree.Element:
    e = ElementTree.Element(tag)
    if isinstance(value, dict):
        for k, v in value.items():
            if k.startswith("@"):
                e.set(k[1:], _scalar(v))
            elif k in ("#text", "#cdata"):
                e.text = _scalar(v)
            else:
                for item in v if isinstance(v, list) else [v]:
                    e.append(_as_element(k, item))
    elif isinstance(value, list):
        for item in value:
            e.append(_as_element("item", item))
    else:
        e.text = _scalar(value)
    return e


# --- diff -------------------------------------------------------------------

# Names of the kinds of change.
TAG, TEXT = "TAG_NAME_CHANGED", "TEXT_CHANGED"


def xml_diff(a: DataFrame, b: DataFrame, doc: str, xml: str = "xml", ignore_whitespace: bool = True) -> DataFrame:
    """Changes per document: ``path, type, old, new``; children are matched by position.

    Spark pairs the documents; equal texts are left out before any tree is built.
    """
    pairs = a.select(doc, col(xml).alias("_a")).join(b.select(doc, col(xml).alias("_b")), doc)
    changed = pairs.filter(F.col("_a") != F.col("_b"))
    kind = a.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, x, y in zip(batch[doc], batch["_a"], batch["_b"]):
                old, new = _parsed(x), _parsed(y)
                if old is None or new is None:
                    if (old is None) != (new is None):
                        rows.append((key, "/", "ROOT_MISMATCH", None, None))
                    continue
                rows.extend((key, *c) for c in _element_changes(old, new, f"/{old.tag}", ignore_whitespace))
            yield pd.DataFrame(rows, columns=[doc, "path", "type", "old", "new"], dtype=object)

    return changed.mapInPandas(run, f"`{doc}` {kind}, path string, type string, old string, new string")


def _element_changes(a: ElementTree.Element, b: ElementTree.Element, path: str, ignore_whitespace: bool) -> Iterator[tuple]:
    if a.tag != b.tag:
        yield path, TAG, a.tag, b.tag
        return
    for name in dict.fromkeys([*a.attrib, *b.attrib]):
        old, new = a.get(name), b.get(name)
        if old != new:
            kind = "ATTR_ADDED" if old is None else "ATTR_REMOVED" if new is None else "ATTR_CHANGED"
            yield f"{path}/@{name}", kind, old, new
    if not len(a) and not len(b):
        old, new = a.text or "", b.text or ""
        if (old.strip() != new.strip()) if ignore_whitespace else (old != new):
            yield path, TEXT, old, new
        return
    for i in range(max(len(a), len(b))):
        if i >= len(b):
            yield f"{path}/{a[i].tag}[{i + 1}]", "ELEMENT_REMOVED", a[i].tag, None
        elif i >= len(a):
            yield f"{path}/{b[i].tag}[{i + 1}]", "ELEMENT_ADDED", None, b[i].tag
        else:
            yield from _element_changes(a[i], b[i], f"{path}/{a[i].tag}[{i + 1}]", ignore_whitespace)


# --- profile ----------------------------------------------------------------

# Marks of a document, in the order they are looked for.
TOKEN = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|</[^>]*>|<[^>]*>|[^<]+"
# Fixed value: nesting beyond this is reported.
DEEP = 20


def tokens(df: DataFrame, doc: str, xml: str = "xml") -> DataFrame:
    """Marks and texts of each document with their nesting depth: ``doc, i, token, kind, tag, depth``."""
    found = F.regexp_extract_all(col(xml), F.lit("(?s)" + TOKEN), F.lit(0))
    step = lambda s: (
        F.when(s.startswith("<!") | s.startswith("<?") | ~s.startswith("<") | s.endswith("/>"), 0)
        .when(s.startswith("</"), -1)
        .otherwise(1)
    )
    kind = lambda s: (
        F.when(s.startswith("<!--"), "comment")
        .when(s.startswith("<![CDATA["), "cdata")
        .when(s.startswith("<?") | s.startswith("<!"), "declaration")
        .when(s.startswith("</"), "end")
        .when(s.startswith("<"), "element")
        .when(F.trim(s, F.lit(" \t\r\n")) != "", "text")
        .otherwise("space")
    )
    marks = df.select(doc, F.posexplode(found).alias("i", "token"))
    # What is summed is one document, which came from one cell.
    before = Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(step(F.col("token"))).over(before), F.lit(0))
    return marks.select(
        doc,
        "i",
        "token",
        kind(F.col("token")).alias("kind"),
        F.regexp_extract("token", r"^</?([^\s/>]+)", 1).alias("tag"),
        (above + 1).cast("int").alias("depth"),
    )


def profile(df: DataFrame, doc: str, xml: str = "xml") -> DataFrame:
    """Elements, texts, comments, CDATA, depth, tags, prefixes and findings per document."""
    t = tokens(df, doc, xml)
    is_element = F.col("kind") == "element"
    prefix = F.nullif(F.regexp_extract("tag", r"^([^:]+):", 1), F.lit(""))
    # What is counted as empty: an empty tag, or a start followed by nothing but its end.
    empty = F.size(
        F.regexp_extract_all(_bare(col(xml)), F.lit(r"<([^\s/>!?]+)[^>]*?(?:/>|>\s*</\1\s*>)"), F.lit(0))
    )
    counts = t.groupBy(doc).agg(
        F.count_if(is_element).alias("elements"),
        F.count_if(F.col("kind") == "text").alias("texts"),
        F.count_if(F.col("kind") == "comment").alias("comments"),
        F.count_if(F.col("kind") == "cdata").alias("cdata"),
        F.max(F.when(F.col("kind").isin("element", "text", "comment", "cdata"), F.col("depth"))).alias("max_depth"),
        F.count_distinct(F.when(is_element, F.col("tag"))).alias("tags"),
        F.sort_array(F.collect_set(F.when(is_element, prefix))).alias("prefixes"),
        F.count_if(is_element & (F.col("depth") > DEEP)).alias("deep_nesting"),
    )
    return counts.join(df.select(doc, empty.alias("empty_elements")), doc)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->|<\?.*?\?>", "")


def tag_frequencies(df: DataFrame, doc: str, xml: str = "xml") -> DataFrame:
    """How often each tag and attribute occurs in the corpus: ``kind, name, count``."""
    bare = F.regexp_replace(_bare(col(xml)), r"(?s)<!\[CDATA\[.*?\]\]>", "")
    starts = df.select(F.explode(F.regexp_extract_all(bare, F.lit(r"<[^/!?][^>]*>"), F.lit(0))).alias("s"))
    named = starts.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("tag").alias("kind"), F.regexp_extract("s", r"^<([^\s/>]+)", 1).alias("name"))),
                F.transform(
                    F.regexp_extract_all("s", F.lit(r"\s([^\s=/>]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(1)),
                    lambda a: F.struct(F.lit("attribute").alias("kind"), a.alias("name")),
                ),
            )
        ).alias("n")
    )
    return named.groupBy("n.kind", "n.name").agg(F.count(F.lit(1)).alias("count"))


# --- cleaning ---------------------------------------------------------------


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def trim_texts(c: Column) -> Column:
    out = F.regexp_replace(c, r">\s+", ">")
    return F.regexp_replace(out, r"\s+<", "<")


def strip_empty(c: Column) -> Column:
    """Without elements that hold no text and no other element, inside out."""

    def one(text: str) -> str | None:
        root = _parsed(text)
        if root is None:
            return None

        def prune(e: ElementTree.Element) -> bool:
            gone = [child for child in e if prune(child)]
            for child in gone:
                e.remove(child)
            return not len(e) and not "".join(e.itertext()).strip()

        prune(root)
        return ElementTree.tostring(root, encoding="unicode")

    return _per_document(one)(c)


def clean(c: Column, comments: bool = True, empty: bool = False, trim: bool = True) -> Column:
    out = strip_comments(c) if comments else c
    out = trim_texts(out) if trim else out
    return strip_empty(out) if empty else out


def minify(c: Column) -> Column:
    """No comments, no white space between tags, empty elements in short form."""
    out = F.regexp_replace(strip_comments(c), r">\s+<", "><")
    return F.trim(F.regexp_replace(out, r"<([^\s/>!?]+)([^>]*)></\1>", "<$1$2/>"), F.lit(" \t\r\n"))


# --- checks -----------------------------------------------------------------


def faults(c: Column) -> Column:
    """``struct<line, col, message>`` of the first fault, null for a well-formed document.

    Well-formedness is tested by the XML parser inside the row.
    """

    @F.pandas_udf("line int, col int, message string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            if text is None or not text.strip():
                return 1, 1, "document is empty"
            parser = expat.ParserCreate()
            try:
                parser.Parse(text.encode("utf-8"), True)
            except expat.ExpatError as e:
                return e.lineno, e.offset + 1, expat.errors.messages[e.code]
            return None, None, None

        out = pd.DataFrame([one(t) for t in texts], columns=["line", "col", "message"])
        return out.astype({"line": "Int32", "col": "Int32"})

    found = run(c)
    return F.when(found["message"].isNotNull(), found)


def schema_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """The inferred schema of a corpus as rows ``path, type, repeated``."""
    schema = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="#text").load(path).schema
    return spark.createDataFrame(list(_schema_entries(schema, row_tag)), "path string, type string, repeated boolean")


def _schema_entries(t: Any, path: str) -> Iterator[tuple]:
    for field in t.fields:
        kind, repeated = field.dataType, False
        if kind.typeName() == "array":
            kind, repeated = kind.elementType, True
        yield f"{path}/{field.name}", kind.typeName(), repeated
        if kind.typeName() == "struct":
            yield from _schema_entries(kind, f"{path}/{field.name}")


# --- edits ------------------------------------------------------------------


def edit(c: Column, edits: Sequence[tuple]) -> Column:
    """Apply edits to all elements an ElementTree path matches, in turn.

    ``("text", path, value)``, ``("set", path, name, value)``, ``("unset", path, name)``,
    ``("rename", path, tag)``, ``("remove", path)``, ``("append", path, xml)``,
    ``("sort", path, key)`` with a key function over child elements.
    """

    def one(text: str) -> str | None:
        root = _parsed(text)
        if root is None:
            return None
        for kind, path, *args in edits:
            parents = {child: parent for parent in root.iter() for child in parent}
            for e in [root] if path == "." else root.findall(path):
                _apply(e, kind, args, parents)
        return ElementTree.tostring(root, encoding="unicode")

    return _per_document(one)(c)


def _apply(e: ElementTree.Element, kind: str, args: list, parents: dict) -> None:
    if kind == "text":
        for child in list(e):
            e.remove(child)
        e.text = args[0]
    elif kind == "set":
        e.set(*args)
    elif kind == "unset":
        e.attrib.pop(args[0], None)
    elif kind == "rename":
        e.tag = args[0]
    elif kind == "remove":
        if e in parents:
            parents[e].remove(e)
    elif kind == "append":
        e.append(ElementTree.fromstring(args[0]))
    elif kind == "sort":
        e[:] = sorted(e, key=args[0])
    else:
        raise ValueError(f"unknown edit {kind}")
