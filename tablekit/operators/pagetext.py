"""Documents as tables of pages and positioned text items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.coerce import col, strip
from tablekit.functions.fx import ENTITIES, xml_escape
from tablekit.operators.edit import small
from tablekit.operators.rows import dense_rows, running_total

# Pages of one document that are joined into one cell; longer documents get
# several cells, so no document is collected whole.
PAGES_PER_CELL = 256


def document_text(
    pages: DataFrame, doc: str = "doc", page: str = "page_no", text: str = "text", first_page: int = 1
) -> DataFrame:
    """Text of each document, pages joined by a blank line: ``doc, part, text``.

    The cells of a document, in ``part`` order and joined by a blank line, are
    the whole text.
    """
    part = F.floor((col(page) - first_page) / PAGES_PER_CELL)
    return pages.groupBy(doc, part.alias("part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(col(page).alias("p"), F.coalesce(col(text), F.lit("")).alias("t")))),
                lambda s: s["t"],
            ),
            "\n\n",
        ).alias("text")
    )


def clean_text(c: Column) -> Column:
    """Without control characters, replacement marks and zero-width characters."""
    # The characters to go.
    out = F.regexp_replace(c, r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F]", "")
    out = F.regexp_replace(out, r"\uFFFD", "")
    return F.regexp_replace(out, r"[\u200B-\u200D\u2060\uFEFF]", "")


def word_count(c: Column) -> Column:
    trimmed = strip(c)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def page_profile(pages: DataFrame, text: str = "text") -> DataFrame:
    """Characters, words and orientation per page."""
    t = F.coalesce(col(text), F.lit(""))
    out = pages.withColumns({"chars": F.length(t), "words": word_count(t)})
    if "width" in pages.columns and "height" in pages.columns:
        out = out.withColumn("orientation", F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait"))
    return out


def document_profile(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    return page_profile(pages, text).groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("words").alias("words")
    )


# --- reading order ----------------------------------------------------------


def assemble_lines(items: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Lines of text from positioned items: ``doc, page, line_no, text``.

    Items are taken top to bottom, then left to right; a line ends where an item
    is more than half a line height away from the line's first item. Inside a
    line items run left to right, with a space where the gap is wider than 0.4
    of a character.

    A gap of half the page's greatest height ends a line whatever came before.
    So items get dense positions, each meets the one before it by a join on the
    position, and such gaps, counted by a running total, cut the page into
    stretches; only inside a stretch the line's first item is carried along.
    """
    placed = dense_rows(items, [col(doc), col(page), F.col("y").desc(), F.col("x"), F.col("text")], "_pos")
    tallest = placed.groupBy(col(doc).alias("_d"), col(page).alias("_p")).agg(F.max("height").alias("_tallest"))
    before = placed.select((F.col("_pos") + 1).alias("_pos"), col(doc).alias("_bd"), col(page).alias("_bp"), F.col("y").alias("_y"))
    paired = placed.join(before, "_pos", "left").join(
        tallest, col(doc).eqNullSafe(F.col("_d")) & col(page).eqNullSafe(F.col("_p"))
    )
    same_page = F.col("_y").isNotNull() & col(doc).eqNullSafe(F.col("_bd")) & col(page).eqNullSafe(F.col("_bp"))
    gap = F.col("_y") - F.col("y") > F.col("_tallest") * 0.5
    starts = F.when(same_page & ~gap, 0).otherwise(1)
    counted = running_total(paired.withColumn("_start", starts), ["_pos"], F.col("_start"), "_before")
    stretch = F.col("_before") + F.col("_start")
    # What is collected is a stretch without a gap: one line, or a few that run into each other.
    item = F.struct("_pos", "x", F.col("y").cast("double").alias("y"), F.col("height").cast("double").alias("height"), "text", "width")
    runs = counted.groupBy(col(doc), col(page), stretch.alias("_stretch")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    carried = "struct<n:int,y:double,h:double,of:array<int>>"

    def carry(acc: Column, it: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(it["y"] - acc["y"]) > F.greatest(acc["h"], it["height"]) * 0.5)
        n = acc["n"] + F.when(new, 1).otherwise(0)
        y, h = F.when(new, it["y"]).otherwise(acc["y"]), F.when(new, it["height"]).otherwise(acc["h"])
        return F.struct(n.alias("n"), y.alias("y"), h.alias("h"), F.concat(acc["of"], F.array(n)).alias("of")).cast(carried)

    nothing = F.lit(None).cast("double")
    begin = F.struct(F.lit(0).alias("n"), nothing.alias("y"), nothing.alias("h"), F.array().alias("of")).cast(carried)
    runs = runs.withColumn("_of", F.aggregate("_items", begin, carry, lambda acc: acc["of"])).withColumn("_lines", F.array_max("_of"))
    runs = running_total(runs, ["_stretch"], F.col("_lines"), "_above")
    first = runs.groupBy(col(doc).alias("_d"), col(page).alias("_p")).agg(F.min("_above").alias("_first"))
    each = runs.join(first, col(doc).eqNullSafe(F.col("_d")) & col(page).eqNullSafe(F.col("_p"))).select(
        doc, page, (F.col("_above") - F.col("_first")).alias("_above"), F.explode(F.sequence(F.lit(1), "_lines")).alias("_n"), "_items", "_of"
    )
    own = F.filter(F.arrays_zip("_items", "_of"), lambda z: z["_of"] == F.col("_n"))
    across = F.array_sort(F.transform(own, lambda z: F.struct(z["_items"]["x"].alias("x"), z["_items"]["_pos"].alias("_pos"), z["_items"]["text"].alias("text"), z["_items"]["width"].alias("width"))))
    joined = F.aggregate(
        across,
        F.struct(F.lit("").alias("out"), nothing.alias("end"), F.lit(0.0).alias("char"), F.lit("").alias("last")),
        lambda acc, it: F.struct(
            F.concat(
                acc["out"],
                F.when(
                    acc["end"].isNotNull()
                    & (it["x"] - acc["end"] > acc["char"] * 0.4)
                    & ~acc["last"].endswith(" ")
                    & ~it["text"].startswith(" "),
                    " ",
                ).otherwise(""),
                it["text"],
            ).alias("out"),
            (it["x"] + it["width"]).cast("double").alias("end"),
            (it["width"] / F.greatest(F.length(it["text"]), F.lit(1))).cast("double").alias("char"),
            it["text"].alias("last"),
        ),
        lambda acc: acc["out"],
    )
    return each.select(doc, page, (F.col("_above") + F.col("_n")).cast("bigint").alias("line_no"), joined.alias("text"))


# --- page edits -------------------------------------------------------------


def select_pages(pages: DataFrame, numbers: Sequence[int], page: str = "page_no") -> DataFrame:
    """Keep the listed pages of every document, in list order and numbered from 1."""
    wanted = pages.sparkSession.createDataFrame(
        [(n, i + 1) for i, n in enumerate(numbers)], "_old long, _new long"
    )
    return (
        pages.join(small(wanted, len(numbers)), col(page) == F.col("_old"))
        .withColumn(page, F.col("_new"))
        .drop("_old", "_new")
    )


def drop_pages(pages: DataFrame, numbers: Sequence[int], page: str = "page_no") -> DataFrame:
    """Remove the listed pages and close the gaps."""
    gone = F.array(*[F.lit(int(n)) for n in sorted(set(numbers))])
    lower = F.size(F.filter(gone, lambda n: n < col(page)))
    return pages.filter(~F.array_contains(gone, col(page).cast("int"))).withColumn(page, col(page) - lower)


def move_page(pages: DataFrame, source: int, target: int, page: str = "page_no") -> DataFrame:
    """Move one page to another place; the pages between shift by one."""
    p = col(page)
    if source < target:
        new = F.when(p == source, target).when((p > source) & (p <= target), p - 1)
    else:
        new = F.when(p == source, target).when((p >= target) & (p < source), p + 1)
    return pages.withColumn(page, new.otherwise(p))


def split_documents(pages: DataFrame, size: int, doc: str = "doc", page: str = "page_no") -> DataFrame:
    """Cut every document into documents of ``size`` pages, named ``doc-1``, ``doc-2`` …"""
    part = F.floor((col(page) - 1) / size)
    return pages.withColumns(
        {
            doc: F.concat_ws("-", col(doc).cast("string"), (part + 1).cast("string")),
            page: col(page) - part * size,
        }
    )


def merge_documents(
    pages: DataFrame, into: str, order: Column, doc: str = "doc", page: str = "page_no"
) -> DataFrame:
    """One document out of all, in ``order``; pages are numbered on.

    Page offsets come from a running total over one row per document.
    """
    lengths = pages.groupBy(doc).agg(F.max(page).alias("_n"), F.min(order).alias("_o"))
    offsets = running_total(lengths, ["_o", doc], F.col("_n"), "_offset").select(doc, "_offset")
    return (
        pages.join(offsets, doc)
        .withColumn(page, col(page) + F.col("_offset"))
        .withColumn("source", col(doc).cast("string"))
        .withColumn(doc, F.lit(into))
        .drop("_offset")
    )


def rotate(pages: DataFrame, degrees: int, relative: bool = True, rotation: str = "rotation") -> DataFrame:
    base = col(rotation) if relative else F.lit(0)
    return pages.withColumn(rotation, F.pmod(base + degrees, F.lit(360)))


# --- export -----------------------------------------------------------------


def page_json(pages: DataFrame, doc: str = "doc", page: str = "page_no") -> DataFrame:
    """One JSON object per page: number, size, rotation, text length and text."""
    size = [c for c in ("width", "height", "rotation") if c in pages.columns]
    entry = F.to_json(
        F.struct(
            col(page).alias("pageNumber"),
            *[col(c) for c in size],
            F.length("text").alias("textLength"),
            F.col("text"),
        )
    )
    return pages.select(doc, page, entry.alias("json"))


def page_xml(pages: DataFrame, doc: str = "doc", page: str = "page_no") -> DataFrame:
    """One ``Page`` element per page, three entities escaped."""
    attrs = [F.concat(F.lit(' number="'), col(page).cast("string"), F.lit('"'))]
    for c in ("width", "height", "rotation"):
        if c in pages.columns:
            attrs.append(F.concat(F.lit(f' {c}="'), col(c).cast("string"), F.lit('"')))
    body = xml_escape(F.coalesce(F.col("text"), F.lit("")), ENTITIES[:3])
    return pages.select(
        doc, page, F.concat(F.lit("<Page"), *attrs, F.lit("><Text>"), body, F.lit("</Text></Page>")).alias("xml")
    )


def export_lines(
    pages: DataFrame, form: str = "json", doc: str = "doc", page: str = "page_no", version: str = "1.7"
) -> DataFrame:
    """A whole document as ordered lines: ``doc, line_no, text``.

    The lines of a document, in order, are its JSON or XML file; head and foot
    are lines of their own, so no document is put together in one task.
    """
    lengths = pages.groupBy(doc).agg(F.max(page).alias("_n"))
    count = F.col("_n").cast("string")
    if form == "json":
        body = page_json(pages, doc, page).join(lengths, doc).select(
            doc, col(page).cast("bigint").alias("line_no"),
            F.concat("json", F.when(col(page) < F.col("_n"), ",").otherwise("")).alias("text"),
        )
        head = F.concat(F.lit(f'{{"version":"{version}","pageCount":'), count, F.lit(',"pages":['))
        foot = F.lit("]}")
    else:
        body = page_xml(pages, doc, page).select(doc, col(page).cast("bigint").alias("line_no"), F.col("xml").alias("text"))
        head = F.concat(
            F.lit(f'<?xml version="1.0" encoding="UTF-8"?><Document version="{version}" pageCount="'), count, F.lit('"><Pages>')
        )
        foot = F.lit("</Pages></Document>")

    def edge(line: Column, text: Column) -> Column:
        return F.struct(line.cast("bigint").alias("line_no"), text.alias("text"))

    frame = lengths.select(
        doc, F.inline(F.array(edge(F.lit(0), head), edge(F.col("_n") + 1, foot)))
    )
    return body.unionByName(frame)
