"""The registered queries of the training-data operators, one per operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm import (
    decontaminate, dialogues, hmm, lexical, licenses, linededup, ngramjoin, packing, quality, subwords, toxicity, warc, whitening,
)
from tablekit.llm.base import crc_remainder, prepare
from tablekit.session import new_folder

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack_documents(_table(spark, folder, "documents"), added=packing.added_tokens()).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "loss_tokens",
    )


@_query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that documents name or quote."""
    found = licenses.scan_licenses(_table(spark, folder, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("phrase_labels", F.col("matches.label"))))
    best = F.coalesce(F.array_max("matches.score"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_starts").cast("long").alias("n_base"),
        F.array_min("phrase_starts").alias("first_word"),
        F.array_max("phrase_starts").alias("last_word"),
        F.array_join("phrase_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("phrase_starts") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


@_query
def op3_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the view of each of its speakers."""
    turns = dialogues.rotate_perspectives(_table(spark, folder, "conversations"))
    return turns.withColumn("rendered_md5", F.md5("rendered")).drop("rendered")


LLM_ORACLES["op3_perspective_rotation"] = """
WITH s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
r AS (
  SELECT c.conv_id, s.perspective, c.turn, c.role, c.role = s.perspective AS loss,
    CASE WHEN c.role = s.perspective THEN '<|assistant|>' || chr(10)
         WHEN c.role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user|>' || c.role || chr(10) END AS head,
    c.text || '<|end|>' || chr(10) AS body
  FROM conversations c JOIN s USING (conv_id)),
t AS (
  SELECT *, length(head) + length(body) AS n,
    CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, head || body
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM r)
SELECT conv_id, perspective, turn, role, loss, stop - n AS start, stop,
  CASE WHEN loss THEN stop - length(body) END AS loss_start, CASE WHEN loss THEN stop END AS loss_stop,
  md5(head || body) AS rendered_md5
FROM t
"""


@_query
def op4_content_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, written, read back and made whole again."""
    pages = _table(spark, folder, "pages")
    archive = new_folder(spark)
    warc.write_archive(pages, archive)
    records = warc.read_archive(spark, archive)
    whole = warc.restore(warc.headers_of(records), warc.payloads_of(records))
    kind = pages.schema["page_id"].dataType
    page = F.regexp_extract(warc.field("WARC-Record-ID"), r"^<urn:record:(.*)>$", 1)
    refers = F.regexp_extract(warc.field("WARC-Refers-To"), r"^<urn:record:(.*)>$", 1)
    return whole.select(
        page.cast(kind).alias("page_id"),
        "payload_bytes",
        F.col("sha1").alias("payload_digest"),
        "record_type",
        refers.cast(kind).alias("refers_to"),
    )


LLM_ORACLES["op4_content_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


@_query
def op5_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of all documents and the verdict of trees fitted to the quality labels."""
    docs = _table(spark, folder, "documents")
    trees = quality.fit_quality(docs, _table(spark, folder, "labels"))
    return quality.judge(docs, trees)


@_query
def op7_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learnt from labelled rows that are not held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(crc_remainder(F.col("doc_id"), 3) != 1))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@_query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the lines that repeat earlier ones, equal or with one other word."""
    found = linededup.dedup_lines(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"),
        F.md5("kept").alias("kept_md5"),
    )


LLM_ORACLES["op9_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
w AS (
  SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM l),
k AS (SELECT *, array_to_string(ws, ' ') AS h, doc_id * 1000000 + no AS pos FROM w WHERE len(ws) >= 1),
f AS (SELECT h, any_value(ws) AS ws, min(pos) AS first FROM k GROUP BY h),
c AS (
  SELECT h, first, unnest(range(1, len(ws) + 1)) AS i, unnest([
    array_to_string(list_concat(ws[1:x - 1], ws[x + 1:]), ' ') FOR x IN range(1, len(ws) + 1)]) AS v
  FROM f WHERE len(ws) >= 5),
near AS (
  SELECT h FROM (SELECT h, first, min(first) OVER (PARTITION BY v, i) AS m FROM c) WHERE m < first
  UNION SELECT c.h FROM c JOIN f ON f.h = c.v WHERE f.first < c.first AND len(f.ws) >= 5
  UNION SELECT f.h FROM c JOIN f ON f.h = c.v WHERE c.first < f.first AND len(f.ws) >= 5),
d AS (
  SELECT k.doc_id, k.no FROM k JOIN f USING (h)
  WHERE k.pos <> f.first OR k.h IN (SELECT h FROM near))
SELECT l.doc_id, count(*) AS n_lines, count(d.no) AS n_dropped,
  coalesce(string_agg(CAST(d.no AS VARCHAR), ',' ORDER BY l.no), '') AS dropped_lines,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (d.no IS NULL), '')) AS kept_md5
FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.no = l.no
GROUP BY l.doc_id
"""


@_query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-equal documents."""
    return ngramjoin.near_duplicates(_table(spark, folder, "documents"))


@_query
def op8_hmm_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of all documents under a model of those that are not held out."""
    return hmm.score_texts(_table(spark, folder, "documents"), crc_remainder(F.col("doc_id"), 7) != 2)


@_query
def op11_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learnt from labelled rows that are not held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = subwords.fit_embeddings(docs, labels.where(crc_remainder(F.col("doc_id"), 3) != 1))
    scored = subwords.score_quality(docs, model)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@_query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 16 whitened coordinates of all embeddings."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query
def op13_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


LLM_ORACLES["op13_block_max_search"] = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM d, c),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
