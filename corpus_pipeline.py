"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame;
its rows are written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from tablekit.llm.base import prepare
from tablekit.session import new_folder, remove

# SQL has neither the learner nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, does not reject."""
    model = toxicity.fit_toxicity(docs, prepare(spark).read.parquet(f"{folder}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that stand in an earlier place; those that lose all words go.

    Equal lines go from one word on, close ones from five: at most one word in five differs.
    """
    return linededup.keep_first_lines(docs, min_words=1, near_words=5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-equal ones: five-word shingles, similarity 0.8."""
    return ngramjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.drop_leaks(docs, prepare(spark).read.parquet(f"{folder}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents, placed into sequences."""
    return packing.pack_documents(docs, added=packing.added_tokens()).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "loss_tokens",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for _, stage in STAGES[:-1]:
        written.append(new_folder(spark))
        stage(spark, docs, sf_dir).write.parquet(written[-1])
        docs = spark.read.parquet(written[-1])
        if len(written) > 1:
            remove(spark, written[-2])
    return STAGES[-1][1](spark, docs, sf_dir)
