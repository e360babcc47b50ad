"""Text files as ordered pieces.

Files are read with a record separator, so a large file is split over tasks.
The order of pieces inside a file is kept in the columns ``file, block, _seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["file", "block", "_seq"]


def pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``value, file, block, _seq, file_size``; line ends are ``\\n`` unless a separator is given."""
    reader = spark.read.option("lineSep", separator or "\n")
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def without_bom(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.regexp_replace("value", "^﻿", ""))
