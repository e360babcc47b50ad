"""Embedding whitening on MLlib's distributed block matrices.

Rows become whole numbers, so sums and deviations are exact. Distinct vectors
are the fit list: their centred rows lie in blocks, a transpose-multiply gives
the scatter matrix, its eigenvectors are found locally (the matrix has as many
rows as a vector has entries), and a second multiplication projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm.base import Scratch, prepare

# Fixed values of the whole-number form.
SCALE, SHIFT = 64, 1_000_000
# Doubles of a block (4 MB), and its columns at most.
BLOCK_CELLS, BLOCK_COLUMNS = 1 << 19, 1024
# An eigenvalue below this share of the largest is no variance but rounding.
NO_VARIANCE = 1e-10


@dataclass(frozen=True)
class Whitening:
    """What a fit list of ``n`` distinct vectors with per-dimension ``sums`` gives."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray  # dimensions x components: unit eigenvectors over the root of their eigenvalues
    values: np.ndarray  # eigenvalues, falling
    trace: float


def whole(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of every entry; null where the vector or an entry is null or not finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = entries.isNotNull() & ~F.coalesce(F.exists(entries, bad), F.lit(False))
    return F.when(fine, F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("bigint")))


def numbered(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df``, stored, with a gapless ``place`` from 0: partition sizes, one row each, give the offsets."""
    stored = scratch.store(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = dict(stored.groupBy(part).count().collect())
    offsets, total = {}, 0
    for k in sorted(sizes):
        offsets[k], total = total, total + sizes[k]
    steps = stored.sparkSession.createDataFrame(list(offsets.items()), "part bigint, offset bigint")
    # One row per partition, whatever the rows.
    return (
        stored.join(F.broadcast(steps), part == F.col("part"))
        .withColumn("place", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("at", "part", "offset")
    )


def centred(x: Column, n: int, sums) -> Column:
    """``x - S/n`` as doubles: the whole number ``n*x - S`` first, one division last."""
    s = F.array(*[F.lit(int(v)).cast("bigint") for v in sums])
    return F.zip_with(x, s, lambda a, b: (F.lit(n).cast("bigint") * a - b).cast("double") / F.lit(float(n)))


def deviation(x: Column, n: int, sums) -> Column:
    """Sum over the dimensions of ``(n*x - S)^2``, exact; an overflow raises."""
    s = F.array(*[F.lit(int(v)).cast("bigint") for v in sums])
    apart = F.zip_with(x, s, lambda a, b: F.lit(n).cast("bigint") * a - b)
    return F.aggregate(apart, F.lit(0).cast("bigint"), lambda total, v: total + v * v)


def block_matrix(df: DataFrame, place: str, row: str, dims: int) -> BlockMatrix:
    """Rows of doubles as a distributed matrix of dense blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(place, array_to_vector(row).alias("row")), "row")
    columns = min(dims, BLOCK_COLUMNS)
    return IndexedRowMatrix(vectors).toBlockMatrix(BLOCK_CELLS // columns, columns)


def multiply(left: BlockMatrix, right: BlockMatrix, middle: int = 1) -> BlockMatrix:
    """``left`` times ``right``; the dimension they share is dealt to ``middle`` tasks."""
    got = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, middle)
    return BlockMatrix(got, left.rowsPerBlock, right.colsPerBlock)


def gram(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix: every block of rows is a task's own, partial sums meet by reduceByKey."""
    return multiply(m.transpose(), m, max(1, m.numRowBlocks)).toLocalMatrix().toArray()


def project(m: BlockMatrix, projection: np.ndarray) -> DataFrame:
    """``place`` and ``white``: the rows of ``m`` times the whitening matrix."""
    dims, parts = projection.shape
    sc = m._java_matrix_wrapper._sc
    size = m.colsPerBlock
    blocks = [
        ((i, 0), DenseMatrix(len(p), parts, p.flatten(order="F").tolist()))
        for i, p in enumerate(projection[k : k + size] for k in range(0, dims, size))
    ]
    right = BlockMatrix(sc.parallelize(blocks, 1), size, parts, dims, parts)
    rows = multiply(m, right).toIndexedRowMatrix()
    df = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(df, "vector").select(
        F.col("index").alias("place"), vector_to_array("vector").alias("white")
    )


def fit_whitening(fit: DataFrame, scratch: Scratch, components: int) -> tuple[Whitening, float]:
    """The whitening of the distinct vectors ``x`` at ``place``, and its identity error.

    The error is the largest absolute entry of the covariance of the whitened
    rows, centred anew, minus the identity.
    """
    dims = fit.select(F.max(F.size("x"))).first()[0] or 0
    got = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i]) for i in range(dims)]).first()
    n, sums = got[0], tuple(got[1:])
    if not n or not dims:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0), 0.0
    matrix = block_matrix(fit.select("place", centred(F.col("x"), n, sums).alias("row")), "place", "row", dims)
    covariance = gram(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    order = order[values[order] > max(values.max(), 0.0) * NO_VARIANCE]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    model = Whitening(n, sums, vectors / np.sqrt(values), values, trace)
    if not len(values):
        return model, 0.0
    white = scratch.store(project(matrix, model.projection), "white")
    means = white.agg(*[F.avg(F.col("white")[i]) for i in range(len(values))]).first()
    shift = F.array(*[F.lit(float(m)) for m in means])
    again = block_matrix(
        white.select("place", F.zip_with("white", shift, lambda a, b: a - b).alias("row")), "place", "row", len(values)
    )
    return model, float(np.abs(gram(again) / n - np.eye(len(values))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened coordinates of every usable row, one row per component.

    Rows whose vector is null, or holds null or non-finite entries, are left
    out; so are vectors of another length than the table's most frequent one
    (the longer on a tie), as entries of theirs are missing. Repeated vectors
    count once in the fit and each get their rows; null keys and repeated rows
    are rows like others. Only components with variance are given, so a table
    of equal vectors, like an empty one, gives no rows. Other columns are not
    looked at. Whole numbers beyond 64 bits raise an error.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    read = vectors.select(F.col(key).alias("key"), whole(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    common = read.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    rows = numbered(read.where(F.size("x") == dims), scratch, "rows")
    fit = numbered(scratch.spark.read.parquet(scratch.folders["rows"]).select("x").distinct(), scratch, "fit")
    model, error = fit_whitening(fit, scratch, components)
    scratch.drop(*[name for name in scratch.folders if name != "rows"])
    kind = vectors.schema[key].dataType.simpleString()
    if not len(model.values):
        schema = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    matrix = block_matrix(rows.select("place", centred(F.col("x"), model.n, model.sums).alias("row")), "place", "row", dims)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return (
        rows.select("place", "key", deviation(F.col("x"), model.n, model.sums).alias("deviation"))
        .join(project(matrix, model.projection), "place")
        .select("key", "deviation", F.posexplode("white").alias("at", "whitened"))
        .select(
            F.col("key").alias(key),
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            F.element_at(explained, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
