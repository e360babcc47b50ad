"""Missing-data methods: counts, deletion, simple, grouped, neighbour and chained imputation."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.coerce import col, dtype
from tablekit.operators.agg import median
from tablekit.operators.profile import missing_rates
from tablekit.operators.rows import ROW, running_total
from tablekit.session import cut


def missing_report(df: DataFrame, row: str = ROW) -> DataFrame:
    """``column, missing, rate`` for nulls."""
    return missing_rates(df, row, blank=False)


def listwise(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def drop_sparse_columns(df: DataFrame, threshold: float = 0.6, row: str = ROW) -> DataFrame:
    """Drop columns missing in more than ``threshold`` of the rows; one row decides."""
    rates = missing_report(df, row).filter(F.col("rate") > threshold).select("column").collect()
    return df.drop(*[r["column"] for r in rates])


def label(df: DataFrame, name: str, value: str = "Missing", indicator: str | None = None) -> DataFrame:
    """A category of its own for missing values, with an indicator column."""
    flag = col(name).isNull() if not str(dtype(df, name)).startswith("String") else (
        col(name).isNull() | (F.trim(col(name)) == "")
    )
    out = df.withColumn(indicator or f"{name}_missing", flag)
    return out.withColumn(name, F.when(F.col(indicator or f"{name}_missing"), value).otherwise(col(name)))


def statistic(df: DataFrame, name: str, method: str) -> DataFrame:
    """One row ``value``: the mean, exact median or mode of a column.

    The mode counts values first, so it never holds them in one place; ties go
    to the smallest value.
    """
    if method == "mean":
        return df.agg(F.avg(col(name)).alias("value"))
    if method == "median":
        return median(df, [], name, "value")
    if method == "mode":
        counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.max("n").alias("n"))
        return counts.join(F.broadcast(top), "n").agg(F.min("v").alias("value"))
    raise ValueError(f"unknown method {method}")


@dataclass
class SimpleImputer:
    """Fit statistics on one table, fill the gaps of another."""

    methods: Mapping[str, str]
    values: dict[str, Any] | None = None

    def fit(self, df: DataFrame) -> SimpleImputer:
        # One number per column.
        self.values = {c: statistic(df, c, m).first()["value"] for c, m in self.methods.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.values is None:
            raise ValueError("fit first")
        return df.withColumns(
            {c: F.coalesce(col(c), F.lit(v).cast(dtype(df, c))) for c, v in self.values.items() if v is not None}
        )


def impute(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Fill gaps with column statistics; the statistic is part of the plan."""
    return df.withColumns(
        {
            c: F.coalesce(col(c), statistic(df, c, m).scalar().cast(dtype(df, c)))
            for c, m in methods.items()
        }
    )


@dataclass
class GroupMedianImputer:
    """Fill gaps with the exact median of the row's group."""

    group: str
    name: str
    table: DataFrame | None = None

    def fit(self, df: DataFrame) -> GroupMedianImputer:
        self.table = cut(median(df, [self.group], self.name, "_median"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.table is None:
            raise ValueError("fit first")
        t = self.table.withColumnRenamed(self.group, "_group")
        return (
            df.join(t, col(self.group).eqNullSafe(F.col("_group")), "left")
            .withColumn(self.name, F.coalesce(col(self.name), F.col("_median")))
            .drop("_group", "_median")
        )


def group_median(df: DataFrame, group: str, name: str) -> DataFrame:
    return GroupMedianImputer(group, name).fit(df).transform(df)


# --- neighbours -------------------------------------------------------------


def knn(
    df: DataFrame, target: str, feature: str | Sequence[str], k: int = 5, row: str = ROW, weighted: bool = False
) -> DataFrame:
    """Fill ``target`` from the ``k`` rows nearest in ``feature``, one or several columns, that have it.

    Exact, by Euclidean distance; among equally near donors the lower row number
    wins. Gaps with the same features are solved once, and of donors with the
    same features the first ``k`` can matter. Rows that miss a feature stay as
    they are.
    """
    features = [feature] if isinstance(feature, str) else list(feature)
    own = "_" * (1 + max(map(len, df.columns))) + "knn"
    # Adding 0 makes the two zeros one.
    x = F.array(*[col(f).cast("double") + F.lit(0.0) for f in features]).cast("array<double>")
    told = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    first = Window.partitionBy("x").orderBy("dr")
    donors = (
        df.filter(col(target).isNotNull() & told)
        .select(x.alias("x"), col(target).cast("double").alias("dt"), col(row).alias("dr"))
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )
    wanted = df.filter(col(target).isNull() & told).select(x.alias("x")).distinct()
    best = _nearest_on_line(wanted, donors, k) if len(features) == 1 else _nearest_by_pivots(wanted, donors, k, len(features))
    if weighted:
        weight = F.transform("s", lambda v: F.lit(1.0) / F.greatest(v["d"], F.lit(1e-9)))
        value = F.aggregate(
            F.zip_with("s", weight, lambda v, w: v["dt"] * w), F.lit(0.0), lambda a, v: a + v
        ) / F.aggregate(weight, F.lit(0.0), lambda a, v: a + v)
    else:
        value = F.aggregate("s", F.lit(0.0), lambda a, v: a + v["dt"]) / F.size("s")
    filled = best.select(F.struct(F.col("x").alias("x"), value.alias("value")).alias(own))
    joined = df.join(filled, col(target).isNull() & (x == F.col(own)["x"]), "left")
    guess = F.coalesce(col(target), F.col(own)["value"].cast(dtype(df, target))).alias(target)
    return joined.select(*[guess if c == target else col(c) for c in df.columns])


def _nearest_on_line(wanted: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """``x`` and ``s``, its ``k`` nearest donors, for one feature.

    Donors are numbered in feature order. The ``k`` nearest of a value are among
    the 2k donors before its place (whole groups of equal features) and the
    ``k`` after it, so each value looks up 3k places.
    """
    missing = lambda c: F.lit(None).cast(donors.schema[c].dataType).alias(c)
    both = donors.unionByName(wanted.select("x", missing("dt"), missing("dr"))).withColumn("gap", F.col("dt").isNull())
    counted = F.when(~F.col("gap"), 1).otherwise(0)
    placed = running_total(both, ["x", "gap", "dr"], counted, "place")
    near = placed.filter("not gap").select("place", F.col("x")[0].alias("f"), "dt", "dr")
    looks = placed.filter("gap").select("x", F.explode(F.sequence(F.col("place") - 2 * k, F.col("place") + k - 1)).alias("place"))
    pairs = looks.join(near, "place").select("x", F.struct(F.abs(F.col("x")[0] - F.col("f")).alias("d"), "dr", "dt").alias("s"))
    # At most 3k entries per value.
    return pairs.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("s")), 1, k).alias("s"))


def _nearest_by_pivots(wanted: DataFrame, donors: DataFrame, k: int, dims: int) -> DataFrame:
    """``x`` and ``s``, its ``k`` nearest donors, for several features.

    Two points are at least as far apart as their distances to any third, a
    pivot, differ. So donors within a radius lie in neighbouring cells of the
    distances to a few pivots; cells are join keys. A point with ``k`` donors
    within the radius is settled, the others try again with twice the radius,
    until it spans all points.
    """
    every = donors.select("x").unionByName(wanted.select("x"))
    box = every.agg(*[f(F.col("x")[i]) for i in range(dims) for f in (F.min, F.max)], F.count(F.lit(1))).first()
    low, high, n = box[0 : 2 * dims : 2], box[1 : 2 * dims : 2], box[-1]
    entry = F.struct(F.lit(0.0).alias("d"), "dr", "dt")
    if low[0] is None:
        return donors.select("x", F.array(entry).alias("s"))
    spans = [b - a for a, b in zip(low, high)]
    far = math.sqrt(sum(e * e for e in spans))
    # Corners of the box: the lowest one, moved to the upper end of one feature each.
    pivots = [[high[i] if i == j else low[i] for i in range(dims)] for j in range(min(dims, 3))]
    to_pivots = F.array(*[distance(F.col("x"), F.array(*[F.lit(float(v)) for v in p])) for p in pivots]).alias("d")
    donors, left = cut(donors.select("*", to_pivots)), cut(wanted.select("x", to_pivots))
    steps = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=len(pivots))])
    radius, settled = max(far / 2 * (k / n) ** (1 / dims), far * 1e-6), [donors.select("x", F.array(entry).alias("s")).limit(0)]
    while not left.isEmpty():
        # A little wider than the radius, for distances are rounded.
        width = F.lit(radius * (1 + 1e-9) or 1.0)
        cell = F.transform("d", lambda v: F.floor(v / width))
        places = donors.select(cell.alias("cell"), F.col("x").alias("y"), "dr", "dt")
        looks = left.select("x", cell.alias("at"), F.explode(steps).alias("step")).select(
            "x", F.zip_with("at", "step", lambda a, b: a + b).alias("cell")
        )
        nearest = Window.partitionBy("x").orderBy("d", "dr")
        pairs = looks.join(places, "cell").select("x", distance(F.col("x"), F.col("y")).alias("d"), "dr", "dt")
        ranked = pairs.filter(F.col("d") <= radius).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k)
        # At most k entries per point.
        found = ranked.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("d", "dr", "dt"))).alias("s"))
        done = cut(found if radius >= far else found.filter(F.size("s") >= k))
        settled.append(done)
        if radius >= far:
            break
        left = cut(left.join(done.select("x"), "x", "left_anti"))
        radius = min(2 * radius, far * (1 + 1e-9))
    return functools.reduce(DataFrame.unionByName, settled)


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v))


# --- chained equations ------------------------------------------------------

# Numbers in a table of patterns that is sent to all tasks; more are joined in this many parts per pattern.
SENT_NUMBERS, SALTS = 2_000_000, 64


def mice(df: DataFrame, cols: Sequence[str], rounds: int = 5) -> DataFrame:
    """Chained regressions: each column with gaps is predicted from the others, in turn.

    Gaps start at the column mean. Each step is one least-squares regression
    fitted on the rows where the column is known and applied to its gaps; of
    collinear columns it takes the shortest solution.

    A filled value is always a linear function of what its row has, and the same
    one for all rows with the same gaps. So one aggregate of cross products per
    pattern of gaps holds all that any round needs: the regressions run on that
    table, however many rounds there are, and a second pass over the rows fills
    them. A column without a single value stays as it is and predicts nothing.
    """
    stats = df.agg(
        *[f(col(c).cast("double")) for c in cols for f in (F.count, F.avg, F.stddev_pop)]
    ).first()
    about = {c: stats[3 * i : 3 * i + 3] for i, c in enumerate(cols)}
    used = [c for c in cols if about[c][0]]
    # Standard scores keep the cross products well conditioned; a gap is 0, its mean.
    scale = [(float(about[c][1]), float(about[c][2]) or 1.0) for c in used]
    scores = [F.lit(1.0)] + [
        F.coalesce((col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in zip(used, scale)
    ]
    pattern = F.array(*[col(c).isNull() for c in used]).cast("array<boolean>")
    width = len(scores)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    patterns = cut(
        df.select(pattern.alias("pattern"), *[v.alias(f"z{i}") for i, v in enumerate(scores)])
        .groupBy("pattern")
        .agg(F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("products"))
    )
    steps: list[tuple[int, np.ndarray]] = []
    # A round on complete columns changes nothing, so they are no targets.
    gappy = patterns.agg(*[F.max(F.col("pattern")[i]) for i in range(len(used))]).first() if used else ()
    targets = [i for i in range(len(used)) if gappy[i]]
    for _ in range(rounds):
        for t in targets:
            steps.append((t, _regression(_completed(patterns, steps, t, width), t)))
    filled = patterns.mapInArrow(_fillings(steps, width), "pattern array<boolean>, fill array<array<double>>")
    # What the rows have, by name: helper columns stay in one struct of their own.
    own = "_" * (1 + max(map(len, df.columns))) + "mice"
    work = df.select("*", F.struct(pattern.alias("pattern"), F.array(*scores).alias("z")).alias(own))
    ready = filled.select(F.col("pattern").alias(own + "p"), F.col("fill").alias(own + "f"))
    # Half of all rows may have the same gaps, so they are not gathered by them: the few patterns
    # go to the rows, and where there are many, the rows of one pattern are dealt over many tasks.
    if patterns.count() * width * width <= SENT_NUMBERS:
        work = work.join(F.broadcast(ready), F.col(own)["pattern"] == F.col(own + "p"), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(own)["z"]), F.lit(SALTS))
        ready = ready.withColumn(own + "s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        work = work.join(ready, (F.col(own)["pattern"] == F.col(own + "p")) & (salt == F.col(own + "s")), "left").drop(own + "s")
    place = {c: i for i, c in enumerate(used)}

    def value(c: str) -> Column:
        m, s = scale[place[c]]
        terms = F.zip_with(F.col(own + "f")[place[c]], F.col(own)["z"], lambda a, b: a * b)
        guess = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) * F.lit(s) + F.lit(m)
        return F.coalesce(col(c).cast("double"), guess).alias(c)

    return work.select(*[value(c) if c in place else col(c) for c in df.columns])


def _pattern_maps(pattern: Sequence[bool], steps: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """The matrix from (1, known scores) to (1, all scores) of rows with these gaps, after all steps."""
    whole = np.eye(len(pattern) + 1)
    for i, gap in enumerate(pattern):
        if gap:
            whole[i + 1] = 0.0
    for target, weights in steps:
        if pattern[target]:
            whole[target + 1] = weights @ whole
    return whole


def _products(flat: Sequence[float], width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = flat
    return out + np.triu(out, 1).T


def _completed(patterns: DataFrame, steps: Sequence[tuple[int, np.ndarray]], target: int, width: int) -> np.ndarray:
    """Cross products of the completed scores over the rows that know ``target``."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for gaps, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not gaps[target]:
                    whole = _pattern_maps(gaps, steps)
                    total += whole @ _products(flat, width) @ whole.T
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width), "v": total.ravel()})

    sums = patterns.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width * width)
    out[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    return out.reshape(width, width)


def _regression(products: np.ndarray, target: int) -> np.ndarray:
    """Least-squares weights of (1, scores) for a score; its own weight is 0."""
    others = np.delete(np.arange(len(products)), target + 1)
    weights = np.zeros(len(products))
    weights[others] = np.linalg.lstsq(products[np.ix_(others, others)], products[others, target + 1], rcond=1e-12)[0]
    return weights


def _fillings(steps: Sequence[tuple[int, np.ndarray]], width: int):
    def run(batches):
        for batch in batches:
            maps = [_pattern_maps(gaps, steps)[1:].tolist() for gaps in batch.column(0).to_pylist()]
            fill = pa.array(maps, pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), fill], names=["pattern", "fill"])

    return run
