"""Neighbour and chained imputation against brute force."""

import math

import numpy as np
import pytest

from tablekit.operators import impute


def brute_knn(rows, k):
    """(id, filled value) by looking at every donor."""
    out = []
    for i, x, v in rows:
        if v is None and not any(f is None or math.isnan(f) for f in x):
            near = sorted(
                (math.sqrt(sum((a - b) * (a - b) for a, b in zip(x, y))), j, w)
                for j, y, w in rows if w is not None and not any(f is None or math.isnan(f) for f in y)
            )[:k]
            v = sum(w for *_, w in near) / len(near) if near else None
        out.append((i, v))
    return out


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_nearest_in_several_features(spark, dims):
    rng = np.random.default_rng(dims)
    # A dense cluster, far outliers, repeated points, and rows without a feature.
    points = np.vstack([rng.normal(size=(60, dims)), rng.integers(0, 3, (60, dims)), rng.normal(size=(4, dims)) * 1e6, np.full((40, dims), 7.5)])
    rows = [(i, [float(v) for v in p], None if i % 3 == 0 else float(i)) for i, p in enumerate(points)]
    rows += [(900, [None] * dims, None), (901, [float("nan")] * dims, 3.0), (902, [-0.0] * dims, None), (903, [0.0] * dims, None)]
    cols = [f"f{k}" for k in range(dims)]
    schema = "id bigint, d int, x string, s double, " + ", ".join(f"{c} double" for c in cols) + ", v double"
    df = spark.createDataFrame([(i, 1, "x", 2.0, *x, v) for i, x, v in rows], schema)
    got = impute.knn(df, "v", cols[0] if dims == 1 else cols, 3, row="id")
    assert got.columns == df.columns
    want = brute_knn(rows, 3)
    have = sorted((r.id, r.v) for r in got.collect())
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [v for _, v in have] == [pytest.approx(v) if v is not None else None for _, v in want]
    few = impute.knn(df.filter("v is null or id < 3"), "v", cols, 5, row="id").filter("id = 6").first()
    assert few.v == pytest.approx(1.5)
    none = impute.knn(df.filter("v is null"), "v", cols, 5, row="id")
    assert none.count() == df.filter("v is null").count() and none.filter("v is not null").count() == 0
    assert impute.knn(df.limit(0), "v", cols, row="id").count() == 0


def brute_chained(table, rounds):
    """Gauss-Seidel on the rows themselves."""
    gap = np.isnan(table)
    filled = np.where(gap, np.nanmean(table, axis=0), table)
    for _ in range(rounds):
        for c in np.flatnonzero(gap.any(axis=0)):
            others = np.delete(np.arange(table.shape[1]), c)
            x = np.column_stack([np.ones(len(table)), filled[:, others]])
            known = ~gap[:, c]
            weights = np.linalg.lstsq(x[known], filled[known, c], rcond=None)[0]
            filled[gap[:, c], c] = x[gap[:, c]] @ weights
    return filled


def test_chained_equations(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 2))
    table = np.column_stack([base @ [1, 2], base @ [3, -1] * 1e5 + 1e6, base[:, 0] + rng.normal(size=400) * 0.1, rng.normal(size=400)])
    table[:, :3][rng.random((400, 3)) < 0.3] = np.nan
    table[0, :3] = np.nan
    schema = "id int, pattern int, z string, a double, b double, c double, d double, empty double"
    rows = [(i, 1, "z", *[None if np.isnan(v) else float(v) for v in r], None) for i, r in enumerate(table)]
    df = spark.createDataFrame(rows, schema)
    got = impute.mice(df, ["a", "b", "c", "d", "empty"], 3)
    assert got.columns == df.columns
    have = sorted(got.collect())
    assert all(r.empty is None for r in have)
    assert np.array([r[3:7] for r in have]) == pytest.approx(brute_chained(table, 3), rel=1e-7, abs=1e-7)
    # Collinear and constant predictors, and no rows at all.
    twin = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, 2.0, 4.0, 5.0), (3, None, 6.0, 5.0)], "id int, a double, b double, c double")
    assert sorted(impute.mice(twin, ["a", "b", "c"]).collect())[2].a == pytest.approx(3.0)
    assert impute.mice(df.limit(0), ["a", "b"]).count() == 0


def test_rows_of_one_pattern_lie_apart(spark, monkeypatch):
    """No task gathers all rows with the same gaps, whether the patterns are few or many."""
    rng = np.random.default_rng(2)
    table = rng.normal(size=(3000, 2))
    table[:1000, 0] = np.nan
    rows = [(i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(table)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = []
        for sent in (impute.SENT_NUMBERS, 0):
            monkeypatch.setattr(impute, "SENT_NUMBERS", sent)
            out = impute.mice(df, ["a", "b"], 2)
            sizes = [len(p) for p in out.rdd.glom().collect()]
            assert max(sizes) < 1000
            found.append(np.array(sorted((r.id, r.a, r.b) for r in out.collect())))
        assert found[0] == pytest.approx(found[1], rel=1e-12)
        assert found[0][:, 1:] == pytest.approx(brute_chained(table, 2), rel=1e-7, abs=1e-7)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
