"""The distributed matching against the plain sequential rule."""

import datetime
import random

import pytest

from tablekit.operators import ledger

SCHEMA = "_row bigint, id string, date date, amount decimal(18,2), check_number string"


def sequential(a, b, days=3):
    free = sorted(b)
    out = []
    for x in sorted(a):
        for y in free:
            close = abs(x[3] - y[3]) <= 1
            same_id = x[1] and x[1] == y[1]
            near = x[2] and y[2] and abs((x[2] - y[2]).days) <= days
            check = x[4] and x[4] == y[4]
            if close and (same_id or near or check):
                out.append((x[0], y[0]))
                free.remove(y)
                break
    return sorted(out)


def side(rng, n, amounts, span):
    day = datetime.date(2024, 1, 1)
    rows = []
    for r in rng.sample(range(n * 3), n):
        rows.append(
            (
                r,
                rng.choice(["", f"id{rng.randrange(n)}"]),
                rng.choice([None] + [day + datetime.timedelta(rng.randrange(span))] * 5),
                rng.choice(amounts),
                rng.choice(["", "", f"c{rng.randrange(n)}"]),
            )
        )
    return rows


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(r, i, d, Decimal(c) / 100, k) for r, i, d, c, k in rows], SCHEMA)


@pytest.mark.parametrize(
    "seed, n, amounts, span",
    [(1, 120, [100, 101, 102, 500], 20), (2, 60, [0], 1), (3, 150, list(range(100, 140, 3)), 60)],
)
def test_short_runs_as_sequential(spark, seed, n, amounts, span):
    rng = random.Random(seed)
    a, b = side(rng, n, amounts, span), side(rng, n - 5, amounts, span)
    got = ledger.match_pairs(frame(spark, a), frame(spark, b)).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b)


def test_runs_over_many_batches(spark):
    """Runs that go over the end of an Arrow batch, and some settled in rounds among others that are not."""
    rng = random.Random(9)
    a, b = side(rng, 90, list(range(0, 900, 100)) + [501] * 3, 20), side(rng, 80, list(range(0, 900, 100)), 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for run_rows in (10**6, 20):
            got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=run_rows).collect()
            assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rounds_as_sequential(spark):
    rng = random.Random(4)
    a, b = side(rng, 16, [100, 101, 102, 500], 12), side(rng, 14, [100, 101, 102, 500], 12)
    got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=0).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b)


def test_equal_rows_need_few_rounds(spark, monkeypatch):
    """Many equal transactions on both sides are one signature each."""
    day = datetime.date(2024, 1, 1)
    a = [(i, "", day, 999, "") for i in range(300)]
    b = [(i, "", day, 999, "") for i in range(250)]
    rounds = []
    kept = ledger._left_over
    monkeypatch.setattr(ledger, "_left_over", lambda *args: rounds.append(1) or kept(*args))
    got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=0).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == [(i, i) for i in range(250)]
    # One round, which updates both sides.
    assert len(rounds) == 2


def test_report(spark):
    day = datetime.date(2024, 1, 1)
    a = frame(spark, [(1, "x", day, 100, ""), (2, "", day, 200, "")])
    b = frame(spark, [(1, "x", None, 101, "")])
    result = ledger.reconcile(a, b)
    row = ledger.reconcile_report(a, b, result).first()
    assert (row.matched, row.unmatched_a, row.unmatched_b, row.reconciled) == (1, 1, 0, False)
    assert (row.total_a, row.total_b, round(row.discrepancy, 2)) == (3.0, 1.01, 1.99)


@pytest.mark.parametrize("seed, days, run_rows", [(5, 3, 60), (6, 1, 40), (7, 3, 80)])
def test_stretches_of_days_as_sequential(spark, monkeypatch, seed, days, run_rows):
    """A run far longer than what is settled together needs no round, wherever its days are cut."""
    rng = random.Random(seed)
    start = datetime.date(2024, 1, 1)

    def rows(n, shown):
        out = []
        for k in rng.sample(range(n * 2), n):
            # Ids and check numbers are shared by both sides, a few days apart.
            at = start + datetime.timedelta((k * 37) % 200 + (k % 6 if shown else 0))
            out.append((k, f"id{k}" if k % 2 else "", at, 0 if k % 3 else 1, f"c{k}" if k % 10 == 0 else ""))
        return out

    a, b = rows(330, False), rows(300, True)
    a += [(1000, "", None, 0, ""), (1001, "none", None, 1, "")]
    monkeypatch.setattr(ledger, "_choices", lambda *args: pytest.fail("settled in rounds"))
    got = ledger.match_pairs(frame(spark, a), frame(spark, b), days, run_rows=run_rows).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b, days)


@pytest.mark.parametrize("seed, span", [(11, 300), (12, 1), (13, 12)])
def test_long_runs_in_one_pass(spark, monkeypatch, seed, span):
    """A long run needs no round, be its days many or one, and its ids shared over all of them."""
    rng = random.Random(seed)
    a, b = side(rng, 200, [0, 1, 2, 700], span), side(rng, 180, [0, 1, 2, 701], span)
    monkeypatch.setattr(ledger, "_choices", lambda *args: pytest.fail("settled in rounds"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b)


def test_runs_too_long_for_a_task_go_through_rounds(spark):
    rng = random.Random(14)
    a, b = side(rng, 24, [0, 1, 700, 900], 12), side(rng, 20, [0, 1, 700, 900], 12)
    got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=4, pass_rows=12).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == sequential(a, b)


@pytest.mark.parametrize("run_rows", [10**6, 2])
def test_rows_without_a_number(spark, run_rows):
    """They take part and come last."""
    day = datetime.date(2024, 1, 1)
    a = [(None, "", day, 100, ""), (5, "x", day, 100, ""), (6, "x", day, 100, "")]
    b = [(None, "", day, 100, ""), (None, "", day, 100, ""), (7, "x", day, 101, ""), (1, "", day, 900, "")]
    got = ledger.match_pairs(frame(spark, a), frame(spark, b), run_rows=run_rows).collect()
    assert sorted(((r.a_row, r.b_row) for r in got), key=str) == [(5, 7), (6, None), (None, None)]


def test_a_number_of_b_is_taken_once(spark):
    day = datetime.date(2024, 1, 1)
    a = [(1, "", day, 100, ""), (2, "", day, 100, ""), (2, "", day, 100, ""), (3, "c", None, 101, "")]
    b = [(7, "", day, 100, ""), (7, "c", day, 101, ""), (8, "", day, 101, ""), (7, "", day, 900, "")]
    got = ledger.match_pairs(frame(spark, a), frame(spark, b)).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == [(1, 7), (2, 8)]


def test_amounts_far_apart_and_cents_beyond_a_double(spark):
    """Amounts meet at a cent's distance, however large they are."""
    day, big = datetime.date(2024, 1, 1), 10**17 + 1
    a = [(1, "", day, big, ""), (2, "", day, -big, ""), (3, "", day, 0, "")]
    b = [(4, "", day, big + 2, ""), (5, "", day, big - 1, ""), (6, "", day, -big - 1, ""), (7, "", day, 2, "")]
    got = ledger.match_pairs(frame(spark, a), frame(spark, b)).collect()
    assert sorted((r.a_row, r.b_row) for r in got) == [(1, 5), (2, 6)]
