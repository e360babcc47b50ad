"""The verbs on a file stream that is read to its end."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablekit.operators import clean, edit
from tablekit.streaming import events


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i), "x " if i % 2 else None, float(i - 3)) for i in range(6)] + [(5, t + datetime.timedelta(hours=5), "x", 2.0)]
    spark.createDataFrame(rows, "id long, ts timestamp, s string, amount double").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("id long, ts timestamp, s string, amount double").parquet(str(tmp_path / "in"))


def test_row_local_verbs(stream):
    out = clean.fill_missing(clean.trim_cells(edit.filter_rows(stream, {"amount": {"$gt": -3}})), {"s": "none"})
    assert sorted(r.s for r in run(out, "local_verbs")) == ["none", "none", "x", "x", "x", "x"]


def test_rules(stream):
    found = run(events.validate(stream, {"s": {"required": True}, "amount": {"min": -2}}, "id"), "rule_errors")
    assert sorted((r._row, r.column, r.rule) for r in found) == [
        (0, "amount", "min"), (0, "s", "required"), (2, "s", "required"), (4, "s", "required"),
    ]
    with pytest.raises(ValueError):
        events.validate(stream, {"id": {"unique": True}}, "id")


def test_dedup_and_windows(stream):
    assert len(run(events.deduplicate(stream, ["id"], "ts"), "once")) == 6
    flow = run(events.cashflow(stream, "ts"), "flow", "complete")
    assert [(float(r.inflow), float(r.outflow)) for r in flow] == [(5.0, 6.0)]
    logs = stream.select("ts", F.concat(F.lit("ERROR code "), F.col("id").cast("string")).alias("value"))
    assert sum(r.lines for r in run(events.log_counts(logs, "ts", window="1 day"), "logs", "complete")) == 7
