"""Queries over streams: the event table arrives in deliveries and is read to its end.

Each delivery is written to the shared folder and processed by a run of its
own with the same checkpoint, as a scheduled job would; the watermark that one
run leaves decides which rows of the next are late.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.plans.registry import query
from tablekit.session import new_folder
from tablekit.streaming import events

# Days before the 16th, the days from then on, and a tenth of all events long after.
DELIVERY = "CASE WHEN event_id % 10 = 0 THEN 2 WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END"
DAYS = 2
# Watermarks after each delivery: the latest event so far, less the delay.
MARKS = f"""e AS (SELECT *, {DELIVERY} AS delivery FROM events),
  w AS (SELECT max(ts) FILTER (delivery = 0) - INTERVAL {DAYS} DAY AS w0, max(ts) FILTER (delivery <= 1) - INTERVAL {DAYS} DAY AS w1,
    max(ts) - INTERVAL {DAYS} DAY AS w2 FROM e),
  m AS (SELECT e.*, CASE delivery WHEN 0 THEN TIMESTAMP '1970-01-01' WHEN 1 THEN w0 ELSE w1 END AS mark, w2 FROM e, w)"""


def deliveries(t):
    late, second = F.col("event_id") % 10 == 0, F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    # A watermark needs an instant, not a wall clock time.
    timed = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return [timed.filter(~late & ~second), timed.filter(~late & second), timed.filter(late)]


def arrived(t, verb):
    """The table that ``verb`` leaves after all deliveries."""
    inbox, folders = new_folder(t.spark), (new_folder(t.spark), new_folder(t.spark))
    for delivery in deliveries(t):
        delivery.write.mode("append").parquet(inbox)
        out = events.run_to_end(verb(t.spark.readStream.schema(delivery.schema).parquet(inbox)), *folders)
    return out


@query(
    "str1_stream_rules",
    """SELECT event_id AS _row, 'value' AS "column", 'max' AS rule FROM events WHERE value > 30
       UNION ALL SELECT event_id, 'event_type', 'enum' FROM events WHERE event_type NOT IN ('click', 'view')""",
)
def _(t):
    checks = {"value": {"max": 30}, "event_type": {"enum": ["click", "view"]}}
    return arrived(t, lambda s: events.validate(s, checks, "event_id")).select("_row", "column", "rule")


@query(
    "str2_stream_dedup",
    f"""WITH {MARKS} SELECT user_id, CAST(ts AS DATE) AS day FROM m WHERE ts > mark GROUP BY ALL""",
)
def _(t):
    """One row per user and day; a day's later rows come within the delay, rows behind the watermark are dropped."""
    def verb(s):
        daily = s.select("user_id", F.date_trunc("day", "ts").alias("day"), "ts")
        return events.deduplicate(daily, ["user_id", "day"], "ts", f"{DAYS} days").select("user_id", F.col("day").cast("date").alias("day"))

    return arrived(t, verb)


@query(
    "str3_stream_cashflow",
    f"""WITH {MARKS}, k AS (SELECT date_trunc('day', ts) AS start, CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END AS amount, w2
           FROM m WHERE date_trunc('day', ts) + INTERVAL 1 DAY > mark)
       SELECT start, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS BIGINT) AS inflow, CAST(sum(CASE WHEN amount <= 0 THEN -amount ELSE 0 END) AS BIGINT) AS outflow
       FROM k WHERE start + INTERVAL 1 DAY <= w2 GROUP BY start""",
)
def _(t):
    """Daily sums; a day is given out once the watermark has passed its end, rows that come after that are dropped."""
    amount = F.when(F.col("event_type") == "error", -F.col("event_id")).otherwise(F.col("event_id"))
    out = arrived(t, lambda s: events.cashflow(s.withColumn("amount", amount), "ts", "1 day", f"{DAYS} days"))
    return out.select("start", F.col("inflow").cast("bigint").alias("inflow"), F.col("outflow").cast("bigint").alias("outflow"))


@query(
    "str3_stream_log_counts",
    f"""WITH {MARKS}, k AS (SELECT date_trunc('hour', ts) AS start, event_type, w2 FROM m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
       SELECT start, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CAST(count(*) AS BIGINT) AS lines
       FROM k WHERE start + INTERVAL 1 HOUR <= w2 GROUP BY ALL""",
)
def _(t):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    lines = F.concat(level, F.lit(" event "), F.col("event_id").cast("string"))
    out = arrived(t, lambda s: events.log_counts(s.withColumn("value", lines), "ts", "value", "1 hour", f"{DAYS} days"))
    return out.groupBy("start", "level").agg(F.sum("lines").alias("lines"))
