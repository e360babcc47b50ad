"""Queries over diffs, profiles, cleaning and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import agg, clean, diff, profile, rules
from tablekit.operators.rows import dense_rows
from tablekit.plans.registry import query

# --- diffs ------------------------------------------------------------------

# A second version of the orders: some removed, some changed, some added.
ORDERS_B = """SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 7 = 0 THEN ' ' || o_orderpriority ELSE o_orderpriority END
    AS o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_orderkey % 17 <> 0"""


def _order_pair(t):
    a = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    key, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    b = a.filter(key % 17 != 0).select(
        F.when(key % 13 == 0, key + 10000000).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        F.when(key % 11 == 0, F.lower(prio)).when(key % 7 == 0, F.concat(F.lit(" "), prio)).otherwise(prio).alias("o_orderpriority"),
        F.when(key % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return a.withColumn("_row", key), b.withColumn("_row", key)


@query(
    "dif1_table_diff",
    f"""WITH b AS ({ORDERS_B})
       SELECT CAST(a.o_orderkey AS VARCHAR) AS o_orderkey, 'o_orderpriority' AS "column", a.o_orderpriority AS old, b.o_orderpriority AS new
       FROM orders a JOIN b USING (o_orderkey) WHERE trim(a.o_orderpriority) <> trim(b.o_orderpriority)
       UNION ALL SELECT CAST(a.o_orderkey AS VARCHAR), 'o_orderstatus', a.o_orderstatus, b.o_orderstatus
       FROM orders a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus""",
)
def _(t):
    a, b = _order_pair(t)
    return diff.cell_changes(diff.table_diff(a, b, ["o_orderkey"]))


@query(
    "dif2_positional_diff",
    """WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r, n_name FROM nation),
            b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name
                  FROM nation WHERE n_nationkey <> 20)
       SELECT coalesce(a.r, b.r) AS position, CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed'
         WHEN a.n_name <> b.n_name THEN 'modified' ELSE 'unchanged' END AS status, CASE WHEN a.n_name <> b.n_name THEN b.n_name END AS new
       FROM a FULL JOIN b ON a.r = b.r""",
)
def _(t):
    a = dense_rows(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).drop("n_nationkey")
    changed = F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    b = dense_rows(
        t.nation.filter("n_nationkey <> 20").select("n_nationkey", changed.alias("n_name")), ["n_nationkey"]
    ).drop("n_nationkey")
    return diff.table_diff(a, b).select(
        F.col("_row").alias("position"), "status", F.get(F.col("changes.new"), F.lit(0)).alias("new")
    )


@query(
    "dif3_diff_summary",
    f"""WITH b AS ({ORDERS_B}), j AS (
         SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, lower(trim(a.o_orderpriority)) IS DISTINCT FROM lower(trim(b.o_orderpriority))
           OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS m FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
       SELECT count(ka) AS total_a, count(kb) AS total_b, count(*) FILTER (ka IS NULL) AS added, count(*) FILTER (kb IS NULL) AS removed,
         count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND m) AS modified,
         count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND NOT m) AS unchanged, false AS identical FROM j""",
)
def _(t):
    a, b = _order_pair(t)
    return diff.diff_summary(diff.table_diff(a, b, ["o_orderkey"], ignore_case=True))


CONV_B = """SELECT conv_id, CASE WHEN turn % 5 = 4 THEN turn + 1000 ELSE turn END AS turn,
  CASE WHEN turn % 3 = 1 THEN upper(text) WHEN turn % 3 = 2 THEN '  ' || text ELSE text END AS text FROM conversations"""


@query(
    "dif11_page_diff",
    f"""WITH b AS ({CONV_B})
       SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn,
         CASE WHEN a.turn IS NULL THEN 'ADDED_PAGE' WHEN b.turn IS NULL THEN 'REMOVED_PAGE' ELSE 'MODIFIED' END AS change
       FROM conversations a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn
       WHERE a.turn IS NULL OR b.turn IS NULL OR trim(a.text) <> trim(b.text)""",
)
def _(t):
    turn, text = F.col("turn"), F.col("text")
    b = t.conversations.select(
        "conv_id",
        F.when(turn % 5 == 4, turn + 1000).otherwise(turn).alias("turn"),
        F.when(turn % 3 == 1, F.upper(text)).when(turn % 3 == 2, F.concat(F.lit("  "), text)).otherwise(text).alias("text"),
    )
    return diff.page_diff(t.conversations, b, "conv_id", "turn").select("conv_id", "turn", "change")


@query(
    "dif12_line_diff",
    """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS s FROM documents),
            b AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'the', 'THE') ELSE text || chr(10) || 'end' END, chr(10))) AS line, 1 AS s FROM documents)
       SELECT doc_id, line, CASE WHEN sum(s) > 0 THEN 'added' ELSE 'removed' END AS status, CAST(abs(sum(s)) AS BIGINT) AS times
       FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id, line HAVING sum(s) <> 0""",
)
def _(t):
    a = t.documents.select("doc_id", "text")
    return diff.line_counts_diff(a, _edited_documents(a), "doc_id", ignore_endings=False)


def _edited_documents(a):
    text = F.col("text")
    return a.withColumn(
        "text",
        F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit("the"), F.lit("THE"))).otherwise(
            F.concat(text, F.lit("\nend"))
        ),
    )


@query("dif12_line_edits")
def _(t):
    a = t.documents.select("doc_id", "text")
    return diff.line_edits(a, _edited_documents(a), "doc_id")


@query("dif13_edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_brand) AS INTEGER) AS distance FROM part")
def _(t):
    return t.part.select("p_partkey", diff.edit_distance(F.col("p_name"), F.col("p_brand")).alias("distance"))


# --- profiles ---------------------------------------------------------------

# The event table with blanks: some types empty, some values missing, one column mixed.
EVENTS = """SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props,
  CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END AS mixed,
  CASE WHEN event_id % 4 = 0 THEN 'TRUE' ELSE 'false' END AS flag, strftime(ts, '%Y-%m-%d') AS day FROM events"""
EVENT_COLS = ["event_id", "user_id", "event_type", "value", "props", "mixed", "flag", "day"]


def blank_events(t):
    i = F.col("event_id")
    return t.events.select(
        "event_id",
        "user_id",
        F.when(i % 5 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 7 != 0, F.col("value")).alias("value"),
        "props",
        F.when(i % 11 == 0, F.lit("n/a"))
        .when(i % 3 == 0, F.col("user_id").cast("string"))
        .otherwise(F.concat((i % 100).cast("string"), F.lit(".5")))
        .alias("mixed"),
        F.when(i % 4 == 0, F.lit("TRUE")).otherwise(F.lit("false")).alias("flag"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        i.alias("_row"),
    )


CELLS = "WITH e AS (" + EVENTS + "), c AS (" + " UNION ALL ".join(
    f"SELECT event_id AS r, '{c}' AS col, nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM e" for c in EVENT_COLS
) + ")"

CLASSED = CELLS + """, k AS (SELECT col, v, CASE WHEN v IS NULL THEN NULL WHEN lower(v) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+([eE][+-]?[0-9]+)?') THEN 'float'
  WHEN length(v) >= 8 AND regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}.*') THEN 'date' ELSE 'string' END AS kind FROM c)"""


@query(
    "prf1_column_profile",
    CLASSED
    + """, p AS (SELECT col, count(*) AS total, count(v) AS non_null, count(*) - count(v) AS missing, count(DISTINCT v) AS distinct_values,
         count(*) FILTER (kind = 'integer') AS ints, count(*) FILTER (kind = 'float') AS floats, count(*) FILTER (kind = 'boolean') AS bools,
         count(*) FILTER (kind = 'date') AS dates, count(*) FILTER (kind = 'string') AS strings FROM k GROUP BY col)
       SELECT col AS "column", total, non_null, missing, missing / total AS missing_rate, distinct_values,
         floor(distinct_values / non_null * 100 + 0.5) / 100 AS cardinality_ratio, ints AS integer_cells, floats AS float_cells,
         bools AS boolean_cells, dates AS date_cells, strings AS string_cells,
         CASE WHEN ints = non_null THEN 'integer' WHEN ints + floats = non_null THEN 'number' WHEN bools = non_null THEN 'boolean'
           WHEN dates = non_null THEN 'date' WHEN (ints + floats) / non_null > 0.8 THEN 'mixed (predominantly numeric)' ELSE 'string' END AS inferred_type
       FROM p""",
)
def _(t):
    p = profile.column_profile(blank_events(t))
    return p.drop("min_value", "max_value", "avg_value", "sum_value", "min_length", "max_length")


@query(
    "prf2_numeric_stats",
    CLASSED
    + """, n AS (SELECT col, v, CASE WHEN kind IN ('integer', 'float') THEN TRY_CAST(v AS DOUBLE) END AS x FROM k)
       SELECT col AS "column", min(x) AS min_value, max(x) AS max_value, floor(avg(x) * 100 + 0.5) / 100 AS avg_value,
         floor(sum(x) * 100 + 0.5) / 100 AS sum_value, CASE WHEN count(x) = 0 THEN CAST(min(length(v)) AS INTEGER) END AS min_length,
         CASE WHEN count(x) = 0 THEN CAST(max(length(v)) AS INTEGER) END AS max_length FROM n GROUP BY col""",
)
def _(t):
    return profile.column_profile(blank_events(t)).select(
        "column", "min_value", "max_value", "avg_value", "sum_value", "min_length", "max_length"
    )


@query(
    "prf3_top_frequencies",
    CELLS
    + """, f AS (SELECT col, v, count(*) AS n, min(r) AS first FROM c GROUP BY col, v), s AS (SELECT col, sum(n) AS total FROM f GROUP BY col),
         t AS (SELECT col, v, n, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, first) AS INTEGER) AS rank FROM f WHERE v IS NOT NULL)
       SELECT col AS "column", rank, v AS value, n AS count, CAST(floor(n / total * 100 + 0.5) AS INTEGER) AS percentage
       FROM t JOIN s USING (col) WHERE rank <= 3""",
)
def _(t):
    return profile.top_frequencies(blank_events(t))


@query(
    "lim1_top_values",
    """SELECT 'event_type' AS "column", event_type AS value, count(*) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS INTEGER) AS rank FROM events GROUP BY 2 QUALIFY rank <= 3""",
)
def _(t):
    cells = t.events.select(
        F.lit("event_type").alias("column"), F.col("event_type").alias("value"), F.col("event_id").alias("_row")
    )
    return agg.top_values(cells, 3)


@query(
    "prf4_anomalies",
    """SELECT 'DUPLICATE_ROWS' AS type, NULL AS "column", (SELECT count(*) FROM labels) - (SELECT count(*) FROM (SELECT DISTINCT quality, toxic FROM labels)) AS count, CAST(NULL AS DOUBLE) AS rate
       UNION ALL SELECT 'HIGH_MISSING_RATE', 'note', count(*) FILTER (quality = 1 OR doc_id % 2 = 0), count(*) FILTER (quality = 1 OR doc_id % 2 = 0) / count(*) FROM labels
       HAVING count(*) FILTER (quality = 1 OR doc_id % 2 = 0) / count(*) > 0.5""",
)
def _(t):
    df = t.labels.withColumn(
        "note", F.when((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0), F.lit("")).otherwise(F.lit("x"))
    )
    found = profile.anomalies(df.drop("doc_id").drop("note"))
    return found.unionByName(profile.anomalies(df.select("doc_id", "note").withColumnRenamed("doc_id", "_row")).filter(
        "type = 'HIGH_MISSING_RATE'"
    ))


LOG_LINE = """strftime(ts, '%Y-%m-%d') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'Warning' WHEN 'view' THEN 'info' ELSE 'note' END
  || ' user ' || user_id || ' did "' || event_type || '" in ' || CAST(event_id % 97 AS VARCHAR) || ' ms'"""


@query(
    "prf16_log_audit",
    f"""WITH l AS (SELECT {LOG_LINE} AS line, event_type FROM events)
       SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'INFO' ELSE 'NONE' END AS level,
         regexp_replace(regexp_replace(line, '"[^"]*"', '<text>', 'g'), '[0-9]+([.][0-9]+)?', '<n>', 'g') AS template,
         count(*) AS lines, min(line) AS example FROM l GROUP BY 1, 2""",
)
def _(t):
    kind = F.col("event_type")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd"),
        F.lit(" "),
        F.when(kind == "error", "ERROR").when(kind == "click", "Warning").when(kind == "view", "info").otherwise("note"),
        F.lit(" user "),
        F.col("user_id").cast("string"),
        F.lit(' did "'),
        kind,
        F.lit('" in '),
        (F.col("event_id") % 97).cast("string"),
        F.lit(" ms"),
    )
    return profile.log_audit(t.events.select(line.alias("value")))


# --- cleaning ---------------------------------------------------------------


@query(
    "cln1_trim",
    "SELECT c_custkey, c_name, c_mktsegment || chr(9) || '.' AS c_mktsegment FROM customer",
)
def _(t):
    df = t.customer.select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("c_name"),
        F.concat("c_mktsegment", F.lit("\t. ")).alias("c_mktsegment"),
    )
    return clean.trim_cells(df)


@query(
    "cln2_headers",
    "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS acct_bal FROM customer",
)
def _(t):
    df = t.customer.select(
        F.col("c_custkey").alias("custKey"), F.col("c_name").alias(" Full Name "), F.col("c_acctbal").alias("Acct--Bal!")
    )
    return clean.normalise_headers(df, "snake_case")


@query(
    "cln3_dedup",
    """SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) = 1""",
)
def _(t):
    df = t.labels.withColumn("_row", F.col("doc_id"))
    both = clean.dedup(df.drop("doc_id"))
    return both.select(F.col("_row").alias("doc_id"), "quality", "toxic")


@query(
    "cln3_dedup_by_key",
    "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1",
)
def _(t):
    return clean.dedup(t.events, ["event_type", "user_id"], row="event_id").select("event_type", "event_id", "value")


@query(
    "cln4_drop_empty_rows",
    """SELECT * FROM (SELECT event_id AS _row, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END AS a,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS b FROM events) WHERE trim(a) <> '' OR b IS NOT NULL""",
)
def _(t):
    i = F.col("event_id")
    df = t.events.select(
        i.alias("_row"),
        F.when(i % 3 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("a"),
        F.when(i % 2 != 0, F.col("value")).alias("b"),
    )
    return clean.drop_empty_rows(df)


@query("cln5_drop_empty_columns", "SELECT event_id, event_type FROM events")
def _(t):
    df = t.events.select("event_id", "event_type", F.lit(" ").alias("blank"), F.lit(None).cast("double").alias("none"))
    return clean.drop_empty_columns(df)


@query(
    "cln6_fill_missing",
    f"SELECT event_id, CASE WHEN trim(event_type) = '' THEN 'unknown' ELSE event_type END AS event_type, coalesce(value, -1) AS value FROM ({EVENTS})",
)
def _(t):
    df = blank_events(t).select("event_id", "event_type", "value")
    return clean.fill_missing(df, {"event_type": "unknown", "value": -1, "nope": 1})


@query(
    "cln7_fit_width",
    """SELECT event_id, split_part(x, ',', 1) AS a, split_part(x, ',', 2) AS b, split_part(x, ',', 3) AS b_2 FROM
       (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ',' || user_id || ',' || props || ',extra' END AS x FROM events)""",
)
def _(t):
    x = F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(
        F.array("event_type", F.col("user_id").cast("string"), "props", F.lit("extra"))
    )
    return clean.fit_width(t.events.select("event_id", x.alias("cells")), "cells", ["a", "b", "b"])


# --- rules ------------------------------------------------------------------


@query(
    "val2_required",
    """SELECT event_id AS _row, 'event_type' AS "column", 'required' AS rule FROM events WHERE event_id % 5 = 0
       UNION ALL SELECT event_id, 'value', 'required' FROM events WHERE event_id % 7 = 0""",
)
def _(t):
    df = blank_events(t).withColumn("event_type", F.trim("event_type"))
    found = rules.validate(df, {"event_type": {"required": True}, "value": {"required": True}, "props": {"required": True}})
    return found.select("_row", "column", "rule")


@query(
    "val3_types",
    r"""WITH p AS (SELECT page_id, url, 'mail' || page_id || CASE WHEN page_id % 4 = 0 THEN ' @x' ELSE '@x.org' END AS mail,
         CASE WHEN page_id % 6 = 0 THEN 'abc' ELSE CAST(page_id AS VARCHAR) || CASE WHEN page_id % 5 = 0 THEN '.5' ELSE '' END END AS n FROM pages)
       SELECT page_id AS _row, 'url' AS "column", url AS value FROM p WHERE url <> '' AND NOT regexp_full_match(url, '(?i)https?://[^\s$.?#].[^\s]*')
       UNION ALL SELECT page_id, 'mail', mail FROM p WHERE NOT regexp_full_match(mail, '[^\s@]+@[^\s@]+\.[^\s@]+')
       UNION ALL SELECT page_id, 'n', n FROM p WHERE page_id % 6 = 0 OR page_id % 5 = 0""",
)
def _(t):
    i = F.col("page_id")
    df = t.pages.select(
        i.alias("_row"),
        "url",
        F.concat(F.lit("mail"), i.cast("string"), F.when(i % 4 == 0, " @x").otherwise("@x.org")).alias("mail"),
        F.when(i % 6 == 0, F.lit("abc")).otherwise(
            F.concat(i.cast("string"), F.when(i % 5 == 0, ".5").otherwise(""))
        ).alias("n"),
    )
    found = rules.validate(df, {"url": {"type": "url"}, "mail": {"type": "email"}, "n": {"type": "integer"}})
    return found.select("_row", "column", "value")


@query(
    "val4_bounds",
    """SELECT 'l_quantity' AS "column", 'min' AS rule, count(*) AS errors FROM lineitem WHERE l_quantity < 5
       UNION ALL SELECT 'l_quantity', 'max', count(*) FROM lineitem WHERE l_quantity > 45
       UNION ALL SELECT 'l_discount', 'max', count(*) FROM lineitem WHERE l_discount > 0.08""",
)
def _(t):
    df = t.lineitem.withColumn("_row", F.col("l_orderkey"))
    return rules.violation_summary(
        rules.validate(df, {"l_quantity": {"type": "number", "min": 5, "max": 45}, "l_discount": {"max": 0.08}})
    )


@query(
    "val5_lengths",
    """SELECT p_partkey AS _row, 'minLength' AS rule, p_name AS value FROM part WHERE length(p_name) < 9
       UNION ALL SELECT p_partkey, 'maxLength', p_name FROM part WHERE length(p_name) > 12""",
)
def _(t):
    df = t.part.withColumn("_row", F.col("p_partkey"))
    return rules.validate(df, {"p_name": {"minLength": 9, "maxLength": 12}}).select("_row", "rule", "value")


@query(
    "val6_enum",
    "SELECT o_orderkey AS _row, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
)
def _(t):
    df = t.orders.withColumn("_row", F.col("o_orderkey"))
    return rules.validate(df, {"o_orderstatus": {"enum": ["F", "O"]}}).select("_row", "value")


@query(
    "val7_unique",
    """SELECT event_id AS _row, CAST(user_id AS VARCHAR) AS value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1""",
)
def _(t):
    df = t.events.withColumn("_row", F.col("event_id"))
    return rules.validate(df, {"user_id": {"unique": True}}).select("_row", "value")


@query(
    "val7_unique_of_several",
    """SELECT event_id AS _row, 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1
       UNION ALL SELECT event_id, 'event_type', event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1""",
)
def _(t):
    """A column that the table lacks is blank in every row and repeats nothing."""
    df = t.events.withColumn("_row", F.col("event_id"))
    checks = {"user_id": {"unique": True}, "absent": {"unique": True}, "event_type": {"unique": True}}
    return rules.validate(df, checks).select("_row", "column", "value")
