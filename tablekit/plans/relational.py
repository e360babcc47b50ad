"""Queries over projections, filters, edits, sorts, joins and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import agg, edit, joins
from tablekit.operators.rows import dense_rows
from tablekit.plans.registry import query

# --- projection, filter, edits ---------------------------------------------


@query("prj1_select", "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders")
def _(t):
    return edit.select(t.orders, ["o_orderkey", "o_totalprice", "note"])


@query("prj2_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(t):
    return edit.drop(t.orders, ["o_orderpriority", "unknown"])


@query(
    "prj3_rename",
    "SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def _(t):
    return edit.rename(t.orders, {"o_orderkey": "id", "o_orderstatus": "status", "nope": "x"})


@query(
    "prj4_reorder_columns",
    "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders",
)
def _(t):
    return edit.reorder_columns(t.orders, ["o_totalprice", "unknown", "o_orderkey"])


@query(
    "prj5_reorder_rows",
    """SELECT p.i AS position, n_nationkey, n_name FROM
       (SELECT unnest([24, 0, 3, 3, 99]) AS k, unnest([0, 1, 2, 3, 4]) AS i) p
       JOIN (SELECT row_number() OVER (ORDER BY n_name) - 1 AS r, * FROM nation) ON r = p.k""",
)
def _(t):
    placed = dense_rows(t.nation.select("n_nationkey", "n_name"), ["n_name"], "position")
    return edit.reorder_rows(placed, [24, 0, 3, 3, 99], row="position")


@query(
    "prj6_transform",
    """SELECT event_id AS id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, upper(event_type) AS kind,
       CAST(user_id AS VARCHAR) || ':' || event_type AS who FROM events""",
)
def _(t):
    df = t.events.withColumn("props", F.parse_json("props"))
    out = edit.transform(
        df,
        {
            "id": "event_id",
            "k": "props.k",
            "kind": lambda d: F.upper(d["event_type"]),
            "who": {"user": "user_id", "type": "event_type"},
        },
    )
    return out.withColumn("who", F.concat_ws(":", "who.user", "who.type"))


@query(
    "flt1_equality",
    "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2",
)
def _(t):
    return edit.filter_rows(t.lineitem, {"l_returnflag": "R", "l_linenumber": 2})


@query(
    "flt2_comparisons",
    """SELECT l_orderkey, l_quantity, l_discount FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity < 25 AND l_discount > 0.05 AND l_tax <= 0.06
         AND nullif(l_returnflag, 'N') IS DISTINCT FROM 'A'""",
)
def _(t):
    df = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return edit.filter_rows(
        df,
        {
            "l_quantity": {"$gte": 10, "$lt": 25},
            "l_discount": {"$gt": 0.05},
            "l_tax": {"$lte": 0.06},
            "flag": {"$ne": "A"},
        },
    ).select("l_orderkey", "l_quantity", "l_discount")


@query(
    "flt3_in",
    """SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem
       WHERE l_linenumber IN (1, 3) AND (nullif(l_returnflag, 'N') = 'A' OR nullif(l_returnflag, 'N') IS NULL)""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return edit.filter_rows(df, {"l_linenumber": {"$in": [1, 3]}, "flag": {"$in": ["A", None]}})


@query("flt4_like", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED.*get')")
def _(t):
    return edit.filter_rows(t.part, {"p_name": {"$like": "RED%get"}}).select("p_partkey", "p_name")


@query(
    "flt5_callable",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 AND l_linestatus = 'O'",
)
def _(t):
    return edit.filter_rows(
        t.lineitem,
        lambda d: (d.l_extendedprice * (1 - d.l_discount) > 50000) & (d.l_linestatus == "O"),
    ).select("l_orderkey", "l_extendedprice")


@query(
    "edt1_update",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN 0 END AS open_items FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return edit.update(df, {"o_orderstatus": "F"}, {"o_orderstatus": "done", "open_items": 0})


@query(
    "edt2_insert",
    """SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region
       UNION ALL SELECT r_regionkey + 100, NULL, upper(r_name) FROM region""",
)
def _(t):
    extra = t.region.select(
        (F.col("r_regionkey") + 100).alias("r_regionkey"), F.upper("r_name").alias("note")
    )
    return edit.insert(t.region, extra)


@query(
    "edt3_delete",
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'",
)
def _(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return edit.delete(df, lambda d: d.status == "F")


@query(
    "set1_union_all",
    """SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation
       UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def _(t):
    a = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    b = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return edit.union_all(a, b)


# --- order ------------------------------------------------------------------


@query(
    "srt1_sort",
    """SELECT o_orderkey, status, row_number() OVER (ORDER BY status DESC NULLS LAST, o_orderkey) - 1 AS position
       FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)""",
)
def _(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return edit.with_position(df, [*edit.sort_order(df, "status", "desc"), F.col("o_orderkey")])


@query(
    "srt2_sheet_sort",
    """SELECT o_orderkey, price, row_number() OVER (ORDER BY price ASC NULLS LAST, o_orderkey) - 1 AS position
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)""",
)
def _(t):
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")
    )
    return edit.with_position(
        df, [*edit.sort_order(df, "price", nulls_last=True), F.col("o_orderkey")]
    )


@query(
    "srt3_transactions",
    """SELECT o_custkey AS account, o_orderkey, o_totalprice AS amount FROM orders
       ORDER BY account, amount DESC, o_orderkey""",
)
def _(t):
    df = t.orders.select(
        F.col("o_custkey").alias("account"), "o_orderkey", F.col("o_totalprice").alias("amount")
    )
    return edit.sort_transactions(df, "amount", "desc", row="o_orderkey")


@query(
    "srt4_natural_sort",
    """SELECT p_partkey, label, row_number() OVER (ORDER BY lower(p_name), p_size, p_partkey) - 1 AS position
       FROM (SELECT p_partkey, p_name, p_size, upper(p_name) || ' ' || p_size AS label FROM part)""",
)
def _(t):
    df = t.part.select("p_partkey", F.concat_ws(" ", F.upper("p_name"), "p_size").alias("label"))
    return edit.with_position(df, [*edit.sort_order(df, "label", kind="natural"), F.col("p_partkey")])


@query(
    "lim2_head_items",
    """SELECT doc_id, len(string_split(text, chr(10))) AS lines,
       array_to_string(list_slice(string_split(text, chr(10)), 1, 15), '|') AS sample FROM documents""",
)
def _(t):
    lines = F.split("text", "\n", -1)
    return t.documents.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("lines"),
        F.array_join(edit.head_items(lines, 15), "|").alias("sample"),
    )


# --- joins ------------------------------------------------------------------


@query(
    "joi1_inner",
    """SELECT o_orderkey, o_custkey AS custkey, c_name, c_mktsegment AS label
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    a = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("label"))
    b = t.customer.select(
        F.col("c_custkey").alias("custkey"), "c_name", F.col("c_mktsegment").alias("label")
    )
    return joins.join(a, b, "custkey")


@query(
    "joi2_left",
    """SELECT c_custkey AS custkey, CASE WHEN o_orderkey IS NOT NULL THEN o_orderpriority ELSE c_mktsegment END AS label,
       o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("label"))
    b = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("label"), "o_orderkey"
    )
    return joins.join(a, b, "custkey", how="left")


@query(
    "joi3_keyed_comparison",
    """WITH a AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
            b AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
       SELECT CAST(coalesce(a.o_custkey, b.o_custkey) AS VARCHAR) AS custkey, a.k AS a_order, b.k AS b_order
       FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
)
def _(t):
    slim = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    a = slim.filter("o_orderstatus <> 'P'").withColumn("_row", F.col("o_orderkey"))
    b = slim.filter("o_orderstatus <> 'F'").withColumn("_row", F.col("o_orderkey"))
    return joins.comparison_join(a, b, ["o_custkey"]).select(
        F.col("_key0").alias("custkey"),
        F.col("a.o_orderkey").alias("a_order"),
        F.col("b.o_orderkey").alias("b_order"),
    )


@query(
    "joi4_positional",
    """WITH a AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS r, n_name FROM nation),
            b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS r, s_name FROM supplier)
       SELECT coalesce(a.r, b.r) AS position, n_name, s_name FROM a FULL JOIN b ON a.r = b.r""",
)
def _(t):
    a = dense_rows(t.nation.select("n_name"), ["n_name"])
    b = dense_rows(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"])
    return joins.positional_join(a, b).select(
        F.col("_row").alias("position"), F.col("a.n_name").alias("n_name"), F.col("b.s_name").alias("s_name")
    )


@query(
    "joi5_only_in_one",
    """SELECT 'added' AS side, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN
         (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
       UNION ALL SELECT 'removed', o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN
         (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    slim = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    p, f = slim.filter("o_orderstatus = 'P'"), slim.filter("o_orderstatus = 'F'")
    added = joins.only_in_left(f, p, ["o_custkey"]).withColumn("side", F.lit("added"))
    removed = joins.only_in_left(p, f, ["o_custkey"]).withColumn("side", F.lit("removed"))
    return added.unionByName(removed).select("side", "o_custkey", "o_orderkey")


@query(
    "joi7_lookup",
    """SELECT s_suppkey, coalesce(n_name, '#N/A') AS nation
       FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey""",
)
def _(t):
    table = t.nation.filter("n_nationkey < 20").withColumn("_row", F.col("n_nationkey"))
    df = joins.lookup(t.supplier, "s_nationkey", table, 2, out="nation")
    return df.select("s_suppkey", "nation")


NAME_RULES = [("RED", "warm"), ("ring", "jewel"), ("blue", "cold"), ("small", "little")]


@query(
    "joi8_first_rule",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'ring') THEN 'jewel'
       WHEN contains(lower(p_name), 'blue') THEN 'cold' WHEN contains(lower(p_name), 'small') THEN 'little' END AS category
       FROM part""",
)
def _(t):
    return t.part.select("p_partkey", joins.first_rule(F.col("p_name"), NAME_RULES).alias("category"))


# Ten thousand numbered rules, the larger numbers first, then some that many texts hold.
MANY_RULES = [(f"№{n}É", f"number {n}") for n in range(10_000, 0, -1)] + [("BLUE", "cold"), ("e№", "ends in e"), ("a", "has a"), ("", "other")]


@query(
    "joi8_many_rules",
    """WITH r AS (SELECT 10000 - n AS rule, '№' || n || 'é' AS pattern, 'number ' || n AS category FROM range(1, 10001) t(n)
         UNION ALL SELECT 10000 + i, pattern, category FROM (VALUES (1, 'blue', 'cold'), (2, 'e№', 'ends in e'), (3, 'a', 'has a'), (4, '', 'other')) v(i, pattern, category)),
       x AS (SELECT p_partkey, CASE WHEN p_partkey % 10 < 3 THEN lower(p_name || '№' || p_partkey || 'É') ELSE lower(p_name || '№') END AS text FROM part)
       SELECT p_partkey, (SELECT arg_min(category, rule) FROM r WHERE contains(text, pattern)) AS category FROM x""",
)
def _(t):
    mark = F.when(F.col("p_partkey") % 10 < 3, F.concat(F.col("p_partkey").cast("string"), F.lit("É"))).otherwise("")
    text = F.concat("p_name", F.lit("№"), mark)
    return t.part.select("p_partkey", joins.first_rule(text, MANY_RULES).alias("category"))



# --- groups -----------------------------------------------------------------


@query(
    "agg1_group_by",
    """SELECT coalesce(nullif(l_returnflag, 'N'), '(null)') AS flag, l_linestatus AS status, count(*) AS n,
       floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS total, floor(avg(l_quantity) * 100 + 0.5) / 100 AS mean_qty,
       min(l_discount) AS low, max(l_tax) AS high
       FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    df = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N"))).withColumnRenamed(
        "l_linestatus", "status"
    )
    return agg.group_by(
        df,
        ["flag", "status"],
        {
            "n": ("count", None),
            "total": ("sum", "l_extendedprice"),
            "mean_qty": ("avg", "l_quantity"),
            "low": ("min", "l_discount"),
            "high": ("max", "l_tax"),
        },
    )


@query("agg2_count", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return agg.group_by(t.lineitem, "l_linestatus", {"n": ("count", None)})


@query(
    "agg3_sum_avg",
    """SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, floor(sum(CAST(q AS DOUBLE)) * 100 + 0.5) / 100 AS total,
       floor(avg(CAST(q AS DOUBLE)) * 100 + 0.5) / 100 AS mean, floor(sum(coalesce(CAST(q AS DOUBLE), 0)) / count(*) * 100 + 0.5) / 100 AS mean_zero
       FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q FROM lineitem) GROUP BY 1""",
)
def _(t):
    # Text cells, some blank and some not numbers.
    df = t.lineitem.select(
        "l_suppkey",
        F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.col("l_quantity").cast("string")).alias("q"),
    )
    plain = agg.group_by(df, "l_suppkey", {"total": ("sum", "q"), "mean": ("avg", "q")})
    zero = agg.group_by(df, "l_suppkey", {"mean_zero": ("avg", "q")}, blank_as_zero=True)
    return plain.join(zero, "l_suppkey")


@query(
    "agg4_min_max",
    """SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""",
)
def _(t):
    return agg.group_by(
        t.lineitem, "l_returnflag", {"low": ("min", "l_extendedprice"), "high": ("max", "l_extendedprice")}
    )


@query(
    "agg5_first_last",
    """SELECT event_type, arg_min(value, event_id) AS first_value, arg_max(props, event_id) AS last_props
       FROM events GROUP BY 1""",
)
def _(t):
    return agg.group_by(
        t.events,
        "event_type",
        {"first_value": ("first", "value"), "last_props": ("last", "props")},
        row="event_id",
    )


@query(
    "agg6_pivot_sum",
    """SELECT l_suppkey, floor(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) * 100 + 0.5) / 100 AS A,
       floor(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) * 100 + 0.5) / 100 AS N,
       floor(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) * 100 + 0.5) / 100 AS R
       FROM lineitem GROUP BY 1""",
)
def _(t):
    return agg.pivot(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity", "sum")


@query(
    "agg7_pivot_count",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
       count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view
       FROM events GROUP BY 1""",
)
def _(t):
    return agg.pivot(
        t.events, "user_id", "event_type", "value", "count", ["click", "error", "purchase", "view"]
    )


@query(
    "agg8_pivot_first",
    """SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click' AND value <> 0) AS click,
       arg_min(value, event_id) FILTER (event_type = 'view' AND value <> 0) AS view FROM events GROUP BY 1""",
)
def _(t):
    return agg.pivot(
        t.events, "user_id", "event_type", "value", "first", ["click", "view"], row="event_id"
    )


@query(
    "agg9_cardinality",
    """SELECT coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, '(undefined)') AS value, count(*) AS count
       FROM events GROUP BY 1""",
)
def _(t):
    return agg.cardinality(t.events, F.when(F.col("event_id") % 5 != 0, F.col("event_type")))


@query(
    "agg10_distinct_count",
    "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT props) AS props FROM events",
)
def _(t):
    return agg.distinct_count(t.events, ["user_id", "event_type", "props"])


@query(
    "agg12_distinct_keys",
    """SELECT DISTINCT unnest(json_keys(p)) AS key FROM
       (SELECT CASE WHEN event_id % 3 = 0 THEN json_object('id', event_id, event_type, 1) ELSE props END AS p FROM events)""",
)
def _(t):
    built = F.to_json(F.map_from_arrays(F.array(F.lit("id"), F.col("event_type")), F.array(F.col("event_id"), F.lit(1).cast("bigint"))))
    df = t.events.select(F.when(F.col("event_id") % 3 == 0, built).otherwise(F.col("props")).alias("p"))
    return agg.distinct_keys(df, "p")


@query(
    "agg13_median",
    "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1",
)
def _(t):
    return agg.median(t.lineitem, ["l_returnflag"], "l_extendedprice")
