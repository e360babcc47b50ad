"""Queries over transactions, spreadsheet functions and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.functions import fx
from tablekit.operators import agg, grid, ledger
from tablekit.operators.rows import dense_rows
from tablekit.plans.registry import query

# The orders as bank transactions: finished orders are money out.
TX = """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS account, CAST(o_orderdate AS DATE) AS date,
  CAST(CASE o_orderstatus WHEN 'F' THEN -o_totalprice WHEN 'P' THEN 0 ELSE o_totalprice END AS DECIMAL(18, 2)) AS amount,
  'POS Customer ' || o_custkey || CASE o_custkey % 3 WHEN 0 THEN ' LLC' WHEN 1 THEN ' #12 main' ELSE '' END AS payee,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'order ' || o_orderpriority END AS memo,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS category,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS check_number FROM orders"""


def transactions(t):
    price, status, key, cust = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        key.alias("id"),
        cust.cast("string").alias("account"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(status == "F", -price).when(status == "P", 0).otherwise(price).cast("decimal(18,2)").alias("amount"),
        F.concat(
            F.lit("POS Customer "), cust.cast("string"), F.when(cust % 3 == 0, " LLC").when(cust % 3 == 1, " #12 main").otherwise("")
        ).alias("payee"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("order "), "o_orderpriority")).alias("memo"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(key % 10 == 0, key.cast("string")).otherwise("").alias("check_number"),
        key.alias("_row"),
    )


FLOW = """CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DOUBLE) AS inflow, CAST(coalesce(sum(-amount) FILTER (amount <= 0), 0) AS DOUBLE) AS outflow,
  CAST(sum(amount) AS DOUBLE) AS net"""


@query("fin3_cashflow", f"SELECT count(*) AS transactions, {FLOW} FROM ({TX})")
def _(t):
    return ledger.cashflow(transactions(t))


@query(
    "fin4_by_category",
    f"SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS transactions FROM ({TX}) GROUP BY 1",
)
def _(t):
    return ledger.by_category(transactions(t))


@query(
    "fin5_by_payee",
    f"SELECT CASE WHEN id % 9 = 0 THEN 'Unknown' ELSE payee END AS payee, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS transactions FROM ({TX}) GROUP BY 1",
)
def _(t):
    tx = transactions(t)
    return ledger.by_payee(tx.withColumn("payee", F.when(F.col("id") % 9 != 0, F.col("payee"))))


@query("fin6_by_month", f"SELECT strftime(date, '%Y-%m') AS month, {FLOW} FROM ({TX}) GROUP BY 1")
def _(t):
    return ledger.by_month(transactions(t))


@query(
    "agg11_conditional_sums",
    f"SELECT o_custkey % 10 AS bucket, {FLOW} FROM (SELECT * FROM orders JOIN ({TX}) ON id = o_orderkey) GROUP BY 1",
)
def _(t):
    tx = transactions(t).withColumn("bucket", F.col("account").cast("bigint") % 10)
    a = F.col("amount")
    return tx.groupBy("bucket").agg(
        ledger.inflow(a).cast("double").alias("inflow"),
        ledger.outflow(a).cast("double").alias("outflow"),
        F.sum(a).cast("double").alias("net"),
    )


@query(
    "prf14_statement_profile",
    f"""WITH t AS ({TX}), l AS (SELECT 'total' AS section, 'all' AS key, amount FROM t UNION ALL SELECT 'category', coalesce(nullif(category, ''), 'Uncategorized'), amount FROM t
         UNION ALL SELECT 'payee', payee, amount FROM t UNION ALL SELECT 'month', strftime(date, '%Y-%m'), amount FROM t)
       SELECT section, key, {FLOW}, count(*) AS transactions FROM l GROUP BY 1, 2""",
)
def _(t):
    return ledger.profile(transactions(t))


PART_RULES = [("widget", "tools"), ("ring", "jewels"), ("GEAR", "tools"), ("small", "small goods")]


@query(
    "fin7_categorise",
    """SELECT p_partkey, CASE WHEN contains(x, 'widget') THEN 'tools' WHEN contains(x, 'ring') THEN 'jewels' WHEN contains(x, 'gear') THEN 'tools'
         WHEN contains(x, 'small') THEN 'small goods' ELSE p_type END AS category FROM (SELECT *, lower(p_name || ' ' || p_brand) AS x FROM part)""",
)
def _(t):
    df = t.part.select("p_partkey", F.col("p_name").alias("payee"), F.col("p_brand").alias("memo"), F.col("p_type").alias("category"))
    return ledger.categorise(df, PART_RULES).select("p_partkey", "category")


@query(
    "fin8_qif_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS slash, CAST(o_orderdate AS DATE) AS apostrophe, CAST(o_orderdate AS DATE) AS iso FROM orders""",
)
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        ledger.qif_date(F.date_format(d, "M/d/yyyy")).alias("slash"),
        ledger.qif_date(F.date_format(d, "MM/dd''yy")).alias("apostrophe"),
        ledger.qif_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"),
    )


@query("fin9_ofx_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def _(t):
    return t.orders.select("o_orderkey", ledger.ofx_date(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("date"))


@query(
    "fin10_payees",
    """SELECT c_custkey, c_name AS payee FROM customer""",
)
def _(t):
    k = F.col("c_custkey")
    raw = F.concat(
        F.when(k % 4 == 0, "POS * ").when(k % 4 == 1, "ach-").when(k % 4 == 2, "Checkcard  #").otherwise(""),
        "c_name",
        F.when(k % 3 == 0, " Inc.").when(k % 3 == 1, "  #77 Main St").otherwise("  "),
    )
    # The names hold a number sign of their own, which has no space before it.
    return t.customer.select("c_custkey", ledger.normal_payee(raw).alias("payee"))


CLEANED = f"""SELECT * FROM (SELECT id, account, date, amount, 'Customer ' || account AS payee, check_number FROM ({TX}) WHERE amount <> 0)
  QUALIFY row_number() OVER (PARTITION BY account, date, amount, payee, check_number ORDER BY id) = 1"""


@query("cln14_statement_clean", CLEANED)
def _(t):
    tx = transactions(t)
    doubled = tx.unionByName(tx.filter("id % 6 = 0").withColumn("_row", F.col("_row") + 10_000_000_000))
    return ledger.clean(doubled).select("id", "account", "date", "amount", "payee", "check_number")


@query(
    "cln15_anonymise",
    """SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS account,
         CASE WHEN c_custkey % 2 = 0 THEN 'Statement item' ELSE '' END AS memo FROM customer""",
)
def _(t):
    df = t.customer.select(
        "c_custkey", F.col("c_name").alias("account"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("memo")
    )
    return ledger.anonymised(df)


@query(
    "cln19_drop_empty_fields",
    f"SELECT id, nullif(memo, '') AS memo, nullif(category, '') AS category, nullif(check_number, '') AS check_number FROM ({TX})",
)
def _(t):
    return ledger.drop_empty_fields(transactions(t)).select("id", "memo", "category", "check_number")


def _two_statements(t):
    """The transactions, and the same as another bank shows them."""
    a = transactions(t).withColumn("id", F.concat(F.lit("a"), F.col("id").cast("string")))
    k = F.col("_row")
    b = (
        a.filter(k % 11 != 0)
        .withColumn("amount", F.when(k % 3 == 0, F.col("amount") + F.lit(0.01).cast("decimal(18,2)")).otherwise(F.col("amount")).cast("decimal(18,2)"))
        .withColumn("date", F.date_add("date", (k % 6).cast("int")))
        .withColumn("id", F.when(k % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("b"), k.cast("string"))))
    )
    return a, b


@query("joi6_reconcile")
def _(t):
    a, b = _two_statements(t)
    return ledger.reconcile(a, b)


@query("dif10_reconcile_report")
def _(t):
    a, b = _two_statements(t)
    return ledger.reconcile_report(a, b, ledger.reconcile(a, b))


# All transactions of a group agree, so the rule pairs them in order.
IN_ORDER = """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 50 AS g FROM orders), b AS (SELECT * FROM a WHERE k % 4 <> 0),
  x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS n FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS n FROM b),
  p AS (SELECT CASE WHEN y.k IS NULL THEN 'unmatched_a' WHEN x.k IS NULL THEN 'unmatched_b' ELSE 'matched' END AS status, x.k AS a_row, y.k AS b_row
    FROM x FULL JOIN y ON x.g = y.g AND x.n = y.n)"""


def _groups(t, cents):
    """Statements of fifty amounts a unit apart, all on one day; ``cents`` is added to the second."""
    k = F.col("o_orderkey")
    a = t.orders.select(
        k.alias("_row"), F.lit("").alias("id"), F.lit("2024-01-01").cast("date").alias("date"), (k % 50).cast("decimal(18,2)").alias("amount")
    )
    return a, a.filter("_row % 4 <> 0").withColumn("amount", (F.col("amount") + cents).cast("decimal(18,2)"))


@query("joi6_in_order", IN_ORDER + " SELECT status, a_row, b_row FROM p")
def _(t):
    a, b = _groups(t, F.when(F.col("_row") % 2 == 0, F.lit(0.01)).otherwise(F.lit(0)).cast("decimal(18,2)"))
    return ledger.reconcile(a, b)


@query("joi6_rounds", IN_ORDER + " SELECT status, a_row, b_row FROM p")
def _(t):
    """The same pairs, all settled in rounds."""
    return ledger.reconcile(*_groups(t, F.lit(0)), run_rows=0)


@query(
    "dif10_report_in_order",
    IN_ORDER + """ SELECT count(*) FILTER (status <> 'matched') = 0 AS reconciled, count(*) FILTER (status = 'matched') AS matched,
        count(*) FILTER (status = 'unmatched_a') AS unmatched_a, count(*) FILTER (status = 'unmatched_b') AS unmatched_b,
        CAST((SELECT sum(g) FROM a) AS DOUBLE) AS total_a, CAST((SELECT sum(g) FROM b) AS DOUBLE) AS total_b,
        CAST((SELECT sum(g) FROM a) - (SELECT sum(g) FROM b) AS DOUBLE) AS discrepancy FROM p""",
)
def _(t):
    a, b = _groups(t, F.lit(0))
    return ledger.reconcile_report(a, b, ledger.reconcile(a, b))


# --- spreadsheet functions --------------------------------------------------


@query(
    "fx1_ranges",
    """SELECT l_returnflag, sum(l_quantity) AS sum, avg(l_quantity) AS average, min(l_quantity) AS min, max(l_quantity) AS max,
         count(*) FILTER (l_linenumber <> 2) AS count, count(*) AS counta, 0.0::DOUBLE AS empty FROM lineitem GROUP BY 1""",
)
def _(t):
    q = F.col("l_quantity")
    some = F.when(F.col("l_linenumber") == 2, F.lit("x")).otherwise(q.cast("string"))
    return t.lineitem.groupBy("l_returnflag").agg(
        fx.fx_sum(q).alias("sum"),
        fx.fx_average(q).alias("average"),
        fx.fx_min(q).alias("min"),
        fx.fx_max(q).alias("max"),
        fx.fx_count(some).alias("count"),
        fx.fx_counta(some).alias("counta"),
        fx.fx_product(F.lit("")).alias("empty"),
    )


@query(
    "fx2_numbers",
    """SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS round, ceil(l_extendedprice) AS roundup, floor(l_extendedprice * 10) / 10 AS rounddown,
         abs(20 - l_quantity) AS abs, floor(l_discount * 33) AS int, (20 - l_quantity) % 7 AS mod, pow(l_quantity, 2) AS power,
         CASE WHEN l_quantity >= 10 THEN sqrt(l_quantity - 10) END AS sqrt FROM lineitem""",
)
def _(t):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        fx.fx_round(p, 1).alias("round"),
        fx.fx_roundup(p).alias("roundup"),
        fx.fx_rounddown(p, 1).alias("rounddown"),
        fx.fx_abs(20 - q).alias("abs"),
        fx.fx_int(F.col("l_discount") * 33).alias("int"),
        fx.fx_mod(20 - q, 7).alias("mod"),
        fx.fx_power(q, 2).alias("power"),
        fx.fx_sqrt(q - 10).alias("sqrt"),
    )


@query(
    "fx3_logic",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size,
         CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE '#N/A' END AS state,
         o_totalprice > 1000 AND o_orderstatus = 'F' AS both, o_totalprice > 400000 OR o_orderstatus = 'P' AS either, NOT o_orderstatus = 'P' AS other FROM orders""",
)
def _(t):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        fx.fx_if(p > 100000, "big", "small").alias("size"),
        fx.fx_ifs(s == "F", "done", s == "O", "open").alias("state"),
        fx.fx_and(p > 1000, s == "F").alias("both"),
        fx.fx_or(p > 400000, s == "P").alias("either"),
        fx.fx_not(s == "P").alias("other"),
    )


@query(
    "fx4_text",
    """SELECT p_partkey, p_name || '/' || p_size AS concat, CAST(length(p_name) AS INTEGER) AS len, left(p_name, 3) AS "left", right(p_name, 1) AS "right",
         substr(p_name, 2, 4) AS mid, upper(p_name) AS upper, lower(p_brand) AS lower,
         upper(p_name[1:1]) || substr(p_name, 2, position(' ' IN p_name) - 1) || upper(substr(p_name, position(' ' IN p_name) + 1, 1)) || substr(p_name, position(' ' IN p_name) + 2) AS proper FROM part""",
)
def _(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey",
        fx.fx_concat(n, "/", F.col("p_size")).alias("concat"),
        fx.fx_len(n).alias("len"),
        fx.fx_left(n, 3).alias("left"),
        fx.fx_right(n).alias("right"),
        fx.fx_mid(n, 2, 4).alias("mid"),
        fx.fx_upper(n).alias("upper"),
        fx.fx_lower(F.col("p_brand")).alias("lower"),
        fx.fx_proper(fx.fx_trim(F.concat(F.lit(" "), n))).alias("proper"),
    )


@query(
    "fx7_operators",
    """SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_tax AS minus, l_quantity * l_tax AS times,
         CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS quotient, l_returnflag || l_linestatus AS joined, l_quantity > 10 AS bigger,
         l_returnflag < 'N' AS earlier FROM lineitem""",
)
def _(t):
    q, x = F.col("l_quantity"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        fx.fx_add(q, x).alias("plus"),
        fx.fx_subtract(q, x).alias("minus"),
        fx.fx_multiply(q, x).alias("times"),
        fx.fx_divide(q, F.col("l_discount")).alias("quotient"),
        fx.fx_join(F.col("l_returnflag"), F.col("l_linestatus")).alias("joined"),
        fx.fx_compare(q, ">", 10).alias("bigger"),
        fx.fx_compare(F.col("l_returnflag"), "<", "N").alias("earlier"),
    )


@query(
    "fx8_epoch",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, date_trunc('second', ts) AS ts FROM events""",
)
def _(t):
    e = fx.fx_timestamp_to_epoch(F.col("ts"))
    return t.events.select("event_id", e.alias("epoch"), fx.fx_epoch_to_timestamp(e).cast("timestamp_ntz").alias("ts"))


@query(
    "fx9_xml_entities",
    """SELECT p_partkey, '<a b=&quot;' || p_name || '&quot;>&amp;&apos;' AS escaped, '<' || p_brand || '>A' || chr(128512) AS plain
       FROM (SELECT p_partkey, replace(p_name, '<', '&lt;') AS p_name, p_brand FROM part)""".replace("'<a", "'&lt;a").replace("&quot;>", "&quot;&gt;"),
)
def _(t):
    raw = F.concat(F.lit('<a b="'), "p_name", F.lit("\">&'"))
    coded = F.concat(F.lit("&lt;"), "p_brand", F.lit("&gt;&#65;&#x1F600;"))
    return t.part.select("p_partkey", fx.xml_escape(raw).alias("escaped"), fx.xml_unescape(coded).alias("plain"))


# --- cells ------------------------------------------------------------------


def sheet_of(t):
    """The nations as cells, with a blank header, a blank row and a formula column."""
    placed = dense_rows(t.nation, ["n_nationkey"], "_pos")
    return grid.cells_of(placed, "book", "nations", "_pos")


@query(
    "grd2_cells",
    """SELECT CAST(n_nationkey + 2 AS INTEGER) AS "row", CAST(unnest([1, 2, 3]) AS INTEGER) AS col, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS value,
         unnest(['number', 'string', 'number']) AS vtype FROM nation
       UNION ALL SELECT 1, CAST(unnest([1, 2, 3]) AS INTEGER), unnest(['n_nationkey', 'n_name', 'n_regionkey']), 'string'""",
)
def _(t):
    return sheet_of(t).select("row", "col", "value", "vtype")


@query(
    "grd1_records",
    """SELECT CAST(n_nationkey + 2 AS INTEGER) AS "row", CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS col_3
       FROM nation WHERE n_nationkey <> 7""",
)
def _(t):
    cells = sheet_of(t)
    gaps = cells.filter("not (col = 3 and (row - 2) % 3 = 0 and row > 1)")
    blank_head = gaps.withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 3), None).otherwise(F.col("value")))
    blank_row = blank_head.withColumn("value", F.when(F.col("row") == 9, "").otherwise(F.col("value")))
    return grid.record_columns(grid.records(blank_row), ["n_nationkey", "n_name", "col_3"]).drop("workbook", "sheet")


def order_cells(t):
    """All orders as one sheet with a date serial and a formula."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")

    def cell(number, value, kind, formula=none):
        return F.struct(F.lit(number).alias("col"), value.alias("value"), kind.alias("vtype"), formula.alias("formula"))

    blank = k % 5 == 0
    values = F.array(
        cell(1, k.cast("string"), F.lit("number")),
        cell(2, F.col("o_orderstatus"), F.lit("string")),
        cell(
            3,
            F.when(blank, "").otherwise(F.col("o_totalprice").cast("string")),
            F.when(blank, "empty").otherwise("number"),
            F.when(k % 4 == 0, F.concat(F.lit("sum(A"), (k + 2).cast("string"), F.lit(")"))),
        ),
    )
    return t.orders.select(
        F.lit("book").alias("workbook"),
        F.concat(F.lit("sheet"), (F.col("o_custkey") % 3).cast("string")).alias("sheet"),
        (k + 2).cast("int").alias("row"),
        F.inline(values),
    )


@query(
    "prf12_sheet_profile",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, count(*) * 3 AS cells, count(*) + count(*) FILTER (o_orderkey % 5 <> 0) AS numbers, count(*) AS strings,
         count(*) FILTER (o_orderkey % 4 = 0) AS formulas, count(*) FILTER (o_orderkey % 5 = 0) AS empties, CAST(max(o_orderkey) + 2 AS INTEGER) AS "rows" FROM orders GROUP BY 1""",
)
def _(t):
    return grid.profile(order_cells(t)).select("sheet", "cells", "numbers", "strings", "formulas", "empties", "rows")


@query(
    "prf12_formula_inventory",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, 'SUM' AS function, count(*) AS uses FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1""",
)
def _(t):
    return grid.formula_inventory(order_cells(t)).drop("workbook")


@query(
    "grd3_set_cells",
    """SELECT CAST(n_nationkey + 2 AS INTEGER) AS "row", 2 AS col, CASE n_nationkey WHEN 0 THEN 'Atlantis' WHEN 3 THEN NULL ELSE n_name END AS value,
         CASE n_nationkey WHEN 3 THEN 'UPPER(B2)' END AS formula FROM nation UNION ALL SELECT 1, 2, 'n_name', NULL UNION ALL SELECT 40, 27, 'true', NULL""",
)
def _(t):
    out = grid.set_cells(sheet_of(t), "book", "nations", {"B2": "Atlantis", "AA40": True}, {"$B$5": "=UPPER(B2)"})
    return out.filter("col in (2, 27)").select("row", "col", "value", "formula")


@query(
    "grd4_sheets",
    """SELECT CASE o_custkey % 3 WHEN 1 THEN 'first' ELSE 'sheet' || (o_custkey % 3) END AS sheet, CAST(CASE o_custkey % 3 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS sheet_no,
         count(*) * 3 AS cells FROM orders GROUP BY 1, 2""",
)
def _(t):
    named = grid.rename_sheets(order_cells(t), {"sheet1": "first"})
    return grid.order_sheets(named, ["sheet2", "first"]).groupBy("sheet", F.col("sheet_no").cast("bigint").alias("sheet_no")).agg(
        F.count(F.lit(1)).alias("cells")
    )


@query(
    "grd5_dimensions",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, CAST(max(o_orderkey) + 2 AS INTEGER) AS "rows", CAST(3 AS INTEGER) AS cols, 'A1:C' || (max(o_orderkey) + 2) AS range FROM orders GROUP BY 1""",
)
def _(t):
    return grid.dimensions(order_cells(t)).select("sheet", "rows", "cols", "range")


@query(
    "fx5_time",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, date_trunc('second', ts) AS back, true AS today FROM events""",
)
def _(t):
    seconds = fx.fx_timestamp_to_epoch(F.col("ts"))
    back = fx.fx_epoch_to_timestamp(seconds).cast("timestamp_ntz")
    same_day = (fx.fx_today() == F.current_date()) & (F.to_date(fx.fx_now()) == fx.fx_today())
    return t.events.select("event_id", seconds.alias("seconds"), back.alias("back"), same_day.alias("today"))


def order_merges(t):
    """In each of the three sheets a range of three rows and two columns at every tenth order, spelt in two ways."""
    r = F.col("o_orderkey") + 2
    plain = F.concat(F.lit("A"), r.cast("string"), F.lit(":B"), (r + 2).cast("string"))
    turned = F.concat(F.lit("$b$"), (r + 2).cast("string"), F.lit(":$A"), r.cast("string"))
    ref = F.when(F.col("o_orderkey") % 20 == 0, turned).otherwise(plain)
    tenth = t.orders.filter("o_orderkey % 10 = 0")
    return tenth.select(F.lit("book").alias("workbook"), F.explode(F.array(*map(F.lit, ("sheet0", "sheet1", "sheet2")))).alias("sheet"), ref.alias("ref"))


@query(
    "grd5_merges",
    """WITH k AS (SELECT o_orderkey AS k, 'sheet' || (o_custkey % 3) AS sheet, unnest([1, 2, 3]) AS col FROM orders),
         m AS (SELECT *, k % 10 < 3 AND col < 3 AS merged, k - k % 10 + 2 AS r FROM k)
       SELECT sheet, CAST(k + 2 AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, CASE WHEN merged THEN 'A' || r || ':B' || (r + 2) END AS merge,
         merged AND k % 10 = 0 AND col = 1 AS master FROM m""",
)
def _(t):
    return grid.with_merges(order_cells(t), order_merges(t)).select("sheet", "row", "col", "merge", "master")


@query(
    "prf12_merge_count",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, count(*) * 3 AS cells, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS merges FROM orders GROUP BY 1""",
)
def _(t):
    return grid.profile(order_cells(t), order_merges(t)).select("sheet", "cells", "merges")


@query(
    "grd6_serials",
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER) AS serial, o_orderdate + INTERVAL 6 HOUR AS back FROM orders""",
)
def _(t):
    d = F.col("o_orderdate")
    later = d + F.expr("interval 6 hours")
    return t.orders.select(
        "o_orderkey",
        grid.date_to_serial(d).alias("serial"),
        grid.serial_to_timestamp(grid.timestamp_to_serial(later)).cast("timestamp_ntz").alias("back"),
    )


@query(
    "cln17_sheet_clean",
    """SELECT sheet, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY k) AS INTEGER) AS "row", status FROM
       (SELECT 'sheet' || (o_custkey % 3) AS sheet, o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0)""",
)
def _(t):
    blank = (F.col("row") - 2) % 7 == 0
    cells = order_cells(t).withColumn("value", F.when(blank, "").when(F.col("col") == 2, F.concat(F.lit(" "), "value")).otherwise(F.col("value")))
    return grid.clean(cells).filter("col = 2").select("sheet", "row", F.col("value").alias("status"))


@query(
    "cln18_trim_to_used",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, count(*) * 2 AS cells FROM orders GROUP BY 1""",
)
def _(t):
    extra = order_cells(t).filter("col <= 2").withColumn("formula", F.lit(None).cast("string"))
    padded = extra.unionByName(extra.filter("col = 1").withColumns({"col": F.lit(9), "value": F.lit("")}))
    return grid.trim_to_used(padded).groupBy("sheet").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "dif9_grid_diff",
    """SELECT 'sheet' || (o_custkey % 3) AS sheet, CAST(o_orderkey + 2 AS INTEGER) AS "row", CAST(2 AS INTEGER) AS col, CASE WHEN o_orderkey % 9 = 0 THEN 'removed' ELSE 'modified' END AS status
       FROM orders WHERE o_orderkey % 9 = 0 OR (o_orderkey % 8 = 0 AND o_orderstatus = 'F')
       UNION ALL SELECT 'sheet' || (o_custkey % 3), CAST(o_orderkey + 2 AS INTEGER), 3, 'modified' FROM orders WHERE o_orderkey % 12 = 0""",
)
def _(t):
    from tablekit.operators import diff

    a = order_cells(t)
    k = F.col("row") - 2
    b = (
        a.filter(~((F.col("col") == 2) & (k % 9 == 0)))
        .withColumn("value", F.when((F.col("col") == 2) & (k % 8 == 0) & (F.col("value") == "F"), "X").otherwise(F.col("value")))
        .withColumn("formula", F.when((F.col("col") == 3) & (k % 12 == 0), None).otherwise(F.col("formula")))
    )
    return diff.grid_diff(a, b).select("sheet", "row", "col", "status")


@query("fx6_vlookup", "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    from tablekit.operators.joins import lookup

    table = t.nation.withColumn("_row", F.col("n_nationkey"))
    return lookup(t.customer, "c_nationkey", table, 2, "nation").select("c_custkey", "nation")


@query(
    "agg13_median_all",
    "SELECT median(o_totalprice) AS median FROM orders",
)
def _(t):
    return agg.median(t.orders, [], "o_totalprice")
