"""Bank transactions: cash flow, categories, payees, cleaning and reconciliation.

A transactions table has ``account, id, type, date, amount, payee, memo,
category, check_number`` (those a call does not use may be absent) and a row
order column. Amounts are decimals, so sums do not depend on row order.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tablekit.functions.coerce import col
from tablekit.operators.joins import first_rule, keep_first
from tablekit.operators.rows import ROW, dense_rows, running_total
from tablekit.session import cut, new_folder

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


def inflow(amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0)).cast("decimal(38,2)")


def outflow(amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(amount <= 0, -amount)), F.lit(0)).cast("decimal(38,2)")


def flatten_statement(accounts: DataFrame) -> DataFrame:
    """One row per transaction from nested accounts, with account defaults filled in."""
    name = F.coalesce(F.nullif("account_id", F.lit("")), F.nullif("name", F.lit("")), F.lit("Default"))
    return accounts.select(
        name.alias("account"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("Bank")).alias("account_type"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")).alias("currency"),
        F.inline("transactions"),
    )


def cashflow(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Inflow, outflow (positive), net and count over all transactions."""
    a = money(col(amount))
    return df.agg(
        F.count(F.lit(1)).alias("transactions"),
        inflow(a).cast("double").alias("inflow"),
        outflow(a).cast("double").alias("outflow"),
        (inflow(a) - outflow(a)).cast("double").alias("net"),
    )


def totals_by(df: DataFrame, key: Column, out: str, amount: str = "amount") -> DataFrame:
    a = money(col(amount))
    return df.groupBy(key.alias(out)).agg(
        F.sum(a).cast("double").alias("total"), F.count(F.lit(1)).alias("transactions")
    )


def by_category(df: DataFrame) -> DataFrame:
    return totals_by(df, F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")), "category")


def by_payee(df: DataFrame) -> DataFrame:
    return totals_by(df, F.coalesce(F.nullif("payee", F.lit("")), F.lit("Unknown")), "payee")


def by_month(df: DataFrame, amount: str = "amount") -> DataFrame:
    a = money(col(amount))
    dated = df.filter(F.col("date").isNotNull())
    return dated.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        inflow(a).cast("double").alias("inflow"),
        outflow(a).cast("double").alias("outflow"),
        (inflow(a) - outflow(a)).cast("double").alias("net"),
    )


def profile(df: DataFrame) -> DataFrame:
    """All breakdowns in one table: ``section, key, inflow, outflow, net, transactions``."""
    a = money(F.col("amount"))
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("(none)"))
    sections = {
        "total": F.lit("all"),
        "category": F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")),
        "payee": F.coalesce(F.nullif("payee", F.lit("")), F.lit("Unknown")),
        "month": month,
    }
    keys = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in sections.items()])
    long = df.select(a.alias("a"), F.inline(keys))
    return long.groupBy("section", "key").agg(
        inflow(F.col("a")).cast("double").alias("inflow"),
        outflow(F.col("a")).cast("double").alias("outflow"),
        F.sum("a").cast("double").alias("net"),
        F.count(F.lit(1)).alias("transactions"),
    )


def categorise(df: DataFrame, rules: Sequence[tuple[str, str]], regex: bool = False) -> DataFrame:
    """Set the category from the first rule that matches payee and memo."""
    text = F.concat(
        F.coalesce(F.col("payee"), F.lit("")), F.lit(" "), F.coalesce(F.col("memo"), F.lit(""))
    )
    return df.withColumn("category", first_rule(text, rules, F.col("category"), regex))


def normal_payee(c: Column) -> Column:
    """A payee without bank prefix, company suffix, store number and double spaces."""
    # The prefixes and suffixes, in the order they are taken off.
    out = F.regexp_replace(c, r"(?i)^(POS|DEBIT|PURCHASE|CHECKCARD|ACH|PAYPAL)\s*[\*#-]?\s*", "")
    out = F.regexp_replace(out, r"(?i)\s+(LLC|INC|CORP|LTD)\.?$", "")
    out = F.regexp_replace(out, r"\s+#\d+.*$", "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def mask(c: Column, default: str = "") -> Column:
    """All but the last four characters starred; short values become four stars."""
    c = F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.when(F.length(c) <= 4, "****").otherwise(
        F.concat(F.repeat(F.lit("*"), F.length(c) - 4), F.right(c, F.lit(4)))
    )


def clean(
    df: DataFrame,
    drop_zero: bool = True,
    payees: bool = True,
    deduplicate: bool = True,
    anonymise: bool = False,
    row: str = ROW,
) -> DataFrame:
    """Drop zero amounts, normalise payees and keep the first of equal transactions per account."""
    if drop_zero:
        df = df.filter(F.abs(F.coalesce(F.col("amount").cast("double"), F.lit(0.0))) >= 1e-4)
    if payees:
        df = df.withColumn("payee", normal_payee(F.col("payee")))
    if deduplicate:
        keys = [k for k in ("account", "date", "amount", "payee", "check_number") if k in df.columns]
        df = keep_first(df, keys, row)
    return anonymised(df) if anonymise else df


def anonymised(df: DataFrame) -> DataFrame:
    # Stand-ins for missing numbers, and the memo that replaces all memos.
    changes = {"account": ("123456789",), "bank_id": ("987654321",)}
    for name, (default,) in changes.items():
        if name in df.columns:
            df = df.withColumn(name, mask(F.col(name), default))
    if "memo" in df.columns:
        df = df.withColumn("memo", F.when(F.col("memo") != "", "Statement item").otherwise(F.col("memo")))
    return df


def drop_empty_fields(df: DataFrame) -> DataFrame:
    """Blank memo, category and check number become null, so that exports leave them out."""
    names = [n for n in ("memo", "category", "check_number") if n in df.columns]
    out = df.withColumns({n: F.nullif(F.trim(n), F.lit("")) for n in names})
    if "splits" in df.columns:
        out = out.withColumn("splits", F.when(F.size("splits") > 0, F.col("splits")))
    return out


# --- dates ------------------------------------------------------------------


def qif_date(c: Column) -> Column:
    """Month first, parted by ``/ . ' -``; two-digit years above 50 are 19xx. ISO stays ISO."""
    parts = F.split(F.trim(c), r"[/.'\-]")

    def number(i: int) -> Column:
        return F.trim(F.get(parts, F.lit(i))).try_cast("int")

    year = F.when(
        F.length(F.trim(F.get(parts, F.lit(2)))) == 2,
        number(2) + F.when(number(2) > 50, 1900).otherwise(2000),
    ).otherwise(number(2))
    iso = c.rlike(r"^\s*\d{4}-")
    y = F.when(iso, number(0)).otherwise(year)
    m = F.when(iso, number(1)).otherwise(number(0))
    d = F.when(iso, number(2)).otherwise(number(1))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def ofx_date(c: Column) -> Column:
    """The first eight digits."""
    digits = F.regexp_extract(c, r"^\s*(\d{8})", 1)
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


# --- reconciliation ---------------------------------------------------------
#
# The rule is sequential: each transaction of A, in order, takes the first free
# transaction of B it agrees with. Amounts more than a cent apart never agree,
# so the rule falls apart into runs of neighbouring amounts. The line of amounts
# is cut where a run begins, and the pieces are settled side by side. A longer run
# is settled in one task, which goes once over its rows as numbers (see
# ``_in_row_order``). Runs that no task can hold are settled in rounds over the
# whole cluster:
#
# Whether two transactions agree depends only on their signature (cents, day,
# id, check number), so equal ones are one row with a count. A round looks up,
# per signature, the two lowest free partners; where two signatures are each
# other's first choice, their members are matched in order for as long as no
# other partner comes earlier. Such pairs are in the sequential result, so the
# rounds end with exactly that result. No pairs of rows are listed, and a
# signature that holds a third of all rows is one row. For statements in date
# order the number of rounds follows the number of days, not of rows.

NO_DAY = -(10**9)
# Rows without a number come last.
NO_ROW = 2**63 - 1
# Rows of a run of amounts that are settled with others; a longer one has a task of its own.
RUN_ROWS = 200_000
# Rows of a run that one task may hold as numbers; longer runs go through rounds.
PASS_ROWS = 50_000_000
A, B = 0, 1


def _slim(df: DataFrame, row: str, side: int) -> DataFrame:
    """What the rule looks at: ``side, r, cents, day, id, chk``."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    cents = F.round(F.col("amount").try_cast("decimal(20,4)") * 100).cast("bigint")
    kind = df.schema["amount"].dataType
    if isinstance(kind, DecimalType) and kind.scale <= 2:
        # Whole cents: a double holds them to the last one below 2^50.
        plain = F.col("amount").cast("double") * 100
        cents = F.when(F.abs(plain) < 2**50, F.rint(plain).cast("bigint")).otherwise(cents)
    return df.select(
        F.lit(side).alias("side"),
        F.coalesce(F.col(row).cast("bigint"), F.lit(NO_ROW)).alias("r"),
        cents.alias("cents"),
        F.coalesce(F.unix_date(F.col("date").cast("date")), F.lit(NO_DAY)).alias("day"),
        text("id").alias("id"),
        text("check_number").alias("chk"),
    )


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The table in columns in the shared folder, as some passes read few of them; and its place."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _numbered(slim: DataFrame) -> DataFrame:
    """The rows with an amount, stored; ``uid`` tells them apart."""
    return _stored(slim.withColumn("uid", F.monotonically_increasing_id()))[0].filter(F.col("cents").isNotNull())


def _prepared(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures ``(sid, cents, day, id, chk, n, taken)`` and members ``(sid, place, r)``."""
    names = ["cents", "day", "id", "chk"]
    placed = dense_rows(slim.select(*names, "r"), [*names, "r"], "pos")
    signatures = cut(
        placed.groupBy(*names)
        .agg(F.min("pos").alias("sid"), F.count(F.lit(1)).alias("n"))
        .withColumn("taken", F.lit(0).cast("bigint"))
    )
    members = cut(
        placed.join(signatures.select(*names, "sid"), names).select(
            "sid", (F.col("pos") - F.col("sid")).alias("place"), "r"
        )
    )
    return signatures, members


def _keys(reach: int, days: int) -> Column:
    """Lookup keys of a signature: its own (reach 0), or all it agrees with."""
    cents = F.sequence(F.col("cents") - reach, F.col("cents") + reach)
    span = days if reach else 0

    def keyed(kind: str, value: Column) -> Column:
        return F.transform(
            cents, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c"), value.alias("k"))
        )

    empty = F.slice(keyed("d", F.lit("")), 1, 0)
    near = F.transform(
        F.sequence(F.col("day") - span, F.col("day") + span), lambda d: keyed("d", d.cast("string"))
    )
    return F.concat(
        F.when(F.col("day") != NO_DAY, F.flatten(near)).otherwise(empty),
        F.when(F.col("id") != "", keyed("i", F.col("id"))).otherwise(empty),
        F.when(F.col("chk") != "", keyed("c", F.col("chk"))).otherwise(empty),
    )


def _first_free(signatures: DataFrame, members: DataFrame) -> DataFrame:
    """Signatures with members left, and the row number of their first free one."""
    left = signatures.filter(F.col("taken") < F.col("n"))
    m = members.select("sid", F.col("place").alias("taken"), F.col("r").alias("first"))
    return left.join(m, ["sid", "taken"])


def _choices(mine: DataFrame, theirs: DataFrame, days: int) -> DataFrame:
    """Per signature of mine: first partner, and where the next other partner starts."""
    own = theirs.select(F.col("sid").alias("partner"), "first", F.explode(_keys(0, days)).alias("key"))
    # Planned with a per-task limit of two rows per key ahead of the shuffle.
    w = Window.partitionBy("key").orderBy("first")
    best = own.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2").drop("_rn")
    wanted = mine.select("sid", "taken", F.explode(_keys(1, days)).alias("key"))
    # At most two partners for each of a signature's fixed number of keys.
    found = wanted.join(best, "key").groupBy("sid", "taken").agg(
        F.sort_array(F.collect_set(F.struct("first", "partner"))).alias("p")
    )
    return found.select(
        "sid", "taken", F.get("p", F.lit(0))["partner"].alias("partner"), F.get("p", F.lit(1))["first"].alias("limit")
    )


def _agreed(members: DataFrame, pairs: DataFrame, sid: str, taken: str, limit: str) -> DataFrame:
    """How many free members of each paired signature come before the limit."""
    p = pairs.select(F.col(sid).alias("sid"), F.col(taken).alias("_t"), F.col(limit).alias("_l"))
    free = members.join(p, "sid").filter(
        (F.col("place") >= F.col("_t")) & (F.col("_l").isNull() | (F.col("r") < F.col("_l")))
    )
    return free.groupBy(F.col("sid").alias(sid)).agg(F.count(F.lit(1)).alias("_n_" + sid))


def _matched(members: DataFrame, pairs: DataFrame, sid: str, taken: str, out: str) -> DataFrame:
    p = pairs.select(F.col(sid).alias("sid"), F.col("a_sid").alias("pair"), F.col(taken).alias("_t"), "times")
    chosen = members.join(p, "sid").filter(
        (F.col("place") >= F.col("_t")) & (F.col("place") < F.col("_t") + F.col("times"))
    )
    return chosen.select("pair", (F.col("place") - F.col("_t")).alias("k"), F.col("r").alias(out))


def _left_over(
    signatures: DataFrame, members: DataFrame, choice: DataFrame, pairs: DataFrame, sid: str
) -> tuple[DataFrame, DataFrame]:
    """What the next round still has to look at.

    A signature that found no partner never will, as partners only get fewer,
    so the tables shrink to what is contested.
    """
    step = pairs.select(F.col(sid).alias("sid"), F.col("times").alias("_more"))
    alive = cut(
        signatures.join(choice.select(F.col(sid).alias("sid")), "sid", "left_semi")
        .join(step, "sid", "left")
        .withColumn("taken", F.col("taken") + F.coalesce("_more", F.lit(0)))
        .drop("_more")
        .filter("taken < n")
    )
    rest = members.join(alive.select("sid", "taken"), "sid").filter("place >= taken").drop("taken")
    return alive, cut(rest)


def match_pairs(
    a: DataFrame, b: DataFrame, days: int = 3, row: str = ROW, run_rows: int = RUN_ROWS, pass_rows: int = PASS_ROWS
) -> DataFrame:
    """Matched row numbers ``a_row, b_row`` of two transaction tables.

    Two transactions agree when their amounts differ by at most 0.01 and they
    share an id, lie at most ``days`` apart, or share a check number. All ways
    of settling give the same pairs; ``run_rows=0`` settles all in rounds.
    """
    rows = _numbered(_slim(a, row, A).unionByName(_slim(b, row, B)))
    result = rows.limit(0).select(F.col("r").alias("a_row"), F.col("r").alias("b_row"))
    numbers = [F.nullif(c, F.lit(NO_ROW)).alias(c) for c in ("a_row", "b_row")]
    while True:
        if run_rows:
            # Runs get shorter as rows are settled in rounds, so they are looked at again.
            made, rows = _by_runs(rows, days, run_rows, pass_rows)
            result = result.unionByName(made)
            if rows is None:
                break
        a_sig, a_members = _prepared(rows.filter(F.col("side") == A))
        b_sig, b_members = _prepared(rows.filter(F.col("side") == B))
        enough = a_sig.count() // 2 if run_rows else -1
        while enough < 0 or a_sig.count() > enough:
            a_free, b_free = _first_free(a_sig, a_members), _first_free(b_sig, b_members)
            a_choice = cut(_choices(a_free, b_free, days).toDF("a_sid", "a_taken", "b_sid", "b_limit"))
            b_choice = cut(_choices(b_free, a_free, days).toDF("b_sid", "b_taken", "a_sid", "a_limit"))
            mutual = a_choice.join(b_choice, ["a_sid", "b_sid"])
            pairs = cut(
                mutual.join(_agreed(a_members, mutual, "a_sid", "a_taken", "a_limit"), "a_sid")
                .join(_agreed(b_members, mutual, "b_sid", "b_taken", "b_limit"), "b_sid")
                .withColumn("times", F.least("_n_a_sid", "_n_b_sid"))
            )
            if pairs.isEmpty():
                return result.select(*numbers)
            made = _matched(a_members, pairs, "a_sid", "a_taken", "a_row").join(
                _matched(b_members, pairs, "b_sid", "b_taken", "b_row"), ["pair", "k"]
            )
            result = result.unionByName(cut(made.select("a_row", "b_row")))
            a_sig, a_members = _left_over(a_sig, a_members, a_choice, pairs, "a_sid")
            b_sig, b_members = _left_over(b_sig, b_members, b_choice, pairs, "b_sid")
        rows = _numbered(_free_rows(a_sig, a_members, A).unionByName(_free_rows(b_sig, b_members, B)))
    return result.select(*numbers)


def _free_rows(signatures: DataFrame, members: DataFrame, side: int) -> DataFrame:
    return (
        members.join(signatures, "sid")
        .filter(F.col("place") >= F.col("taken"))
        .select(F.lit(side).alias("side"), "r", "cents", "day", "id", "chk")
    )


def _place(c: Column, bounds: Column, n: int) -> Column:
    """Place of the last of ``n`` sorted bounds that is not above ``c``, -1 if there is none."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(-1), lambda at, step: F.when(F.get(bounds, at + step) <= c, at + step).otherwise(at)
    )


def _numbers(values: Sequence[int]) -> Column:
    """An array literal; one text, as thousands of literals are slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _by_runs(rows: DataFrame, days: int, run_rows: int, pass_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a_row, b_row`` of the rows, and the rows of runs that are too long to be settled here."""
    pieces = _pieces(rows, run_rows)
    # Where the long runs begin and end by turns.
    long = [bound for start, end, n in pieces if n for bound in (start, end)]
    too_long = [bound for start, end, n in pieces if n > pass_rows for bound in (start, end)]
    starts = [start for start, _, _ in pieces]
    short = rows if not long else rows.filter(~_inside(long))
    piece = _place(F.col("cents"), _numbers(starts), len(starts))
    made = cut(short.drop("uid").withColumn("piece", piece).groupBy("piece").applyInArrow(_greedy(days), PAIRS))
    some = [bound for start, end, n in pieces if 0 < n <= pass_rows for bound in (start, end)]
    if some:
        run = F.shiftright(_place(F.col("cents"), _numbers(some), len(some)), 1)
        made = made.unionByName(cut(_in_row_order(rows.filter(_inside(some)).withColumn("run", run), days)))
    return made, rows.filter(_inside(too_long)) if too_long else None


def _inside(bounds: list[int]) -> Column:
    return F.pmod(_place(F.col("cents"), _numbers(bounds), len(bounds)), F.lit(2)) == 0


def _pieces(rows: DataFrame, run_rows: int) -> list[tuple[int, int, int]]:
    """Where the line of amounts is cut: begin, end and, if it is one run longer than ``run_rows``, its rows, else 0.

    A run begins at an amount when there is none a cent below it. The amounts are
    cut by their running count of rows; of each slot only its first and last
    beginning come here, as a long run goes over the end of a slot.
    """
    size = max(1, run_rows // 4)
    amounts = cut(rows.groupBy("cents").agg(F.count(F.lit(1)).alias("n")))
    below = amounts.select((F.col("cents") + 1).alias("cents"), F.lit(True).alias("_below"))
    placed = running_total(amounts.join(below, "cents", "left"), ["cents"], F.col("n"), "before")
    slots = (
        placed.groupBy(F.floor(F.col("before") / size).alias("slot"))
        .agg(
            F.min(F.when(F.col("_below").isNull(), F.struct("cents", "before"))).alias("first"),
            F.max(F.when(F.col("_below").isNull(), F.struct("cents", "before"))).alias("last"),
            F.max(F.col("before") + F.col("n")).alias("end"),
        )
        .orderBy("slot")
        .collect()
    )
    held = [s for s in slots if s["first"] is not None]
    nexts = [s["first"]["before"] for s in held[1:]] + [s["end"] for s in slots[-1:]]
    cuts: list[tuple[int, int]] = []
    for s, after in zip(held, nexts):
        n = after - s["last"]["before"]
        if n <= run_rows or s["first"] != s["last"]:
            cuts.append((s["first"]["cents"], 0))
        if n > run_rows:
            cuts.append((s["last"]["cents"], n))
    ends = [start for start, _ in cuts[1:]] + [2**63 - 1]
    return [(start, end, n) for (start, n), end in zip(cuts, ends)] or [(0, 1, 0)]


# --- the rule inside one task

PAIRS = "a_row bigint, b_row bigint"
# Rows of A whose places are looked up at once.
LOOKUP_ROWS = 65_536

Links = tuple[np.ndarray, np.ndarray]


def _settle(
    cents: np.ndarray, day: np.ndarray, n: int, days: int, asks: Links, members: Links, twins: dict[int, list[int]] | None = None
) -> np.ndarray:
    """Places of the rows of B that the first ``n`` rows, those of A, take in order; -1 is none.

    The rows of both sides come in row order. Those of B wait in queues by amount
    and day, so a row of A looks at the heads of some ranges of queues. ``asks``
    and ``members`` are places and keys: partners that lie further, by id or check
    number, wait in a queue for each key. ``twins`` are rows of B that go with
    another. All that grows with the rows is in arrays of numbers.
    """
    rows = len(day)
    mate = array("i", [-1]) * n
    if n in (0, rows):
        return np.array(mate)
    dated = day != NO_DAY
    of_b = np.flatnonzero(dated[n:]) + n
    first, last = (int(day[of_b].min()), int(day[of_b].max())) if len(of_b) else (0, 0)
    span = last - first + 1
    if (int(cents.max()) - int(cents.min()) + 2) * span < 2**62:
        code = cents - cents.min()
        code = code.astype(np.int32) if code.max() < 2**30 else code
    else:
        # Only whether amounts are neighbours matters.
        values, code = np.unique(cents, return_inverse=True)
        code = np.concatenate(([0], np.cumsum(np.diff(values) == 1) + 2 * np.cumsum(np.diff(values) != 1)))[code]
    del cents

    def queued(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        places, keys = places[order].astype(np.int32), keys[order]
        starts = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1])))[: len(keys)]
        return keys[starts], np.diff(starts, append=len(keys)), places

    def numbers(kind: str, values: np.ndarray) -> array:
        out = array(kind)
        out.frombytes(values.astype({"i": np.int32, "q": np.int64}[kind], copy=False).tobytes())
        return out

    found, sizes, items = queued(of_b, code[of_b].astype(np.int64) * span + (day[of_b] - first))
    del of_b
    by_day = np.full(rows + 1, -1, np.int32)
    by_day[items] = np.repeat(np.arange(len(found)), sizes)
    # Queues by name come after those by day.
    named, name_sizes, name_items = queued(*members)
    offset = len(found)
    sizes, items = np.concatenate((sizes, name_sizes)), np.concatenate((items, name_items))
    # Each queue ends with the place after the last row, which is never taken.
    ends = np.cumsum(sizes + 1) - 1
    laid = np.full(len(items) + len(sizes), rows, np.int32)
    held = np.ones(len(laid), bool)
    held[ends] = False
    laid[held] = items
    at, head = numbers("q", ends - sizes), laid[ends - sizes].tolist()
    del items, held
    laid, by_day = numbers("i", laid), numbers("i", by_day)
    # Queues by name of a row of B: from its first place in ``other`` on.
    order = np.argsort(name_items, kind="stable")
    owner, other = name_items[order], (np.repeat(np.arange(len(named)), name_sizes) + offset)[order]
    others = np.full(rows + 1, -1, np.int32)
    others[owner[::-1]] = np.arange(len(owner))[::-1]
    owner, other, others = numbers("i", np.append(owner, -1)), numbers("q", other), numbers("i", others)
    order = np.argsort(asks[0], kind="stable")
    who, keys = asks[0][order], asks[1][order]
    wanted = np.minimum(np.searchsorted(named, keys), max(len(named) - 1, 0))
    real = named[wanted] == keys if len(named) else np.zeros(len(keys), bool)
    who, wanted = who[real], wanted[real] + offset
    del name_items, order, keys
    gone = bytearray(rows + 1)

    def step_on(q: int) -> None:
        p = at[q] + 1
        while gone[laid[p]]:
            p += 1
        at[q], head[q] = p, laid[p]

    def leave(b: int) -> None:
        gone[b] = 1
        q = by_day[b]
        if q >= 0 and head[q] == b:
            step_on(q)
        k = others[b]
        if k >= 0:
            while owner[k] == b:
                if head[other[k]] == b:
                    step_on(other[k])
                k += 1

    for start in range(0, n, LOOKUP_ROWS):
        end = min(n, start + LOOKUP_ROWS)
        mine, near, use = code[start:end], day[start:end].astype(np.int64) - first, dated[start:end]
        low, high = np.clip(near - days, 0, span), np.clip(near + days + 1, 0, span)
        looks = []
        for step in (-1, 0, 1):
            row = (mine.astype(np.int64) + step) * span
            looks += [np.where(use, np.searchsorted(found, row + x), 0) for x in (low, high)]
        some = (looks[0] < looks[1]) | (looks[2] < looks[3]) | (looks[4] < looks[5])
        named_from, named_to = np.searchsorted(who, (start, end))
        also: dict[int, list[int]] = defaultdict(list)
        for i, q in zip(who[named_from:named_to].tolist(), wanted[named_from:named_to].tolist()):
            also[i].append(q)
        some[np.array([*also], np.int64) - start] = True
        asking = np.flatnonzero(some)
        for i, a0, z0, a1, z1, a2, z2 in zip((asking + start).tolist(), *(x[asking].tolist() for x in looks)):
            best = min(head[a1:z1]) if a1 < z1 else rows
            if a0 < z0 and (m := min(head[a0:z0])) < best:
                best = m
            if a2 < z2 and (m := min(head[a2:z2])) < best:
                best = m
            if i in also:
                for q in also[i]:
                    if head[q] < best:
                        best = head[q]
            if best == rows:
                continue
            mate[i] = best
            leave(best)
            if twins and best in twins:
                for b in twins[best]:
                    leave(b)
    return np.array(mate)


def _greedy(days: int):
    """Each row of side a, in order, takes the first free row of side b it agrees with."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        r, side = t["r"].to_numpy(), t["side"].to_numpy()
        order = np.lexsort((r, side))
        if ((np.diff(r[order]) == 0) & (np.diff(side[order]) == 0)).any():
            # Equal numbers go by what the rule looks at.
            keys = [(k, "ascending") for k in ("side", "r", "cents", "day", "id", "chk")]
            order = pc.sort_indices(t, sort_keys=keys).to_numpy()
        t = t.take(order)
        r, cents, day = (t[c].to_numpy() for c in ("r", "cents", "day"))
        n = int((side == A).sum())
        asks, members = _linked(t, cents, n)
        mate = _settle(cents, day, n, days, asks, members, _twins(r, cents, n))
        mine = np.flatnonzero(mate >= 0)
        return pa.table({"a_row": r[mine], "b_row": r[mate[mine]]})

    return run


def _twins(r: np.ndarray, cents: np.ndarray, n: int) -> dict[int, list[int]]:
    """Rows of B with the same number in one run: such a number is taken once."""
    same = np.flatnonzero((r[n + 1 :] == r[n:-1]) & (r[n:-1] != NO_ROW)) + n
    if not len(same):
        return {}
    values, amount = np.unique(cents, return_inverse=True)
    run = np.concatenate(([0], np.cumsum(np.diff(values) != 1)))[amount]
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in np.unique(np.concatenate((same, same + 1))).tolist():
        groups[int(r[i]), int(run[i])].append(i)
    return {i: [x for x in places if x != i] for places in groups.values() for i in places}


def _linked(t: pa.Table, cents: np.ndarray, n: int) -> tuple[Links, Links]:
    """Places and keys of rows of A and B that share an id or a check number."""
    values, amount = np.unique(cents, return_inverse=True)
    asks, members, offset = [], [], 0
    for name in ("id", "chk"):
        column = t[name].combine_chunks().dictionary_encode()
        code, words = column.indices.to_numpy().astype(np.int64), column.dictionary
        filled = ~pc.equal(words, "").to_numpy(zero_copy_only=False)
        a_has, b_has = np.zeros(len(words), bool), np.zeros(len(words), bool)
        a_has[code[:n]], b_has[code[n:]] = True, True
        shared = (a_has & b_has & filled)[code]
        mine, theirs = np.flatnonzero(shared[:n]), np.flatnonzero(shared[n:]) + n
        members.append((theirs, offset + code[theirs] * len(values) + amount[theirs]))
        for step in (-1, 0, 1):
            near = np.minimum(np.searchsorted(values, cents[mine] + step), len(values) - 1)
            found = values[near] == cents[mine] + step
            asks.append((mine[found], offset + code[mine[found]] * len(values) + near[found]))
        offset += len(words) * len(values)
    return tuple(tuple(np.concatenate(x) for x in zip(*some)) for some in (asks, members))


# --- long runs

PACKED = "run int, side int, first_r bigint, first_uid bigint, r binary, cents binary, day binary, owner binary, key binary"


def _in_row_order(long: DataFrame, days: int) -> DataFrame:
    """Pairs ``a_row, b_row`` of long runs of amounts, each settled in one task.

    Who takes whom hangs together over the whole run: cut by days, changes went
    over the cuts for hundreds of turns. So all that can be is done side by side
    before: partners by name are looked up, rows are sorted and packed as
    numbers. One task then goes once over the numbers of a run.
    """
    names = _names(long).withColumn("h", F.xxhash64("run", "kind", "k"))
    # Names whose rows are all near are found by their days. Names with one hash can only seem to lie further.
    far = (
        names.groupBy("h")
        .agg(F.min("day").alias("from"), F.max("day").alias("to"), F.min("side").alias("a"), F.max("side").alias("b"))
        .filter((F.col("a") == A) & (F.col("b") == B) & ((F.col("to") - F.col("from") > days) | (F.col("from") == NO_DAY)))
    )
    some, _ = _stored(names.join(far.select("h"), "h", "left_semi"))
    by = ["run", "kind", "k", "cents"]
    keys = cut(some.filter(F.col("side") == B).select(*by).distinct().withColumn("key", F.monotonically_increasing_id()))
    near = F.explode(F.sequence(F.col("cents") - 1, F.col("cents") + 1)).alias("cents")
    place = ["run", "side", "r", "uid"]
    asks = some.filter(F.col("side") == A).select(*place, "kind", "k", near)
    members = some.filter(F.col("side") == B).select(*place, "kind", "k", "cents")
    links = asks.unionByName(members).join(keys, by).select(*place, "key")
    none = F.lit(None)
    stream = long.select(*place, "cents", "day", none.cast("bigint").alias("key")).unionByName(
        links.select(*place, none.cast("bigint").alias("cents"), none.cast("int").alias("day"), "key")
    )
    # A link comes after its row, as nulls come first.
    packed = stream.repartitionByRange(*place).sortWithinPartitions(*place, "key").mapInArrow(_packed, PACKED)
    return (
        packed.repartition("run")
        .sortWithinPartitions("run", "side", "first_r", "first_uid")
        .mapInArrow(_unpacked(days), PAIRS)
    )


def _names(long: DataFrame) -> DataFrame:
    """One row per id and check number of a transaction: ``kind, k`` beside its own columns."""
    own, check = (
        long.filter(F.col(c) != "").select("run", "side", "r", "uid", "cents", "day", F.lit(kind).alias("kind"), F.col(c).alias("k"))
        for kind, c in (("i", "id"), ("c", "chk"))
    )
    return own.unionByName(check)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows and links, one row of bytes per batch, run and side."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run, side, r, uid = (batch[c].to_numpy() for c in ("run", "side", "r", "uid"))
        starts = np.flatnonzero(np.diff(run, prepend=-1).astype(bool) | np.diff(side, prepend=-1).astype(bool))
        out = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            part = batch.slice(start, end - start)
            own = part.filter(pc.is_null(part["key"]))
            link = pc.is_valid(part["key"]).to_numpy(zero_copy_only=False)
            # -1 is the last row of the piece before.
            owner = (np.cumsum(~link) - 1)[link].astype(np.int32)
            out.append({
                "run": int(run[start]), "side": int(side[start]), "first_r": int(r[start]), "first_uid": int(uid[start]),
                "r": own["r"].to_numpy().tobytes(), "cents": own["cents"].to_numpy().tobytes(), "day": own["day"].to_numpy().tobytes(),
                "owner": owner.tobytes(), "key": part["key"].drop_null().to_numpy().tobytes(),
            })
        yield pa.RecordBatch.from_pylist(out, schema=_PACKED)


_PACKED = pa.schema(
    [("run", pa.int32()), ("side", pa.int32()), ("first_r", pa.int64()), ("first_uid", pa.int64())]
    + [(c, pa.binary()) for c in ("r", "cents", "day", "owner", "key")]
)
_TYPES = {"r": np.int64, "cents": np.int64, "day": np.int32, "owner": np.int32, "key": np.int64}


def _unpacked(days: int):
    """The rule on whole runs, whose pieces come in row order, A before B."""

    def settle(pieces: dict[str, list[np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
        r, owner, key = (np.concatenate(pieces.pop(c)) for c in ("r", "owner", "key"))
        of_a = owner < n
        asks, members = (owner[of_a], key[of_a]), (owner[~of_a], key[~of_a])
        del owner, key
        mate = _settle(np.concatenate(pieces.pop("cents")), np.concatenate(pieces.pop("day")), n, days, asks, members)
        for start in range(0, n, LOOKUP_ROWS):
            theirs = mate[start : start + LOOKUP_ROWS]
            mine = np.flatnonzero(theirs >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(r[mine + start]), pa.array(r[theirs[mine]])], ["a_row", "b_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[np.ndarray]] = {}
        now, rows, n = None, 0, 0
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["run"] != now:
                    if pieces:
                        yield from settle(pieces, n)
                    now, rows, n, pieces = piece["run"], 0, 0, {c: [] for c in _TYPES}
                for c, kind in _TYPES.items():
                    values = np.frombuffer(piece[c], kind)
                    pieces[c].append(values + rows if c == "owner" else values)
                size = len(pieces["r"][-1])
                rows += size
                n += size if piece["side"] == A else 0
        if pieces:
            yield from settle(pieces, n)

    return run


def reconcile(a: DataFrame, b: DataFrame, days: int = 3, row: str = ROW, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every transaction of both sides: ``status, a_row, b_row``.

    Status is matched, unmatched_a or unmatched_b.
    """
    pairs = match_pairs(a, b, days, row, run_rows)
    only_a = a.select(F.col(row).alias("a_row")).join(pairs.select("a_row"), "a_row", "left_anti")
    only_b = b.select(F.col(row).alias("b_row")).join(pairs.select("b_row"), "b_row", "left_anti")
    none = F.lit(None).cast("bigint")
    return (
        pairs.select(F.lit("matched").alias("status"), "a_row", "b_row")
        .unionByName(only_a.select(F.lit("unmatched_a").alias("status"), "a_row", none.alias("b_row")))
        .unionByName(only_b.select(F.lit("unmatched_b").alias("status"), none.alias("a_row"), "b_row"))
    )


def reconcile_report(a: DataFrame, b: DataFrame, result: DataFrame) -> DataFrame:
    """Counts, totals and discrepancy of a reconciliation, as one row."""

    def total(df: DataFrame) -> Column:
        return df.agg(F.coalesce(F.sum(money(F.col("amount"))), F.lit(0)).cast("decimal(38,2)")).scalar()

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    counts = result.agg(n("matched"), n("unmatched_a"), n("unmatched_b"))
    return counts.select(
        ((F.col("unmatched_a") == 0) & (F.col("unmatched_b") == 0)).alias("reconciled"),
        "matched",
        "unmatched_a",
        "unmatched_b",
        total(a).cast("double").alias("total_a"),
        total(b).cast("double").alias("total_b"),
    ).withColumn("discrepancy", F.abs(F.col("total_a") - F.col("total_b")))
