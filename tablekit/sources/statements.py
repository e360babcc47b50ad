"""Bank statements in QIF and OFX/QFX/QBO text.

Files are cut at the end of each transaction, so that a large file is read by
many tasks. What a transaction needs from earlier in its file, its account, is
a running count of account headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.coerce import strip
from tablekit.operators.ledger import MONEY, ofx_date, qif_date
from tablekit.operators.rows import ROW, running_total
from tablekit.session import cut
from tablekit.sources.lines import ORDER, pieces, without_bom


def leading_number(c: Column) -> Column:
    """The number a text starts with, thousands commas left out; 0 when there is none."""
    digits = F.regexp_extract(F.replace(strip(c), F.lit(","), F.lit("")), r"^[+-]?(\d+\.?\d*|\.\d+)", 0)
    return F.coalesce(digits.try_cast(MONEY), F.lit(0).cast(MONEY))


def detect_format(spark: SparkSession, path: str) -> DataFrame:
    """``file, format``: QIF, QBO, QFX, OFX or UNKNOWN."""
    lines = without_bom(pieces(spark, path))
    v = F.col("value")
    facts = lines.groupBy("file").agg(
        F.min_by(strip(v), F.when(strip(v) != "", F.struct("block", "_seq"))).alias("first"),
        F.max(strip(v).startswith("!Option:")).alias("option"),
        F.max(v.rlike(r"(?i)<APPID>QBO|APPID:QBO|<INTU\.BID>")).alias("qbo"),
        F.max(v.rlike(r"(?i)<APPID>QFX|APPID:QFX|<INTU\.USERID>")).alias("qfx"),
        F.max(v.contains("<OFX>") | v.contains("OFXHEADER:")).alias("ofx"),
    )
    kind = (
        F.when(F.col("first").startswith("!Type:") | F.col("first").startswith("!Account") | F.col("option"), "QIF")
        .when(F.col("qbo"), "QBO")
        .when(F.col("qfx"), "QFX")
        .when(F.col("ofx"), "OFX")
        .otherwise("UNKNOWN")
    )
    return facts.select("file", kind.alias("format"))


# Rows of facts about accounts or files that are sent to all tasks; of more none holds most transactions.
SENT_ROWS = 50_000


def _facts(df: DataFrame) -> DataFrame:
    """One row per account or file, ready to be joined without gathering the transactions of an account."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= SENT_ROWS else kept


def _accounts(chunks: DataFrame, opens: Column, is_tx: Column) -> DataFrame:
    """Add per-file ``account_no`` and, inside an account, ``tx_no`` (both from 1)."""
    numbered = running_total(
        chunks.withColumns({"_opens": opens.cast("int"), "_tx": is_tx.cast("int")}),
        ORDER,
        {"_o": F.col("_opens"), "_t": F.col("_tx")},
    ).withColumn("_acct", F.col("_o") + F.col("_opens"))
    # One row per account, and per file, from partial minima.
    starts = _facts(numbered.groupBy("file", "_acct").agg(F.min("_t").alias("_t0")))
    files = _facts(starts.groupBy("file").agg(F.min("_acct").alias("_a0")))
    return (
        numbered.join(starts, ["file", "_acct"])
        .join(files, "file")
        .withColumns({"account_no": F.col("_acct") - F.col("_a0") + 1, "tx_no": F.col("_t") - F.col("_t0") + 1})
    )


# --- QIF --------------------------------------------------------------------


def read_qif(spark: SparkSession, path: str) -> DataFrame:
    """Transactions: ``file, account, account_type, id, type, date, amount, payee, …, splits``."""
    chunks = without_bom(pieces(spark, path, "\n^"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda s: strip(s)), lambda s: s != "")
    chunks = chunks.withColumn("_lines", lines)
    header = F.filter("_lines", lambda s: s.startswith("!Type:"))
    about = F.exists("_lines", lambda s: s.startswith("!Account"))
    fields = F.filter("_lines", lambda s: ~s.startswith("!"))
    is_tx = ~about & (F.size(fields) > 0)
    chunks = chunks.withColumns({"_header": header, "_is_tx": is_tx, "_fields": fields}).drop("value", "_lines")
    # The account a file starts with is there already; its header only names it.
    firsts = chunks.groupBy("file").agg(F.min(F.when(F.col("_is_tx"), F.struct("block", "_seq"))).alias("_f"))
    chunks = chunks.join(firsts, "file").withColumn("_first", F.struct("block", "_seq") <= F.col("_f")).drop("_f")
    opens = (F.size("_header") > 0) & ~F.coalesce(F.col("_first"), F.lit(True))
    placed = _accounts(chunks, opens, F.col("_is_tx"))
    types = _facts(
        placed.groupBy("file", "account_no").agg(
            F.max_by(F.element_at("_header", -1), F.when(F.size("_header") > 0, F.struct("block", "_seq"))).alias("_type")
        )
    )

    def field(code: str) -> Column:
        """The value of the last line with a code."""
        hits = F.filter("_fields", lambda s: F.left(s, F.lit(1)).isin(list(code)))
        return F.coalesce(F.trim(F.substr(F.try_element_at(hits, F.lit(-1)), F.lit(2))), F.lit(""))

    amount = leading_number(field("TU"))
    return (
        placed.filter("_is_tx")
        .join(types, ["file", "account_no"])
        .select(
            "file",
            F.when(F.col("account_no") == 1, "Default")
            .otherwise(F.concat(F.lit("Account-"), F.col("account_no").cast("string")))
            .alias("account"),
            F.coalesce(F.trim(F.substr("_type", F.lit(7))), F.lit("Bank")).alias("account_type"),
            F.concat(F.lit("qif-"), F.col("tx_no").cast("string")).alias("id"),
            F.when(amount < 0, "DEBIT").when(amount > 0, "CREDIT").otherwise("OTHER").alias("type"),
            qif_date(field("D")).alias("date"),
            amount.alias("amount"),
            field("P").alias("payee"),
            field("M").alias("memo"),
            field("L").alias("category"),
            field("N").alias("check_number"),
            field("C").alias("cleared"),
            _splits(F.col("_fields")).alias("splits"),
            F.struct("block", "_seq").alias("_place"),
        )
        .withColumn(ROW, F.col("_place._seq"))
        .drop("_place")
    )


def _splits(fields: Column) -> Column:
    """S opens a split; $ and E fill the last one."""
    split = "array<struct<category:string,amount:decimal(18,2),memo:string>>"
    lines = F.filter(fields, lambda s: F.left(s, F.lit(1)).isin("S", "$", "E"))

    def step(acc: Column, s: Column) -> Column:
        code, value = F.left(s, F.lit(1)), F.trim(F.substr(s, F.lit(2)))
        last = F.try_element_at(acc, F.lit(-1))
        opened = F.concat(
            acc, F.array(F.struct(value.alias("category"), F.lit(0).cast(MONEY).alias("amount"), F.lit("").alias("memo")))
        )
        changed = F.struct(
            last["category"].alias("category"),
            F.when(code == "$", leading_number(value)).otherwise(last["amount"]).alias("amount"),
            F.when(code == "E", value).otherwise(last["memo"]).alias("memo"),
        )
        filled = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(changed))
        return F.when(code == "S", opened.cast(split)).when(F.size(acc) > 0, filled.cast(split)).otherwise(acc)

    return F.aggregate(lines, F.array().cast(split), step)


# --- OFX --------------------------------------------------------------------


def tag_value(text: Column, tag: str) -> Column:
    """The value of the first such tag, closed or not; empty when absent."""
    return F.trim(F.regexp_extract(text, rf"(?i)<{tag}>([^<\r\n]*)", 1))


STATEMENT = r"(?is)^.*<(STMTRS|CCSTMTRS|INVSTMTRS)>"


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of OFX, QFX and QBO files, with their account's data."""
    # Large files are split at the usual spelling of the mark, pieces at any other.
    marks = F.explode(F.split("value", "(?i)</STMTTRN>")).alias("value")
    chunks = without_bom(pieces(spark, path, "</STMTTRN>")).select("file", "block", "file_size", marks)
    chunks = chunks.withColumn("_seq", F.monotonically_increasing_id())
    is_tx = F.col("value").rlike("(?i)<STMTTRN>")
    before = F.when(is_tx, F.regexp_replace("value", r"(?is)<STMTTRN>.*$", "")).otherwise(F.col("value"))
    chunks = chunks.withColumns(
        {
            "_is_tx": is_tx,
            "_before": before,
            "_body": F.regexp_replace("value", r"(?is)^.*<STMTTRN>", ""),
            "_kind": F.upper(F.regexp_extract(before, STATEMENT, 1)),
        }
    ).drop("value")
    placed = _accounts(chunks, F.col("_kind") != "", F.col("_is_tx"))
    head = F.when(F.col("_kind") != "", F.regexp_replace("_before", STATEMENT, ""))
    accounts = placed.filter("_kind <> ''").select("file", "account_no", "_kind", head.alias("_head"))
    # A balance stands behind its account's transactions, before the next account's head.
    tail = F.regexp_replace("_before", r"(?is)<(STMTRS|CCSTMTRS|INVSTMTRS)>.*$", "")
    balances = (
        placed.select("file", (F.col("account_no") - F.col("_opens")).alias("account_no"), tail.alias("_tail"), "block", "_seq")
        .filter(F.col("_tail").rlike("(?i)<BALAMT>"))
        .groupBy("file", "account_no")
        .agg(F.min_by("_tail", F.struct("block", "_seq")).alias("_tail"))
    )
    info = _facts(accounts.join(balances, ["file", "account_no"], "left"))

    def or_else(c: Column, default: Column | str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)

    default_type = F.when(F.col("_kind") == "CCSTMTRS", "CREDITCARD").when(F.col("_kind") == "INVSTMTRS", "INVESTMENT").otherwise("CHECKING")
    b = F.col("_body")
    return (
        placed.filter("_is_tx")
        .join(info.withColumnRenamed("_kind", "_akind"), ["file", "account_no"])
        .withColumn("_kind", F.col("_akind"))
        .select(
            "file",
            or_else(tag_value(F.col("_head"), "ACCTID"), "Default").alias("account"),
            or_else(tag_value(F.col("_head"), "ACCTTYPE"), default_type).alias("account_type"),
            or_else(tag_value(F.col("_head"), "CURDEF"), "USD").alias("currency"),
            tag_value(F.col("_head"), "BANKID").alias("bank_id"),
            tag_value(F.col("_head"), "BRANCHID").alias("branch_id"),
            leading_number(F.coalesce(tag_value(F.col("_tail"), "BALAMT"), F.lit(""))).alias("balance"),
            ofx_date(tag_value(F.col("_tail"), "DTASOF")).alias("balance_date"),
            or_else(tag_value(b, "FITID"), F.concat(F.lit("fit-"), F.col("tx_no").cast("string"))).alias("id"),
            or_else(tag_value(b, "TRNTYPE"), "OTHER").alias("type"),
            ofx_date(tag_value(b, "DTPOSTED")).alias("date"),
            leading_number(tag_value(b, "TRNAMT")).alias("amount"),
            tag_value(b, "NAME").alias("payee"),
            or_else(tag_value(b, "MEMO"), tag_value(b, "REFNUM")).alias("memo"),
            tag_value(b, "CHECKNUM").alias("check_number"),
            F.col("_seq").alias(ROW),
        )
    )
