"""Transactions as QIF and OFX/QFX/QBO text.

A statement is a table of ordered lines (``account, part, _row, text``): the
account's head, one row per transaction, the account's foot. The rows in order
are the file, so an account of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.fx import ENTITIES, xml_escape
from tablekit.operators.rows import ROW

ORDER = ["account", "part", ROW]


def _has(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _amount(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _coded(code: str, value: Column) -> Column:
    return F.concat(F.lit(code), value)


def qif_text(df: DataFrame) -> Column:
    """The lines of one transaction, ``^`` last."""
    lines = [
        _coded("D", F.date_format("date", "MM/dd/yyyy")),
        _coded("T", _amount(F.col("amount"))),
        *[
            _coded(code, _has(df, name))
            for code, name in (("C", "cleared"), ("N", "check_number"), ("P", "payee"), ("M", "memo"), ("L", "category"))
        ],
    ]
    if "splits" in df.columns:
        split = lambda s: F.concat_ws(
            "\n",
            _coded("S", F.nullif(s["category"], F.lit(""))),
            _coded("E", F.nullif(s["memo"], F.lit(""))),
            _coded("$", _amount(s["amount"])),
        )
        lines.append(F.nullif(F.array_join(F.transform("splits", split), "\n"), F.lit("")))
    return F.concat_ws("\n", *lines, F.lit("^"))


def _type(df: DataFrame, default: str) -> Column:
    return F.coalesce(_has(df, "account_type"), F.lit(default))


def qif_lines(df: DataFrame) -> DataFrame:
    """Ordered lines of a QIF file, by account."""
    heads = df.groupBy("account").agg(F.min(_type(df, "Bank")).alias("_t")).select(
        "account", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias(ROW), F.concat(F.lit("!Type:"), "_t").alias("text")
    )
    body = df.select("account", F.lit(1).alias("part"), F.col(ROW).cast("bigint").alias(ROW), qif_text(df).alias("text"))
    return heads.unionByName(body)


def _element(tag: str, value: Column, pad: int) -> Column:
    return F.concat(F.lit(" " * pad + f"<{tag}>"), value, F.lit(f"</{tag}>"))


def ofx_text(df: DataFrame) -> Column:
    """The STMTTRN block of one transaction."""
    amount = F.col("amount").cast("decimal(18,2)")
    kind = F.coalesce(_has(df, "type"), F.when(amount < 0, "DEBIT").otherwise("CREDIT"))

    def clean(name: str) -> Column:
        return xml_escape(_has(df, name), ENTITIES[:3])

    return F.concat_ws(
        "\n",
        F.lit(" " * 10 + "<STMTTRN>"),
        _element("TRNTYPE", kind, 12),
        _element("DTPOSTED", F.date_format("date", "yyyyMMdd"), 12),
        _element("TRNAMT", _amount(amount), 12),
        _element("FITID", F.coalesce(_has(df, "id"), F.concat(F.lit("TX-"), F.col(ROW).cast("string"))), 12),
        _element("CHECKNUM", _has(df, "check_number"), 12),
        _element("NAME", clean("payee"), 12),
        _element("MEMO", clean("memo"), 12),
        F.lit(" " * 10 + "</STMTTRN>"),
    )


def ofx_lines(df: DataFrame, form: str = "OFX", now: str | None = None, bank: str | None = None) -> DataFrame:
    """Ordered lines of the statements inside the message set, by account.

    First and last dates are those of the first and last transaction.
    """
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")
    currency = F.coalesce(_has(df, "currency"), F.lit("USD"))
    facts = df.groupBy("account").agg(
        F.min(_type(df, "CHECKING")).alias("kind"),
        F.min(currency).alias("currency"),
        F.min(_has(df, "bank_id")).alias("bank_id"),
        F.min_by("date", ROW).alias("first"),
        F.max_by("date", ROW).alias("last"),
        F.max(F.col("balance").cast("decimal(18,2)") if "balance" in df.columns else F.lit(0).cast("decimal(18,2)")).alias("balance"),
    )
    card = F.upper("kind").contains("CREDIT") | (F.upper("kind") == "CCARD")
    root = F.when(card, "CCSTMTRS").otherwise("STMTRS")
    owner = F.when(card, "CCACCTFROM").otherwise("BANKACCTFROM")

    def opened(tag: Column, pad: int, close: bool = False) -> Column:
        return F.concat(F.lit(" " * pad + ("</" if close else "<")), tag, F.lit(">"))

    head = F.concat_ws(
        "\n",
        F.lit("    <STMTTRNRS>"),
        F.lit("      <TRNUID>1</TRNUID>"),
        F.lit("      <STATUS><CODE>0</CODE><SEVERITY>INFO</SEVERITY></STATUS>"),
        opened(root, 6),
        _element("CURDEF", F.col("currency"), 8),
        opened(owner, 8),
        F.when(~card, _element("BANKID", F.col("bank_id"), 10)),
        _element("ACCTID", F.col("account"), 10),
        F.when(~card, _element("ACCTTYPE", F.col("kind"), 10)),
        opened(owner, 8, True),
        F.lit("        <BANKTRANLIST>"),
        _element("DTSTART", F.coalesce(F.date_format("first", "yyyyMMdd"), stamp), 10),
        _element("DTEND", F.coalesce(F.date_format("last", "yyyyMMdd"), stamp), 10),
    )
    foot = F.concat_ws(
        "\n",
        F.lit("        </BANKTRANLIST>"),
        F.lit("        <LEDGERBAL>"),
        _element("BALAMT", _amount(F.coalesce("balance", F.lit(0))), 10),
        _element("DTASOF", stamp, 10),
        F.lit("        </LEDGERBAL>"),
        opened(root, 6, True),
        F.lit("    </STMTTRNRS>"),
    )
    none = F.lit(None).cast("bigint").alias(ROW)
    heads = facts.select("account", F.lit(0).alias("part"), none, head.alias("text"))
    feet = facts.select("account", F.lit(2).alias("part"), none, foot.alias("text"))
    body = df.select("account", F.lit(1).alias("part"), F.col(ROW).cast("bigint").alias(ROW), ofx_text(df).alias("text"))
    return heads.unionByName(body).unionByName(feet)


def ofx_frame(form: str = "OFX", now: str = "20000101000000", bank: str | None = None) -> tuple[str, str]:
    """What stands before and after the statements in a file; QFX and QBO name a bank."""
    # The header lines of version 1.02.
    header = (
        "OFXHEADER:100", "DATA:OFXSGML", "VERSION:102", "SECURITY:NONE", "ENCODING:USASCII",
        "CHARSET:1252", "COMPRESSION:NONE", "OLDFILEUID:NONE", "NEWFILEUID:NONE", "",
    )
    own = []
    if form in ("QBO", "QFX"):
        own = [f"      <INTU.BID>{bank or ('3000' if form == 'QBO' else '2000')}</INTU.BID>", "      <INTU.USERID>USER</INTU.USERID>"]
    sign_on = [
        "<OFX>", "  <SIGNONMSGSRSV1>", "    <SONRS>",
        "      <STATUS><CODE>0</CODE><SEVERITY>INFO</SEVERITY></STATUS>",
        f"      <DTSERVER>{now}</DTSERVER>", "      <LANGUAGE>ENG</LANGUAGE>", *own,
        "    </SONRS>", "  </SIGNONMSGSRSV1>", "  <BANKMSGSRSV1>",
    ]
    return "\n".join([*header, *sign_on]), "  </BANKMSGSRSV1>\n</OFX>"


def write_statement(lines: DataFrame, path: str, head: str = "", foot: str = "") -> None:
    """Write ordered lines so that the files in name order are one statement file."""
    from tablekit.sinks.texts import write_framed

    if head:
        write_framed(lines, path, head, foot, ORDER)
    else:
        lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("text").write.mode("overwrite").text(path)
