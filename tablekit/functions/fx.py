"""Spreadsheet functions as Column helpers.

Range functions are aggregates over a column: blanks are left out, cells that
are no numbers are skipped, and an empty range gives 0. An error such as
``#NUM!`` or ``#DIV/0!`` is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablekit.functions.coerce import number, strip, text

Cell = Column | str | int | float | bool


def _c(x: Cell) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _n(x: Cell) -> Column:
    """A number; anything else counts as 0."""
    c = _c(x)
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _s(x: Cell) -> Column:
    return F.coalesce(text(_c(x)), F.lit(""))


# --- ranges -----------------------------------------------------------------


def fx_sum(c: Column) -> Column:
    return F.coalesce(F.sum(number(c)), F.lit(0.0))


def fx_average(c: Column) -> Column:
    return F.coalesce(F.avg(number(c)), F.lit(0.0))


def fx_min(c: Column) -> Column:
    return F.coalesce(F.min(number(c)), F.lit(0.0))


def fx_max(c: Column) -> Column:
    return F.coalesce(F.max(number(c)), F.lit(0.0))


def fx_count(c: Column) -> Column:
    return F.count(number(c))


def fx_counta(c: Column) -> Column:
    return F.count_if(c.isNotNull() & (text(c) != ""))


def fx_product(c: Column) -> Column:
    return F.coalesce(F.product(number(c)), F.lit(0.0))


# --- numbers ----------------------------------------------------------------


def _factor(places: Cell) -> Column:
    return F.pow(F.lit(10.0), _n(places))


def fx_round(x: Cell, places: Cell = 0) -> Column:
    return F.floor(_n(x) * _factor(places) + 0.5).cast("double") / _factor(places)


def fx_roundup(x: Cell, places: Cell = 0) -> Column:
    return F.ceil(_n(x) * _factor(places)).cast("double") / _factor(places)


def fx_rounddown(x: Cell, places: Cell = 0) -> Column:
    return F.floor(_n(x) * _factor(places)).cast("double") / _factor(places)


def fx_abs(x: Cell) -> Column:
    return F.abs(_n(x))


def fx_int(x: Cell) -> Column:
    return F.floor(_n(x)).cast("double")


def fx_mod(x: Cell, divisor: Cell) -> Column:
    """Remainder with the sign of the dividend; a divisor of 0 counts as 1."""
    d = _n(divisor)
    return _n(x) % F.when(d == 0, 1.0).otherwise(d)


def fx_power(x: Cell, y: Cell) -> Column:
    return F.pow(_n(x), _n(y))


def fx_sqrt(x: Cell) -> Column:
    return F.when(_n(x) >= 0, F.sqrt(_n(x)))


# --- logic ------------------------------------------------------------------


def fx_if(test: Column, then: Cell, otherwise: Cell | None = None) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), _c(then)).otherwise(
        F.lit(False) if otherwise is None else _c(otherwise)
    )


def fx_ifs(*pairs: Cell) -> Column:
    """The value of the first test that holds, ``#N/A`` if none does."""
    out = F.lit("#N/A")
    for test, value in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = F.when(F.coalesce(_c(test), F.lit(False)), text(_c(value))).otherwise(out)
    return out


def fx_and(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def fx_or(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def fx_not(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


# --- text -------------------------------------------------------------------


def fx_concat(*parts: Cell) -> Column:
    return F.concat(*[_s(p) for p in parts])


def fx_len(x: Cell) -> Column:
    return F.length(_s(x))


def _length(n: Cell) -> Column:
    """A count given by the user; 0 and blanks count as 1."""
    c = _n(n).cast("int")
    return F.when(c == 0, 1).otherwise(c)


def fx_left(x: Cell, n: Cell = 1) -> Column:
    return F.left(_s(x), _length(n))


def fx_right(x: Cell, n: Cell = 1) -> Column:
    return F.right(_s(x), _length(n))


def fx_mid(x: Cell, start: Cell, n: Cell) -> Column:
    return F.substr(_s(x), _length(start), F.greatest(_n(n).cast("int"), F.lit(0)))


def fx_upper(x: Cell) -> Column:
    return F.upper(_s(x))


def fx_lower(x: Cell) -> Column:
    return F.lower(_s(x))


def fx_trim(x: Cell) -> Column:
    return strip(_s(x))


def fx_proper(x: Cell) -> Column:
    """Upper case at each word start; other letters keep their case."""
    words = F.regexp_extract_all(_s(x), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""
    )


# --- time -------------------------------------------------------------------


def fx_now() -> Column:
    return F.current_timestamp()


def fx_today() -> Column:
    return F.current_date()


def fx_epoch_to_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(c)


def fx_timestamp_to_epoch(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def fx_uuid() -> Column:
    return F.uuid()


# --- operators --------------------------------------------------------------


def fx_divide(x: Cell, y: Cell) -> Column:
    """Quotient; division by 0 is an error, so null."""
    return F.try_divide(_n(x), _n(y))


def fx_add(x: Cell, y: Cell) -> Column:
    return _n(x) + _n(y)


def fx_subtract(x: Cell, y: Cell) -> Column:
    return _n(x) - _n(y)


def fx_multiply(x: Cell, y: Cell) -> Column:
    return _n(x) * _n(y)


def fx_join(x: Cell, y: Cell) -> Column:
    return F.concat(_s(x), _s(y))


def fx_compare(x: Cell, op: str, y: Cell) -> Column:
    """``= <> < <= > >=`` on numbers when both are, otherwise on text."""
    a, b = _c(x).try_cast("double"), _c(y).try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    tests = {
        "=": lambda p, q: p == q,
        "<>": lambda p, q: p != q,
        "<": lambda p, q: p < q,
        "<=": lambda p, q: p <= q,
        ">": lambda p, q: p > q,
        ">=": lambda p, q: p >= q,
    }
    return F.when(numeric, tests[op](a, b)).otherwise(tests[op](_s(x), _s(y)))


# --- XML entities -----------------------------------------------------------

# The five entities, ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(c: Column, entities=ENTITIES) -> Column:
    return reduce(lambda out, e: F.replace(out, F.lit(e[0]), F.lit(e[1])), entities, c)


def xml_unescape(c: Column) -> Column:
    """Decode the five entities and numeric references."""
    parts = F.regexp_extract_all(c, F.lit(r"&#[xX][0-9a-fA-F]+;|&#[0-9]+;|[^&]+|&"), F.lit(0))

    def decoded(p: Column) -> Column:
        hexa = F.conv(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
        code = F.when(p.rlike("^&#[xX]"), hexa).otherwise(F.regexp_extract(p, r"^&#([0-9]+);$", 1))
        n = code.try_cast("int")
        utf16 = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(
            F.concat(
                F.lpad(F.hex(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), 4, "0"),
                F.lpad(F.hex(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)), 4, "0"),
            )
        )
        return F.when(p.startswith("&#"), F.coalesce(F.decode(F.unhex(utf16), "UTF-16BE"), p)).otherwise(p)

    plain = F.array_join(F.transform(parts, decoded), "")
    return reduce(lambda out, e: F.replace(out, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), plain)
