"""Text of typed columns: how a number looks as a symbol, as a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import debug


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _exponential(s: Column) -> Column:
    """Java's text of a positive double with an exponent, as positional text."""
    power = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    raw = F.regexp_replace(F.regexp_extract(s, r"^([0-9.]+)E", 1), r"\.", "")

    def place(x: Column) -> Column:
        digits, p = x["digits"], x["power"]
        n = F.length(digits)
        large = F.when(p + 1 >= n, F.rpad(digits, p + 1, F.lit("0"))).otherwise(F.concat(digits.substr(F.lit(1), p + 1), F.lit("."), digits.substr(p + 2, n)))
        return F.when(p < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), digits)).otherwise(large)

    trimmed = F.concat(F.left(raw, F.lit(1)), F.regexp_replace(F.substring(raw, 2, 400), "0+$", ""))
    return let(F.struct(trimmed.alias("digits"), power.alias("power")), place)


def display(c: Column) -> Column:
    """A double as positional text without an exponent and without a trailing .0."""

    def show(s: Column) -> Column:
        sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        a = F.regexp_replace(s, "^-", "")
        return F.when(s == "NaN", s).when(a == "Infinity", F.concat(sign, F.lit("inf"))).when(s.contains("E"), F.concat(sign, _exponential(a))).otherwise(F.regexp_replace(s, r"\.0$", ""))

    return let(c.cast("double").cast("string"), show)


def debugged(c: Column) -> Column:
    """A double with at least one fractional digit, and with an exponent below 1e-4 and from 1e16."""

    def show(x: Column) -> Column:
        a = F.abs(x)
        dotted = let(display(x), lambda t: F.when(t.contains("."), t).otherwise(F.concat(t, F.lit(".0"))))
        wide = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E", "e")
        return F.when(F.isnan(x) | (a == float("inf")), display(x)).when((x == 0) | ((a >= 1e-4) & (a < 1e16)), dotted).otherwise(wide)

    return let(c.cast("double"), show)


def text_of(c: Column, kind: T.DataType, shown: str | None = None) -> Column:
    """The symbol that a typed column stands for, as a string."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return display(c) if shown == "display" else debugged(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    return c.cast("string")


def literal(value: bytes, kind: T.DataType):
    """The value of a type that a symbol stands for, or None if no value of the type looks like it."""
    try:
        text = value.decode()
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return int(text) if str(int(text)) == text else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text) if debug(float(text)) == text else None
        return text
    except ValueError:
        return None


def number_of(c: Column, kind: T.DataType) -> Column:
    """A double from a typed column; null where text is no float."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        t = c.cast("string")
        t = F.when(t.rlike(r"^(?i)[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"), t)
        return t.try_cast("double")
    return c.cast("double")


def whole_of(c: Column, kind: T.DataType) -> Column:
    """An unsigned 32-bit integer from a typed column; null where it is none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = c.cast("long")
    else:
        t = text_of(c, kind)
        n = F.when(t.rlike(r"^\+?[0-9]{1,12}$"), t).try_cast("long")
    return F.when(n.between(0, 2**32 - 1), n)
