"""Checks of single values. Each returns a boolean Column; blank and null values are not valid unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import col, date_ok, strip

#: Shapes of values.
DATE_SHAPE = r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\z"
TIMESTAMP_SHAPE = r"(?i)^[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}\s*(am|pm)?\z"
DECIMAL_SHAPE = r"^[0-9]+(,[0-9]{2,3})*\.[0-9]{2,3}\z"
DIGITS_SHAPE = r"^[0-9]+\z"
CODE_SHAPE = r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]+\z"
ALPHA_SHAPE = r"^[A-Za-z .]+\z"
DELIVERY_SHAPE = r"(?i)^[0-9]{1,2} \w{3} [0-9]{2} [0-9]{2}:[0-9]{2} (am|pm)\z"
VALUE_SHAPES = (r"^[0-9,]+(\.[0-9]+)?[/\-]*\z", DATE_SHAPE, DIGITS_SHAPE)


def sr_no(x: Column | str) -> Column:
    """C20: digits, 1 to 999."""
    n = strip(x)
    return F.coalesce(n.rlike(DIGITS_SHAPE) & n.try_cast("decimal(38,0)").between(1, 999), F.lit(False))


def shipment_no(x: Column | str) -> Column:
    """C21."""
    return strip(x).rlike(r"^[0-9]{7,9}\z")


def vehicle(x: Column | str) -> Column:
    """(value, valid, flags); a bad value is kept and flagged."""
    t = F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[\s\-]", ""))
    ok = t.rlike(r"^[A-Za-z0-9]+\z")
    flags = F.when((t == "") | ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("vehicle_no_unvalidated")))
    return F.struct(F.when(t != "", t).alias("value"), ok.alias("valid"), flags.alias("flags"))


def vehicle_code(x: Column | str, client_format: Column | None = None) -> Column:
    """Letters and digits after stripping, and the client's own format if it has one."""
    plain = strip(x).rlike(r"^[A-Za-z0-9]+\z")
    return plain if client_format is None else plain & F.coalesce(strip(x).rlike(client_format), F.lit(True))


def amount(x: Column | str) -> Column:
    """(value, valid): digits, and a point with digits, once commas and blanks are gone."""
    c = F.regexp_replace(strip(x), r"(?U)[,\s]", "")
    ok = c.rlike(r"^[0-9]+(\.[0-9]+)?\z")
    return F.struct(F.when(ok, c).alias("value"), ok.alias("valid"))


def gross_qty(x: Column | str) -> Column:
    """At most three digits before and two after the point; a comma is an error."""
    return strip(x).rlike(r"^[0-9]{1,3}\.[0-9]{1,2}\z")


def date(x: Column | str) -> Column:
    """C25."""
    return (strip(x) != "") & date_ok(x)


def delivery_timestamp(x: Column | str) -> Column:
    """C26."""
    return strip(x).rlike(DELIVERY_SHAPE)


def plausible_value(x: Column | str) -> Column:
    """digits, a code, a date or a decimal amount."""
    s = strip(x)
    return s.rlike(DIGITS_SHAPE) | s.rlike(CODE_SHAPE) | s.rlike(DATE_SHAPE) | s.rlike(DECIMAL_SHAPE)


def looks_like_value(x: Column | str) -> Column:
    """F8: shaped like data, not like a caption."""
    s = strip(x)
    return s.rlike(VALUE_SHAPES[0]) | s.rlike(VALUE_SHAPES[1]) | s.rlike(VALUE_SHAPES[2])
