"""Cleaning of text, keys, numbers and dates as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What scans leave before a value, currency marks, and unit marks.
LEADING_JUNK = ":.-_>*'\"` "
CURRENCY = r"^(?:RS|INR|₹|\$)\.?"
UNITS = r"(?:TONNES|TONNE|TONS|TON|KGS|KG|MTS|MT|RS|INR)\.?$"
#: Fixed value: all characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?\z"
SPACE = r"(?U)\s+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends; null is empty."""
    return F.btrim(F.coalesce(col(x), F.lit("")), F.lit(WHITE))


def blank_to_null(x: Column | str) -> Column:
    s = strip(x)
    return F.when(s != "", s)


def clean_extracted(x: Column | str) -> Column:
    """Stripped, without leading junk, stripped again; null and blank stay as they are."""
    x = col(x)
    t = strip(F.ltrim(strip(x), F.lit(LEADING_JUNK)))
    return F.when(x.isNull() | (strip(x) == ""), x).otherwise(t)


def lr_number(x: Column | str) -> Column:
    """Upper-case letters and digits without leading letters and zeros; all zeros give 0, letters alone nothing."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(col(x), F.lit(""))), "[^A-Z0-9]", ""), "^[A-Z]+", "")
    return F.when(t.rlike("^0+$"), "0").otherwise(F.regexp_replace(t, "^0+", ""))


def lr_digits(x: Column | str, length: int = 7) -> Column:
    """The last digits of a normalised number."""
    return F.right(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^0-9]", ""), F.lit(length))


DAY_FIRST = r"^([0-9]{1,2})([./\-])([0-9]{1,2})\2"
YEAR_MONTH = "$4-$3-$1"


def _parsed_date(x: Column) -> Column:
    c = F.translate(F.coalesce(x, F.lit("")), WHITE, "")
    full = DAY_FIRST + r"([0-9]{4})$"  # by far the most frequent shape: the others are looked at where it fails
    head = F.regexp_extract(c, r"^[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{2,4}", 0)
    k = F.when(head == "", c).otherwise(head)
    iso = F.when(c.rlike(full), F.regexp_replace(c, full, YEAR_MONTH)).when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), c)
    for year, century in ((r"([0-9]{4})$", ""), (r"(69|[7-9][0-9])$", "19"), (r"([0-9]{2})$", "20")):
        iso = iso.when(k.rlike(DAY_FIRST + year), F.regexp_replace(k, DAY_FIRST + year, century + YEAR_MONTH))
    return F.try_to_date(iso, "yyyy-M-d")


def date_value(x: Column | str) -> Column:
    """The day-first date of a text as DATE; null if there is none."""
    return _parsed_date(col(x))


def date_norm(x: Column | str) -> Column:
    """C4: the date as yyyy-MM-dd, or the stripped text where none is found."""
    d = _parsed_date(col(x))
    return F.when(strip(x) == "", "").when(d.isNotNull(), F.date_format(d, "yyyy-MM-dd")).otherwise(strip(x))


def date_ok(x: Column | str) -> Column:
    return (strip(x) == "") | _parsed_date(col(x)).isNotNull()


def number_value(x: Column | str) -> Column:
    """The number of a text without separators, one currency mark and one unit, to three places (halves away from zero)."""
    n = F.upper(F.translate(F.coalesce(col(x), F.lit("")), "," + WHITE, ""))
    bare = F.regexp_replace(F.regexp_replace(n, CURRENCY, ""), UNITS, "")
    return F.round(F.when(n.rlike(NUMBER), n.try_cast("double")).when(n.rlike("[0-9]") & bare.rlike(NUMBER), bare.try_cast("double")), 3)


def number_ok(x: Column | str) -> Column:
    return (strip(x) == "") | number_value(x).isNotNull()


def vehicle_no(x: Column | str) -> Column:
    """C6."""
    return F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^A-Za-z0-9]+", ""))


def to_float(x: Column | str) -> Column:
    """C17: the digits and points of a text as a number; signs are lost, two points give null."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^0-9.]", "").try_cast("double")


def as_float(x: Column | str) -> Column:
    """As to_float, but only with digits on both sides of one point."""
    n = F.regexp_replace(F.coalesce(col(x), F.lit("")), "[^0-9.]", "")
    return F.when(n.rlike(r"^[0-9]+\.[0-9]+\z"), n.try_cast("double"))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(strip(x), SPACE), lambda t: t != "")


def _alnum(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))


def caption_words(x: Column | str) -> Column:
    """Lower-cased words of a caption with two letters or digits, that make half of the word, at least."""
    kept = F.filter(_tokens(col(x)), lambda t: (_alnum(t) >= 2) & (_alnum(t) >= F.length(t) * 0.5))
    return F.lower(F.array_join(kept, " "))


def caption_key(x: Column | str, longest: int = 30) -> Column:
    """A caption as a column name, or empty."""
    kept = F.filter(_tokens(col(x)), lambda t: (_alnum(t) >= 2) & (_alnum(t) >= F.length(t) * 0.6))
    name = F.trim(F.regexp_replace(F.lower(F.array_join(kept, " ")), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.length(F.regexp_replace(name, "[^a-z]", "")) < 2, "").otherwise(F.trim(F.left(name, F.lit(longest)), F.lit("_")))


def _titled(word: Column) -> Column:
    """First letter of each run of letters upper, the others lower."""
    runs = F.regexp_extract_all(word, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def header(x: Column | str) -> Column:
    """K6: underscores as blanks, stripped, each run of letters in title case."""
    return _titled(strip(F.replace(F.coalesce(col(x), F.lit("")), F.lit("_"), F.lit(" "))))


def field_key(x: Column | str) -> Column:
    """A label as a key: edge marks off, other marks as blanks, words in title case joined by underscores."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^[\s*\-.•]+", ""), r"[\s:*\-.]+$", "")
    return F.array_join(F.transform(_tokens(F.regexp_replace(t, r"[^0-9A-Za-z_\s]", " ")), _titled), "_")


def row_label(x: Column | str) -> Column:
    """C32."""
    return strip(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z ]", " "))


def edge_trimmed(x: Column | str) -> Column:
    t = strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.when(t != "", t)


def _first(x: Column | str, pattern: str, group: int = 0) -> Column:
    m = F.regexp_extract(F.coalesce(col(x), F.lit("")), pattern, group)
    return F.when(m != "", m)


#: What each field of a cover form is read as.
COVER_CLEANERS = {
    "vendor_name": edge_trimmed,
    "vendor_code": lambda x: F.coalesce(_first(x, r"[0-9][0-9,]{3,}"), edge_trimmed(x)),
    "po_number": lambda x: F.coalesce(_first(x, r"[0-9][0-9,]{3,}"), edge_trimmed(x)),
    "grn_srn_number": lambda x: F.coalesce(_first(x, r"[0-9][0-9,]{3,}"), edge_trimmed(x)),
    "invoice_number": edge_trimmed,
    "invoice_date": lambda x: F.coalesce(_first(x, r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"), edge_trimmed(x)),
    "penalty_amount": lambda x: F.coalesce(F.replace(_first(x, r"(?i)amount[^0-9]{0,6}([0-9,]+\s*/?-?)", 1), F.lit(" "), F.lit("")), edge_trimmed(x)),
    "invoice_amount": lambda x: F.coalesce(F.replace(_first(x, r"[0-9,]{3,}\s*/?-?"), F.lit(" "), F.lit("")), edge_trimmed(x)),
}


def barcode(x: Column | str) -> Column:
    """The first run of six letters or digits of the upper-cased text, or that text."""
    up = F.upper(F.coalesce(col(x), F.lit("")))
    return F.coalesce(_first(up, "[A-Z0-9]{6,}"), up)


def inline_pair(x: Column | str) -> Column:
    """(label, value) of a text "label: value" whose label has a letter; null otherwise."""
    p = r"^([^:]{2,60}):[\s\-]*(\S.*)$"
    label, value = F.regexp_extract(col(x), p, 1), F.regexp_extract(col(x), p, 2)
    return F.when(col(x).rlike(p) & label.rlike("[A-Za-z]"), F.struct(strip(label).alias("label"), strip(value).alias("value")))


def cell_value(x: Column | str) -> Column:
    """K7 for lists: joined by commas; null is empty."""
    return F.coalesce(F.array_join(col(x), ", "), F.lit(""))
