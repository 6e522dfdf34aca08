"""Scalar functions: tables of cases, and properties against plain Python."""

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import fuzzy
from recordloom.functions import text as X
from recordloom.functions import validators as V


def apply(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


LR = {"L848501350": "848501350", "0000001350": "1350", "LR-8485.0135": "84850135", " lr 848 501 350 ": "848501350", "LR0000123": "123", "0000": "0", "LR": "", "": "", None: "", "L848501350A": "848501350A"}
DIGITS = {"848501350": "8501350", "1350": "1350", "848501350A": "8501350", "": ""}
DATES = {**{d: ("2026-09-05", True) for d in ("05.09.2026", "05/09/2026", "05-09-2026", "5/9/2026", "05/09/26", "2026-09-05", "05 . 09 . 2026", "05/09/2026 noise")}, "03/09/2026": ("2026-09-03", True), "32/13/2026": ("32/13/2026", False), "N/A": ("N/A", False), "": ("", True), None: ("", True), "05.09/2026": ("05.09/2026", False), "5/9/026": ("5/9/026", False), "1/1/68": ("2068-01-01", True), "1/1/69": ("1969-01-01", True), "29/2/2023": ("29/2/2023", False)}
NUMBERS = {"1,200": 1200.0, "10,625.50": 10625.5, "12.5 MT": 12.5, "8500KG": 8500.0, "3 TON": 3.0, "RS. 98,750.00": 98750.0, "INR 1200": 1200.0, "₹1,500.25": 1500.25, "12.34567": 12.346, "-45.5": -45.5, "1200": 1200.0, "ABC": None, "MT": None, "": None, None: None, "1_000": None, "1.0d": None, "NaN": None, "1e3": 1000.0}


def test_lr_numbers(spark):
    assert apply(spark, LR, X.lr_number("x")) == [(v,) for v in LR.values()]
    assert apply(spark, DIGITS, X.lr_digits("x")) == [(v,) for v in DIGITS.values()]


def test_dates(spark):
    assert apply(spark, DATES, X.date_norm("x"), X.date_ok("x")) == list(DATES.values())


def test_numbers(spark):
    got = apply(spark, NUMBERS, X.number_value("x"), X.number_ok("x"))
    assert [g[0] for g in got] == list(NUMBERS.values())
    assert [g[1] for g in got] == [v is not None or k in ("", None) for k, v in NUMBERS.items()]


def test_three_number_parsers_differ(spark):
    got = apply(spark, ["-45.5", "RS. 98,750.00", "1200", "B4008.60", ".", None], X.number_value("x"), X.to_float("x"), X.as_float("x"))
    assert got == [(-45.5, 45.5, 45.5), (98750.0, None, None), (1200.0, 1200.0, None), (None, 4008.6, 4008.6), (None, None, None), (None, None, None)]


def test_vehicles_and_cleaning(spark):
    assert apply(spark, ["MH 12 AB 1234", "mh-12-ab-1234", "MH.12.AB.1234", ""], X.vehicle_no("x")) == [("MH12AB1234",)] * 3 + [("",)]
    assert apply(spark, [" : - 12 ", "  ", None, "\t'\"a "], X.clean_extracted("x")) == [("12",), ("  ",), (None,), ("a",)]


def test_captions_and_keys(spark):
    assert apply(spark, [". fe) wee . AMOUNT , 4 : OTe", "x", "S-NO."], X.caption_key("x"), X.caption_words("x")) == [("fe_wee_amount_ote", "fe) wee amount ote"), ("", ""), ("s_no", "s-no.")]
    assert apply(spark, ["*Invoice date:-", "• p.o. NUMBER"], X.field_key("x")) == [("Invoice_Date",), ("P_O_Number",)]
    assert apply(spark, ["lr_date 3rd o'neil"], X.header("x")) == [("Lr Date 3Rd O'Neil",)]
    assert apply(spark, ["Amount :- 23,30,645/-", "12:30", "none"], X.inline_pair("x")["label"], X.inline_pair("x")["value"]) == [("Amount", "23,30,645/-"), (None, None), (None, None)]


def test_cover_values(spark):
    got = apply(spark, ["4500237065 A", "| Acme Ltd.", "on 10.06.2026 |", "If Yes Amount:- 23,30,645 /-"], *[X.COVER_CLEANERS[n]("x") for n in ("po_number", "vendor_name", "invoice_date", "penalty_amount")])
    assert (got[0][0], got[1][1], got[2][2], got[3][3]) == ("4500237065", "Acme Ltd", "10.06.2026", "23,30,645/-")


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (V.sr_no, ["1", " 999 "], ["0", "1000", "", None, "a", "-1"]),
        (V.shipment_no, ["1234567", "123456789 "], ["123456", "1234567890", "12345a7", None]),
        (V.gross_qty, ["33.96", "1.5"], ["33,96", "1000.0", "33", "1.234", ""]),
        (V.date, ["05.09.2026"], ["", None, "31/02/2026"]),
        (V.delivery_timestamp, ["15 May 26 05:55 am", "5 may 26 05:55 PM"], ["15 May 2026", "", None]),
        (lambda x: V.amount(x)["valid"], ["1,200.50", "7"], ["", "RS 7", "1.", None]),
        (lambda x: V.vehicle(x)["valid"], ["MH 12-ab 1"], ["", "MH/12", None]),
        (V.vehicle_code, ["MH12", " a1 "], ["MH 12", "", None]),
        (V.plausible_value, ["37", "AB1", "1/2/26", "1,200.50"], ["x", "", "a b", None]),
        (V.looks_like_value, ["23,30,645/-", "10.06.2026", "20050923"], ["Name", "", "P1"]),
    ],
)
def test_validators(spark, check, good, bad):
    assert [r[0] for r in apply(spark, good + bad, check("x"))] == [True] * len(good) + [False] * len(bad)


def test_fuzzy_ratios():
    assert fuzzy.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert fuzzy.token_sort_ratio("no lr", "lr no") == 100 and fuzzy.partial_ratio("abcd", "xxabcdyy") == 100
    assert fuzzy.ratio("", "") == 100 and fuzzy.partial_ratio("", "a") == 0


@settings(max_examples=20, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert fuzzy._common(a, b) == t[-1][-1]


def plain_date(x):
    c = re.sub(r"\s+", "", x)
    m = re.match(r"[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{2,4}", c)
    k = m[0] if m else c
    for form in ("%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%y", "%d/%m/%y", "%d-%m-%y", "%Y-%m-%d"):
        try:
            return datetime.strptime(k, form).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return x.strip()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.builds(lambda d, s, m, t, y: f"{d}{s}{m}{t}{y}", st.integers(0, 33), st.sampled_from("./-"), st.integers(0, 14), st.sampled_from("./-"), st.sampled_from(["26", "2026", "1999", "70", "68", "026"])), min_size=20, max_size=40))
def test_dates_like_plain_python(spark, values):
    assert [r[0] for r in apply(spark, values, X.date_norm("x"))] == [plain_date(v) for v in values]


def test_lists_as_cells(spark):
    rows = spark.sql("SELECT array('a', 'b') x UNION ALL SELECT CAST(NULL AS array<string>)")
    assert sorted(r[0] for r in rows.select(X.cell_value(F.col("x"))).collect()) == ["", "a, b"]
