"""Queries of single-value functions, over texts derived from orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.catalog import duck as D
from recordloom.functions import text as X
from recordloom.functions import validators as V
from recordloom.plans import derive

BILL = f"WITH {D.BILLS} "
RECEIPT = f"WITH {D.RECEIPTS} "


#: Captions and labels made of a customer's name and segment.
RAW = "concat(' *', c_name, ': ', lower(c_mktsegment), ' no. ', c_custkey % 97, ' -')"
RAW_SQL = "concat(' *', c_name, ': ', lower(c_mktsegment), ' no. ', c_custkey % 97, ' -')"
COVER = "concat('| ', c_mktsegment, ' 4500', c_custkey, ' Amount :- ', c_custkey % 90 + 10, ',', 100 + c_custkey % 900, '/- on ', 1 + c_custkey % 28, '.05.2026 }')"


def _customers(raw: str, **columns):
    return lambda s, d: derive.table(s, d, "customer").selectExpr("c_custkey", f"{raw} AS raw").select("c_custkey", *[c().alias(n) for n, c in columns.items()])


def _customers_sql(raw: str, **columns: str) -> str:
    return f"WITH c AS (SELECT c_custkey, {raw} AS raw FROM customer) SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM c"


_EDGE = f"nullif({D.strip('regexp_replace(raw, ' + chr(39) + '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '')"

QUERIES = {
    "lr_number_norm": (lambda s, d: derive.bills(s, d).select("bill_idx", X.lr_number("lr_no").alias("lr_no_norm")), BILL + f"SELECT bill_idx, {D.lr_number('lr_no')} AS lr_no_norm FROM bills"),
    "lr_digits": (lambda s, d: derive.receipts(s, d).select("lr_idx", X.lr_digits(X.lr_number("lr_no")).alias("digits")), RECEIPT + f"SELECT lr_idx, {D.lr_digits(D.lr_number('lr_no'))} AS digits FROM receipts"),
    "date_norm": (lambda s, d: derive.bills(s, d).select("bill_idx", X.date_norm("lr_date").alias("norm"), X.date_ok("lr_date").alias("ok"), X.date_value("lr_date").cast("string").alias("as_date")), BILL + f"SELECT bill_idx, {D.date_norm('lr_date')} AS norm, {D.date_ok('lr_date')} AS ok, CAST({D.date('lr_date')} AS VARCHAR) AS as_date FROM bills"),
    "number_norm": (lambda s, d: derive.receipts(s, d).select("lr_idx", X.number_value("amount").alias("amount_num"), X.number_ok("amount").alias("ok"), X.number_value("net_wt").alias("net_wt_num")), RECEIPT + f"SELECT lr_idx, {D.number('amount')} AS amount_num, {D.number_ok('amount')} AS ok, {D.number('net_wt')} AS net_wt_num FROM receipts"),
    "vehicle_norm": (lambda s, d: derive.receipts(s, d).select("lr_idx", X.vehicle_no("truck_no").alias("vehicle")), RECEIPT + f"SELECT lr_idx, {D.vehicle('truck_no')} AS vehicle FROM receipts"),
    "clean_text": (lambda s, d: derive.receipts(s, d).select("lr_idx", X.clean_extracted("lr_date").alias("cleaned")), RECEIPT + f"SELECT lr_idx, {D.clean('lr_date')} AS cleaned FROM receipts"),
    "to_float": (lambda s, d: derive.bills(s, d).select("bill_idx", X.to_float("amount").alias("amount"), X.to_float("gross_qty").alias("qty")), BILL + f"SELECT bill_idx, {D.to_float('amount')} AS amount, {D.to_float('gross_qty')} AS qty FROM bills"),
    "simple_validators": (
        lambda s, d: derive.bills(s, d).select("bill_idx", V.date("lr_date").alias("date_ok"), V.gross_qty("gross_qty").alias("qty_ok"), V.amount("amount")["valid"].alias("amount_ok"), V.delivery_timestamp("delivery_date").alias("delivery_ok"), V.vehicle_code("vehicle_no").alias("vehicle_ok")),
        BILL + f"SELECT bill_idx, {D.strip('lr_date')} <> '' AND {D.date_ok('lr_date')} AS date_ok, regexp_full_match({D.strip('gross_qty')}, '[0-9]{{1,3}}\\.[0-9]{{1,2}}') AS qty_ok, {D.amount_ok('amount')} AS amount_ok, "
        f"regexp_full_match({D.strip('delivery_date')}, '(?i)[0-9]{{1,2}} \\w{{3}} [0-9]{{2}} [0-9]{{2}}:[0-9]{{2}} (am|pm)') AS delivery_ok, regexp_full_match({D.strip('vehicle_no')}, '[A-Za-z0-9]+') AS vehicle_ok FROM bills",
    ),
    "sr_no_valid": (lambda s, d: derive.table(s, d, "part").select("p_partkey", V.sr_no(F.col("p_partkey").cast("string")).alias("ok")), "SELECT p_partkey, p_partkey BETWEEN 1 AND 999 AS ok FROM part"),
    "shipment_valid": (lambda s, d: derive.table(s, d, "orders").select("o_orderkey", V.shipment_no((F.col("o_orderkey") * 1009).cast("string")).alias("ok")), "SELECT o_orderkey, len(CAST(o_orderkey * 1009 AS VARCHAR)) BETWEEN 7 AND 9 AS ok FROM orders"),
    "vehicle_valid": (
        lambda s, d: derive.bills(s, d).select("bill_idx", V.vehicle("vehicle_no").alias("v"), V.vehicle(F.concat("vehicle_no", F.lit("/x"))).alias("w")).select("bill_idx", "v.value", "v.valid", F.array_join("w.flags", ",").alias("flags")),
        BILL + "SELECT bill_idx, upper(regexp_replace(vehicle_no, '[\\s-]', '', 'g')) AS value, true AS valid, 'vehicle_no_unvalidated' AS flags FROM bills",
    ),
    "amount_valid": (lambda s, d: derive.bills(s, d).select("bill_idx", V.amount("amount").alias("v")).select("bill_idx", "v.value", "v.valid"), BILL + f"SELECT bill_idx, CASE WHEN {D.amount_ok('amount')} THEN regexp_replace({D.strip('amount')}, '[,\\s]', '', 'g') END AS value, {D.amount_ok('amount')} AS valid FROM bills"),
    "plausible_values": (
        lambda s, d: derive.cells(s, d).select("table_id", "row_idx", "col_idx", V.plausible_value("text").alias("plausible"), V.looks_like_value("text").alias("value_like")),
        f"WITH {D.CELLS} SELECT table_id, row_idx, col_idx, regexp_full_match(text, '[0-9]+') OR (regexp_full_match(text, '[A-Za-z0-9]+') AND regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[0-9]')) OR regexp_full_match(text, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}') OR regexp_full_match(text, '[0-9]+(,[0-9]{{2,3}})*\\.[0-9]{{2,3}}') AS plausible, "
        "regexp_full_match(text, '[0-9,]+(\\.[0-9]+)?[/\\-]*') OR regexp_full_match(text, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}') AS value_like FROM cells",
    ),
    "caption_clean": (
        _customers(RAW, words=lambda: X.caption_words("raw"), key=lambda: X.caption_key("raw")),
        _customers_sql(RAW_SQL, words="lower(array_to_string(list_filter(string_split_regex(trim(raw), '\\s+'), lambda t: len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= len(t) * 0.5), ' '))",
                       key="trim(left(trim(regexp_replace(lower(array_to_string(list_filter(string_split_regex(trim(raw), '\\s+'), lambda t: len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= len(t) * 0.6), ' ')), '[^a-z0-9]+', '_', 'g'), '_'), 30), '_')"),
    ),
    "field_keys": (
        _customers(RAW, key=lambda: X.field_key("raw"), label=lambda: X.row_label("raw")),
        _customers_sql(RAW_SQL, key="array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(raw, '^[\\s*\\-.•]+', ''), '[\\s:*\\-.]+$', ''), '[^0-9A-Za-z_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> ''), lambda t: concat(upper(left(t, 1)), lower(substr(t, 2)))), '_')", label="trim(regexp_replace(lower(raw), '[^a-z ]', ' ', 'g'))"),
    ),
    "report_header": (
        lambda s, d: derive.table(s, d, "customer").select("c_custkey", X.header(F.concat(F.lower("c_mktsegment"), F.lit("_no_3rd_o'neil"))).alias("header")),
        "SELECT c_custkey, concat(upper(left(c_mktsegment, 1)), lower(substr(c_mktsegment, 2)), ' No 3Rd O''Neil') AS header FROM customer",
    ),
    "cover_cleaners": (
        _customers(COVER, **{n: (lambda f=f: f("raw")) for n, f in X.COVER_CLEANERS.items()}),
        _customers_sql(COVER, vendor_name=_EDGE, invoice_number=_EDGE, vendor_code=f"coalesce(nullif(regexp_extract(raw, '[0-9][0-9,]{{3,}}'), ''), {_EDGE})", po_number=f"coalesce(nullif(regexp_extract(raw, '[0-9][0-9,]{{3,}}'), ''), {_EDGE})", grn_srn_number=f"coalesce(nullif(regexp_extract(raw, '[0-9][0-9,]{{3,}}'), ''), {_EDGE})",
                       invoice_date=f"coalesce(nullif(regexp_extract(raw, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}'), ''), {_EDGE})", penalty_amount=f"coalesce(replace(nullif(regexp_extract(raw, '(?i)amount[^0-9]{{0,6}}([0-9,]+\\s*/?-?)', 1), ''), ' ', ''), {_EDGE})", invoice_amount=f"coalesce(replace(nullif(regexp_extract(raw, '[0-9,]{{3,}}\\s*/?-?'), ''), ' ', ''), {_EDGE})"),
    ),
    "barcode_code": (_customers(COVER, code=lambda: X.barcode("raw")), _customers_sql(COVER, code="coalesce(nullif(regexp_extract(upper(raw), '[A-Z0-9]{6,}'), ''), upper(raw))")),
    "inline_pairs": (
        lambda s, d: derive.table(s, d, "customer").selectExpr("c_custkey", f"{RAW} AS raw").select("c_custkey", X.inline_pair("raw").alias("p")).where("p is not null").select("c_custkey", "p.label", "p.value"),
        _customers_sql(RAW_SQL, label="trim(regexp_extract(raw, '^([^:]{2,60}):[\\s\\-]*(\\S.*)$', 1))", value="trim(regexp_extract(raw, '^([^:]{2,60}):[\\s\\-]*(\\S.*)$', 2))") + " WHERE regexp_matches(raw, '^([^:]{2,60}):[\\s\\-]*(\\S.*)$')",
    ),
    "client_detect": (
        lambda s, d: _detected(s, d),
        "SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'auto_mobile' WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' ELSE '' END AS client FROM customer",
    ),
}


def _detected(s, d):
    from recordloom.operators.matching import detect_client

    texts = derive.table(s, d, "customer").selectExpr("c_custkey", "concat('M/s ', c_mktsegment, ' works, ', c_name) AS text")
    return detect_client(texts, ["auto_mobile", "machinery"]).select("c_custkey", "client")
