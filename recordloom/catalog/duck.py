"""Building blocks of the SQL side: scalar expressions and derived tables in DuckDB's dialect."""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '^\s+', ''), '\s+$', '')"


def blank_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def clean(x: str) -> str:
    inner = strip("ltrim(" + strip(x) + ", ':.-_>*''\"` ')")
    return f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN {x} ELSE {inner} END"


def lr_number(x: str) -> str:
    t = f"regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g'), '^[A-Z]+', '')"
    return f"CASE WHEN regexp_full_match({t}, '0+') THEN '0' ELSE regexp_replace({t}, '^0+', '') END"


def lr_digits(x: str) -> str:
    return f"right(regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g'), 7)"


def date(x: str) -> str:
    c = rf"regexp_replace({strip(x)}, '\s+', '', 'g')"
    head = f"regexp_extract({c}, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}')"
    k = f"CASE WHEN {head} = '' THEN {c} ELSE {head} END"
    day = lambda y: f"coalesce(try_strptime({k}, '%d.%m.%{y}'), try_strptime({k}, '%d/%m/%{y}'), try_strptime({k}, '%d-%m-%{y}'))"
    return (
        f"CAST(CASE WHEN regexp_matches({k}, '[./-][0-9]{{4}}$') THEN {day('Y')} WHEN regexp_matches({k}, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2}}$') THEN {day('y')} "
        f"WHEN regexp_matches({k}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN try_strptime({k}, '%Y-%m-%d') END AS DATE)"
    )


def date_norm(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN '' WHEN {date(x)} IS NOT NULL THEN strftime({date(x)}, '%Y-%m-%d') ELSE {strip(x)} END"


def date_ok(x: str) -> str:
    return f"({strip(x)} = '' OR {date(x)} IS NOT NULL)"


def number(x: str) -> str:
    n = rf"regexp_replace(regexp_replace(upper(regexp_replace(coalesce({x}, ''), '[,\s]+', '', 'g')), '^(RS|INR|₹|\$)\.?', ''), '(TONNES|TONNE|TONS|TON|KGS|KG|MTS|MT|RS|INR)\.?$', '')"
    return rf"round(CASE WHEN regexp_full_match({n}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?') THEN try_cast({n} AS DOUBLE) END, 3)"


def number_ok(x: str) -> str:
    return f"({strip(x)} = '' OR {number(x)} IS NOT NULL)"


def vehicle(x: str) -> str:
    return f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', '', 'g'))"


def to_float(x: str) -> str:
    return f"try_cast(nullif(regexp_replace(coalesce({x}, ''), '[^0-9.]', '', 'g'), '') AS DOUBLE)"


def amount_ok(x: str) -> str:
    return rf"regexp_full_match(regexp_replace({strip(x)}, '[,\s]', '', 'g'), '[0-9]+(\.[0-9]+)?')"


def flags(*named: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in named) + "], lambda f: f IS NOT NULL), ',')"


BILLS = """
bills AS (SELECT 2 * k + c AS bill_idx,
  CASE WHEN k % 37 = 0 THEN '' ELSE concat(CASE k % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'LR-' WHEN 2 THEN '' WHEN 3 THEN '99' ELSE ' lr ' END, 8400000 + k) END AS lr_no,
  CASE WHEN k % 43 = 0 THEN 'n.a.' ELSE replace(strftime(d, '%d/%m/%Y'), '/', CASE k % 3 WHEN 0 THEN '.' WHEN 1 THEN '/' ELSE '-' END) END AS lr_date,
  CASE WHEN k % 31 = 0 THEN '' ELSE concat('SHP', k) END AS shipment_no,
  concat('MH 12 AB ', lpad(CAST(cust % 10000 AS VARCHAR), 4, '0')) AS vehicle_no,
  CAST(CAST(30 + cust % 15 + 0.25 + CASE WHEN k % 29 = 0 THEN 0.02 ELSE 0 END AS DECIMAL(10,2)) AS VARCHAR) AS gross_qty,
  CAST(CAST(30 + cust % 15 AS DECIMAL(10,2)) AS VARCHAR) AS charge_qty,
  CAST(CAST(price / (30.25 + cust % 15) AS DECIMAL(18,2)) AS VARCHAR) AS rate,
  concat(CASE WHEN k % 4 = 0 THEN 'RS. ' ELSE '' END, CAST(CAST(price + CASE WHEN k % 7 = 0 THEN 0.5 WHEN k % 13 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,2)) AS VARCHAR)) AS amount,
  CASE WHEN k % 6 = 0 THEN '15 May 26 05:55 am' WHEN k % 6 = 1 THEN NULL ELSE '15 May 2026' END AS delivery_date
  FROM (SELECT o_orderkey k, o_custkey cust, o_totalprice price, o_orderdate d, unnest(CASE WHEN o_orderkey % 17 = 0 THEN [0, 1] ELSE [0] END) c FROM orders WHERE o_orderkey % 11 <> 0))"""

RECEIPTS = """
receipts AS (SELECT 2 * k + c AS lr_idx,
  CASE WHEN k % 41 = 0 THEN '' ELSE concat('0000', 8400000 + k) END AS lr_no,
  concat(': ', strftime(d, '%d/%m/%Y')) AS lr_date, concat('SHP', k) AS shipment_no,
  concat('MH-12-AB-', lpad(CAST(cust % 10000 AS VARCHAR), 4, '0')) AS truck_no,
  concat(CAST(CAST(30 + cust % 15 + 0.25 AS DECIMAL(10,2)) AS VARCHAR), ' MT') AS net_wt,
  CAST(CAST(45 + cust % 15 AS DECIMAL(10,2)) AS VARCHAR) AS gross_wt, '14.75' AS lorry_tare_wt,
  CASE WHEN k % 23 = 0 THEN 'not readable' ELSE CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) END AS amount
  FROM (SELECT o_orderkey k, o_custkey cust, o_totalprice price, o_orderdate d, unnest(CASE WHEN o_orderkey % 19 = 0 THEN [0, 1] ELSE [0] END) c FROM orders WHERE o_orderkey % 10 <> 0))"""


def _numbers(fields: tuple[str, ...]) -> str:
    return ", ".join(f"{number(f)} AS {f}_num" for f in fields)


def _warnings(fields: tuple[str, ...]) -> str:
    return flags(("lr_no", f"{strip('lr_no')} <> '' AND {lr_number('lr_no')} = ''"), ("lr_date", f"NOT {date_ok('lr_date')}"), *((f, f"NOT {number_ok(f)}") for f in fields))


NORM_BILLS = f"""{BILLS},
nb AS (SELECT *, {lr_number('lr_no')} AS lr_no_norm, {lr_digits(lr_number('lr_no'))} AS lr_no_digits, {date_norm('lr_date')} AS lr_date_norm,
  {_numbers(('gross_qty', 'charge_qty', 'rate', 'amount'))}, {vehicle('vehicle_no')} AS vehicle_no_norm, {_warnings(('gross_qty', 'charge_qty', 'rate', 'amount'))} AS warned FROM bills)"""

NORM_RECEIPTS = f"""{RECEIPTS},
cr AS (SELECT lr_idx, {', '.join(f'{clean(c)} AS {c}' for c in ('lr_no', 'lr_date', 'shipment_no', 'truck_no', 'net_wt', 'gross_wt', 'lorry_tare_wt'))}, amount FROM receipts),
nr AS (SELECT *, {lr_number('lr_no')} AS lr_no_norm, {lr_digits(lr_number('lr_no'))} AS lr_no_digits, {date_norm('lr_date')} AS lr_date_norm,
  {_numbers(('net_wt', 'gross_wt', 'lorry_tare_wt', 'amount'))}, {vehicle('truck_no')} AS truck_no_norm, {_warnings(('net_wt', 'gross_wt', 'lorry_tare_wt', 'amount'))} AS warned FROM cr)"""

CANDIDATES = f"""{NORM_BILLS}, {NORM_RECEIPTS},
p AS (SELECT lr_no_norm key, min(lr_idx) k, count(*) c FROM nr WHERE lr_no_norm <> '' GROUP BY 1),
f AS (SELECT lr_no_digits key, min(lr_idx) k, count(*) c FROM nr WHERE lr_no_digits <> '' GROUP BY 1),
m AS (SELECT nb.*, coalesce(p.k, f.k) AS lr_idx, coalesce(p.c, f.c) AS n_candidates, p.k IS NULL AND f.k IS NOT NULL AS by_digits
  FROM nb LEFT JOIN p ON nullif(nb.lr_no_norm, '') = p.key LEFT JOIN f ON nullif(nb.lr_no_digits, '') = f.key),
w AS (SELECT *, lr_idx IS NOT NULL AND row_number() OVER (PARTITION BY lr_idx ORDER BY bill_idx) > 1 AS repeated FROM m)"""

_TEXT = lambda a, b: f"({blank_null(a)} = {blank_null(b)})"

RECONCILED = f"""{CANDIDATES},
x AS (SELECT w.bill_idx, w.lr_idx, coalesce({blank_null('w.lr_no')}, {blank_null('w.lr_no_norm')}, {blank_null('nr.lr_no')}, {blank_null('nr.lr_no_norm')}, '') AS lr_no,
  {_TEXT('w.shipment_no', 'nr.shipment_no')} AS shipment_match, {_TEXT('w.vehicle_no_norm', 'nr.truck_no_norm')} AS vehicle_match, {_TEXT('w.lr_date_norm', 'nr.lr_date_norm')} AS date_match,
  abs(w.gross_qty_num - nr.net_wt_num) <= 0.01 + 1e-9 AS weight_match, round(w.gross_qty_num - nr.net_wt_num, 3) AS net_wt_diff,
  abs(w.amount_num - nr.amount_num) <= 1.0 + 1e-9 AS amount_match, round(w.amount_num - nr.amount_num, 3) AS amount_diff,
  w.lr_idx IS NOT NULL AS found, w.lr_no_norm = '' AS no_number, by_digits, n_candidates > 1 AS many, repeated, w.warned <> '' AS bill_warned, nr.warned <> '' AS lr_warned
  FROM w LEFT JOIN nr ON w.lr_idx = nr.lr_idx),
r AS (SELECT 0 AS section, bill_idx, lr_idx, lr_no, CASE WHEN found THEN 'A' ELSE 'B' END AS category,
  CASE WHEN NOT found THEN 'missing_lr' WHEN NOT (coalesce(shipment_match, true) AND coalesce(vehicle_match, true) AND coalesce(date_match, true) AND coalesce(weight_match, true) AND coalesce(amount_match, true)) THEN 'mismatch' ELSE 'clear' END AS status,
  shipment_match, vehicle_match, date_match, weight_match, amount_match, net_wt_diff, amount_diff,
  {flags(('lr_no_fuzzy_matched', 'by_digits'), ('bill_lr_no_missing', 'no_number'), ('ambiguous_lr_match', 'many'), ('duplicate_bill_for_lr', 'repeated'), ('unverified_fields', 'found AND (shipment_match IS NULL OR vehicle_match IS NULL OR date_match IS NULL OR weight_match IS NULL OR amount_match IS NULL)'), ('bill_parse_warnings', 'bill_warned'), ('lr_parse_warnings', 'lr_warned'))} AS flags FROM x
  UNION ALL SELECT 1, NULL, lr_idx, coalesce({blank_null('lr_no')}, {blank_null('lr_no_norm')}, ''), 'C', 'unbilled', NULL, NULL, NULL, NULL, NULL, NULL, NULL, {flags(('lr_lr_no_missing', "lr_no_norm = ''"), ('lr_parse_warnings', "warned <> ''"))}
  FROM nr WHERE lr_idx NOT IN (SELECT lr_idx FROM w WHERE lr_idx IS NOT NULL))"""

CELLS = """
cells AS (SELECT table_id, row_idx, CAST(i AS INTEGER) AS col_idx, texts[i + 1] AS text FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7]) i FROM (SELECT o_custkey AS table_id, row_idx,
  [CAST(row_idx AS VARCHAR), strftime(o_orderdate, '%d.%m.%Y'), CAST(CAST(30 + k % 15 + 0.25 AS DECIMAL(10,2)) AS VARCHAR), CAST(CAST(700 + k % 101 + 0.5 AS DECIMAL(10,2)) AS VARCHAR),
   CAST(CAST(CAST(30 + k % 15 + 0.25 AS DECIMAL(10,2)) * CAST(700 + k % 101 + 0.5 AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS VARCHAR), concat('AB', 8400000 + k), concat('station ', lower(o_orderstatus)), CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END] AS texts
  FROM (SELECT *, o_orderkey k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) row_idx FROM orders))))"""

WORDS = """
tokens AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS i FROM (SELECT doc_id, string_split(text, ' ') t FROM documents)),
words AS (SELECT doc_id, CAST(i // 48 AS INTEGER) AS page_no, CAST(i % 48 // 8 AS INTEGER) AS line, CAST(i % 8 AS INTEGER) AS word,
  CAST(i % 8 * 70 + length(text) % 7 * 3 AS INTEGER) AS "left", CAST(i % 48 // 8 * 30 + length(text) % 3 AS INTEGER) AS top, CAST(7 * length(text) AS INTEGER) AS width, CAST(10 + length(text) % 4 AS INTEGER) AS height,
  CAST(CASE WHEN text = '' THEN -1 ELSE 95 - length(text) % 5 * 10 END AS DOUBLE) AS conf, text FROM tokens)"""
