"""Normalisation, reconciliation and validation of billing rows and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as X
from recordloom.functions import validators as V

BILL_NUMBERS = ("gross_qty", "charge_qty", "rate", "amount")
RECEIPT_NUMBERS = ("net_wt", "gross_wt", "lorry_tare_wt", "amount")
RECEIPT_TEXTS = ("lr_no", "shipment_no", "lr_date", "truck_no", "from_origin", "to_destination", "net_wt", "gross_wt", "lorry_tare_wt", "incoterm", "truck_type")
#: Tolerances of the comparisons of weight and amount.
WEIGHT_TOLERANCE, AMOUNT_TOLERANCE, PRODUCT_TOLERANCE, UNIT = 0.01, 1.0, 0.02, 0.01


def listed(*flags: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda f: f.isNotNull())


def _normalised(rows: DataFrame, numbers: tuple[str, ...], vehicle: str) -> DataFrame:
    for name in ("lr_no", "lr_date", vehicle, *numbers):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    # in two steps, so that the parsed values are computed once
    parsed = {"lr_no_norm": X.lr_number("lr_no"), "lr_date_value": X.date_value("lr_date"), f"{vehicle}_norm": X.vehicle_no(vehicle)}
    rows = rows.withColumns(parsed | {f"{n}_num": X.number_value(n) for n in numbers})
    blank = {n: X.strip(n) == "" for n in ("lr_no", "lr_date", *numbers)}
    warnings = listed(
        ("lr_no", ~blank["lr_no"] & (F.col("lr_no_norm") == "")),
        ("lr_date", ~blank["lr_date"] & F.col("lr_date_value").isNull()),
        *((n, ~blank[n] & F.col(f"{n}_num").isNull()) for n in numbers),
    )
    day = F.when(blank["lr_date"], "").otherwise(F.coalesce(F.date_format("lr_date_value", "yyyy-MM-dd"), X.strip("lr_date")))
    return rows.withColumns({"lr_no_digits": X.lr_digits("lr_no_norm"), "lr_date_norm": day, "parse_warnings": warnings})


def normalise_bills(bills: DataFrame) -> DataFrame:
    """The rows with keys, date, numbers, vehicle and parse_warnings beside the raw values; missing columns count as null."""
    return _normalised(bills, BILL_NUMBERS, "vehicle_no")


def normalise_receipts(receipts: DataFrame) -> DataFrame:
    """As for bills, after leading junk is taken off the text fields."""
    cleaned = receipts.withColumns({n: X.clean_extracted(n) for n in RECEIPT_TEXTS if n in receipts.columns})
    return _normalised(cleaned, RECEIPT_NUMBERS, "truck_no")


def compare_text(a: Column | str, b: Column | str) -> Column:
    """Null if either is blank."""
    return X.blank_to_null(a) == X.blank_to_null(b)


def compare_number(a: Column, b: Column, tolerance: float) -> tuple[Column, Column]:
    """C11: match and signed difference; null if either is."""
    return F.abs(a - b) <= tolerance + 1e-9, F.round(a - b, 3)


def lookup(receipts: DataFrame, key: str) -> DataFrame:
    """For each key that is not blank the first receipt by position and how many share it."""
    return receipts.where(F.col(key) != "").groupBy(F.col(key).alias("_key")).agg(F.min("lr_idx").alias("_first"), F.count("*").alias("_same"))


def candidates(bills: DataFrame, receipts: DataFrame) -> DataFrame:
    """Bills with lr_idx (the receipt chosen by number, else by last digits), n_candidates, by_digits, repeat.

    Blank keys never join. A receipt serves any number of bills; `repeat` marks all but the first in bill order. The
    join keys are unique on the receipts' side, so no join multiplies rows, and a hot key splits under AQE.
    """
    exact, digits = lookup(receipts, "lr_no_norm").alias("p"), lookup(receipts, "lr_no_digits").alias("f")
    joined = bills.alias("b").join(exact, F.expr("nullif(b.lr_no_norm, '') = p._key"), "left").join(digits, F.expr("p._key is null and nullif(b.lr_no_digits, '') = f._key"), "left")
    chosen = joined.select("b.*", F.coalesce("p._first", "f._first").alias("lr_idx"), F.coalesce("p._same", "f._same").alias("n_candidates"), F.expr("p._first is null and f._first is not null").alias("by_digits"))
    # bills without a receipt are spread by their own number: they form no group, neither here nor in the join that follows
    chosen = chosen.withColumn("_apart", F.when(F.col("lr_idx").isNull(), F.col("bill_idx")).otherwise(F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("lr_idx", "_apart").orderBy("bill_idx"))
    return chosen.withColumn("repeat", F.col("lr_idx").isNotNull() & (nth > 1))


def reconcile(bills: DataFrame, receipts: DataFrame) -> DataFrame:
    """Normalised bills against normalised receipts, a row for each bill and each receipt no bill chose.

    Returns section (0 bills, 1 unbilled), bill_idx, lr_idx, lr_no, category (A, B, C), status (clear, mismatch, missing_lr,
    unbilled), the five matches and two differences (null where not comparable), and flags in their fixed order.
    """
    b = candidates(bills, receipts).alias("b")
    r = receipts.withColumns({"_apart": F.lit(0).cast(bills.schema["bill_idx"].dataType), "_there": F.lit(True)}).alias("r")
    both = b.join(r, (F.col("b.lr_idx") == F.col("r.lr_idx")) & (F.col("b._apart") == F.col("r._apart")), "full")
    weight, weight_diff = compare_number(F.col("b.gross_qty_num"), F.col("r.net_wt_num"), WEIGHT_TOLERANCE)
    amount, amount_diff = compare_number(F.col("b.amount_num"), F.col("r.amount_num"), AMOUNT_TOLERANCE)
    found = F.col("b.lr_idx").isNotNull()
    match = {
        "shipment_match": compare_text("b.shipment_no", "r.shipment_no"),
        "vehicle_match": compare_text("b.vehicle_no_norm", "r.truck_no_norm"),
        "date_match": compare_text("b.lr_date_norm", "r.lr_date_norm"),
        "weight_match": weight,
        "amount_match": amount,
    }
    names = list(match)
    billed = F.col("b.bill_idx").isNotNull()
    shown = both.select(
        F.when(billed, 0).otherwise(1).alias("section"), "b.bill_idx", F.coalesce("b.lr_idx", "r.lr_idx").alias("lr_idx"),
        F.coalesce(X.blank_to_null("b.lr_no"), X.blank_to_null("b.lr_no_norm"), X.blank_to_null("r.lr_no"), X.blank_to_null("r.lr_no_norm"), F.lit("")).alias("lr_no"),
        *[m.alias(n) for n, m in match.items()], weight_diff.alias("net_wt_diff"), amount_diff.alias("amount_diff"),
        found.alias("_found"), billed.alias("_billed"), (F.col("b.lr_no_norm") == "").alias("_no_number"), (F.col("r.lr_no_norm") == "").alias("_lr_no_number"), "b.by_digits", (F.col("b.n_candidates") > 1).alias("_many"), "b.repeat",
        (F.size("b.parse_warnings") > 0).alias("_bill_warned"), (F.size("r.parse_warnings") > 0).alias("_lr_warned"),
    )
    any_null = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    any_false = F.greatest(*[F.coalesce(~F.col(n), F.lit(False)).cast("int") for n in names]) == 1
    flags = listed(
        ("lr_lr_no_missing", ~F.col("_billed") & F.col("_lr_no_number")),
        ("lr_no_fuzzy_matched", F.col("by_digits")),
        ("bill_lr_no_missing", F.col("_no_number")),
        ("ambiguous_lr_match", F.col("_many")),
        ("duplicate_bill_for_lr", F.col("repeat")),
        ("unverified_fields", F.col("_found") & any_null),
        ("bill_parse_warnings", F.col("_bill_warned")),
        ("lr_parse_warnings", F.col("_lr_warned")),
    )
    status = F.when(~F.col("_billed"), "unbilled").when(~F.col("_found"), "missing_lr").when(any_false, "mismatch").otherwise("clear")
    category = F.when(~F.col("_billed"), "C").when(F.col("_found"), "A").otherwise("B")
    return shown.select("section", "bill_idx", "lr_idx", "lr_no", category.alias("category"), status.alias("status"), *names, "net_wt_diff", "amount_diff", flags.alias("flags"))


def ordered(result: DataFrame) -> DataFrame:
    """Bill order, then receipts without a bill in theirs."""
    return result.orderBy("section", F.when(F.col("section") == 0, F.col("bill_idx")).otherwise(F.col("lr_idx")))


def status_counts(result: DataFrame) -> DataFrame:
    """The number of rows of each status."""
    return result.groupBy("status").agg(F.count("*").alias("n"))


def validate_bills(rows: DataFrame, client_format: Column | None = None) -> DataFrame:
    """validation_flags after the row's own flags: amount_mismatch, then a flag for each field that is there but not valid."""
    expected, amount = X.to_float("gross_qty") * X.to_float("rate"), X.to_float("amount")
    wrong = F.abs(expected - amount) > PRODUCT_TOLERANCE * F.abs(amount)
    checks = [("amount_mismatch", F.coalesce(wrong, F.lit(False)))]
    for name, ok in (("lr_date", V.date), ("delivery_date", V.delivery_timestamp), ("rate", lambda x: V.amount(x)["valid"]), ("amount", lambda x: V.amount(x)["valid"])):
        if name in rows.columns:
            checks.append((f"{name}_invalid", F.col(name).isNotNull() & ~ok(name)))
    if "vehicle_no" in rows.columns:
        checks.append(("vehicle_no_invalid", F.col("vehicle_no").isNotNull() & ~V.vehicle_code("vehicle_no", client_format)))
    own = F.coalesce("flags", F.array().cast("array<string>")) if "flags" in rows.columns else F.array().cast("array<string>")
    return rows.withColumn("validation_flags", F.concat(own, listed(*checks)))


def strict_bills(rows: DataFrame) -> DataFrame:
    """Fields that fail their check become null and are flagged; a bad vehicle number stays, flagged."""
    checks = {"sr_no": V.sr_no, "shipment_no": V.shipment_no, "gross_qty": V.gross_qty, "lr_date": V.date, "rate": lambda x: V.amount(x)["valid"], "amount": lambda x: V.amount(x)["valid"]}
    used = {n: f for n, f in checks.items() if n in rows.columns}
    flags = [(f"{n}_invalid", F.col(n).isNotNull() & ~f(n)) for n, f in used.items()]
    extra = V.vehicle("vehicle_no")["flags"] if "vehicle_no" in rows.columns else F.array().cast("array<string>")
    return rows.withColumns({n: F.when(f(n), F.col(n)) for n, f in used.items()} | {"field_flags": F.concat(listed(*flags), extra)})


def batch_total(rows: DataFrame, stated: Column | str) -> DataFrame:
    """A3: one row: n_rows, computed_total, stated_total, difference, flagged. Uncheckable totals are flagged."""
    t = rows.agg(F.count("*").alias("n_rows"), F.round(F.sum(X.to_float("amount")), 2).alias("computed_total"), F.max(F.lit(stated) if not isinstance(stated, Column) else stated).alias("_stated"))
    t = t.withColumn("stated_total", X.to_float(F.col("_stated").cast("string")))
    diff = F.round(F.col("computed_total") - F.col("stated_total"), 2)
    return t.select("n_rows", "computed_total", "stated_total", diff.alias("difference"), F.coalesce(F.abs(diff) > UNIT * F.col("n_rows"), F.lit(True)).alias("flagged"))
