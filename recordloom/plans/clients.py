"""Column lists of clients whose bills always print the same columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A client's bill columns from left to right. Others are added by passing a mapping of one's own.
CLIENT_COLUMNS = {
    "inland_world_logistics": (
        "sr_no", "bill_no", "invoice_no", "lr_date", "lr_no", "vehicle_no", "delivery_station", "gross_qty", "rate", "amount", "short_qty_charges", "ld_charges", "balance_pay", "delivery_date",
        "party_name",
    ),
}


def configured_columns(clients: DataFrame, lists: Mapping[str, Sequence[str]] = CLIENT_COLUMNS) -> DataFrame:
    """(table_id, col_idx, name) of the tables of `clients` (table_id, client_id) whose client has a list, as `infer.column_names` takes them.

    Tables of other clients, or of none, have no rows. Columns beyond a list are named by their place there.
    """
    if not lists:
        return clients.where(F.lit(False)).select("table_id", F.lit(0).alias("col_idx"), F.lit("").alias("name"))
    named = F.create_map(*[x for c, names in lists.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])
    return clients.where(F.col("client_id").isNotNull()).select("table_id", F.posexplode(F.element_at(named, F.col("client_id"))).alias("col_idx", "name"))
