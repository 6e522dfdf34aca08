"""Record batches as a stream: each micro-batch of new rows is normalised and validated, and reconciled against receipts at hand.

Reconciliation itself needs all rows (a receipt is unbilled only when no bill came), so it runs on each batch's bills and a table of
receipts; what stays unbilled is asked of the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recordloom.operators import records


def normalised_bills(spark: SparkSession, path: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """A stream of bill files as normalised and validated rows; stateless, so every trigger's rows go out."""
    raw = spark.readStream.schema(schema).format(form).load(path)
    return records.validate_bills(records.normalise_bills(raw))


def reconcile_stream(bills: DataFrame, receipts: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that reconciles each batch of normalised bills with the receipts of that moment and hands it to `sink`."""

    def step(batch: DataFrame, number: int) -> None:
        sink(records.reconcile(batch, receipts()).where("section = 0"), number)

    return bills.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
