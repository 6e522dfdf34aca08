"""The record pipeline end to end, as one plan: normalise, reconcile, validate, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from recordloom.operators import records


@dataclass
class Outcome:
    """Lazy results of a run; nothing is computed until one is used."""

    bills: DataFrame
    receipts: DataFrame
    result: DataFrame
    validated: DataFrame

    def summary(self) -> DataFrame:
        return records.status_counts(self.result)


def run(bills: DataFrame, receipts: DataFrame) -> Outcome:
    """bills with bill_idx, receipts with lr_idx, both raw text."""
    b, r = records.normalise_bills(bills), records.normalise_receipts(receipts)
    return Outcome(b, r, records.reconcile(b, r), records.validate_bills(bills))
