"""Queries of the library's operators over the driver's tables, and the same in SQL."""

from recordloom.catalog import extract, flows, layout, records, scalars, tables


def library_queries() -> dict:
    return {n: q for m in (scalars, records, tables, layout, extract, flows) for n, (q, _) in m.QUERIES.items()}


def library_sql() -> dict:
    return {n: s for m in (scalars, records, tables, layout, extract, flows) for n, (_, s) in m.QUERIES.items() if s}
