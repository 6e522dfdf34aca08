"""Types, numbers and sequences of columns in one pass are those of the single steps."""

from recordloom.operators import infer


def test_facts_are_those_of_the_single_steps(spark, monkeypatch):
    rows = [(t, r, 0, str(r + t)) for t in (1, 2) for r in range(20)] + [(1, r, 1, f"{r}.50" if r % 3 else "x") for r in range(20)] + [(1, r, 2, "" if r % 2 else None) for r in range(6)]
    rows += [(2, r, 1, str(r * 9) if r % 2 else " ") for r in range(20)] + [(2, r, 2, "01.02.2026") for r in range(4)] + [(2, 0, 3, "7"), (2, 1, 3, "8")]
    cells = spark.createDataFrame(rows, "table_id int, row_idx int, col_idx int, text string")
    facts = {(r.table_id, r.col_idx): (r.column_type, r.numeric) for r in infer.column_facts(cells, 4).collect()}
    kinds = {(r.table_id, r.col_idx): r.column_type for r in infer.column_types(cells).collect()}
    numbers = {(r.table_id, r.col_idx) for r in infer.numeric_columns(cells).collect()}
    assert {k: v[0] for k, v in facts.items() if v[0]} == kinds and {k for k, v in facts.items() if v[1]} == numbers
    assert set(facts) == {r[::2][:1] + (r[2],) for r in rows} and facts[1, 2] == (None, False)
    assert facts[1, 0][0] == "small_sequential_int" and facts[2, 1][0] == "large_numeric_code"
