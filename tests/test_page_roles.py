"""Page roles from a layout table of any length."""

from recordloom.operators import tables


def test_all_layout_rows_count(spark):
    pages = spark.range(1, 1501).selectExpr("1L AS doc_id", "CAST(id AS INT) AS page_no")
    layout = spark.range(1, 1501).selectExpr("concat('r', id) AS role", "CAST(id AS INT) AS first_page", "CAST(id AS INT) AS last_page")
    got = tables.page_roles(pages, layout).collect()
    assert {(r.page_no, r.role) for r in got} == {(k, f"r{k}") for k in range(1, 1501)} and len(got) == 1500
