from pyspark.sql import functions as F

from recordloom.operators import infer
from recordloom.plans import clients
from recordloom.sources import tables


def pages(content):
    if b"broken" in content:
        raise ValueError("no trailer")
    return [b"p"] * content.count(b"page")


def test_gates_and_pages(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-page page page", "b.PDF": b"%PDF-page", "c.pdf": b"%PDF-broken", "d.pdf": b"text", "e.txt": b"%PDF-page page page", "f.pdf": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(content)
    good, bad = tables.documents(spark, str(tmp_path))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    assert {(r.name, r.reason) for r in bad.select(name, "reason").collect()} == {("d.pdf", "content"), ("e.txt", "extension")}
    taken, left = tables.counted(good, lambda c: len(pages(c)))
    assert [(r.name, r.n_pages) for r in taken.select(name, "n_pages").collect()] == [("a.pdf", 3)]
    assert {(r.name, r.n_pages, r.reason) for r in left.select(name, "n_pages", "reason").collect()} == {("b.PDF", 1, "fewer than 3 pages"), ("c.pdf", None, "unreadable: no trailer"), ("f.pdf", 0, "fewer than 3 pages")}
    shown = sorted((r.name, -1 if r.page_no is None else r.page_no, r.error or "") for r in tables.rendered_pages(good, pages).select(name, "page_no", "error").collect())
    assert shown == [("a.pdf", 0, ""), ("a.pdf", 1, ""), ("a.pdf", 2, ""), ("b.PDF", 0, ""), ("c.pdf", -1, "no trailer"), ("f.pdf", -1, "no pages")]


def test_client_lists(spark):
    owners = spark.createDataFrame([(1, "inland_world_logistics"), (2, "other"), (3, None)], "table_id int, client_id string")
    own = clients.configured_columns(owners)
    assert [r.name for r in own.where("table_id = 1").orderBy("col_idx").collect()] == list(clients.CLIENT_COLUMNS["inland_world_logistics"]) and own.where("table_id > 1").count() == 0
    cells = spark.createDataFrame([(t, c, f"n{c}", "Some Title") for t in (1, 2) for c in range(17)], "table_id int, col_idx int, name string, caption string")
    names = infer.column_names(cells.select("table_id", "col_idx", "name"), cells.select("table_id", "col_idx", "caption"), own)
    got = {(r.table_id, r.col_idx): r.name for r in names.collect()}
    assert got[1, 0] == "sr_no" and got[1, 14] == "party_name" and got[1, 15] == "col_16" and got[1, 16] == "col_17" and got[2, 3] == "n3"
    assert clients.configured_columns(owners, {}).count() == 0
