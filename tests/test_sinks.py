"""Workbooks written on executors, and page counts read by byte ranges."""

import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.sources import page_counts, reports


def cells(spark, n):
    one = F.array(*[F.struct(F.lit(o).alias("sheet_ord"), F.lit(s).alias("sheet"), F.lit(r).alias("row"), F.lit(c).alias("col")) for o, s in ((0, "Invoice"), (1, "Bill")) for r in (0, 1) for c in (0, 1)])
    return spark.range(n).select(F.concat(F.lit("report/"), F.col("id")).alias("report_id"), F.explode(one).alias("c")).select("report_id", "c.*", F.concat_ws("-", "report_id", "c.sheet", "c.row", "c.col").alias("value"), F.lit("").alias("style"))


def test_reports_are_written_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    reports.save_reports(cells(spark, 500).repartition(7, "value"), folder)
    names = sorted(os.listdir(folder))
    assert len(names) == 500 and names[0] == "report%2F0.xlsx"
    with zipfile.ZipFile(f"{folder}/report%2F41.xlsx") as z:
        assert "report/41-Bill-1-1" in z.read("xl/worksheets/sheet2.xml").decode() and '"Invoice"' in z.read("xl/workbook.xml").decode()
    reports.save_reports(cells(spark, 3), folder)
    assert len(os.listdir(folder)) == 3
    reports.save_reports(cells(spark, 5).where("report_id = 'report/4'"), folder, overwrite=False)
    assert len(os.listdir(folder)) == 4
    reports.save_reports(cells(spark, 1).where("false"), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = cells(spark, 40).withColumn("value", F.when((F.col("report_id") == "report/17") & (F.col("row") == 1), F.raise_error(F.lit("a cell is broken")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        reports.save_reports(bad, folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []


def classic(n, junk=0, prev=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count %d >>" % (1 if prev else n), b"<< /Length %d >> stream\n%s\nendstream" % (junk, b"x" * junk)]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    at = len(out)
    out += b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer << /Size 4 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % at
    if prev:  # an update at the end has the page tree anew
        new = len(out)
        out += b"2 0 obj\n<< /Type /Pages /Kids [] /Count %d >>\nendobj\n" % n
        end = len(out)
        out += b"xref\n2 1\n%010d 00000 n \ntrailer << /Size 4 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (new, at, end)
    return out


def compressed(n):
    inside = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [] >>" % n]
    head = b"1 0 2 %d " % (len(inside[0]) + 1)
    packed = zlib.compress(head + b" ".join(inside))
    out = b"%PDF-1.5\n"
    at3 = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    at4 = len(out)
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at3, 0), (1, at4, 0)]
    plain = [bytes([k]) + p.to_bytes(3, "big") + bytes([i]) for k, p, i in rows]
    coded, above = b"", bytes(5)
    for r in plain:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
        above = r
    table = zlib.compress(coded)
    out += b"4 0 obj\n<< /Type /XRef /W [1 3 1] /Size 5 /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (len(table), table, at4)
    return out


def test_page_counts(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    files = {"a.pdf": classic(7), "deep/b.PDF": classic(2, junk=300_000), "c.pdf": compressed(31), "d.pdf": classic(12, prev=True), "e.pdf": b"no such file", "f.pdf": b"", "g.pdf": classic(9)[:-60], "h.txt": classic(4)}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = {os.path.relpath(r.path, tmp_path / "in"): r for r in page_counts.page_counts(spark, str(tmp_path / "in"), 2).collect()}
    assert {n: r.n_pages for n, r in found.items()} == {"a.pdf": 7, "deep/b.PDF": 2, "c.pdf": 31, "d.pdf": 12, "e.pdf": None, "f.pdf": None, "g.pdf": None}
    assert all((r.error is None) == (r.n_pages is not None) for r in found.values()) and found["a.pdf"].length == len(files["a.pdf"])
    good, bad = page_counts.gated(spark, str(tmp_path / "in"))
    assert sorted(r.n_pages for r in good.collect()) == [7, 12, 31] and {r.reason[:5] for r in bad.collect()} == {"fewer", "unrea"}
    os.makedirs(tmp_path / "empty")
    assert page_counts.page_counts(spark, str(tmp_path / "empty")).count() == 0


def test_counting_reads_little_of_a_large_file():
    data, read = classic(5, junk=5_000_000), []

    def part(at, n):
        read.append(len(data[at : at + n]))
        return data[at : at + n]

    assert page_counts.PageTree(part, len(data)).count() == 5 and sum(read) < 60_000
