"""Inputs: table files of word boxes, cells and records, and the boundary to whatever reads pixels."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BOXES = "doc_id long, page_no int, pass int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"
CELLS = "table_id long, row_idx long, col_idx int, text string"
CAPTIONS = "table_id long, col_idx int, caption string"
FORMATS = ("parquet", "orc", "json", "csv")


class OcrProvider(Protocol):
    """What yields word boxes, table cells and records for documents; pixels stay behind it."""

    def words(self) -> DataFrame: ...

    def cells(self) -> DataFrame: ...

    def captions(self) -> DataFrame:
        """Captions that were read again, magnified; tables without any have no rows."""
        ...

    def records(self, kind: str) -> DataFrame: ...


class TableProvider:
    """A provider whose relations were written before: <root>/words, <root>/cells, <root>/<kind>."""

    def __init__(self, spark: SparkSession, root: str, form: str = "parquet"):
        if form not in FORMATS:
            raise ValueError(f"one of {FORMATS}")
        self.spark, self.root, self.form = spark, root, form

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.form)
        if self.form == "csv":
            reader = reader.option("header", True)
        if schema is not None and self.form in ("csv", "json"):
            reader = reader.schema(schema)
        return reader.load(f"{self.root}/{name}")

    def words(self) -> DataFrame:
        return self._read("words", WORD_BOXES)

    def cells(self) -> DataFrame:
        return self._read("cells", CELLS)

    def captions(self) -> DataFrame:
        return self._read("captions", CAPTIONS)

    def records(self, kind: str) -> DataFrame:
        return self._read(kind)


def is_pdf(content: Column) -> Column:
    """S3: the content begins as such a file does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder: accepted have the extension and the first bytes of PDF; rejected say why.

    The name is tested before any byte is read.
    """
    files = spark.read.format("binaryFile").load(path)
    named = F.lower(F.col("path")).endswith(".pdf")
    reason = F.when(~named, "extension").when(~is_pdf(F.col("content")), "content")
    tagged = files.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null").select("path", "length", "reason")


def counted(files: DataFrame, count: Callable[[bytes], int], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files that `documents` accepted, by a page counter from outside: a file must be readable and have `least` pages.

    Accepted have path, n_pages and content, rejected path, n_pages (null if unreadable) and reason. No file fails the job.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    n, why = int(count(content.as_py())), None
                except Exception as e:  # whatever the reader raises is the file's, and is told in its row
                    n, why = None, f"unreadable: {str(e) or type(e).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([n], pa.int32()), pa.array([why], pa.string())], ["path", "n_pages", "reason"])

    found = files.select("path", "content").mapInArrow(run, "path string, n_pages int, reason string")
    found = found.withColumn("reason", F.coalesce("reason", F.when(F.col("n_pages") < least, F.lit(f"fewer than {least} pages"))))
    return files.join(found.where("reason is null").select("path", "n_pages"), "path").select("path", "n_pages", "content"), found.where("reason is not null")


def rendered_pages(files: DataFrame, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, page_no, image, error) by a renderer from outside, a file at a time; a file that it cannot read, or without pages, is one row with its error."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    pages, why = list(render(content.as_py())), None
                except Exception as e:  # as above
                    pages, why = [], str(e) or type(e).__name__
                rows = [(i, p, None) for i, p in enumerate(pages)] or [(None, None, why or "no pages")]
                for i, p, e in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([i], pa.int32()), pa.array([p], pa.binary()), pa.array([e], pa.string())], ["path", "page_no", "image", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, image binary, error string")
