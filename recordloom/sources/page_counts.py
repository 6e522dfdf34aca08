"""How many pages files have, by what their page tree says: a few byte ranges a file, whatever its size.

The end of a file says where its table of objects is, and that one, or the one before it that it names, where the catalog and the root of the page tree are,
which has the count. Tables come as text or as a compressed stream, and objects may lie in compressed streams themselves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "path string, length long, n_pages int, error string"
TAIL, HEAD, MOST_TABLES, MOST_STREAM = 2048, 4096, 64, 64 << 20


class Unreadable(ValueError):
    pass


class PageTree:
    """Objects of one file, by byte ranges. `read(at, n)` gives n bytes from `at`, or as many as there are."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.places: dict[int, tuple[int, int, int]] = {}  # number: kind (1 at a byte, 2 in a stream), place, index
        self.root = 0
        found = re.findall(rb"startxref\s+(\d+)", read(max(0, size - TAIL), TAIL))
        if read(0, 5) != b"%PDF-" or not found:
            raise Unreadable("no header or no end of file")
        at, seen = int(found[-1]), set()
        while at is not None and at not in seen and len(seen) < MOST_TABLES:
            seen.add(at)
            at = self._table(at)

    def _until(self, at: int, end: bytes) -> bytes:
        """What stands from `at` up to `end`, read in growing pieces."""
        n = HEAD
        while True:
            piece = self.read(at, n)
            if end in piece:
                return piece[: piece.index(end)]
            if len(piece) < n or n > MOST_STREAM:
                raise Unreadable("an object has no end")
            n *= 4

    @staticmethod
    def _number(text: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)(?!\s+\d+\s+R)", text)
        return int(m[1]) if m else None

    @staticmethod
    def _reference(text: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", text)
        return int(m[1]) if m else None

    def _table(self, at: int) -> int | None:
        if self.read(at, 4) == b"xref":
            text = self._until(at, b"startxref")
            body, _, trailer = text.partition(b"trailer")
            tokens, i = body.split()[1:], 0
            while i + 1 < len(tokens):
                first, n = int(tokens[i]), int(tokens[i + 1])
                for k in range(n):
                    place, _, kind = tokens[i + 2 + 3 * k : i + 5 + 3 * k]
                    if kind == b"n":
                        self.places.setdefault(first + k, (1, int(place), 0))
                i += 2 + 3 * n
            stream = self._number(trailer, b"XRefStm")
            if stream is not None:
                self._table(stream)
        else:
            trailer = self._until(at, b"stream")
            data, widths = self._stream(at, trailer), [int(x) for x in re.search(rb"/W\s*\[([^\]]*)\]", trailer)[1].split()]
            index = re.search(rb"/Index\s*\[([^\]]*)\]", trailer)
            ranges = [int(x) for x in index[1].split()] if index else [0, self._number(trailer, b"Size") or 0]
            row = 0
            for first, n in zip(ranges[::2], ranges[1::2], strict=True):
                for k in range(n):
                    cells, p = [], row * sum(widths)
                    for w in widths:
                        cells.append(int.from_bytes(data[p : p + w], "big"))
                        p += w
                    kind = cells[0] if widths[0] else 1
                    if kind in (1, 2):
                        self.places.setdefault(first + k, (kind, cells[1], cells[2]))
                    row += 1
        self.root = self.root or self._reference(trailer, b"Root") or 0
        return self._number(trailer, b"Prev")

    def _stream(self, at: int, head: bytes) -> bytes:
        """The decoded bytes of the stream whose dictionary is `head`."""
        begin = at + len(head) + len(b"stream")
        begin += 2 if self.read(begin, 2) == b"\r\n" else 1
        length = self._number(head, b"Length")
        if length is None:
            length = int(self.text(self._reference(head, b"Length") or 0).split()[0])
        if length > MOST_STREAM:
            raise Unreadable("a stream is too long")
        data = self.read(begin, length)
        if b"FlateDecode" in head:
            data = zlib.decompress(data)
        if (self._number(head, b"Predictor") or 1) >= 10:  # each row has the difference to the one above, after a byte that says so
            width, rows, above = self._number(head, b"Columns") or 1, [], b""
            above = bytes(width)
            for i in range(0, len(data), width + 1):
                kind, row = data[i], data[i + 1 : i + 1 + width]
                if kind not in (0, 2):
                    raise Unreadable("a table's filter is unknown")
                above = row if kind == 0 else bytes((a + b) & 255 for a, b in zip(row, above, strict=True))
                rows.append(above)
            data = b"".join(rows)
        return data

    def text(self, number: int) -> bytes:
        kind, place, index = self.places.get(number, (0, 0, 0))
        if kind == 1:
            body = self._until(place, b"endobj")
            return body[body.index(b"obj") + 3 :] if b"obj" in body else b""
        if kind == 2:
            at = self.places.get(place, (0, 0, 0))
            head = self._until(at[1], b"stream") if at[0] == 1 else b""
            data, n, first = self._stream(at[1], head), self._number(head, b"N") or 0, self._number(head, b"First") or 0
            numbers = [int(x) for x in data[:first].split()]
            begin = first + numbers[2 * index + 1]
            return data[begin : first + numbers[2 * index + 3] if index + 1 < n else len(data)]
        raise Unreadable(f"object {number} is missing")

    def count(self) -> int:
        pages = self._reference(self.text(self.root), b"Pages")
        found = self._number(self.text(pages or 0), b"Count")
        if found is None:
            raise Unreadable("the page tree has no count")
        return found


@dataclass
class Files(InputPartition):
    paths: list


class PageCountReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[Files]:
        """Names and sizes only; no file is opened here."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        named = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.lower().endswith(".pdf"))
        return [Files(named[k : k + self.per_task]) for k in range(0, len(named), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    yield path, size, PageTree(lambda at, n, f=f, size=size: f.read_at(max(0, min(n, size - at)), at) if at < size else b"", size).count(), None
            except Exception as e:  # whatever is wrong with a file is told in its row
                yield path, size, None, f"unreadable: {str(e) or type(e).__name__}"


class PageCounts(DataSource):
    """S2 as a source: the format `page_counts`; options path (a folder, with those below it) and files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "page_counts"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PageCountReader:
        return PageCountReader(self.options["path"], int(self.options.get("files_per_task", "64")))


def page_counts(spark: SparkSession, path: str, files_per_task: int = 64) -> DataFrame:
    """(path, length, n_pages, error) of the files named .pdf in a folder; one that cannot be read has no count and says why."""
    spark.dataSource.register(PageCounts)
    return spark.read.format("page_counts").option("path", path).option("files_per_task", str(files_per_task)).load()


def gated(spark: SparkSession, path: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a folder's files by their page counts alone: accepted have path, length, n_pages; rejected also a reason."""
    found = page_counts(spark, path).withColumn("reason", F.coalesce("error", F.when(F.col("n_pages") < least, F.lit(f"fewer than {least} pages")))).drop("error")
    return found.where("reason is null").drop("reason"), found.where("reason is not null")
