"""Reports as workbooks, written where their cells are: one file a report, all of a job's files or none.

`save_reports` brings the cells of a report into one partition, and each task writes the reports it has, one at a time, to a staging folder. The files
appear in the target folder when the job commits; if a task fails for good, the staging folder goes and nothing appears.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = "report_id string, sheet_ord long, sheet string, row int, col int, value string, style string"


def _store(path: str):
    """The file system of a path and the path on it: a local folder, or any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4()}"

    def write(self, rows) -> Written:
        """The reports of a partition, whose rows come report by report. A report's cells are held in memory, one report at a time."""
        from recordloom.operators.report import write_workbook

        store, root = _store(self.path)
        attempt, done = uuid.uuid4().hex, Written()
        store.create_dir(f"{root}/{self.job}", recursive=True)
        for report, cells in groupby(rows, key=lambda r: r["report_id"]):
            out = io.BytesIO()
            write_workbook((c.asDict() for c in cells), out)
            name = f"{quote('null' if report is None else f'_{report}' if report in ('null', '.', '..', '') else report, safe=' ')}.xlsx"
            with store.open_output_stream(f"{root}/{self.job}/{attempt}-{name}") as f:
                f.write(out.getvalue())
            done.files.append((f"{attempt}-{name}", name))
        return done

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("a report's cells came in more than one piece: use save_reports")
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.endswith(".xlsx"):
                    store.delete_file(old.path)
        for staged, name in files:
            store.move(f"{root}/{self.job}/{staged}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class Reports(DataSource):
    """K1 as a sink: the format `reports`; its option `path` is the folder."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def save_reports(cells: DataFrame, path: str, overwrite: bool = True) -> None:
    """Cells (report_id and what `workbook.report_cells` has) as one workbook a report in a folder; nothing passes through the driver but file names."""
    cells.sparkSession.dataSource.register(Reports)
    order = ["report_id", "sheet_ord", "sheet", "row", "col"]
    placed = cells.select(*[cells[c].cast(t) for c, t in (p.split() for p in COLUMNS.split(", "))]).repartition("report_id").sortWithinPartitions(*order)
    placed.write.format("reports").mode("overwrite" if overwrite else "append").option("path", path).save()
