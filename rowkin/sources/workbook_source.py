"""Workbooks as a Spark data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

A file is a partition, read as a stream with a cap on rows that is checked while reading. A writing task makes its own
files in a folder of its attempt; the driver moves them when all tasks are done, or deletes them.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from xml.sax.saxutils import escape

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rowkin.sources.workbook import CELLS, _date_styles, _headed, _sheet_rows, _shared_strings, _sheets

#: Rows of a sheet, the header included; a task begins another file beyond it.
SHEET_ROWS = 1_048_576


class TooManyRows(ValueError):
    """A workbook holds more data rows than the reader may take."""


@dataclass
class BookPartition(InputPartition):
    path: str


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+://|file:", path) else f"file://{path}")


class BookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxrows", SHEET_ROWS))

    def partitions(self) -> list[BookPartition]:
        """A partition a file: the path itself, or the workbooks in the folder."""
        files, at = _filesystem(self.path)
        info = files.get_file_info(at)
        if info.type == arrow_fs.FileType.File:
            return [BookPartition(at)]
        found = files.get_file_info(arrow_fs.FileSelector(at, recursive=True))
        return [BookPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == arrow_fs.FileType.File and f.path.endswith(".xlsx") and "/_" not in f.path[len(at) :]]

    def read(self, partition: BookPartition | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        files, _ = _filesystem(self.path)
        with files.open_input_file(partition.path) as stream, zipfile.ZipFile(stream) as book:
            shared, dated = _shared_strings(book), _date_styles(book)
            for sheet in _sheets(book):
                seen = -1
                for number, cells in _headed(_sheet_rows(book, sheet, shared, dated)):
                    seen += 1
                    if seen > self.most:
                        raise TooManyRows(f"{partition.path} has more than {self.most} rows")
                    yield partition.path, number, [c and {"text": c[0], "kind": c[1]} for c in cells]
                if seen >= 0:
                    return


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, and its name


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(place: str, value) -> str:
    """A cell as XML: texts and dates inline, numbers as such, truth as Y or N; nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        value = "Y" if value else "N"
    elif isinstance(value, (int, float)):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    elif isinstance(value, (date, datetime)):
        value = value.isoformat()
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{0}" Target="{1}"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{0}" sheetId="1" r:id="rId1"/></sheets></workbook>'


class _Book:
    """One workbook being written, row by row; entries carry a fixed time, so equal rows give equal bytes."""

    def __init__(self, stream, title: str, headers: list[str]):
        self.stream, self.zip, self.rows = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), 0
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format("officeDocument", "xl/workbook.xml")), ("xl/_rels/workbook.xml.rels", _RELS.format("worksheet", "worksheets/sheet1.xml")), ("xl/workbook.xml", _BOOK.format(escape(title[:31])))):
            self.zip.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        entry = zipfile.ZipInfo("xl/worksheets/sheet1.xml")
        entry.compress_type = zipfile.ZIP_DEFLATED
        self.sheet = self.zip.open(entry, "w", force_zip64=True)
        self.sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.row(headers)

    def row(self, values: list) -> None:
        self.rows += 1
        self.sheet.write(f'<row r="{self.rows}">{"".join(_cell(f"{_letters(i)}{self.rows}", v) for i, v in enumerate(values))}</row>'.encode())

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        self.stream.close()


def slug(value) -> str:
    """A value as part of a file name."""
    return re.sub(r"[^a-z0-9]+", "_", str(value if value is not None else "none").lower()).strip("_") or "none"


class BookWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names = [f.name for f in schema]
        self.path, self.by, self.title, self.overwrite = options["path"], options.get("filecolumn"), options.get("title", "Rows"), overwrite
        self.headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}
        self.most = min(SHEET_ROWS, int(options.get("maxrows", SHEET_ROWS - 1)) + 1)
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """A file a value of ``fileColumn`` (one without), and another where a sheet is full. Values should come together: each open file holds a buffer."""
        from pyspark import TaskContext

        files, at = _filesystem(self.path)
        task = TaskContext.get()
        folder = f"{at}/_{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        files.create_dir(folder)
        kept = [n for n in self.names if n != self.by]
        headers = [self.headers.get(n.lower(), n) for n in kept]
        books: dict[str, _Book] = {}
        parts: dict[str, int] = {}
        done: list[tuple[str, str]] = []
        for row in rows:
            name = slug(row[self.by]) if self.by else "part"
            book = books.get(name)
            if book is None or book.rows >= self.most:
                if book:
                    book.close()
                parts[name] = parts.get(name, -1) + 1
                file = f"{name}-{task.partitionId():05d}-{parts[name]}.xlsx"
                book = books[name] = _Book(files.open_output_stream(f"{folder}/{file}"), self.title, headers)
                done.append((f"{folder}/{file}", file))
            book.row([row[n] for n in kept])
        for book in books.values():
            book.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _filesystem(self.path)
        if self.overwrite:
            for old in files.get_file_info(arrow_fs.FileSelector(at)):
                if old.type == arrow_fs.FileType.File and old.path.endswith(".xlsx"):
                    files.delete_file(old.path)
        for message in messages:
            for where, name in message.files if message else ():
                files.move(where, f"{at}/{name if self.overwrite else f'{self.job[:8]}-{name}'}")
        self._clear(files, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_filesystem(self.path))

    def _clear(self, files: arrow_fs.FileSystem, at: str) -> None:
        if files.get_file_info(f"{at}/_{self.job}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{at}/_{self.job}")


class WorkbookSource(DataSource):
    """Reading: path (a file or folder), maxRows a file; rows are (path, row, cells), the first of a path is its header.

    Writing: path, fileColumn (a file a value; the column itself is left out), header.<column> (what the header row
    calls it), title (of the sheet), maxRows (data rows a file).
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return f"path string, row int, cells {CELLS}"

    def reader(self, schema: StructType) -> BookReader:
        return BookReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
