"""Sources of uploaded rows: workbooks (a task a file) and CSV, both as (path, row, cells of (text, kind)).

A workbook is a zip of XML and can't be split; many workbooks are read side by side, and each is streamed row by row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "array<struct<text: string, kind: string>>"
HEADER_WITHIN = 10
_DATE_IDS = {*range(14, 23), *range(45, 48)}


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _place(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _tag(e) == "numFmt"}
    dated = _DATE_IDS | {k for k, code in own.items() if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower()))}
    formats = next((e for e in root if _tag(e) == "cellXfs"), [])
    return {i for i, e in enumerate(formats) if int(e.get("numFmtId", 0)) in dated}


def _text(kind: str, raw: str | None, shared: list[str], dated: bool) -> tuple[str, str] | None:
    """Canonical text and kind of a cell: midnight is a date, whole numbers have no point."""
    if raw is None or not raw.strip():
        return None
    if kind == "s":
        raw, kind = shared[int(raw)], "str"
    if kind in ("str", "inlineStr", "e", "d"):
        return (raw.strip(), "d" if kind == "d" else "s") if raw.strip() else None
    if kind == "b":
        return ("true" if raw == "1" else "false"), "s"
    number = float(raw)
    if dated:
        at = datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))
        return (at.date().isoformat() if at == datetime(at.year, at.month, at.day) else at.isoformat()), "d"
    return (str(int(number)) if number.is_integer() else repr(number)), "n"


def _sheet_rows(book: zipfile.ZipFile, name: str, shared: list[str], dated: set[int]) -> Iterator[tuple[int, list]]:
    with book.open(name) as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) != "row":
                continue
            cells: list = []
            for c in e:
                at = _place(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                inline = "".join(t.text or "" for t in c.iter() if _tag(t) == "t") if c.get("t") == "inlineStr" else None
                raw = inline if inline is not None else next((v.text for v in c if _tag(v) == "v"), None)
                cells[at] = _text(c.get("t", "n"), raw, shared, int(c.get("s", 0)) in dated)
            yield int(e.get("r", 0)), cells
            e.clear()


def _headed(rows: Iterator[tuple[int, list]]) -> Iterator[tuple[int, list]]:
    """The rows from the header on: within the first ten, only texts, two at least. Nothing if there is none."""
    found = False
    for seen, (number, cells) in enumerate(rows):
        filled = [c for c in cells if c]
        if not found and seen >= HEADER_WITHIN:
            return
        found = found or (len(filled) >= 2 and all(c[1] == "s" for c in filled))
        if found and filled:
            yield number, cells


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in e.iter() if _tag(t) == "t") for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _tag(e) == "si"]


def _sheets(book: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))


def read_workbook(content: bytes) -> Iterator[tuple[int, list]]:
    """Header and rows of the first sheet that has a header row."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared, dated = _shared_strings(book), _date_styles(book)
    for sheet in _sheets(book):
        rows = _headed(_sheet_rows(book, sheet, shared, dated))
        if first := next(rows, None):
            yield first
            yield from rows
            return


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of every workbook under a path; the first row of a path is its header."""

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                block = []
                for number, cells in read_workbook(content):
                    block.append((file, number, [c and {"text": c[0], "kind": c[1]} for c in cells]))
                    if len(block) == 2000:
                        yield pd.DataFrame(block, columns=["path", "row", "cells"])
                        block = []
                yield pd.DataFrame(block, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"path string, row int, cells {CELLS}")


def clean_headers(cells: list) -> list[str]:
    """Names of columns: blanks at the end trimmed, blanks numbered, repeats told apart by their place."""
    texts = [(c["text"] if c else "") or "" for c in cells]
    while texts and not texts[-1].strip():
        texts.pop()
    out: list[str] = []
    for i, t in enumerate(" ".join(t.split()) for t in texts):
        name = t or f"Column {i + 1}"
        out.append(f"{name} (col {i + 1})" if name in out else name)
    return out


def sheet(rows: DataFrame, path: str) -> tuple[list[str], DataFrame]:
    """Headers and data rows of one file; only its header row comes to the driver."""
    own = rows.filter(F.col("path") == path)
    first = own.orderBy("row").limit(1).collect()
    if not first:
        raise ValueError("no header row within the first ten rows")
    return clean_headers(first[0]["cells"]), own.filter(F.col("row") > first[0]["row"]).drop("path")


def csv_rows(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """(row, cells) of CSV files, numbered by a column of the file, so that the numbers are the same on every run."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(key).cast("int").alias("row"), F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), F.lit("s").alias("kind"))) for c in columns)).alias("cells"))
