"""Reading spreadsheets: each file is unpacked in the task that holds it.

A workbook is a zip of XML parts. Files spread over the cluster as binary records; one task streams
the first sheet of one file into rows of strings, so many workbooks load in parallel.
"""

from __future__ import annotations

import sys
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
BATCH_ROWS = 10_000


def column_index(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def sheet_rows(content: bytes):
    """Rows of the first sheet as lists of text or None."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag == MAIN + "si":
                        shared.append("".join(t.text or "" for t in node.iter(MAIN + "t")))
                        node.clear()
        sheet = min(n for n in names if n.startswith("xl/worksheets/sheet"))
        with book.open(sheet) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != MAIN + "row":
                    continue
                row = []
                for cell in node.iter(MAIN + "c"):
                    place = column_index(cell.get("r", "")) if cell.get("r") else len(row)
                    row += [None] * (place + 1 - len(row))
                    kind, value = cell.get("t"), cell.find(MAIN + "v")
                    if kind == "inlineStr":
                        row[place] = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                    elif value is not None and value.text is not None:
                        row[place] = shared[int(value.text)] if kind == "s" else value.text
                node.clear()
                yield row


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the first sheet of every workbook under ``path``, all columns as strings.

    Unless columns are named, every header name of every workbook is a column, ordered by the first
    workbook by path that has it and its place there; each workbook is read by header name, and a
    column it doesn't have is null in its rows. Rows carry no id; ``with_row_ids`` numbers them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if columns is None:
        # one row per distinct name reaches the driver, as many as the table has columns
        heads = files.mapInPandas(_headers, "path string, place int, name string")
        first = heads.groupBy("name").agg(F.min(F.struct("path", "place")).alias("first"))
        columns = [r["name"] for r in first.orderBy("first").collect()]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    wanted = list(columns)
    return files.mapInPandas(lambda batches: _rows(batches, wanted), schema)


def column_names(header: list) -> list:
    """Header cells as column names; a name that comes again in the same sheet gets a number."""
    names, taken = [], {h for h in header if h is not None}
    for i, name in enumerate(header):
        if name is not None and name in header[:i]:
            number = 1
            while f"{name}_{number}" in taken:
                number += 1
            name = f"{name}_{number}"
            taken.add(name)
        names.append(name)
    return names


def _headers(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            header = column_names(next(sheet_rows(content), []))
            found = [(path, i, name) for i, name in enumerate(header) if name is not None]
            yield pd.DataFrame(found, columns=["path", "place", "name"])


def _rows(batches, wanted):
    for batch in batches:
        for content in batch["content"]:
            rows = sheet_rows(content)
            header = column_names(next(rows, []))
            at = [header.index(c) if c in header else None for c in wanted]
            held = []
            for row in rows:
                held.append([row[p] if p is not None and p < len(row) else None for p in at])
                if len(held) == BATCH_ROWS:
                    yield pd.DataFrame(held, columns=wanted)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=wanted)
