"""First sheets of many Excel workbooks as one table; the workbooks are decoded in the tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - ord("A") + 1
    return n - 1


def _first_sheet_path(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{NS}sheets/{NS}sheet")
    wanted = sheet.get(f"{REL}id")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("workbook without sheets")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in root.iter(f"{NS}si")]
        with book.open(_first_sheet_path(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{NS}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{NS}c"):
                    place = _column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value, kind = c.find(f"{NS}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    else:
                        text = value.text
                    cells[place] = text or None
                yield cells
                row.clear()


def _header(first: list[str | None], width: int) -> list[str]:
    """Names for the widest row of the sheet; repeated ones get ``_2``, ``_3``, ... so that no cell is lost."""
    names: dict[str, None] = {}
    taken = set(first)
    for i in range(width):
        name = base = (first[i] if i < len(first) else None) or f"Unnamed: {i}"
        k = 2
        while name in names or (name != base and name in taken):
            name, k = f"{base}_{k}", k + 1
        names[name] = None
    return list(names)


def _decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            rows = list(sheet_rows(content))
            if rows:
                header = _header(rows[0], max(map(len, rows)))
                cells = [dict(zip(header, r + [None] * (len(header) - len(r)))) for r in rows[1:]]
                yield pd.DataFrame({"path": path, "row": range(len(cells)), "cells": cells})


def read_excel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, rows in file order of each workbook.

    Without ``columns`` the header names of all workbooks are collected first.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(_decode, "path string, row bigint, cells map<string,string>")
    if columns is None:
        names = cells.where("row = 0").select("path", F.posexplode(F.map_keys("cells")).alias("i", "name"))
        columns = [r["name"] for r in names.groupBy("name").agg(F.min("i").alias("i")).orderBy("i", "name").collect()]
    return cells.select(*[F.col("cells")[F.lit(c)].alias(c) for c in columns])
