"""Spreadsheets and archives as binary columns: made in the tasks that hold their rows, read where their bytes are.

A workbook has one sheet of text cells, so identifiers keep their zeros. A group with
more rows than a sheet may have is dealt to several.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered

#: Rows of a sheet, its header among them; a fixed value of the format.
SHEET_ROWS = 1_048_576
#: Fixed parts of a workbook, by name.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Datos" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def workbook(header: Sequence[str], rows: Iterator[Sequence[str | None]]) -> bytes:
    """A workbook of text cells; an empty cell is left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in PARTS.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate([header, *rows], 1):
                cells = "".join(f'<c r="{_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", v))}</t></is></c>' for i, v in enumerate(row) if v)
                sheet.write(f'<row r="{n}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def _place(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(content: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet as texts; shared, inline and number cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open("xl/worksheets/sheet1.xml") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if not row.tag.endswith("}row"):
                    continue
                out: list[str] = []
                for c in row:
                    value = next((v.text or "" for v in c if v.tag.endswith("}v")), "")
                    value = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" else value
                    at = _place(c.get("r")) if c.get("r") else len(out)
                    out += [""] * (at + 1 - len(out))
                    out[at] = value.strip()
                yield out
                row.clear()


def as_sheets(df: DataFrame, key: str, order: str, rows: int = SHEET_ROWS) -> DataFrame:
    """K3: ``key, sheet, content``: a workbook for each key, or several of ``rows`` rows, in the order of a number or time."""
    columns = [c for c in df.columns if c != key]
    dealt = numbered(df, [key], order).withColumn("sheet", F.floor((F.col("place") - 1) / (rows - 1)).cast("int"))
    texts = dealt.select(key, "sheet", "place", *[F.col(c).cast("string").alias(c) for c in columns])

    def make(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        body = frame.sort_values("place")[columns]
        lines = (["" if v is None or v != v else v for v in r] for r in body.itertuples(index=False, name=None))
        return pd.DataFrame({key: [k[0]], "sheet": [k[1]], "content": [workbook(columns, lines)]})

    return texts.groupBy(key, "sheet").applyInPandas(make, f"`{key}` {df.schema[key].dataType.simpleString()}, sheet int, content binary")


def read_sheets(files: DataFrame, required: Sequence[str], *keys: str) -> DataFrame:
    """``keys, row, cells`` (a map of header to text) of workbooks in ``content``.

    The header is the first row that has all required columns, whatever their case;
    blank headers are dropped. A workbook without such a row is an error.
    """
    wanted = {c.strip().lower() for c in required}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for *held, content in frame[[*keys, "content"]].itertuples(index=False, name=None):
                header, out = None, []
                for n, row in enumerate(cells(content), 1):
                    if header is None:
                        header = row if wanted <= {c.lower() for c in row} else None
                    elif any(row):
                        out.append((n, {h: row[i] if i < len(row) else "" for i, h in enumerate(header) if h}))
                if header is None:
                    raise ValueError(f"no header with {', '.join(sorted(wanted))}")
                yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, held, strict=True)}, "row": [n for n, _ in out], "cells": [c for _, c in out]})

    fields = [f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys]
    return files.select(*keys, "content").mapInPandas(read, ", ".join([*fields, "row int, cells map<string,string>"]))


def as_zip(files: DataFrame, key: str) -> DataFrame:
    """K4: ``key, content``: an archive of each key's files (``name, content``), by name; sizes are bounded where the files are chosen."""

    def make(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in frame.sort_values("name")[["name", "content"]].itertuples(index=False, name=None):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({key: [k[0]], "content": [out.getvalue()]})

    return files.select(key, "name", "content").groupBy(key).applyInPandas(make, f"`{key}` {files.schema[key].dataType.simpleString()}, content binary")


def read_zip(archives: DataFrame, key: str) -> DataFrame:
    """``key, name, content`` of the files in archives."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, content in frame[[key, "content"]].itertuples(index=False, name=None):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    yield pd.DataFrame({key: [k] * len(names), "name": names, "content": [z.read(n) for n in names]})

    return archives.select(key, "content").mapInPandas(read, f"`{key}` {archives.schema[key].dataType.simpleString()}, name string, content binary")
