"""Messy tables: delimited text and workbooks in, with the header row found; delimited text, workbooks and JSON out.

Texts are read by Spark, so any store it reads will do; separators and the header are told from the first lines only. Workbooks are
one zip archive each and are read whole by one task per file.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ",;\t|"


def separator(sample: str, name: str = "") -> str:
    """Tab for .tsv, comma for .txt, else the separator that cuts the sample's lines most evenly; a comma if none does."""
    if name.endswith(".tsv"):
        return "\t"
    if name.endswith(".txt"):
        return ","
    best, most = ",", 0.0
    lines = [x for x in sample.splitlines() if x.strip()]
    for s in SEPARATORS:
        counts = Counter(len(next(csv.reader([x], delimiter=s))) - 1 for x in lines)
        n, times = counts.most_common(1)[0] if counts else (0, 0)
        if n and n * times / len(lines) > most:
            best, most = s, n * times / len(lines)
    return best


def header_score(row: list[str], below: list[str] | None) -> float:
    """How much a row looks like a header: words rather than numbers, short, distinct, filled, with data below."""
    filled = [c.strip() for c in row if c and c.strip()]
    if len(filled) < 2:
        return -1.0
    share = lambda test: sum(map(bool, map(test, filled))) / len(filled)
    score = 0.4 * share(lambda c: not re.fullmatch(r"[\d.,%$/-]+", c)) + 0.2 * share(lambda c: len(c) <= 40)
    score += 0.2 * len({c.lower() for c in filled}) / len(filled) + 0.2 * len(filled) / len(row)
    return score + (0.1 if below and any(c and c.strip() for c in below) else 0.0)


def header_row(rows: list[list[str]], scan: int = 12) -> int:
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    scores = [header_score(r, rows[i + 1] if i + 1 < len(rows) else None) for i, r in enumerate(rows[:scan])]
    return scores.index(max(scores)) if scores and max(scores) >= 0 else 0


def distinct_names(names: list[str]) -> list[str]:
    """Blank names become column_<i>, counted from 1; a repeated one gets _1, _2 and so on."""
    seen: Counter = Counter()
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"column_{i + 1}"
        out.append(n if not seen[n] else f"{n}_{seen[n]}")
        seen[n] += 1
    return out


def _table(numbered: DataFrame, names: list[str]) -> DataFrame:
    """row_id and a string column for each name from (row_id, cells): short rows are padded, long ones cut, blank ones dropped."""
    cells = [F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    filled = F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return numbered.filter(filled).select("row_id", *cells)


def read_delimited(spark: SparkSession, path: str, header: int | None = None, line_breaks: bool = True) -> DataFrame:
    """row_id (order in the file) and all columns as strings. Cells may hold separators, doubled quotes and line breaks if they are quoted.

    header: which line of the file, blank ones counted, is the header; else it is found. With line_breaks False a quoted cell must end
    on its line, and large files are split over tasks; else a file is read by one task. row_id grows within and across partitions,
    which are files or ranges of them."""
    text = "\n".join(r["value"] for r in spark.read.text(path).limit(200).collect()).lstrip("\ufeff")
    sep = separator(text, path.rstrip("/").lower())
    first = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    if not first:
        return spark.createDataFrame([], "row_id long")
    head = first[header_row(first) if header is None else header]
    names = distinct_names(head)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": line_breaks, "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = spark.read.schema(schema).options(**options).csv(path)
    numbered = raw.select(F.monotonically_increasing_id().alias("row_id"), F.array(*raw.columns).alias("cells"))
    # the reader leaves out empty lines, so the header is found again among its rows, the first of the first partition
    sample = numbered.limit(len(first)).collect()
    same = lambda cells: [(c or "").lstrip("\ufeff").strip() for c in cells] == [c.strip() for c in head]
    before = sum(map(bool, first[:header])) if header is not None else 0
    at = next((r["row_id"] for i, r in enumerate(sample) if i >= before and same(r["cells"])), -1)
    return _table(numbered.filter(F.col("row_id") > at), names)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(body: bytes) -> list[tuple[str, str]]:
    """Name and path in the archive of each sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")
        return [(s.get("name"), "xl/" + targets[s.get(_REL)].removeprefix("/xl/").lstrip("/")) for s in found]


def sheet_rows(body: bytes, sheet: str | None = None) -> list[list[str]]:
    """Cells of a sheet, the first one unless named; shared and inline strings; every row as wide as the widest."""
    known = sheets(body)
    path = next((p for n, p in known if sheet and n.lower() == sheet.lower()), known[0][1])
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        rows: list[list[str]] = []
        for r in ET.fromstring(z.read(path)).iter(f"{_NS}row"):
            row: list[str] = []
            for i, c in enumerate(r.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                row += [""] * (at + 1 - len(row))
                v = c.find(f"{_NS}v")
                if c.get("t") == "inlineStr":
                    row[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    row[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: int | None = None) -> DataFrame:
    """row_id and all columns of a sheet as strings. The archive is parsed by a task, the header alone by the driver."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for body in b["content"]:
                rows = sheet_rows(bytes(body), sheet)
                yield pd.DataFrame({"row_id": range(len(rows)), "cells": rows})

    rows = files.mapInPandas(parse, "row_id long, cells array<string>")
    first = [list(r["cells"]) for r in rows.filter("row_id < 13").orderBy("row_id").collect()]
    at = header_row(first) if header is None else header
    return _table(rows.filter(F.col("row_id") > at), distinct_names(first[at]) if first else [])


def read_table(spark: SparkSession, path: str, sheet: str | None = None, header: int | None = None) -> DataFrame:
    low = path.rstrip("/").lower()
    if low.endswith((".xlsx", ".xlsm")):
        return read_workbook(spark, path, sheet, header)
    if low.endswith((".csv", ".tsv", ".txt")):
        return read_delimited(spark, path, header)
    raise ValueError(f"no reader for {path}")


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order as strings; those that df lacks, and nulls, are empty."""
    return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def write_delimited(df: DataFrame, path: str, columns: list[str]) -> None:
    """Delimited text. The header, after a byte order mark for spreadsheet programs, is the first part alone, so that the parts, one
    after the other, are one file."""
    out = as_text(df, columns)
    head = df.sparkSession.createDataFrame([("\ufeff" + columns[0], *columns[1:])], out.schema).coalesce(1)
    head.union(out).write.mode("overwrite").options(header=False, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


_CONTROL = re.compile("[\x00-\x08\x0b-\x1f]")


def workbook(columns: list[str], rows: list[list[str]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet, with strings inline. Control characters but tab and line feed are left out; a sheet's name has 31 characters at most."""
    from xml.sax.saxutils import escape

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, d = divmod(i - 1, 26)
            out = chr(65 + d) + out
        return out

    body = []
    for n, row in enumerate([columns, *rows], 1):
        cells = "".join(f'<c r="{name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", v or ""))}</t></is></c>' for i, v in enumerate(row) if v)
        body.append(f'<row r="{n}">{cells}</row>')
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, content = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{content}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{content}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p, text in parts.items():
            z.writestr(p, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


#: A worksheet holds 1,048,576 rows, so a workbook is bounded whatever the table.
SHEET_ROWS = 1_048_575


def write_workbook(df: DataFrame, path: str, columns: list[str], sheet: str = "Sheet1", rows: int = 100_000) -> None:
    """One workbook, on the driver. A table of more than ``rows`` rows doesn't fit and is refused, not cut."""
    found = as_text(df, columns).limit(min(rows, SHEET_ROWS) + 1).collect()
    if len(found) > min(rows, SHEET_ROWS):
        raise ValueError(f"more than {min(rows, SHEET_ROWS)} rows; write delimited text")
    with open(path, "wb") as f:
        f.write(workbook(columns, [list(r) for r in found], sheet))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
