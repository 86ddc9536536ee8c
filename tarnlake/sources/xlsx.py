"""Workbook reader: a sheet's rows as text columns, one task for each file."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a sheet (default: the first) row by row, as text; DTDs are refused."""
    book = zipfile.ZipFile(io.BytesIO(content))

    def xml(name: str) -> ElementTree.Element:
        raw = book.read(name)
        if b"<!DOCTYPE" in raw[:2000]:
            raise ValueError("document types aren't allowed")
        return ElementTree.fromstring(raw)

    texts = []
    if "xl/sharedStrings.xml" in book.namelist():
        texts = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in xml("xl/sharedStrings.xml")]
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels").iter(_REL)}
    sheets = {s.get("name"): targets[s.get(f"{{{_NS['r']}}}id")] for s in xml("xl/workbook.xml").find("m:sheets", _NS)}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet {sheet}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    for row in xml("xl/" + target.removeprefix("/xl/")).iter(f"{{{_NS['m']}}}row"):
        out: list[str | None] = []
        for c in row.iter(f"{{{_NS['m']}}}c"):
            at = _column(c.get("r")) if c.get("r") else len(out)
            out += [None] * (at - len(out))
            v = c.find("m:v", _NS)
            if c.get("t") == "s" and v is not None:
                out.append(texts[int(v.text)])
            elif c.get("t") == "inlineStr":
                out.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
            elif c.get("t") == "b" and v is not None:
                out.append("true" if v.text == "1" else "false")
            else:
                out.append(None if v is None else v.text)
        yield out


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """``columns`` of the workbooks under a path as text, by the names in the first row; a missing one is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = rows_of(content.as_py(), sheet)
                head = next(rows, [])
                found = [json.dumps({h: v for h, v in zip(head, r, strict=False) if h in columns and v is not None}) for r in rows if any(v is not None for v in r)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["j"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "j string")
    return rows.select(*[F.get_json_object("j", f"$['{c}']").alias(c) for c in columns])
