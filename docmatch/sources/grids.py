"""Delimited files and workbooks as grids.

A document's sheets are one nested column, ``array<struct<name, origin_row, origin_col,
rows>>``; ``cells`` explodes it into one row per filled cell."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEETS = "array<struct<name:string,origin_row:int,origin_col:int,rows:array<array<string>>>>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class GridError(ValueError):
    """A file that can't be read as a grid."""


def csv_rows(text: str, strict: bool = False) -> list[list[str]]:
    """All records, blank lines left out; strict: of one width."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if strict:
        for n, r in enumerate(rows, 1):
            if len(r) != len(rows[0]):
                raise GridError(f"record {n} has {len(r)} fields, but the first has {len(rows[0])}")
    return rows


def csv_sheets(text: str, stem: str | None) -> list[dict]:
    """One grid under its three names."""
    rows = csv_rows(text)
    names = ["Sheet1", "csv", *([stem] if stem else [])]
    return [{"name": n, "origin_row": 0, "origin_col": 0, "rows": rows} for n in names]


def _number_text(raw: str) -> str:
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _address(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
    if not m:
        raise GridError(f"bad cell address {ref!r}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _sheet_cells(root: ElementTree.Element, strings: list[str]) -> dict[tuple[int, int], str]:
    cells: dict[tuple[int, int], str] = {}
    row = -1
    for r in root.iter(MAIN + "row"):
        row = int(r.get("r", row + 2)) - 1
        col = -1
        for c in r.iter(MAIN + "c"):
            at = _address(c.get("r")) if c.get("r") else (row, col + 1)
            col = at[1]
            kind, v = c.get("t", "n"), c.find(MAIN + "v")
            raw = v.text if v is not None and v.text is not None else ""
            if kind == "s":
                value = strings[int(raw)] if raw else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(MAIN + "t"))
            elif kind == "b":
                value = "true" if raw == "1" else "false"
            elif kind == "n" and raw:
                value = _number_text(raw)
            else:
                value = raw
            if value != "":
                cells[at] = value
    return cells


def xlsx_sheets(body: bytes) -> list[dict]:
    """Sheets in workbook order; rows start at the used range's first cell."""
    try:
        z = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile as e:
        raise GridError(corrupt_hint(body)) from e
    names = set(z.namelist())
    if "xl/workbook.xml" not in names:
        raise GridError(f"no xl/workbook.xml among {len(names)} entries ({sum(n.startswith('xl/') for n in names)} under xl/)")
    try:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {}
        if "xl/_rels/workbook.xml.rels" in names:
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
        out = []
        for i, s in enumerate(book.iter(MAIN + "sheet"), 1):
            target = rels.get(s.get(RELATION)) or f"worksheets/sheet{i}.xml"
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            cells = _sheet_cells(ElementTree.fromstring(z.read(path)), strings) if path in names else {}
            top, left = min((r for r, _ in cells), default=0), min((c for _, c in cells), default=0)
            bottom, right = max((r for r, _ in cells), default=-1), max((c for _, c in cells), default=-1)
            rows = [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]
            out.append({"name": s.get("name"), "origin_row": top, "origin_col": left, "rows": rows})
        return out
    except (ElementTree.ParseError, KeyError, IndexError, ValueError, zipfile.BadZipFile) as e:
        raise GridError(f"unreadable workbook: {e}") from e


def corrupt_hint(body: bytes) -> str:
    """What a file that isn't a zip archive looks like."""
    if body[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        return "legacy binary workbook (OLE2 container), which isn't supported"
    if body[:1] in (b"<", b"{") or body[:5].isascii() and body[:5].isalnum():
        return f"not a zip archive; starts like text: {body[:16]!r}"
    return f"not a zip archive; starts with {body[:4].hex()}" if body else "the file is empty"


def cells(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, sheet, sheet_pos, row, col, value`` of every non-empty cell (0-based)."""
    s = docs.select(id_col, F.posexplode("sheets").alias("sheet_pos", "s"))
    r = s.select(id_col, "sheet_pos", F.col("s.name").alias("sheet"), "s.origin_row", "s.origin_col", F.posexplode("s.rows").alias("r", "cells"))
    c = r.select("*", F.posexplode("cells").alias("c", "value")).where("value <> ''")
    return c.select(id_col, "sheet", "sheet_pos", (F.col("origin_row") + F.col("r")).alias("row"), (F.col("origin_col") + F.col("c")).alias("col"), "value")
