"""The thirty assertions as Column expressions.

Each builder returns a string column: null where the assertion holds, otherwise the
detail of its failure. They read one row per document with the columns ``kind``,
``path``, ``view`` (structure.VIEW), ``sheets`` (grids.SHEETS) and ``pdf``; nothing is
joined or shuffled. A `$name` sheet is replaced by the column that binds it."""

from __future__ import annotations

import bisect
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.regexlang import RegexError, compile_python, error_of
from ..plans.definitions import Assertion



TEXT_PDF = "pdf with text_path"


def OK() -> Column:  # noqa: N802
    """No failure."""
    return F.lit(None).cast("string")


def _fail_unless(good: Column, *message: Any) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), OK()).otherwise(_say(*message))


def _say(*parts: Any) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _bad_regex(*patterns: str) -> str | None:
    for p in patterns:
        e = error_of(p)
        if e is not None:
            return f"invalid regex '{p}': {e}"
    return None


# Cell references (0-based inside)


def column_index(letters: str) -> int | None:
    if not re.fullmatch(r"[A-Za-z]{1,7}", letters):
        return None
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_cell(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\s*([A-Za-z]+)([0-9]+)\s*", ref)
    if not m or int(m[2]) < 1 or column_index(m[1]) is None:
        return None
    return int(m[2]) - 1, column_index(m[1])


def parse_range(ref: str) -> tuple[tuple[int, int], tuple[int, int]] | None:
    parts = [parse_cell(p) for p in ref.split(":")]
    if len(parts) != 2 or None in parts:
        return None
    (a, b), (c, d) = parts
    return (min(a, c), min(b, d)), (max(a, c), max(b, d))


def parse_rows(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\s*([0-9]+)\s*:\s*([0-9]+)\s*", ref)
    if not m or int(m[1]) < 1 or int(m[2]) < 1:
        return None
    a, b = sorted((int(m[1]) - 1, int(m[2]) - 1))
    return a, b


def cell_name(row: int, col: int) -> str:
    out, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return f"{out}{row + 1}"


class Builder:
    """Builds the columns of one definition; bindings live as long as it does."""

    def __init__(self, strict_compat: bool = True):
        self.strict = strict_compat
        self.bindings: dict[str, Column] = {}

    def detail(self, a: Assertion) -> Column:
        make = getattr(self, "_" + a.kind)
        return make(**{("text" if k == "" else k): v for k, v in a.params.items()})

    # documents

    def _format(self, format: str) -> Column:
        return _fail_unless(F.col("kind") == format, f"document is not {format}")

    def _filename_regex(self, pattern: str) -> Column:
        if bad := _bad_regex(pattern):
            return F.lit(bad)
        name = S.basename(F.col("path"))
        return _fail_unless(S.matches(name, pattern), "filename '", name, f"' does not match pattern '{pattern}'")

    # grids

    def _sheet(self, sheet: str) -> Column | str:
        """The sheet's name as a column, or what is wrong with the binding."""
        if not sheet.startswith("$"):
            return F.lit(sheet)
        key = sheet[1:].strip()
        if not key:
            return f"binding name '{sheet}' is invalid"
        if key not in self.bindings:
            return f"sheet binding '{sheet}' was not found"
        return self.bindings[key]

    def _grid(self, sheet: str, then) -> Column:
        """``then(grid)`` where the sheet is there: a struct with rows and their origin."""
        name = self._sheet(sheet)
        if isinstance(name, str):
            return F.lit(name)
        csv = F.col("kind") == "csv"
        same = lambda s: F.when(csv, S.ascii_lower(s["name"]) == S.ascii_lower(name)).otherwise(s["name"] == name)
        grid = F.try_element_at(F.filter("sheets", same), F.lit(1))
        return (
            F.when(~F.col("kind").isin("csv", "xlsx"), F.lit("spreadsheet assertion requires xlsx or csv document"))
            .when(name.isNull(), F.lit(f"sheet binding '{sheet}' was not found"))
            .when(grid.isNull() & csv, _say("sheet '", name, "' not found in csv document '", F.col("path"), "'"))
            .when(grid.isNull(), _say("failed reading sheet '", name, "'"))
            .otherwise(S.let(grid, then))
        )

    @staticmethod
    def _cell(grid: Column, row: int, col: int) -> Column:
        """The value at an absolute address; null where blank or outside."""
        r, c = F.lit(row + 1) - grid["origin_row"], F.lit(col + 1) - grid["origin_col"]
        value = F.when((r > 0) & (c > 0), F.try_element_at(F.try_element_at(grid["rows"], r.cast("int")), c.cast("int")))
        return F.when(~S.blank(value), value)

    def _sheet_exists(self, text: str) -> Column:
        name = self._sheet(text)
        if isinstance(name, str):
            return F.lit(name)
        csv = F.col("kind") == "csv"
        found = F.exists("sheets", lambda s: F.when(csv, S.ascii_lower(s["name"]) == S.ascii_lower(name)).otherwise(s["name"] == name))
        return F.when(~F.col("kind").isin("csv", "xlsx"), F.lit("spreadsheet assertion requires xlsx or csv document")).otherwise(
            _fail_unless(found, "sheet '", name, "' not found", F.when(csv, " in csv document").otherwise(""))
        )

    def _sheet_name_regex(self, pattern: str, bind: str | None) -> Column:
        if bad := _bad_regex(pattern):
            return F.lit(bad)
        first = F.try_element_at(F.filter("sheets", lambda s: S.matches(s["name"], pattern)), F.lit(1))["name"]
        if bind is not None:
            key = bind.strip().removeprefix("$").strip()
            if not key:
                return F.lit("binding name cannot be empty")
            self.bindings[key] = first
        csv = F.when(F.col("kind") == "csv", "csv virtual ").otherwise("")
        return F.when(~F.col("kind").isin("csv", "xlsx"), F.lit("spreadsheet assertion requires xlsx or csv document")).otherwise(
            _fail_unless(first.isNotNull(), "no ", csv, f"sheet name matched pattern '{pattern}'")
        )

    def _cell_eq(self, sheet: str, cell: str, value: str) -> Column:
        at = parse_cell(cell)
        if at is None:
            return F.lit(f"invalid cell reference '{cell}'")

        def then(grid: Column) -> Column:
            missing = F.lit(f"cell {cell} is empty or missing")
            return S.let(self._cell(grid, *at), lambda v: F.when(v.isNull(), missing).otherwise(_fail_unless(v == value, f"cell {cell} expected '{value}' but found '", v, "'")))

        return self._grid(sheet, then)

    def _cell_regex(self, sheet: str, cell: str, pattern: str) -> Column:
        at = parse_cell(cell)
        if at is None:
            return F.lit(f"invalid cell reference '{cell}'")
        if bad := _bad_regex(pattern):
            return F.lit(bad)

        def then(grid: Column) -> Column:
            missing = F.lit(f"cell {cell} is empty or missing")
            return S.let(self._cell(grid, *at), lambda v: F.when(v.isNull(), missing).otherwise(_fail_unless(S.matches(v, pattern), f"cell {cell} value '", v, f"' did not match pattern '{pattern}'")))

        return self._grid(sheet, then)

    @staticmethod
    def _range_rows(grid: Column, box: tuple[tuple[int, int], tuple[int, int]]) -> Column:
        """The cells of a range, row by row: (row, col, value or null)."""
        (r0, c0), (r1, c1) = box

        def cells(r: Column, row: Column) -> Column:
            j = lambda c: c + 1 - grid["origin_col"]
            value = lambda c: F.when(j(c) > 0, F.try_element_at(row, j(c).cast("int")))
            return F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col"), F.when(~S.blank(value(c)), value(c)).alias("value")))

        rows, cols = F.sequence(F.lit(r0), F.lit(r1)), F.sequence(F.lit(c0), F.lit(c1))
        row_at = lambda i: F.when(i > 0, F.try_element_at(grid["rows"], i.cast("int")))
        return F.transform(rows, lambda r: S.let(row_at(r + 1 - grid["origin_row"]), lambda row: cells(r, row)))

    @staticmethod
    def _values(grid: Column, box: tuple[tuple[int, int], tuple[int, int]]) -> Column:
        """All cells of a range in row-major order: (row, col, value or null)."""
        return F.flatten(Builder._range_rows(grid, box))

    def _range_non_null(self, sheet: str, range: str) -> Column:
        box = parse_range(range)
        if box is None:
            return F.lit(f"invalid range reference '{range}'")

        def then(grid: Column) -> Column:
            first = F.try_element_at(F.filter(self._values(grid, box), lambda x: x["value"].isNull()), F.lit(1))
            return F.when(first.isNull(), OK()).otherwise(_say(f"range {range} contains empty or missing cell at ", S.a1(first["row"], first["col"])))

        return self._grid(sheet, then)

    def _sheet_min_rows(self, sheet: str, min_rows: int) -> Column:
        def then(grid: Column) -> Column:
            n = F.size(F.filter(grid["rows"], lambda r: F.exists(r, lambda v: ~S.blank(v))))
            return _fail_unless(n >= min_rows, "sheet '", self._sheet(sheet), "' has ", n, f" non-empty rows, expected at least {min_rows}")

        return self._grid(sheet, then)

    def _column_search(self, sheet: str, column: str, row_range: str, pattern: str) -> Column:
        col, rows = column_index(column.strip()), parse_rows(row_range)
        if col is None:
            return F.lit(f"invalid column reference '{column}'")
        if rows is None:
            return F.lit(f"invalid row range '{row_range}'")
        if bad := _bad_regex(pattern):
            return F.lit(bad)

        def then(grid: Column) -> Column:
            # rows count from the used range's first one, as those of header_row_match do
            mine = F.slice(grid["rows"], F.lit(rows[0] + 1), F.lit(rows[1] - rows[0] + 1))
            found = F.exists(mine, lambda r: F.coalesce(S.matches(F.try_element_at(r, F.lit(col + 1)), pattern), F.lit(False)))
            return _fail_unless(found, f"no cell in column {column} rows {row_range}", f" matched pattern '{pattern}'")

        return self._grid(sheet, then)

    def _header_row_match(self, sheet: str, row_range: str, min_match: int, columns: list) -> Column:
        patterns = [c["pattern"] for c in columns]
        if not patterns:
            return F.lit("header_row_match requires at least one column pattern")
        rows = parse_rows(row_range)
        if rows is None:
            return F.lit(f"invalid row range '{row_range}'")
        if bad := _bad_regex(*patterns):
            return F.lit(bad)

        def claim(taken: Column, cell: Column) -> Column:
            """Each cell takes the first open pattern that it matches."""
            free = [F.when(~F.array_contains(taken, i) & S.matches(cell, p), F.lit(i)) for i, p in enumerate(patterns)]
            return S.let(F.coalesce(*free), lambda i: F.when(S.blank(cell) | i.isNull(), taken).otherwise(F.array_append(taken, i)))

        def then(grid: Column) -> Column:
            mine = F.slice(grid["rows"], F.lit(rows[0] + 1), F.lit(rows[1] - rows[0] + 1))
            counts = F.transform(mine, lambda r: F.size(F.aggregate(r, F.array().cast("array<int>"), claim)))

            def judge(found: Column) -> Column:
                best = F.coalesce(F.array_max(found), F.lit(0))
                row = F.when(best > 0, (F.array_position(found, best) + rows[0]).cast("string")).otherwise("none")
                return _fail_unless(best >= min_match, f"no row in range {row_range} reached", f" min_match {min_match}; best row was ", row, " with ", best, " matches")

            return S.let(counts, judge)

        return self._grid(sheet, then)

    # advertised, never true unless asked for

    def _unsupported(self, kind: str) -> Column:
        return F.lit(f"assertion '{kind}' is not implemented in v0.1")

    def _range_populated(self, sheet: str, range: str, min_pct: float) -> Column:
        box = parse_range(range)
        if self.strict:
            return self._unsupported("range_populated")
        if box is None:
            return F.lit(f"invalid range reference '{range}'")

        def then(grid: Column) -> Column:
            share = lambda cells: F.size(F.filter(cells, lambda x: x["value"].isNotNull())) / F.size(cells)
            said = lambda x: _fail_unless(x >= min_pct, f"range {range} is populated to ", F.round(x, 4).cast("string"), f", expected at least {min_pct}")
            return S.let(S.let(self._values(grid, box), share), said)

        return self._grid(sheet, then)

    def _first_sheet(self, then) -> Column:
        grid = F.try_element_at("sheets", F.lit(1))
        return F.when(grid.isNull(), F.lit("spreadsheet assertion requires xlsx or csv document")).otherwise(S.let(grid, then))

    def _sum_eq(self, range: str, equals_cell: str, tolerance: float) -> Column:
        box, at = parse_range(range), parse_cell(equals_cell)
        if self.strict:
            return self._unsupported("sum_eq")
        if box is None or at is None:
            return F.lit(f"invalid range reference '{range if box is None else equals_cell}'")

        def then(grid: Column) -> Column:
            numbers = F.transform(self._values(grid, box), lambda x: F.coalesce(F.expr("0D") + x["value"].try_cast("double"), F.lit(0.0)))
            total, want = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x), self._cell(grid, *at).try_cast("double")
            return _fail_unless(F.abs(total - want) <= tolerance, f"sum of {range} differs from {equals_cell}")

        return self._first_sheet(then)

    def _within_tolerance(self, cell: str, min: float, max: float) -> Column:
        at = parse_cell(cell)
        if self.strict:
            return self._unsupported("within_tolerance")
        if at is None:
            return F.lit(f"invalid cell reference '{cell}'")
        return self._first_sheet(lambda grid: _fail_unless(self._cell(grid, *at).try_cast("double").between(min, max), f"cell {cell} is not within [{min}, {max}]"))

    # structured content

    def _content(self, then: Column) -> Column:
        kind = F.col("kind")
        return (
            F.when(kind.isin("html", "markdown"), then)
            .when(kind == "pdf", F.when(F.col("view").isNull(), F.lit("No text_path provided (E_NO_TEXT)")).otherwise(then))
            .when(kind == "text", F.lit(f"Heading assertions require html or markdown format, or {TEXT_PDF} (text format has no heading structure)"))
            .otherwise(F.lit(f"Content assertions with heading structure require html, markdown, or {TEXT_PDF}"))
        )

    def _text_source(self, name: str, then: Column) -> Column:
        kind = F.col("kind")
        return (
            F.when(kind.isin("html", "markdown", "text"), then)
            .when(kind == "pdf", F.when(F.col("view").isNull(), F.lit("No text_path provided (E_NO_TEXT)")).otherwise(then))
            .otherwise(F.lit(f"Content assertion '{name}' not supported for document type"))
        )

    def _html(self, then: Column) -> Column:
        return F.when(F.col("kind") == "html", then).otherwise(F.lit("html assertion requires html format"))

    def _heading_exists(self, text: str) -> Column:
        return self._content(_fail_unless(F.exists("view.headings", lambda h: h["text"] == text), f"Heading '{text}' not found"))

    def _heading_regex(self, pattern: str) -> Column:
        if bad := _bad_regex(pattern):
            return self._content(F.lit(bad))
        return self._content(_fail_unless(F.exists("view.headings", lambda h: S.matches(h["text"], pattern)), f"No heading matches pattern '{pattern}'"))

    def _heading_level(self, level: int, pattern: str) -> Column:
        if bad := _bad_regex(pattern):
            return self._content(F.lit(bad))
        found = F.exists("view.headings", lambda h: (h["level"] == level) & S.matches(h["text"], pattern))
        return self._content(_fail_unless(found, f"No level-{level} heading", f" matches pattern '{pattern}'"))

    def _text_contains(self, text: str) -> Column:
        return self._text_source("text_contains", _fail_unless(F.contains("view.normalized", F.lit(text)), f"Text '{text}' not found in document"))

    def _text_regex(self, pattern: str) -> Column:
        if bad := _bad_regex(pattern):
            return F.lit(bad)
        return self._text_source("text_regex", _fail_unless(S.matches(F.col("view.normalized"), pattern), f"Pattern '{pattern}' not found in document"))

    def _text_near(self, anchor: str, pattern: str, within_chars: int) -> Column:
        if bad := _bad_regex(anchor, pattern):
            return F.lit(bad)
        near = near_udf(anchor, pattern, within_chars)(F.col("view.normalized"))
        return self._text_source("text_near", _fail_unless(near, f"No '{pattern}' match found near anchor '{anchor}' within {within_chars} chars"))

    def _section(self, heading: str, then) -> Column:
        if bad := _bad_regex(heading):
            return self._content(F.lit(bad))
        first = F.try_element_at(F.filter("view.sections", lambda s: s["heading"].isNotNull() & S.matches(s["heading"]["text"], heading)), F.lit(1))
        filled = F.size(F.filter(S.lines(first["content"]), lambda x, i: (i > 0) & ~S.blank(x)))
        return self._content(F.when(first.isNull(), F.lit(f"heading not found: no section matches '{heading}'")).otherwise(S.let(filled, then)))

    def _section_non_empty(self, heading: str) -> Column:
        return self._section(heading, lambda n: _fail_unless(n > 0, "Section is empty"))

    def _section_min_lines(self, heading: str, min_lines: int) -> Column:
        return self._section(heading, lambda n: _fail_unless(n >= min_lines, "Section has ", n, f" non-blank lines, expected at least {min_lines}"))

    def _find_table(self, heading: str, index: int | None, then) -> Column:
        if bad := _bad_regex(heading):
            return self._content(F.lit(bad))
        i = index or 0
        table = F.try_element_at(F.filter("view.tables", lambda t: F.coalesce(S.matches(t["heading_ref"], heading), F.lit(False))), F.lit(i + 1))
        return self._content(F.when(table.isNull(), F.lit(f"table not found for heading '{heading}' at index {i}")).otherwise(S.let(table, then)))

    def _table_exists(self, heading: str, index: int | None) -> Column:
        return self._find_table(heading, index, lambda t: OK())

    def _table_columns(self, heading: str, index: int | None, patterns: list[str]) -> Column:
        def then(t: Column) -> Column:
            n = F.size(t["headers"])
            out = OK()
            for i in reversed(range(len(patterns))):
                bad = _bad_regex(patterns[i])
                header = F.try_element_at(t["headers"], F.lit(i + 1))
                wrong = F.lit(bad) if bad else _say(f"column {i} header '", header, f"' does not match '{patterns[i]}'")
                out = F.when(F.lit(False) if bad else S.matches(header, patterns[i]), out).otherwise(wrong)
            return F.when(n < len(patterns), _say("table has ", n, f" columns but {len(patterns)} patterns were provided")).otherwise(out)

        return self._find_table(heading, index, then)

    def _table_shape(self, heading: str, index: int | None, min_columns: int, column_types: list[str]) -> Column:
        def then(t: Column) -> Column:
            n = F.size(t["headers"])
            found = F.array(*[column_type(t["rows"], i) for i in range(len(column_types))], F.lit(""))

            def judge(kinds: Column) -> Column:
                out = OK()
                for i in reversed(range(len(column_types))):
                    want, kind = column_types[i].lower(), F.element_at(kinds, i + 1)
                    good = kind.isin(want, *(("number", "currency") if want in ("number", "currency") else ()))
                    out = F.when(good, out).otherwise(_say(f"column {i} inferred as '", kind, f"' but expected '{column_types[i]}'"))
                return out

            few = F.when(n < len(column_types), _say("table has ", n, f" columns but {len(column_types)} expected types were provided"))
            return F.when(n < min_columns, _say("table has ", n, f" columns, expected at least {min_columns}")).when(few.isNotNull(), few).otherwise(S.let(found, judge))

        return self._find_table(heading, index, then)

    def _table_min_rows(self, heading: str, index: int | None, min_rows: int) -> Column:
        return self._find_table(heading, index, lambda t: _fail_unless(F.size(t["rows"]) >= min_rows, "table has ", F.size(t["rows"]), f" rows, expected at least {min_rows}"))

    # html tables and pages

    def _header_token_search(self, tokens: list[str], min_matches: int, page: int | None, index: int | None, max_matches: int | None) -> Column:
        if not tokens:
            return self._html(F.lit("header_token_search requires at least one token"))
        if max_matches is not None and max_matches < min_matches:
            return self._html(F.lit("header_token_search max_matches cannot be less than min_matches"))
        if bad := _bad_regex(*tokens):
            return self._html(F.lit(bad))
        tables = F.filter("view.tables", lambda t: t["page"].eqNullSafe(page)) if page is not None else F.col("view.tables")
        where = f" for page {page}" if page is not None else ""
        chosen = tables if index is None else F.slice(tables, F.lit(index + 1), F.lit(1))

        def count(t: Column) -> Column:
            hit = [F.when(F.exists(t["headers"], _matcher(p)), 1).otherwise(0) for p in tokens]
            return sum(hit[1:], hit[0])

        found = F.coalesce(F.array_max(F.transform(chosen, count)), F.lit(0))
        out = F.when(F.size(tables) == 0, F.lit(f"no html tables found{where}"))
        if index is not None:
            out = out.when(F.size(tables) <= index, F.lit(f"no html table at filtered index {index}{where}"))

        def judge(best: Column) -> Column:
            low = F.when(best < min_matches, _say("best header token match count was ", best, f", expected at least {min_matches}"))
            return low if max_matches is None else low.when(best > max_matches, _say("best header token match count was ", best, f", expected at most {max_matches}"))

        return self._html(out.otherwise(S.let(found, judge)))

    def _dominant_column_count(self, count: int, tolerance: int, sample_pages: int) -> Column:
        if sample_pages == 0:
            return self._html(F.lit("dominant_column_count sample_pages must be >= 1"))
        paged = F.exists("view.tables", lambda t: t["page"].isNotNull())
        tables = F.filter("view.tables", lambda t: ~paged | F.coalesce(t["page"] <= sample_pages, F.lit(False)))
        judge = lambda mode: _fail_unless(F.abs(mode - count) <= tolerance, "dominant column count was ", mode, f", expected {count} +/- {tolerance}")
        mode = S.let(F.transform(tables, table_width), dominant)
        return self._html(F.when(F.size(tables) == 0, F.lit(f"no html tables available within the first {sample_pages} pages")).otherwise(S.let(mode, judge)))

    def _full_width_row(self, pattern: str, min_cells: int) -> Column:
        if bad := _bad_regex(pattern):
            return self._html(F.lit(bad))

        def full(row: Column) -> Column:
            filled = F.array_distinct(F.filter(F.transform(row, S.trim), lambda x: x != ""))
            return (F.size(row) >= min_cells) & S.let(filled, lambda x: (F.size(x) == 1) & S.matches(F.try_element_at(x, F.lit(1)), pattern))

        found = F.exists("view.tables", lambda t: F.exists(t["rows"], lambda r: F.coalesce(full(r), F.lit(False))))
        return self._html(_fail_unless(found, f"no full-width row matched '{pattern}'", f" with min_cells {min_cells}"))

    @staticmethod
    def _bounds(n: Column, low: int | None, high: int | None, few: tuple, many: tuple) -> Column:
        out = F.when(F.lit(False), OK())
        if low is not None:
            out = out.when(n < low, _say(*few))
        if high is not None:
            out = out.when(n > high, _say(*many))
        return out.otherwise(OK())

    def _page_section_count(self, min: int | None, max: int | None) -> Column:
        n = F.col("view.page_sections")
        return self._html(self._bounds(n, min, max, ("html page-section count was ", n, f", expected at least {min}"), ("html page-section count was ", n, f", expected at most {max}")))

    # pdf

    def _pdf(self, then: Column) -> Column:
        error = F.col("pdf.error")
        return F.when(F.col("kind") != "pdf", F.lit("pdf structural assertion requires pdf format")).when(
            F.col("pdf").isNull() | error.isNotNull(), _say("failed reading pdf '", F.col("path"), "': ", F.coalesce(error, F.lit("missing")))
        ).otherwise(then)

    def _page_count(self, min: int | None, max: int | None) -> Column:
        n = F.col("pdf.page_count")
        return self._pdf(self._bounds(n, min, max, ("pdf has ", n, f" pages, expected at least {min}"), ("pdf has ", n, f" pages, expected at most {max}")))

    def _metadata_regex(self, key: str, pattern: str) -> Column:
        if bad := _bad_regex(pattern):
            return F.lit(bad)
        value = F.try_element_at(F.filter("pdf.info", lambda e: S.ascii_lower(e["key"]) == S.ascii_lower(F.lit(key))), F.lit(1))["value"]
        return self._pdf(
            F.when(value.isNull(), F.lit(f"metadata key '{key}' not found")).otherwise(_fail_unless(S.matches(value, pattern), f"metadata '{key}' value '", value, f"' does not match pattern '{pattern}'"))
        )


def _matcher(pattern: str):
    return lambda x: S.matches(x, pattern)


def table_width(table: Column) -> Column:
    widest = F.array_max(F.transform(table["rows"], lambda r: F.size(r)))
    return F.greatest(F.coalesce(widest, F.lit(0)), F.size(table["headers"]))


def dominant(widths: Column) -> Column:
    """The most frequent number; of several the smallest."""
    counted = F.transform(F.array_distinct(widths), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), (-w).alias("less")))
    return -F.array_max(counted)["less"]


def column_type(rows: Column, index: int) -> Column:
    """What most of a column's filled cells are."""
    kinds = F.filter(F.transform(rows, lambda r: S.cell_type(F.coalesce(F.try_element_at(r, F.lit(index + 1)), F.lit("")))), lambda k: k != "empty")

    def majority(ks: Column) -> Column:
        most = lambda k: F.size(F.filter(ks, lambda x: x == k)) >= F.floor(F.size(ks) / 2) + 1
        return F.when(F.size(ks) == 0, "empty").when(most("currency"), "currency").when(most("number"), "number").when(most("percentage"), "percentage").when(most("date"), "date").otherwise("string")

    return S.let(kinds, majority)


def spans(text: str, pattern: Any) -> list[tuple[int, int]]:
    """UTF-8 byte ranges of all matches."""
    if text.isascii():
        return [m.span() for m in pattern.finditer(text)]
    out, at, bytes_at = [], 0, 0
    for m in pattern.finditer(text):
        bytes_at += len(text[at : m.start()].encode())
        size = len(m.group().encode())
        out.append((bytes_at, bytes_at + size))
        at, bytes_at = m.end(), bytes_at + size
    return out


def is_near(text: str, anchor: Any, value: Any, within: int) -> bool:
    """Whether a value is within so many bytes of an anchor; overlaps are at 0, and so
    are gaps of under ten bytes of white space."""
    anchors, values = spans(text, anchor), spans(text, value)
    data, starts = text.encode(), [v[0] for v in values]
    for a in anchors:
        # matches are in order and don't overlap: the nearest on each side are enough
        k = bisect.bisect_left(starts, a[1])
        for v in values[max(k - 1, 0) : k + 1]:
            lo, hi = (a[1], v[0]) if v[0] >= a[1] else (v[1], a[0])
            gap = hi - lo
            if gap <= within or (gap < 10 and not data[lo:hi].decode("utf-8", "replace").strip()):
                return True
    return False


def near_udf(anchor: str, pattern: str, within: int):
    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        try:
            a, v = compile_python(anchor), compile_python(pattern)
        except RegexError:
            return pd.Series([False] * len(texts))
        return pd.Series([t is not None and is_near(t, a, v, within) for t in texts])

    return near

