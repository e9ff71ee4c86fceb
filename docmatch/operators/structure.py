"""Structuring of markdown and HTML into headings, sections and tables.

Trees and line machines have state that array functions can't carry, so they run in
Arrow functions; everything after them stays in the JVM. ``native_*`` are the parts of
the markdown side that array functions do express."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Collection, Sequence
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

HEADING = "struct<level:int,text:string,line:int>"
SECTION = f"struct<heading:{HEADING},start_line:int,end_line:int,content:string,page:int>"
TABLE = "struct<heading_ref:string,index:int,start_line:int,end_line:int,page:int,headers:array<string>,rows:array<array<string>>>"
PARTS = {"normalized": "string", "headings": f"array<{HEADING}>", "sections": f"array<{SECTION}>", "tables": f"array<{TABLE}>", "page_sections": "int"}
VIEW = f"struct<{','.join(f'{k}:{v}' for k, v in PARTS.items())}>"

_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string()), ("line", pa.int32())])
_SECTION = pa.struct([("heading", _HEADING), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("page", pa.int32())])
_TABLE = pa.struct([("heading_ref", pa.string()), ("index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("page", pa.int32()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
ARROW = {"normalized": pa.string(), "headings": pa.list_(_HEADING), "sections": pa.list_(_SECTION), "tables": pa.list_(_TABLE), "page_sections": pa.int32()}


def split_lines(text: str) -> list[str]:
    """Lines of a text; a final empty piece is none, one carriage return goes."""
    parts = text.split("\n")
    tail = parts.pop()
    out = [p[:-1] if p.endswith("\r") else p for p in parts]
    return [*out, tail] if tail else out


# Markdown


def setext_to_atx(lines: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(lines):
        under = lines[i + 1] if i + 1 < len(lines) else ""
        if under[:1] in ("=", "-") and (title := lines[i].strip()) and not under.strip(under[0]) and len(under) >= len(title.encode()):
            out.append(("# " if under[0] == "=" else "## ") + title)
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


def bold_to_heading(lines: list[str]) -> list[str]:
    out = []
    for i, line in enumerate(lines):
        t = line.strip() if "**" in line else ""
        if len(t.encode()) > 4 and t.startswith("**") and t.endswith("**") and t[2:-2].strip() and not any(x.strip() for x in (*lines[max(i - 1, 0) : i], *lines[i + 1 : i + 2])):
            out.append("## " + t[2:-2].strip())
        else:
            out.append(line)
    return out


def squeeze(lines: list[str]) -> list[str]:
    kept: list[str] = []
    for line in map(str.rstrip, lines):
        if line or not kept or kept[-1]:
            kept.append(line)
    return kept


def is_piped(line: str) -> bool:
    t = line.strip()
    return t.startswith("|") and t.endswith("|")


def align_pipes(lines: list[str]) -> list[str]:
    return [" | ".join(c.strip() for c in x.split("|")) if is_piped(x) else x for x in lines]


def normalise_markdown(text: str) -> str:
    lines = split_lines(text)
    for step in (setext_to_atx, bold_to_heading, squeeze, align_pipes):
        lines = split_lines("\n".join(step(lines)))
    return "\n".join(lines)


def markdown_headings(lines: list[str]) -> list[dict]:
    found = []
    for n, line in enumerate(lines, 1):
        m = re.match(r"(#{1,6})(?!#)(.*)", line.strip(), re.S) if "#" in line else None
        if m:
            found.append({"level": len(m[1]), "text": m[2].strip(), "line": n})
    return found


def sections_of(lines: list[str], headings: list[dict], pages: list[int | None] | None = None) -> list[dict]:
    def section(heading: dict | None, start: int, end: int) -> dict:
        page = next((p for p in (pages or [])[start - 1 : end] if p is not None), None)
        return {"heading": heading, "start_line": start, "end_line": end, "content": "\n".join(lines[start - 1 : end]), "page": page}

    if not headings:
        return [section(None, 1, len(lines))]
    out = [section(None, 1, headings[0]["line"] - 1)] if headings[0]["line"] > 1 else []
    # from the last heading back: the next line of a heading of each level or a higher one
    ends, after = [], {}
    for h in reversed(headings):
        ends.append(min((line for level, line in after.items() if level <= h["level"]), default=len(lines) + 1) - 1)
        after = {level: line for level, line in after.items() if level < h["level"]} | {h["level"]: h["line"]}
    return out + [section(h, h["line"], end) for h, end in zip(headings, reversed(ends), strict=True)]


def markdown_tables(lines: list[str], headings: list[dict]) -> list[dict]:
    """A header with its separator but no data is followed by a table made of the
    separator, as the definitions in use expect."""
    cells = lambda line: [c.strip() for c in line.strip().split("|")[1:-1]]
    out, i, above, known = [], 0, None, 0
    while i < len(lines):
        if not is_piped(lines[i]):
            i += 1
            continue
        j = i + 1
        if j < len(lines) and is_piped(lines[j]) and "-" in lines[j]:
            j += 1
        first = j
        while j < len(lines) and is_piped(lines[j]):
            j += 1
        last = j - 1 if j > first else i
        while known < len(headings) and headings[known]["line"] <= i:
            above, known = headings[known]["text"], known + 1
        out.append({"heading_ref": above, "index": len(out), "start_line": i + 1, "end_line": last + 1, "page": None, "headers": cells(lines[i]), "rows": [cells(x) for x in lines[first:j]]})
        i = last + 1
    return out


def parse_markdown(text: str, parts: Collection[str] = PARTS) -> dict:
    normal = normalise_markdown(text)
    lines = split_lines(normal)
    headings = markdown_headings(lines) if {"headings", "sections", "tables"} & set(parts) else []
    return {
        "normalized": normal, "headings": headings, "sections": sections_of(lines, headings) if "sections" in parts else None,
        "tables": markdown_tables(lines, headings) if "tables" in parts else None, "page_sections": None,
    }


# HTML

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IGNORED = frozenset("script style head meta link title noscript".split())
HEADS = {f"h{i}": i for i in range(1, 7)}
BLOCK = frozenset(HEADS) | frozenset("p div section table ul ol li dl dd dt pre hr nav main header footer form fieldset figure figcaption blockquote aside article".split())
ENDS_P = BLOCK - {"li", "dt", "dd"} | frozenset("address center details dialog dir menu summary search hgroup".split())
TABLE_PARTS = frozenset("caption col colgroup th td tr tfoot tbody thead table body html".split())


class Node:
    """Its kids are nodes, and texts by their number."""

    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []


class TreeBuilder(HTMLParser):
    """A tree with the implied ends and parts that browsers supply."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.quirks = True
        self.texts: list[str] = []

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.quirks = False

    def _close(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Closes the innermost open element of these names, not looking past stop."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        cells = frozenset(("td", "th", "table", "caption"))
        if tag in ("html", "body"):
            self.root.attrs |= a
            return
        if tag in ENDS_P and not (tag == "table" and self.quirks) or tag in ("li", "dt", "dd"):
            self._close({"p"}, cells | {"button"})
        if tag == "li":
            self._close({"li"}, frozenset(("ul", "ol")) | cells)
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, frozenset(("dl",)) | cells)
        elif tag in HEADS and self.open[-1].name in HEADS:
            self.open.pop()
        elif tag in ("td", "th"):
            self._close({"td", "th"}, frozenset(("tr", "table")))
            if self.open[-1].name in ("table", "thead", "tbody", "tfoot"):
                self._row_parent()
                self._push(Node("tr"))
        elif tag == "tr":
            self._close({"tr"}, frozenset(("table", "thead", "tbody", "tfoot")))
            self._row_parent()
        elif tag in ("thead", "tbody", "tfoot"):
            self._close({"thead", "tbody", "tfoot"}, frozenset(("table",)))
        elif tag == "option":
            self._close({"option"}, frozenset(("select",)))
        node = Node(tag, a)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _push(self, node: Node) -> None:
        self.open[-1].kids.append(node)
        self.open.append(node)

    def _row_parent(self) -> None:
        if self.open[-1].name == "table":
            self._push(Node("tbody"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in HEADS:
            self._close(frozenset(HEADS), frozenset(("td", "th", "table")))
        elif tag in ("table", "section", "article", "div"):
            self._close({tag}, frozenset(("td", "th")) if tag != "table" else frozenset())
        else:
            self._close({tag}, frozenset(("table",)) if tag not in ("thead", "tbody", "tfoot", "tr", "td", "th") else frozenset())

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(len(self.texts))
        self.texts.append(data)


class _TagReader(HTMLParser):
    """The events of a tag by itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen.append(("handle_starttag", tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen.append(("handle_startendtag", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append(("handle_endtag", tag))

    def handle_decl(self, decl: str) -> None:
        self.seen.append(("handle_decl", decl))


TAG = re.compile("(<[^<>]*>)")
#: Tags that mean the same wherever they stand, outside of the elements below.
PLAIN = re.compile(r"""<(?:[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=`&/]+))?)*\s*/?|/[a-zA-Z][a-zA-Z0-9]*\s*|!(?i:doctype)\s+html)>""")
RAW = frozenset(("script", "style"))
ALONE = RAW | {"title", "textarea"}  # looked at only if their end is the next tag
OTHER = frozenset("xmp iframe noembed noframes noscript plaintext".split())
KEPT_TAGS, KEPT_LAYOUTS, LONG = 10_000, 1_000, 500
_tags: dict[str, tuple | None] = {}
_layouts: dict[tuple, tuple] = {}


def _event(tag: str) -> tuple | None:
    """What the parser makes of a tag; None if it has to see the whole text."""
    if tag not in _tags:
        if len(_tags) >= KEPT_TAGS:
            _tags.clear()
        reader = _TagReader()
        if PLAIN.fullmatch(tag):
            reader.feed(tag)
        _tags[tag] = reader.seen[0] if len(reader.seen) == 1 and reader.seen[0][1] not in OTHER and (not reader.rawdata or reader.seen[0][1] in ALONE) else None
    return _tags[tag]


def _plain(tags: Sequence[str]) -> list[tuple] | None:
    """The events of all tags of a page, None if one isn't plain."""
    events = [_event(t) for t in tags]
    for i, e in enumerate(events):
        if e is None or (e[0] == "handle_starttag" and e[1] in ALONE and (i + 1 == len(events) or events[i + 1] != ("handle_endtag", e[1]))):
            return None
    return events


def html_layout(text: str) -> tuple[tuple, int, list[str]]:
    """The blocks of a page, its numbered sections and its texts. Pages with the same
    tags and the same texts filled have one layout, which is made once."""
    pieces = TAG.split(text)
    tags, events, key = tuple(pieces[1::2]), None, None
    if text.count("<") == len(tags):
        texts = [unescaped(x) for x in pieces[::2]]
        filled = [bool(x and fragment(x)) for x in texts]
        if len(tags) <= LONG:
            # an empty text parts nothing, one of spaces may
            key = (tags, tuple(filled), tuple([not x for x in texts]))
            # texts of raw elements aren't unescaped, so those must have no & in them
            if (known := _layouts.get(key)) is not None and not any("&" in pieces[i] for i in known[2]):
                return known[0], known[1], texts
        events = _plain(tags)
    b = TreeBuilder()
    if events is None:
        b.feed(text)
        b.close()
        blocks, n = _program(b.root, [bool(fragment(x)) for x in b.texts])
        return blocks, n, b.texts
    raw: list[int] = []
    for i, x in enumerate(texts):
        if i and events[i - 1][0] == "handle_starttag" and events[i - 1][1] in RAW:
            raw.append(2 * i)
            texts[i] = pieces[2 * i]
            filled[i] = bool(fragment(texts[i]))
        if x:
            b.open[-1].kids.append(i)
        if i < len(events):
            getattr(b, events[i][0])(*events[i][1:])
    blocks, n = _program(b.root, filled)
    if key is not None and not any("&" in pieces[i] for i in raw):
        if len(_layouts) >= KEPT_LAYOUTS:
            _layouts.clear()
        _layouts[key] = (blocks, n, raw)
    return blocks, n, texts


DASHES = re.compile("[\u00a0\u2013\u2014]")
RULE = re.compile("[-_=:\u2013\u2014]*")
SHORT = 48


def _made_normal(text: str) -> str:
    if not text.isascii():
        text = DASHES.sub(" ", text)
    if "\n" not in text:
        return " ".join(text.split())
    return "\n".join(t for t in (" ".join(x.split()) for x in split_lines(text)) if t)


# short texts repeat from cell to cell and from page to page
_short_normal = functools.lru_cache(20_000)(_made_normal)
_short_unescaped = functools.lru_cache(20_000)(html.unescape)


def fragment(text: str) -> str:
    return _short_normal(text) if len(text) <= SHORT else _made_normal(text)


def unescaped(text: str) -> str:
    return text if "&" not in text else _short_unescaped(text) if len(text) <= SHORT else html.unescape(text)


def _all_text(node: Node) -> list[int]:
    out: list[int] = []
    todo: list[Any] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            todo += reversed(x.kids)
    return out


def _flow(node: Node, heading: bool) -> list[int | str]:
    """The texts of a block by number, and the line breaks between them."""
    out: list[int | str] = []
    for k in node.kids:
        if isinstance(k, int):
            out.append(k)
        elif k.name == "br":
            out.append("\n")
        elif k.name in IGNORED or (heading and k.name in BLOCK and k.name not in HEADS):
            continue
        else:
            out += _flow(k, heading)
            if not heading and k.name in ("p", "div", "li"):
                out.append("\n")
    return out


def _span(node: Node, name: str) -> int:
    raw = node.attrs.get(name, "").strip()
    return max(int(raw), 1) if re.fullmatch(r"\+?[0-9]{1,9}", raw) else 1


def _page(node: Node, inherited: int | None) -> int | None:
    raw = node.attrs.get("data-page-number", "").strip()
    return int(raw) if re.fullmatch(r"\+?[0-9]+", raw) and int(raw) < 1 << 32 else inherited


def expand_rows(rows: list[list[tuple[Any, int, int, bool]]], empty: Any = "") -> list[list[tuple[Any, bool]]]:
    """Cells (content, colspan, rowspan, is header) as a full grid."""
    carried: dict[int, tuple[Any, int]] = {}
    grid: list[list[tuple[Any, bool]]] = []
    width = 0
    for row in rows:
        line: list[tuple[Any, bool]] = []

        def drop(column: int, line: list = line) -> None:
            text, left = carried.pop(column)
            line.append((text, False))
            if left > 1:
                carried[column] = (text, left - 1)

        for text, across, down, head in row:
            while len(line) in carried:
                drop(len(line))
            for _ in range(across):
                if down > 1:
                    carried[len(line)] = (text, down - 1)
                line.append((text, head))
        while len(line) in carried or (len(line) < width and carried and len(line) <= max(carried)):
            if len(line) in carried:
                drop(len(line))
            else:
                line.append((empty, False))
        width = max(width, len(line))
        grid.append(line)
    return [line + [(empty, False)] * (width - len(line)) for line in grid]


def split_header(texts: list[list[str]], heads: Sequence[bool]) -> tuple[list[str], list[list[str]]]:
    """The header row of a grid (heads: rows with a header cell) and the data rows below it."""
    empty = [not "".join(line).strip() for line in texts]
    rule = [not e and RULE.fullmatch("".join([t.strip() for t in line])) is not None for e, line in zip(empty, texts, strict=True)]
    at = next((i for i, head in enumerate(heads) if head and not empty[i]), None)
    if at is None:
        at = next((i for i in range(min(3, len(texts))) if not empty[i] and not rule[i]), 0 if texts else None)
    if at is None:
        return [], []
    return texts[at], [t for i, t in enumerate(texts) if i > at and not empty[i] and not rule[i]]


def _table(node: Node) -> tuple[list[tuple[int, ...]], list[list[int]], list[bool]]:
    """The cells of a table by their texts (the first is empty), its grid of cells, and
    which rows have a header cell."""
    cells: list[tuple[int, ...]] = [()]
    rows = []
    for part in node.kids:
        for tr in [part] if not isinstance(part, int) and part.name == "tr" else (part.kids if not isinstance(part, int) and part.name in ("thead", "tbody", "tfoot") else []):
            if not isinstance(tr, int) and tr.name == "tr":
                rows.append([])
                for c in tr.kids:
                    if not isinstance(c, int) and c.name in ("td", "th"):
                        cells.append(tuple(_all_text(c)))
                        rows[-1].append((len(cells) - 1, _span(c, "colspan"), _span(c, "rowspan"), c.name == "th"))
    grid = expand_rows(rows, 0)
    return cells, [[c for c, _ in line] for line in grid], [any(h for _, h in line) for line in grid]


def _program(root: Node, filled: list[bool]) -> tuple[tuple, int]:
    """Blocks (kind, page, content) in document order, their texts by number; and how
    many numbered sections there are. An explicit stack, as trees may be deep."""
    out: list[tuple[str, int | None, Any]] = []
    todo: list[tuple[Any, int | None]] = [(root, None)]
    some = lambda parts: any(isinstance(p, int) and filled[p] for p in parts)
    while todo:
        node, page = todo.pop()
        if isinstance(node, int):
            if filled[node]:
                out.append(("text", page, (node,)))
            continue
        if node.name in IGNORED:
            continue
        if node.name == "section":
            page = _page(node, page)
        if node.name in HEADS:
            if some(flow := _flow(node, True)):
                out.append(("heading", page, (HEADS[node.name], tuple(flow))))
            todo += [(k, page) for k in reversed(node.kids) if not isinstance(k, int) and k.name in BLOCK]
        elif node.name == "table":
            out.append(("table", page, _table(node)))
        elif node.name not in TABLE_PARTS and not any(not isinstance(k, int) and k.name in BLOCK for k in node.kids) and some(_all_text(node)):
            if some(flow := _flow(node, False)):
                out.append(("text", page, tuple(flow)))
        else:
            todo += [(k, page) for k in reversed(node.kids)]
    n, nodes = 0, [root]
    while nodes:
        x = nodes.pop()
        n += x.name == "section" and "data-page-number" in x.attrs
        nodes += [k for k in x.kids if not isinstance(k, int)]
    return tuple(out), n


def parse_html(text: str, parts: Collection[str] = PARTS) -> dict:
    blocks, numbered, texts = html_layout(text)
    flow = lambda ps: fragment(texts[ps[0]] if len(ps) == 1 else "".join([texts[p] if isinstance(p, int) else p for p in ps]))
    lines: list[str] = []
    pages: list[int | None] = []
    headings, tables, last = [], [], None
    for kind, page, content in blocks:
        if lines and lines[-1]:
            lines.append("")
            pages.append(page)
        start = len(lines) + 1
        if kind == "heading":
            last = flow(content[1])
            headings.append({"level": content[0], "text": last, "line": start})
            new = ["#" * content[0] + " " + last]
        elif kind == "text":
            new = flow(content).split("\n")
        else:
            cells, grid, heads = content
            made = [fragment(texts[c[0]] if len(c) == 1 else " ".join([texts[i] for i in c])) for c in cells]
            headers, rows = split_header([[made[c] for c in line] for line in grid], heads)
            new = [" | ".join(r) for r in ([headers] if headers else []) + rows]
            tables.append({"heading_ref": last, "index": len(tables), "start_line": start, "end_line": start + len(new) - 1, "page": page, "headers": headers, "rows": rows})
        lines += new
        pages += [page] * len(new)
    while lines and not lines[-1]:
        lines.pop()
        pages.pop()
    # a heading may hold line breaks; what follows sees the final lines
    normal = "\n".join(lines)
    return {"normalized": normal, "headings": headings, "sections": sections_of(split_lines(normal), headings, pages) if "sections" in parts else None, "tables": tables, "page_sections": numbered}


def view_of(kind: str | None, text: str | None, parts: Collection[str] = PARTS) -> dict | None:
    if text is None:
        return None
    if kind == "html":
        return parse_html(text, parts)
    if kind in ("markdown", "pdf"):
        return parse_markdown(text, parts)
    if kind == "text":
        return {"normalized": text, "headings": None, "sections": None, "tables": None, "page_sections": None}
    return None


def with_view(df: DataFrame, kind: str = "kind", text: str = "text", out: str = "view", parts: Collection[str] = tuple(PARTS)) -> DataFrame:
    """Adds the structured view of each text as a nested column, or some parts of it."""
    names = [p for p in PARTS if p in parts]

    @F.arrow_udf(f"struct<{','.join(f'{p}:{PARTS[p]}' for p in names)}>")
    def parse(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [view_of(k, t, names) or {} for k, t in zip(kinds.to_pylist(), texts.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r.get(p) for r in rows], ARROW[p]) for p in names], fields=[pa.field(p, ARROW[p]) for p in names])

    view = parse(F.col(kind), F.col(text))
    return df.withColumn(out, F.when(F.col(text).isNotNull(), view))


# The same by array functions


def native_headings(text: Column) -> Column:
    """Headings of a text whose lines are already normal: array of (level, text, line)."""
    at = F.transform(S.lines(text), lambda x, i: F.struct(x.alias("t"), (i + 1).cast("int").alias("line")))
    marked = F.transform(F.filter(at, lambda x: F.contains(x["t"], F.lit("#"))), lambda x: F.struct(S.trim(x["t"]).alias("t"), x["line"].alias("line")))
    found = F.filter(marked, lambda x: x["t"].rlike(r"^#{1,6}(?!#)"))
    return F.transform(
        found,
        lambda x: F.struct(F.length(F.regexp_extract(x["t"], "^(#+)", 1)).cast("int").alias("level"), S.trim(F.regexp_replace(x["t"], "^#+", "")).alias("text"), x["line"].alias("line")),
    )


def native_sections(headings: Column, line_count: Column) -> Column:
    """Line ranges: a preamble, and for each heading up to the next one not below it."""

    # from the last heading back: the next line of a heading of each level or a higher one
    def back(state: Column, h: Column) -> Column:
        return F.struct(
            F.concat(F.slice(state["next"], F.lit(1), h["level"] - 1), F.array_repeat(h["line"], 7 - h["level"])).alias("next"),
            F.array_append(state["ends"], F.element_at(state["next"], h["level"]) - 1).alias("ends"),
        )

    start = F.struct(F.array_repeat((line_count + 1).cast("int"), 6).alias("next"), F.array().cast("array<int>").alias("ends"))
    ends = F.aggregate(F.reverse(headings), start, back, lambda state: state["ends"])
    own = S.let(ends, lambda e: F.transform(headings, lambda h, i: F.struct(h["text"].alias("heading"), h["line"].alias("start_line"), F.element_at(e, F.size(e) - i).alias("end_line"))))
    first = F.when(F.size(headings) == 0, line_count).otherwise(F.try_element_at(headings, F.lit(1))["line"] - 1)
    preamble = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit(1).alias("start_line"), first.cast("int").alias("end_line")))
    return F.when((F.size(headings) == 0) | (first >= 1), F.concat(preamble, own)).otherwise(own)


def native_heading_above(headings: Column, line_count: Column) -> Column:
    """For each line the text of the heading at or above it, or null."""
    next_line = lambda i: F.coalesce(F.try_element_at(headings, (i + 2).cast("int"))["line"], line_count + 1)
    runs = F.transform(headings, lambda h, i: F.array_repeat(h["text"], (next_line(i) - h["line"]).cast("int")))
    first = F.coalesce(F.try_element_at(headings, F.lit(1))["line"] - 1, line_count).cast("int")
    return F.concat(F.array_repeat(F.lit(None).cast("string"), first), F.flatten(runs))


def native_squeeze(text: Column) -> Column:
    """Line ends trimmed, runs of blank lines as one."""
    keep = lambda t: F.filter(t, lambda x, i: (x != "") | (i == 0) | (F.try_element_at(t, i.cast("int")) != ""))
    return F.array_join(S.let(F.transform(S.lines(text), S.trim_end), keep), "\n")
