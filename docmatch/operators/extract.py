"""Content anchors of a matched document, and the hash over them.

Every anchor is a JSON text column, null where its target isn't there."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.blake3 import blake3_hex, blake3_many
from ..functions.regexlang import compile_python, error_of
from ..plans.definitions import Definition, Extract
from .assertions import Builder, parse_range, spans


class ExtractError(ValueError):
    """An extract that can't be made; it voids all extracts of its definition."""


def _need(e: Extract, key: str):
    if e.params.get(key) is None:
        raise ExtractError(f"extract section '{e.name}': {e.type} extract requires '{key}'")
    return e.params[key]


def _pattern(e: Extract, key: str) -> str:
    p = _need(e, key)
    if (bad := error_of(p)) is not None:
        raise ExtractError(f"extract section '{e.name}': invalid {key} regex: {bad}")
    return p


def extract_column(e: Extract) -> Column:
    make = {"range": _range, "section": _section, "table": _table, "text_match": _text_match}.get(e.type)
    if make is None:
        raise ExtractError(f"extract section '{e.name}': unsupported extract type '{e.type}'")
    return make(e)


def _range(e: Extract) -> Column:
    sheet, ref = _need(e, "sheet"), _need(e, "range")
    box = parse_range(ref)
    if box is None:
        raise ExtractError(f"extract section '{e.name}': invalid range reference '{ref}'")
    csv = F.col("kind") == "csv"
    grid = F.try_element_at(F.filter("sheets", lambda s: F.when(csv, S.ascii_lower(s["name"]) == sheet.lower()).otherwise(s["name"] == sheet)), F.lit(1))
    filled = lambda g: F.filter(Builder._range_rows(g, box), lambda cells: F.exists(cells, lambda x: x["value"].isNotNull()))
    n = S.let(grid, lambda g: F.when(g.isNotNull(), F.size(filled(g))))
    made = lambda n: F.when(n.isNotNull(), F.to_json(F.struct(F.lit(ref).alias("range"), n.alias("row_count"))))
    return F.when(F.col("kind").isin("csv", "xlsx"), S.let(n, made))


def _anchor(pattern: str) -> Column:
    return F.try_element_at(F.filter("view.headings", lambda h: S.matches(h["text"], pattern)), F.lit(1))


def _section(e: Extract) -> Column:
    heading = _anchor(_pattern(e, "anchor_heading"))
    section = F.try_element_at(F.filter("view.sections", lambda s: s["heading"]["line"] == heading["line"]), F.lit(1))
    return F.when(section.isNotNull(), F.to_json(F.struct(section["end_line"].alias("end_line"), heading["text"].alias("heading"), section["start_line"].alias("start_line"))))


def _table(e: Extract) -> Column:
    heading = _anchor(_pattern(e, "anchor_heading"))
    table = F.try_element_at(F.filter("view.tables", lambda t: t["heading_ref"] == heading["text"]), F.lit((e.params.get("index") or 0) + 1))
    made = F.to_json(F.struct(table["headers"].alias("columns"), table["end_line"].alias("end_line"), F.size(table["rows"]).alias("row_count"), table["start_line"].alias("start_line")))
    return F.when(table.isNotNull(), made)


def text_match(text: str, anchor, value, within: int) -> dict | None:
    """The first value within so many bytes of the first anchor."""
    a = next(iter(spans(text, anchor)), None)
    if a is None:
        return None
    for (start, end), m in zip(spans(text, value), value.finditer(text), strict=True):
        gap = start - a[1] if start >= a[1] else max(0, a[0] - end)
        if gap <= within:
            before = text[: m.start()]
            return {"char_offset": m.start() - (before.rfind("\n") + 1), "line": before.count("\n") + 1, "matched": m.group()}
    return None


def _text_match(e: Extract) -> Column:
    anchor, pattern, within = _pattern(e, "anchor"), _pattern(e, "pattern"), _need(e, "within_chars")

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        a, v = compile_python(anchor), compile_python(pattern)
        found = [text_match(t, a, v, within) if isinstance(t, str) else None for t in texts]
        return pd.Series([None if f is None else json.dumps(f, ensure_ascii=False, separators=(",", ":")) for f in found])

    return find(F.col("view.normalized"))


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def hash_body(extracted: dict[str, object], over: list[str]) -> bytes:
    """The named anchors in order (all, sorted, if none are named)."""
    body = bytearray()
    for name in over or sorted(extracted):
        body += name.encode() + b"\0"
        if name in extracted:
            text = canonical_json(extracted[name]).encode()
            body += b"\x01" + len(text).to_bytes(8, "little") + text
        else:
            body += b"\x02"
        body += b"\xff"
    return bytes(body)


def content_hash(extracted: dict[str, object], over: list[str]) -> str:
    """BLAKE3 over the anchors."""
    return "blake3:" + blake3_hex(hash_body(extracted, over))


def hash_udf(over: list[str]):
    """Of maps of anchors as JSON; those of a batch are hashed together."""

    @F.arrow_udf("string")
    def hashed(maps: pa.Array) -> pa.Array:
        bodies = [None if m is None else hash_body({k: json.loads(v) for k, v in m}, over) for m in maps.to_pylist()]
        made = iter(blake3_many([b for b in bodies if b is not None]))
        return pa.array([None if b is None else "blake3:" + next(made) for b in bodies], pa.string())

    return hashed


def extracted_map(d: Definition) -> Column | None:
    """Map of name to JSON with the anchors that are there; None without extracts."""
    if not d.extract:
        return None
    pairs = F.array(*[F.struct(F.lit(e.name).alias("key"), extract_column(e).alias("value")) for e in d.extract])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
