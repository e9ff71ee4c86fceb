"""Template definitions: model, loading, automatic names, validation, registry."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions.regexlang import error_of
from .refusals import Refusal

FORMATS = tuple("xlsx csv pdf html markdown text".split())

#: Assertion -> (required parameters, optional ones with defaults). A single parameter
#: named "" means that the assertion is written as a plain string.
KINDS: dict[str, tuple[dict[str, type], dict[str, Any]]] = {
    "filename_regex": ({"pattern": str}, {}),
    "sheet_exists": ({"": str}, {}),
    "sheet_name_regex": ({"pattern": str}, {"bind": None}),
    "cell_eq": ({"sheet": str, "cell": str, "value": str}, {}),
    "cell_regex": ({"sheet": str, "cell": str, "pattern": str}, {}),
    "range_non_null": ({"sheet": str, "range": str}, {}),
    "range_populated": ({"sheet": str, "range": str, "min_pct": float}, {}),
    "sheet_min_rows": ({"sheet": str, "min_rows": int}, {}),
    "column_search": ({"sheet": str, "column": str, "row_range": str, "pattern": str}, {}),
    "header_row_match": ({"sheet": str, "row_range": str, "min_match": int, "columns": list}, {}),
    "sum_eq": ({"range": str, "equals_cell": str, "tolerance": float}, {}),
    "within_tolerance": ({"cell": str, "min": float, "max": float}, {}),
    "heading_exists": ({"": str}, {}),
    "heading_regex": ({"pattern": str}, {}),
    "heading_level": ({"level": int, "pattern": str}, {}),
    "text_contains": ({"": str}, {}),
    "text_regex": ({"pattern": str}, {}),
    "text_near": ({"anchor": str, "pattern": str, "within_chars": int}, {}),
    "section_non_empty": ({"heading": str}, {}),
    "section_min_lines": ({"heading": str, "min_lines": int}, {}),
    "table_exists": ({"heading": str}, {"index": None}),
    "table_columns": ({"heading": str, "patterns": list}, {"index": None}),
    "table_shape": ({"heading": str, "min_columns": int, "column_types": list}, {"index": None}),
    "table_min_rows": ({"heading": str, "min_rows": int}, {"index": None}),
    "header_token_search": ({"tokens": list, "min_matches": int}, {"page": None, "index": None, "max_matches": None}),
    "dominant_column_count": ({"count": int, "tolerance": int}, {"sample_pages": 4}),
    "full_width_row": ({"pattern": str, "min_cells": int}, {}),
    "page_section_count": ({}, {"min": None, "max": None}),
    "page_count": ({}, {"min": None, "max": None}),
    "metadata_regex": ({"key": str, "pattern": str}, {}),
}
HTML_ONLY = ("header_token_search", "dominant_column_count", "full_width_row", "page_section_count")
#: Accepted in definitions, but never true unless the engine is told otherwise.
UNSUPPORTED = ("range_populated", "sum_eq", "within_tolerance")


class DefinitionError(ValueError):
    """A definition that can't be read; code is that of the compile refusal."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Assertion:
    kind: str
    params: dict[str, Any]
    name: str | None = None

    def __getitem__(self, key: str) -> Any:
        return self.params[key]


@dataclass
class Extract:
    name: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class Definition:
    template_id: str
    format: str
    assertions: list[Assertion]
    extract: list[Extract] = field(default_factory=list)
    valid_from: str | None = None
    valid_until: str | None = None
    parent: str | None = None
    hash_over: list[str] | None = None
    hash_algorithm: str | None = None
    crate: str = "docmatch"
    version: str = "0.1.0"
    source: str = "dsl"
    definition_hash: str | None = None


class CustomDefinition(Definition):
    """Base of templates that are written in code: a subclass says what its results are,
    as a column over the document's row (kind, path, view, sheets, pdf). They are an
    array of (name, passed, detail, context) in order, ``detail`` null where passed, and
    are registered, routed, trusted and reported like those of definition files."""

    def __init__(self, template_id: str, format: str, parent: str | None = None, source: str = "builtin:custom", **more: Any):
        super().__init__(template_id, format, [], parent=parent, source=source, **more)

    def results(self) -> Any:
        raise NotImplementedError(f"{type(self).__name__} gives no results")

    @staticmethod
    def result(name: str, passed: Any, detail: Any) -> Any:
        """One result: detail (text or column) is what is said where it isn't passed."""
        from pyspark.sql import functions as F

        ok = F.coalesce(passed, F.lit(False))
        said = F.when(~ok, F.lit(detail) if isinstance(detail, str) else detail)
        return F.struct(F.lit(name).alias("name"), ok.alias("passed"), said.alias("detail"), F.lit(None).cast("string").alias("context"))


def _need(data: dict, key: str, where: str) -> Any:
    if key not in data or data[key] is None:
        raise DefinitionError("E_MISSING_FIELD", f"{where}: missing field `{key}`")
    return data[key]


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def assertion_from(item: Any) -> Assertion:
    if not isinstance(item, dict):
        raise DefinitionError("E_INVALID_YAML", "an assertion must be a mapping")
    name = item.get("name")
    kinds = [k for k in item if k != "name"]
    if len(kinds) != 1 or kinds[0] not in KINDS:
        raise DefinitionError("E_UNKNOWN_ASSERTION", f"unknown assertion `{', '.join(map(str, kinds))}`")
    kind, body = kinds[0], item[kinds[0]]
    required, optional = KINDS[kind]
    if "" in required:
        if not isinstance(body, str):
            raise DefinitionError("E_INVALID_YAML", f"{kind} takes a string")
        return Assertion(kind, {"": body}, name)
    body = {} if body is None else body
    if not isinstance(body, dict):
        raise DefinitionError("E_INVALID_YAML", f"{kind} takes a mapping")
    params = {}
    for key, want in required.items():
        value = _need(body, key, kind)
        if want in (int, float) and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise DefinitionError("E_INVALID_YAML", f"{kind}.{key} must be a number")
        if want is list and not isinstance(value, list):
            raise DefinitionError("E_INVALID_YAML", f"{kind}.{key} must be a list")
        if want is str and not isinstance(value, str):
            raise DefinitionError("E_INVALID_YAML", f"{kind}.{key} must be a string")
        params[key] = value
    params |= {key: body.get(key, default) for key, default in optional.items()}
    return Assertion(kind, params, name)


def definition_from(data: Any) -> Definition:
    if not isinstance(data, dict):
        raise DefinitionError("E_INVALID_YAML", "a definition must be a mapping")
    named = [k for k in data if isinstance(k, str) and k.endswith("_id")]
    if "template_id" not in data and len(named) == 1:  # files of other tools call it otherwise
        data = {"template_id": data[named[0]]} | data
    extracts = []
    for e in data.get("extract") or []:
        extracts.append(Extract(_need(e, "name", "extract"), _need(e, "type", "extract"), {k: v for k, v in e.items() if k not in ("name", "type")}))
    hashed = data.get("content_hash")
    d = Definition(
        _need(data, "template_id", "definition"), _need(data, "format", "definition"), [assertion_from(a) for a in _need(data, "assertions", "definition")],
        extracts, data.get("valid_from"), data.get("valid_until"), data.get("parent"),
        None if hashed is None else list(hashed.get("over") or []), None if hashed is None else _need(hashed, "algorithm", "content_hash"),
    )
    auto_name(d.assertions)
    return d


def load_text(text: str) -> Definition:
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise DefinitionError("E_INVALID_YAML", str(e)) from e
    return definition_from(data)


def load(path: str | Path) -> Definition:
    return load_text(Path(path).read_text(encoding="utf-8"))


# Names of assertions that have none of their own


def literal_excerpt(value: str, limit: int = 20, lower: bool = True) -> str:
    value = re.sub(r"[A-Z]", lambda m: m[0].lower(), value) if lower else value
    cut = re.sub(r"[^A-Za-z0-9]+", "_", value).strip("_")
    return cut[:limit].strip("_") if cut else "value"


def regex_excerpt(pattern: str, limit: int = 20) -> str:
    """Without flags and escapes; a class counts as a separator before its content."""
    for flag in "imsx":
        pattern = pattern.replace(f"(?{flag})", "")
    out, inside = [], False
    for c in pattern:
        if c == "[":
            inside = True
            out.append("_")
        elif c == "]":
            inside = False
        elif c != "\\" or inside:
            out.append(c)
    return literal_excerpt("".join(out), limit)


#: What each kind's automatic name is made of: r = pattern excerpt, t = text excerpt in
#: lower case, v = excerpt as it is, i = index or 0, n = number, h = number after an h.
_NAME_PARTS = {
    "filename_regex": "r:pattern", "sheet_exists": "v:", "sheet_name_regex": "r:pattern", "cell_eq": "v:sheet v:cell", "cell_regex": "v:sheet v:cell", "range_non_null": "v:sheet v:range",
    "range_populated": "v:sheet v:range", "sheet_min_rows": "v:sheet", "column_search": "v:sheet v:column", "header_row_match": "v:sheet", "sum_eq": "v:range v:equals_cell", "within_tolerance": "v:cell",
    "heading_exists": "t:", "heading_regex": "r:pattern", "heading_level": "h:level r:pattern", "text_contains": "t:", "text_regex": "r:pattern", "text_near": "r:anchor", "section_non_empty": "r:heading",
    "section_min_lines": "r:heading", "table_exists": "r:heading i:index", "table_columns": "r:heading i:index", "table_shape": "r:heading i:index", "table_min_rows": "r:heading i:index",
    "header_token_search": "f:tokens", "dominant_column_count": "n:count", "full_width_row": "r:pattern", "page_section_count": "", "page_count": "", "metadata_regex": "v:key",
}


def base_name(a: Assertion) -> str:
    make = {
        "r": regex_excerpt, "t": literal_excerpt, "v": lambda x: literal_excerpt(x, 20, False), "i": lambda x: str(x or 0), "n": str, "h": lambda x: f"h{x}",
        "f": lambda x: regex_excerpt(x[0]) if x else "token",
    }
    parts = [p.split(":") for p in _NAME_PARTS[a.kind].split()]
    return "__".join([a.kind, *(make[how](a[key]) for how, key in parts)])


def auto_name(assertions: list[Assertion]) -> None:
    seen: dict[str, int] = {}
    for a in assertions:
        base = a.name if a.name is not None else base_name(a)
        n = seen.get(base, 0)
        if a.name is None:
            a.name = f"{base}__{n}" if n else base
        seen[base] = n + 1


# Validation of a definition that was read


def validate(d: Definition) -> list[str]:
    """What is wrong with it; empty if nothing is."""
    wrong = []
    if d.format not in (*FORMATS, "md"):
        wrong.append(f"unsupported format '{d.format}'")
    if not d.template_id.strip():
        wrong.append("template_id is empty")
    if not d.assertions:
        wrong.append("assertions are empty")
    for i, a in enumerate(d.assertions):
        at = f"assertions[{i}] ({a.kind})"
        if a.kind in HTML_ONLY and d.format != "html":
            wrong.append(f"{at}: requires format html")
        for low, high in (("min", "max"), ("min_matches", "max_matches")):
            lo, hi = a.params.get(low), a.params.get(high)
            if lo is not None and hi is not None and hi < lo:
                wrong.append(f"{at}: {high} is less than {low}")
        if a.kind in ("page_section_count", "page_count") and a["min"] is None and a["max"] is None:
            wrong.append(f"{at}: needs min or max")
        if a.kind == "header_token_search" and not a["tokens"]:
            wrong.append(f"{at}: needs a token")
        if a.kind == "dominant_column_count" and (a["sample_pages"] or 0) < 1:
            wrong.append(f"{at}: sample_pages must be at least 1")
        if a.kind == "full_width_row" and a["min_cells"] < 1:
            wrong.append(f"{at}: min_cells must be at least 1")
        if a.kind == "heading_level" and not 1 <= a["level"] <= 6:
            wrong.append(f"{at}: level must be from 1 to 6")
        for p in patterns_of(a):
            if (e := error_of(p)) is not None:
                wrong.append(f"{at}: invalid regex '{p}': {e}")
    needs = {"range": ("sheet", "range"), "section": ("anchor_heading",), "table": ("anchor_heading",), "text_match": ("anchor", "pattern", "within_chars")}
    names = set()
    for e in d.extract:
        if e.type not in needs:
            wrong.append(f"extract '{e.name}': unsupported type '{e.type}'")
        wrong += [f"extract '{e.name}': {e.type} requires '{k}'" for k in needs.get(e.type, ()) if e.params.get(k) is None]
        if e.name in names:
            wrong.append(f"extract '{e.name}' is repeated")
        names.add(e.name)
    if d.hash_over is not None:
        if d.hash_algorithm != "blake3":
            wrong.append(f"unsupported hash algorithm '{d.hash_algorithm}'")
        wrong += [f"content_hash refers to unknown extract '{n}'" for n in d.hash_over if n not in names]
    return wrong


def patterns_of(a: Assertion) -> list[str]:
    found = [a.params[k] for k in ("pattern", "heading", "anchor") if isinstance(a.params.get(k), str)]
    return found + [p for k in ("patterns", "tokens") for p in a.params.get(k, [])] + [c["pattern"] for c in a.params.get("columns", [])]


def _object(required: list[str], **properties: dict) -> dict:
    return dict(type="object", additionalProperties=False, required=required, properties=properties)


def json_schema() -> dict:
    """JSON Schema of a definition file."""
    text, whole, listed = dict(type="string"), dict(type="integer", minimum=0), dict(type="array")
    types = {str: text, int: whole, float: dict(type="number"), list: listed}
    options = []
    for kind, (required, optional) in KINDS.items():
        if "" in required:
            body = text
        else:
            more = {k: dict(type=["string" if k == "bind" else "integer", "null"]) for k in optional}
            body = _object(list(required), **{k: types[t] for k, t in required.items()}, **more)
        note = dict(description="not evaluated in this version") if kind in UNSUPPORTED else {}
        options.append(_object([kind], name=text, **{kind: body}) | note)
    strings = listed | dict(items=text)
    fields = {k: whole if k in ("index", "within_chars") else text for k in ("name", "type", "anchor_heading", "index", "anchor", "pattern", "within_chars", "sheet", "range")}
    hashed = _object(["algorithm", "over"], algorithm=dict(enum=["blake3"]), over=strings)
    plain = dict.fromkeys(("template_id", "valid_from", "valid_until", "parent"), text)
    lists = dict(assertions=listed | dict(items=dict(oneOf=options)), extract=listed | dict(items=_object(["name", "type"], **fields)))
    whole_file = _object(["template_id", "format", "assertions"], format=dict(enum=list(FORMATS)), content_hash=hashed, **plain, **lists)
    return {"$schema": "http://json-schema.org/draft-07/schema#"} | whole_file


# Registry


class Registry:
    """Definitions by id, from built-in and installed ones."""

    def __init__(self, definitions: list[Definition] | None = None, builtins: bool = True):
        self.items: list[Definition] = (builtin_definitions() if builtins else []) + list(definitions or [])

    def register(self, d: Definition) -> None:
        self.items.append(d)

    def get(self, template_id: str) -> Definition | None:
        return next((d for d in self.items if d.template_id == template_id), None)

    def listing(self) -> list[Definition]:
        return sorted(self.items, key=lambda d: (d.template_id, d.source))

    def check(self, trust: list[str]) -> None:
        """Refuses repeated ids and untrusted sources, the first in order of listing."""
        rows = self.listing()
        for a, b in zip(rows, rows[1:], strict=False):
            if a.template_id == b.template_id:
                raise Refusal("E_DUPLICATE_FP_ID", f"'{a.template_id}' is defined more than once", {"template_id": a.template_id, "providers": [a.source, b.source]})
        for d in rows:
            if not trusted(d.source, trust):
                raise Refusal("E_UNTRUSTED_FP", f"'{d.template_id}' comes from '{d.source}', which isn't allowed", {"template_id": d.template_id, "provider": d.source})

    def select(self, ids: list[str]) -> list[Definition]:
        """The requested definitions in order; refuses unknown ids, then children whose
        parent isn't requested."""
        for i in ids:
            if self.get(i) is None:
                raise Refusal("E_UNKNOWN_FP", f"'{i}' isn't known", {"template_id": i, "available": [d.template_id for d in self.listing()]})
        found = [self.get(i) for i in ids]
        for d in found:
            if d.parent is not None and d.parent not in ids:
                raise Refusal("E_ORPHAN_CHILD", f"'{d.template_id}' needs its parent '{d.parent}' to be requested", {"child": d.template_id, "parent": d.parent})
        return found


def trusted(source: str, allowed: list[str]) -> bool:
    if source.startswith("builtin"):
        return True
    return any(source.startswith(a[:-1]) if a.endswith("*") else source == a for a in allowed)


def builtin_definitions() -> list[Definition]:
    """Format tests; the one of markdown also wants a heading."""
    made = [Definition(f"{f}.v0", f, [Assertion("format", {"format": f}, f"format_{f}")], source="builtin") for f in ("csv", "xlsx", "pdf")]
    made.append(Definition("markdown.v0", "markdown", [Assertion("format", {"format": "markdown"}, "format_markdown"), Assertion("heading_regex", {"pattern": ""}, "has_heading")], source="builtin"))
    return made


def scan_definitions(folder: str | Path) -> tuple[list[Definition], list[str]]:
    """All ``*.fp.yaml`` and ``*.fp.yml`` of a folder, and warnings on unreadable ones."""
    from ..functions.blake3 import blake3_hex

    found, warnings = [], []
    if not os.path.isdir(folder):
        return found, warnings
    for name in sorted(os.listdir(folder)):
        if re.search(r"\.fp\.ya?ml$", name):
            try:
                text = Path(folder, name).read_text(encoding="utf-8")
                d = load_text(text)
            except (DefinitionError, OSError, UnicodeDecodeError) as e:
                warnings.append(f"{name}: {e}")
                continue
            d.source = f"installed:{d.template_id}"
            d.definition_hash = "blake3:" + blake3_hex(text.encode())
            found.append(d)
    return found, warnings


def scan_trust(*paths: str | Path) -> list[str]:
    """The allow-lists of all files that exist, one after the other."""
    out: list[str] = []
    for p in paths:
        if os.path.exists(p):
            data = yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}
            out += list((data.get("trust") or data.get("allow") or []) if isinstance(data, dict) else data)
    return out
