"""Learning of definitions from example corpora and from known field values.

Observations are one row per document; supports are grouped counts over them. What
comes back to the driver is the candidates, whose number the schema of the documents
bounds, not the documents."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.regexlang import escape
from ..plans.definitions import Assertion
from . import assertions as A
from . import hybrid

EXTENSIONS = {"xlsx": ("xlsx", "xls"), "csv": ("csv",), "pdf": ("pdf",), "html": ("html", "htm")}
GENERIC = tuple("security|portfolio company|metric|issuer|fair value|cost|amount".split("|"))
EPSILON = 2.220446049250313e-16


class LearnError(ValueError):
    """Nothing could be learned."""


@dataclass
class Candidate:
    assertion: Assertion
    support: int
    total: int = 0

    @property
    def confidence(self) -> float:
        return self.support / self.total


# Observation: columns of the document's row


def observe(docs: DataFrame, format: str) -> DataFrame:
    """docs: path, kind, view, sheets, pdf, error. One row per readable document with
    ``ord`` (its path, which orders the corpus) and the facts of its format."""
    good = docs.where(F.col("error").isNull() & (F.col("kind") == ("xlsx" if format == "xlsx" else format)))
    if format == "pdf":
        good = good.where(F.col("pdf.error").isNull())
    base = good.withColumn("extension", S.extension(F.col("path"))).withColumn("ord", F.col("path"))
    keep = ["ord", "path", "extension"]
    filled = lambda rows: F.size(F.filter(rows, lambda r: F.exists(r, lambda v: ~S.blank(v)))).cast("long")
    if format == "xlsx":
        cells = [("A1", 0, 0), ("B1", 0, 1), ("A2", 1, 0), ("B2", 1, 1)]
        corner = lambda s: F.filter(F.array(*[F.struct(s["name"].alias("sheet"), F.lit(n).alias("cell"), A.Builder._cell(s, r, c).alias("value")) for n, r, c in cells]), lambda x: x["value"].isNotNull())
        return base.select(*keep, F.sort_array(F.transform("sheets", lambda s: F.struct(s["name"].alias("name"), filled(s["rows"]).alias("rows")))).alias("sheets"), F.flatten(F.transform("sheets", corner)).alias("cells"))
    if format == "csv":
        rows = F.try_element_at("sheets", F.lit(1))["rows"]
        width = F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r))))
        data = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        return base.where(width <= 1).select(*keep, F.try_element_at(rows, F.lit(1)).alias("headers"), filled(data).alias("rows"))
    if format == "pdf":
        return base.select(*keep, F.col("pdf.page_count").alias("page_count"), F.filter("pdf.info", lambda e: ~S.blank(e["value"])).alias("info"))
    tables = F.transform(
        "view.tables",
        lambda t, i: F.struct(
            t["page"].alias("page"), A.table_width(t).alias("columns"), F.filter(F.transform(t["headers"], S.scalar_text), lambda h: h != "").alias("headers"),
            i.alias("pos"),
        ),
    )
    # a column of its own, as next to nothing asks for it
    full_rows = F.transform("view.tables", lambda t: F.filter(F.transform(t["rows"], full_row), lambda x: x.isNotNull()))
    return base.select(*keep, F.transform("view.headings", lambda h: h["text"]).alias("headings"), F.col("view.page_sections").cast("long").alias("page_sections"), page_local(tables).alias("tables"), full_rows.alias("full_rows"))


def full_row(row: Column) -> Column:
    """The one text of a row whose filled cells are all alike, if it spans two cells."""
    texts = F.filter(F.transform(row, S.scalar_text), lambda x: x != "")
    return F.when((F.size(row) > 1) & (F.size(F.array_distinct(texts)) == 1), F.try_element_at(texts, F.lit(1)))


def page_local(tables: Column) -> Column:
    """Adds the index of a table among those of its page."""

    def placed(all_: Column) -> Column:
        before = lambda t: F.filter(all_, lambda x: x["page"].eqNullSafe(t["page"]) & (x["pos"] < t["pos"]))
        return F.transform(all_, lambda t: F.struct(t["page"].alias("page"), t["columns"].alias("columns"), t["headers"].alias("headers"), F.size(before(t)).alias("page_index"), t["pos"].alias("pos")))

    return S.let(tables, placed)


# Supports


def support(observed: DataFrame, items: Column, *keys: str) -> DataFrame:
    """Documents that have each distinct item (a struct column is flattened)."""
    x = observed.select("ord", F.explode(F.array_distinct(items)).alias("x"))
    cols = [F.col(f"x.{k}").alias(k) for k in keys] if keys else [F.col("x").alias("item")]
    names = list(keys) if keys else ["item"]
    return x.select(*cols).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def dominant_largest(values: Column) -> Column:
    """The most frequent number; of several the largest."""
    counted = F.transform(F.array_distinct(values), lambda w: F.struct(F.size(F.filter(values, lambda x: x == w)).alias("n"), w.alias("w")))
    return F.array_max(counted)["w"]


def candidates(observed: DataFrame, format: str, total: int | None, least: float = 0.0, kinds: Collection[str] | None = None) -> list[Candidate]:
    """Facts in at least the share ``least`` of the documents: rarer ones aren't
    collected, so the driver gets at most their number per document divided by it.
    HTML facts can be limited to some kinds of assertions, and are counted with their
    total (None) in the pass that counts them."""
    out: list[Candidate] = []
    common_ones = lambda df: df.where(F.col("n") / F.lit(total) + F.lit(EPSILON) >= F.lit(float(least))).collect()
    add = lambda kind, n, **p: out.append(Candidate(Assertion(kind, {("" if k == "text" else k): v for k, v in p.items()}), int(n), total))
    if format == "xlsx":
        seen = {r[0] for r in observed.select(F.lower("extension")).distinct().collect()} & {"xls", "xlsx"}
        add("filename_regex", total, pattern={("xls",): r"(?i).*\.xls$", ("xls", "xlsx"): r"(?i).*\.xls(x)?$"}.get(tuple(sorted(seen)), r"(?i).*\.xlsx$"))
        for r in common_ones(support(observed, F.transform("sheets", lambda s: s["name"]))):
            add("sheet_exists", r["n"], text=r["item"])
        for r in common_ones(observed.select(F.explode("sheets").alias("s")).groupBy("s.name").agg(F.min("s.rows").alias("low"), F.count(F.lit(1)).alias("n"))):
            add("sheet_min_rows", r["n"], sheet=r["name"], min_rows=int(r["low"]))
        for r in common_ones(support(observed, F.col("cells"), "sheet", "cell", "value")):
            add("cell_eq", r["n"], sheet=r["sheet"], cell=r["cell"], value=r["value"])
    elif format == "csv":
        add("filename_regex", total, pattern=r"(?i).*\.csv$")
        add("sheet_exists", total, text="Sheet1")
        low = observed.agg(F.min("rows")).first()[0]
        if low is not None:
            add("sheet_min_rows", total, sheet="Sheet1", min_rows=int(low))
        heads = F.filter(F.transform("headers", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: ~S.blank(x["h"]))
        for r in common_ones(support(observed, heads, "i", "h")):
            add("cell_eq", r["n"], sheet="Sheet1", cell=A.cell_name(0, r["i"]), value=r["h"])
    elif format == "pdf":
        add("filename_regex", total, pattern=r"(?i).*\.pdf$")
        pages = observed.agg(F.min("page_count").alias("lo"), F.max("page_count").alias("hi"), F.count("page_count").alias("n")).first()
        if pages["n"]:
            add("page_count", pages["n"], min=int(pages["lo"]), max=int(pages["hi"]))
        for r in common_ones(support(observed, F.col("info"), "key", "value")):
            add("metadata_regex", r["n"], key=r["key"], pattern=f"^{escape(r['value'])}$")
    else:
        counted = html_facts(observed, kinds).persist()  # read by every support
        try:
            if total is None:
                total = int(counted.agg(F.sum("n")).first()[0] or 0)
            _html_candidates(observed, counted, add, total, kinds)
        finally:
            counted.unpersist()
    return out


def first_headings(observed: DataFrame) -> DataFrame:
    """How many documents begin with each heading, the most common first, then by text."""
    first = observed.select(F.try_element_at("headings", F.lit(1)).alias("h")).where("h is not null")
    return first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h")


def width_mode(widths: DataFrame, documents: Column | None = None) -> DataFrame:
    """widths: w of one document, or of so many. One row: ``w`` (the most frequent, of
    several the largest), ``tolerance`` (the largest distance from it) and ``n`` documents."""
    counts = widths.where("w is not null").groupBy("w").agg(F.sum(F.lit(1) if documents is None else documents).alias("n"))
    one = counts.agg(F.max(F.struct("n", "w"))["w"].alias("w"), F.max("w").alias("hi"), F.min("w").alias("lo"), F.sum("n").alias("n"))
    return one.select("w", F.greatest(F.col("hi") - F.col("w"), F.col("w") - F.col("lo")).alias("tolerance"), "n")


def html_facts(observed: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """The facts of HTML documents that these kinds need (null for others), each
    combination once with its documents ``n`` and the first of them, ``ord``: one pass
    over the documents, whatever is asked of it."""
    only = lambda kind, column, type_: (column if _wants(kinds, kind) else F.lit(None)).cast(type_)
    sections = "dominant_column_count" if _wants(kinds, "dominant_column_count") else "page_section_count"
    widths = F.filter(F.transform("tables", lambda t: t["columns"]), lambda w: w > 0)
    # the table with most telling headers of each document
    telling = lambda t: F.filter(t["headers"], lambda h: ~S.ascii_lower(S.trim(h)).isin(*GENERIC))
    told = F.transform("tables", lambda t: F.struct(telling(t).alias("tokens"), t.alias("t")))
    best = F.array_max(F.filter(F.transform(told, lambda x: F.struct(F.size(x["tokens"]).alias("n"), F.coalesce(x["t"]["page"], F.lit(-1)).alias("page"), x["t"]["columns"].alias("c"), (-x["t"]["page_index"]).alias("less"), x["t"]["pos"].alias("pos"), x["tokens"].alias("tokens"))), lambda x: x["n"] > 0))
    facts = observed.select(
        "ord", only("heading_exists", F.try_element_at("headings", F.lit(1)), "string").alias("h"), only(sections, F.col("page_sections"), "long").alias("page_sections"),
        only("dominant_column_count", S.let(widths, dominant_largest), "int").alias("w"), only("header_token_search", best, "struct<n:int,page:int,c:int,less:int,pos:int,tokens:array<string>>").alias("b"),
    )
    facts = facts.select("ord", "h", "page_sections", "w", "b.page", (-F.col("b.less")).alias("index"), "b.tokens")
    return facts.groupBy("h", "page_sections", "w", "page", "index", "tokens").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))


def _wants(kinds: Collection[str] | None, kind: str) -> bool:
    return kinds is None or kind in kinds


def _html_candidates(observed: DataFrame, counted: DataFrame, add, total: int, kinds: Collection[str] | None) -> None:
    if _wants(kinds, "filename_regex"):
        add("filename_regex", total, pattern=r"(?i).*\.html?$")
    if _wants(kinds, "heading_exists"):
        first = counted.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").first()
        if first:
            add("heading_exists", first["n"], text=first["h"])
    if _wants(kinds, "page_section_count"):
        pages = counted.where("page_sections > 0").agg(F.min("page_sections").alias("lo"), F.max("page_sections").alias("hi"), F.sum("n").alias("n")).first()
        if pages["n"]:
            add("page_section_count", pages["n"], min=int(pages["lo"]), max=int(pages["hi"]))
    mode = width_mode(counted, F.col("n")).first() if _wants(kinds, "dominant_column_count") else None
    if mode and mode["w"] is not None:
        sample = counted.agg(F.max("page_sections")).first()[0]
        add("dominant_column_count", mode["n"], count=mode["w"], tolerance=mode["tolerance"], sample_pages=int(sample if sample is not None else 1))
    if _wants(kinds, "header_token_search"):
        # the modal place of the tables chosen, and the headers most have there
        b = counted.where("tokens is not null")
        place = b.groupBy("page", "index").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("page"), F.desc("index")).first()
        if place:
            mine = b.where((F.col("page") == place["page"]) & (F.col("index") == place["index"]))
            counts = mine.select("n", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.sum("n").alias("n"))
            exemplar = mine.agg(F.min(F.struct("ord", "tokens"))["tokens"]).first()[0]
            most = counts.agg(F.max("n").alias("top"))
            common = {r["t"] for r in counts.where(F.col("t").isin(exemplar)).join(F.broadcast(most), F.col("n") == F.col("top")).select("t").collect()}
            tokens = [t for t in exemplar if t in common][:2]
            add("header_token_search", place["n"], page=None if place["page"] < 0 else place["page"], index=place["index"], tokens=[f"(?i){escape(t)}" for t in tokens], min_matches=len(tokens), max_matches=None)
    if not _wants(kinds, "full_width_row"):
        return
    tables = F.transform("tables", lambda t, i: F.struct(t["columns"].alias("columns"), F.try_element_at("full_rows", i + 1).alias("full_rows")))
    rows = observed.select("ord", F.posexplode(tables).alias("ti", "t")).select("ord", "ti", "t.columns", F.posexplode_outer("t.full_rows").alias("ri", "row"))
    widest = rows.agg(F.max("columns")).first()[0]
    per_row = rows.where("row is not null").groupBy("row").agg(F.count_distinct("ord").alias("n"), F.min(F.struct("ord", "ti", "ri")).alias("seen"))
    top = per_row.agg(F.max("n")).first()[0]
    if top and widest:
        found = [r["row"] for r in per_row.where(F.col("n") == top).orderBy("seen").limit(2).collect()]
        add("full_width_row", top, pattern=f"(?i)^({'|'.join(map(escape, found))})$", min_cells=int(widest))


def sort_key(a: Assertion) -> str:
    p = a.params
    some = lambda x: "None" if x is None else f"Some({x})"
    quoted = lambda xs: "[" + ", ".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in xs) + "]"
    return {
        "filename_regex": lambda: f"00_filename_regex:{p['pattern']}", "sheet_exists": lambda: f"10_sheet_exists:{p['']}", "sheet_min_rows": lambda: f"11_sheet_min_rows:{p['sheet']}:{p['min_rows']}",
        "cell_eq": lambda: f"12_cell_eq:{p['sheet']}:{p['cell']}:{p['value']}", "heading_exists": lambda: f"13_heading_exists:{p['']}", "page_count": lambda: f"20_page_count:{some(p['min'])}:{some(p['max'])}",
        "header_token_search": lambda: f"21_header_token_search:{some(p['page'])}:{some(p['index'])}:{quoted(p['tokens'])}", "dominant_column_count": lambda: f"22_dominant_column_count:{p['count']}:{p['tolerance']}:{p['sample_pages']}",
        "full_width_row": lambda: f"23_full_width_row:{p['pattern']}:{p['min_cells']}", "page_section_count": lambda: f"24_page_section_count:{some(p['min'])}:{some(p['max'])}", "metadata_regex": lambda: f"30_metadata_regex:{p['key']}:{p['pattern']}",
    }.get(a.kind, lambda: f"99_other:{a.kind}")()


def support_query(a: Assertion) -> str | None:
    literal = lambda x: re.sub(r"^\^+|\$+$", "", x).replace("\\", "")
    make = {
        "sheet_exists": lambda: a[""], "sheet_min_rows": lambda: a["sheet"], "cell_eq": lambda: a["value"], "heading_exists": lambda: a[""],
        "header_token_search": lambda: " ".join(map(literal, a["tokens"])), "full_width_row": lambda: literal(a["pattern"]), "metadata_regex": lambda: literal(a["pattern"]),
    }
    return make[a.kind]() if a.kind in make else None


def from_documents(docs: DataFrame, format: str, template_id: str, min_confidence: float = 0.9, with_extract: bool = True, calibrate: DataFrame | None = None) -> dict:
    """A definition with the confidence of each assertion. calibrate: doc_id, text; a
    support is raised to the number of documents that a search for it finds."""
    format = format.lower()
    if format not in EXTENSIONS:
        raise LearnError(f"unsupported infer format '{format}' (xlsx, csv, pdf or html)")
    if not 0.0 <= min_confidence <= 1.0:
        raise LearnError(f"min_confidence must be within [0, 1], not {min_confidence}")
    observed = observe(docs, format).persist()  # small facts; read by every support
    total = observed.count()
    if not total:
        raise LearnError("no document could be read")
    found = sorted(candidates(observed, format, total, 0.0 if calibrate is not None else min_confidence), key=lambda c: sort_key(c.assertion).encode())
    if calibrate is not None:
        for c in found:
            q = support_query(c.assertion)
            if q is not None and len(q.strip()) >= 2 and c.support < total:
                c.support = min(total, max(c.support, hybrid.support(calibrate, q)))
    kept = [c for c in found if c.confidence + EPSILON >= min_confidence]
    if not kept:
        raise LearnError(f"no assertion reached a confidence of {min_confidence:.2f}")
    if format == "html" and all(c.assertion.kind in ("filename_regex", "heading_exists") for c in kept):
        raise LearnError("the html corpus shows no stable structure: no page sections, table headers or full-width rows in common")
    extract = suggested(observed, format) if with_extract else []
    return {"template_id": template_id, "format": format, "assertions": kept, "extract": extract, "hash_over": [e["name"] for e in extract]}


def suggested(observed: DataFrame, format: str) -> list[dict[str, Any]]:
    grid = lambda name, sheet: [{"name": name, "type": "range", "sheet": sheet, "range": "A1:D20"}]
    if format == "xlsx":
        sheet = observed.select(F.explode("sheets").alias("s")).agg(F.min("s.name")).first()[0]
        return grid("primary_range", sheet) if sheet is not None else []
    if format == "csv":
        return grid("primary_rows", "Sheet1")
    if format == "html":
        first = observed.where(F.size("headings") > 0).orderBy("ord").select(F.try_element_at("headings", F.lit(1))).first()
        if first:
            anchor = f"(?i){escape(first[0])}"
            return [{"name": "primary_table", "type": "table", "anchor_heading": anchor, "index": 0}, {"name": "primary_section", "type": "section", "anchor_heading": anchor}]
    return []


def quote(value: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9.-]+", value):
        return value
    return "'" + value.replace("'", "''") + "'"


def assertion_data(a: Assertion) -> dict:
    body = a.params[""] if "" in a.params else dict(a.params)
    return ({"name": a.name} if a.name else {}) | {a.kind: body}


def emit_yaml(profile: dict) -> str:
    """The definition file, each learned assertion under a comment with its confidence."""
    out = [f"template_id: {quote(profile['template_id'])}", f"format: {quote(profile['format'])}", "assertions:"]

    def item(data: Any, indent: str) -> None:
        for i, line in enumerate(yaml.safe_dump(data, sort_keys=False, allow_unicode=True, width=10**9).rstrip().split("\n")):
            out.append(f"{indent}{'- ' if i == 0 else '  '}{line}")

    for c in profile["assertions"]:
        if isinstance(c, Candidate):
            out.append(f"  # confidence: {c.confidence:.3f} ({c.support}/{c.total})")
        item(assertion_data(c.assertion if isinstance(c, Candidate) else c), "  ")
    if profile["extract"]:
        out.append("extract:")
        for e in profile["extract"]:
            item(e, "")
    if profile["hash_over"]:
        out += ["content_hash:", "  algorithm: blake3", "  over:", *[f"    - {quote(n)}" for n in profile["hash_over"]]]
    return "\n".join(out) + "\n"


# From known field values of one document


def load_fields(text: str) -> list[dict]:
    data = yaml.safe_load(text)
    if not isinstance(data, list) or not data:
        raise LearnError("fields must be a list of name and value")
    for f in data:
        if not isinstance(f, dict) or not str(f.get("name") or "").strip() or not str(f.get("value") or "").strip():
            raise LearnError("each field needs a name and a value")
    return [{"name": str(f["name"]), "value": str(f["value"])} for f in data]


def sanitise(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "field"


def line_table(spark: SparkSession, view: dict) -> DataFrame:
    """Lines with their nearest heading above, as search documents."""
    rows = [(i, x) for i, x in enumerate((view["normalized"] or "").split("\n"), 1)]
    heads = [(h["line"], h["text"]) for h in view["headings"] or []]
    lines = spark.createDataFrame(rows, "line long, text string")
    marked = lines.join(spark.createDataFrame(heads, "line long, heading string"), "line", "left")
    above = F.last("heading", ignorenulls=True).over(Window.orderBy("line"))
    return marked.withColumn("heading", above)


def from_fields(spark: SparkSession, view: dict, format: str, fields: list[dict], template_id: str) -> tuple[dict, list[str]]:
    """The definition that locates the fields, and the names of those not found."""
    lines = line_table(spark, view)
    docs = lines.select(F.col("line").alias("doc_id"), F.concat_ws("\n", "heading", "text").alias("text"), F.col("text").alias("body"), "heading")
    assertions, extract, missing = [], [], []
    for f in fields:
        low = f["value"].lower()
        has = docs.where(F.contains(F.lower("body"), F.lit(low)))
        hits = hybrid.search(docs.select("doc_id", "text"), f["value"], 5).select(F.col("id").alias("doc_id"), "fused")
        row = hits.join(has, "doc_id").orderBy(F.desc("fused"), "doc_id").first() or has.orderBy("doc_id").first()
        if row is None:
            missing.append(f["name"])
            continue
        name, pattern, heading = sanitise(f["name"]), escape(f["value"]), row["heading"]
        if heading is not None:
            a = Assertion("text_near", {"anchor": f"(?i){escape(heading)}", "pattern": pattern, "within_chars": 400}, f"field_{name}")
        else:
            a = Assertion("text_contains", {"": f["value"]}, f"field_{name}")
        assertions.append(a)
        extract.append({"name": name, "type": "text_match"} | ({"anchor": f"(?i){escape(heading)}"} if heading is not None else {}) | {"pattern": pattern, "within_chars": 400})
    if not assertions:
        raise LearnError("none of the fields was found in the document")
    return {"template_id": template_id, "format": format, "assertions": assertions, "extract": extract, "hash_over": [e["name"] for e in extract]}, missing
