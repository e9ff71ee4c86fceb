"""More registered queries with their SQL twins: markdown and HTML made from the lines of
orders and parsed by the engine's own readers, run output, learning, diagnosis, scalars."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as C
from .catalog import _MATCH, DEFINITIONS, _t, query
from .functions import scalars as S
from .functions.regexlang import escape, glob_to_regex
from .operators import assertions as A
from .operators import diagnose, engine, extract, hybrid, learn, struct_check, structure
from .plans import definitions as D
from .plans.definitions import Assertion, Definition, auto_name
from .plans.refusals import Refusal
from .sources import pdf

# Markdown that has to be made normal first


def made_markdown(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Orders as markdown with an underlined title, a bold heading and a table whose cells
    are padded unevenly; parsed, with these parts of the view."""
    o = C.order_docs(spark, sf_dir).select("doc_id", "data")
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.slice(r, 1, 3), lambda x, i: F.concat(F.repeat(F.lit(" "), i.cast("int")), x, F.lit(" "))), "|"), F.lit("|"))
    title = F.concat(F.lit("Order "), F.col("doc_id"))
    mark = F.when(F.col("doc_id") % 2 == 0, "=").otherwise("-")
    text = F.concat(title, F.lit("\n"), F.repeat(mark, F.length(title) + (F.col("doc_id") % 3).cast("int")), F.lit("\n\n\n\n**Lines of "), F.col("doc_id"), F.lit("**\n\n|Line|Flag|Status|\n|---|---|---|\n"), F.array_join(F.transform("data", row), "\n"), F.lit("\n\nend  \n"))
    return structure.with_view(o.select("doc_id", F.lit("markdown").alias("kind"), text.alias("text")), "kind", "text", parts=parts)


@query("WITH {GRID} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS level, 'Order ' || doc_id AS text, 1::BIGINT AS line FROM docs")
def n01_setext(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = made_markdown(spark, sf_dir, "headings").select("doc_id", F.element_at("view.headings", 1).alias("h"))
    return h.select("doc_id", F.col("h.level").cast("long").alias("level"), "h.text", F.col("h.line").cast("long").alias("line"))


@query("WITH {GRID} SELECT doc_id, 2::BIGINT AS level, 'Lines of ' || doc_id AS text, 3::BIGINT AS line, 2::BIGINT AS n FROM docs")
def n02_bold_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = made_markdown(spark, sf_dir, "headings").select("doc_id", F.element_at("view.headings", 2).alias("h"), F.size("view.headings").cast("long").alias("n"))
    return h.select("doc_id", F.col("h.level").cast("long").alias("level"), "h.text", F.col("h.line").cast("long").alias("line"), "n")


@query("""WITH {GRID}, rows_ AS (SELECT doc_id, string_agg(' | ' || a || ' | ' || b || ' | ' || c || ' | ', chr(10) ORDER BY r) AS body FROM li GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# ' ELSE '## ' END || 'Order ' || doc_id || chr(10) || chr(10) || '## Lines of ' || doc_id || chr(10) || chr(10) || ' | Line | Flag | Status | ' || chr(10) || ' | --- | --- | --- | ' || chr(10) || body || chr(10) || chr(10) || 'end' AS normalized FROM rows_""")
def n04_table_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_markdown(spark, sf_dir, "normalized").select("doc_id", F.col("view.normalized").alias("normalized"))


@query("WITH {GRID} SELECT doc_id, CAST(r - 1 AS BIGINT) AS row, a || ',' || b || ',' || c AS cells, 'Line,Flag,Status' AS headers FROM li")
def n07_markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_markdown(spark, sf_dir, "tables").select("doc_id", F.element_at("view.tables", 1).alias("t"))
    x = t.select("doc_id", F.array_join("t.headers", ",").alias("headers"), F.posexplode_outer("t.rows").alias("i", "cells")).where("i is not null")  # outer, as in j03_children
    return x.select("doc_id", (F.col("i") + 1).cast("long").alias("row"), F.array_join("cells", ",").alias("cells"), "headers")


@query("WITH {GRID} SELECT doc_id, 'Lines of ' || doc_id AS heading, 5::BIGINT AS start_line, CAST(6 + COUNT(*) AS BIGINT) AS end_line FROM li GROUP BY doc_id")
def n08_table_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_markdown(spark, sf_dir, "tables").select("doc_id", F.element_at("view.tables", 1).alias("t"))
    return t.select("doc_id", F.col("t.heading_ref").alias("heading"), F.col("t.start_line").cast("long").alias("start_line"), F.col("t.end_line").cast("long").alias("end_line"))


# HTML


def made_html(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Orders as HTML: paragraphs, a heading on a numbered page, and a table whose first
    cell spans two columns in the header and two rows below it; parsed, with these parts
    of the view."""
    o = C.order_docs(spark, sf_dir).select("doc_id", "data")
    cell = lambda r, i: F.element_at(r, i)
    row = lambda r, k: F.concat(F.lit("<tr>"), F.when(k % 2 == 0, F.concat(F.lit("<td rowspan=2>"), cell(r, 1))).otherwise(""), F.lit("<td>"), cell(r, 2), F.lit("<td> "), cell(r, 3), F.lit(" &ndash; x</tr>"))
    page = F.col("doc_id") % 3 + 1
    paragraphs = F.repeat(F.lit("<p>a&nbsp;&mdash; b\n c<br>d</p>"), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(
        F.lit("<html><body>"), paragraphs, F.lit('<section data-page-number="'), page, F.lit('"><h2>Lines <b>of</b> '), F.col("doc_id"),
        F.lit("</h2><table><thead><tr><th colspan=2>Line<th>Status</thead>"), F.array_join(F.transform("data", row), ""), F.lit("</table></section><script>no</script></body></html>"),
    )
    return structure.with_view(o.select("doc_id", F.lit("html").alias("kind"), text.alias("text")), "kind", "text", parts=parts)


# a row without its own first cell takes the one that spans it
HTML_ROWS = "hr AS (SELECT doc_id, r - 1 AS n, CASE WHEN (r - 1) % 2 = 1 THEN a ELSE lag(a) OVER (PARTITION BY doc_id ORDER BY r) END AS a, b, c || ' x' AS c FROM li)"


@query("WITH {GRID} SELECT doc_id, 'Lines of ' || doc_id AS text, CAST(1 + 4 * (doc_id % 4) AS BIGINT) AS line, CAST(doc_id % 3 + 1 AS BIGINT) AS page FROM docs")
def n09_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in document order with their lines: N-09, N-11 and the offsets of W-07."""
    h = made_html(spark, sf_dir, "headings", "tables").select("doc_id", F.element_at("view.headings", 1).alias("h"), F.element_at("view.tables", 1)["page"].alias("page"))
    return h.select("doc_id", "h.text", F.col("h.line").cast("long").alias("line"), F.col("page").cast("long").alias("page"))


@query("WITH {GRID} SELECT doc_id, CAST(doc_id % 3 + 1 AS BIGINT) AS page, 1::BIGINT AS page_sections FROM docs")
def n18_page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page context of the last section (N-10, N-17) and the count of page sections."""
    v = made_html(spark, sf_dir, "sections", "page_sections")
    return v.select("doc_id", F.element_at("view.sections", -1)["page"].cast("long").alias("page"), F.col("view.page_sections").cast("long").alias("page_sections"))


@query("WITH {GRID}, " + HTML_ROWS + " SELECT doc_id, CAST(n AS BIGINT) AS row, a || ',' || b || ',' || c AS cells FROM hr")
def n14_html_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_html(spark, sf_dir, "tables").select("doc_id", F.posexplode_outer(F.element_at("view.tables", 1)["rows"]).alias("i", "cells")).where("i is not null")  # outer, as in j03_children
    return t.select("doc_id", (F.col("i") + 1).cast("long").alias("row"), F.array_join("cells", ",").alias("cells"))


@query("WITH {GRID} SELECT doc_id, 'Line,Line,Status' AS headers, COUNT(*) AS n_rows FROM li GROUP BY doc_id")
def n15_html_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_html(spark, sf_dir, "tables").select("doc_id", F.element_at("view.tables", 1).alias("t"))
    return t.select("doc_id", F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").cast("long").alias("n_rows"))


@query("WITH {GRID}, " + HTML_ROWS + """, body AS (SELECT doc_id, string_agg(a || ' | ' || b || ' | ' || c, chr(10) ORDER BY n) AS body FROM hr GROUP BY doc_id)
SELECT doc_id, repeat('a b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || chr(10), (doc_id % 4)::INT) || '## Lines of ' || doc_id || chr(10) || chr(10) || 'Line | Line | Status' || chr(10) || body AS normalized FROM body""")
def n16_html_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments made normal (N-12) and all blocks as lines."""
    return made_html(spark, sf_dir, "normalized").select("doc_id", F.col("view.normalized").alias("normalized"))


@query("WITH {GRID} SELECT doc_id, 'Lines of ' || doc_id AS heading, CAST(1 + 4 * (doc_id % 4) AS BIGINT) AS start_line, CAST(3 + 4 * (doc_id % 4) + COUNT(*) AS BIGINT) AS end_line FROM li GROUP BY doc_id")
def n17_html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = made_html(spark, sf_dir, "sections").select("doc_id", F.element_at("view.sections", -1).alias("s"))
    return s.select("doc_id", F.col("s.heading.text").alias("heading"), F.col("s.start_line").cast("long").alias("start_line"), F.col("s.end_line").cast("long").alias("end_line"))


# Assertions that only newer runs evaluate, and those of PDF


def _judged(docs: DataFrame, kind: str, params: dict, strict: bool = True) -> DataFrame:
    d = docs.select("doc_id", A.Builder(strict).detail(Assertion(kind, params)).alias("detail"))
    return d.select("doc_id", F.col("detail").isNull().alias("passed"), "detail")


@query("WITH {GRID}, n AS (SELECT doc_id, least(COUNT(*), 4) / 4 AS share FROM li GROUP BY doc_id) SELECT doc_id, share >= 0.75 AS passed, CASE WHEN share < 0.75 THEN 'range A2:E5 is populated to ' || CAST(share AS VARCHAR) || ', expected at least 0.75' END AS detail FROM n")
def a07_range_populated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(C.order_docs(spark, sf_dir), "range_populated", {"sheet": "Sheet1", "range": "A2:E5", "min_pct": 0.75}, False)


@query("SELECT doc_id, false AS passed, 'assertion ''within_tolerance'' is not implemented in v0.1' AS detail FROM documents")
def a12_within_tolerance_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(C.text_docs(spark, sf_dir), "within_tolerance", {"cell": "A1", "min": 0.0, "max": 1.0})


@query("WITH {GRID} SELECT doc_id, CAST(d AS INT) BETWEEN 10 AND 30 AS passed, CASE WHEN CAST(d AS INT) NOT BETWEEN 10 AND 30 THEN 'cell D2 is not within [10, 30]' END AS detail FROM g WHERE r = 2")
def a12_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(C.order_docs(spark, sf_dir), "within_tolerance", {"cell": "D2", "min": 10, "max": 30}, False)


def _pdf_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PDF facts: pages by key, a producer, and one in nine that can't be read."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    info = F.array(F.struct(F.lit("Producer").alias("key"), F.col("o_orderpriority").alias("value")))
    facts = F.struct((F.col("doc_id") % 7).cast("int").alias("page_count"), info.alias("info"), F.when(F.col("doc_id") % 9 == 0, "no header").alias("error"))
    return C._as_document(o, "pdf", F.concat("doc_id", F.lit(".pdf"))).withColumn("pdf", facts.cast(pdf.PDF)).withColumn("view", F.lit(None).cast(structure.VIEW))


_NO_PDF = "'failed reading pdf ''' || o_orderkey || '.pdf'': no header'"


@query(f"SELECT o_orderkey AS doc_id, o_orderkey % 9 <> 0 AND o_orderkey % 7 BETWEEN 2 AND 5 AS passed, CASE WHEN o_orderkey % 9 = 0 THEN {_NO_PDF} WHEN o_orderkey % 7 < 2 THEN 'pdf has ' || o_orderkey % 7 || ' pages, expected at least 2' WHEN o_orderkey % 7 > 5 THEN 'pdf has 6 pages, expected at most 5' END AS detail FROM orders")
def a29_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(_pdf_docs(spark, sf_dir), "page_count", {"min": 2, "max": 5})


@query(f"SELECT o_orderkey AS doc_id, o_orderkey % 9 <> 0 AND regexp_matches(o_orderpriority, '^[1-3]-') AS passed, CASE WHEN o_orderkey % 9 = 0 THEN {_NO_PDF} WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'metadata ''producer'' value ''' || o_orderpriority || ''' does not match pattern ''^[1-3]-''' END AS detail FROM orders")
def a30_metadata_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(_pdf_docs(spark, sf_dir), "metadata_regex", {"key": "producer", "pattern": "^[1-3]-"})


# Tables: widths and types


@query("WITH {GRID} SELECT doc_id, CAST(greatest(MAX(CAST(a AS INT) % 4 + 1), doc_id % 5 + 1) AS BIGINT) AS width FROM li GROUP BY doc_id")
def g06_table_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.order_docs(spark, sf_dir)
    rows = F.transform("data", lambda r: F.slice(r, F.lit(1), F.element_at(r, 1).cast("int") % 4 + 1))
    heads = F.slice(F.element_at("rows", 1), F.lit(1), (F.col("doc_id") % 5 + 1).cast("int"))
    return o.select("doc_id", A.table_width(F.struct(rows.alias("rows"), heads.alias("headers"))).cast("long").alias("width"))


@query("""WITH {GRID}, k AS (SELECT doc_id, CASE WHEN CAST(d AS INT) % 5 = 0 THEN NULL WHEN CAST(d AS INT) % 2 = 0 THEN 'number' ELSE 'currency' END AS kind FROM li),
n AS (SELECT doc_id, COUNT(kind) AS n, COUNT(*) FILTER (WHERE kind = 'currency') AS cur, COUNT(*) FILTER (WHERE kind = 'number') AS num FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN cur >= n // 2 + 1 THEN 'currency' WHEN num >= n // 2 + 1 THEN 'number' ELSE 'string' END AS kind FROM n""")
def g07_column_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of a column's filled cells; where there is none it is text."""
    q = lambda r: F.element_at(r, 4).cast("int")
    rows = F.transform("data", lambda r: F.array(F.when(q(r) % 5 == 0, " ").when(q(r) % 2 == 0, q(r).cast("string")).otherwise(F.concat(F.lit("$"), q(r).cast("string")))))
    return C.order_docs(spark, sf_dir).select("doc_id", A.column_type(rows, 0).alias("kind"))


# Evaluation of every definition, and run output


@query(_MATCH + """, v AS (SELECT doc_id, unnest(['mail.v1', 'prose.v1', 'prose.v1/short.v1', 'prose.v1/legal.v1', 'latin.v1']) AS template_id, unnest([mail, prose, c1, c2, l1]) AS matched,
  unnest([CASE WHEN NOT m1 THEN 'Text ''@mail'' not found in document' WHEN NOT m2 THEN 'Pattern ''[A-Z]{4}'' not found in document' END,
    CASE WHEN NOT p1 THEN 'Text '' the '' not found in document' WHEN NOT p2 THEN 'Text ''ing'' not found in document' WHEN NOT p3 THEN 'Text ''edon'' not found in document' END,
    CASE WHEN NOT c1 THEN 'Pattern ''(?s)^.{0,1500}\\z'' not found in document' END, CASE WHEN NOT c2 THEN 'Text ''icensed'' not found in document' END, CASE WHEN NOT l1 THEN 'Pattern ''(?i)[aeiou]'' not found in document' END]) AS reason FROM w)
SELECT * FROM v""".replace("\\\\", "\\"))
def g01_all_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every definition of its format (J-02): whether all assertions
    passed (G-01) and the first failure (G-02)."""
    d = C.text_docs(spark, sf_dir)
    verdicts = []
    for i, x in enumerate(DEFINITIONS):
        d = engine.with_results(d, x, f"_r{i}")
        v = engine.verdict(x, F.col(f"_r{i}"))
        verdicts.append(F.struct(v["template_id"].alias("template_id"), v["matched"].alias("matched"), v["reason"].alias("reason")))
    return d.select("doc_id", F.explode(F.array(*verdicts)).alias("v")).select("doc_id", "v.*")


@query(_MATCH + "SELECT doc_id, unnest(['prose.v1/short.v1', 'prose.v1/legal.v1']) AS child, unnest([c1, c2]) AS matched FROM w WHERE won = 'prose.v1'")
def j03_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer: explode alone would add a filter that repeats the whole evaluation
    e = C._evaluated(spark, sf_dir).select("doc_id", F.explode_outer("children").alias("c")).where("c is not null")
    return e.select("doc_id", F.col("c.template_id").alias("child"), "c.matched")


def _run(spark: SparkSession, sf_dir: str, diagnose_: bool = False) -> DataFrame:
    """Run output over documents as manifest records: one in ten skipped before, one in
    ten that can't be read, one in ten without a path."""
    k = F.col("doc_id") % 10
    raw = F.to_json(F.struct(F.lit("hash.v0").alias("version"), F.col("doc_id").alias("n"), F.struct(F.lit("9").alias("walk")).alias("tool_versions")))
    d = C.text_docs(spark, sf_dir).withColumns({"seq": F.col("doc_id"), "raw": raw, "skipped": k == 7, "has_path": k != 8, "error": F.when(k == 9, "bad bytes")})
    return engine.output_lines(engine.evaluate(d, DEFINITIONS, diagnose_), DEFINITIONS, diagnose_)


_KEYS = "SELECT doc_id AS seq, doc_id % 10 AS k, won, mail OR prose OR l1 AS any_, prose, c1, c2, mail FROM w"


@query(_MATCH + f", r AS ({_KEYS}) SELECT seq, 'docmatch.v0' AS version, seq AS n, '9' AS walk, k = 9 AS skipped, k = 9 OR (k < 7 AND (NOT any_ OR (won = 'prose.v1' AND c1 = c2))) AS partial FROM r WHERE k <> 8")
def e07_enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input fields kept, version and tool added (E-07), records skipped (E-08), and
    whether a record makes the run partial."""
    v = lambda p: F.get_json_object("value", p)
    r = _run(spark, sf_dir).where("seq % 10 <> 8")
    return r.select("seq", v("$.version").alias("version"), v("$.n").cast("long").alias("n"), v("$.tool_versions.walk").alias("walk"), F.coalesce(v("$._skipped") == "true", F.lit(False)).alias("skipped"), "partial")


@query(_MATCH + f", r AS ({_KEYS}) SELECT seq, won AS template_id, any_ AS matched, CASE WHEN mail THEN 2 WHEN prose THEN 3 ELSE 1 END::BIGINT AS n_assertions, CASE WHEN won = 'prose.v1' THEN CASE c1::INT + c2::INT WHEN 1 THEN 'selected' WHEN 0 THEN 'no_child_match' ELSE 'ambiguous' END END AS routing FROM r WHERE k < 7")
def e06_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda p: F.get_json_object("value", p)
    r = _run(spark, sf_dir).where("seq % 10 < 7")
    n = F.size(F.from_json(v("$.template.assertions"), "array<struct<name:string>>")).cast("long")
    return r.select("seq", v("$.template.template_id").alias("template_id"), (v("$.template.matched") == "true").alias("matched"), n.alias("n_assertions"), v("$.template.child_routing.status").alias("routing"))


@query("SELECT doc_id AS seq, 'docmatch' AS tool, 'Cannot parse TEXT: bad bytes' AS message, doc_id || '.txt' AS file FROM documents WHERE doc_id % 10 = 9")
def e08_skip_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.element_at(F.from_json(F.get_json_object("value", "$._warnings"), "array<struct<tool:string,message:string,detail:struct<path:string>>>"), 1)
    r = _run(spark, sf_dir).where("seq % 10 = 9").select("seq", w.alias("w"))
    return r.select("seq", "w.tool", "w.message", S.basename(F.col("w.detail.path")).alias("file"))


@query(_MATCH + f", r AS ({_KEYS}) SELECT seq, CASE WHEN mail THEN 'mail.v1' WHEN prose THEN 'mail.v1,prose.v1' ELSE 'mail.v1,prose.v1,latin.v1' END AS attempts, CASE WHEN mail THEN 'prose.v1,latin.v1' WHEN prose THEN 'latin.v1' ELSE '' END AS later FROM r WHERE k < 7")
def w03_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts up to the winner and the roots left out after it."""
    r = _run(spark, sf_dir, True).where("seq % 10 < 7")
    d = F.from_json(F.get_json_object("value", "$.template.diagnostics"), "attempts array<struct<template_id:string>>, short_circuited_template_ids array<string>")
    x = r.select("seq", d.alias("d"))
    return x.select("seq", F.array_join(F.transform("d.attempts", lambda a: a["template_id"]), ",").alias("attempts"), F.array_join("d.short_circuited_template_ids", ",").alias("later"))


# Diagnosis

TARGET = "The attion of thaneable ther"


@query(r"""WITH {HEADS}, t AS (SELECT trim(regexp_replace(lower('The attion of thaneable ther'), '[^a-z0-9]+', ' ', 'g')) AS want),
x AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY levenshtein(want, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))), strlen(text), line) AS rn FROM h, t)
SELECT doc_id, text AS nearest FROM x WHERE rn = 1""")
def o07_nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents without a heading go here: a filter before would find headings twice
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [diagnose.nearest(TARGET, hs or []) for hs in b.column("hs").to_pylist()]
            whole = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "nearest"])
            yield whole.filter(whole.column("nearest").is_valid())

    d = C.md_docs(spark, sf_dir).select("doc_id", F.transform("headings", lambda h: h["text"]).alias("hs"))
    return d.mapInArrow(nearest, "doc_id long, nearest string")


@query(r"""WITH ls AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, list_filter(ls, lambda x: contains(lower(x), 'idiot') OR contains(lower(x), 'edon')) AS found FROM ls)
SELECT doc_id, array_to_string(found[1:5], chr(10)) AS lines FROM f WHERE len(found) > 0""")
def o08_partial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines with a word of the target, of documents that have one."""

    @F.pandas_udf("string")
    def partial(texts: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(diagnose.partial_lines(t, "Idiot, edon!")) for t in texts])

    d = _t(spark, sf_dir, "documents").where(F.lower("text").contains("idiot") | F.lower("text").contains("edon"))
    return d.select("doc_id", partial("text").alias("lines"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(trim(regexp_replace(translate(left(text, 60), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)[1:6]) AS BIGINT) AS n, COALESCE(array_to_string(list_filter(string_split(trim(regexp_replace(translate(left(text, 60), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)[1:6], ' '), '') AS tokens FROM documents WHERE text IS NOT NULL")
def f09_hint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that partial matches are looked for by, of each document's first 60 signs."""

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([diagnose.tokens_of(t) for t in texts])

    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", tokens(F.substr("text", F.lit(1), F.lit(60))).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("long").alias("n"), F.array_join("ts", " ").alias("tokens"))


# Learning


def _learned(spark: SparkSession, found: list[learn.Candidate]) -> DataFrame:
    rows = sorted((learn.sort_key(c.assertion), c.support, c.total) for c in found)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, key string, support long, total long")


@query("""WITH {GRID}, n AS (SELECT doc_id, COUNT(*) AS n FROM li GROUP BY doc_id), t AS (SELECT COUNT(*) AS total, MIN(n) AS low FROM n),
c AS (SELECT '00_filename_regex:(?i).*\\.csv$' AS key FROM t UNION ALL SELECT '10_sheet_exists:Sheet1' FROM t UNION ALL SELECT '11_sheet_min_rows:Sheet1:' || low FROM t
  UNION ALL SELECT '12_cell_eq:Sheet1:' || unnest(['A1', 'B1', 'C1', 'D1', 'E1']) || ':' || unnest(['Line', 'Return Flag', 'Status', 'Quantity', 'Part']) FROM t)
SELECT row_number() OVER (ORDER BY key) - 1 AS place, key, total AS support, total FROM c, t""".replace("\\\\", "\\"))
def i02_learn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of CSV documents (I-02), their supports, the least rows (G-11), the confidence
    filter (G-16) and the order of the assertions (O-04)."""
    profile = learn.from_documents(C.order_docs(spark, sf_dir), "csv", "orders.v1", 0.9)
    return _learned(spark, profile["assertions"])


@query("""WITH {GRID}, n AS (SELECT doc_id, doc_id % 3 + 1 AS page FROM docs), t AS (SELECT COUNT(*) AS total FROM docs), p AS (SELECT page, COUNT(*) AS n FROM n GROUP BY page),
h AS (SELECT 'Lines of page ' || page AS text, n FROM p ORDER BY n DESC, text LIMIT 1), s AS (SELECT MIN(doc_id % 4) AS lo, MAX(doc_id % 4) AS hi, COUNT(*) AS n FROM docs WHERE doc_id % 4 > 0)
SELECT '13_heading_exists:' || text AS key, n AS support FROM h UNION ALL SELECT '00_filename_regex:(?i).*\\.html?$', total FROM t
UNION ALL SELECT '24_page_section_count:Some(' || lo || '):Some(' || hi || ')', n FROM s UNION ALL SELECT '22_dominant_column_count:5:0:' || (SELECT MAX(doc_id % 4) FROM docs), total FROM t""".replace("\\\\", "\\"))
def i04_learn_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of HTML documents: the commonest first heading, page sections, table widths."""
    observed = learn.observe(C.table_docs(spark, sf_dir), "html")
    kinds = ("filename_regex", "heading_exists", "page_section_count", "dominant_column_count")
    return _learned(spark, learn.candidates(observed, "html", None, kinds=kinds)).select("key", "support")


@query("WITH {GRID}, f AS (SELECT DISTINCT doc_id, CASE b WHEN 'R' THEN a || ' returned' ELSE 'open' END AS v FROM li WHERE b IN ('R', 'N')) SELECT v AS text, COUNT(*) AS support FROM f GROUP BY v")
def g15_full_width_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose filled cells are all alike (U-06), by the documents that have them."""
    note = lambda r: F.when(F.element_at(r, 2) == "R", F.concat(F.element_at(r, 1), F.lit("\t returned"))).otherwise("open")
    row = lambda r: F.when(F.element_at(r, 2) == "A", r).otherwise(F.array(note(r), F.lit(" "), F.concat(F.lit(" "), note(r))))
    o = C.order_docs(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    s = learn.support(o, F.filter(F.transform("data", lambda r: learn.full_row(row(r))), lambda x: x.isNotNull()))
    return s.select(F.col("item").alias("text"), F.col("n").alias("support"))


@query("""WITH e AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'xls' ELSE 'xlsx' END AS x FROM orders) SELECT CASE WHEN COUNT(*) = 2 THEN '(?i).*\\.xls(x)?$' END AS pattern, (SELECT COUNT(*) FROM orders) AS support FROM e""".replace("\\\\", "\\"))
def u02_learn_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of file names follows from the distinct extensions."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    d = C._as_document(o, "xlsx", F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, ".xls").otherwise(".xlsx"))).withColumn("sheets", F.array().cast(C.grids.SHEETS)).withColumn("view", F.lit(None).cast(structure.VIEW))
    observed = learn.observe(d, "xlsx")
    found = learn.candidates(observed, "xlsx", observed.count())
    return spark.createDataFrame([(c.assertion["pattern"], c.support) for c in found if c.assertion.kind == "filename_regex"], "pattern string, support long")


@query("WITH {GRID}, c AS (SELECT doc_id, unnest(['A1', 'B1', 'A2', 'B2']) AS cell, unnest([MAX(CASE WHEN r = 1 THEN a END), MAX(CASE WHEN r = 1 THEN b END), MAX(CASE WHEN r = 2 THEN a END), MAX(CASE WHEN r = 2 THEN b END)]) AS value FROM g GROUP BY doc_id) SELECT s.sheet, cell, value, COUNT(*) AS n FROM c, (SELECT unnest(['Sheet1', 'csv']) AS sheet) s GROUP BY ALL")
def i01_observe_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner cells of each sheet, counted over the documents."""
    o = C.order_docs(spark, sf_dir)
    d = o.withColumn("kind", F.lit("xlsx")).withColumn("sheets", F.filter("sheets", lambda s: ~s["name"].startswith("lines"))).withColumn("view", F.lit(None).cast(structure.VIEW))
    return learn.support(learn.observe(d, "xlsx"), F.col("cells"), "sheet", "cell", "value")


@query("SELECT o_orderkey % 7 AS pages, o_orderpriority AS producer, COUNT(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY ALL")
def i03_observe_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = learn.observe(_pdf_docs(spark, sf_dir), "pdf").select(F.col("page_count").cast("long").alias("pages"), F.element_at("info", 1)["value"].alias("producer"))
    return x.groupBy("pages", "producer").agg(F.count(F.lit(1)).alias("n"))


# Search and order


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def w06_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("s"))
    return hybrid.ranked(d, "s", "place").select("id", F.col("place").cast("long").alias("place"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 2), s AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) AS cosine FROM embeddings, q)
SELECT id, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS place FROM s WHERE cosine > 0""")
def o06_semantic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits alone: only cosines above 0, by cosine and id."""
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 2").select(F.col("embedding").alias("q"))  # one row
    hits = e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), S.cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    none = spark.createDataFrame([], "id long, bm25 double")
    return hybrid.fuse(none, hits).select("id", F.col("semantic_rank").cast("long").alias("place"))


@query("SELECT doc_id AS seq, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def o01_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records come out in the order of their lines, whatever the partitions."""
    out = _run(spark, sf_dir).repartition(7, "value").select(F.col("seq").alias("id"), (-F.col("seq")).alias("back"))
    return hybrid.ranked(out, "back", "place").select(F.col("id").alias("seq"), (F.col("place") + 1).alias("place"))


# Scalars


@query("SELECT p_partkey, p_name AS text FROM part")
def f03_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.concat(F.repeat(F.lit("  \t"), (F.col("p_partkey") % 4).cast("int")), F.col("p_name"), F.lit(" \n"))
    return _t(spark, sf_dir, "part").select("p_partkey", S.trim(pad).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN '*' || p_name || '*' WHEN 5 THEN p_name || '**' ELSE p_name END AS text FROM part")
def f04_normalise_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    around = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    forms = [around(" **", "** "), around("__", "__"), around("`", "` "), around("*", "*"), around("_*", "*_"), around("", "**")]
    return _t(spark, sf_dir, "part").select("p_partkey", S.normalise_cell(F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("text"))


@query("SELECT o_orderkey, o_orderkey % 9 < 6 AS is_date FROM orders")
def f06_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    as_ = lambda f: F.date_format(d, f)
    forms = [as_("yyyy-MM-dd"), as_("yyyy-M-d"), as_("M/d/yyyy"), as_("MM/dd/yy"), as_("MMMM d, yyyy"), as_("d-MMM-yyyy"), as_("yyyy/MM/dd"), F.concat(as_("yyyy"), F.lit("-02-30")), F.concat(F.lit("13/"), as_("d/yyyy"))]
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.is_date(F.element_at(F.array(*forms), (F.col("o_orderkey") % 9 + 1).cast("int"))).alias("is_date"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || '--' || p_brand || '!'), '[^a-z0-9]+', ' ', 'g')) AS text FROM part")
def f08_distance_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.distance_form(F.concat("p_type", F.lit("--"), "p_brand", F.lit("!"))).alias("text"))


@query("SELECT doc_id, source || '/' || lang AS dir, doc_id::VARCHAR AS stem, 'txt' AS extension FROM documents")
def f12_directory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory (F-12), stem and extension (S-04) of a path."""
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".TXT")))
    return _t(spark, sf_dir, "documents").select("doc_id", S.directory(path).alias("dir"), S.stem(path).alias("stem"), S.extension(path).alias("extension"))


@query(r"SELECT doc_id, regexp_matches(source || '/' || lang || '/' || doc_id || '.txt', '^(src1|src2).*/[de].*/.*[!0-4]\.t.t$') AS hit FROM documents")
def f13_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    return _t(spark, sf_dir, "documents").select("doc_id", path.rlike(glob_to_regex("{src1,src2}*/[de]*/**[0-4].t?t")).alias("hit"))


@query("SELECT p_partkey, p_name || ' ' || p_brand AS text FROM part")
def f15_scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.scalar_text(F.concat(F.lit("\x01 "), "p_name", F.lit("\t\x07 \u0085"), "p_brand", F.lit("\n"))).alias("text"))


@query("SELECT doc_id, CASE WHEN contains(text, 'mail6.example.com') THEN true ELSE false END AS hit, contains(text, '$$$ ') AS money FROM documents WHERE text IS NOT NULL")
def f02_regex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped texts as patterns (F-02) find themselves (F-01)."""
    t = F.col("text")
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", S.matches(t, escape("mail6.example.com")).alias("hit"), S.matches(t, escape("$$$ ")).alias("money"))


@query("SELECT o_orderkey, round(1.0::DOUBLE / (60 + o_orderkey + 1), 12) AS score FROM orders")
def f20_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(S.reciprocal_rank(F.col("o_orderkey")), 12).alias("score"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 5400000000 END // 1000000 AS seconds FROM events")
def f21_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with Z, with an offset, and ones that aren't of the format."""
    e, t = _t(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(t, F.lit("Z"))).when(k == 1, F.concat(F.regexp_replace(t, "T", " "), F.lit(".000+01:30"))).otherwise(t)
    return e.select("event_id", F.unix_seconds(S.rfc3339(text)).alias("seconds"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'other ' || lang END AS family FROM documents")
def f23_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit(" BDC-soi-"), "lang", F.lit(".v3"))).when(k == 1, F.concat(F.lit("a/b/"), "source", F.lit(".v12"))).otherwise(F.concat(F.lit("Other "), F.upper("lang")))
    return _t(spark, sf_dir, "documents").select("doc_id", S.family(t).alias("family"))


@query("""SELECT p_partkey, '{"a":[' || p_size || ',null],"b":"' || p_brand || '","é":true}' AS text FROM part""")
def f18_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return pd.Series([extract.canonical_json(json.loads(t)) for t in texts])

    raw = F.concat(F.lit('{ "é" : true, "b":"'), "p_brand", F.lit('", "a" : [ '), "p_size", F.lit(" , null ] }"))
    return _t(spark, sf_dir, "part").select("p_partkey", canonical(raw).alias("text"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM part")
def f22_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def names(texts: pd.Series) -> pd.Series:
        return texts.map(learn.sanitise)

    return _t(spark, sf_dir, "part").select("p_partkey", names("p_type").alias("name"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS row, CAST(p_partkey % 700 AS BIGINT) AS col FROM part")
def n19_cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cells read back."""

    @F.pandas_udf("array<long>")
    def parsed(names: pd.Series) -> pd.Series:
        return pd.Series([list(A.parse_cell(f" {n.lower()}")) for n in names])

    d = _t(spark, sf_dir, "part").select("p_partkey", parsed(S.a1(F.col("p_size"), F.col("p_partkey") % 700)).alias("at"))
    return d.select("p_partkey", F.element_at("at", 1).alias("row"), F.element_at("at", 2).alias("col"))


# Directory rules, one by one


@query("""WITH {PATHS}, q AS (SELECT DISTINCT j.id, j.dir, unnest(j.req) AS p, unnest(j.req_rx) AS rx FROM j) SELECT id AS rule_id, dir, p AS missing FROM q u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dir = u.dir AND regexp_matches(f.file, u.rx))""")
def j10_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = struct_check.check(C._directories(spark, sf_dir), C.RULES)
    return c.select("rule_id", F.col("matched_directory").alias("dir"), F.explode("missing").alias("missing"))


@query("WITH {PATHS} SELECT id AS rule_id, dir, file FROM m WHERE NOT is_req AND NOT is_opt")
def j11_unexpected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = struct_check.check(C._directories(spark, sf_dir), C.RULES)
    return c.select("rule_id", F.col("matched_directory").alias("dir"), F.explode("unexpected").alias("file"))


@query("""WITH {PATHS}, a AS (SELECT id, dir, bool_or(is_req) AS any_there FROM m GROUP BY id, dir), q AS (SELECT DISTINCT j.id, j.dir, unnest(j.req_rx) AS rx FROM j),
g AS (SELECT id, dir, COUNT(*) AS n FROM q u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dir = u.dir AND regexp_matches(f.file, u.rx)) GROUP BY id, dir)
SELECT a.id AS rule_id, CASE WHEN g.n IS NULL THEN 'complete' WHEN NOT any_there THEN 'empty' ELSE 'partial' END AS outcome, COUNT(*) AS n FROM a LEFT JOIN g ON a.id = g.id AND a.dir = g.dir GROUP BY ALL""")
def v08_rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_check.check(C._directories(spark, sf_dir), C.RULES).groupBy("rule_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


# Sections


@query(r"WITH {SECTIONS} SELECT doc_id, heading, CAST(start_line AS BIGINT) AS line, CAST(end_line - start_line + 1 AS BIGINT) AS n_lines FROM s")
def j07_section_of_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the heading on their first line, and the lines they hold."""
    d = C.md_docs(spark, sf_dir).select("doc_id", F.explode("sections").alias("s")).where("s.heading is not null")
    return d.select("doc_id", F.col("s.heading.text").alias("heading"), F.col("s.heading.line").cast("long").alias("line"), (F.length(F.col("s.content")) - F.length(F.regexp_replace("s.content", "\n", "")) + 1).cast("long").alias("n_lines"))


@query(r"WITH {HEADS} SELECT a.doc_id, CAST(a.line AS BIGINT) AS line, CAST((SELECT MIN(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS BIGINT) AS next_line FROM h a")
def w04_conditional_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next heading that isn't below this one."""
    d = C.md_docs(spark, sf_dir).select("doc_id", F.size("ls").alias("n"), F.explode("ranges").alias("r")).where("r.heading is not null")
    return d.select("doc_id", F.col("r.start_line").cast("long").alias("line"), F.when(F.col("r.end_line") < F.col("n"), F.col("r.end_line") + 1).cast("long").alias("next_line"))


@query("""WITH {GRID}, p AS (SELECT doc_id % 3 + 1 AS page, COUNT(*) AS n FROM docs GROUP BY ALL), t AS (SELECT page, n FROM p ORDER BY n DESC, page DESC LIMIT 1)
SELECT '21_header_token_search:Some(' || page || '):Some(0):["(?i)Line", "(?i)' || CASE WHEN page = 2 THEN 'Flag' ELSE 'Return Flag' END || '"]' AS key, n AS support FROM t""")
def g14_header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = learn.observe(C.table_docs(spark, sf_dir), "html")
    return _learned(spark, learn.candidates(observed, "html", None, kinds=("header_token_search",))).select("key", "support")


# Registry: nations (25) as definitions of their region's provider


def _nations(spark: SparkSession, sf_dir: str) -> list:
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()  # definitions are few


def _as_definition(template_id: str, source: str, parent: str | None = None) -> Definition:
    return Definition(template_id, "text", [Assertion("text_contains", {"": "x"})], source=source, parent=parent)


def _refused(call) -> str:
    try:
        call()
    except Refusal as e:
        return e.code
    return "ok"


_NATIONS = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT row_number() OVER (ORDER BY n_name) - 1 AS place, n_name AS template_id, r_name AS source {_NATIONS}")
def o02_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.Registry([_as_definition(r["n_name"], r["r_name"]) for r in _nations(spark, sf_dir)], builtins=False).listing()
    return spark.createDataFrame([(i, d.template_id, d.source) for i, d in enumerate(found)], "place long, template_id string, source string")


@query(f"SELECT 'E_DUPLICATE_FP_ID' AS code, MIN(r_name) AS template_id FROM (SELECT r_name {_NATIONS} GROUP BY r_name HAVING COUNT(*) > 1)")
def g09_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first repeated id in order of listing refuses the registry."""
    try:
        D.Registry([_as_definition(r["r_name"], "builtin") for r in _nations(spark, sf_dir)], builtins=False).check([])
        rows = []
    except Refusal as e:
        rows = [(e.code, e.detail["template_id"])]
    return spark.createDataFrame(rows, "code string, template_id string")


@query(f"SELECT n_name AS template_id, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'E_UNKNOWN_FP' END AS code {_NATIONS}")
def j15_requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ids against the registry (J-01), which has every second one."""
    rows = _nations(spark, sf_dir)
    known = D.Registry([_as_definition(r["n_name"], "builtin") for r in rows if r["n_nationkey"] % 2 == 0])
    return spark.createDataFrame([(r["n_name"], _refused(lambda r=r: known.select([r["n_name"]]))) for r in rows], "template_id string, code string")


@query(f"SELECT n_name AS template_id, CASE WHEN n_nationkey % 3 = 0 THEN 'E_ORPHAN_CHILD' ELSE 'ok' END AS code {_NATIONS}")
def j13_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children need their parent among the requested ids."""
    rows = _nations(spark, sf_dir)
    known = D.Registry([_as_definition(x, "builtin") for x in sorted({r["r_name"] for r in rows})] + [_as_definition(r["n_name"], "builtin", r["r_name"]) for r in rows])
    asked = lambda r: [r["n_name"]] if r["n_nationkey"] % 3 == 0 else [r["r_name"], r["n_name"]]
    return spark.createDataFrame([(r["n_name"], _refused(lambda r=r: known.select(asked(r)))) for r in rows], "template_id string, code string")


@query(f"SELECT n_name AS template_id, r_name LIKE 'A%' OR r_name = 'EUROPE' AS trusted {_NATIONS}")
def v04_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r["n_name"], D.trusted(r["r_name"], ["A*", "EUROPE", "MIDDLE"])) for r in _nations(spark, sf_dir)], "template_id string, trusted boolean")


@query(f"SELECT n_nationkey, 'text_contains__' || lower(replace(r_name, ' ', '_')) || CASE WHEN rn > 1 THEN '__' || (rn - 1) ELSE '' END AS name FROM (SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS rn {_NATIONS})")
def w08_auto_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of assertions (E-09), counted where they repeat."""
    rows = _nations(spark, sf_dir)
    made = [Assertion("text_contains", {"": r["r_name"]}) for r in rows]
    auto_name(made)
    return spark.createDataFrame([(r["n_nationkey"], a.name) for r, a in zip(rows, made, strict=True)], "n_nationkey long, name string")


@query(f"SELECT n_nationkey, CAST((n_nationkey % 9 NOT BETWEEN 1 AND 6)::INT + (n_nationkey % 2)::INT + (n_nationkey % 5 = 0)::INT AS BIGINT) AS n_wrong {_NATIONS}")
def v01_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a definition: its heading level, a pattern, the id."""
    out = []
    for r in _nations(spark, sf_dir):
        k = r["n_nationkey"]
        d = Definition(" " if k % 5 == 0 else r["n_name"], "markdown", [Assertion("heading_level", {"level": k % 9, "pattern": "x"}), Assertion("text_regex", {"pattern": "(" if k % 2 else "y"})])
        out.append((k, len(D.validate(d))))
    return spark.createDataFrame(out, "n_nationkey long, n_wrong long")
