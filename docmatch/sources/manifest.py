"""Manifest records and the documents that they name.

Records are JSON lines with open fields: they stay as text beside the few typed columns
that the engine reads, and are merged with its results only at the end."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.structure import VIEW, view_of
from ..plans.refusals import Refusal
from . import grids, pdf

VERSION = "hash.v0"
PROBLEMS = {
    1: "invalid JSON", 2: "record must be a JSON object", 3: "missing field 'version'", 4: "'version' must be a string", 5: f"unsupported version (expected {VERSION})",
    6: "'_skipped' must be a boolean", 7: "missing field 'bytes_hash'", 8: "'bytes_hash' must be a string", 9: "'text_path' must be a string or null",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``seq, raw, file`` of the non-blank lines of a file or folder, numbered from 1 in
    each file. Large files are read in splits by many tasks: lines are numbered within
    their split, and the lines of the splits before it are added."""
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("split"), F.col("value").alias("raw"))

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}  # a task reads its splits one after the other, each in order
        for p in parts:
            for k, own in p.groupby(["file", "split"], sort=False):
                first = seen.get(k, 0)
                seen[k] = first + len(own)
                yield own.assign(n=range(first + 1, first + len(own) + 1))

    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))  # a row per split
    numbered = lines.mapInPandas(number, "file string, split long, raw string, n long").join(F.broadcast(before), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    return numbered.where(~S.blank(F.col("raw"))).select((F.col("n") + F.col("before")).alias("seq"), F.regexp_replace("raw", r"\r\z", "").alias("raw"), "file")


def _type(raw: Column, path: str) -> Column:
    """JSON type of a field: object, array, string, boolean, number, null; SQL null if
    it isn't there."""
    v = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")
    )


def problem(raw: Column) -> Column:
    """Number of what is wrong with a record (see PROBLEMS), or null."""
    version, skipped, hashed, text = (_type(raw, f"$.{k}") for k in ("version", "_skipped", "bytes_hash", "text_path"))
    whole = F.try_parse_json(raw)
    is_skipped = F.coalesce(F.get_json_object(raw, "$._skipped") == "true", F.lit(False))
    return (
        F.when(whole.isNull(), 1).when(~F.schema_of_variant(whole).startswith("OBJECT"), 2)
        .when(version.isNull(), 3).when(version != "string", 4).when(F.get_json_object(raw, "$.version") != VERSION, 5)
        .when(skipped.isNotNull() & (skipped != "boolean"), 6)
        .when(~is_skipped & hashed.isNull(), 7).when(~is_skipped & (hashed != "string"), 8)
        .when(text.isNotNull() & ~text.isin("string", "null"), 9)
    )


def records(lines: DataFrame) -> DataFrame:
    """Typed columns of valid records: ``seq, raw, path, extension, text_path, skipped,
    has_path``. Refuses the run at the first bad line: one small aggregate."""
    checked = lines.withColumn("problem", problem(F.col("raw")))
    worst = checked.where("problem is not null").agg(F.min(F.struct("seq", "problem")).alias("w")).first()["w"]
    if worst is not None:
        raise Refusal("E_BAD_INPUT", f"line {worst['seq']}: {PROBLEMS[worst['problem']]}", {"line": worst["seq"], "error": PROBLEMS[worst["problem"]]})
    return typed(lines)


def typed(lines: DataFrame) -> DataFrame:
    raw = F.col("raw")
    string = lambda k: F.when(_type(raw, f"$.{k}") == "string", F.get_json_object(raw, f"$.{k}"))
    given, path = string("extension"), string("path")
    return lines.select(
        "seq", "raw", F.coalesce(path, F.lit("")).alias("path"), F.coalesce(S.ascii_lower(F.regexp_replace(given, r"^\.+", "")), S.extension(F.coalesce(path, F.lit("")))).alias("extension"),
        string("text_path").alias("text_path"), F.coalesce(F.get_json_object(raw, "$._skipped") == "true", F.lit(False)).alias("skipped"), path.isNotNull().alias("has_path"),
    )


def kind_of(extension: Column) -> Column:
    return (
        F.when(extension.isin("xlsx", "xls"), "xlsx").when(extension == "csv", "csv").when(extension == "pdf", "pdf").when(extension.isin("html", "htm"), "html")
        .when(extension.isin("md", "markdown"), "markdown").when(extension.isin("txt", "text"), "text").otherwise("unknown")
    )


def read_bytes(path: str) -> bytes:
    """A local path, or a URI that pyarrow's file systems know."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path) if parts.scheme else path, "rb") as f:
            return f.read()
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_stream(at) as f:
        return f.read()


def open_document(path: str, kind: str, text_path: str | None, base: str = "", csv_text: bool = False) -> dict:
    """The parsed parts of one document: view, sheets, pdf, error. CSV and PDF files are
    not touched until something asks for their content, so a missing one is no error."""
    at = path if not base or os.path.isabs(path) or "://" in path else os.path.join(base, path)
    out: dict = {"view": None, "sheets": None, "pdf": None, "error": None}
    try:
        if kind in ("markdown", "text"):
            out["view"] = view_of(kind, read_bytes(at).decode("utf-8"))
        elif kind == "html":
            out["view"] = view_of(kind, read_bytes(at).decode("utf-8", "replace"))
        elif kind == "xlsx":
            out["sheets"] = grids.xlsx_sheets(read_bytes(at))
        elif kind == "pdf":
            try:
                out["pdf"] = pdf.read_pdf(read_bytes(at)) | {"error": None}
            except (OSError, pdf.PdfError) as e:
                out["pdf"] = {"page_count": None, "info": [], "error": str(e)}
            if text_path is not None:
                out["view"] = view_of("markdown", read_bytes(text_path if not base or os.path.isabs(text_path) else os.path.join(base, text_path)).decode("utf-8"))
        elif kind == "unknown":
            read_bytes(at)
        if kind == "csv" or csv_text:
            stem = os.path.splitext(os.path.basename(path))[0] or None
            try:
                out["sheets"] = grids.csv_sheets(read_bytes(at).decode("utf-8", "replace"), stem)
            except OSError:
                out["sheets"] = []
    except (OSError, UnicodeDecodeError, grids.GridError) as e:
        out["error"] = str(e)
    return out


PARSED = f"struct<view:{VIEW},sheets:{grids.SHEETS},pdf:{pdf.PDF},error:string>"


def documents(recs: DataFrame, base: str = "", csv_text: bool = False) -> DataFrame:
    """Records with ``kind, view, sheets, pdf, error``. Files are read by the task that
    holds the record: no shuffle, each file once."""
    texts = ("txt", "text", "tsv", "dat")

    @F.pandas_udf(PARSED)
    def parse(paths: pd.Series, kinds: pd.Series, text_paths: pd.Series, exts: pd.Series) -> pd.DataFrame:
        rows = [open_document(p, k, t if isinstance(t, str) else None, base, csv_text and e in texts) for p, k, t, e in zip(paths, kinds, text_paths, exts, strict=True)]
        return pd.DataFrame({c: [r[c] for r in rows] for c in ("view", "sheets", "pdf", "error")})

    with_kind = recs.withColumn("kind", kind_of(F.col("extension")))
    parsed = F.when(~F.col("skipped") & F.col("has_path"), parse("path", "kind", "text_path", "extension"))
    return with_kind.withColumn("parsed", parsed).select(*with_kind.columns, "parsed.view", "parsed.sheets", "parsed.pdf", "parsed.error")


def corpus(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """All files of a folder, at any depth, with one of the extensions, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.where(S.extension(F.col("path")).isin(*extensions)).orderBy("path")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """JSON lines in order of seq; one file per range of it, whose names sort alike."""
    df.orderBy("seq").select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_file(df: DataFrame, out: io.TextIOBase, column: str = "value") -> None:
    """The same into one stream, partition by partition."""
    for row in df.orderBy("seq").select(column).toLocalIterator():
        out.write(row[0] + "\n")
