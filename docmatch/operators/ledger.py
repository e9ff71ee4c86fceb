"""The run ledger: JSON lines that are appended to and queried."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import scalars as S
from ..functions.blake3 import blake3_hex

FIELDS = ("id", "tool", "version", "binary_hash", "inputs", "params", "outcome", "exit_code", "output_hash", "ts")


class LedgerError(ValueError):
    """A line that isn't a record."""


def default_path() -> str:
    return os.environ.get("DOCMATCH_LEDGER") or str(Path.home() / ".docmatch" / "ledger.jsonl")


def record(inputs: list[tuple[str, bytes]], params: dict, outcome: str, exit_code: int, output: bytes, ts: str | None = None) -> dict:
    """A record whose id is the hash of its other fields in their order."""
    r = {
        "id": "", "tool": "docmatch", "version": __version__, "binary_hash": "blake3:" + blake3_hex(__version__.encode()),
        "inputs": [{"path": p, "hash": "blake3:" + blake3_hex(b), "bytes": len(b)} for p, b in inputs], "params": params, "outcome": outcome, "exit_code": exit_code,
        "output_hash": "blake3:" + blake3_hex(output), "ts": ts or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }
    r["id"] = "blake3:" + blake3_hex(json.dumps(r, ensure_ascii=False, separators=(",", ":")).encode())
    return r


def append(path: str | Path, row: dict) -> None:
    """One line, in a single write."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False, separators=(",", ":")) + "\n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, raw, tool, outcome, ts, hashes``; a missing file is empty, a bad line
    an error that names its number."""
    from ..sources.manifest import read_lines

    if "://" not in path and not os.path.exists(path):
        lines = spark.createDataFrame([], "seq long, raw string")
    else:
        lines = read_lines(spark, path).select("seq", "raw")
    worst = lines.where(F.try_parse_json("raw").isNull()).agg(F.min("seq")).first()[0]
    if worst is not None:
        raise LedgerError(f"line {worst} is not valid JSON")
    return columns(lines)


def columns(lines: DataFrame) -> DataFrame:
    field = lambda k: F.get_json_object("raw", f"$.{k}")
    return lines.select(F.col("seq").alias("line_no"), "raw", field("tool").alias("tool"), field("outcome").alias("outcome"), F.coalesce(field("ts"), field("created_ts")).alias("ts"), field("inputs[*].hash").alias("hashes"))


def query(rows: DataFrame, tool: str | None = None, since: str | None = None, until: str | None = None, outcome: str | None = None, input_hash: str | None = None) -> DataFrame:
    """Rows that pass all filters; time bounds are inclusive, and drop rows whose time
    can't be read."""
    for column, want in (("tool", tool), ("outcome", outcome)):
        if want is not None:
            rows = rows.where(F.col(column) == want)
    for bound, test in ((since, lambda a, b: a >= b), (until, lambda a, b: a <= b)):
        if bound is not None:
            rows = rows.where(F.coalesce(test(S.rfc3339(F.col("ts")), S.rfc3339(F.lit(bound))), F.lit(False)))
    if input_hash is not None:
        rows = rows.where(F.coalesce(F.contains("hashes", F.lit(input_hash)), F.lit(False)))
    return rows.orderBy("line_no")


def last(rows: DataFrame) -> str | None:
    return rows.agg(F.max_by("raw", "line_no")).first()[0]


def count(rows: DataFrame) -> int:
    return rows.count()
