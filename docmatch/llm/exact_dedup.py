"""Exact dedup by a tree merge of sorted digest runs.

Every partition holds a run of (SHA-256, length, best identifier, count), sorted by
digest. In each binomial round a partition splits its run by the next digit of the
digest, hands the parts to the partitions that differ from it in that digit alone, and
merges what it receives, retaining one entry per digest. After the last round each
digest lives in one place; a digest with any number of copies never has more entries
in a task than the fan-in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAN_IN_BITS = 3
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("length", "<i8"), ("known", "i1"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])


def merge_runs(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run with one entry per digest: the best identifier and the sum of the
    counts. Entries are the same text only if digest and byte length both agree."""
    a = np.concatenate(runs) if runs else np.zeros(0, ENTRY)
    if not len(a):
        return a
    sign = 1 if largest else -1
    order = np.lexsort((-a["row"] * sign, -a["id"] * sign, -a["known"].astype(np.int8), a["length"], a["d3"], a["d2"], a["d1"], a["d0"]))
    a = a[order]
    at = common.group_starts(a["d0"], a["d1"], a["d2"], a["d3"], a["length"])
    out = a[at].copy()
    out["count"] = np.add.reduceat(a["count"], at)
    return out


def _first(rank_bits: int, largest: bool) -> Callable:
    """The run of one partition of documents, with the partition's rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank = TaskContext.get().partitionId() % (1 << rank_bits)
        runs = []
        for b in batches:
            a = np.zeros(b.num_rows, ENTRY)
            sha = b.column(0).to_pylist()
            d = np.frombuffer(b"".join(sha), ">u8").reshape(-1, 4).astype("<u8")
            for k in range(4):
                a[f"d{k}"] = d[:, k]
            a["length"], a["row"], a["count"] = b.column(1).to_numpy(), b.column(3).to_numpy(), 1
            ids = b.column(2)
            a["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            a["id"] = ids.fill_null(0).to_numpy()
            runs.append(merge_runs([a], largest))
        yield from _split(merge_runs(runs, largest), rank, rank_bits, 0)

    return run


def _digit(a: np.ndarray, rank_bits: int, k: int) -> tuple[np.ndarray, int, int]:
    """The k-th digit of the rank that holds each entry in the end: its value, its
    width, and the number of bits below it."""
    low = FAN_IN_BITS * k
    width = min(FAN_IN_BITS, rank_bits - low)
    below = rank_bits - low - width
    goal = a["d0"].astype(np.uint64) >> np.uint64(64 - rank_bits)
    return ((goal >> np.uint64(below)) & np.uint64((1 << width) - 1)).astype(np.int64), width, below


def _split(a: np.ndarray, rank: int, rank_bits: int, k: int) -> Iterator[pa.RecordBatch]:
    digit, width, below = _digit(a, rank_bits, k)
    keep = rank & ~(((1 << width) - 1) << below)
    dest, body = [], []
    for v in range(1 << width):
        part = a[digit == v]
        if len(part):
            dest.append(keep | (v << below))
            body.append(part.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(body, pa.binary())], names=["dest", "run"])


def _round(rank_bits: int, k: int, last: bool, largest: bool) -> Callable:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, rank = [], None
        for b in batches:
            for d, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rank = d
                runs.append(np.frombuffer(r, ENTRY))
        a = merge_runs(runs, largest)
        if not last:
            if rank is not None:
                yield from _split(a, rank, rank_bits, k + 1)
            return
        a = a[a["count"] > 1]
        sha = np.stack([a[f"d{j}"] for j in range(4)], 1).astype(">u8").tobytes() if len(a) else b""
        yield pa.RecordBatch.from_arrays(
            [pa.array([sha[i : i + 32].hex() for i in range(0, len(sha), 32)], pa.string()), pa.array(a["length"], pa.int64()), pa.array(a["id"], pa.int64(), mask=a["known"] == 0), pa.array(a["row"], pa.int64()), pa.array(a["count"], pa.int64())],
            names=["g_sha256", "g_length", "g_keep", "g_row", "g_size"],
        )

    return step


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared as they are; null counts as empty. Of equal texts the row with
    the largest (or ``keep="smallest"``) id stays; a null id only if there is no other;
    of rows that repeat both text and id exactly one stays. Empty tables give an empty
    result; other columns aren't read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    largest = keep == "largest"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = common.table(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    rank_bits = max(FAN_IN_BITS, (common.n_partitions(spark) - 1).bit_length())
    rounds = -(-rank_bits // FAN_IN_BITS)
    runs = rows.select(F.unhex("text_sha256").alias("sha"), "n_bytes", "doc_id", "row").mapInArrow(_first(rank_bits, largest), "dest int, run binary")
    for k in range(rounds):
        last = k == rounds - 1
        schema = "g_sha256 string, g_length long, g_keep long, g_row long, g_size long" if last else "dest int, run binary"
        runs = runs.repartitionById(1 << rank_bits, F.col("dest")).mapInArrow(_round(rank_bits, k, last, largest), schema)
    j = rows.join(runs, (F.col("text_sha256") == F.col("g_sha256")) & (F.col("n_bytes") == F.col("g_length")), "left")
    single = F.col("g_size").isNull()
    return j.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"), F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("g_row"))).alias("kept"), "text_sha256",
    )


ORACLE_SQL = """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
  doc_id = MAX(doc_id) OVER w AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY COALESCE(text, ''))
"""
