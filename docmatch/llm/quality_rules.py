"""Quality rules with risk-controlled thresholds.

Each rule compares one signal of a text with a cutoff. Cutoffs are not given but
selected, per stratum (language), on labelled documents. One half of them gives a path:
from no rule at all, one cutoff after another is tightened, each time the one that
rejects most further bad documents for the good ones it rejects. The other half, held
out, is tested along that path: a step stands if the exact (Clopper-Pearson) upper bound
on the share of good documents that all its cutoffs together reject is within the risk,
and the first step that doesn't ends it. As a fixed sequence of tests needs no division
of the error, only the number of strata divides it (Bonferroni). Strata with too few
labels for any verdict are tested together as one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Signals, all "the larger the worse", computed from the integer columns.
RULES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1) - 5",
    "short_words": "5 - word_chars / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(n_words, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
}
GRID = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0],
    "dup_line_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_rate": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "long_words": [1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0, 10.0, 20.0],
    "short_words": [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5],
    "upper_rate": [0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0],
    "mark_rate": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0],
}
#: What a share of good documents rejected counts against the same share of bad ones.
PRICE = 5.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def _dup_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, w: vec.Words) -> np.ndarray:
    """Lines of each document that are equal to an earlier one. Equal hashes only
    propose; bytes decide."""
    key = vec.mix(w.range_hash(starts, ends) + (doc.astype(vec.U64) + vec.U64(1)) * vec.BASE)
    order = np.argsort(key, kind="stable")
    first = order[common.group_starts(key[order])][common.spread(common.group_starts(key[order]), len(order))] if len(order) else order
    later = order != first
    line, like = order[later], first[later]
    raw = data.tobytes()
    same = [raw[a:b] == raw[c:d] and i == j for a, b, c, d, i, j in zip(*(x.tolist() for x in (starts[line], ends[line], starts[like], ends[like], doc[line], doc[like])), strict=True)]
    out = np.bincount(doc[line], minlength=w.n_docs)
    for d in np.unique(doc[line[~np.array(same, bool)]]):  # hashes that lie: count that document's lines themselves
        own = np.flatnonzero(doc == d)
        out[d] = len(own) - len({raw[starts[i] : ends[i]] for i in own})
    return out


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = vec.Words(data, offsets)
    out = _sums(w)
    # lines with a word; a line is equal to an earlier one if its bytes are
    n, breaks = len(data), np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < n]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], offsets[line_doc + 1])
    solid = np.concatenate(([0], np.cumsum(w.solid)))
    has = solid[ends] > solid[starts]
    starts, ends, line_doc = starts[has], ends[has], line_doc[has]
    out["n_dup_lines"] = _dup_lines(data, starts, ends, line_doc, w)
    out["n_lines"] = np.bincount(line_doc, minlength=w.n_docs)
    at, h = w.windows(3)
    often = at[vec.repeated(w.doc[at], h) > 1]
    mark = np.zeros(len(w.start) + 3, bool)
    for k in range(3):
        mark[often + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[mark[: len(w.doc)]], minlength=w.n_docs)
    return out


def _sums(w: vec.Words) -> dict[str, np.ndarray]:
    """What is counted word by word or sign by sign."""
    data = w.data
    marks = (data == 33) | (data == 63) | (data == 64) | (data == 95) | (data == 61) | (data == 123) | (data == 125)
    return {
        "n_words": w.counts(), "word_chars": w.per_doc(w.solid & ((data & 0xC0) != 0x80)), "n_symbols": w.per_doc(SYMBOLS[data]),
        "n_upper": w.per_doc((data >= 65) & (data <= 90)), "n_marks": w.per_doc(marks),
    }


def long_counts(data: np.ndarray, limit: int | None = None) -> dict[str, np.ndarray]:
    """The counts of one long text, by pieces."""
    sums, hashes = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_upper", "n_marks"), 0), []
    one = lambda a, b: vec.Words(data[a:b], np.array([0, b - a]))
    for start, end, then in vec.pieces(data, 2, limit):
        w = one(start, end)
        hashes.append(w.windows(3)[1])
        for k, v in _sums(w).items():
            sums[k] += int(v[0])
        if then < end:  # the words that the next piece begins with
            for k, v in _sums(one(then, end)).items():
                sums[k] -= int(v[0])
    h = np.concatenate(hashes)
    order = np.argsort(h)
    starts = common.group_starts(h[order])
    size = np.diff(np.append(starts, len(h)))
    mark = np.zeros(len(h) + 3, bool)
    often = order[np.repeat(size > 1, size)]
    for k in range(3):
        mark[often + k] = True
    seen, lines, at = set(), 0, 0
    body = data.tobytes()
    while at <= len(body):
        stop = body.find(b"\n", at)
        stop = len(body) if stop < 0 else stop
        line = body[at:stop]
        if line.strip(b" \t\n\x0b\x0c\r"):
            lines += 1
            seen.add(hashlib.blake2b(line, digest_size=16).digest())
        at = stop + 1
    out = sums | {"n_dup_lines": lines - len(seen), "n_lines": lines, "n_repeat_words": int(mark.sum())}
    return {k: np.array([v]) for k, v in out.items()}


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = vec.utf8(b.column(b.num_columns - 1))
        parts = []
        for lo, hi in vec.chunks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            parts.append(long_counts(part) if len(part) > vec.PIECE_BYTES else _counts(part, offsets[lo : hi + 1] - offsets[lo]))
        cols = [b.column(i) for i in range(b.num_columns - 1)]
        for c in COUNTS:
            cols.append(pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0), pa.int64()))
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], *COUNTS])


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id, stratum and the integer columns of ``COUNTS``. A null
    or empty text has zeros. Other columns of docs aren't read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_stats_batches, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rejection rate p for which k or fewer of n good
    documents would be rejected with a probability of at least ``error``."""
    if n == 0 or k >= n:
        return 1.0
    # from k down; above k / n the terms fall, after 12 deviations below any precision
    j = k - np.arange(min(k, int(12 * math.sqrt(k)) + 50) + 1)
    comb = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + np.concatenate(([0.0], np.cumsum(np.log(j[:-1] / (n - j[:-1] + 1)))))
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p >= 1.0:
            break
        terms = comb + j * np.log(max(p, 1e-300)) + (n - j) * np.log1p(-p)
        top = terms.max()
        if np.exp(top) * np.exp(terms - top).sum() > error:
            lo = p
        else:
            hi = p
    return hi


NAMES = list(RULES)
#: The group of all strata that have no cutoffs of their own.
OTHERS = -1
#: Per rule a signal that exceeds as many of its cutoffs as the index says.
LEVELS = np.array([[*GRID[r], np.inf] for r in NAMES])


def tightening_path(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float) -> list[tuple[int, int]]:
    """Steps (rule, index of its cutoff in the grid) from labelled documents: always the
    one whose further rejections have the largest share of bad less ``PRICE`` times the
    share of good documents, while it is above 0 and at most half the risk is used up.
    levels: how many cutoffs of each rule are exceeded, a row for each combination; good,
    bad: how many documents have it."""
    n_bad, n_good = max(1, int(bad.sum())), max(1, int(good.sum()))
    gone, at, path = 0, [len(GRID[r]) for r in NAMES], []
    while True:
        best, step = 0.0, None
        for r, limit in enumerate(at):
            # documents at each level and above it
            more_good, more_bad = (np.bincount(levels[:, r], x, len(GRID[NAMES[r]]) + 1)[::-1].cumsum()[::-1] for x in (good, bad))
            for c in range(limit):
                gain = int(more_bad[c + 1]) / n_bad - PRICE * int(more_good[c + 1]) / n_good
                if gone + int(more_good[c + 1]) <= risk / 2 * n_good and gain > best + 1e-12:
                    best, step = gain, (r, c)
        if step is None:
            return path
        path.append(step)
        at[step[0]] = step[1]
        hit = levels[:, step[0]] > step[1]
        gone += int(good[hit].sum())
        levels, good, bad = levels[~hit], good[~hit], bad[~hit]


def tested(path: list[tuple[int, int]], signals: np.ndarray, risk: float, error: float, count: np.ndarray | None = None) -> dict[str, float]:
    """The cutoffs after the last step of the path before the first whose bound on the
    rejected share of the held-out good documents exceeds the risk. count: how many of
    these have each row of signals, one without it."""
    count = np.ones(len(signals), np.int64) if count is None else count
    gone, out = np.zeros(len(signals), bool), {}
    for r, c in path:
        gone |= signals[:, r] > GRID[NAMES[r]][c]
        if upper_bound(int(count[gone].sum()), int(count.sum()), error) > risk:
            break
        out[NAMES[r]] = GRID[NAMES[r]][c]
    return out


def _selected(risk: float, error: float):
    """Cutoffs of a group from its combinations of levels (a digit for each rule) and
    what is counted of each."""

    def run(group: pa.Table) -> pa.Table:
        code, good, bad, held = (group.column(c).to_numpy() for c in ("code", "good", "bad", "held"))
        levels = code[:, None] // 10 ** np.arange(len(NAMES)) % 10
        cut = tested(tightening_path(levels, good, bad, risk), LEVELS[np.arange(len(NAMES)), levels], risk, error, held)
        columns = [pa.array([cut.get(r)], pa.float64()) for r in NAMES]
        return pa.Table.from_arrays([pa.array([group.column("group")[0].as_py()], pa.int32()), *columns], names=["group", *NAMES])

    return run


def select_cutoffs(found: DataFrame, risk: float, confidence: float, max_strata: int) -> tuple[dict[str | None, dict[str, float]], dict[str, float]]:
    """found: of each labelled document its stratum, whether it is good, whether it gives
    the path or tests it (``fit``), and its signals. Cutoffs by stratum, and those of all
    other strata. At most ``max_strata`` strata, those with most good documents to test,
    have cutoffs of their own, and only if a step that rejects none of these would stand;
    all others are pooled. Documents are counted by the cutoffs that they exceed: no more
    than 1.9 million combinations a group (no word length exceeds cutoffs of both of its
    rules), whatever the number of documents; a group's are in one task."""
    code = sum((10**i * sum((F.col(r) > c).cast("int") for c in GRID[r]) for i, r in enumerate(NAMES)), F.lit(0))
    count = lambda x, name: F.count(F.when(x, 1)).alias(name)
    good, fit = F.col("good"), F.col("fit")
    cells = common.table(found.groupBy("stratum", code.cast("int").alias("code")).agg(count(fit & good, "good"), count(fit & ~good, "bad"), count(~fit & good, "held")), "levels")
    strata = cells.groupBy("stratum").agg(F.sum("held").alias("n"))
    error = (1 - confidence) / (min(strata.count(), max_strata) + 1)
    ranked = strata.orderBy(F.col("n").desc(), F.col("stratum").asc_nulls_last()).limit(max_strata).collect()
    own = [r["stratum"] for r in ranked if upper_bound(0, r["n"], error) <= risk]
    groups = F.broadcast(cells.sparkSession.createDataFrame(list(enumerate(own)), "group int, stratum_key string"))  # at most max_strata rows
    placed = cells.join(groups, F.col("stratum").eqNullSafe(F.col("stratum_key")), "left").groupBy(F.coalesce("group", F.lit(OTHERS)).alias("group"), "code")
    counted = placed.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "held")])
    made = counted.groupBy("group").applyInArrow(_selected(risk, error), "group int, " + ", ".join(f"{r} double" for r in NAMES)).collect()
    cutoffs = {r["group"]: {n: r[n] for n in NAMES if r[n] is not None} for r in made}
    return {s: cutoffs[i] for i, s in enumerate(own)}, cutoffs.get(OTHERS, {})


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.1, confidence: float = 0.95, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality", max_strata: int = 1000) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``kept``, ``stratum``,
    ``failed_rules`` and ``n_rules`` (rules that its stratum has a cutoff for).

    risk: the largest share of good documents that all selected cutoffs together may
    reject in a stratum, at ``confidence`` for all strata together. All labels are used
    but those with a null id or quality, or of no document; several labels of one id count
    as its largest. A null stratum is one of its own. Strata without enough labels, and all
    beyond the ``max_strata`` with most, share the cutoffs of their pool. Without labels, or
    without bad ones, no rule is applied. Repeated rows give repeated results; empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    stats = common.table(signals(docs, id_col, text_col, stratum_col), "signals")
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    named = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(quality_col) == 1).alias("good"))
    named = named.withColumn("fit", F.xxhash64(F.lit(11), "doc_id") % 2 == 0)
    rules = [F.expr(e).cast("double").alias(r) for r, e in RULES.items()]
    found = stats.where(f"not ({base})").join(named, "doc_id").select("doc_id", "good", "fit", "stratum", *rules)
    # one row of each labelled id
    found = found.groupBy("doc_id", "good", "fit").agg(F.min(F.struct("stratum", *NAMES)).alias("x")).select("good", "fit", "x.*")
    cutoffs, pool = select_cutoffs(found, risk, confidence, max_strata)
    rows = [(s, True, *[c.get(x) for x in NAMES]) for s, c in cutoffs.items()]
    schema = "stratum_key string, named boolean, " + ", ".join(f"cut_{r} double" for r in RULES)
    cuts = F.broadcast(spark.createDataFrame(rows, schema))  # at most max_strata rows
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("stratum_key")), "left")
    cut = {r: F.when(F.col("named"), F.col(f"cut_{r}")).otherwise(F.lit(pool.get(r)).cast("double")) for r in NAMES}
    failed = F.filter(F.array(*[F.when(F.expr(e) > cut[r], F.lit(r)) for r, e in RULES.items()]), lambda x: x.isNotNull())
    n_rules = sum((cut[r].isNotNull().cast("int") for r in NAMES), F.lit(0))
    out = joined.withColumn("base_failed", F.expr(base)).withColumn("failed_rules", F.concat_ws(",", failed)).withColumn("n_rules", n_rules)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "stratum", "failed_rules", "n_rules",
    )
