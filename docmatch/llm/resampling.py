"""Quality classifier by importance resampling.

Two bag-of-hashed-n-grams models (words, word pairs and byte triples in 2 ** bits
buckets; all pairs of a word with itself share one) are estimated: one of the target text
(labelled good documents of a bounded sample), one of the raw text (all documents). A
document's log importance weight is the sum over its n-grams of log target / raw. Sums
grow with length, so the draw is stratified: documents compete in bands of n-gram counts
(powers of two). In each band Gumbel top-k at temperature 1 draws k documents without
replacement in proportion to their weights. k is the band's size times the share of
target documents among held-out labels; what those miss of a count over all documents of
the band (mean log weights above a cutoff) corrects it, which only lowers the variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

BITS = 16
#: Labelled documents used at most (by smallest hash of the id): half fit the target
#: model, half set k. The bound keeps the id list that is broadcast under 1 MB.
MAX_LABELLED = 40_000
MIN_HELD = 30

#: The bucket of pairs of equal words.
REPEAT = 0


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, pairs of neighbouring words and byte triples, and their
    documents."""
    shift = vec.U64(64 - bits)
    w = vec.Words(data, offsets)
    at, h = w.windows(2)
    pairs = (h >> shift).astype(np.int64)
    pairs[w.hash[at] == w.hash[at + 1]] = REPEAT
    buckets, docs = [(vec.mix(w.hash) >> shift).astype(np.int64), pairs], [w.doc, w.doc[at]]
    if len(data) >= 3:
        b = data.astype(np.uint32)
        triples = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        buckets.append(((triples[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64))
        docs.append(doc[:-2][inside])
    return np.concatenate(buckets), np.concatenate(docs)


def tallied(data: np.ndarray, bits: int = BITS, limit: int | None = None) -> np.ndarray:
    """Counts of all buckets of one long text, by pieces."""
    total = np.zeros(1 << bits, np.int64)
    one = lambda x: np.bincount(features(x, np.array([0, len(x)]), bits)[0], minlength=1 << bits)
    for start, end, then in vec.pieces(data, 1, limit):
        total += one(data[start:end])
        if then < end:
            total -= one(data[then:end])  # the word that the next piece begins with
    return total


def _count_batches(bits: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            data, offsets = vec.utf8(b.column(0))
            target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in vec.chunks(offsets):
                if offsets[hi] - offsets[lo] > vec.PIECE_BYTES:
                    own = tallied(data[offsets[lo] : offsets[hi]], bits)
                    total[0] += own
                    total[1] += own * int(target[lo])
                    continue
                f, d = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
                total[0] += np.bincount(f, minlength=1 << bits)
                total[1] += np.bincount(f[target[lo:hi][d]], minlength=1 << bits)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    return count


def _score_batches(ratio: np.ndarray, bits: int, also: tuple[str, ...] = ()) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.utf8(b.column(1))
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lo, hi in vec.chunks(offsets):
                if offsets[hi] - offsets[lo] > vec.PIECE_BYTES:
                    own = tallied(data[offsets[lo] : offsets[hi]], bits)
                    total[lo], n[lo] = own @ ratio, own.sum()
                    continue
                f, d = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
                total[lo:hi] = np.bincount(d, weights=ratio[f], minlength=hi - lo)
                n[lo:hi] = np.bincount(d, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), *b.columns[2:]], names=["doc_id", "n_features", "log_weight", *also])

    return score


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    size = len(raw)
    p = np.log((target + smoothing) / (target.sum() + smoothing * size))
    return p - np.log((raw + smoothing) / (raw.sum() + smoothing * size))


def best_cutoff(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The score above which the shares of good documents kept and bad ones rejected
    have the largest sum; None unless both kinds are there."""
    if not good.any() or good.all():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    gain = caught - lost
    gain[1:-1][w[1:] == w[:-1]] = -1.0  # equal weights aren't parted
    i = int(np.argmax(gain))
    if i == 0:
        return -np.inf
    return float((w[i - 1] + w[i]) / 2) if i < len(w) else np.inf


def gumbel(doc_id: str, seed: int) -> F.Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


#: Bits of a rank key that one round of the selection settles, and rounds.
DIGIT, ROUNDS = 12, 4


def kth_largest(df: DataFrame, group: str, key: str, ks: dict[int, int]) -> dict[int, int]:
    """Per group (under 64 of them) the ks-th largest value of a long column in
    [0, 2 ** 48). Radix selection: each of the rounds sends at most 4,096 counts of a
    group to the driver, whatever the number of rows."""
    found, need = dict.fromkeys(ks, 0), dict(ks)
    if not ks:
        return found
    for step in range(ROUNDS):
        shift = DIGIT * (ROUNDS - 1 - step)
        prefix = F.create_map(*[F.lit(x).cast("long") for g in found.items() for x in g])
        part = df.where(F.shiftright(F.col(key), shift + DIGIT) == F.element_at(prefix, F.col(group)))
        digits: dict[int, list[tuple[int, int]]] = {}
        for g, d, n in part.groupBy(group, F.shiftright(F.col(key), shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("d")).count().collect():
            digits.setdefault(g, []).append((int(d), n))
        for g, counts in digits.items():
            for d, n in sorted(counts, reverse=True):
                if n >= need[g]:
                    found[g] = found[g] << DIGIT | d
                    break
                need[g] -= n
    return found


def shares(k: int, sizes: dict[int, int]) -> dict[int, int]:
    """k split over the bands in proportion to their sizes; the parts sum to k."""
    out, seen, given, total = {}, 0, 0, sum(sizes.values())
    for b, n in sorted(sizes.items()):
        seen += n
        out[b] = k * seen // total - given
        given += out[b]
    return out


def quality_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 7, bits: int = BITS, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_features, log_weight, score, band, gumbel_key,
    kept``; score is the mean log weight of an n-gram. with_digest: also ``text_sha256``,
    which tells rows of one id (or none) apart.

    k: documents to draw, split over the bands by their sizes; None: the estimated number
    of target documents of each band. temperature scales the noise (0: the plain top k
    by weight). A null or empty text has weight 0. Rows whose keys agree to 2 ** -16
    (copies of one id) stay or go together, so k may be exceeded by them. Without labels
    of both kinds nothing is rejected. Labels with a null id or quality aren't used; a
    toxic label never counts as target of the model.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    hashed = F.xxhash64(F.lit(seed + 1), F.col("doc_id"))
    sample = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), toxic.cast("int").alias("toxic"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .withColumn("h", hashed).orderBy("h", "doc_id").limit(max_labelled)
        .select("doc_id", (F.col("quality") == 1).alias("good"), "toxic", (F.col("h") % 2 == 0).alias("fit"))
    )
    sample = common.table(sample.coalesce(1), "labels")
    fit = F.broadcast(sample.where("fit and good and toxic = 0").select("doc_id", F.lit(True).alias("t")))  # at most max_labelled rows
    marked = src.join(fit, "doc_id", "left").select("text", F.coalesce("t", F.lit(False)).alias("t"))
    tallies = marked.mapInArrow(_count_batches(bits), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    pdf = tallies.toPandas()  # at most 2 ** bits rows
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[pdf["bucket"]], target[pdf["bucket"]] = pdf["raw"], pdf["target"]
    ratio = log_ratio(raw, target) if target.sum() else np.zeros(1 << bits)

    also = ("text_sha256",) if with_digest else ()
    keyed = src.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)) if with_digest else src
    scored = keyed.mapInArrow(_score_batches(ratio, bits, also), "doc_id long, n_features long, log_weight double" + "".join(f", {c} string" for c in also))
    noise = gumbel("doc_id", seed) if temperature else F.lit(0.0)
    scored = scored.withColumn("score", F.col("log_weight") / F.greatest("n_features", F.lit(1))).withColumn("band", F.floor(F.log2(F.col("n_features") + 1)))
    scored = common.table(scored.withColumn("gumbel_key", F.col("log_weight") + F.lit(float(temperature)) * noise), "scores")
    held = scored.join(F.broadcast(sample.where("not fit")), "doc_id").select("band", "score", "good").toPandas()  # at most max_labelled ids
    cutoff = best_cutoff(held["score"].to_numpy(), held["good"].to_numpy().astype(bool)) if len(held) else None
    if k is None and cutoff is None:
        return scored.withColumn("kept", F.lit(True))
    above = F.sum((F.col("score") >= F.lit(float(cutoff if cutoff is not None else 0.0))).cast("long"))
    bands = {r[0]: (r[1], r[2]) for r in scored.groupBy("band").agg(F.count(F.lit(1)), above).collect()}  # under 64 rows
    sizes = {b: n for b, (n, _) in bands.items()}
    draw = target_counts(bands, held, cutoff) if k is None else shares(min(k, sum(sizes.values())), sizes)
    # fixed-point keys, so that their order is that of unsigned digits
    key = F.greatest(F.lit(0.0), F.least(F.lit(float(2**48 - 1)), F.round(F.col("gumbel_key") * F.lit(65536.0)) + F.lit(float(1 << 47)))).cast("long")
    ranked = scored.withColumn("rank_key", key)
    cuts = kth_largest(ranked, "band", "rank_key", {b: x for b, x in draw.items() if 0 < x < sizes[b]})
    least = {b: cuts.get(b, 0 if x else 1 << 48) for b, x in draw.items()}
    if not least:
        return scored.withColumn("kept", F.lit(True))
    limit = F.create_map(*[F.lit(x).cast("long") for b in least.items() for x in b])
    return ranked.withColumn("kept", F.col("rank_key") >= F.element_at(limit, F.col("band"))).drop("rank_key")


def target_counts(bands: dict[int, tuple[int, int]], held: pd.DataFrame, cutoff: float) -> dict[int, int]:
    """bands: documents, and those whose score reaches the cutoff. The estimated number
    of target documents in each band: the second count, plus the band's size times the
    mean of (good - reaches the cutoff) over its held-out labels. Where a band has under
    ``MIN_HELD`` labels that mean is taken over all bands."""
    miss = held["good"].astype(float) - (held["score"] >= cutoff)
    by_band = miss.groupby(held["band"]).agg(["mean", "size"])
    out = {}
    for b, (n, above) in bands.items():
        own = b in by_band.index and by_band.loc[b, "size"] >= MIN_HELD
        out[b] = int(min(n, max(0, round(above + n * (by_band.loc[b, "mean"] if own else miss.mean())))))
    return out
