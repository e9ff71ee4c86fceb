"""Hybrid search: BM25 and hashed-embedding cosine, fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

DIM = 384
SEED = 42
K1, B = 1.2, 0.75
LEAST_COSINE = 0.25


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inverted index: ``id, term, tf, length``."""
    t = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("ts"))
    return t.select("id", F.size("ts").alias("length"), F.explode("ts").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def lexical(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, bm25`` of the documents with a term of the query. Only the query's terms are
    looked for: one scan and one small aggregate per document, no index is shuffled."""
    wanted = sorted({t for t in query.lower().replace("_", " ").split() if t})
    words = sorted(set().union(*[_python_terms(w) for w in wanted])) if wanted else []
    d = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("ts"))
    counts = [F.size(F.filter("ts", _equals(w))).alias(f"tf{i}") for i, w in enumerate(words)]
    d = d.select("id", F.size("ts").alias("length"), *counts)
    facts = d.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    j = d.crossJoin(F.broadcast(facts))  # facts is a single row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("avg"), F.lit(1e-9))))
    return j.select("id", score.alias("bm25")).where("bm25 > 0")


def _equals(word: str):
    return lambda t: t == word


def _python_terms(text: str) -> set[str]:
    import regex

    return {t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}


def embedding(text: Column, dim: int = DIM) -> Column:
    """Unit vector of hashed signed term counts."""
    ts = terms(text)
    slot = lambda t: F.pmod(F.xxhash64(F.lit(SEED), t), F.lit(dim)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), t), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = F.transform(ts, lambda t: F.struct(slot(t).alias("s"), sign(t).alias("w")))
    vector = S.let(pairs, lambda pairs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(pairs, lambda p: p["s"] == i), F.lit(0.0), lambda a, p: a + p["w"])))
    # each computed once: an expression in a lambda's body would run for every element
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))
    return S.let(vector, lambda v: S.let(length(v), lambda n: scaled(v, n)))


def ranked(hits: DataFrame, score: str, rank: str) -> DataFrame:
    """0-based rank by score, then id; hits are those of one query. Range partitions are
    sorted by themselves, and the hits of the partitions before are added: no task sees
    all hits. Cached, so that both uses see the same ranges."""
    order = (F.desc(score), F.col("id"))
    ranged = hits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))  # a row per partition
    placed = ranged.join(F.broadcast(before), part == F.col("_p"))
    return placed.withColumn(rank, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b")).drop("_m", "_p", "_b")


def fuse(lexical_hits: DataFrame, semantic_hits: DataFrame, k: int | None = None) -> DataFrame:
    """Full outer join of (id, bm25) and (id, cosine) on id with reciprocal-rank fusion,
    by fused score, then lexical score, then id."""
    a, b = ranked(lexical_hits, "bm25", "lexical_rank"), ranked(semantic_hits.where("cosine > 0 and not isnan(cosine)"), "cosine", "semantic_rank")
    j = a.join(b, "id", "full")
    fused = j.withColumn("fused", S.reciprocal_rank(F.col("lexical_rank")) + S.reciprocal_rank(F.col("semantic_rank")))
    out = fused.orderBy(F.desc("fused"), F.desc_nulls_last("bm25"), "id")
    return out if k is None else out.limit(k)


def search(docs: DataFrame, query: str, k: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    q = docs.sparkSession.range(1).select(embedding(F.lit(query)).alias("q"))
    vectors = docs.select(F.col(id_col).alias("id"), embedding(F.col(text_col)).alias("v"))
    semantic = vectors.crossJoin(F.broadcast(q)).select("id", S.cosine(F.col("v"), F.col("q")).alias("cosine"))  # q is a single row
    return fuse(lexical(docs, query, id_col, text_col), semantic, k)


def support(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Documents that the query finds by a word or by nearness."""
    hits = search(docs, query, None, id_col, text_col)
    return hits.where(F.col("lexical_rank").isNotNull() | (F.col("cosine") >= LEAST_COSINE)).count()
