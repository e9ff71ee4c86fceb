"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, target / size of the
source. Documents are put in one order within their source (by size, then id), the
expected copies are prefix-summed, one offset per source is added, and a document is
taken once per integer boundary that its interval crosses. Sorting by size makes the
words taken follow the target closely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def offset_expr(rank: str, seed: int) -> str:
    """The offset of the rank-th source, in [0, 1) in steps of 2 ** -16."""
    return f"((({rank} + {seed}) * 40503) % 65536) / 65536.0D"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds ``source_rank`` (by code point, null last),
    ``weight`` and ``target``. A target stops at cap x size; the excess is shared by
    weight again. With the sources in order of cap x size / weight, those that stop are
    a prefix, so one pass of running sums settles it. One row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights)).cast("int") + 1)
    s = sizes.withColumn("source_rank", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", w)
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("w_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.col("used")) / (F.sum("weight").over(whole) - F.col("w_used")))
    stops = F.col("limit") <= F.col("level") * F.col("weight")
    # the first source that doesn't stop sets the level of all that follow
    first = F.min(F.when(~stops, F.struct(F.col("limit") / F.col("weight"), F.col("source_rank"), F.col("level")))).over(whole)
    return s.withColumn("target", F.when(stops, F.col("limit")).otherwise(first["level"] * F.col("weight"))).select("source", "source_rank", "source_size", "target")


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, source``.

    Size is the number of words; a null text has none and so takes none. A null source
    is a source of its own, the last; a null id is the smallest. Repeated rows are
    separate documents. With no words at all every target is 0. Results depend on the
    rows alone, not on their order or partitions.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0))), F.lit(0))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.greatest(size, F.lit(0)).cast("long").alias("size"))
    # texts are read once; the range partitions are cut from a table of sizes
    sized = common.table(sized, "words")
    # a range partition holds one stretch of the order, so a hot source spans many
    ranged = sized.repartitionByRange(common.n_partitions(spark), F.col("source").asc_nulls_last(), "size", "doc_id")
    runs = common.table(ranged.withColumn("run", F.spark_partition_id()), "sizes")
    per_run = runs.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("run_size"))
    goal = targets(per_run.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("source", "run", "before")
    plan = per_run.join(goal, per_run["source"].eqNullSafe(goal["source"])).select(per_run["source"].alias("p_source"), F.col("run").alias("p_run"), "before", "source_rank", "source_size", "target")
    inside = Window.partitionBy("run", "source").orderBy("size", "doc_id")
    placed = runs.withColumn("place", F.row_number().over(inside))
    j = placed.join(plan, (F.col("run") == F.col("p_run")) & F.col("source").eqNullSafe(F.col("p_source")))
    j = j.withColumn("at", (F.col("before") + F.col("place")).cast("double"))
    j = j.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", F.expr(offset_expr("source_rank", seed)))
    copies = F.floor(F.col("at") * F.col("each") + F.col("offset")) - F.floor((F.col("at") - 1.0) * F.col("each") + F.col("offset"))
    j = j.withColumn("copies", F.least(copies, F.lit(cap)).cast("long"))
    return j.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
sizes AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_rank FROM sizes),
weighted AS (SELECT *, CASE source_rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS lim FROM ranked),
running AS (
  SELECT *, lim / weight AS ratio,
    COALESCE(SUM(lim) OVER (ORDER BY lim / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    COALESCE(SUM(weight) OVER (ORDER BY lim / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_used,
    CAST(SUM(source_size) OVER () AS DOUBLE) AS total, SUM(weight) OVER () AS w_total FROM weighted),
leveled AS (SELECT *, (total - used) / (w_total - w_used) AS lev FROM running),
marked AS (SELECT *, lim <= lev * weight AS stops FROM leveled),
goal AS (SELECT source, source_rank, source_size,
    CASE WHEN stops THEN lim ELSE (SELECT arg_min(lev, struct_pack(a := ratio, b := source_rank)) FROM marked WHERE NOT stops) * weight END AS target FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized),
joined AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.source, CAST(p.place AS DOUBLE) AS at_,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each_,
    (((g.source_rank + 11) * 40503) % 65536) / 65536.0::DOUBLE AS off_
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source),
copied AS (SELECT *, CAST(LEAST(floor(at_ * each_ + off_) - floor((at_ - 1.0) * each_ + off_), 3) AS BIGINT) AS copies FROM joined)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM copied
"""
