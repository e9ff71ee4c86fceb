"""Reports over output records: family summaries, parity with earlier routes, and the
routes that a consumer sees. All are joins and aggregates of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What the reports read of an output record.
RECORD = (
    "version string, path string, outcome string, _skipped boolean, refusal struct<code:string>, template struct<template_id:string,matched:boolean,reason:string,"
    "assertions:array<struct<name:string,passed:boolean>>,child_routing:struct<status:string,selected_child_template_id:string,matched_child_count:int,evaluated_child_count:int>>"
)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, RECORD).alias("r")).select("r.*")


def with_inventory(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """Records with the family of their path; unknown paths are of family 'unknown'."""
    return records.join(inventory.select("path", F.col("family").alias("known")), "path", "left").withColumn("family", F.coalesce("known", F.lit("unknown"))).drop("known")


def status(records: DataFrame) -> DataFrame:
    refused, skipped = F.col("outcome").eqNullSafe("REFUSAL"), F.coalesce("_skipped", F.lit(False))
    child = F.col("template.child_routing.status")
    s = (
        F.when(refused, "refusal").when(skipped, "skipped").when(~F.coalesce("template.matched", F.lit(False)), "unmatched")
        .when(child == "ambiguous", "ambiguous").when(child == "no_child_match", "unmatched").otherwise("matched")
    )
    return records.withColumn("status", s)


def family_summary(records: DataFrame) -> DataFrame:
    """Counts of each status per family; records: status and family."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("matched", "unmatched", "ambiguous", "skipped", "refusal")]
    return records.groupBy("family").agg(F.count(F.lit(1)).alias("records"), *counts)


def matched_by_id(records: DataFrame) -> DataFrame:
    """Matched records per family and id of the selected child, or else the root."""
    chosen = F.coalesce("template.child_routing.selected_child_template_id", "template.template_id")
    return records.where("status = 'matched'").groupBy("family", chosen.alias("template_id")).agg(F.count(F.lit(1)).alias("n"))


def run_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "unmatched", "ambiguous", "skipped", "refusal")])


def parity(routes: DataFrame, legacy: DataFrame) -> DataFrame:
    """routes, legacy: path, route. Inner join on path; ``verdict`` is match or mismatch
    by family."""
    j = routes.select("path", F.col("route").alias("new_route")).join(legacy.select("path", F.col("route").alias("old_route")), "path")
    return j.withColumn("verdict", F.when(S.family(F.col("new_route")).eqNullSafe(S.family(F.col("old_route"))), "match").otherwise("mismatch"))


def without_legacy(routes: DataFrame, legacy: DataFrame) -> DataFrame:
    """Paths that parity can't judge."""
    return routes.join(legacy.select("path"), "path", "left_anti")


def parity_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("verdict") == "match").alias("matches"), F.count_if(F.col("verdict") == "mismatch").alias("mismatches"))


def consume(routes: DataFrame, legacy: DataFrame) -> DataFrame:
    """routes: path, status, route; a route that isn't resolved falls back to the legacy
    one. ``source`` says which was taken, ``diff`` why the two differ."""
    j = routes.join(legacy.select("path", F.col("route").alias("legacy_route")), "path", "left")
    resolved = F.when(F.col("status") == "matched", F.col("route"))
    taken = F.coalesce(resolved, "legacy_route")
    source = F.when(resolved.isNotNull(), "template").when(F.col("legacy_route").isNotNull(), "legacy").otherwise("unresolved")
    diff = (
        F.when(resolved.isNull(), F.col("status")).when(F.col("legacy_route").isNull(), "no_legacy_route")
        .when(S.family(resolved) != S.family(F.col("legacy_route")), "route_changed")
    )
    return j.select("path", "status", taken.alias("taken_route"), source.alias("source"), diff.alias("diff"))


def consumer_summary(consumed: DataFrame) -> DataFrame:
    return consumed.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("source") == "template").alias("from_template"), F.count_if(F.col("source") == "legacy").alias("from_legacy"),
        F.count_if(F.col("source") == "unresolved").alias("unresolved"), F.count("diff").alias("diffs"),
    )


def failure_histogram(records: DataFrame) -> DataFrame:
    """How often each assertion failed."""
    # outer: explode alone would add a filter that repeats the whole evaluation
    a = records.select(F.explode_outer("template.assertions").alias("a")).where("not a.passed")
    return a.groupBy(F.col("a.name").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
