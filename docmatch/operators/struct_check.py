"""Completeness of directory deliveries against rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions import scalars as S
from ..functions.regexlang import RegexError, glob_to_regex
from ..plans.refusals import Refusal

VERSION = "struct-check.v0"


@dataclass
class Rule:
    id: str
    group_by: str
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)


def load_rules(path: str | Path) -> list[Rule]:
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rules = [Rule(r["id"], r["group_by"], list(r.get("required") or []), list(r.get("optional") or [])) for r in data.get("rules") or []]
    if not rules:
        raise ValueError(f"{path}: no rules")
    return rules


def _globs(patterns: list[str]) -> list[tuple[str, str]]:
    """(glob, pattern) of those that can be read; the others are left out."""
    out = []
    for p in patterns:
        try:
            out.append((p, glob_to_regex(p)))
        except RegexError:
            continue
    return out


def paths_of(lines: DataFrame) -> DataFrame:
    """``relative_path`` of directory-scan records (seq, raw); refuses other records."""
    raw = F.col("raw")
    bad = F.when(F.try_parse_json(raw).isNull(), "invalid JSON").when(~F.get_json_object(raw, "$.version").eqNullSafe("vacuum.v0"), "unsupported version").when(F.get_json_object(raw, "$.relative_path").isNull(), "missing relative_path")
    worst = lines.withColumn("bad", bad).where("bad is not null").agg(F.min(F.struct("seq", "bad")).alias("w")).first()["w"]
    if worst is not None:
        raise Refusal("E_BAD_INPUT", f"line {worst['seq']}: {worst['bad']}", {"line": worst["seq"], "error": worst["bad"]})
    return lines.select(F.get_json_object(raw, "$.relative_path").alias("relative_path"))


def groups(paths: DataFrame, column: str = "relative_path") -> DataFrame:
    """``dir, files``: the sorted distinct files of each directory."""
    p = F.col(column)
    split = paths.select(S.directory(p).alias("dir"), F.regexp_extract(p, r"([^/]*)\z", 1).alias("file")).distinct()
    return split.groupBy("dir").agg(F.sort_array(F.collect_list("file")).alias("files"))


def check(directories: DataFrame, rules: list[Rule]) -> DataFrame:
    """One record per rule and directory that it applies to, by rule and directory. A
    rule whose group glob can't be read applies to none."""
    found = []
    for r in rules:
        try:
            group = glob_to_regex(r.group_by)
        except RegexError:
            continue
        required, optional = _globs(r.required), _globs(r.optional)
        none = F.array().cast("array<string>")
        missing = [F.when(~F.exists("files", _any_of([(p, g)])), F.lit(p)) for p, g in required]
        record = F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.group_by).alias("group_pattern"), F.filter("files", _any_of(required)).alias("present"),
            (F.sort_array(F.filter(F.array(*missing), lambda x: x.isNotNull())) if missing else none).alias("missing"),
            F.filter("files", _none_of(required + optional)).alias("unexpected"),
        )
        found.append(F.when(F.col("dir").rlike(group), record))
    if not found:
        return directories.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("version", "string"), ("rule_id", "string"), ("group_pattern", "string"), ("matched_directory", "string"), ("outcome", "string"), ("present", "array<string>"), ("missing", "array<string>"), ("unexpected", "array<string>"))])
    # all rules in one scan: a directory's records are an array of its row
    each = directories.select("dir", F.explode_outer(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")).where("r is not null")
    out = each.select(F.lit(VERSION).alias("version"), "r.rule_id", "r.group_pattern", F.col("dir").alias("matched_directory"), "r.present", "r.missing", "r.unexpected")
    outcome = F.when(F.size("missing") == 0, "complete").when(F.size("present") == 0, "empty").otherwise("partial")
    return out.withColumn("outcome", outcome).orderBy("rule_id", "matched_directory")


def _any_of(globs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def test(name: Column) -> Column:
        out = F.lit(False)
        for _, pattern in globs:
            out = out | name.rlike(pattern)
        return out

    return test


def _none_of(globs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    test = _any_of(globs)
    return lambda name: ~test(name)


def output_lines(checked: DataFrame) -> DataFrame:
    versions = F.struct(F.lit(__version__).alias("docmatch"))
    ordered = F.struct("version", "rule_id", "group_pattern", "matched_directory", "outcome", "present", "missing", "unexpected", versions.alias("tool_versions"))
    return checked.select(F.to_json(ordered).alias("value"))
