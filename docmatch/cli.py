"""Command line: run (default), compile, infer, infer-schema, struct-check, witness."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from . import __version__
from .plans import definitions as D
from .plans.refusals import EXIT_OK, EXIT_PARTIAL, EXIT_REFUSED, Refusal

COMMANDS = ("compile", "infer", "infer-schema", "struct-check", "witness")


def _spark(jobs: int | None = None):
    from pyspark.sql import SparkSession

    n = max(1, jobs or os.cpu_count() or 1)
    spark = SparkSession.builder.master(f"local[{n}]").appName("docmatch").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def registry() -> tuple[D.Registry, list[str]]:
    """Built-in and installed definitions, and the trust list, from the environment."""
    home = Path.home() / ".docmatch"
    found, warnings = D.scan_definitions(os.environ.get("DOCMATCH_DEFINITIONS") or home / "definitions")
    for w in warnings:
        print(json.dumps({"event": "warning", "message": w}), file=sys.stderr)
    own = os.environ.get("DOCMATCH_TRUST")
    trust = D.scan_trust(own) if own else D.scan_trust(home / "trust.yaml", Path(".docmatch") / "trust.yaml")
    return D.Registry(found), trust


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmatch")
    p.add_argument("input", nargs="?")
    p.add_argument("--fp", "--template", action="append", default=[])
    p.add_argument("--jobs", type=int)
    p.add_argument("--base", default="")
    for flag in ("diagnose", "no-witness", "progress", "list", "describe", "schema", "version"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _subparser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"docmatch {command}")
    if command == "compile":
        p.add_argument("yaml", nargs="?")
        p.add_argument("--out")
        p.add_argument("--check", action="store_true")
        p.add_argument("--schema", action="store_true")
    elif command == "infer":
        p.add_argument("dir")
        p.add_argument("--format", required=True)
        p.add_argument("--id", required=True)
        p.add_argument("--min-confidence", type=float, default=0.9)
        p.add_argument("--no-extract", action="store_true")
        p.add_argument("--out")
    elif command == "infer-schema":
        for a in ("doc", "fields"):
            p.add_argument(f"--{a}", required=True)
        for a in ("text-path", "id", "out"):
            p.add_argument(f"--{a}")
    elif command == "struct-check":
        p.add_argument("--rules", required=True)
        p.add_argument("--input")
    else:
        p.add_argument("action", choices=("query", "last", "count"))
        for a in ("tool", "since", "until", "outcome", "input-hash"):
            p.add_argument(f"--{a}")
        p.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv and argv[0] in COMMANDS:
            return globals()["_" + argv[0].replace("-", "_")](_subparser(argv[0]).parse_args(argv[1:]))
        return _run(_parser().parse_args(argv))
    except Refusal as e:
        print(e.json())
        return EXIT_REFUSED


def _run(a: argparse.Namespace) -> int:
    if a.version:
        print(f"docmatch {__version__}")
        return EXIT_OK
    if a.describe:
        print(json.dumps({"name": "docmatch", "version": __version__, "input": "hash.v0", "output": "docmatch.v0", "exit_codes": {"0": "all matched", "1": "partial", "2": "refused"}, "formats": list(D.FORMATS)}))
        return EXIT_OK
    if a.schema:
        some = dict(version=dict(const="docmatch.v0"), path=dict(type="string"), template=dict(type=["object", "null"]), tool_versions=dict(type="object"))
        print(json.dumps(dict(type="object", required=["version", "path"], properties=some)))
        return EXIT_OK
    known, trust = registry()
    if a.list:
        for d in known.listing():
            print(f"{d.template_id} ({d.format})")
        return EXIT_OK
    if not a.fp:
        print("at least one --fp is needed", file=sys.stderr)
        return EXIT_REFUSED
    from .operators import ledger
    from .operators.engine import Engine
    from .sources import manifest

    body = sys.stdin.buffer.read() if a.input in (None, "-") else Path(a.input).read_bytes()
    engine = Engine(known, trust, a.diagnose)
    known.check(trust)
    known.select(a.fp)
    spark = _spark(a.jobs)
    rows = [(i, x.removesuffix("\r")) for i, x in enumerate(body.decode("utf-8", "replace").split("\n"), 1) if x.strip()]
    lines = spark.createDataFrame(rows, "seq long, raw string").repartition(min(len(rows) or 1, 2 * (a.jobs or os.cpu_count() or 1)))
    out = engine.run(lines, a.fp, a.base).persist()
    outcome, code = (engine.outcome(out), EXIT_OK)
    if outcome == "PARTIAL":
        code = EXIT_PARTIAL
    text = "".join(r["value"] + "\n" for r in out.orderBy("seq").toLocalIterator())
    sys.stdout.write(text)
    for r in out.where("warning is not null").orderBy("seq").select("warning").toLocalIterator():
        print(r["warning"], file=sys.stderr)
    if a.progress:
        print(json.dumps({"event": "progress", "records": len(rows)}), file=sys.stderr)
    if not a.no_witness:
        ledger.append(ledger.default_path(), ledger.record([(a.input or "-", body)], {"templates": a.fp, "diagnose": a.diagnose}, outcome, code, text.encode()))
    return code


def _compile(a: argparse.Namespace) -> int:
    from .plans.compiled import compile_file

    if a.schema:
        print(json.dumps(D.json_schema()))
        return EXIT_OK
    if a.yaml is None:
        print("a definition file is needed", file=sys.stderr)
        return EXIT_REFUSED
    made = compile_file(a.yaml, None if a.check else a.out)
    print(json.dumps({"outcome": "VALID"}) if a.check else made)
    return EXIT_OK


def _write(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def _learned(inputs: list[tuple[str, bytes]], params: dict, code: int, text: str) -> None:
    from .operators import ledger

    ledger.append(ledger.default_path(), ledger.record(inputs, params, "INFERRED", code, text.encode()))


def _infer(a: argparse.Namespace) -> int:
    from .operators import learn
    from .sources import manifest

    try:
        if a.format.lower() not in learn.EXTENSIONS:
            raise learn.LearnError(f"unsupported infer format '{a.format}'")
        spark = _spark()
        files = manifest.corpus(spark, a.dir, learn.EXTENSIONS[a.format.lower()])
        from pyspark.sql import functions as F

        recs = files.select("path", F.element_at(F.split("path", r"\."), -1).alias("extension"), F.lit(None).cast("string").alias("text_path"), F.lit(False).alias("skipped"), F.lit(True).alias("has_path"))
        profile = learn.from_documents(manifest.documents(recs), a.format, a.id, a.min_confidence, not a.no_extract)
    except learn.LearnError as e:
        print(e, file=sys.stderr)
        return EXIT_REFUSED
    text = learn.emit_yaml(profile)
    _write(text, a.out)
    paths = "\n".join(r["path"] for r in files.toLocalIterator())
    _learned([(a.dir, paths.encode())], {"command": "infer", "format": a.format, "id": a.id, "min_confidence": a.min_confidence}, EXIT_OK, text)
    return EXIT_OK


def _infer_schema(a: argparse.Namespace) -> int:
    from .operators import learn
    from .sources import manifest

    ext = Path(a.doc).suffix.lower().lstrip(".")
    kind = {"htm": "html", "md": "markdown", "txt": "text"}.get(ext, ext)
    try:
        fields = learn.load_fields(Path(a.fields).read_text(encoding="utf-8"))
        doc = manifest.open_document(a.doc, kind, a.text_path)
        if doc["error"] or doc["view"] is None:
            raise learn.LearnError(doc["error"] or "the document has no text")
        profile, missing = learn.from_fields(_spark(), doc["view"], kind, fields, a.id or f"{learn.sanitise(Path(a.doc).stem)}.v1")
    except (learn.LearnError, OSError) as e:
        print(e, file=sys.stderr)
        return EXIT_REFUSED
    text, code = learn.emit_yaml(profile), EXIT_PARTIAL if missing else EXIT_OK
    _write(text, a.out)
    _learned([(x, Path(x).read_bytes()) for x in (a.doc, a.fields)], {"command": "infer-schema", "id": profile["template_id"], "missing": missing}, code, text)
    return code


def _struct_check(a: argparse.Namespace) -> int:
    from .operators import struct_check as C

    try:
        rules = C.load_rules(a.rules)
    except (OSError, ValueError, KeyError) as e:
        raise Refusal("E_BAD_INPUT", str(e)) from e
    body = sys.stdin.read() if a.input in (None, "-") else Path(a.input).read_text(encoding="utf-8")
    spark = _spark()
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(body.split("\n"), 1) if x.strip()], "seq long, raw string")
    checked = C.check(C.groups(C.paths_of(lines)), rules).persist()
    for r in C.output_lines(checked).toLocalIterator():
        print(r["value"])
    return EXIT_OK if checked.where("outcome <> 'complete'").isEmpty() else EXIT_PARTIAL


def _witness(a: argparse.Namespace) -> int:
    from .operators import ledger

    try:
        rows = ledger.query(ledger.read(_spark(1), ledger.default_path()), a.tool, a.since, a.until, a.outcome, a.input_hash)
    except ledger.LedgerError as e:
        print(e, file=sys.stderr)
        return EXIT_REFUSED
    if a.action == "count":
        n = ledger.count(rows)
        print(json.dumps({"count": n}) if a.json else n)
        return EXIT_OK if n else EXIT_PARTIAL
    found = [r["raw"] for r in rows.toLocalIterator()] if a.action == "query" else [x for x in [ledger.last(rows)] if x]
    for x in found:
        print(x)
    return EXIT_OK if found else EXIT_PARTIAL


if __name__ == "__main__":
    sys.exit(main())
