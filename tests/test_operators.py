import json
import math

import pytest
from pyspark.sql import functions as F

from docmatch import catalog
from docmatch.functions import blake3
from docmatch.functions.blake3 import blake3_hex
from docmatch.functions.regexlang import RegexError, compile_python, escape, glob_to_regex, to_java
from docmatch.operators import assertions as A
from docmatch.operators import hybrid, learn, ledger, struct_check
from docmatch.operators import structure as learn_view
from docmatch.operators.extract import content_hash
from docmatch.plans import compiled
from docmatch.plans import definitions as D
from docmatch.plans.refusals import Refusal
from docmatch.sources import grids, manifest, pdf

from . import samples


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(5121))
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex(data[:1024]) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3_hex(data) == "628bd2cb2004694adaab7bbd778a25df25c47b9d4155a55f8fbd79f2fe154cff"
    assert content_hash({"a": {"x": 1, "b": 2}}, ["a"]) == content_hash({"a": {"b": 2, "x": 1}}, ["a"]) != content_hash({"a": {"b": 2, "x": 1}}, ["a", "c"])


def test_blake3_of_many_messages_compresses_them_together(monkeypatch):
    sizes = [0, 1, 64, 65, 1024, 1025, 2048, 2049, 3073, 5121, 9217] * 3
    messages = [bytes((i + k) % 251 for i in range(n)) for k, n in enumerate(sizes)]
    alone, calls, compress = [blake3_hex(m) for m in messages], [], blake3._compress
    monkeypatch.setattr(blake3, "_compress", lambda *a: calls.append(1) or compress(*a))
    # 16 blocks of a chunk, and at most 4 levels of parents
    assert blake3.blake3_many(messages) == alone and len(calls) == 20 and blake3.blake3_many([]) == []


def test_bm25_over_all_languages(spark, tmp_path):
    rows = [(1, "An idiot, an IDIOT", "en"), (2, "Plain words here", "en"), (3, "Ein Idiot\u2014größer als 3 andere", "de"), (4, "l\u2019idiot \u00abidiote\u00bb été", "fr"), (5, "", "en"), (6, "nada de nada", None), (7, "idiot", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ts = {i: "".join(c if c.isalpha() or c.isnumeric() else " " for c in t.lower()).split() for i, t, _ in rows}
    df, mean = sum("idiot" in t for t in ts.values()), sum(map(len, ts.values())) / len(ts)
    idf = math.log(1 + (len(ts) - df + 0.5) / (df + 0.5))
    want = {i: idf * t.count("idiot") * 2.2 / (t.count("idiot") + 1.2 * (0.25 + 0.75 * len(t) / mean)) for i, t in ts.items() if "idiot" in t}
    got = {r.id: r.bm25 for r in catalog.queries()["i11_bm25_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 4, 7} and got == pytest.approx(want, abs=1e-6)


def test_regex_language():
    assert compile_python("a$").search("a\n") is None and compile_python(r"(?i)É").search("é") and compile_python(escape("a.b*c")).fullmatch("a.b*c")
    assert to_java("a$").endswith(r"a\z") and to_java("(?m)a$").endswith("a$") and to_java("[$]").endswith("[$]")
    for bad in ("(?=a)", r"(a)\1", "(", "(?<!x)"):
        with pytest.raises(RegexError):
            to_java(bad)
    assert compile_python(glob_to_regex("src/*.{txt,md}")).search("src/a/b.md") and not compile_python(glob_to_regex("?.t[!x]t")).search("a.txt")


def test_automatic_names():
    d = D.load_text("template_id: x\nformat: html\nassertions:\n- heading_regex: {pattern: '(?i)[Rr]ent  Roll\\d+ of a long name'}\n- heading_regex: {pattern: '(?i)[Rr]ent  Roll\\d+ of a long name'}\n- cell_eq: {sheet: My Sheet, cell: A1, value: v}\n- page_count: {min: 1}\n- {name: own, page_count: {}}\n")
    assert [a.name for a in d.assertions] == ["heading_regex__rrent_rolld_of_a_lon", "heading_regex__rrent_rolld_of_a_lon__1", "cell_eq__My_Sheet__A1", "page_count", "own"]


@pytest.mark.parametrize("text, code", [("template_id: x\nformat: csv\nassertions:\n- nope: {}\n", "E_UNKNOWN_ASSERTION"), ("format: csv\nassertions: []\n", "E_MISSING_FIELD"), ("a: [", "E_INVALID_YAML"), ("template_id: x\nformat: csv\nassertions:\n- cell_eq: {sheet: a}\n", "E_MISSING_FIELD")])
def test_compile_refusals(text, code):
    with pytest.raises(Refusal) as e:
        compiled.compile_text(text)
    assert e.value.code == code and json.loads(e.value.json())["outcome"] == "REFUSAL"


def test_validation_and_schema():
    d = D.definition_from({"template_id": "x", "format": "csv", "assertions": [{"full_width_row": {"pattern": "(", "min_cells": 0}}, {"page_count": {"min": 3, "max": 1}}], "extract": [{"name": "a", "type": "range"}], "content_hash": {"algorithm": "md5", "over": ["b"]}})
    wrong = " ".join(D.validate(d))
    assert all(x in wrong for x in ("requires format html", "invalid regex", "max is less than min", "requires 'sheet'", "unsupported hash", "unknown extract 'b'", "min_cells"))
    assert len(D.json_schema()["properties"]["assertions"]["items"]["oneOf"]) == 30


def test_compiled_module_evaluates_alike(spark, tmp_path):
    text = "template_id: a.v1\nformat: text\nassertions:\n- text_contains: mill\n"
    (tmp_path / "a.fp.yaml").write_text(text)
    target = compiled.compile_file(str(tmp_path / "a.fp.yaml"), str(tmp_path / "out"))
    space: dict = {}
    exec(open(target).read(), space)
    docs = catalog.text_docs(spark, "/root/testdata/sf0.001").limit(20)
    got = space["evaluate"](docs).select("doc_id", "chosen.matched").collect()
    assert len(got) == 20 and space["DEFINITION"].definition_hash == compiled.source_hash(text) and compiled.compile_text(text) == compiled.compile_text(text)


def test_struct_check_outcomes(spark):
    paths = ["in/a/x.csv", "in/a/y.md", "in/a/x.csv", "in/b/y.md", "in/c/z", "other/x.csv", "top"]
    df = spark.createDataFrame([(i, json.dumps({"version": "vacuum.v0", "relative_path": p})) for i, p in enumerate(paths)], "seq long, raw string")
    rules = [struct_check.Rule("r", "in/*", ["*.csv", "y.*"], ["q"]), struct_check.Rule("bad", "[", ["x"])]
    got = [tuple(map(lambda v: tuple(v) if isinstance(v, list) else v, (r.matched_directory, r.outcome, r.present, r.missing, r.unexpected))) for r in struct_check.check(struct_check.groups(struct_check.paths_of(df)), rules).collect()]
    assert got == [("in/a", "complete", ("x.csv", "y.md"), (), ()), ("in/b", "partial", ("y.md",), ("*.csv",), ()), ("in/c", "empty", (), ("*.csv", "y.*"), ("z",))]
    with pytest.raises(Refusal):
        struct_check.paths_of(spark.createDataFrame([(1, '{"version":"vacuum.v1"}')], "seq long, raw string"))


def test_ledger(spark, tmp_path):
    path = tmp_path / "l" / "ledger.jsonl"
    assert ledger.count(ledger.read(spark, str(path))) == 0
    for k, (o, ts) in enumerate([("ALL_MATCHED", "2024-01-01T00:00:00Z"), ("PARTIAL", "2024-01-02T01:00:00+02:00"), ("PARTIAL", "soon")]):
        ledger.append(path, ledger.record([("in", bytes([k]))], {}, o, 0, b"", ts))
    rows = ledger.read(spark, str(path))
    assert ledger.count(rows) == 3 and json.loads(ledger.last(rows))["ts"] == "soon"
    assert ledger.count(ledger.query(rows, outcome="PARTIAL", since="2024-01-01T23:00:00Z")) == 1 and ledger.count(ledger.query(rows, input_hash=blake3_hex(b"\x01"))) == 1
    path.open("a").write("{broken\n")
    with pytest.raises(ledger.LedgerError, match="line 4"):
        ledger.read(spark, str(path))


def _folder(tmp_path, files):
    for name, body in files.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path


def _docs(spark, folder, exts):
    from pyspark.sql import functions as F

    from docmatch.functions import scalars as S

    files = manifest.corpus(spark, str(folder), exts)
    return manifest.documents(files.select("path", S.extension(F.col("path")).alias("extension"), F.lit(None).cast("string").alias("text_path"), F.lit(False).alias("skipped"), F.lit(True).alias("has_path")))


def test_learn_html_and_match_again(spark, tmp_path):
    # one table: of two widths equally often, learning takes the larger but a run the smaller
    one = samples.HTML.split("<table><tr><td>Key")[0]
    folder = _folder(tmp_path, {f"d{i}.html": one.replace("Aurora", f"Ship{i}") for i in range(3)})
    profile = learn.from_documents(_docs(spark, folder, ("html", "htm")), "html", "fleet.v1")
    kinds = [c.assertion.kind for c in profile["assertions"]]
    assert kinds == ["filename_regex", "heading_exists", "header_token_search", "dominant_column_count", "full_width_row", "page_section_count"]
    text = learn.emit_yaml(profile)
    d = D.load_text(text)
    assert "# confidence: 1.000 (3/3)" in text and not D.validate(d)
    from docmatch.operators import engine

    got = engine.evaluate(_docs(spark, folder, ("html",)), [d]).select("chosen.matched", "chosen.content_hash").collect()
    assert all(r.matched for r in got) and len({r.content_hash for r in got}) == 1


def test_learn_html_reads_documents_once(spark):
    title = lambda i: "Top" if i % 3 else "Other"
    rows = [(f"d{i:02}.html", "html", None, ([(1, title(i), 1)], [(title(i), 0, 1, 3, i % 2 + 1, ["Vessel", " Flag\t State", "Cost"] if i % 4 else ["Vessel"], [["a", "a"], ["b", "\u2003"]])], i % 3)) for i in range(20)]
    view = f"struct<headings:array<{learn_view.HEADING}>,tables:array<{learn_view.TABLE}>,page_sections:int>"
    docs = spark.createDataFrame(rows, f"path string, kind string, error string, view {view}")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    observed = learn.observe(docs.mapInArrow(counted, docs.schema), "html")
    kinds = ("heading_exists", "header_token_search", "dominant_column_count", "page_section_count")
    found = {c.assertion.kind: c for c in learn.candidates(observed, "html", None, kinds=kinds)}
    assert read.value == len(rows) and set(found) == set(kinds) and all(c.total == 20 for c in found.values())
    assert found["heading_exists"].assertion[""] == "Top" and found["heading_exists"].support == 13 and found["page_section_count"].support == 13
    search = found["header_token_search"]
    assert search.support == 10 and search.assertion["tokens"] == ["(?i)Vessel", "(?i)Flag State"] and search.assertion["page"] == 2
    assert found["dominant_column_count"].assertion["count"] == 3 and found["dominant_column_count"].assertion["tolerance"] == 1
    # all kinds at once give the same, and full-width rows besides
    again = {c.assertion.kind: c for c in learn.candidates(observed, "html", 20)}
    assert all(again[k] == found[k] for k in kinds) and again["full_width_row"].assertion["pattern"] == "(?i)^(a|b)$"


def test_learn_csv_and_errors(spark, tmp_path):
    folder = _folder(tmp_path, {"a.csv": "Name,Area\nx,1\n", "b.csv": "Name,Size\ny,2\nz,3\n", "ragged.csv": "a,b\n1\n"})
    docs = _docs(spark, folder, ("csv",))
    p = learn.from_documents(docs, "csv", "t", 0.6)
    assert [(c.assertion.kind, c.support, c.total) for c in p["assertions"]] == [("filename_regex", 2, 2), ("sheet_exists", 2, 2), ("sheet_min_rows", 2, 2), ("cell_eq", 2, 2)] and p["extract"][0]["range"] == "A1:D20"
    with pytest.raises(learn.LearnError):
        learn.from_documents(docs, "docx", "t")
    with pytest.raises(learn.LearnError):
        learn.from_documents(docs, "csv", "t", 1.5)


def test_learn_from_fields(spark):
    view = manifest.view_of("markdown", samples.MARKDOWN)
    p, missing = learn.from_fields(spark, view, "markdown", [{"name": "Exit Yield", "value": "6.25%"}, {"name": "none", "value": "zzzz"}], "x.v1")
    assert missing == ["none"] and p["assertions"][0].kind == "text_near" and p["extract"][0]["name"] == "exit_yield" and not D.validate(D.load_text(learn.emit_yaml(p)))


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "the mill on the river"), (2, "mill mill mill"), (3, "unrelated words"), (4, "")], "doc_id long, text string")
    hits = hybrid.search(docs, "mill").collect()
    assert [h.id for h in hits][:2] == [2, 1] and hybrid.support(docs, "mill") >= 2 and hybrid.search(docs, "mill", 1).count() == 1


def test_readers_refuse_broken_files():
    for body in (b"", b"{}", bytes.fromhex("d0cf11e0a1b11ae1"), samples.xlsx({})[:40]):
        with pytest.raises(grids.GridError):
            grids.xlsx_sheets(body)
    with pytest.raises(grids.GridError):
        grids.csv_rows("a,b\n1\n", strict=True)
    with pytest.raises(pdf.PdfError):
        pdf.read_pdf(b"hello")
    assert pdf.read_pdf(samples.PDF) == {"page_count": 2, "info": [{"key": "Producer", "value": "Harbour (Press)"}, {"key": "Title", "value": "A"}]}


def test_sparse_text(spark):
    from docmatch.operators import engine

    rows = [(1, "pdf", 11, "x" * 99), (2, "pdf", 10, "x"), (3, "pdf", 50, "x" * 100), (4, "text", 50, "x"), (5, "pdf", 50, None), (6, "pdf", None, "x")]
    d = spark.createDataFrame(rows, "i int, kind string, n int, t string").withColumn("path", F.concat("i", F.lit(".pdf")))
    d = d.withColumn("pdf", F.struct(F.col("n").alias("page_count"))).withColumn("view", F.struct(F.col("t").alias("normalized")))
    got = {r.i: r.w for r in d.select("i", engine.sparse_text().alias("w")).collect()}
    assert [i for i, w in got.items() if w] == [1] and json.loads(got[1])["code"] == "W_SPARSE_TEXT" and "11 pages but 99" in got[1]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    bodies = {"a.jsonl": "\n".join("" if i % 7 == 3 else f'{{"n":{i}}}' + "\r" * (i % 2) for i in range(4000)), "b.jsonl": "\nonly\n\n", "c.jsonl": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.file.rpartition("/")[2], r.seq, r.raw) for r in manifest.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((n, i, x.removesuffix("\r")) for n, b in bodies.items() for i, x in enumerate(b.split("\n"), 1) if x.strip())


def test_ranks_over_ranges(spark):
    d = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("s")).repartition(9)
    got = {r.id: r.place for r in hybrid.ranked(d, "s", "place").collect()}
    want = {i: k for k, i in enumerate(sorted(range(5000), key=lambda i: (-(i * 7919 % 101), i)))}
    assert got == want


def test_nearness_is_that_of_all_pairs():
    import random
    import re

    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab  é.\n") for _ in range(r.randint(0, 60)))
        x, y, within = re.compile(r.choice(["a", "aa?", "a|b"])), re.compile(r.choice(["b", "b+", "é", "ab?"])), r.randint(0, 6)
        data, near = text.encode(), False
        for a in A.spans(text, x):
            for v in A.spans(text, y):
                lo, hi = (a[1], v[0]) if v[0] >= a[1] else (v[1], a[0])
                near |= hi - lo <= within or (hi - lo < 10 and not data[lo:hi].decode("utf-8", "replace").strip())
        assert A.is_near(text, x, y, within) == near


def test_stream(spark, tmp_path):
    from docmatch.operators.engine import Engine
    from docmatch.streaming import stream

    files = samples.write_all(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.jsonl").write_text(samples.manifest([files["fleet.csv"]]))
    q = stream.enrich(Engine(D.Registry()), stream.manifests(spark, str(tmp_path / "in")), ["csv.v0"], str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/*").collect()]
    assert len(got) == 1 and got[0]["template"]["matched"]


def test_every_query_runs_and_oracles_name_queries(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    for name in ("w02_first_match", "j09_struct_check", "a10_header_row_match"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "docmatch", tmp_path / "docmatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout.split()[0]) > 60, run.stderr


def test_a_sheet_is_looked_up_once_for_a_range(spark):
    from docmatch.operators.extract import extract_column
    from docmatch.plans.definitions import Assertion, Extract

    found = extract_column(Extract("r", "range", {"sheet": "Sheet1", "range": "A2:D5"}))
    judged = A.Builder(False).detail(Assertion("range_populated", {"sheet": "Sheet1", "range": "A2:E5", "min_pct": 0.75}))
    # the sheet's own lookup, and the rows and columns of the range
    assert str(found).count("sheets") == 1
    assert str(found).count("sequence") == 2 and str(judged).count("sequence") == 2
    rows = [["a", "b"], ["", "\u2003"], ["1"], [None, "x"]]
    docs = spark.createDataFrame([("csv", "f.csv", [("Sheet1", 1, 1, rows)])], "kind string, path string, sheets array<struct<name:string,origin_row:int,origin_col:int,rows:array<array<string>>>>")
    r = docs.select(found.alias("r"), judged.alias("d")).first()
    assert json.loads(r.r) == {"range": "A2:D5", "row_count": 3} and r.d == "range A2:E5 is populated to 0.2, expected at least 0.75"


def test_nearest_texts_weigh_few_distances(monkeypatch):
    from docmatch.operators import diagnose

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    pairs = [("", ""), ("", "ab"), ("abc", ""), ("kitten", "sitting"), ("a z 4", "zebra 44 a"), ("ab" * 50, "ba" * 47 + "c"), ("x" * 64, "x" * 65)]
    assert [diagnose.levenshtein(*p) for p in pairs] == [plain(*p) for p in pairs]
    lines = [f"{'Word ' * (i % 40)}{i % 7}Z\u00e9" for i in range(400)]
    forms = [diagnose.distance_form(t) for t in lines]
    want = diagnose.distance_form("[A-Z]{4}")
    made, weigh = [], diagnose.levenshtein
    monkeypatch.setattr(diagnose, "levenshtein", lambda *a: made.append(a) or weigh(*a))
    order = sorted(range(400), key=lambda i: plain(want, forms[i]))
    assert diagnose.partial_lines("\n".join(lines), "[A-Z]{4}") == [lines[i] for i in order[:5]] and len(made) < 40
    target = "Word word 3z"
    assert diagnose.nearest(target, lines) == min(lines, key=lambda t: (plain(diagnose.distance_form(target), diagnose.distance_form(t)), len(t.encode()))) and len(made) < 80


def test_queries_of_failures_and_headings_look_once(spark, tmp_path):
    texts = [(1, "# x\n ##Two # \nplain"), (2, ""), (3, "WORD @mail"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()
    failures = q["g22_failure_histogram"](spark, str(tmp_path))
    assert {r.name: r.n for r in failures.collect()} == {"text_contains__mail": 3, "text_regex__a_z_4": 3}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan(failures)  # no contexts are made for counts
    nearest = q["o07_nearest_heading"](spark, str(tmp_path))
    assert {r.doc_id: r.nearest for r in nearest.collect()} == {1: "Two #", 3: "WORD @mail"} and plan(nearest).count("(?!#)") == 1
