"""The pipeline's stages against brute force, stage by stage, on one small folder."""

from __future__ import annotations

from collections import Counter

import pytest

from docmatch.llm import common

from .test_operators import words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    good = [(i, words(i, 60 + i % 50), "en", f"s{i % 4}", 1) for i in range(300)]
    copies = [(1000 + i, good[i][1], "en", "s0", 1) for i in range(30)]
    near = [(2000 + i, good[i][1] + " tail", "en", "s1", 1) for i in range(20, 40)]
    junk = [(3000 + i, " ".join(f"{w}%%%" for w in words(i, 60).split()), "en", "s2", 1) for i in range(60)]
    odd = [(None, words(900, 70), "en", "s0", 1), (5, good[5][1], "en", "s1", 1), (4000, None, None, None, None)]
    rows = good + copies + near + junk + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300)] + [(3000 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_classifier_drops_rejected_rows_only(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, _ = folder
    junk = lambda i: " ".join(f"{w}%%%" for w in words(i, 60).split())
    more = [(None, junk(5)), (None, words(7, 67)), (5000, words(9, 69)), (5000, junk(9)), (5001, junk(11))]
    docs = spark.read.parquet(f"{path}/documents.parquet").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, path).collect())
    assert [left[x] for x in more] == [0, 1, 1, 0, 0]


def test_stages(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(stage(spark, docs, path), "stage")
        seen[name] = docs
        if name != "byte-level BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    after = ids["quality classifier"]
    assert sum(after[i] > 0 for i in range(300)) >= 290 and sum(after[3000 + i] > 0 for i in range(60)) <= 3
    # exact: of equal texts among what came in, the largest id, once
    groups = {}
    for r in seen["quality classifier"].collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = Counter(max((i for i in v if i is not None), default=None) for v in groups.values())
    assert ids["exact dedup"] == want and ids["exact dedup"][None] == 1
    # near: one of each pair, the smaller id
    left = ids["near dedup"]
    for i in range(20, 40):
        pair = [j for j in (i, 1000 + i, 2000 + i) if ids["exact dedup"][j]]
        assert sum(left[j] for j in pair) == 1 and left[min(pair)] == 1
    assert max(ids["mix sources"].values()) <= 3 and sum(ids["byte-level BPE"].values()) == sum(ids["mix sources"].values())
    assert corpus_pipeline.run(spark, path).count() == sum(ids["mix sources"].values())
