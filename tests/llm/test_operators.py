"""Small fixtures against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing extra columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docmatch.llm import bpe, exact_dedup, license_scan, mixing, near_dedup, quality_rules, resampling, suffix_dedup, token_shards, vec, wrapper_induction
from docmatch.llm.queries import PATTERN, RANKS, WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, part int, row long, kept boolean, copies int, h string"


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 8))) for _ in range(n))


BASE = words(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
PASSAGE = words(2, 30)
ROWS = [
    (1, BASE, "en", "b"), (2, NEAR, "en", "b"), (3, BASE, "de", "a"), (4, None, "en", "b"), (5, "", None, None), (6, "  \n\t ", "en", "b"), (7, "two words", "en", "c"), (8, "Two WORDS", "en", "c"),
    (9, words(3, 40) + " " + PASSAGE + "\n" + words(4, 40), "fr", "b"), (10, PASSAGE + " ünïcödé " * 30, "fr", "b"), (10, PASSAGE + " ünïcödé " * 30, "fr", "b"), (11, words(5, 60_000), "en", "b"),
    (None, BASE, "en", "b"), (12, "same line here\nsame line here\n" * 40, "en", "b"), (13, "a b c a b c a b c" + " x" * 60, "en", None), (14, "### $$$ %%% " * 30, "en", "d"), (15, words(11, 70), "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 3, 4, 5, False, 6, "x") for i, t, lang, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (12, 13, 14)), 0, "z") for i in range(1, 16)] + [(None, 1, 0, "z"), (99, None, None, None), (1, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")


def test_license_scan(spark, docs, empty):
    shouted = license_scan.MIT.upper().replace("LICENSE", "LICENCE").replace("YEAR HOLDER", "2024 Somebody, all of it")
    rows = [(1, shouted), (2, "x\nReleased under the MIT licence!\ny\nLicensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, license_scan.MIT + " more"), (5, license_scan.ISC)]
    got = sorted(((r.doc_id, r.license, r.n_notices, r.licenses) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "MIT", 0, "MIT"), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (5, "ISC", 0, "ISC")], key=str)
    assert license_scan.license_scan(docs).count() == len(ROWS) and license_scan.license_scan(empty).count() == 0
    for licence, text in license_scan.KNOWN:
        assert license_scan.known_digests()[hashlib.sha256(license_scan.canonical_text(text).encode()).hexdigest()] == licence


def test_license_scan_full_texts(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(name, (folder / name).read_text()) for name in want]
    texts += [(name, " ".join(t.split())) for name, t in texts] + [(name, t + "\nand more") for name, t in texts]
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[name] if i < 2 * len(want) else None for i, (name, _) in enumerate(texts)}


def brute_suffix(rows, length=50):
    out = []
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        smaller = set()
        if i is not None:
            for j, c in texts:
                if j is not None and j < i:
                    smaller |= {c[p : p + length] for p in range(len(c) - length + 1)} if len(c) < 20_000 else set()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in smaller:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, docs, empty):
    got = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()), key=str)
    assert got == brute_suffix(ROWS) and suffix_dedup.suffix_dedup(empty).count() == 0
    kept = {r.doc_id: r.kept_bytes for r in suffix_dedup.suffix_dedup(docs, with_text=True).collect()}
    assert kept[3] == b"" and kept[1] == bytearray(BASE.encode())


def test_suffix_dedup_random_overlaps(spark):
    r = np.random.default_rng(5)
    pool = [words(s, 30) for s in range(40, 46)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(int(r.integers(0, 5))):
            p = pool[int(r.integers(0, 6))]
            a = int(r.integers(0, len(p) - 60))
            parts.append(p[a : a + int(r.integers(20, 120))])
        rows.append((int(r.permutation(1000)[0]) * 60 + i, "ab" * 40 + "é".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in suffix_dedup.suffix_dedup(df).collect()), key=str) == brute_suffix(rows)


def test_suffix_levels_merge_geometrically():
    index = suffix_dedup.SuffixLevels()
    for k in range(16):
        index.add(np.array([2 * k], np.uint64), np.array([k]))
    assert len(index.levels) <= 5 and index.scan(np.array([6, 7], np.uint64)).tolist() == [3, np.iinfo(np.int64).max]


def brute_base(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(docs, labels, empty):
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, *brute_base(t)) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)
    assert {r.doc_id: r.kept for r in got}[15]
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())


def test_risk_control(spark):
    from math import comb

    for k, n in ((0, 50), (3, 100), (17, 300)):
        p = quality_rules.upper_bound(k, n, 0.01)
        assert abs(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) - 0.01) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0 and quality_rules.upper_bound(0, 0, 0.05) == 1.0
    # different lines of equal hashes (Thue-Morse) aren't repeats
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    lines = tm.replace("b", " ") + "\n" + tm.translate(str.maketrans("ab", "ba")).replace("b", " ") + "\n" + tm + " " + tm
    data = np.frombuffer((lines + "\n" + lines).encode(), np.uint8)
    counts = quality_rules._counts(data, np.array([0, len(lines), len(data)]))
    assert counts["n_dup_lines"].tolist() == [0, 0] and [counts["n_words"][0], counts["n_repeat_words"][0]] == [brute_base(lines)[0], brute_base(lines)[4]]
    # the tests stop at the first step beyond the risk
    x = np.zeros((400, len(quality_rules.NAMES)))
    x[:30, 0], x[30:200, 2] = 5.0, 0.5
    assert quality_rules.tested([(0, 8), (0, 3), (2, 4), (0, 0)], x, 0.1, 0.01) == {}
    assert quality_rules.tested([(0, 8), (0, 3), (2, 4), (0, 0)], x, 0.15, 0.01) == {"symbol_rate": 0.2}
    # enough good documents: junk of many symbols goes, good ones of the holdout stay
    rows = [(i, words(i, 80), "en") for i in range(3000)] + [(i, words(i, 80).replace(" ", "%%% "), "en") for i in range(3000, 3050)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i < 3000)) for i in range(3050)], "doc_id long, quality int")
    got = quality_rules.quality_rules(d, lab).groupBy((F.col("doc_id") < 3000).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {r.good: r.k for r in got}[False] == 0.0 and {r.good: r.k for r in got}[True] > 0.9


def test_small_strata_share_cutoffs(spark):
    # two strata of their own; the others are too small for cutoffs one by one
    lang = lambda i: "a" if i < 1500 else None if i < 2900 else f"l{i % 40}"
    rows = [(i, words(i, 80), lang(i)) for i in range(4500)] + [(i, words(i, 80).replace(" ", "%%% "), lang(i)) for i in range(4500, 4550)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i < 4500)) for i in range(4550)], "doc_id long, quality int")
    got = quality_rules.quality_rules(d, lab, max_strata=2).groupBy((F.col("doc_id") < 4500).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert {r.good: r.n for r in got} == {True: 4500, False: 50} and {r.good: r.k for r in got}[False] == 0.0 and {r.good: r.k for r in got}[True] > 0.9


def test_cutoffs_come_from_all_labels(spark):
    # "late" has the labelled ids of the largest hashes, behind 42,000 others
    ids = spark.range(45_050).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64(F.lit(11), "doc_id")).toPandas()["doc_id"].tolist()
    late, junk = set(ids[42_000:]), set(ids[45_000:])
    rows = [(i, words(i, 80).replace(" ", "%%% " if i in junk else " ") if i in late else None, "late" if i in late else "early") for i in ids]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i not in junk)) for i in ids], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(d, lab).where("stratum = 'late'").collect()}
    assert len(got) == 3_050 and not any(got[i] for i in junk) and sum(got.values()) > 2_700


def test_tightening_path_by_counts():
    # combinations that are counted give the path of the documents one by one
    r = np.random.default_rng(5)
    for _ in range(5):
        x, good = r.integers(0, 10, (300, len(quality_rules.NAMES))), r.random(300) < 0.8
        x[good] //= 3
        x, good = np.repeat(x, 3, 0), np.repeat(good, 3)
        cells, at = np.unique(x, axis=0, return_inverse=True)
        n = [np.bincount(at.reshape(-1), weights=w, minlength=len(cells)).astype(int) for w in (good, ~good)]
        path = quality_rules.tightening_path(cells, *n, 0.1)
        assert path == quality_rules.tightening_path(x, good.astype(int), (~good).astype(int), 0.1) and path
        gone = np.zeros(len(x), bool)
        for k, c in path:
            gone |= x[:, k] > c
        assert (gone & good).sum() <= 0.05 * good.sum()


M = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_features(text):
    """Buckets of words, word pairs and byte triples, without numpy."""
    out, base = [], 0x9E3779B97F4A7C15
    hashes = []
    for w in WORD.findall(text or ""):
        h = sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(w.encode()))
        hashes.append(plain_mix(h & M))
    out += [plain_mix(h) >> 48 for h in hashes]
    out += [0 if x == y else plain_mix((x * 0xD6E8FEB86659FD93 + y) & M) >> 48 for x, y in zip(hashes, hashes[1:], strict=False)]
    data = (text or "").encode()
    return out + [((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 % (1 << 32)) >> 16 for k in range(len(data) - 2)]


def test_resampling_matches_brute_force(spark, docs, labels, empty):
    import math

    got = resampling.quality_resample(docs, labels, k=8, temperature=0.0).collect()
    feats = [plain_features(t) for _, t, *_ in ROWS]
    fit = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").select("doc_id").where(f"xxhash64({8}, doc_id) % 2 = 0").distinct().collect() if r.doc_id is not None}
    raw, target = Counter(), Counter()
    for f, r in zip(feats, ROWS, strict=True):
        raw.update(f)
        target.update(f if r[0] in fit else ())
    p, q = sum(target.values()) + (1 << 16), sum(raw.values()) + (1 << 16)
    ratio = {x: math.log((target[x] + 1) / p) - math.log((raw[x] + 1) / q) for x in raw}
    weight = [sum(ratio[x] for x in f) for f in feats]
    assert Counter((r.doc_id, r.n_features, round(r.log_weight, 5)) for r in got) == Counter((r[0], len(f), round(w, 5)) for f, w, r in zip(feats, weight, ROWS, strict=True))
    # k is split over the bands by their sizes; in each the largest weights are drawn
    bands = {}
    for f, w in zip(feats, weight, strict=True):
        bands.setdefault(int(math.log2(len(f) + 1)), []).append(w)
    seen = given = 0
    for band, ws in sorted(bands.items()):
        seen += len(ws)
        n = 8 * seen // len(ROWS) - given
        given += n
        least = sorted(ws)[-n] if n else math.inf
        assert sorted(round(r.log_weight, 3) for r in got if r.band == band and r.kept) == sorted(round(w, 3) for w in ws if w >= least - 1e-5)
    assert resampling.quality_resample(empty, labels).count() == 0 and resampling.quality_resample(docs, labels.limit(0)).where("not kept").count() == 0


def test_resampling_draws_by_weight(spark):
    """Two kinds of texts whose weights differ little: temperature 1 mixes them, 0 doesn't,
    and a seed gives the same draw again."""
    rows = [(i, f"{'x' if i % 2 else 'y'} same words here and there {i % 7}") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 2 or i % 5 == 0)) for i in range(2000)], "doc_id long, quality int")
    draw = lambda **x: {r.doc_id for r in resampling.quality_resample(d, lab, k=600, **x).where("kept").collect()}
    plain, one, again, other = draw(temperature=0.0), draw(), draw(), draw(seed=8)
    assert one == again and one != other and abs(len(one) - 600) <= 1 and len(one - plain) > 60
    assert sum(i % 2 for i in one) > 300


def test_ngram_buckets():
    text = b"aa aa bb\xc3\xa9cc"
    buckets, docs = resampling.features(np.frombuffer(text, np.uint8), np.array([0, 5, 5, len(text)]))
    # words, pairs within a document, byte triples within a document
    assert Counter(docs.tolist()) == {0: 2 + 1 + 3, 2: 1 + 0 + 5}
    assert (buckets == resampling.REPEAT).sum() == 1 and buckets.max() < 1 << resampling.BITS


def test_resampling_holds_out(spark):
    good = [(i, " ".join(words(i % 50, 40).split() + words(7, 30).split())) for i in range(400)]
    bad = [(i, " ".join(f"{w}$$$" for w in words(i, 50).split())) for i in range(400, 480)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") < 400).cast("int").alias("quality"))
    got = resampling.quality_resample(d, lab).collect()
    wrong = sum(r.kept != (r.doc_id < 400) for r in got)
    assert wrong <= 0.02 * len(got)
    assert sum(r.kept for r in resampling.quality_resample(d, lab, k=100).collect()) == 100
    assert resampling.target_counts({3: (100, 40), 4: (50, 50)}, __import__("pandas").DataFrame({"band": [3] * 40, "score": [1.0] * 20 + [0.0] * 20, "good": [True] * 22 + [False] * 18}), 0.5) == {3: 45, 4: 50}


def test_token_shards_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    shards = token_shards.write(docs, WORD_BPE, f"file://{tmp_path}")
    got = token_shards.read(spark, shards).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, text, *_ in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)
    shard = token_shards.Shard(open(shards[-1]["path"].removeprefix("file://"), "rb").read())
    tokens, ends = shard.tokens(), np.cumsum(shard.counts)
    for d, (e, n) in enumerate(zip(ends, shard.counts, strict=True)):
        assert (shard.slice(d, n // 3, n) == tokens[e - n + n // 3 : e]).all()
    assert token_shards.write(empty, WORD_BPE) == [] and token_shards.read(spark, []).count() == 0


def test_re_pair_shrinks_and_expands():
    ids = np.tile(np.array([5, 6, 7, 5, 6, 2]), 2000)
    last = ids == 2
    s, _, rules = token_shards.re_pair(ids, last, 100)
    assert len(s) < len(ids) / 2 and rules and (token_shards.expand(s, rules, 100) == ids).all()
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 200))
        ids, last = r.integers(0, 3, n), r.random(n) < 0.1
        last[-1] = True
        s, ends, rules = token_shards.re_pair(ids, last.copy(), 10)
        assert (token_shards.expand(s, rules, 10) == ids).all() and ends.sum() == last.sum()
        # no pair is left with MIN_USES places that don't overlap
        left = Counter()
        for (x, y), run in itertools.groupby(zip(s[:-1][~ends[:-1]].tolist(), s[1:][~ends[:-1]].tolist(), strict=True)):
            k = len(list(run))
            left[x, y] += (k + 1) // 2 if x == y else k
        assert max(left.values(), default=0) < token_shards.MIN_USES
    odd = "\x1c ΣΑΣ İstanbul ẞ ﬁn É. don't x<|endoftext|> y  3½"
    e = token_shards.encoder(WORD_BPE)
    assert np.frombuffer(e.encode(odd), "<u4").tolist() == e.tokenizer.encode(odd, add_special_tokens=False).ids


def test_re_pair_ends_when_no_pair_repeats():
    r = np.random.default_rng(8)
    ids = np.minimum(r.zipf(1.3, 60_000), 5000) + 2
    ids[r.integers(0, len(ids), 600)] = 2
    ids[1000:1100], ids[-1] = 7, 2
    s, last, rules = token_shards.re_pair(ids, ids == 2, 6000)
    assert (token_shards.expand(s, rules, 6000) == ids).all() and last.sum() == (ids == 2).sum()
    left = Counter()
    for k in range(len(s) - 1):
        if not last[k] and not (k > 1 and s[k - 1] == s[k] == s[k + 1]):
            left[s[k], s[k + 1]] += 1
    assert max(left.values()) < token_shards.MIN_USES


def test_words_are_those_of_the_library(monkeypatch):
    import random
    import unicodedata

    import pyarrow as pa

    monkeypatch.setattr(token_shards, "CHUNK", 5000)
    e, r = token_shards.encoder(WORD_BPE), random.Random(5)
    want = lambda t: e.tokenizer.encode(t, add_special_tokens=False).ids
    some = [chr(c) for c in range(0x250)] + list(" \t\n\r\v\f\u2000\u2028\u3000\u0301\u0307\u030a\u0331ΣσςКй語ﬁ½٣😀") + ["<|", "|>", "<|endoftext|>", "</w>", "'s", "don't", "I\u0307", "H\u0331", "Straße", "ÉCOLE", "Žižek", "12.5%", "a_b", "\x1c"]
    texts = ["", None, " ", "\u00a0", *some, *("".join(r.choices([*some, *[" "] * 200, *"abcdefghijklmnopqrstuvwxyzABCDEFG.,;:!?0123456789éÜ" * 6], k=r.randrange(60))) for _ in range(3000))]
    texts += [unicodedata.normalize("NFD", t or "") for t in texts[-300:]]
    ids, counts = e.encode_all(pa.array(texts), (2,))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*want(t or ""), 2] for t in texts]
    assert [len(x) for x in e.encode_all(pa.array([], pa.string()), (2,))] == [0, 0]
    # the same with runs of earlier portions kept, of which there are too many now and then
    for most in (0, 300, 5000):
        monkeypatch.setattr(token_shards, "MAX_RUNS", most)
        e.forget()
        parts = [e.encode_all(pa.array(texts[k : k + 400], pa.string()), (2,))[0] for k in range(0, len(texts), 400)]
        assert (np.concatenate(parts) == ids).all() and len(e.runs) <= most
    # portions of short and of empty batches, and of one that is longer than a portion
    batches = [pa.record_batch({"i": pa.array(range(a, b), pa.int64()), "t": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 3), (3, 3), (3, 10), (10, len(texts)))]
    parts = list(token_shards._portions(iter(batches)))
    assert len(parts) > 9 and [i for a, _ in parts for i in a.to_pylist()] == list(range(len(texts))) and [t for _, b in parts for t in b.to_pylist()] == [t or "" for t in texts]


def test_re_pair_looks_only_at_places_of_its_pairs():
    import time

    rare = np.random.default_rng(3).integers(10, 40_000, 3_000_000)
    # the run takes many rounds, and so does what is there four times when the run is done
    some = np.concatenate((np.full(1 << 18, 5), *[40_000 + np.random.default_rng(4).permutation(9000)] * 4, rare))

    def took(ids):
        began = time.thread_time()
        s, _, rules = token_shards.re_pair(ids, np.arange(len(ids)) == len(ids) - 1, 50_000)
        took = time.thread_time() - began
        assert (token_shards.expand(s, rules, 50_000) == ids).all()
        return took, len(rules)

    alone, (both, rounds) = min(took(rare) for _ in range(2)), min(took(some) for _ in range(2))
    assert rounds > 20 and both < 2 * alone[0], (alone, both, rounds)


def test_expansion_lays_out_short_rules_once():
    r = np.random.default_rng(6)
    once = r.integers(2, 300, 400)
    ids = np.concatenate([*(r.integers(2, 300, 30_000) for _ in range(2)), *[once] * 9, np.full(500, 7), r.integers(2, 30, 30_000)])
    s, _, rules = token_shards.re_pair(ids, np.arange(len(ids)) == len(ids) - 1, 300)
    length = token_shards._lengths(rules, 300)
    assert len(s) > 300 + len(length) and length.max() > token_shards.SHORT and (length[s[s >= 300] - 300] > token_shards.SHORT).any()
    assert (token_shards.expand(s, rules, 300) == ids).all() and (token_shards.expand(s, rules, 300, length) == ids).all()
    assert all((token_shards.expand(np.array([300 + k]), rules, 300, length) == token_shards.expand(rules_k, rules, 300, length)).all() for k, rules_k in enumerate(np.concatenate(rules)))
    # symbols that don't fit a word with their places make the same grammar
    far, _, more = token_shards.re_pair(ids + (1 << 30) - 300, np.arange(len(ids)) == len(ids) - 1, 1 << 30)
    assert (far - (1 << 30) + 300 == s).all() and (np.concatenate(more) - (1 << 30) + 300 == np.concatenate(rules)).all()


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    assert len(got) == len(ROWS)
    for r in got:
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and mixing.mix(empty).count() == 0


def test_mix_meets_targets(spark):
    rows = [(i, words(i, 5 + i % 40), f"s{0 if i % 3 else i % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.02 * r.g + 60 for r in got)


def test_near_dedup(spark, docs, empty):
    sets = {}
    for i, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}
    for a, b in itertools.combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    got = near_dedup.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(sets[i]), root.get(i), i is None or root[i] == i) for i, *_ in ROWS)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_families(spark):
    r = np.random.default_rng(3)
    rows = []
    for f in range(6):
        base = words(100 + f, 90).split()
        for _ in range(12):
            w = list(base)
            for _ in range(int(r.integers(0, 7))):
                w[int(r.integers(0, len(w)))] = words(int(r.integers(1000, 9000)), 1)
            rows.append((len(rows), words(77, 60) * int(f % 2) + " " + " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if v == hi else v for v in root]
    assert [got[i] for i in range(len(rows))] == root


def test_near_dedup_hot_lists(spark, monkeypatch):
    """Documents of one long common passage and own words: lists are hot, few are linked."""
    r, rows = np.random.default_rng(5), []
    common_part = words(50, 60)
    for f in range(70):
        own = words(2000 + f, 40).split()
        for copy in range(1 + f % 3):
            w = list(own)
            for _ in range(copy):
                w[int(r.integers(0, 40))] = words(int(r.integers(10_000, 90_000)), 1)
            rows.append((len(rows), common_part + " " + " ".join(w)))
    rows += [(len(rows) + i, common_part + " " + words(7000 + i, int(n))) for i, n in enumerate((3, 4, 5, 6, 8, 10, 200))]
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = [lo if v == hi else v for v in root]
    assert len(set(root)) < len(rows) - 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = near_dedup.hot_links
    used = []
    for block in (near_dedup.BLOCK, 500):  # in one block, and in many

        def links(member, sets, percent, block=block):
            used.append(member.count())
            return whole(member, sets, percent, block)

        monkeypatch.setattr(near_dedup, "hot_links", links)
        got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(d).collect()}
        assert [got[i] for i in range(len(rows))] == root
    assert min(used) > 100


def test_overlaps():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, n)).astype(np.uint64) for n in (0, 5, 60, 80, 200, 200, 100, 90, 250, 250, 250, 250)]
    both = near_dedup.overlaps(sets[:7], sets[7:])
    assert all(both[i, j] == len(set(x) & set(y)) for i, x in enumerate(sets[:7]) for j, y in enumerate(sets[7:]))
    own = near_dedup.overlaps(sets)
    assert all(own[i, j] == len(set(x) & set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)
    pairs = near_dedup.block_links(np.arange(12), sets, 30)
    linked = {(i, j) for i in range(12) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 30 * len(set(sets[i]) | set(sets[j])) > 0}
    nodes, root = near_dedup._small_components(np.array(sorted(linked)))
    assert {tuple(p) for p in pairs.tolist()} == {(n, x) for n, x in zip(nodes.tolist(), root.tolist(), strict=True) if n != x}


def test_long_texts_by_pieces():
    """Kernels give the same for a text in pieces as for the whole."""
    r = np.random.default_rng(9)
    for n in range(60):
        parts = [("ab" * int(r.integers(1, 90)) if r.random() < 0.03 else words(int(r.integers(0, 40)), 1)) + str(r.choice([" ", "\n", "  ", " \t", "\n\n", "é ", "# "])) for _ in range(int(r.integers(0, 160)))]
        data = np.frombuffer(("" if n % 2 else " ").join(["", *parts]).encode(), np.uint8)
        ends = np.array([0, len(data)])
        for limit in (16, 60, 300):
            assert (near_dedup.long_set(data, 3, limit) == near_dedup.shingle_sets(data, ends)[0]).all()
            whole = quality_rules._counts(data, ends)
            assert {k: int(v[0]) for k, v in quality_rules.long_counts(data, limit).items()} == {k: int(v[0]) for k, v in whole.items()}
            assert (resampling.tallied(data, 16, limit) == np.bincount(resampling.features(data, ends)[0], minlength=1 << 16)).all()


def test_a_very_long_text():
    """30 MB, one text: a few times its size in memory, not sixty times."""
    import resource

    text = (words(6, 40_000) + "\n") * 120
    data = np.frombuffer(text.encode(), np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = len(text.split())
    got = quality_rules.long_counts(data)
    assert got["n_words"][0] == n == 120 * 40_000 and got["n_dup_lines"][0] == 119 and got["n_repeat_words"][0] == n
    assert 39_000 < len(near_dedup.long_set(data)) <= 40_000 and resampling.tallied(data).sum() > 2 * n
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


def test_components_distributed_and_on_driver(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (100, 100), (3, 1)], "a long, b long")
    want = {i: (i // 10) * 10 for i in range(40)} | {100: 0}
    for limit in (0, 1000):
        got = {r.id: r.root for r in near_dedup.components(edges, on_driver=limit).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_exact_dedup(docs, empty):
    for keep in ("largest", "smallest"):
        got = exact_dedup.exact_dedup(docs, keep).collect()
        groups = {}
        for i, t, *_ in ROWS:
            groups.setdefault(t or "", []).append(i)
        assert len(got) == len(ROWS)
        for r in got:
            ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
            known = [i for i in ids if i is not None]
            best = (max if keep == "largest" else min)(known) if known else None
            assert (r.keep_id, r.group_size) == (best, len(ids)) and (not r.kept or r.doc_id == best)
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=\"ad\">Buy {n}</div>{body}<footer>&copy; {n}</footer></body></html>"


def test_wrapper_induction(spark):
    rows = [(1, "http://a.example/x", PAGE.format(n=1, body="<article><h1>T &amp; U</h1><p>One&nbsp; two<br>three<p>Four <b>5</b><form>x</form><div class='comments'>c</div></article>")), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "http://b.example", "<p>a<p>b")]
    rows += [(10 + i, f"https://h.example/{i}", PAGE.format(n=i, body=f"<div><div>Welcome to our site</div><div>Body {i} text</div></div>")) for i in range(8)]
    got = wrapper_induction.extract(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, n int, host string, ref string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == "T & U\nOne two three\nFour 5" and by[2].text == "" and by[3].n_chars == 0 and by[None].text == "a\nb"
    assert by[12].text == "Body 2 text" and by[12].n_chars == 11
    assert wrapper_induction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_constant_nodes_in_landmarks(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=i, body=f"<article><p>Story {i}</p><div class='more'>Read more here</div><div>Part {i}</div></article>")) for i in range(8)]
    got = wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i}\nPart {i}" for i in range(8)}


def test_wrapper_of_every_layout(spark):
    one = "<div><ul class=x><li>Start<li>Shop</ul><div>Item {n}</div></div>"
    two = "<section><section><table><tr><td>Same box</table></section><blockquote>Quote {n}</blockquote></section>"
    odd = "<div><ul class=x><li>Start<li>Shop</ul><div>Item {n}</div><dl><dt>Extra {n}</dl></div>"
    rows = [(0, "https://h.example/0", None), (1, "https://h.example/1", "<p>cut")]
    rows += [(i, f"https://h.example/{i}", f"<html><body>{(one if i % 2 else two).format(n=i)}</body></html>") for i in range(2, 22)]
    # a page with a text of its own comes first in its layout; a rare layout takes the nearest wrapper
    rows[2] = (2, rows[2][1], rows[2][2].replace("Same box", "Other box"))
    rows.append((22, "https://h.example/22", f"<html><body>{odd.format(n=22)}</body></html>"))
    got = {r.page_id: r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Item {i}" if i % 2 else f"Quote {i}" for i in range(3, 22)} | {0: "", 1: "cut", 22: "Item 22\nExtra 22"}
    assert {i: t for i, t in got.items() if i != 2} == want


def test_simple_tree_matching():
    a = wrapper_induction.Page("<body><nav></nav><div><p>x</div><footer></footer>").structure()
    b = wrapper_induction.Page("<body><div><p>y</div><section></section><footer></footer>").structure()
    labels = [x.split(" ", 1)[1] for x in a.split("\n")]
    found = wrapper_induction.align(a, b)
    assert found[labels.index("nav")] == -1 and found[labels.index("div")] >= 0 and found[labels.index("footer")] >= 0
    assert wrapper_induction.Page("<div>" * 3000 + "deep").text() == "deep"


def test_tree_matching_is_the_largest():
    r = __import__("random").Random(3)

    def brute(la, ka, lb, kb, x=0, y=0):
        if la[x] != lb[y]:
            return 0
        m = [[0] * (len(kb[y]) + 1) for _ in range(len(ka[x]) + 1)]
        for i, p in enumerate(ka[x]):
            for j, q in enumerate(kb[y]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute(la, ka, lb, kb, p, q))
        return m[-1][-1] + 1

    some = lambda: wrapper_induction.Page("<body>" + "".join(r.choice(["<div>", "<ul>", "<section class=x>", "</div>", "</ul>", "</section>", "t"]) for _ in range(r.randint(0, 22)))).structure()
    for _ in range(300):
        a, b = some(), some()
        (la, ka), (lb, kb), m = wrapper_induction._children(a), wrapper_induction._children(b), wrapper_induction.align(a, b)
        above_a, above_b = ({k: i for i, ks in enumerate(kids) for k in ks} for kids in (ka, kb))
        hit = [(x, y) for x, y in enumerate(m) if y >= 0]
        assert len(hit) == brute(la, ka, lb, kb) and all(la[x] == lb[y] and (not x or m[above_a[x]] == above_b[y]) for x, y in hit)


def test_large_trees_match_as_small_ones(monkeypatch):
    # 2,100 children that all differ, one more at either end of b: all of a has a partner
    bits = lambda i: [f"{'ul' if i >> k & 1 else 'section'}" for k in range(12)]
    kids = [["div", *bits(i)] for i in range(2_100)]

    def structure(kids):
        out = ["-1 html"]
        for head, *below in kids:
            at = len(out)
            out += [f"0 {head}", *(f"{at} {x}" for x in below)]
        return "\n".join(out)

    a, b = structure(kids), structure([["div"], *kids, ["div"]])
    assert wrapper_induction.align(a, b) == [0, *range(2, a.count("\n") + 2)]
    assert wrapper_induction.align(a, b.replace("html", "body")) == [-1] * (a.count("\n") + 1)
    # neither what is kept nor what is weighed together makes a difference
    r = __import__("random").Random(7)
    some = lambda: wrapper_induction.Page("<body>" + "".join(r.choice(["<div>", "<ul>", "<section class=x>", "</div>", "</ul>", "</section>"]) for _ in range(r.randint(0, 150)))).structure()
    cases = [(some(), some()) for _ in range(40)]
    want = [wrapper_induction.align(*x) for x in cases]
    for kept, own in ((1, 1 << 16), (200, 30), (1 << 24, 0)):
        monkeypatch.setattr(wrapper_induction, "KEPT_WEIGHTS", kept)
        monkeypatch.setattr(wrapper_induction, "OWN_PAIRS", own)
        assert [wrapper_induction.align(*x) for x in cases] == want


@pytest.mark.parametrize(
    "html, text",
    [
        ("<a " * 300_000, ""), ('<a ="' * 300_000, ""), ("<!" * 300_000, ""), ("<script>" + "</script " * 100_000, ""), ("<div a='" * 100_001 + ">x", "x"), ("<div " * 100_000 + ">x", "x"), ("a < b <3 </> c", "a < b <3 c"),
        ("<div class='a\nb' id=\"c\r\nd\">x<p title=it's>y</div>", "x\ny"), ("<!-- <p>no --><p>yes<!-- open <p>no", "yes"),
    ],
)
def test_odd_pages_take_linear_time(html, text):
    p = wrapper_induction.Page(html)
    assert p.text() == text and len(wrapper_induction._children(p.structure())[0]) == len(p.labels)
    wide = "\n".join(["-1 html", *(f"0 div.c{i * i % 901}" for i in range(10_000))])
    found = wrapper_induction.align(wide, wide.replace("c1", "c2"))
    assert found[0] == 0 and sorted(x for x in found if x >= 0) == [x for x in found if x >= 0]


def test_wrapper_pool_and_copies(spark):
    """Rotating texts outside a landmark go; a host of one page copied over keeps it."""
    rows = [(i, f"http://r.example/{i}", f"<body><div><div>Deal {i % 3}</div><div>Own story {i}</div></div>") for i in range(12)]
    rows += [(20 + i, f"http://c.example/{i}", "<body><article><p>The one story</article><div class=menu>m</div>") for i in range(8)]
    got = {r.page_id: r.text for r in wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own story {i}" for i in range(12)} | {20 + i: "The one story" for i in range(8)}


def test_byte_bpe(spark, docs, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text, *_ in ROWS:
        ids = t.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, RANKS, PATTERN).collect())) == want and bpe.round_trip(empty, RANKS, PATTERN).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert back[10] == ROWS[9][1] and back[4] == ""
    coder, r = bpe.load(RANKS, PATTERN), np.random.default_rng(1)
    for _ in range(300):
        x = "".join(chr(c) for c in r.choice([32, 10, 9, 160, 0x2028, 97, 98, 0x1F600, 0x300, 48, 33, 39, 0, 13], 40))
        ids = t.encode_ordinary(x)
        assert coder.encoded(x) == (len(ids), ",".join(map(str, ids)), x.encode())


def test_byte_bpe_merges_words_together(monkeypatch):
    """Distinct words aren't searched one by one, and results don't depend on where blocks end."""
    import pyarrow as pa
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t, coder, r = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.BytePairs(RANKS, PATTERN), np.random.default_rng(2)
    syllables = ["th", "er", "ing", "é", "tion", "日本", "ß", "'s", "7", " ", " ", " ", "\n", "  ", "\u3000", "!"]
    texts = ["".join(r.choice(syllables, 400)) for _ in range(60)] + ["", None, "a" * 3000, " "]
    want = [t.encode_ordinary(x or "") for x in texts]
    one_by_one, encode_bytes = [], coder.encode_bytes
    monkeypatch.setattr(coder, "encode_bytes", lambda w: one_by_one.append(w) or encode_bytes(w))
    words = " ".join("".join(r.choice(["th", "er", "ing", "on", "ble", "wh"], 6)) for _ in range(20_000))
    assert coder.encoded(words)[1] == ",".join(map(str, t.encode_ordinary(words))) and len(one_by_one) < 200
    for block in (bpe.BLOCK, 70):
        monkeypatch.setattr(bpe, "BLOCK", block)
        got = [(b"", b"") for _ in texts]
        for i, n, ids, back in coder.portions(pa.array(["", *texts], pa.string())[1:]):
            assert bytes(ids).count(b",") == n
            got[i] = got[i][0] + ids, got[i][1] + back
        assert got == [("".join(f",{i}" for i in x).encode(), (y or "").encode()) for x, y in zip(want, texts, strict=True)]
