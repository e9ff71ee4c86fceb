"""Near dedup by bottom-k sketches of one hash function.

A document's set is its distinct 3-word shingles as 64-bit hashes; its sketch is the k
smallest. Equal sets are collapsed first (a group of copies is one set). Inverted lists
of the retained values generate candidates, the k smallest of two sketches' union
estimate their similarity and filter, and the full sets verify exactly.

Two sets with 100 * intersection >= 85 * union share, of their sketches' values, at
least ``needed`` but for a probability under 1e-8 (sets of up to ``k`` shingles: always).
So a set enters only the lists of its ``size - needed + 1`` rarest values: any two that
share ``needed`` values meet in one of them (prefix filtering). Values of a passage that
many documents share are frequent and drop out, unless they are most of the document.

Each list then links its members to its smallest id alone. What is still in different
components is looked at further: short lists give their pairs (at most ``HOT`` for each
entry). Members of longer lists are put into groups (what such lists connect), a group is
cut into blocks of about ``BLOCK`` shingles, and a task compares the full sets of two
blocks; it returns only the edges of a forest. So no pairs are written for a hot list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

K = 64
NEEDED = 35
PERCENT = 85
#: A list of more members than this gives no pairs; its members are compared in blocks.
HOT = 16
#: Shingles in a block of a group, and documents that are compared at once in a task.
BLOCK = 1 << 20
TILE = 1024
FILTER_BITS = 1 << 26


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    w = vec.Words(data, offsets, lower=True)
    at, h = w.windows(width)
    doc = w.doc[at]
    n_words = w.counts()
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(w.doc, short)
        hs = vec.mix(w.hash[first] + n_words[short].astype(vec.U64))
        for k in range(1, width - 1):
            more = np.flatnonzero(n_words[short] > k)
            hs[more] = vec.mix(hs[more] * vec.U64(0xD6E8FEB86659FD93) + w.hash[first[more] + k])
        doc, h = np.concatenate((doc, short)), np.concatenate((h, hs))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    at = common.group_starts(doc, h)
    doc, h = doc[at], h[at]
    cuts = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return [h[cuts[i] : cuts[i + 1]] for i in range(w.n_docs)]


def long_set(data: np.ndarray, width: int = 3, limit: int | None = None) -> np.ndarray:
    """The same of one long text, by pieces."""
    found, n_words = [], 0
    for start, end, _ in vec.pieces(data, width - 1, limit):
        w = vec.Words(data[start:end], np.array([0, end - start]), lower=True)
        n_words += len(w.start)
        found.append(np.unique(w.windows(width)[1]))
    if n_words < width:
        return shingle_sets(data, np.array([0, len(data)]), width)[0]
    return np.unique(np.concatenate(found))


def chunk_sets(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    part = data[offsets[lo] : offsets[hi]]
    return [long_set(part)] if len(part) > vec.PIECE_BYTES else shingle_sets(part, offsets[lo : hi + 1] - offsets[lo])


def _sketch_batches(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.utf8(b.column(1))
            n, sig, sig2, sketch = [], [], [], []
            for lo, hi in vec.chunks(offsets):
                sets = chunk_sets(data, offsets, lo, hi)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, vec.U64)
                ends = np.cumsum(sizes)
                for out, m in ((sig, flat), (sig2, vec.mix(flat + vec.BASE))):
                    total = np.concatenate((np.zeros(1, vec.U64), np.cumsum(m, dtype=vec.U64)))
                    out.append((total[ends] - total[ends - sizes]).view(np.int64))
                n.append(sizes)
                sketch += [s[:k].view(np.int64) for s in sets]
            cuts = np.concatenate(([0], np.cumsum([len(s) for s in sketch]))).astype(np.int32)
            values = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cat(n)), pa.array(cat(sig)), pa.array(cat(sig2)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], names=["doc_id", "n", "sig", "sig2", "sketch"]
            )
        common.release_memory()

    return run


def _set_batches(bitmap: np.ndarray) -> Callable:
    """Sets of the documents whose id is in the (bounded, one-sided) filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(len(bitmap) * 64 - 1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            slot = vec.mix(ids.astype(np.int64).view(vec.U64)) & bits
            hit = np.flatnonzero((bitmap[(slot >> vec.U64(6)).astype(np.int64)] >> (slot & vec.U64(63))) & vec.U64(1))
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            data, offsets = vec.utf8(b.column(1))
            body: list[bytes] = []
            for lo, hi in vec.chunks(offsets):
                body += [s.tobytes() for s in chunk_sets(data, offsets, lo, hi)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(body, pa.binary())], names=["s_id", "body"])
        common.release_memory()

    return run


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of the k smallest values of the union that both sketches hold."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / max(1, len(union))


def _estimate_batches(k: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for c in (2, 3):
                lists = b.column(c)
                cols.append((lists.flatten().to_numpy().view(vec.U64), np.asarray(lists.offsets) - lists.offsets[0].as_py()))
            (va, oa), (vb, ob) = cols
            ok = np.fromiter((estimate(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], k) >= least for i in range(b.num_rows)), bool, b.num_rows)
            b = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])
        common.release_memory()

    return run


def _verify_batches(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(2)[i].as_buffer(), vec.U64)
                y = np.frombuffer(b.column(3)[i].as_buffer(), vec.U64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both) and both > 0
            b = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])
        common.release_memory()

    return run


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits of hashed ids. Its size is fixed: with more ids it
    lets more rows through, which the join after it sorts out."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = vec.mix(b.column(0).to_numpy().view(vec.U64)) & vec.U64(FILTER_BITS - 1)
            yield pa.RecordBatch.from_arrays([pa.array((s >> vec.U64(6)).astype(np.int64)), pa.array((vec.U64(1) << (s & vec.U64(63))).view(np.int64))], names=["at", "bits"])

    words = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").mapInArrow(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, vec.U64)
    bitmap[found["at"].to_numpy()] = found["bits"].to_numpy().view(vec.U64)
    return bitmap


def _small_components(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and roots of few edges: roots sink to the smallest neighbour until stable."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    u, v = flat.reshape(pairs.shape).T
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for x in (u, v, root[u], root[v]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, on_driver: int = 500_000) -> DataFrame:
    """``id, root``: the smallest id of each node's component, by alternating large-star
    and small-star steps; lineage is cut by a table each round. Up to ``on_driver``
    edges (16 bytes each, counted first) are settled on the driver instead."""
    e = common.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    n = e.count()
    if n <= on_driver:
        t = e.toArrow()
        common.drop(e)
        nodes, root = _small_components(np.stack([t["u"].to_numpy(), t["v"].to_numpy()], 1)) if n else (np.zeros(0, np.int64),) * 2
        return e.sparkSession.createDataFrame(pa.table({"id": nodes.astype(np.int64), "root": root.astype(np.int64)}))
    before = None
    while True:  # both steps only lower the nodes' neighbours, so it comes to rest
        # large star: every larger neighbour of a node is linked to its smallest neighbour
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(m, "u")
        e, old = common.table(j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges"), e
        common.drop(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """The sizes of the intersections of each of the sets x with each of the sets y (or
    of x; then those of a set with itself stay 0 for values of no other)."""
    both, m = [*x, *(y or [])], len(x)
    sizes = np.array([len(s) for s in both])
    values, doc = np.concatenate(both), np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(values)
    values, doc = values[order], doc[order]
    starts = common.group_starts(values)
    count = np.diff(np.append(starts, len(values)))
    lo, width = (m, len(both) - m) if y is not None else (0, m)
    out = np.zeros((m, width), np.float32)
    # a value of few sets adds one to each of its pairs; the others are columns of a matrix
    flat = []
    for c in range(2, 9):
        rows = doc[starts[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(c):
                if i != j:
                    across = (rows[:, i] < m) & (rows[:, j] >= lo)
                    flat.append(rows[across, i] * width + rows[across, j] - lo)
    if flat:
        out += np.bincount(np.concatenate(flat), minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(count > 8)
    for k in range(0, len(often), 4096):
        at = often[k : k + 4096]
        n = count[at]
        part = np.zeros((len(both), len(at)), np.float32)
        part[doc[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(at)), n)] = 1
        out += part[:m] @ part[lo:].T
    return out


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Edges (larger id, smaller id) of a forest whose trees are the components of the
    similar pairs among the sets."""
    edges = [np.zeros((0, 2), np.int64)]
    size = np.array([len(s) for s in sets], np.float64)
    order = np.argsort(size, kind="stable")
    tiles = [order[i : i + TILE] for i in range(0, len(order), TILE)]
    for k, p in enumerate(tiles):
        for q in tiles[k:]:
            if 100 * size[p[-1]] < percent * size[q[0]]:
                break
            both = overlaps([sets[i] for i in p], None if p is q else [sets[i] for i in q])
            ok = (100 * both >= percent * (size[p][:, None] + size[q][None] - both)) & (both > 0)
            i, j = np.nonzero(ok)
            found = np.stack([ids[p[i]], ids[q[j]]], 1)
            edges.append(found[found[:, 0] != found[:, 1]])
    pairs = np.concatenate(edges)
    if not len(pairs):
        return pairs
    nodes, root = _small_components(pairs)
    return np.stack([nodes, root], 1)[nodes != root]


def _block_batches(percent: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t["doc_id"].to_numpy(), return_index=True)
        body = t["body"].combine_chunks()
        found = block_links(ids, [np.frombuffer(body[i].as_buffer(), vec.U64) for i in first], percent)
        if t.nbytes > 1 << 22:
            del body, t
            common.release_memory()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def hot_members(hot: DataFrame, percent: int) -> DataFrame:
    """hot: v, doc_id, n. The groups that hot lists connect, in cells: sets of a ratio of
    sizes of percent / 100 or more meet in one cell."""
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) + 1e-9))
    first = hot.groupBy("v").agg(F.min("doc_id").alias("b"))
    group = components(hot.join(first, "v").select(F.col("doc_id").alias("a"), "b"))
    member = hot.select("doc_id", "n").distinct().join(group, F.col("doc_id") == F.col("id"), "left")
    return common.table(member.select("doc_id", "n", F.coalesce("root", "doc_id").alias("g"), F.explode(F.array(band, band - 1)).alias("cell")), "members")


def hot_links(member: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links within the groups: each pair of blocks of a cell is compared in one task."""
    blocks = member.groupBy("g", "cell").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("c")).where("c > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    placed = member.join(blocks, ["g", "cell"]).select("doc_id", "n", "g", "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("doc_id", "n", "g", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    joined = placed.join(sets, (F.col("doc_id") == F.col("s_id")) & (F.octet_length("body") == 8 * F.col("n"))).select("g", "cell", "i", "j", "doc_id", "body")
    return common.table(joined.groupBy("g", "cell", "i", "j").applyInArrow(_block_batches(percent), "a long, b long"), "links")


def likely(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches' union estimates a similarity near enough."""
    x = sketches.select(F.col("doc_id").alias("xa"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("doc_id").alias("yb"), F.col("sketch").alias("sb"))
    with_sketches = pairs.join(x, F.col("a") == F.col("xa")).join(y, F.col("b") == F.col("yb")).select("a", "b", "sa", "sb")
    return common.table(with_sketches.mapInArrow(_estimate_batches(k, percent / 100 - 0.3), "a long, b long"), "pairs")


def full_sets(ids: DataFrame, src: DataFrame) -> DataFrame:
    """``s_id, body`` of the documents that ``id`` names; others may be among them."""
    return common.table(src.mapInArrow(_set_batches(id_filter(ids, "id")), "s_id long, body binary"), "sets")


def both_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough."""
    t = sets.select(F.col("s_id").alias("t_id"), F.col("body").alias("t_body"))
    j = pairs.join(sets, F.col("a") == F.col("s_id")).join(t, F.col("b") == F.col("t_id")).select("a", "b", "body", "t_body")
    return common.table(j.mapInArrow(_verify_batches(percent), "a long, b long"), "links")


def near_dedup(docs: DataFrame, percent: int = PERCENT, k: int = K, needed: int = NEEDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased (A-Z). A text with fewer than three words is one shingle; a
    null or empty text, or one without words, has an empty set, is linked with nothing,
    and is kept. A null id is linked with nothing either and has a null component; it
    is kept. Rows that repeat an id count as one document with the first of its sets
    (the smallest by signature) and give one result each. Other columns aren't read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.table(src.mapInArrow(_sketch_batches(k), "doc_id long, n long, sig long, sig2 long, sketch array<long>"), "sketches")
    # one representative, the smallest id, of each distinct set
    full = rows.where("n > 0 and doc_id is not null")
    reps = full.groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("doc_id"))
    equal = full.select("doc_id", "n", "sig", "sig2").join(reps.withColumnRenamed("doc_id", "rep"), ["n", "sig", "sig2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    equal = common.table(equal, "equal")
    sketches = common.table(full.join(equal.select(F.col("a").alias("doc_id")), "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct("n", "sketch"), F.struct("n", "sig", "sig2")).alias("s")).select("doc_id", "s.n", "s.sketch"), "sets")
    # frequencies of retained values; a value of one document lists nothing
    values = sketches.select("doc_id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(often, "v")
    least = F.when(F.col("s") <= 54, F.ceil(F.col("s") * F.lit(percent) / 100)).otherwise(F.lit(needed))
    per_doc = shared.groupBy("doc_id", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))  # at most k values
    rare = F.col("s") - F.size("vs")
    room = (F.col("s") - least + 1 - rare).cast("int")
    lists = common.table(per_doc.where(room > 0).select("doc_id", "n", F.explode(F.slice("vs", F.lit(1), room)).alias("x")).select("doc_id", "n", F.col("x.v").alias("v")), "lists")
    # first links: each member to the smallest id of its list
    hub = lists.groupBy("v").agg(F.min_by(F.struct("doc_id", "n"), F.struct("doc_id", "n")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select("v", F.col("h.doc_id").alias("a"), F.col("h.n").alias("na"))
    stars = lists.join(hub, "v").where(F.col("doc_id") != F.col("a")).where(_sizes_fit("n", "na", percent)).select("a", F.col("doc_id").alias("b")).distinct()
    stars = common.table(stars, "stars")
    pairs = likely(stars, sketches, k, percent)
    sets = full_sets(both_ids(pairs), src)
    links = verified(pairs, sets, percent)
    common.drop(pairs, sets)
    roots = components(links)
    # further pairs of a list only across components
    rooted = lists.join(roots, lists["doc_id"] == roots["id"], "left").select("v", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    split = rooted.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("v", "c")
    open_ = common.table(rooted.join(split, "v").select("v", F.struct("doc_id", "n", "root").alias("m"), "c"), "open")
    common.drop(lists)
    cold = open_.where(F.col("c") <= HOT)
    p, q = cold.select("v", F.col("m").alias("p")), cold.select("v", F.col("m").alias("q"))
    cross = p.join(q, "v").where((F.col("p.doc_id") < F.col("q.doc_id")) & (F.col("p.root") != F.col("q.root"))).where(_sizes_fit("p.n", "q.n", percent))
    more = common.table(cross.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "cross")
    common.drop(stars)
    pairs = likely(more, sketches, k, percent)
    common.drop(more, sketches)
    member = hot_members(open_.where(F.col("c") > HOT).select("v", "m.doc_id", "m.n"), percent)
    common.drop(open_)
    sets = full_sets(both_ids(pairs).unionAll(member.select("doc_id")), src)
    further = verified(pairs, sets, percent)
    within = hot_links(member, sets, percent)
    common.drop(pairs, member, sets)
    final = components(equal.unionAll(links).unionAll(further).unionAll(within))
    common.drop(equal, links, further, within)
    out = rows.select("doc_id", "n").join(final, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))
