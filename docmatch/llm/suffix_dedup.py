"""Removal of long repeated substrings with a logarithmic family of suffix arrays.

A byte goes if it lies in a ``length``-byte string that also starts in a document with a
smaller id. Sorting the suffixes at all positions would move 16 times the input, so the
suffix arrays are sparse: a suffix is indexed where the hash of its first ``GRAM`` bytes
is the smallest among the starts inside some ``length``-byte window (a minimizer). Equal
windows have their minimizer at the same place, so no match is lost.

1. Grams: each part of the documents sends its anchors' hashes to buckets; anchors whose
   gram is in one document only are settled there and never move again.
2. Suffixes: the others carry the digest of their context, all the bytes of the
   windows that they stand for. A bucket takes them in batches of ascending ids: each
   batch is sorted (its suffix array), merge-scanned against the levels that exist, and
   becomes a level itself; levels of equal size merge. A hit covers all those windows.
3. Windows: anchors without a hit whose halves agree with another document's (the ends
   of matches) are compared window by window.
4. The covered ranges return to the documents' parts, which cut them out.

Within a part only the smallest id per gram, context or window is sent on, so a passage
in a third of all documents costs a bucket one entry per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

LENGTH = 50
GRAM = 24
CHUNK = 1 << 18
U = vec.U64


def _slide(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over every ``width`` neighbours."""
    s = 1
    while s * 2 <= width:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (width - s)], a[width - s :]) if s < width else a


def gram_hash(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    x = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = x[:n] * U(0x9E3779B97F4A7C15) + x[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F)
    return vec.mix(vec.mix(h) + x[16 : 16 + n])


class Part:
    """Documents of one part in order of id (and text, for rows that repeat an id),
    without those of null id."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        ids = table["doc_id"].combine_chunks()
        self.null = table.filter(ids.is_null())
        table = table.filter(ids.is_valid())
        ids = table["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            texts = table["text"].to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")), np.int64)
        table = table.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = vec.utf8(table["text"])
        self._at: list[tuple[int, int]] = list(vec.chunks(self.offsets, CHUNK))

    def anchors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk of documents: first byte, anchor positions in it, their gram hashes,
        and for every window the smallest hash (0: no window)."""
        n_starts = self.length - GRAM + 1
        for lo, hi in self._at:
            a, b = int(self.offsets[lo]), int(self.offsets[hi])
            if b - a < self.length:
                continue
            data, off = self.data[a:b], self.offsets[lo : hi + 1] - a
            h = gram_hash(data)
            least = _slide(h, n_starts, np.minimum)
            left = np.repeat(off[1:], np.diff(off))[: len(least)] - np.arange(len(least))
            least[left < self.length] = 0
            padded = np.zeros(len(h) + n_starts - 1, U)
            padded[n_starts - 1 : n_starts - 1 + len(least)] = least
            top = _slide(padded, n_starts, np.maximum)
            at = np.flatnonzero((top == h) & (top > 0))
            yield a, at, h[at], least, data

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(40)) % U(n)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    starts = common.group_starts(bucket[order])
    return order, starts, np.append(starts, len(order))[1:]


ROWS = "bucket int, part int, kind int, blob binary"
BACK = "part int, bucket int, kind int, blob binary"
SHIPPED, DIRECT = 0, 1


def _rows(names: list[str], cols: list[list]) -> pa.Table:
    kinds = {"blob": pa.binary()}
    return pa.table({n: pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(names, cols, strict=True)})


def _gram_state(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All anchors of the part: hash, number of the id, whether it is known to be in two
    documents, and whether it is sent (once per gram that is)."""
    hs, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, at, h, _, _ in part.anchors():
        hs.append(h)
        docs.append(part.doc_of(at + a))
    h, doc = np.concatenate(hs), np.concatenate(docs)
    number = common.spread(common.group_starts(part.ids), len(part.ids))[doc] if len(doc) else doc
    order = np.lexsort((number, h))
    starts = common.group_starts(h[order])
    ends = np.append(starts[1:], len(order)) - 1
    many_groups = number[order][starts] != number[order][ends] if len(order) else np.zeros(0, bool)
    many = np.zeros(len(h), bool)
    many[order] = many_groups[common.spread(starts, len(order))] if len(order) else False
    sent = ~many
    sent[order[starts[many_groups]]] = True
    return h, number, many, sent


def _grams(n_buckets: int, length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        part = Part(table, length)
        h, number, many, sent = _gram_state(part)
        h, number, many = h[sent], number[sent], many[sent]
        order, starts, ends = _by_bucket(_bucket(h, n_buckets))
        h, number, many = h[order], number[order], many[order]
        bucket, blob = [], []
        for s, e in zip(starts, ends, strict=True):
            bucket.append(int(_bucket(h[s : s + 1], n_buckets)[0]))
            blob.append(common.low_planes(h[s:e], 7) + common.planes(common.deltas(number[s:e]).astype("<i4")) + many[s:e].tobytes())
        part_no = table["part"][0].as_py()
        return _rows(["bucket", "part", "kind", "blob"], [bucket, [part_no] * len(bucket), [SHIPPED] * len(bucket), blob])

    return run


def _gram_bucket(table: pa.Table) -> pa.Table:
    """Per part, one bit for each of its grams: whether two documents have it."""
    hs, docs, manys, sizes = [], [], [], []
    parts = table["part"].to_pylist()
    for p, blob in zip(parts, table["blob"].to_pylist(), strict=True):
        n = len(blob) // 12
        hs.append(common.unplanes(blob[: 7 * n], n, "<u8", 7))
        docs.append(np.cumsum(common.unplanes(blob[7 * n : 11 * n], n, "<i4")).astype(np.int64) + (p << 32))
        manys.append(np.frombuffer(blob[11 * n :], bool))
        sizes.append(n)
    h, doc, many = np.concatenate(hs), np.concatenate(docs), np.concatenate(manys)
    order = np.lexsort((doc, h))
    starts = common.group_starts(h[order])
    ends = np.append(starts[1:], len(order)) - 1
    d = doc[order]
    hit = (d[starts] != d[ends]) | np.logical_or.reduceat(many[order], starts)
    out = np.zeros(len(h), bool)
    out[order] = hit[common.spread(starts, len(order))]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    blobs = [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    n = len(parts)
    return _rows(["part", "bucket", "kind", "blob"], [parts, table["bucket"].to_pylist(), [SHIPPED] * n, blobs])


def pack_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges of documents, merged where they touch."""
    if not len(doc):
        return b""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    top = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * top)
    new = np.ones(len(doc), bool)
    new[1:] = (start + doc * top)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    out = np.stack([doc[at], start[at], reach[last] - doc[at] * top]).astype("<i4")
    return b"".join(common.planes(x) for x in (common.deltas(out[0]), out[1], out[2] - out[1]))


def unpack_ranges(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 12
    d, s, e = (common.unplanes(blob[4 * n * i : 4 * n * (i + 1)], n, "<i4").astype(np.int64) for i in range(3))
    return np.cumsum(d), s, s + e


def _suffixes(n_buckets: int, length: int) -> Callable:
    n_starts = length - GRAM + 1
    half = -(-(length - GRAM) // 2)

    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(["bucket", "part", "kind", "blob"], [[], [], [], []])
        part = Part(table, length)
        h, number, many, sent = _gram_state(part)
        chosen = many.copy()
        at = np.flatnonzero(sent)
        bucket = _bucket(h[at], n_buckets)
        order, starts, ends = _by_bucket(bucket)
        found = dict(zip(bits["bucket"].to_pylist(), bits["blob"].to_pylist(), strict=True))
        for s, e in zip(starts, ends, strict=True):
            mark = np.unpackbits(np.frombuffer(found[int(bucket[order[s]])], np.uint8), count=e - s).astype(bool)
            chosen[at[order[s:e]]] |= mark
        cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        seen = 0
        for first, pos, gh, least, data in part.anchors():
            mine = chosen[seen : seen + len(pos)]
            seen += len(pos)
            a, gh = pos[mine], gh[mine]
            if not len(a):
                continue
            span = a[:, None] - np.arange(n_starts - 1, -1, -1)
            ok = (span >= 0) & (span < len(least))
            ok &= least[np.clip(span, 0, len(least) - 1)] == gh[:, None]
            lo = span[np.arange(len(a)), ok.argmax(1)]
            hi = span[np.arange(len(a)), n_starts - 1 - ok[:, ::-1].argmax(1)]
            prefix = vec.prefix_hash(data)
            inverse = vec._power_tables(len(data) + 1)[1]
            hashed = lambda s, e: vec.mix((prefix[e] - prefix[s]) * inverse[s])  # noqa: E731, B023
            doc = part.doc_of(a + first)
            begin, end = part.offsets[doc] - first, part.offsets[doc + 1] - first
            key = vec.mix(vec.mix(hashed(lo, hi + length) + ((a - lo) * 4096 + (hi - lo)).astype(U)) + gh)
            ls, re = np.maximum(a - half, begin), np.minimum(a + GRAM + half, end)
            left = vec.mix(vec.mix(hashed(ls, a) + (a - ls).astype(U)) + gh)
            right = vec.mix(vec.mix(hashed(a, re) + (re - a).astype(U) + U(1 << 20)) + gh)
            for c, x in zip(cols, (gh, key, left, right, doc, lo - begin, hi - lo), strict=True):
                c.append(x)
        part_no = table["part"][0].as_py()
        if not cols[0]:
            return _rows(["bucket", "part", "kind", "blob"], [[], [], [], []])
        gh, key, left, right, doc, lo, more = map(np.concatenate, cols)
        ids = part.ids[doc]
        # only the smallest id of each context leaves the part
        order = np.lexsort((ids, key))
        starts = common.group_starts(key[order])
        smallest = ids[order][starts][common.spread(starts, len(order))]
        covered = np.zeros(len(order), bool)
        covered[order] = ids[order] > smallest
        bucket_col, kind, blob = [part_no % n_buckets], [DIRECT], [pack_ranges(doc[covered], lo[covered], (lo + more)[covered] + length)]
        rest = np.flatnonzero(~covered)
        order, starts, ends = _by_bucket(_bucket(gh[rest], n_buckets))
        for s, e in zip(starts, ends, strict=True):
            i = rest[order[s:e]]
            bucket_col.append(int(_bucket(gh[i[:1]], n_buckets)[0]))
            kind.append(SHIPPED)
            blob.append(
                common.planes(key[i]) + common.low_planes(left[i], 5) + common.low_planes(right[i], 5) + common.planes(common.deltas(ids[i]).astype("<i8"))
                + common.planes(common.deltas(doc[i]).astype("<i4")) + common.planes(lo[i].astype("<i4")) + more[i].astype(np.uint8).tobytes()
            )
        return _rows(["bucket", "part", "kind", "blob"], [bucket_col, [part_no] * len(kind), kind, blob])

    return run


class SuffixLevels:
    """A logarithmic family of sorted runs of suffix keys with their smallest id."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the smallest id that a level has for each (or the largest
        integer)."""
        best = np.full(len(keys), np.iinfo(np.int64).max)
        for have, ids in self.levels:
            at = np.searchsorted(have, keys)
            at[at == len(have)] = 0
            best = np.where(have[at] == keys, np.minimum(best, ids[at]), best)
        return best

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """A batch's sorted distinct keys become a level; equal-sized levels merge."""
        if not len(keys):
            return
        run = (keys, ids)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(run[0]):
            have, have_ids = self.levels.pop()
            k, i = np.concatenate((have, run[0])), np.concatenate((have_ids, run[1]))
            order = np.argsort(k, kind="stable")  # merges two sorted runs
            k, i = k[order], i[order]
            starts = common.group_starts(k)
            run = (k[starts], np.minimum.reduceat(i, starts))
        self.levels.append(run)


def covered_by_levels(keys: np.ndarray, ids: np.ndarray, batch: int = 1 << 16) -> np.ndarray:
    """Which suffixes have a key that a smaller id has too."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(ids, kind="stable")
    index, at = SuffixLevels(), 0
    while at < len(order):
        end = min(at + batch, len(order))
        # documents stay whole: a batch ends where the id changes
        end = int(np.searchsorted(ids[order], ids[order[end - 1]], "right"))
        mine = order[at:end]
        mine = mine[np.lexsort((ids[mine], keys[mine]))]
        k, i = keys[mine], ids[mine]
        starts = common.group_starts(k)
        known = np.minimum(index.scan(k[starts]), i[starts])
        out[mine] = i > known[common.spread(starts, len(k))]
        index.add(k[starts], i[starts])
        at = end
    return out


def _suffix_bucket(table: pa.Table, length: int) -> pa.Table:
    """Per part: covered ranges (kind DIRECT), and ranges to compare by window."""
    direct = table.filter(pc.equal(table["kind"], DIRECT))
    table = table.filter(pc.equal(table["kind"], SHIPPED))
    out_part, out_kind, out_blob = direct["part"].to_pylist(), [DIRECT] * direct.num_rows, direct["blob"].to_pylist()
    parts = table["part"].to_pylist()
    cols: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
    sizes = []
    for blob in table["blob"].to_pylist():
        n = len(blob) // 35
        at = np.cumsum([0, 8, 5, 5, 8, 4, 4, 1]) * n
        piece = [blob[at[i] : at[i + 1]] for i in range(7)]
        for c, x in zip(
            cols,
            (
                common.unplanes(piece[0], n, "<u8"), common.unplanes(piece[1], n, "<u8", 5), common.unplanes(piece[2], n, "<u8", 5), np.cumsum(common.unplanes(piece[3], n, "<i8")),
                np.cumsum(common.unplanes(piece[4], n, "<i4")).astype(np.int64), common.unplanes(piece[5], n, "<i4").astype(np.int64), np.frombuffer(piece[6], np.uint8).astype(np.int64),
            ), strict=True,
        ):
            c.append(x)
        sizes.append(n)
    if sizes:
        key, left, right, ids, doc, lo, more = map(np.concatenate, cols)
        covered = covered_by_levels(key, ids)
        rest = np.flatnonzero(~covered)
        compare = np.zeros(len(key), bool)
        for side in (left, right):
            order = rest[np.lexsort((ids[rest], side[rest]))]
            if not len(order):
                continue
            starts = common.group_starts(side[order])
            ends = np.append(starts[1:], len(order)) - 1
            mixed = ids[order[starts]] != ids[order[ends]]
            compare[order] |= mixed[common.spread(starts, len(order))]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        for p, a, b in zip(parts, cuts, cuts[1:], strict=False):
            c = np.flatnonzero(covered[a:b]) + a
            if len(c):
                out_part.append(p)
                out_kind.append(DIRECT)
                out_blob.append(pack_ranges(doc[c], lo[c], lo[c] + more[c] + length))
            c = np.flatnonzero(compare[a:b]) + a
            if len(c):
                out_part.append(p)
                out_kind.append(SHIPPED)
                out_blob.append(pack_ranges(doc[c], lo[c], lo[c] + more[c] + 1))
    return _rows(["part", "bucket", "kind", "blob"], [out_part, [0] * len(out_part), out_kind, out_blob])


def _suffix_buckets(length: int) -> Callable:
    return lambda table: _suffix_bucket(table, length)


def _unite(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [unpack_ranges(b) for b in blobs]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range of each."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def _windows(n_buckets: int, length: int) -> Callable:
    def run(table: pa.Table, ranges: pa.Table) -> pa.Table:
        if not table.num_rows or not ranges.num_rows:
            return _rows(["bucket", "part", "kind", "blob"], [[], [], [], []])
        part, part_no = Part(table, length), table["part"][0].as_py()
        kinds, blobs = ranges["kind"].to_pylist(), ranges["blob"].to_pylist()
        done = _unite([b for k, b in zip(kinds, blobs, strict=True) if k == DIRECT])
        doc, start, end = unpack_ranges(pack_ranges(*_unite([b for k, b in zip(kinds, blobs, strict=True) if k == SHIPPED])))
        bucket_col, kind, blob = [], [], []
        if len(doc):
            at, which = _expand(start, end)
            doc = doc[which]
            absolute = part.offsets[doc] + at
            prefix = None
            h = np.zeros(len(at), U)
            for lo, hi in part._at:  # hashes by chunk, with tables of bounded size
                a, b = part.offsets[lo], part.offsets[hi]
                i = np.flatnonzero((absolute >= a) & (absolute < b))
                if len(i):
                    prefix = vec.prefix_hash(part.data[a:b])
                    s = absolute[i] - a
                    h[i] = vec.mix((prefix[s + length] - prefix[s]) * vec._power_tables(int(b - a) + 1)[1][s])
            ids = part.ids[doc]
            order = np.lexsort((ids, h))
            starts = common.group_starts(h[order])
            covered = np.zeros(len(order), bool)
            covered[order] = ids[order] > ids[order][starts][common.spread(starts, len(order))]
            done = tuple(np.concatenate(x) for x in zip(done, (doc[covered], at[covered], at[covered] + length), strict=True))
            rest = np.flatnonzero(~covered)
            order, starts, ends = _by_bucket(_bucket(h[rest], n_buckets))
            for s, e in zip(starts, ends, strict=True):
                i = rest[order[s:e]]
                bucket_col.append(int(_bucket(h[i[:1]], n_buckets)[0]))
                kind.append(SHIPPED)
                blob.append(common.planes(h[i]) + common.planes(common.deltas(ids[i]).astype("<i8")) + common.planes(common.deltas(doc[i]).astype("<i4")) + common.planes(common.deltas(at[i]).astype("<i4")))
        bucket_col.append(part_no % n_buckets)
        kind.append(DIRECT)
        blob.append(pack_ranges(*done))
        return _rows(["bucket", "part", "kind", "blob"], [bucket_col, [part_no] * len(kind), kind, blob])

    return run


def _window_bucket(length: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        direct = table.filter(pc.equal(table["kind"], DIRECT))
        table = table.filter(pc.equal(table["kind"], SHIPPED))
        out_part, out_blob = direct["part"].to_pylist(), direct["blob"].to_pylist()
        hs, idl, docs, ats, sizes = [], [], [], [], []
        for blob in table["blob"].to_pylist():
            n = len(blob) // 24
            hs.append(common.unplanes(blob[: 8 * n], n, "<u8"))
            idl.append(np.cumsum(common.unplanes(blob[8 * n : 16 * n], n, "<i8")))
            docs.append(np.cumsum(common.unplanes(blob[16 * n : 20 * n], n, "<i4")).astype(np.int64))
            ats.append(np.cumsum(common.unplanes(blob[20 * n :], n, "<i4")).astype(np.int64))
            sizes.append(n)
        if sizes:
            h, ids, doc, at = map(np.concatenate, (hs, idl, docs, ats))
            covered = covered_by_levels(h, ids)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            for p, a, b in zip(table["part"].to_pylist(), cuts, cuts[1:], strict=False):
                c = np.flatnonzero(covered[a:b]) + a
                if len(c):
                    out_part.append(p)
                    out_blob.append(pack_ranges(doc[c], at[c], at[c] + length))
        n = len(out_part)
        return _rows(["part", "bucket", "kind", "blob"], [out_part, [0] * n, [DIRECT] * n, out_blob])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, with_text: bool) -> Callable:
    def run(table: pa.Table, ranges: pa.Table) -> pa.Table:
        part = Part(table, length)
        n = len(part.ids)
        doc, start, end = _unite(ranges["blob"].to_pylist())
        step = np.zeros(len(part.data) + 1, np.int32)
        np.add.at(step, part.offsets[doc] + start, 1)
        np.add.at(step, part.offsets[doc] + end, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.zeros(len(part.data) + 1, bool)
        edge[part.offsets] = True
        first = gone.copy()
        first[1:] &= ~gone[:-1] | edge[1 : len(gone)]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[part.offsets])
        removed, spans = total(gone), total(first)
        kept = part.data[~gone].tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.diff(part.offsets) - removed)))
        bodies = [kept[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        null_bodies = [(t or "").encode() for t in part.null["text"].to_pylist()]
        bodies += null_bodies
        pad = lambda x, y: pa.array(np.concatenate((x, np.asarray(y, np.int64))).astype(np.int64), pa.int64())
        zeros = np.zeros(len(null_bodies), np.int64)
        out = {
            "doc_id": pa.concat_arrays([pa.array(part.ids, pa.int64()), pa.nulls(len(zeros), pa.int64())]), "n_bytes": pad(np.diff(part.offsets)[:n], [len(x) for x in null_bodies]),
            "n_removed": pad(removed, zeros), "n_spans": pad(spans, zeros), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
        }
        if with_text:
            out["kept_bytes"] = pa.array(bodies, pa.binary())
        return pa.table(out)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (``kept_bytes``).

    A null text counts as empty. A row with a null id is neither searched nor cut. Rows
    that repeat an id are compared with smaller ids only, not with each other. An empty
    table gives an empty result; other columns aren't read.
    """
    if not GRAM + 2 <= length <= 255:
        raise ValueError(f"length must be from {GRAM + 2} to 255")
    n = 4 * common.n_partitions(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("part", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(n)).cast("int"))
    # the same exchange of the texts serves all four steps
    parts = src.select("part", "doc_id", "text")
    grams = parts.groupBy("part").applyInArrow(_grams(n, length), ROWS)
    bits = grams.groupBy("bucket").applyInArrow(_gram_bucket, BACK)
    suffixes = parts.groupBy("part").cogroup(bits.groupBy("part")).applyInArrow(_suffixes(n, length), ROWS)
    ranges = suffixes.groupBy("bucket").applyInArrow(_suffix_buckets(length), BACK)
    windows = parts.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_windows(n, length), ROWS)
    covered = windows.groupBy("bucket").applyInArrow(_window_bucket(length), BACK)
    return parts.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(_cut(length, with_text), RESULT + (", kept_bytes binary" if with_text else ""))
