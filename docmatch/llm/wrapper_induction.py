"""Main text of web pages by wrapper induction.

A page is read into a tree of its containers with the text blocks in them. Pages of one
host whose trees have the same paths are of one layout; the trees are aligned with the
layout's reference (its most frequent tree, or for rare layouts the reference that fits
best) by simple tree matching. Reference nodes whose text stays the same over the pages
are template. Nodes that get their texts from a pool (most pages share theirs with
another page: rotating menus, adverts and footers) are template too, unless they are in
an article or main element, where copied pages look the same. All others are slots. A
page's main text is that of the slots in its article (or main) element, or where there is
none of all slots; elements that their name or class marks as menu, header, footer,
sidebar, notice, advert, form or comments are left out either way. Where template leaves
nothing of a page (a host of one page copied over), names alone decide.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as html_lib
import re
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A node is template if so many of the host's pages have it, nearly all alike.
MIN_PAGES = 5
MIN_SAME = 0.9
#: The share of pages that have their text of a node in common with another page.
MIN_SHARED = 0.8
CONSTANT, POOL = 2, 1
#: Wrappers up to this size together are broadcast; beyond it they are joined.
BROADCAST_BYTES = 32 << 20

CONTAINERS = frozenset("body div section article main nav header footer aside form ul ol dl table figure details dialog menu fieldset blockquote center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre address figcaption hr html summary hgroup option legend".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title canvas audio video xmp".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies reply share sharing social newsletter subscribe signup login popup modal overlay paywall related widget skip".split()
)
#: A tag from its "<" on; a quote counts after "=" alone. What it doesn't match runs to
#: the page's end. No part of it gives back what it took, so time is linear.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)|</{t}\Z", re.I) for t in RAW}
#: Weights that an alignment keeps; others are made again when they are asked for.
KEPT_WEIGHTS = 1 << 24
#: Pairs of children beyond which two nodes are weighed on their own, not with others.
OWN_PAIRS = 1 << 16


def _next_tag(html: str, at: int) -> tuple[int, re.Match | None, int]:
    """Where the text from ``at`` ends, the tag after it (None: a comment or the page's
    end), and where to go on."""
    look = at
    while (i := html.find("<", look)) >= 0:
        nxt = html[i + 1 : i + 2]
        if nxt == "!" or nxt == "?" or (nxt == "/" and not html[i + 2 : i + 3].isalpha()):
            mark = "-->" if html.startswith("<!--", i) else ">"
            end = html.find(mark, i + 2)
            return i, None, end + len(mark) if end >= 0 else len(html)
        if nxt == "/" or (nxt.isascii() and nxt.isalpha()):
            m = TAG.match(html, i)
            if m:
                return i, m, m.end()
            if nxt != "/" or html[i + 2 : i + 3].isascii():
                return i, None, len(html)
        look = i + 1
    return len(html), None, len(html)


class Page:
    """labels, parents: the container tree in document order (node 0 is the root);
    dropped: whether a node is boilerplate by name; blocks: (node, raw text)."""

    __slots__ = ("blocks", "dropped", "labels", "parents")

    def __init__(self, html: str):
        self.labels, self.parents, self.dropped = ["html"], [-1], [False]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        buffer: list[str] = []
        at, n, head = 0, len(html), False
        while at < n:
            stop, m, after = _next_tag(html, at)
            if stop > at and not head:
                buffer.append(html[at:stop])
            at = after
            if m is None:
                continue
            tag = m.group(2).lower()
            closing = m.group(1)
            if tag in RAW:
                if not closing and not m.group(3).endswith("/"):
                    end = RAW_END[tag].search(html, at)
                    at = end.end() if end else n
                continue
            if tag == "head":
                head = not closing
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag not in BLOCKS:
                continue
            if tag == "body":
                head = False
            if buffer:
                text = "".join(buffer)
                self.blocks.append((stack[-1][1], text))
                buffer = []
            if stack[-1][0] == "p" and not closing:
                stack.pop()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            names = NAMES.findall(m.group(3)) if m.group(3) else ()
            cls = " ".join(" ".join(x.strip("\"'").split()) for x in names).lower()
            marked = bool(cls) and tag not in ("article", "main", "body", "html") and not MARKED.isdisjoint(WORDS.findall(cls))
            if tag in CONTAINERS or (marked and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")):
                if m.group(3).endswith("/"):
                    continue
                kind = tag if tag in CONTAINERS else "p"
                node = len(self.labels)
                self.labels.append(f"{tag}.{cls}" if cls else tag)
                self.parents.append(stack[-1][1])
                self.dropped.append(self.dropped[stack[-1][1]] or marked or tag in DROPPED)
                stack.append((kind, node))
        if buffer:
            text = "".join(buffer)
            self.blocks.append((stack[-1][1], text))

    def structure(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels, strict=True))

    def digests(self) -> list[int]:
        """Per node the digest of its own text."""
        out = [0] * len(self.labels)
        for node, text in self.blocks:
            if text := text.strip():
                out[node] = zlib.crc32(text.encode(errors="replace"), out[node])
        return out

    def text(self, template: list[int] | None = None) -> str:
        """The main text; template: 0 or what the wrapper calls each node."""
        n = len(self.labels)
        inside = [False] * n
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[p] or self.labels[i].split(".", 1)[0] in ("article", "main")
        landmark = any(inside[i] and not self.dropped[i] for i in range(n))
        out = []
        for node, raw in self.blocks:
            if self.dropped[node] or (landmark and not inside[node]) or (template and template[node] > inside[node]):
                continue
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(text)
        return "\n".join(out) if out or not template else self.text()


@functools.lru_cache(4096)
def layout_of(structure: str) -> int:
    """Digest of the set of a tree's paths: repeats of siblings and numbers in names
    make no difference."""
    paths: list[bytes] = []
    for line in structure.split("\n"):
        parent, label = line.split(" ", 1)
        above = paths[int(parent)] if int(parent) >= 0 else b""
        paths.append(hashlib.blake2b(above + DIGITS.sub("0", label).encode(errors="replace"), digest_size=8).digest())
    return int.from_bytes(hashlib.blake2b(b"".join(sorted(set(paths))), digest_size=8).digest(), "little", signed=True)


def _children(structure: str) -> tuple[list[str], list[list[int]]]:
    labels, kids = [], []
    for i, line in enumerate(structure.split("\n")):
        parent, label = line.split(" ", 1)
        labels.append(label)
        kids.append([])
        if int(parent) >= 0:
            kids[int(parent)].append(i)
    return labels, kids


def _classes(labels: list[str], kids: list[list[int]], known: dict) -> list[int]:
    """A number for each node, the same for equal subtrees."""
    out = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):  # parents come before their children
        out[i] = known.setdefault((labels[i], tuple(out[k] for k in kids[i])), len(known))
    return out


def _numbered(labels: list[str], kids: list[list[int]], known: dict) -> list[int]:
    """A number for each node, the same for equal labels from the root down."""
    out = [known.setdefault((-1, labels[0]), len(known))] * len(labels)
    for i, ks in enumerate(kids):
        for k in ks:
            out[k] = known.setdefault((out[i], labels[k]), len(known))
    return out


class _Peers:
    """The distinct subtrees of one tree at one path, those of fewest children first.
    Their children stand in a row, each subtree's after a free place; at: their places by
    path, and their columns among their own peers."""

    def __init__(self, nodes: list[int], kids: list[list[int]], path: list[int], column: list[int]):
        self.nodes = nodes
        self.sizes = [len(kids[y]) for y in nodes]
        self.starts = np.cumsum([0] + [n + 1 for n in self.sizes])
        self.segment = np.repeat(np.arange(len(nodes)), np.diff(self.starts))
        at: dict[int, tuple[list[int], list[int]]] = {}
        for start, y in zip(self.starts.tolist(), nodes, strict=False):
            for i, k in enumerate(kids[y], start + 1):
                places, columns = at.setdefault(path[k], ([], []))
                places.append(i)
                columns.append(column[k])
        self.at = {p: (np.array(x), np.array(c)) for p, (x, c) in at.items()}


class _Match:
    """Weights of largest matches of the subtrees of a with those of b at the same path.
    A subtree of a is weighed with all its peers in b at once, a vector operation for
    each of its children."""

    def __init__(self, a: str, b: str):
        self.la, self.ka = _children(a)
        self.lb, self.kb = _children(b)
        known: dict = {}
        self.ca, self.cb = _classes(self.la, self.ka, known), _classes(self.lb, self.kb, known)
        self.size = [0] * len(known)
        for (_, ks), c in known.items():  # classes of children come first
            self.size[c] = 1 + sum(self.size[k] for k in ks)
        paths: dict = {}
        self.pb = _numbered(self.lb, self.kb, paths)
        first: dict[tuple[int, int], int] = {}
        like = [first.setdefault(x, i) for i, x in enumerate(zip(self.pb, self.cb, strict=True))]
        self.nodes: dict[int, list[int]] = {}
        for y in first.values():
            self.nodes.setdefault(self.pb[y], []).append(y)
        place = [0] * len(self.lb)
        for x in self.nodes.values():
            x.sort(key=lambda y: len(self.kb[y]))
            for i, y in enumerate(x):
                place[y] = i
        self.column = [place[y] for y in like]
        self.peers: dict[int, _Peers] = {}
        self.pa = _numbered(self.la, self.ka, paths)
        first = {}
        self.like = [first.setdefault(x, i) for i, x in enumerate(zip(self.pa, self.ca, strict=True))]
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.n_kept = 0

    def middle(self, x: int, y: int) -> tuple[int, int, int]:
        """How many children at the front are equal, and where those end that aren't
        equal at the back. Equal subtrees at either end are in a largest match."""
        xs, ys = self.ka[x], self.kb[y]
        n, front = min(len(xs), len(ys)), 0
        while front < n and self.ca[xs[front]] == self.cb[ys[front]]:
            front += 1
        back = 0
        while back < n - front and self.ca[xs[-1 - back]] == self.cb[ys[-1 - back]]:
            back += 1
        return front, len(xs) - back, len(ys) - back

    def columns(self, ys: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per path the places of nodes of b, from 1 on, and their columns."""
        at: dict[int, tuple[list[int], list[int]]] = {}
        for i, k in enumerate(ys, 1):
            places, columns = at.setdefault(self.pb[k], ([], []))
            places.append(i)
            columns.append(self.column[k])
        return {p: (np.array(x), np.array(c)) for p, (x, c) in at.items()}

    def weigh(self, x: int):
        """A step for each weight it asks for; returns those of x with its peers."""
        p, xs = self.pa[x], self.ka[x]
        if p not in self.peers:
            self.peers[p] = _Peers(self.nodes[p], self.kb, self.pb, self.column)
        peers = self.peers[p]
        n = len(peers.nodes)
        out = np.ones(n, np.int32)
        if not xs or not peers.at:
            return out
        together = bisect.bisect_right(peers.sizes, OWN_PAIRS // len(xs)) if n > 4 else 0
        far = self.size[self.ca[x]] + 1
        stop = int(peers.starts[together])
        sums = peers.segment[:stop] * far
        own = []
        for i in range(together, n):
            y = peers.nodes[i]
            front, end, last = self.middle(x, y)
            out[i] += sum(self.size[self.ca[k]] for k in (*xs[:front], *xs[end:]))
            if front < end and front < last:
                own.append((i, front, end, self.columns(self.kb[y][front:last]), np.zeros(last - front + 1, np.int32)))
        for i, k in enumerate(xs):
            p, row = self.pa[k], None
            todo = [(at[p], best) for _, front, end, at, best in own if front <= i < end and p in at]
            if together and p in peers.at:
                places, columns = peers.at[p]
                m = int(np.searchsorted(places, stop))
                if m:
                    todo.append(((places[:m], columns[:m]), sums))
            for (places, columns), best in todo:
                if row is None:
                    row = yield self.like[k]
                best[places] = np.maximum(best[places], best[places - 1] + row[columns])
                np.maximum.accumulate(best, out=best)
        if together:
            out[:together] += (sums[peers.starts[1 : together + 1] - 1] - np.arange(together) * far).astype(np.int32)
        for i, _, _, _, best in own:
            out[i] += best[-1]
        return out

    def weights(self, x: int) -> np.ndarray:
        """Of the subtree x of a with each of its peers."""
        x, row = self.like[x], None
        stack = [] if x in self.kept else [(x, self.weigh(x))]
        while stack:
            try:
                k = stack[-1][1].send(row)
            except StopIteration as done:
                row = done.value
                self.keep(stack.pop()[0], row)
                continue
            row = self.kept.get(k)
            if row is None:
                stack.append((k, self.weigh(k)))
            else:
                self.kept.move_to_end(k)
        return self.kept[x] if row is None else row

    def keep(self, x: int, row: np.ndarray) -> None:
        self.kept[x] = row
        self.n_kept += len(row) + 32  # an array of its own
        while self.n_kept > KEPT_WEIGHTS and len(self.kept) > 1:
            self.n_kept -= len(self.kept.popitem(last=False)[1]) + 32

    def pairs(self, x: int, y: int) -> list[tuple[int, int]]:
        """The children of x and y that a largest match has together. Sums of every
        so many children are kept, those between them are made again."""
        front, end, last = self.middle(x, y)
        xs, ys = self.ka[x], self.kb[y]
        out = [*zip(xs[:front], ys[:front], strict=True), *zip(xs[end:], ys[last:], strict=True)]
        xs, ys = xs[front:end], ys[front:last]
        if not xs or not ys:
            return out
        if len(xs) == len(ys) == 1:
            return out + [(k, q) for k, q in zip(xs, ys, strict=True) if self.pa[k] == self.pb[q]]
        at = self.columns(ys)

        def after(best: np.ndarray, k: int) -> np.ndarray:
            if self.pa[k] not in at:
                return best
            places, columns = at[self.pa[k]]
            made = best.copy()
            made[places] = np.maximum(best[places], best[places - 1] + self.weights(k)[columns])
            return np.maximum.accumulate(made, out=made)

        step = max(16, int(len(xs) ** 0.5))
        best, saved = np.zeros(len(ys) + 1, np.int32), []
        for i, k in enumerate(xs):
            if i % step == 0:
                saved.append(best)
            best = after(best, k)
        j = len(ys)
        for n in range(len(saved) - 1, -1, -1):
            part = xs[n * step : (n + 1) * step]
            rows = [saved.pop()[: j + 1]]
            at = self.columns(ys[:j])
            for k in part:
                rows.append(after(rows[-1], k))
            i = len(part)
            while i and j:
                k, q = part[i - 1], ys[j - 1]
                w = int(self.weights(k)[self.column[q]]) if self.pa[k] == self.pb[q] else 0
                if w and rows[i][j] == rows[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((k, q))
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


def align(a: str, b: str) -> list[int]:
    """Simple tree matching: for each node of structure a, the node of b that it is
    matched with in a largest top-down, order-preserving match, or -1. Equal subtrees at
    a path are weighed once. It is a largest match whatever the trees' sizes; its time
    goes with the product of the numbers of their subtrees that differ."""
    if a == b:
        return list(range(a.count("\n") + 1))
    m = _Match(a, b)
    out = [-1] * len(m.la)
    todo = [(0, 0)] if m.la[0] == m.lb[0] else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += zip(m.ka[x], m.kb[y], strict=True) if m.ca[x] == m.cb[y] else m.pairs(x, y)
    return out


class Aligner:
    """align() with its results remembered; pages of one template repeat a structure."""

    def __init__(self, keep: int = 4096):
        self.known: dict[tuple[str, str], list[int]] = {}
        self.keep = keep

    def __call__(self, a: str, b: str) -> list[int]:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            found = self.known[a, b] = align(a, b)
        return found


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        structure, digest = [], []
        for h in b.column(1):
            p = Page(h.as_py() or "")
            structure.append(p.structure())
            digest.append(p.digests())
        layout = pa.array([layout_of(x) for x in structure], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), layout, pa.array(structure, pa.string()), pa.array(digest, pa.list_(pa.int64()))], names=["host", "layout", "structure", "digest"])


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        layout = pa.array([layout_of(Page(h.as_py() or "").structure()) for h in b.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, layout], names=["page_id", "url", "html", "host", "layout"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host the reference of each layout. A layout of enough pages has its own; so has
    one that shares less than half of its nodes with every reference of larger layouts."""
    aligner = Aligner()
    for b in batches:
        for host, layouts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            refs, chosen = [], []
            for x in sorted(layouts, key=lambda x: (-x["pages"], x["structure"])):
                fit, best = -1, -1
                if x["pages"] < MIN_PAGES:
                    for k, r in enumerate(refs):
                        shared = sum(y >= 0 for y in aligner(x["structure"], r))
                        if shared > fit and 2 * shared >= 1 + max(x["structure"].count("\n"), r.count("\n")):
                            fit, best = shared, k
                if best < 0:
                    best = len(refs)
                    refs.append(x["structure"])
                chosen.append((x["layout"], best))
            yield pa.RecordBatch.from_arrays(
                [pa.array([host] * len(chosen), pa.string()), pa.array([c[0] for c in chosen], pa.int64()), pa.array([c[1] for c in chosen], pa.int64()), pa.array([refs[c[1]] for c in chosen], pa.string())],
                names=["host", "layout", "number", "ref"],
            )


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, reference, reference node and digest of the text in it the pages that
    have it, summed over a batch."""
    aligner = Aligner()
    for b in batches:
        seen: dict[tuple[str, int, int, int], int] = {}
        for host, number, structure, digest, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for x, y in enumerate(aligner(structure, ref)):
                if y >= 0 and digest[x]:
                    k = host, number, y, digest[x]
                    seen[k] = seen.get(k, 0) + 1
        columns = [pa.array([k[i] for k in seen], pa.int64() if i else pa.string()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["host", "number", "node", "digest", "pages"])


def wrappers(pages: DataFrame) -> DataFrame:
    """pages: host, html. Per host and layout: ``host, layout, ref`` (the structure of
    its reference) and ``constant`` (its template nodes, each four times its number plus
    ``CONSTANT`` or ``POOL``)."""
    skeletons = common.table(pages.select("host", "html").mapInArrow(_skeletons, "host string, layout long, structure string, digest array<long>"), "skeletons")
    trees = skeletons.groupBy("host", "layout", "structure").agg(F.count(F.lit(1)).alias("n"))
    layouts = trees.groupBy("host", "layout").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "structure"))["structure"].alias("structure"))
    hosts = layouts.groupBy("host").agg(F.collect_list(F.struct("pages", "layout", "structure")).alias("layouts"))  # trees of one host that differ in their paths
    refs = common.table(hosts.mapInArrow(_references, "host string, layout long, number long, ref string"), "references")
    found = skeletons.join(refs, ["host", "layout"]).select("host", "number", "structure", "digest", "ref")
    seen = found.mapInArrow(_observations, "host string, number long, node long, digest long, pages long")
    texts = seen.groupBy("host", "number", "node", "digest").agg(F.sum("pages").alias("n"))
    nodes = texts.groupBy("host", "number", "node").agg(F.sum("n").alias("pages"), F.max("n").alias("same"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))
    kind = F.when(F.col("same") >= MIN_SAME * F.col("pages"), CONSTANT).when(F.col("shared") >= MIN_SHARED * F.col("pages"), POOL).otherwise(0)
    nodes = nodes.withColumn("kind", kind).where((F.col("pages") >= MIN_PAGES) & (F.col("kind") > 0))
    constant = nodes.groupBy("host", "number").agg(F.sort_array(F.collect_list(F.col("node") * 4 + F.col("kind"))).alias("constant"))  # nodes of one page
    return common.table(refs.join(constant, ["host", "number"], "left").select("host", "layout", "ref", F.coalesce("constant", F.array().cast("array<long>")).alias("constant")), "wrappers")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner()
    for b in batches:
        texts, sizes = [], []
        for h, ref, constant in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            p = Page(h.as_py() or "")
            template = None
            if constant:
                fixed = {c >> 2: c & 3 for c in constant}
                template = [fixed.get(y, 0) for y in aligner(p.structure(), ref)]
            text = p.text(template)
            texts.append(text)
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page has an empty text. Pages without a host (null or relative url)
    count as one host. A host with fewer than ``MIN_PAGES`` pages has no template
    nodes. Of a page with an article or main element only what is in it is taken, but for
    template nodes and marked elements.
    Repeated rows give repeated results; other columns aren't read.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of("url"))
    w = wrappers(src)
    size = w.agg(F.sum(F.octet_length("ref") + F.octet_length("host") + 8 * F.size("constant"))).first()[0] or 0
    placed = src.mapInArrow(_with_layout, "page_id long, url string, html string, host string, layout long")
    j = placed.join(F.broadcast(w) if size <= BROADCAST_BYTES else w, ["host", "layout"], "left").select("page_id", "url", "html", "ref", "constant")
    return j.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
