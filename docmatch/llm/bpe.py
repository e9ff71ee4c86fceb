"""Byte-level BPE: merges of many words at once, longest-match backtracking for the rest.

A text is cut before each single space or newline. The pieces of a block of texts, and
the pattern's matches (words) in them, are looked at once each. Words of one length are
merged together in numpy: a round does the merge of lowest rank in each of them. Longer
words, and lengths of few words, are encoded from left to right with the longest token
that fits, found by an Aho-Corasick automaton over Latin-1 (one symbol per byte); a token
may follow another only if encoding the two together gives just these two (memoised), and
where no token may follow, the search backs up to the next shorter one. The result is
that of the merges, with a number of steps linear in the word.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_shards import _binary, _content

#: Bytes of text whose pieces are looked at together; it ends where a text may be cut.
BLOCK = 4 << 20
#: Words of up to so many bytes are merged together, if at least FEW have the same length.
SHORT = 64
FEW = 50
#: Words merged at a time, so that a round's arrays stay in the processor's cache.
ROWS = 1 << 14
#: Stands for a pair that is no token; a rank, times SHORT and with a place, takes 32 bits.
NONE = 1 << 24
PLACE = np.arange(SHORT, dtype=np.int32)[:, None]
#: The only pattern whose matches are known to begin at every cut.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGN, LETTER, NUMBER, WHITE, SPACE, ODD = range(6)
EMPTY = hashlib.sha256().hexdigest()


def _kinds() -> np.ndarray:
    """The kind of each code point, as the pattern has it. An apostrophe can begin a contraction."""
    import regex

    kinds = np.full(0x110000, SIGN, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(r"(\p{L}+)|(\p{N}+)|\s+", "".join(map(chr, range(lo, hi)))):
            kinds[lo + m.start() : lo + m.end()] = m.lastindex or WHITE
    kinds[ord(" ")], kinds[ord("'")] = SPACE, ODD
    return kinds


def _points(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at these bytes of valid UTF-8."""
    found = body[at].astype(np.int32)
    for least, kept, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero(body[at] >= least)
        x = body[at[k]].astype(np.int32) & kept
        for i in range(1, more + 1):
            x = x << 6 | body[at[k] + i] & 0x3F
        found[k] = x
    return found


class BytePairs:
    """A rank file as encoder and decoder. ``pattern`` splits text before the merges."""

    def __init__(self, rank_file: str, pattern: str):
        import ahocorasick
        import regex

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in ranks.items()}
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, (len(t) - 1, r))
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        # longest proper prefix token, and the pair of tokens that the merges make a token of
        self.length = {r: len(t) for r, t in self.token.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.compatible: dict[int, bool] = {}  # left << 32 | right
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.shorter[r] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1)
            parts = self._merge(t, r)
            if len(parts) == 2:
                self.split[r] = (parts[0], parts[1])
                self.pairs[parts[0], parts[1]] = r
            else:
                self.split[r] = (r, r)
        self.kinds, self.cuttable = _kinds(), pattern == CUTTABLE
        self.ranks = np.array(sorted(self.token), np.int32)
        self.texts = pa.array([self.token[r] for r in self.ranks.tolist()], pa.large_binary())
        rows = range(int(self.ranks[-1]) + 1)
        self.names = pa.array([f",{r}".encode() for r in rows], pa.large_binary())
        self.by_rank = pa.array([self.token.get(r, b"") for r in rows], pa.large_binary())
        self.byte = np.array([self.rank.get(chr(c), -1) for c in range(256)], np.int32)
        self._number_pairs()

    def _number_pairs(self) -> None:
        """A hash table of all pairs of tokens that together are a token, with its rank."""
        rank = self.rank
        found = [(a, b, r) for t, r in rank.items() for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None]
        a, b, r = np.array(found, np.int64).reshape(-1, 3).T
        if int(self.ranks[-1]) >= NONE:
            raise ValueError("ranks of 2^24 and more")
        bits = max(16, 3 + len(r).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, NONE, np.int32)
        key = a << 32 | b
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = key[free]
            left = left[self.slots[slot[left]] != key[left]]
            slot[left] = slot[left] + 1 & len(self.slots) - 1
        self.made[slot] = r
        self.bytes_made = np.full((256, 256), NONE, np.int32)
        one = {r: c for c, r in enumerate(self.byte.tolist()) if r >= 0}
        for x, y, z in found:
            if x in one and y in one:
                self.bytes_made[one[x], one[y]] = z

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that these pairs make, or NONE."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        there = self.slots[slot]
        while len(k := np.flatnonzero((there != key) & (there >= 0))):
            slot[k] = slot[k] + 1 & len(self.slots) - 1
            there[k] = self.slots[slot[k]]
        return self.made[slot]

    def _merge(self, t: str, below: int) -> list[int]:
        """The merges themselves, with those of lower rank than ``below`` only."""
        parts = [self.rank.get(c, -1) for c in t]
        texts = list(t)
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(texts[i] + texts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            texts[at : at + 2] = [texts[at] + texts[at + 1]]
            parts[at : at + 2] = [best]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart side by side."""
        limit = 1 << 62
        while True:
            r = self.pairs.get((a, b))
            if r is not None and r < limit:
                return False
            if a > b:
                limit, last = a, a
                a = self.split[a][1]
                if a == last:
                    limit, last = b + 1, b
                    b = self.split[b][0]
                    if b == last:
                        return True
            else:
                limit, last = b + 1, b
                b = self.split[b][0]
                if b == last:
                    limit, last = a, a
                    a = self.split[a][1]
                    if a == last:
                        return True

    def encode_bytes(self, t: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.rank.get(t)
        if whole is not None:
            return [whole]
        n = len(t)
        longest = [-1] * n
        for end, (less, r) in self.automaton.iter(t):
            longest[end - less] = r  # ends ascend, so the last one is the longest
        length, shorter, compatible = self.length, self.shorter, self.compatible
        dead: set[int] = set()
        out: list[int] = []
        at, left, nxt = 0, -1, longest[0]
        while nxt >= 0:
            end = at + length[nxt]
            if left < 0:
                fits = True
            else:
                fits = compatible.get(left << 32 | nxt)
                if fits is None:
                    fits = compatible[left << 32 | nxt] = self.fits(left, nxt)
            if fits and end not in dead:
                out.append(nxt)
                if end == n:
                    return out
                at, left, nxt = end, nxt, longest[end]
                continue
            nxt = shorter[nxt]
            if nxt < 0 and out:  # nothing fits here: try less before it
                dead.add(at)
                nxt = out.pop()
                at -= length[nxt]
                left = out[-1] if out else -1
        raise ValueError("bytes without a token")

    def _merged(self, parts: np.ndarray, made: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Columns are words, all of as many parts: the merges, and which words they end in.
        ``made`` has what each part and the next make. Every round merges one pair of each word."""
        which = np.arange(parts.shape[1])
        while len(which):
            n = len(parts)
            least = (made * SHORT + PLACE[: n - 1]).min(axis=0, initial=NONE * SHORT)
            live = least < NONE * SHORT
            if not live.all():
                yield which[~live], parts[:, ~live]
                which, parts, made, least = which[live], parts[:, live], made[:, live], least[live]
            if not len(which):
                return
            at, r, row = least % SHORT, least // SHORT, np.arange(len(which))
            parts = np.where(PLACE[: n - 1] > at, parts[1:], parts[:-1])
            parts[at, row] = r
            made = np.where(PLACE[: n - 2] >= at, made[1:], made[:-1])
            k = np.flatnonzero(at > 0)
            made[at[k] - 1, k] = self._pair(parts[at[k] - 1, k], r[k])
            k = np.flatnonzero(at < n - 2)
            made[at[k], k] = self._pair(r[k], parts[at[k] + 1, k])

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        offset, body = _content(words)
        size, count = np.diff(offset), np.ones(len(words), np.int64)
        whole = pc.index_in(words, value_set=self.texts).fill_null(-1).to_numpy()
        done = [(np.flatnonzero(whole >= 0), self.ranks[whole[whole >= 0]][None, :])]
        many = np.bincount(np.minimum(size[whole < 0], SHORT + 1), minlength=SHORT + 2) >= FEW
        many[SHORT + 1] = False
        together = (whole < 0) & many[np.minimum(size, SHORT + 1)]
        if (self.byte < 0).any():
            together[np.searchsorted(offset, np.flatnonzero(self.byte[body] < 0), "right") - 1] = False
        for n in np.unique(size[together]).tolist():
            of_size = np.flatnonzero(together & (size == n))
            for k in range(0, len(of_size), ROWS):
                w = of_size[k : k + ROWS]
                letters = body[offset[w] + np.arange(n)[:, None]]
                done += [(w[i], ids) for i, ids in self._merged(self.byte[letters], self.bytes_made[letters[:-1], letters[1:]])]
        for i in np.flatnonzero((whole < 0) & ~together).tolist():
            done.append((np.array([i]), np.array(self.encode_bytes(words[i].as_py().decode("latin-1")), np.int32)[:, None]))
        for w, ids in done:
            count[w] = len(ids)
        begin, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int32)
        for w, ids in done:
            out[begin[w] + np.arange(len(ids))[:, None]] = ids
        return out, count

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all pieces in a row, and where each piece's begin and the last ends."""
        offset, body = _content(pieces)
        at = np.flatnonzero(body & 0xC0 != 0x80)
        kind = self.kinds[_points(body, at)]
        first = np.zeros(len(body) + 1, bool)
        first[offset] = True
        begins = first[at]
        odd = np.zeros(len(pieces), bool) if self.cuttable else np.ones(len(pieces), bool)
        if self.cuttable:  # white space stands only first, as it does after a cut
            out_of_place = (kind == ODD) | ((kind == SPACE) | (kind == WHITE)) & ~begins
            odd[np.searchsorted(offset, at[out_of_place], "right") - 1] = True
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        start = at[begins]
        if not odd.any():
            return _binary(body, np.append(start, len(body))), np.searchsorted(start, offset)
        size = np.diff(np.append(start, len(body)))
        of = np.searchsorted(offset, start, "right") - 1
        found = [[x.encode() for x in self.pattern.findall(p.decode())] for p in pieces.filter(pa.array(odd)).to_pylist()]
        many = np.bincount(of[~odd[of]], minlength=len(pieces))
        many[odd] = [len(x) for x in found]
        upto = np.append(0, np.cumsum(many))
        lengths = np.empty(int(upto[-1]), np.int64)
        plain = np.repeat(~odd, many)
        lengths[plain] = size[~odd[of]]
        lengths[~plain] = [len(w) for x in found for w in x]
        return _binary(body, np.append(0, np.cumsum(lengths))), upto

    def _cuts(self, body: np.ndarray, first: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Places from ``lo`` to ``hi`` of a single space or newline between two characters
        of one text that aren't white space: there the pattern starts a new match whatever
        surrounds it. ``first`` marks where texts begin and the last one ends."""
        if not self.cuttable:
            return np.zeros(0, np.int64)
        at = lo + np.flatnonzero((body[lo:hi] == 32) | (body[lo:hi] == 10))
        at = at[~first[at] & ~first[at + 1]]
        before = at - 1
        for _ in range(3):
            before -= body[before] & 0xC0 == 0x80
        white = [(k == SPACE) | (k == WHITE) for k in (self.kinds[_points(body, before)], self.kinds[_points(body, at + 1)])]
        return at[~white[0] & ~white[1]]

    def _blocks(self, body: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The end of each block, and where its pieces begin."""
        lo = 0
        while lo < len(body):
            hi = min(lo + BLOCK, len(body))
            while hi < len(body):
                ahead = min(hi + (1 << 16), len(body))
                found = np.concatenate((hi + np.flatnonzero(first[hi:ahead]), self._cuts(body, first, hi, ahead)))
                hi = int(found.min()) if len(found) else ahead
                if len(found):
                    break
            begin = first[lo:hi].copy()
            begin[0] = True
            begin[self._cuts(body, first, lo, hi) - lo] = True
            yield hi, lo + np.flatnonzero(begin)
            lo = hi

    def portions(self, texts: pa.Array, joined: bool = True) -> Iterator[tuple[int, int, memoryview, memoryview]]:
        """Of each text that isn't empty, in order and in one or more portions: its number,
        how many ids, the ids with a comma before each (or, not ``joined``, as 32-bit
        integers), and the bytes they decode to."""
        texts = texts.cast(pa.large_string()).fill_null("")
        texts.validate(full=True)
        offset, body = _content(texts)
        first = np.zeros(len(body) + 1, bool)
        first[offset] = True
        for end, begin in self._blocks(body, first):
            pieces = _binary(body[begin[0] : end], np.append(begin, end) - begin[0]).dictionary_encode()
            words, upto = self._words(pieces.dictionary)
            words = words.dictionary_encode()
            ids, count = self._ids(words.dictionary)
            ends = np.append(0, np.cumsum(count))
            which = words.indices.to_numpy()
            n = np.append(0, np.cumsum(count[which]))[upto]
            n = np.append(0, np.cumsum(np.diff(n)[pieces.indices.to_numpy()]))
            text = np.arange(np.searchsorted(offset, begin[0], "right") - 1, np.searchsorted(offset, end))
            text = text[offset[text] < offset[text + 1]]
            piece = np.append(np.searchsorted(begin, np.maximum(offset[text], begin[0])), len(begin))
            known = self.names.take(pa.array(ids)) if joined else _binary(ids.view(np.uint8), 4 * np.arange(len(ids) + 1))
            views = []
            for of_id in (known, self.by_rank.take(pa.array(ids))):
                at, content = _content(of_id)
                at, content = _content(_binary(content, at[ends]).take(words.indices))
                at, content = _content(_binary(content, at[upto]).take(pieces.indices))
                views.append((at[piece].tolist(), memoryview(content)))
            n = n[piece].tolist()
            for k, t in enumerate(text.tolist()):
                yield t, n[k + 1] - n[k], *(content[at[k] : at[k + 1]] for at, content in views)

    def encoded(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the bytes they decode to."""
        found = list(self.portions(pa.array([text], pa.string())))
        return sum(n for _, n, _, _ in found), b"".join(x for _, _, x, _ in found)[1:].decode(), b"".join(x for _, _, _, x in found)

    def forget(self) -> None:
        """Drops what was remembered, so that an idle Python worker holds no memory for it."""
        self.compatible = {}
        pa.default_memory_pool().release_unused()
        common.release_memory()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[tuple[str, str], BytePairs] = {}


def load(rank_file: str, pattern: str) -> BytePairs:
    """The encoder of this Python worker, kept."""
    if (rank_file, pattern) not in _loaded:
        _loaded[rank_file, pattern] = BytePairs(rank_file, pattern)
    return _loaded[rank_file, pattern]


def _digest_batches(rank_file: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(rank_file, pattern)
        for b in batches:
            n = [0] * b.num_rows
            ids, back = [[EMPTY] * b.num_rows for _ in range(2)]
            last = -1
            for t, count, joined, decoded in coder.portions(b.column(1)):
                if t != last:
                    last, of_ids, of_text, joined = t, hashlib.sha256(), hashlib.sha256(), joined[1:]
                of_ids.update(joined)
                of_text.update(decoded)
                n[t] += count
                ids[t], back[t] = of_ids.hexdigest(), of_text.hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return run


def _encode_batches(rank_file: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(rank_file, pattern)
        for b in batches:
            n, found = np.zeros(b.num_rows + 1, np.int32), []
            for t, count, ids, _ in coder.portions(b.column(1), joined=False):
                n[t + 1] += count
                found.append(ids)
            ids = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(found))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum(n, dtype=np.int32)), ids)], names=["doc_id", "ids"])
        coder.forget()

    return run


def _decode_batches(rank_file: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(rank_file, pattern)
        for b in batches:
            texts = [coder.decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every text; null and empty give no ids."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_encode_batches(rank_file, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every list of ids; null gives the empty text."""
    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(_decode_batches(rank_file, pattern), "doc_id long, text string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. A null text counts as
    empty; ids may be null or repeat (each row has its own result); an empty table
    gives an empty result; other columns aren't read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_digest_batches(rank_file, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
