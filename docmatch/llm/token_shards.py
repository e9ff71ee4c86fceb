"""Token-id shards compressed by grammar (Re-Pair).

Documents are put in ascending id order, encoded, and written as one file per range
partition. In each file frequent pairs of neighbouring ids are replaced by nonterminals,
round after round; rules and the expansion length of every nonterminal are stored, so
any stretch of tokens is decoded without the rest. Pairs never cross documents.

File: 8 bytes magic, 4 bytes header length, a JSON header, then the arrays it names.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"DMRPAIR1"
END_ID = 2
#: Bytes of text that are cut into pieces together, and of pieces that the library gets in a call.
CHUNK = 1 << 25
BULK = 1 << 14
#: Runs of earlier portions that are kept, of ``CHUNK`` bytes at most.
MAX_RUNS = 1 << 19
#: A rule costs 12 bytes and each of its uses saves a symbol of two bytes and some bits.
MIN_USES = 4
#: Each round's least count is so many times smaller than the one's before.
FALL = 2
#: Places that are looked at together, so that they stay in a processor's cache.
BLOCK = 1 << 16
#: Ids that a nonterminal stands for, at most, where a whole shard's are laid out.
SHORT = 64


def _byte_symbols() -> np.ndarray:
    """The code points of the printable stand-ins of byte-level vocabularies, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.arange(256, dtype="<u4")
    out[np.setdiff1d(out, shown)] = 256 + np.arange(256 - len(shown))
    return out


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, size of them, of each stretch in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: What separates pieces; other white space stays in a piece, which then goes to the library.
GAPS = b" \t\n\v\f\r"
ODD, LETTER, DIGIT, SIGN = range(4)


def _table(of: Callable[[int], int]) -> bytes:
    return bytes(map(of, range(256)))


IS_GAP = _table(lambda b: b in GAPS)
LOWER = _table(lambda b: b + 32 if 65 <= b <= 90 else b)
#: An apostrophe can begin a contraction.
KIND = _table(lambda b: ODD if not 33 <= b <= 126 or b == 39 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN)


class WordEncoder:
    """A tokenizers file that brings texts to NFC and lower case, splits into contractions,
    runs of letters, single digits and runs of other signs, and drops white space. So a
    text's ids are those of its white-space-separated pieces in a row. Pieces of a portion
    are looked at once each; those of Latin letters (to U+012F), digits and ASCII signs are
    split and lower-cased here, and each run goes to the library's merges once (up to
    ``MAX_RUNS`` runs are kept for later portions). Other pieces go to the library as they
    are, and so do texts with a special token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.forget()
        self.symbols, suffix = _byte_symbols(), self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)  # ids that end a run
        self.closes[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True

    def _whole(self, texts: list[str]) -> Iterator[list[int]]:
        for k in range(0, len(texts), BULK):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + BULK], add_special_tokens=False):
                yield e.ids

    def forget(self) -> None:
        """Runs of earlier portions are no longer kept."""
        self.runs, self.run_ids, self.run_size = _binary(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each run's begin and how many it has."""
        at = pc.index_in(runs, value_set=self.runs)
        fresh = runs.filter(at.is_null())
        offset, body = _content(fresh)
        ids, size = self._merged(body, np.diff(offset)) if len(fresh) else (self.run_ids[:0], self.run_size[:0])
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.runs) + np.arange(len(fresh))
        many = lambda n, size: n > MAX_RUNS or size > CHUNK
        all_ids, all_size = np.concatenate((self.run_ids, ids)), np.concatenate((self.run_size, size))
        start = np.cumsum(all_size) - all_size
        if not many(len(self.runs) + len(fresh), self.runs.nbytes + fresh.nbytes):
            self.runs, self.run_size, self.run_ids = pa.concat_arrays([self.runs, fresh]), all_size, all_ids
        elif many(len(runs), runs.nbytes):
            self.forget()
        else:  # only those of this portion stay
            self.runs, self.run_size, self.run_ids = runs, all_size[at], all_ids[_stretches(start[at], all_size[at])]
        return all_ids, start[at], all_size[at]

    def _merged(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs in a row, and how many each has."""
        line = np.full(len(body) + len(size), 32, "<u4")
        line[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = self.symbols[body]
        end, ids = np.cumsum(size + 1), []
        cuts = [0, *end[np.flatnonzero(np.diff(end // BULK))].tolist(), len(line)]
        for lo, hi in itertools.pairwise(cuts):
            ids.append(np.array(self.merges.encode_batch_fast([line[lo:hi].tobytes().decode("utf-32-le")])[0].ids, np.uint32))
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(size):
            return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in line.tobytes().decode("utf-32-le").split(" ")[:-1]]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's begin and how many it has."""
        offset, body = _content(pieces)
        raw, size = body.tobytes(), np.diff(offset)
        low, kind = np.frombuffer(bytearray(raw.translate(LOWER)), np.uint8), np.frombuffer(bytearray(raw.translate(KIND)), np.uint8)
        lead = np.flatnonzero((body == 0xC3) | (body == 0xC4))  # of U+00C0 to U+013F
        one, two = body[lead] == 0xC3, body[lead + 1]
        letter = np.where(one, (two != 0x97) & (two != 0xB7), two < 0xB0)
        lead, one, two = lead[letter], one[letter], two[letter]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(one, two + 32 * (two < 0x9F), two | 1)
        known = np.ones(len(size), bool)
        known[np.searchsorted(offset, np.flatnonzero(kind == ODD), "right") - 1] = False
        kept = np.repeat(known, size)
        low, kind, begin = low[kept], kind[kept], np.cumsum(size[known]) - size[known]
        new = kind == DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        new[begin] = True
        start = np.flatnonzero(new)
        runs = _binary(low, np.append(start, len(low))).dictionary_encode()
        which = runs.indices.to_numpy()
        ids, at, n = self._runs(runs.dictionary)
        ids = ids[_stretches(at[which], n[which])]
        total = np.append(0, np.cumsum(n[which]))[np.searchsorted(start, np.append(begin, len(low)))]
        odd = list(self._whole([x.decode() for x in pieces.filter(pa.array(~known)).to_pylist()]))
        count = np.zeros(len(size), np.int64)
        count[known], count[~known] = np.diff(total), [len(x) for x in odd]
        at = np.zeros(len(size), np.int64)
        at[known], at[~known] = total[:-1], len(ids) + np.cumsum(count[~known]) - count[~known]
        return np.concatenate((ids, np.array([i for x in odd for i in x], np.uint32))), at, count

    def encode_all(self, texts: pa.Array, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, tail after each, and how many each has. A null
        counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        texts.validate(full=True)
        offset, body = _content(texts)
        special = np.zeros(len(texts), bool)
        body = body.tobytes()
        for s in self.special:
            if s.encode() in body:
                special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        special = np.flatnonzero(special)
        if len(special):
            blank = bytearray(body)
            for k in special:
                blank[offset[k] : offset[k + 1]] = b" " * (offset[k + 1] - offset[k])
            body = bytes(blank)
        gap = np.frombuffer(body.translate(IS_GAP) + b"\1", bool)
        begin = ~gap
        begin[1:] &= gap[:-1]
        begin[offset] = ~gap[offset]
        end = gap.copy()
        end[offset] = True
        end[1:] &= ~gap[:-1]
        end[0] = False
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        pieces = _binary(np.frombuffer(body.translate(None, GAPS), np.uint8), np.append(0, np.cumsum(end - begin))).dictionary_encode()
        n = np.searchsorted(begin, offset)  # pieces before each text
        del body, gap, begin, end
        ids, at, count = self._pieces(pieces.dictionary)
        # after each text stands one more piece: its tail, with a special text's ids before it
        extra = [*([*x, *tail] for x in self._whole([texts[int(k)].as_py() for k in special])), tail]
        more = np.array([len(x) for x in extra], np.int64)
        at, count = np.concatenate((at, len(ids) + np.cumsum(more) - more)), np.concatenate((count, more))
        ids = np.concatenate((ids, np.array([i for x in extra for i in x], np.uint32)))
        last = np.full(len(texts), len(at) - 1)
        last[special] = len(at) - 1 - len(special) + np.arange(len(special))
        which = np.insert(pieces.indices.to_numpy(), n[1:], last)
        size = count[which]
        upto = np.append(0, np.cumsum(size))
        out = np.empty(upto[-1], np.uint32)
        for k in range(0, len(which), BLOCK):
            w = which[k : k + BLOCK]
            out[upto[k] : upto[k + len(w)]] = ids[_stretches(at[w], count[w])]
        return out, np.diff(upto[n + np.arange(len(n))])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def _content(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes, of an array of large strings or bytes without nulls."""
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offset = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    body = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
    return offset - offset[0], body


def _binary(body: np.ndarray, offset: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int64, copy=False)), pa.py_buffer(body)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Pairs:
    """Numbers for pairs of symbols, with exact counts of their places, and lists of where
    they stood when they were numbered. 0 stands for all pairs of fewer than ``MIN_USES``
    places: a pair of given symbols only gets rarer."""

    def __init__(self, n: int):
        self.key, self.count, self.start, self.size = (np.zeros(1, np.int64) for _ in range(4))
        self.listed, self.used = np.empty(n, np.int32 if n < 1 << 31 else np.int64), 0

    def add(self, at: np.ndarray, left: np.ndarray, right: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of new pairs of symbols below top; those of pairs that are numbered, and
        the numbers."""
        wide, long = top.bit_length(), int(at.max(initial=0)).bit_length()
        if narrow := 2 * wide + long <= 64:  # sorting numbers is much faster than finding their order
            parts = (wide + long, long)
        else:
            parts, wide = (32, 0), 32
        both = np.empty(len(at), np.uint64)
        for k in range(0, len(at), BLOCK):
            x, b = slice(k, k + BLOCK), both[k : k + BLOCK]
            np.left_shift(left[x].astype(np.uint64), np.uint64(parts[0]), out=b)
            b |= right[x].astype(np.uint64) << np.uint64(parts[1])
            if narrow:
                b |= at[x].view(np.uint64)
        if narrow:
            both.sort()
            at = (both & np.uint64((1 << long) - 1)).view(np.int64)
            both >>= np.uint64(long)
            key = both.view(np.int64)
        else:
            order = np.argsort(both, kind="stable")
            key, at = both[order].view(np.int64), at[order]
        starts = common.group_starts(key)
        count = np.diff(np.append(starts, len(key)))
        often = count >= MIN_USES
        where = at[np.repeat(often, count)]
        key, count = key[starts[often]], count[often]
        number = np.repeat(np.arange(len(self.key), len(self.key) + len(key), dtype=np.int32), count)
        if self.used + len(where) > len(self.listed):
            self.listed = np.concatenate((self.listed[: self.used], np.empty(max(self.used, len(where)), self.listed.dtype)))
        self.listed[self.used : self.used + len(where)] = where
        self.key = np.concatenate((self.key, (key >> wide) << 32 | key & ((1 << wide) - 1)))
        self.start = np.concatenate((self.start, self.used + np.cumsum(count) - count))
        self.count, self.size = np.concatenate((self.count, count)), np.concatenate((self.size, count))
        self.used += len(where)
        return where, number

    def places(self, numbers: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs still stand, in order, and the rank of each in numbers."""
        size = self.size[numbers]
        both = self.listed[_stretches(self.start[numbers], size)].astype(np.int64) << 31
        both |= np.repeat(np.arange(len(numbers)), size)
        both.sort()
        at = both >> 31
        both &= (1 << 31) - 1
        still = pair[at] == numbers[both]
        return at[still], both[still]

    def less(self, numbers: np.ndarray) -> None:
        """Places that are gone."""
        np.subtract.at(self.count, numbers[numbers > 0].astype(np.int64), 1)


def re_pair(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, and whether each is the last of its document. The remaining symbols, their
    last flags, and the rules of each round; nonterminals count up from base. A round
    takes the pairs down to a part of the highest count together; where two of them
    overlap the more frequent one has the place, and of overlapping places of one pair
    (runs of a symbol) every other one counts. That part falls each round. It ends when no
    pair has ``MIN_USES`` places that don't overlap. Symbols stay where they are and are
    linked, so a round looks only at the places of its pairs."""
    n, rules, top, known = len(ids), [], base, _Pairs(len(ids))
    s = ids.astype(np.int64 if base + n >= 1 << 31 else np.int32)
    pair = np.zeros(n + 1, np.int32)  # of each place and the next one; the spare place is before the first and after the last
    after = np.arange(1, n + 2, dtype=known.listed.dtype)
    before = after - 2
    last = last.copy()
    last[-1:] = True

    inner = ~last[:-1]
    where, which = known.add(np.flatnonzero(inner), s[:-1][inner], s[1:][inner], top)
    pair[where] = which
    least = n
    while (most := int(known.count.max())) >= MIN_USES:
        least = max(MIN_USES, min(least, most) // FALL)
        hot = np.flatnonzero(known.count >= least)
        hot = hot[np.argsort(-known.count[hot], kind="stable")]
        at, r = known.places(hot, pair)
        near = after[at[:-1]] == at[1:]
        again = np.flatnonzero(near & (r[1:] == r[:-1])) + 1
        if len(again):
            starts = np.flatnonzero(np.concatenate(([True], np.diff(again) > 1)))
            counted = np.ones(len(at), bool)
            counted[again[(again - again[starts][common.spread(starts, len(again))]) % 2 == 0]] = False
            at, r, near = at[counted], r[counted], (near & counted[1:])[counted[:-1]]
            near = near[: len(at) - 1]
        known.count[hot[np.bincount(r, minlength=len(hot)) < MIN_USES]] = 0  # their places overlap
        wins = np.ones(len(at), bool)
        wins[1:] &= ~near | (r[1:] < r[:-1])
        wins[:-1] &= ~near | (r[:-1] < r[1:])
        # a pair that lost too many places isn't worth a rule; it may come again
        made = np.bincount(r[wins], minlength=len(hot)) >= MIN_USES
        if not made.any():
            continue  # the first pair loses no place, so its count was set to 0
        wins &= made[r]
        at, which = at[wins], (np.cumsum(made) - 1)[r[wins]]
        key = known.key[hot[made]]
        rules.append(np.stack([key >> 32, key & 0xFFFFFFFF], 1))
        gone, prior = after[at], before[at]
        known.count[hot[made]] -= np.bincount(which, minlength=len(key))
        pair[at] = 0
        touched = np.concatenate((gone, prior[np.append(True, prior[1:] != gone[:-1])]))
        known.less(pair[touched])
        pair[touched] = 0
        s[at] = top + which
        s[gone] = -1
        last[at] = last[gone]
        after[at] = after[gone]
        before[after[at]] = at
        prior = before[at]
        prior = prior[np.append(True, prior[1:] != at[:-1])]
        top += len(key)
        at = np.concatenate((at, prior[prior >= 0]))
        at = at[~last[at]]
        where, which = known.add(at, s[at], s[after[at]], top)
        pair[where] = which
    kept = s >= 0
    return s[kept], last[kept], rules


def expand(symbols: np.ndarray, rules: list[np.ndarray], base: int, length: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for. Expansion lengths give each symbol its place in
    the result, so only what is still a nonterminal is looked at again. Of many symbols
    those that stand for few ids are laid out once and copied."""
    s = symbols.astype(np.int64)
    if not rules:
        return s.astype(np.uint32)
    known = _lengths(rules, base) if length is None else length
    pairs = np.concatenate(rules).astype(np.int64)
    size = np.where(s >= base, known[np.maximum(s - base, 0)], 1)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    if len(s) > base + len(pairs):
        short = np.flatnonzero(known <= SHORT)
        start, begin = np.arange(base + len(pairs)), np.cumsum(known[short]) - known[short]
        start[base + short] = base + begin
        laid = np.arange(base + int(known[short].sum()), dtype=np.uint32)
        _put(short + base, begin, pairs, known, base, laid[base:])
        long = size > SHORT
        few = np.flatnonzero(~long)
        for k in range(0, len(few), BLOCK):
            x = few[k : k + BLOCK]
            out[_stretches(at[x], size[x])] = laid[_stretches(start[s[x]], size[x])]
        s, at = s[long], at[long]
    return _put(s, at, pairs, known, base, out)


def _put(s: np.ndarray, at: np.ndarray, pairs: np.ndarray, length: np.ndarray, base: int, out: np.ndarray) -> np.ndarray:
    """out, with what symbols stand for at their places."""
    while len(s):
        plain = s < base
        out[at[plain]] = s[plain]
        s, at = s[~plain], at[~plain]
        left, right = pairs[s - base, 0], pairs[s - base, 1]
        s, at = np.concatenate((left, right)), np.concatenate((at, at + np.where(left >= base, length[np.maximum(left - base, 0)], 1)))
    return out


def _lengths(rules: list[np.ndarray], base: int) -> np.ndarray:
    """Expansion length of every nonterminal."""
    out = np.zeros(0, np.int64)
    for r in rules:
        size = np.ones(r.shape, np.int64)
        inner = r >= base
        size[inner] = out[r[inner] - base]
        out = np.concatenate((out, size.sum(1)))
    return out


def pack(doc_ids: pa.Array, tokens: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """A shard file."""
    last = np.zeros(len(tokens), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, last, rules = re_pair(tokens, last, base)
    ends = np.flatnonzero(last) + 1
    high = symbols >> 16
    bits = max(1, int(high.max(initial=0)).bit_length())
    arrays = {
        "doc_id": doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "doc_known": np.packbits(doc_ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(), "n_tokens": counts.astype("<u4").tobytes(),
        "end": ends.astype("<u8").tobytes(), "rules": (np.concatenate(rules) if rules else np.zeros((0, 2))).astype("<u4").tobytes(), "length": _lengths(rules, base).astype("<u4").tobytes(),
        "low": (symbols & 0xFFFF).astype("<u2").tobytes(), "high": b"".join(np.packbits((high >> k) & 1 == 1).tobytes() for k in range(bits)),
    }
    header = json.dumps({"base": base, "rounds": [len(r) for r in rules], "docs": len(counts), "tokens": len(tokens), "symbols": len(symbols), "bits": bits, "sizes": {k: len(v) for k, v in arrays.items()}}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(arrays.values())


class Shard:
    """A shard file's content; tokens are expanded on request."""

    def __init__(self, body: bytes):
        if body[:8] != MAGIC:
            raise ValueError("not a token shard")
        n = int.from_bytes(body[8:12], "little")
        h = self.header = json.loads(body[12 : 12 + n])
        at, part = 12 + n, {}
        for name, size in h["sizes"].items():
            part[name] = body[at : at + size]
            at += size
        docs, count = h["docs"], h["symbols"]
        known = np.unpackbits(np.frombuffer(part["doc_known"], np.uint8), count=docs).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(part["doc_id"], "<i8"), pa.int64(), mask=~known)
        self.counts = np.frombuffer(part["n_tokens"], "<u4").astype(np.int64)
        self.ends = np.frombuffer(part["end"], "<u8").astype(np.int64)
        flat = np.frombuffer(part["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.rules = np.split(flat, np.cumsum(h["rounds"])[:-1]) if h["rounds"] else []
        self.length = np.frombuffer(part["length"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(part["low"], "<u2").astype(np.int64)
        stride = (count + 7) // 8
        for k in range(h["bits"]):
            self.symbols |= np.unpackbits(np.frombuffer(part["high"][k * stride : (k + 1) * stride], np.uint8), count=count).astype(np.int64) << (16 + k)

    def tokens(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.header["base"], self.length)

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of the doc-th document; only the symbols that overlap
        are expanded, found by their expansion lengths."""
        base = self.header["base"]
        s = self.symbols[self.ends[doc - 1] if doc else 0 : self.ends[doc]]
        size = np.where(s >= base, self.length[np.maximum(s - base, 0)] if len(self.length) else 1, 1)
        end = np.cumsum(size)
        lo, hi = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1
        skipped = int(end[lo - 1]) if lo else 0
        return expand(s[lo:hi], self.rules, base, self.length)[start - skipped : stop - skipped]


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of all batches; portions are of ``CHUNK`` bytes of text or little
    more, where no single text is longer."""
    held, size = [], 0
    for b in batches:
        if not len(b):
            continue
        ids, texts = b.column(0), b.column(1).cast(pa.large_string()).fill_null("")
        upto = _content(texts)[0]
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(upto[1:] // CHUNK)) + 1).tolist(), len(b)]):
            held.append((ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)))
            size += int(upto[hi] - upto[lo])
            if size >= CHUNK:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def _write_batches(folder: str, tokenizer: str, base: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, context = encoder(tokenizer), TaskContext.get()
        ids, bodies, counts = [], [], []
        for some, texts in _portions(batches):
            ids.append(some)
            body, count = coder.encode_all(texts, (end_id,))
            bodies.append(body)
            counts.append(count)
            del body, texts
        if not counts:
            return
        bodies, counts = [np.concatenate(bodies)], np.concatenate(counts)
        common.release_memory()
        shard = context.partitionId()
        body = pack(pa.concat_arrays(ids), bodies.pop(), counts, base)
        name = f"shard-{shard:06d}.tok"
        # complete under another name first: a lost or doubled attempt leaves no half file
        draft = f"{folder}/.{name}-{context.taskAttemptId()}"
        files, at = _file(draft)
        files.create_dir(os.path.dirname(at), recursive=True)
        with files.open_output_stream(at) as f:
            f.write(body)
        files.move(at, _file(f"{folder}/{name}")[1])
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([shard], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(body)], pa.int64())], names=["path", "shard", "n_docs", "n_tokens", "n_bytes"])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes all documents and returns one row per shard (path, shard, n_docs,
    n_tokens, n_bytes), in order. A null text counts as empty (its end id alone); null
    ids come first; rows that repeat an id follow each other by text. An empty table
    makes no shard."""
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = src.repartitionByRange(common.n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    from tokenizers import Tokenizer

    base = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    made = ranged.mapInArrow(_write_batches(folder, tokenizer, base, end_id), "path string, shard long, n_docs long, n_tokens long, n_bytes long")
    return sorted(made.collect(), key=lambda r: r["shard"])  # one row per file


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            files, at = _file(path)
            with files.open_input_stream(at) as f:
                shard = Shard(f.read())
            body = memoryview(shard.tokens().astype("<u4", copy=False)).cast("B")
            ends = np.cumsum(shard.counts)
            crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), shard.counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(start + ends - shard.counts), pa.array(shard.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    rows, start = [], 0
    for i, s in enumerate(shards):
        rows.append((s["path"], start, i))
        start += s["n_tokens"]
    files = spark.createDataFrame(rows, "path string, start long, i int").repartitionById(max(1, len(rows)), F.col("i"))
    return files.select("path", "start").mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
