"""Score texts with a trigram model kept in Elias-Fano tries.

The texts are dealt into blocks. A first exchange counts words: each block asks the
words' shards for them, once for each distinct word. Then it sends its distinct
trigrams, with how often they occur in training texts, to the shards that own their
first words: once each, however often they occur. A shard sums the counts and builds a trie of
three levels. Each level is one monotone sequence in Elias-Fano code: a node's
symbol behind its parent's number, so a node's children are found by successor
search within their parent's range. The children's pointers are monotone and in
Elias-Fano code too; probabilities, discounted and with their back-off weights,
take 8 bits: codes of one table for all shards, exact for the counts that most
entries have. The levels are written to a file in the task's
own temporary folder, which a repeated task makes anew, and mapped into memory;
look-ups select in the packed levels and never unpack them. The shard answers each
block's trigrams in the order in which they came, one byte each, and the block
puts the answers together: p(w|uv) = a(uvw) + g(uv) (a(vw) + g(v) p(w)).

A block asks only the shards that own something of it, so there are no more messages
than distinct trigrams in the blocks: they grow with the text. A frequent word's
pairs are spread over as many shards as its count asks for, so no shard grows with
one word; the blocks sum what those shards say of it. The words' own counts are
exact. First words are known by 64 bits of hash; within a shard first words by 44
bits, and within their context second and third ones by 32.

Nulls: a null text counts as an empty one, which is one end token; a null doc_id
is a row like others (and learned from, unless ``held_out`` says otherwise).
Repeated rows each get their row and count twice if learned from. Without
training texts every token has the probability 1 (an empty model has no other
outcome than the unknown one). An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words

#: Bytes of text in a block (and about as much in a shard), and trigrams that are sorted at a time.
BLOCK, PIECE = 13 << 19, 2_000_000
#: Training tokens behind a word for each shard that its pairs are spread over.
SPREAD = 1 << 18
#: Bits of a first word's hash within its shard.
HASH = 44
#: What is taken from the count of a word, a pair, a trigram.
DISCOUNTS = (0.75, 0.8, 0.85)
_U = np.uint64
_BEGIN1, _BEGIN, _END, _PAD = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_SELECT = np.array([[next((i for i in range(8) if (b >> i & 1) and (b & ((1 << i) - 1)).bit_count() == j), 8) for j in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = np.arange(len(high)) * 64 - self.before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (int(values[-1]) >> width if n else 0)) // 64 + 1, _U)
        at = (values >> _U(width)) + np.arange(n, dtype=_U)
        np.bitwise_or.at(high, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        low = np.zeros(n * width // 64 + 2, _U)
        if width:
            bit = np.arange(n, dtype=_U) * _U(width)
            part, word = values & _U((1 << width) - 1), (bit >> _U(6)).astype(np.int64)
            np.bitwise_or.at(low, word, part << (bit & _U(63)))
            over = (bit & _U(63)) + _U(width) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - (bit[over] & _U(63))))
        return cls(n, width, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i.astype(_U) * _U(self.width)
        word, by = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        return ((self.low[word] >> by) | ((self.low[word + 1] << _U(1)) << (_U(63) - by))) & _U((1 << self.width) - 1)

    @staticmethod
    def _select(bits: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one of bits; before: ones before each word."""
        word = np.searchsorted(before, i, side="right") - 1
        left, at, bits = (i - before[word]).astype(np.uint8), word * 64, bits[word]
        for half in (32, 16, 8):
            low = bits & _U((1 << half) - 1)
            n = np.bitwise_count(low)
            right = left >= n
            left = np.where(right, left - n, left)
            bits = np.where(right, bits >> _U(half), low)
            at += right * half
        return at + _SELECT[bits.astype(np.intp), left]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i, by selecting the i-th one of the high bits."""
        i = np.asarray(i, np.int64)
        return ((self._select(self.high, self.before, i) - i).astype(_U) << _U(self.width)) | self._low(i)

    def find(self, targets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each target within [lo, hi), by successor search; -1 where it isn't.

        Values that share a target's high bits lie between two zeros of the high bits;
        what is left of the range is halved by the low bits.
        """
        out = np.full(len(targets), -1)
        high = (targets >> _U(self.width)).astype(np.int64)
        last = len(self.high) * 64 - self.n if self.n else 0  # zeros that there are
        ask = np.flatnonzero((lo < hi) & (high < last))
        if not len(ask):
            return out
        h, flipped = high[ask], ~self.high
        end = self._select(flipped, self.zeros, h) - h
        at = np.where(h > 0, self._select(flipped, self.zeros, np.maximum(h - 1, 0)) - (h - 1), 0)
        at, end = np.maximum(at, lo[ask]), np.minimum(end, hi[ask])
        stop, low = end.copy(), targets[ask] & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            mid = (at[open_] + end[open_]) >> 1
            less = self._low(mid) < low[open_]
            at[open_[less]], end[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[at[open_] < end[open_]]
        ok = np.flatnonzero(at < stop)
        ok = ok[self._low(at[ok]) == low[ok]]
        out[ask[ok]] = at[ok]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], _U), self.low, self.high]


def _table(exact: np.ndarray, grid) -> np.ndarray:
    """256 rising values: 0, the exact ones, and as many of a grid as are left."""
    exact = np.unique(np.round(exact, 12))
    n = 255 - len(exact)
    while len(out := np.unique(np.r_[0.0, exact, np.round(grid(n), 12)])) < 256:
        n += 1
    return out[:256]


def _tables(few: int = 14, most: int = 64) -> np.ndarray:
    """What the codes of shares, probabilities and back-off weights stand for."""
    c, pair = np.array([(c, p) for p in range(1, few + 1) for c in range(1, p + 1)], float).T
    odds = lambda n: 1 / (1 + np.exp(-np.linspace(-23, 23, n)))
    counts = np.arange(1, most) - DISCOUNTS[1]
    return np.stack([_table(counts, lambda n: np.geomspace(most, 2.0**44, n)), _table((c - DISCOUNTS[2]) / pair, odds), _table(DISCOUNTS[2] * c / pair, odds)])


_TABLES = _tables()


def quantised(kind: int, p: np.ndarray) -> np.ndarray:
    """The code of the nearest value of a table: 0 for shares, 1 for probabilities, 2 for back-off weights."""
    table = _TABLES[kind]
    return np.searchsorted((table[1:] + table[:-1]) / 2, p).astype(np.uint8)


class Trie:
    """Three levels of symbols with 8-bit codes of probabilities and back-off weights.

    share: of a pair, its discounted count, since its first word's count is spread
    over shards; prob: of a trigram, given its pair; backoff: of a pair.
    """

    def __init__(self, roots: EliasFano, level2: EliasFano, level3: EliasFano, ptr1: EliasFano, ptr2: EliasFano, codes: list[np.ndarray]):
        self.roots, self.level2, self.level3, self.ptr1, self.ptr2 = roots, level2, level3, ptr1, ptr2
        self.share, self.prob, self.backoff = codes

    @classmethod
    def build(cls, u: np.ndarray, vw: np.ndarray, count: np.ndarray) -> Trie:
        """u: first words; vw: the next two, 32 bits each; all with their counts, in any order."""
        order = np.lexsort((vw, u))
        u, vw, count = u[order], vw[order], count[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (vw[1:] != vw[:-1])] if len(u) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.add.reduceat(count, first) if len(first) else count[:0]
        u, vw = u[first], vw[first]
        v, w = vw >> _U(32), vw & _U(0xFFFFFFFF)
        new_u = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
        new_v = new_u | (np.r_[True, v[1:] != v[:-1]] if len(u) else new_u)
        at_u, at_v = np.flatnonzero(new_u), np.flatnonzero(new_v)
        pair = np.add.reduceat(count, at_v) if len(at_v) else count[:0]
        node2 = np.cumsum(new_v) - 1
        node1 = (np.cumsum(new_u) - 1)[at_v]
        sizes2, sizes1 = np.diff(np.r_[at_v, len(u)]), np.bincount(node1, minlength=len(at_u))
        prob = np.maximum(count - DISCOUNTS[2], 0) / pair[node2]
        made = [quantised(0, np.maximum(pair - DISCOUNTS[1], 0)), quantised(1, prob), quantised(2, DISCOUNTS[2] * sizes2 / np.maximum(pair, 1))]
        return cls(
            EliasFano.of(u[at_u]), EliasFano.of(node1.astype(_U) << _U(32) | v[at_v]), EliasFano.of(node2.astype(_U) << _U(32) | w),
            EliasFano.of(np.r_[0, np.cumsum(sizes1)]), EliasFano.of(np.r_[0, np.cumsum(sizes2)]),
            made,
        )

    def save(self, path: str) -> None:
        parts = [p for e in (self.roots, self.level2, self.level3, self.ptr1, self.ptr2) for p in e.parts()] + [self.share, self.prob, self.backoff]
        with open(path, "wb") as f:
            f.write(struct.pack(f"<{len(parts)}q", *(p.nbytes for p in parts)))
            for p in parts:
                f.write(np.ascontiguousarray(p).tobytes() + bytes(-p.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Trie:
        """The levels, mapped from the file."""
        with open(path, "rb") as f:
            sizes = struct.unpack("<18q", f.read(18 * 8))
        whole, at, parts = np.memmap(path, np.uint8, "r"), 18 * 8, []
        for i, n in enumerate(sizes):
            parts.append(whole[at : at + n].view(_U if i < 15 else np.uint8))
            at += n + -n % 8
        own = [EliasFano(int(parts[i][0]), int(parts[i][1]), parts[i + 1], parts[i + 2]) for i in range(0, 15, 3)]
        return cls(*own, parts[15:18])

    def find(self, u: np.ndarray, v: np.ndarray, of_v: np.ndarray, w: np.ndarray, of_w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of first words, of second ones (of_v: whose they are) and third ones (of_w), or -1; and how many children the first have."""
        n1 = self.roots.find(u, np.zeros(len(u), np.int64), np.full(len(u), self.roots.n))

        def below(node: np.ndarray, symbol: np.ndarray, of: np.ndarray, pointers: EliasFano, level: EliasFano) -> tuple[np.ndarray, np.ndarray]:
            lo, hi, ok = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.flatnonzero(node >= 0)
            lo[ok], hi[ok] = pointers.get(node[ok]).astype(np.int64), pointers.get(node[ok] + 1).astype(np.int64)
            # The parents that aren't there have empty ranges.
            return level.find(np.maximum(node, 0).astype(_U)[of] << _U(32) | symbol, lo[of], hi[of]), hi - lo

        n2, children = below(n1, v, of_v, self.ptr1, self.level2)
        n3, _ = below(n2, w, of_w, self.ptr2, self.level3)
        return n1, n2, n3, children


def _packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(raw) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(raw))


def _small(x: np.ndarray) -> bytes:
    """Mostly small counts: a byte each, large ones behind."""
    x = x.astype(_U)
    return struct.pack("<q", len(x)) + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].tobytes()


def _unsmall(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<q", raw, at)
    x = np.frombuffer(raw, np.uint8, n, at + 8).astype(np.int64)
    big, at = x == 255, at + 8 + n
    m = int(big.sum())
    x[big] = np.frombuffer(raw, np.dtype("<u8"), m, at)
    return x, at + 8 * m


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte: all first bytes, all second ones, ..."""
    return struct.pack("<q", len(x)) + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, at: int, kind: str) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<q", raw, at)
    size = n * np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at + 8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind), at + 8 + size


def _rising(x: np.ndarray) -> bytes:
    """A sorted sequence by its differences."""
    return _planes(np.diff(x, prepend=_U(0)))


def _unrising(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    x, at = _unplanes(raw, at, "<u8")
    return np.cumsum(x, dtype=_U), at


class _Piece:
    """The trigrams that begin at some places of a block's texts, and the distinct words in them."""

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, learned: np.ndarray, shards: int):
        lo, hi = int(begins[0]), int(begins[-1]) + 3
        vocabulary, local = np.unique(symbols[lo:hi], return_inverse=True)
        at, self.local, self.learned, self.shards = begins - lo, local, learned, shards
        self.begins, self.third, self.second = at, local[at + 2], local[at + 1]
        # Words' own counts: of third symbols, and of texts for the mark before them.
        heads = (symbols[begins + 1] == _BEGIN) & learned
        own = np.bincount(self.third[learned], minlength=len(vocabulary))
        if heads.any():
            own[self.second[heads][0]] = heads.sum()
        own[vocabulary == _PAD] = 0
        self.vocabulary, self.own = vocabulary, own
        owner = (words.mixed(vocabulary) % _U(shards)).astype(np.int64)
        self.word_order = np.argsort(owner, kind="stable")
        self.word_cut = np.searchsorted(owner[self.word_order], np.arange(shards + 1))

    def own_words(self, shard: int) -> np.ndarray:
        return self.word_order[self.word_cut[shard] : self.word_cut[shard + 1]]

    def asks(self) -> np.ndarray:
        """The shards that own a word of this piece."""
        return np.flatnonzero(np.diff(self.word_cut))

    def question(self, shard: int) -> bytes:
        own = self.own_words(shard)
        return _packed(_rising(self.vocabulary[own]), _small(self.own[own]))

    def deal(self, spread: np.ndarray, places: bool = False) -> None:
        """Sort the trigrams and deal them to shards; spread: over how many parts each word's pairs go.

        places: also number the distinct trigram (at) and the distinct pair (context) that begin at each place.
        """
        local, at = self.local.astype(_U), self.begins
        a, b, c = local[at], local[at + 1], local[at + 2]
        both = (a << _U(42) | b << _U(21) | c) << _U(1) | self.learned.astype(_U)
        del a, b, c
        order = np.argsort(both) if places else None
        both = both[order] if places else np.sort(both)
        plain = both >> _U(1)
        new = np.r_[True, plain[1:] != plain[:-1]]
        first = np.flatnonzero(new)
        self.key, self.count = plain[first], np.add.reduceat((both & _U(1)).astype(np.int64), first)
        pair = self.key >> _U(21)
        at_pair = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        self.pair = pair[at_pair]
        if places:
            self.at = np.empty(len(order), np.int64)
            self.at[order] = np.cumsum(new) - 1
            self.context = np.repeat(np.arange(len(at_pair)), np.diff(np.r_[at_pair, len(self.key)]))[self.at]
        first_word = (self.pair >> _U(21)).astype(np.int64)
        u, v = self.vocabulary[first_word], self.vocabulary[(self.pair & _U((1 << 21) - 1)).astype(np.int64)]
        shard_of = lambda u, part: (words.mixed(u + part.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(self.shards)).astype(np.int64)
        owner = shard_of(u, v % spread[first_word].astype(_U))
        # In the order of shards: pairs, and their trigrams behind them.
        self.pair_order = np.argsort(owner, kind="stable")
        sizes = np.diff(np.r_[at_pair, len(self.key)])
        self.sizes = sizes[self.pair_order]
        self.key_order = np.repeat(at_pair[self.pair_order] - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(len(self.key))
        self.pair_cut = np.searchsorted(owner[self.pair_order], np.arange(self.shards + 1))
        self.key_cut = np.r_[0, np.cumsum(self.sizes)][self.pair_cut]
        # A spread word's successors are counted in all of its shards, also where no pair of this piece lies.
        wide = np.flatnonzero(spread > 1)
        word, part = np.repeat(wide, spread[wide]), np.concatenate([np.arange(spread[i]) for i in wide]) if len(wide) else wide
        self.asked = np.unique(np.c_[shard_of(self.vocabulary[word], part), word], axis=0) if len(wide) else np.zeros((0, 2), np.int64)
        self.asked_cut = np.searchsorted(self.asked[:, 0], np.arange(self.shards + 1))

    def sends(self) -> np.ndarray:
        """The shards that own a trigram of this piece, or successors of a word in it."""
        return np.flatnonzero(np.diff(self.pair_cut) + np.diff(self.asked_cut))

    def first_words(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words that a shard is asked for (local numbers), and how many pairs each has there."""
        u = (self.pair[self.pair_order[self.pair_cut[shard] : self.pair_cut[shard + 1]]] >> _U(21)).astype(np.int64)
        more = self.asked[self.asked_cut[shard] : self.asked_cut[shard + 1], 1]
        every = np.unique(np.r_[u, more])
        return every, np.searchsorted(u, every, side="right") - np.searchsorted(u, every)

    def message(self, shard: int) -> bytes:
        pairs = self.pair_order[self.pair_cut[shard] : self.pair_cut[shard + 1]]
        keys = self.key_order[self.key_cut[shard] : self.key_cut[shard + 1]]
        low = _U((1 << 21) - 1)
        u, n = self.first_words(shard)
        top = lambda x: (self.vocabulary[x.astype(np.int64)] >> _U(32)).astype(np.uint32)
        return _packed(
            _rising(self.vocabulary[u] >> _U(64 - HASH)), _small(n), _planes(top(self.pair[pairs] & low)),
            _small(self.sizes[self.pair_cut[shard] : self.pair_cut[shard + 1]]), _planes(top(self.key[keys] & low)), _small(self.count[keys]),
        )


def _read_message(raw: bytes) -> list[np.ndarray]:
    u, at = _unrising(raw, 0)
    pairs, at = _unsmall(raw, at)
    v, at = _unplanes(raw, at, "<u4")
    sizes, at = _unsmall(raw, at)
    w, at = _unplanes(raw, at, "<u4")
    n, at = _unsmall(raw, at)
    return [u, pairs, v, sizes, w, n]


def _pack(rows: pd.DataFrame) -> bytes:
    """Ids, marks and texts of some documents, in one blob."""
    texts = words.encoded(rows.text)
    known = rows.doc_id.notna().to_numpy(bool)
    ids = rows.doc_id.fillna(0).to_numpy(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    return _packed(struct.pack("<q", len(texts)), known.tobytes(), ids.tobytes(), rows.held_out.to_numpy(bool).tobytes(), sizes.tobytes(), *texts)


def _unpack(blob) -> Iterator[tuple[bool, int, bytes, bool]]:
    raw = _unpacked(blob)
    (n,) = struct.unpack_from("<q", raw)
    known, ids, held, sizes = (np.frombuffer(raw, kind, n, 8 + at * n) for kind, at in ((bool, 0), (np.int64, 1), (bool, 9), (np.int64, 10)))
    end = 8 + 18 * n + np.cumsum(sizes)
    for i in range(n):
        yield bool(known[i]), int(ids[i]), raw[end[i] - sizes[i] : end[i]], bool(held[i])


class _Block:
    """The texts of a block in a fixed order, cut into pieces."""

    def __init__(self, packs, shards: int):
        rows = sorted(row for pack in packs for row in _unpack(pack))
        self.ids = [i if known else None for known, i, _, _ in rows]
        self.held_out = np.array([held for *_, held in rows], bool)
        texts = [t for _, _, t, _ in rows]
        del rows
        h, n = words.hashes(texts)
        self.n = n + 1
        start = np.cumsum(n + 4) - (n + 4)
        symbols = np.empty(int((n + 4).sum()), _U)
        symbols[start], symbols[start + 1], symbols[start + n + 2], symbols[start + n + 3] = _BEGIN1, _BEGIN, _END, _PAD
        inner = np.ones(len(symbols), bool)
        inner[np.concatenate((start, start + 1, start + n + 2, start + n + 3))] = False
        symbols[inner] = h
        begins = np.ones(len(symbols), bool)
        begins[np.concatenate((start + n + 2, start + n + 3))] = False
        begins = np.flatnonzero(begins)
        doc = np.repeat(np.arange(len(n)), n + 2)
        learned = ~self.held_out[doc]
        self.docs, self.pieces, self.symbols = [], [], symbols
        for at in range(0, len(begins), PIECE):
            # One trigram more, which counts in the next piece: it begins with this piece's last pair.
            part = slice(at, at + PIECE + 1)
            self.docs.append(doc[at : at + PIECE])
            counts = learned[part] & (np.arange(len(begins[part])) < PIECE)
            self.pieces.append(lambda part=part, counts=counts: _Piece(symbols, begins[part], counts, shards))


def _answer_words(rows: pd.DataFrame) -> Iterator[tuple[int | None, int | None, bytes | None, int | None, int | None]]:
    """The words' counts over all pieces; and a row with the shard's tokens and types."""
    asked, counts = [], []
    for m in rows.message:
        raw = _unpacked(m)
        x, at = _unrising(raw, 0)
        asked.append(x)
        counts.append(_unsmall(raw, at)[0])
    every, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64) if len(every) else np.zeros(0, np.int64)
    real = every != _BEGIN
    yield None, None, None, int(total[real].sum()), int((total[real] > 0).sum())
    for block, piece, x in zip(rows.block, rows.piece, asked):
        yield block, piece, _packed(_small(total[np.searchsorted(every, x)])), None, None


def _answer(rows: pd.DataFrame) -> Iterator[tuple[int, int, bytes]]:
    """Build the shard's trie of all pieces' trigrams, and look up each piece's."""
    messages = [_read_message(_unpacked(m)) for m in rows.message]
    n_u, n_v, n_w = ([len(m[i]) for m in messages] for i in (0, 2, 4))
    u, pairs, v, sizes, w, count = (np.concatenate([m[i] for m in messages]) for i in range(6))
    del messages
    of_v, of_w = np.repeat(np.arange(len(u)), pairs), np.repeat(np.arange(len(v)), sizes)
    seen = count > 0
    with tempfile.TemporaryDirectory() as folder:
        of = of_w[seen]
        Trie.build(u[of_v[of]], v[of].astype(_U) << _U(32) | w[seen].astype(_U), count[seen]).save(os.path.join(folder, "trie"))
        del seen, of, count
        trie = Trie.load(os.path.join(folder, "trie"))
        n1, n2, n3, children = trie.find(u, v.astype(_U), of_v, w.astype(_U), of_w)
        value = lambda n, x: np.where(n >= 0, x[np.maximum(n, 0)] if len(x) else 0, 0)
        share, backoff, prob = value(n2, trie.share).astype(np.uint8), value(n2, trie.backoff).astype(np.uint8), value(n3, trie.prob).astype(np.uint8)
        del trie
    a = b = c = 0
    for block, piece, x, y, z in zip(rows.block, rows.piece, n_u, n_v, n_w):
        yield block, piece, _packed(_small(children[a : a + x]), share[b : b + y].tobytes(), backoff[b : b + y].tobytes(), prob[c : c + z].tobytes())
        a, b, c = a + x, b + y, c + z


def _counts(p: _Piece, heard: dict[tuple[int, int], bytes], number: int) -> np.ndarray:
    """How often each word of a piece occurs in all training texts, as the shards say."""
    own = np.zeros(len(p.vocabulary), np.int64)
    for s in p.asks():
        own[p.own_words(s)] = _unsmall(_unpacked(heard[number, s]), 0)[0]
    return own


def _scores(block: _Block, heard: dict[tuple[int, int], bytes], answers: dict[tuple[int, int], bytes], tokens: int, types: int) -> pd.DataFrame:
    n_docs = len(block.n)
    base, score, known = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs, np.int64)
    for number, (make, doc) in enumerate(zip(block.pieces, block.docs)):
        p = make()
        own, successors = _counts(p, heard, number), np.zeros(len(p.vocabulary), np.int64)
        p.deal(1 + own // SPREAD, places=True)
        share, backoff, prob = np.zeros(len(p.pair), np.float32), np.zeros(len(p.pair), np.float32), np.zeros(len(p.key), np.float32)
        for s in p.sends():
            raw = _unpacked(answers[number, s])
            x, at = _unsmall(raw, 0)
            successors[p.first_words(s)[0]] += x
            a, b = p.pair_cut[s], p.pair_cut[s + 1]
            share[p.pair_order[a:b]] = _TABLES[0][np.frombuffer(raw, np.uint8, b - a, at)]
            backoff[p.pair_order[a:b]] = _TABLES[2][np.frombuffer(raw, np.uint8, b - a, at + b - a)]
            c, d = p.key_cut[s], p.key_cut[s + 1]
            prob[p.key_order[c:d]] = _TABLES[1][np.frombuffer(raw, np.uint8, d - c, at + 2 * (b - a))]
        predicted = np.flatnonzero(p.vocabulary[p.third[: len(doc)]] != _PAD)
        # A trigram's last two words begin the text's next one.
        i3, context, i2 = p.at[predicted], p.context[predicted], p.context[predicted + 1]
        third, second, of = p.third[predicted], p.second[predicted], doc[predicted]
        c = own[third].astype(float)
        base += np.bincount(of, np.log10((c + 1) / (tokens + types + 1)), n_docs)
        known += np.bincount(of[c > 0], minlength=n_docs)
        p1 = (np.maximum(c - DISCOUNTS[0], 0) + DISCOUNTS[0] * types / (types + 1)) / tokens if tokens else np.ones(len(c))
        before = own[second].astype(float)
        p2 = np.where(before > 0, np.minimum(1, (share[i2] + DISCOUNTS[1] * successors[second] * p1) / np.maximum(before, 1)), p1)
        g = backoff[context]
        p3 = np.where(g > 0, prob[i3] + g * p2, p2)
        score += np.bincount(of, np.log10(np.minimum(1, p3)), n_docs)
    return pd.DataFrame({"n_tokens": block.n, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The model learns from the rows where ``held_out`` is not true. Texts are shuffled
    once, into blocks; all uses of a block read that shuffle.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // BLOCK) + 1
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(block, _pack(own)) for block, own in batch.groupby("block")]
            yield pd.DataFrame(out, columns=["block", "pack"])

    def ask(own: pd.DataFrame) -> pd.DataFrame:
        out = [(number, s, p.question(s)) for number, p in enumerate(make() for make in _Block(own["pack"], shards).pieces) for s in p.asks()]
        return pd.DataFrame(out, columns=["piece", "shard", "message"]).assign(block=own.block.iloc[0])

    def answer_words(own: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(_answer_words(own)), columns=["block", "piece", "answer", "tokens", "types"])
        return out.astype(dict.fromkeys(("block", "piece", "tokens", "types"), "Int64")).assign(shard=own["shard"].iloc[0])

    def named(got: pd.DataFrame) -> dict[tuple[int, int], bytes]:
        return {(p, s): a for p, s, a in zip(got.piece, got["shard"], got.answer)}

    def send(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        heard, out = named(got), []
        for number, make in enumerate(_Block(own["pack"], shards).pieces):
            p = make()
            p.deal(1 + _counts(p, heard, number) // SPREAD)
            out += [(number, s, p.message(s)) for s in p.sends()]
        return pd.DataFrame(out, columns=["piece", "shard", "message"]).assign(block=own.block.iloc[0])

    def answer(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_answer(own)), columns=["block", "piece", "answer"]).assign(shard=own["shard"].iloc[0])

    def finish(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        block, of_words = _Block(own["pack"], shards), got.tokens.isna().to_numpy()
        known = got[~of_words]
        out = _scores(block, named(got[of_words]), named(known), int(known.tokens.iloc[0]), int(known.types.iloc[0]))
        out.insert(0, "doc_id", pd.array(block.ids, "Int64"))
        return out.assign(held_out=block.held_out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = rows.mapInPandas(pack, "block long, pack binary").groupBy("block")
    asked = texts.applyInPandas(ask, "piece long, shard long, message binary, block long")
    heard = asked.groupBy("shard").applyInPandas(answer_words, "block long, piece long, answer binary, tokens long, types long, shard long")
    totals = heard.where("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    heard = heard.where("block is not null")
    sent = texts.cogroup(heard.groupBy("block")).applyInPandas(send, "piece long, shard long, message binary, block long")
    answered = sent.groupBy("shard").applyInPandas(answer, "block long, piece long, answer binary, shard long").crossJoin(F.broadcast(totals))  # one row
    answered = answered.unionByName(heard.withColumns({"tokens": F.lit(None).cast("long"), "types": F.lit(None).cast("long")}))
    return texts.cogroup(answered.groupBy("block")).applyInPandas(finish, schema)
