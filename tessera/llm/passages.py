"""Passages that documents share, also with some words changed: seeds, chains, alignment.

Seeds are all runs of SEED words: a passage of MIN_WORDS words with a share of IDENTITY
matches has FEWEST at least, wherever the changed words are. Documents are ordered by
a hash of their ids and dealt into units, ranges of that order. A unit asks the buckets
of its seeds once for each distinct seed, with its first place in the unit; the bucket
answers with the first place of all. So every place of a seed is tied to one other
place, whatever the batches and units are, a passage is found as often as a document
holds it, and rows grow with the text: a seed that a third of all documents hold is one
entry of each unit. Places with fewer than FEWEST tied ones near them are left out.

The first places of a passage's seeds may lie scattered over documents that don't have
the passage. So units also ask for runs of LONG words, the least of any WINDOW in a row
by hash. Where no seed of such a run, or within LONG words of it, is one of ENOUGH on one
diagonal, its words are tied to the first place of the whole run; any LONG + WINDOW - 1
unchanged words have such a run. What is shared without so many, or beside seeds that are
tied to another text, is found by the seeds' first places alone.

A text's seeds near each other in an earlier document are chained by a tree of best
scores: ordered matches on both sides at most GAP words apart, a cost for each word
between them. The unit then asks the others for blocks of words, once for each block,
and aligns its chains word by word (matches along diagonals, short gaps by dynamic
programming, extended at both ends; chains of one diagonal many at a time). Alignments
with a share of IDENTITY matches that follow each other within JOIN words make a
passage, also if they are tied to different documents; it has at least MIN_WORDS words.
What units and buckets send each other is one message for a pair that has something to say.

Null ids take no part; null texts count as empty ones. A document is not compared
with itself, so rows that repeat do not make passages of each other, and neither do
repeats within a text (of an earlier document's passage, each copy is found). An id
with several texts is one document, whose texts are not compared with each other;
``digest`` says which of them a place is in. Documents may have any length. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.names import apart

SEED = 4
#: Words of long runs, how many in a row have one that is asked for, and seeds on one diagonal that make it needless.
LONG, WINDOW, ENOUGH = 3 * SEED, 12, 9
#: Words between chained matches at most, and what each of them costs.
GAP, COST = 42, 0.15
MIN_WORDS, IDENTITY = 45, 0.8
#: Words of an alignment at least, and between alignments of one passage at most.
PART, JOIN = 12, 16
#: Words that a chain may be extended by at each end, words in a block that is sent to be aligned, and places between texts of a unit.
REACH, BLOCK, PAD = 32, 64, 64
#: Tied places within MIN_WORDS words, by the q-gram lemma 36 - 10 * 3 = 6; one less for words that are missing.
FEWEST = 5
#: Words between seeds of one segment at most.
SAME = 10
#: Bytes of text in a unit, and of text whose seeds are a bucket's: both grow in number with the corpus.
UNIT, BUCKET = 13 << 18, 13 << 18
#: Words that are compared at a time.
CELLS = 1 << 19
_U = np.uint64


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of int64, a row of lowest bytes, of next bytes and so on, without the highest ones that are zero everywhere."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    used = [max(1, 1 + int(np.flatnonzero(p.any(1)).max(initial=0))) for p in planes]
    return zstandard.ZstdCompressor(level=1).compress(bytes(used) + b"".join(p[:k].tobytes() for p, k in zip(planes, used)))


def _unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    used, at, out = raw[:n], 0, []
    planes = np.frombuffer(raw, np.uint8, offset=n).reshape(sum(used), -1)
    for k in used:
        whole = np.zeros((planes.shape[1], 8), np.uint8)
        whole[:, :k] = planes[at : at + k].T
        out.append(whole.view("<i8").ravel())
        at += k
    return out


def _pack(rows: pd.DataFrame) -> bytes:
    """Order, ids and texts of some documents, in one blob."""
    texts = words.encoded(rows.text)
    sizes = np.array([len(t) for t in texts], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack("<q", len(texts)), rows.h.to_numpy(np.int64).tobytes(), rows.doc_id.to_numpy(np.int64).tobytes(), sizes.tobytes(), *texts]))


def _unpack(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    h, ids, sizes = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * i) for i in range(3))
    end = 8 + 24 * n + np.cumsum(sizes)
    for i in range(n):
        yield int(h[i]), int(ids[i]), raw[end[i] - sizes[i] : end[i]]


def _message(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _read(raw) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(raw)))


def bucket_bits(size: int) -> int:
    """Buckets are a power of two; a seed is known by that many bits and 32 more."""
    return max(2, (size // BUCKET).bit_length())


class _Unit:
    """The distinct texts of a unit in order, and places for their words, PAD apart from text to text."""

    def __init__(self, packs):
        rows = sorted({row for pack in packs for row in _unpack(bytes(pack))})
        self.texts, self.ids = [t for *_, t in rows], np.array([i for _, i, _ in rows], np.int64)
        h, self.n = words.hashes(self.texts)
        self.begin = np.cumsum(self.n + PAD) - (self.n + PAD)
        self.owner = np.repeat(np.arange(len(rows)), self.n)
        self.words = np.zeros(int((self.n + PAD).sum()), np.uint16)
        self.words[np.arange(len(h)) + self.owner * PAD] = (h >> _U(48)).astype(np.uint16)
        self.hashes = h

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def sort(self, bits: int) -> None:
        """Seeds and chosen long runs by hash and place; the distinct ones and their first places."""
        run, k = words.shingles(self.hashes, self.n, SEED)
        place = np.arange(len(run)) + np.repeat(self.begin - (np.cumsum(k) - k), k)
        own = np.flatnonzero(place[LONG - SEED :] - place[: max(0, len(place) - LONG + SEED)] == LONG - SEED)  # in one text
        whole = words.mixed(words.mixed(run[own] * _U(31) + run[own + SEED]) * _U(31) + run[own + 2 * SEED])
        chosen = _least(whole, self.text_of(place[own]))
        long = np.r_[np.zeros(len(run), bool), np.ones(len(chosen), bool)]
        run, place = np.r_[run, whole[chosen]], np.r_[place, place[own[chosen]]]
        order = np.argsort(run, kind="stable")
        key = run[order] >> _U(32 - bits)
        self.place, self.long = place[order], long[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        self.of, self.key = np.cumsum(new) - 1, key[new]
        self.first = self.place[new]
        self.edge = np.searchsorted(self.key, np.arange((1 << bits) + 1, dtype=_U) << _U(32))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed seeds with their first places) of each bucket."""
        low = (self.key & _U(0xFFFFFFFF)).astype(np.int64)
        for b in np.flatnonzero(np.diff(self.edge)):
            part = slice(self.edge[b], self.edge[b + 1])
            yield int(b), _packed(np.diff(low[part], prepend=0), self.first[part])

    def ties(self, number: int, bits: int, buckets, answers) -> tuple[np.ndarray, np.ndarray]:
        """Places that are tied, and the places that they are tied to (a unit's number in the high bits)."""
        self.sort(bits)
        ref = self.first + (number << 32)
        for b, raw in zip(buckets, answers):
            at, n = int(self.edge[b]), int(self.edge[b + 1] - self.edge[b])
            size = -(-n // 8)
            tied = at + np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size), count=n))
            unit, place = _unpacked(raw[size:], 2)
            ref[tied] = unit << 32 | place
        place, ref = self.place, ref[self.of]
        there = np.flatnonzero(ref >> 32 == number)
        same = there[self.ids[self.text_of(place[there])] == self.ids[self.text_of(ref[there] & 0xFFFFFFFF)]]
        tied = np.ones(len(place), bool)
        tied[same] = False
        short, long = tied & ~self.long, tied & self.long
        lost, lost_ref = self.lost(place[short], ref[short], place[long], ref[long])
        place, ref = np.r_[place[short], lost], np.r_[ref[short], lost_ref]
        order = np.lexsort((ref, place))
        place, ref = place[order], ref[order]
        new = np.r_[True, (np.diff(place) != 0) | (np.diff(ref) != 0)] if len(place) else np.zeros(0, bool)
        place, ref = place[new], ref[new]
        once = np.unique(place)
        kept = _dense(once)[np.searchsorted(once, place)]
        return place[kept], ref[kept]

    def lost(self, place: np.ndarray, ref: np.ndarray, long: np.ndarray, long_ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ties of the words of those long runs whose seeds are tied here and there."""
        order = np.lexsort((place, ref - place))
        place, diagonal = place[order], (ref - place)[order]
        new = np.r_[True, (np.diff(diagonal) != 0) | (np.diff(place) > SAME)] if len(place) else np.zeros(0, bool)
        size = np.diff(np.r_[np.flatnonzero(new), len(place)])
        along = np.zeros(len(self.words) + 3 * LONG, np.int64)
        along[place + LONG] = np.repeat(size, size)
        some = along[long[:, None] + np.arange(3 * LONG - SEED + 1)].max(1) < ENOUGH  # also beside the run, LONG words on either side
        step = np.arange(LONG - SEED + 1)
        return (long[some, None] + step).ravel(), (long_ref[some, None] + step).ravel()


def _least(run: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which runs are the least of some WINDOW in a row of a text."""
    n = len(run) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, own = run[:n].copy(), text[:n] == text[WINDOW - 1 :]
    for i in range(1, WINDOW):
        np.minimum(least, run[i : i + n], out=least)
    out = np.zeros(len(run), bool)
    for i in range(WINDOW):
        out[i : i + n] |= own & (run[i : i + n] == least)
    return np.flatnonzero(out)


def _answer(rows: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    """For each unit's seeds of a bucket: which are tied, and the first units and places of those."""
    parts = [_unpacked(bytes(held), 2) for held in rows.held]
    key, place = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.repeat(rows.unit.to_numpy(np.int64), [len(p[0]) for p in parts]) << 32 | place
    order = np.lexsort((at, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.empty(len(key), np.int64)
    first[order] = at[order][new][np.cumsum(new) - 1]
    lo = 0
    for unit, n in zip(rows.unit, (len(p[0]) for p in parts)):
        ref, tied = first[lo : lo + n], first[lo : lo + n] != at[lo : lo + n]
        if tied.any():
            yield unit, np.packbits(tied).tobytes() + _packed(ref[tied] >> 32, ref[tied] & 0xFFFFFFFF)
        lo += n


_NONE = (-1e18, -1)


class Fenwick:
    """Greatest (value, item) over prefixes of places."""

    def __init__(self, n: int):
        self.best = [_NONE] * (n + 1)

    def put(self, i: int, entry: tuple[float, int]) -> None:
        best, i = self.best, i + 1
        while i < len(best):
            if best[i] < entry:
                best[i] = entry
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Among the first i places."""
        best, out = self.best, _NONE
        while i > 0:
            if best[i] > out:
                out = best[i]
            i -= i & -i
        return out


class Reach:
    """Greatest entries over any ``width`` places in a row: Fenwick trees from both ends of each block of that many."""

    def __init__(self, width: int):
        self.width, self.up, self.down = width, {}, {}

    def put(self, place: int, entry: tuple[float, int]) -> None:
        block, at = divmod(place, self.width)
        if block not in self.up:
            self.up[block], self.down[block] = Fenwick(self.width), Fenwick(self.width)
        self.up[block].put(at, entry)
        self.down[block].put(self.width - 1 - at, entry)

    def top(self, lo: int) -> tuple[float, int]:
        """Among places lo to lo + width - 1: the end of one block and the begin of the next."""
        block, at = divmod(lo, self.width)
        one = self.down[block].top(self.width - at) if block in self.down else _NONE
        two = self.up[block + 1].top(at) if block + 1 in self.up else _NONE
        return max(one, two)


def _segments(pos: np.ndarray, ref: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """First seed, last seed, its place in the other text (and group) of runs of seeds on one diagonal."""
    group = np.zeros(len(pos), np.int64) if group is None else group
    order = np.lexsort((pos, pos - ref, group))
    pos, ref, group = pos[order], ref[order], group[order]
    # Words that differ within a segment are counted when it is aligned.
    new = np.r_[True, (np.diff(pos - ref) != 0) | (np.diff(pos) > SAME) | (np.diff(group) != 0)] if len(pos) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(pos)][: len(first)] - 1
    return pos[first], pos[last], ref[first], group[first]


def chains(pos: np.ndarray, ref: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of segments (first seed, last seed, its place in the other text) of matched seeds."""
    return _chained(*_segments(pos, ref)[:3])


def _chained(start: np.ndarray, end: np.ndarray, r_start: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of segments, the best one first; each segment is in one."""
    if len(start) == 1:
        return [[(int(start[0]), int(end[0]), int(r_start[0]))]]
    r_end = r_start + end - start
    value, back = np.zeros(len(start)), np.full(len(start), -1)
    own = (end - start + SEED).astype(float)
    # A predecessor ended at most ``far`` words ago on both sides: in the block of words where a
    # segment starts or the one before. A block's segments first meet those of the block before,
    # from the last on (which is complete), then each other as they end; so entries only come.
    far = GAP + SEED
    by_start, by_end = np.lexsort((r_start, start)), np.lexsort((r_end, end))
    starts_in, ends_in = start[by_start] // far, end[by_end] // far
    entry = lambda j: (value[j] + COST * float(end[j] + r_end[j]), int(j))
    for block in np.unique(starts_in):
        mine = by_start[np.searchsorted(starts_in, block) : np.searchsorted(starts_in, block, "right")]
        before = by_end[np.searchsorted(ends_in, block - 1) : np.searchsorted(ends_in, block - 1, "right")]
        within = by_end[np.searchsorted(ends_in, block) : np.searchsorted(ends_in, block, "right")]
        best: dict[int, tuple[float, int]] = {}
        reach, left = Reach(far), len(before)
        for i in mine[::-1] if left else ():
            while left and end[before[left - 1]] >= start[i] - far:
                left -= 1
                reach.put(int(r_end[before[left]]), entry(before[left]))
            best[i] = reach.top(int(r_start[i]) - far)
        reach, done = Reach(far), 0
        for i in mine:
            while done < len(within) and end[within[done]] < start[i]:
                reach.put(int(r_end[within[done]]), entry(within[done]))
                done += 1
            top, j = max(best.get(i, _NONE), reach.top(int(r_start[i]) - far))
            gain = top - COST * float(start[i] + r_start[i])
            value[i] = own[i]
            if j >= 0 and gain > 0:
                value[i], back[i] = own[i] + gain, j
    used, out = np.zeros(len(start), bool), []
    for i in np.argsort(-value, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((int(start[i]), int(end[i]), int(r_start[i])))
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _dense(place: np.ndarray) -> np.ndarray:
    """Which of the sorted places have FEWEST ones (with themselves) within MIN_WORDS words."""
    k, kept = FEWEST - 1, np.zeros(len(place), bool)
    near = np.flatnonzero(place[k:] - place[: max(0, len(place) - k)] <= MIN_WORDS - SEED)
    for j in range(FEWEST):
        kept[near + j] = True
    return kept


def _plan(unit: _Unit, place: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Chains of a unit's ties as rows of segments: chain, first seed, last seed, place that it is tied to."""
    text = unit.text_of(place)
    order = np.lexsort((ref, text))
    place, ref, text = place[order], ref[order], text[order]
    # Segments that are farther apart on the other side are never in one chain.
    group = np.cumsum(np.r_[True, (np.diff(text) != 0) | (np.diff(ref) > GAP + SEED)]) - 1 if len(text) else text
    start, end, to, group = _segments(place, ref, group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    size = np.diff(np.r_[first, len(group)])
    alone = first[size == 1]
    rows, n = [np.stack([np.arange(len(alone)), start[alone], end[alone], to[alone]], 1)], len(alone)
    for lo, k in zip(first[size > 1], size[size > 1]):
        for chain in _chained(start[lo : lo + k], end[lo : lo + k], to[lo : lo + k]):
            rows.append(np.c_[np.full(len(chain), n), np.array(chain, np.int64)])
            n += 1
    return np.concatenate(rows)


def _matches(x: np.ndarray, y: np.ndarray) -> int:
    """Words of a longest common subsequence of two short gaps."""
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == w)))
    return int(row[-1])


def _extent(same: np.ndarray) -> int:
    """How far to extend: while matches outweigh mismatches."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, 1, -2))
    return int(score.argmax()) + 1 if score.max() > 0 else 0


def align(segments: np.ndarray, x: np.ndarray, x_at: int, y: np.ndarray, y_at: int) -> tuple[int, int, int, int, float]:
    """Place in both texts and share of matches of a chain; x, y: words from x_at, y_at on."""
    s = segments.astype(np.int64)
    a, b = int(s[0, 0]), int(s[-1, 1]) + SEED
    c, d = int(s[0, 2]), int(s[-1, 2] + s[-1, 1] - s[-1, 0]) + SEED
    hits, p, q = 0, a, c
    for start, end, r in s:
        r_end = r + end - start + SEED
        over = max(p - start, q - r, 0)  # seeds of neighbouring segments may overlap
        start, r = start + over, r + over
        hits += _matches(x[p - x_at : start - x_at], y[q - y_at : r - y_at])
        n = end + SEED - start
        if n > 0:
            hits += int((x[start - x_at : start - x_at + n] == y[r - y_at : r - y_at + n]).sum())
            p, q = end + SEED, r_end
    size = max(b - a, d - c)
    n = min(a - x_at, c - y_at, REACH)
    left = _extent((x[a - x_at - n : a - x_at] == y[c - y_at - n : c - y_at])[::-1])
    n = min(len(x) - (b - x_at), len(y) - (d - y_at), REACH)
    right = _extent(x[b - x_at : b - x_at + n] == y[d - y_at : d - y_at + n])
    grown = int((x[a - left - x_at : a - x_at] == y[c - left - y_at : c - y_at]).sum() + (x[b - x_at : b + right - x_at] == y[d - y_at : d + right - y_at]).sum())
    return a - left, b + right, c - left, d + right, (hits + grown) / (size + left + right)


def _wanted(plan: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit the numbers of the blocks that hold the chains' other sides, and REACH words more at both ends."""
    if not len(plan):
        return
    edge = np.flatnonzero(np.r_[True, plan[1:, 0] != plan[:-1, 0]])
    last = np.r_[edge[1:], len(plan)] - 1
    lo = plan[edge, 3]
    hi = plan[last, 3] + plan[last, 2] - plan[last, 1] + SEED
    a, b = np.maximum(lo & 0xFFFFFFFF, REACH) - REACH, (hi & 0xFFFFFFFF) + REACH - 1
    a, b = a // BLOCK, b // BLOCK
    n = b - a + 1
    block = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    every = np.unique(np.repeat(lo >> 32, n) << 32 | block)
    cut = np.flatnonzero(np.r_[True, np.diff(every >> 32) != 0])
    for x, y in zip(cut, np.r_[cut[1:], len(every)]):
        yield int(every[x] >> 32), every[x:y] & 0xFFFFFFFF


class _Held:
    """Words of another unit's blocks, and the texts that they lie in."""

    def __init__(self, blocks: np.ndarray, raw: np.ndarray, begin: np.ndarray, n: np.ndarray, ids: np.ndarray):
        self.blocks, self.words, self.begin, self.n, self.ids = blocks, raw, begin, n, ids

    @staticmethod
    def sent(unit: _Unit, blocks: np.ndarray) -> tuple:
        at = np.minimum(blocks[:, None] * BLOCK + np.arange(BLOCK), len(unit.words) - 1)
        texts = np.unique(np.clip(np.r_[unit.text_of(blocks * BLOCK), unit.text_of(blocks * BLOCK + BLOCK - 1)], 0, None))
        both = np.unique(np.r_[texts, np.minimum(texts + 1, len(unit.ids) - 1)])  # a short text may lie within a block
        return blocks, unit.words[at].ravel(), unit.begin[both], unit.n[both], unit.ids[both]

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def get(self, place: np.ndarray) -> np.ndarray:
        block = np.minimum(np.searchsorted(self.blocks, place // BLOCK), len(self.blocks) - 1)
        return self.words[block * BLOCK + place % BLOCK]


def _straight(unit: _Unit, held: _Held, start: np.ndarray, end: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alignments of chains of one segment, many at a time: places on both sides and shares of matches."""
    size = end + SEED - start
    own, other = unit.text_of(start), held.text_of(to)
    left = np.minimum(REACH, np.minimum(start - unit.begin[own], to - held.begin[other]))
    right = np.minimum(REACH, np.minimum(unit.begin[own] + unit.n[own] - start, held.begin[other] + held.n[other] - to) - size)
    hits, before, after = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    step = np.arange(REACH)

    def grown(rows: np.ndarray, at: np.ndarray, sign: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far to extend, and the matches there."""
        use = step < most[:, None]
        x, y = (np.where(use, base[:, None] + sign * step, base[:, None] * 0) for base in (start[rows] + at, to[rows] + at))
        same = (unit.words[x] == held.get(y)) & use
        score = np.cumsum(np.where(use, np.where(same, 1, -2), -(1 << 20)), 1)
        n = np.where(score.max(1) > 0, score.argmax(1) + 1, 0)
        return n, (same & (step < n[:, None])).sum(1)

    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        hi = at + 1
        while hi < len(order) and (hi + 1 - at) * max(int(size[order[hi]]), REACH) <= CELLS and hi - at < 20_000:
            hi += 1
        rows, width = order[at:hi], int(size[order[hi - 1]])
        use = np.arange(width) < size[rows][:, None]
        x, y = (np.where(use, base[rows][:, None] + np.arange(width), base[rows][:, None]) for base in (start, to))
        inside = ((unit.words[x] == held.get(y)) & use).sum(1)
        before[rows], more = grown(rows, np.full(len(rows), -1), -1, left[rows])
        after[rows], most = grown(rows, size[rows], 1, right[rows])
        hits[rows] = inside + more + most
        at = hi
    return start - before, end + SEED + after, to - before, to + size + after, hits / np.maximum(1, size + before + after)


def _aligned(unit: _Unit, plan: np.ndarray, held: dict[int, _Held]) -> Iterator[tuple[np.ndarray, ...]]:
    """Alignments that are long and alike enough, as arrays: places a to b, the other side's text id and words c to d, share."""
    if not len(plan):
        return
    edge = np.flatnonzero(np.r_[True, plan[1:, 0] != plan[:-1, 0]])
    size = np.diff(np.r_[edge, len(plan)])
    for number in np.unique(plan[:, 3] >> 32):
        there = held[int(number)]
        one = edge[(size == 1) & (plan[edge, 3] >> 32 == number)]
        found = [_straight(unit, there, plan[one, 1], plan[one, 2], plan[one, 3] & 0xFFFFFFFF)] if len(one) else []
        rows = []
        for lo, k in zip(edge[(size > 1) & (plan[edge, 3] >> 32 == number)], size[(size > 1) & (plan[edge, 3] >> 32 == number)]):
            chain = plan[lo : lo + k, 1:] & 0xFFFFFFFF
            t, r = int(unit.text_of(chain[:1, 0])[0]), int(there.text_of(chain[:1, 2])[0])
            x_at, y_at = max(int(unit.begin[t]), int(chain[0, 0]) - REACH), max(int(there.begin[r]), int(chain[0, 2]) - REACH)
            x_end = min(int(unit.begin[t] + unit.n[t]), int(chain[-1, 1]) + SEED + REACH)
            y_end = min(int(there.begin[r] + there.n[r]), int(chain[-1, 2] + chain[-1, 1] - chain[-1, 0]) + SEED + REACH)
            rows.append(align(chain, unit.words[x_at:x_end], x_at, there.get(np.arange(y_at, y_end)), y_at))
        if rows:
            found.append(tuple(np.array(c) for c in zip(*rows)))
        for a, b, c, d, share in found:
            ok = (b - a >= PART) & (share >= IDENTITY)
            r = there.text_of(c[ok])
            if len(r):
                yield a[ok], b[ok], there.ids[r], c[ok] - there.begin[r], d[ok] - there.begin[r], share[ok]


def _passages(unit: _Unit, a: np.ndarray, b: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alignments of passages that are long enough, by place, and the number of each one's passage in its text."""
    order = np.lexsort((*rest[1::-1], b, a))
    a, b, *rest = (x[order] for x in (a, b, *rest))
    # Texts are farther apart than JOIN.
    new = np.r_[True, a[1:] > np.maximum.accumulate(b)[:-1] + JOIN]
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    long = np.maximum.reduceat(b, first) - a[first] >= MIN_WORDS
    begins = number[np.searchsorted(a, unit.begin[unit.text_of(a)])]  # the number of a text's first group
    kept = long[number]
    return tuple(x[kept] for x in (a, b, *rest, number - begins))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, ref_id, ref_start, ref_end, identity, passage, digest of each alignment.

    passage numbers the text's passages; ref_id is an earlier document (in the order of the ids' hashes) that has the passage; a document
    that shares a passage with no earlier one appears as a ref_id alone. digest: MD5 of the text that the words are in.
    """
    return _found(docs, False)


def _found(docs: DataFrame, merged: bool) -> DataFrame:
    """The rows of find(), or with ``merged`` one of each passage (doc_id, start_word, end_word, digest)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, bits = int(size // UNIT) + 1, bucket_bits(int(size))
    h = F.xxhash64(F.col("doc_id").cast("long"))
    unit = F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * units, 32)  # ranges of the hash
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", h.alias("h"), unit.alias("unit"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(unit, _pack(own)) for unit, own in batch.groupby("unit")], columns=["unit", "pack"])

    def ask(own: pd.DataFrame) -> pd.DataFrame:
        unit = _Unit(own["pack"])
        unit.sort(bits)
        return pd.DataFrame(list(unit.questions()), columns=["bucket", "held"]).assign(unit=own.unit.iloc[0])

    def answer(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_answer(own)), columns=["unit", "held"]).assign(bucket=own.bucket.iloc[0])

    def plan(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """What the unit wants of others, and its chains, for itself (back: -1)."""
        unit, number = _Unit(own["pack"]), int(own.unit.iloc[0])
        made = _plan(unit, *unit.ties(number, bits, got.bucket, got.held))
        out = [(to, number, _message(np.diff(blocks, prepend=0).astype(np.uint32))) for to, blocks in _wanted(made)]
        out += [(number, -1, _packed(np.diff(made[:, 0], prepend=0), made[:, 1], made[:, 2] - made[:, 1], made[:, 3] >> 32, made[:, 3] & 0xFFFFFFFF))] * bool(len(made))
        return pd.DataFrame(out, columns=["unit", "back", "held"])

    def send(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """Blocks of words to the units that want them; the unit's own chains pass on."""
        out, number = [], -1
        if len(got):
            number, unit = int(got.unit.iloc[0]), _Unit(own["pack"])
            for back, raw in zip(got.back, got.held):
                out.append((number, -1, raw) if back < 0 else (back, number, _message(*_Held.sent(unit, np.cumsum(_read(raw)[0], dtype=np.int64)))))
        return pd.DataFrame(out, columns=["unit", "of", "held"])

    def finish(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out, chained = [], got.held[got.of < 0]
        if len(chained):
            unit = _Unit(own["pack"])
            chain, start, size, number, place = _unpacked(bytes(chained.iloc[0]), 5)
            made = np.stack([np.cumsum(chain), start, start + size, number << 32 | place], 1)
            held = {int(of): _Held(*_read(raw)) for of, raw in zip(got.of, got.held) if of >= 0}
            out = list(_aligned(unit, made, held))
        if not out:
            return pd.DataFrame([], columns=columns)
        a, b, ref, c, d, share, passage = _passages(unit, *(np.concatenate(x) for x in zip(*out)))
        if not len(a):
            return pd.DataFrame([], columns=columns)
        if merged:
            first = np.flatnonzero(np.r_[True, (np.diff(passage) != 0) | (np.diff(unit.text_of(a)) != 0)])
            a, b = a[first], np.maximum.reduceat(b, first)
        t = unit.text_of(a)
        digest = {i: hashlib.md5(unit.texts[i]).hexdigest() for i in np.unique(t)}
        made = {"doc_id": unit.ids[t], "start_word": a - unit.begin[t], "end_word": b - unit.begin[t], "digest": [digest[i] for i in t]}
        return pd.DataFrame(made if merged else {**made, "ref_id": ref, "ref_start": c, "ref_end": d, "identity": share, "passage": passage})[columns]

    columns = ["doc_id", "start_word", "end_word", *([] if merged else ["ref_id", "ref_start", "ref_end", "identity", "passage"]), "digest"]
    kinds = {"doc_id": "long", "ref_id": "long", "identity": "double", "digest": "string"}
    def one(f):
        """f of a group, and its memory given back."""

        def run(own: pd.DataFrame) -> pd.DataFrame:
            out = f(own)
            words.give_back()
            return out

        return run

    def two(f):
        def run(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            out = f(own, got)
            words.give_back()
            return out

        return run

    texts = rows.mapInPandas(pack, "unit long, pack binary").groupBy("unit")
    asked = texts.applyInPandas(one(ask), "bucket long, held binary, unit long")
    answered = asked.groupBy("bucket").applyInPandas(one(answer), "unit long, held binary, bucket long")
    planned = texts.cogroup(answered.groupBy("unit")).applyInPandas(two(plan), "unit long, back long, held binary")
    sent = texts.cogroup(planned.groupBy("unit")).applyInPandas(two(send), "unit long, of long, held binary")
    return texts.cogroup(sent.groupBy("unit")).applyInPandas(two(finish), ", ".join(f"{c} {kinds.get(c, 'int')}" for c in columns))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have lost their __spans; those of which no word is left go."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            out, stays = part.column("text").to_pylist(), [True] * part.num_rows
            for i, spans in enumerate(part.column("__spans").to_pylist()):
                if not spans:
                    continue
                raw = words.encoded([out[i]])[0]
                _, starts, ends, _ = words.spans([raw])
                keep, end = [], 0
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    lo, hi = int(starts[s["start_word"]]) - 1, int(ends[min(s["end_word"], len(ends)) - 1]) - 1
                    keep.append(raw[end : max(end, lo)])
                    end = max(end, hi)
                left = b"".join([*keep, raw[end:]])
                out[i], stays[i] = left.decode("utf-8", "surrogatepass"), len(words.spans([left])[1]) > 0
            names = [n for n in part.schema.names if n != "__spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else part.column(n) for n in names], names).filter(pa.array(stays))


def without(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the passages that earlier documents have; texts that lose all their words go.

    Texts are shuffled once more, to meet their passages.
    """
    spans = _found(docs, True).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")).checkpoint()
    safe, own = apart(docs, "doc_id", "text")  # columns may have any names
    known = safe.where("doc_id is not null").withColumn("__digest", F.md5(F.coalesce("text", F.lit(""))))
    met = known.join(spans, (F.col("doc_id") == F.col("__id")) & (F.col("__digest") == F.col("__of")), "left")
    out = met.select(*safe.columns, "__spans").mapInArrow(_cut, safe.schema).select(*own).unionByName(docs.where("doc_id is null"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
