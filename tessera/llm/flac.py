"""FLAC streams in a binary column: 8-bit mono PCM in, PCM blocks out.

The writer picks, frame by frame, the predictor that takes the fewest bits: one of
the five fixed ones or a linear one, fitted to the frame by its autocorrelations and
quantised to 8 bits; and a Rice parameter. It adds a seek table with the sample and
byte offset of every frame. The reader decodes many frames side by side: a step of numpy
finds where one code of each ends, residuals are made in blocks, and a step predicts one
sample of each. It verifies both checksums of every frame and the digest of all
samples. It writes blocks of PCM with the offset of their first sample; with a range of
samples it reads the frames of the range alone.

Nulls: a null text or payload counts as an empty one, and a null stream as one of no
samples. Payloads of any length are coded in frames of BLOCK samples; equal payloads
give equal streams. A stream without samples gives one empty block. Damaged streams
raise ValueError. Columns of the input with the names of outputs are replaced. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import give_back
from tessera.session import stored

#: Samples in a frame, frames in a block of PCM, and bytes that are written, coded and read at a time.
BLOCK, FRAMES, WRITTEN, STRIDE, READ = 2048, 32, 1 << 18, 1 << 18, 1 << 20
#: Coefficients of a linear predictor; bytes that a checksum takes in at a time.
ORDER, SPAN = 4, 4096
#: Samples of a frame whose residuals are made at once.
ROWS = 128
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
_U = np.uint64
#: Bytes of the other sign bit.
_SIGNED = bytes(b ^ 0x80 for b in range(256))


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        x = b << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.uint8)


def _crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of buf[start : start + size]: of 8 bits, for short headers, all at once; of 16 bits frame by frame."""
    if bits == 16:
        return np.array([_crc16(buf[a : a + n]) for a, n in zip(start.tolist(), size.tolist())], np.uint16)
    crc = np.zeros(len(start), np.uint16)
    for i in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > i)
        crc[own] = table[crc[own] ^ buf[start[own] + i]]
    return crc


@cache
def _far() -> np.ndarray:
    """What a byte with SPAN - 1, ..., 1, 0 bytes behind it adds to a checksum of 16 bits: 256 values for each distance."""
    out = np.empty((SPAN, 256), np.uint16)
    out[-1] = _CRC16
    for i in range(SPAN - 1, 0, -1):
        out[i - 1] = (out[i] << 8) ^ _CRC16[out[i] >> 8]
    return out.ravel()


_PLACE = np.arange(SPAN) << 8


def _crc16(frame: np.ndarray) -> int:
    """The sum of what each byte adds."""
    far, crc = _far(), 0
    for at in range(0, len(frame), SPAN):
        part = frame[at : at + SPAN]
        first = SPAN - len(part)
        sum_ = int(np.bitwise_xor.reduce(far.take(_PLACE[first:] + part)))
        if crc:  # what came before goes into the next two bytes
            sum_ ^= int(far[(first << 8) + (crc >> 8)]) ^ (int(far[(first + 1 << 8) + (crc & 0xFF)]) if len(part) > 1 else (crc & 0xFF) << 8)
        crc = sum_
    return crc


def _fitted(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear predictors from the autocorrelations of frames, by Levinson's recursion: coefficients of 8 bits and their shifts."""
    error, a = r[:, 0] * (1 + 1e-6) + 1e-3, np.zeros((len(r), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = error * np.maximum(1 - k * k, 1e-6)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(np.floor(np.log2(127 / most)), 0, 15).astype(np.int32)
    return np.clip(np.round(a * np.exp2(shift)[:, None]), -127, 127).astype(np.int32), shift


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes are samples (less 128).

    Payloads are coded in strides of at most STRIDE bytes, several short ones in one.
    """
    parts = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), STRIDE)]
    coded: list[list[bytes]] = [[] for _ in payloads]
    lengths: list[list[np.ndarray]] = [[] for _ in payloads]
    for some in _batches([range(min(STRIDE, len(payloads[i]) - at)) for i, at in parts], STRIDE):
        own = parts[some]
        for (i, _), (stream, length) in zip(own, _coded([payloads[i][at : at + STRIDE] for i, at in own], [at // BLOCK for _, at in own])):
            coded[i].append(stream)
            lengths[i].append(length)
    out = []
    for p, streams, of in zip(payloads, coded, lengths):
        length = np.concatenate(of) if of else np.zeros(0, np.int64)
        rate = 8000 << 44 | 0 << 41 | 7 << 36 | len(p)
        digest = hashlib.md5()
        for at in range(0, len(p), STRIDE):
            digest.update((np.frombuffer(p, np.uint8, min(STRIDE, len(p) - at), at) ^ 0x80).tobytes())
        info = BLOCK.to_bytes(2, "big") * 2 + int(length.min(initial=1 << 23)).to_bytes(3, "big") + int(length.max(initial=0)).to_bytes(3, "big") + rate.to_bytes(8, "big") + digest.digest()
        points = np.zeros(len(length), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"] = np.arange(len(length)) * BLOCK
        points["offset"], points["n"] = np.cumsum(length) - length, np.minimum(BLOCK, len(p) - np.arange(len(length)) * BLOCK)
        seek = points.tobytes()
        out.append(b"".join((b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *streams)))
        streams.clear()
    return out


def _coded(payloads: Sequence[bytes], firsts: Sequence[int]) -> list[tuple[bytes, np.ndarray]]:
    """The frames of each payload, numbered from its first on, and their lengths."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    number = within + np.array(firsts, np.int64)[owner]
    n = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
    if not len(owner):
        return [(b"", np.zeros(0, np.int64)) for _ in payloads]
    # Frames in a row, with ORDER zeros before each and ORDER + 1 at the end.
    gap = b"\x80" * ORDER
    raw = b"".join(part for p in payloads for at in range(0, len(p), BLOCK) for part in (gap, p[at : at + BLOCK])) + gap + b"\x80"
    x = (np.frombuffer(raw, np.uint8) ^ 0x80).view(np.int8).astype(np.int16)
    last = np.cumsum(n + ORDER)
    first = last - n
    edges = np.stack([first, last], 1).ravel()
    sums = lambda v: np.add.reduceat(v, edges, dtype=np.int64)[::2]
    wider = x.astype(np.int32)
    coefs, shift = _fitted(np.stack([sums(wider[: len(x) - j] * wider[j:]) for j in range(ORDER + 1)], 1).astype(float))
    # The predictor with the fewest bits, among those shorter than the frame.
    best, least, cost = np.zeros(len(owner), int), np.full(len(owner), np.inf), np.zeros(len(owner))
    folded, r = [], x
    for t in range(len(FIXED) + 1):
        own = t if t < len(FIXED) else ORDER
        if t == len(FIXED):
            guess, real, scaled = np.zeros(len(x), np.float32), x.astype(np.float32), (coefs / np.exp2(shift)[:, None]).astype(np.float32)
            for a, b, c in zip(first.tolist(), last.tolist(), scaled):
                guess[a:b] = np.convolve(real[a - ORDER : b - 1], c, "valid")  # exact: 17 bits
            r = (x - np.floor(guess).astype(np.int32)).astype(np.int16)
        elif t:
            r = np.diff(r, prepend=np.int16(0))
        folded.append(((r << 1) ^ (r >> 15)).view(np.uint16))
        sum_, left = sums(folded[t]), np.maximum(n - own, 1)
        for j in range(own):
            sum_ -= folded[t][first + j]
        sum_ = np.maximum(sum_, 0)  # frames of at most ``own`` samples take no part
        k = np.clip(np.floor(np.log2(np.maximum(sum_ / left * 0.7, 1))), 1, 12)
        bits = np.where(n > own, sum_ / np.exp2(k) + (k + 1) * left + 8 * own + (9 + 8 * ORDER if t == len(FIXED) else 0), np.inf)
        if t == len(FIXED):  # residuals of more than 16 bits aren't written
            bits[np.abs(coefs).sum(1) << 7 >> shift > 32_000] = np.inf
        better = bits < least
        least[better], best[better], cost[better] = bits[better], t, sum_[better]
    linear = best == len(FIXED)
    order = np.where(linear, ORDER, best)
    count = n - order
    edges_of = np.cumsum(count) - count
    u = np.concatenate([folded[t][a:b] for t, a, b in zip(best.tolist(), (first + order).tolist(), last.tolist())])
    k = np.clip(np.floor(np.log2(np.maximum(cost / count * 0.7, 1))).astype(int), 1, 12)
    bits = lambda k: np.add.reduceat(u >> np.repeat(k.astype(np.uint16), count), edges_of, dtype=np.int64) + (k + 1) * count
    now, next_ = bits(k), bits(k + 1)
    k, code_bits = np.where(next_ < now, k + 1, k), np.minimum(now, next_)
    linear_bits = np.where(linear, 9 + 8 * ORDER, 0)  # 4 + 5 + coefficients of 8 bits
    body_bits = 8 + 8 * order + linear_bits + 10 + code_bits
    short = n != BLOCK
    wide = 1 + (number >= 128) + (number >= 2048) + (number >= 65536)
    head = 4 + wide + 2 * short + 1
    body = -(-body_bits // 8)
    length = head + body + 2
    begin = np.cumsum(length) - length
    buf = np.zeros(int(length.sum()) + 8, np.uint8)
    buf[begin], buf[begin + 1] = 0xFF, 0xF8
    buf[begin + 2] = np.where(short, 7, BLOCK.bit_length() - 1) << 4 | 4  # BLOCK is a power of two from 256 on
    buf[begin + 3] = 1 << 1
    for w in range(1, 5):
        m = wide == w
        at, v = begin[m] + 4, number[m]
        if w == 1:
            buf[at] = v
            continue
        buf[at] = (0xF00 >> w & 0xFF) | v >> 6 * (w - 1)
        for j in range(1, w):
            buf[at + j] = 0x80 | (v >> 6 * (w - 1 - j) & 0x3F)
    at = (begin + 4 + wide)[short]
    buf[at], buf[at + 1] = (n[short] - 1) >> 8, (n[short] - 1) & 0xFF
    buf[begin + head - 1] = _crc(buf, begin, head - 1, _CRC8, 8)
    at = begin + head
    buf[at] = np.where(linear, 32 + ORDER - 1, 8 + best) << 1
    for j in range(int(order.max(initial=0))):
        m = order > j
        buf[at[m] + 1 + j] = x[first[m] + j].astype(np.uint8)
    at = at + 1 + order
    # A fitted predictor's fields of 4, 5 and 8 bits; then method 0, one partition, its parameter.
    field = 7 << 5 | shift.astype(np.int64)
    for j in range(ORDER):
        field = field << 8 | (coefs[:, j] & 0xFF)
    field = np.where(linear, field << 10 | k, k).astype(_U) << np.where(linear, 64 - 19 - 8 * ORDER, 54).astype(_U)
    wide_k = np.repeat(k + 1, count)
    step = (u >> (wide_k - 1).astype(np.uint16)) + wide_k
    ends = np.cumsum(step)
    ends += np.repeat(at * 8 + linear_bits + 10 - ends[edges_of] + step[edges_of], count)
    stop = _U(1) << (wide_k - 1).astype(_U)
    value = u & (stop - _U(1)) | stop

    # Each code goes into the word of 64 bits in which it begins, and what is left of it into the next one.
    word, over = ends - wide_k >> 6, (ends - wide_k & 63) + wide_k - 64
    held = value << np.maximum(-over, 0).astype(_U) >> np.maximum(over, 0).astype(_U)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    packed = np.zeros(len(buf) // 8 + 2, _U)
    packed[word[starts]] = np.bitwise_or.reduceat(held, starts)
    split = np.flatnonzero(over > 0)
    packed[word[split] + 1] |= value[split] << (64 - over[split]).astype(_U)
    buf |= packed.astype(">u8").view(np.uint8)[: len(buf)]
    for j in range(8):
        buf[at + j] |= (field >> _U(56 - 8 * j) & _U(0xFF)).astype(np.uint8)
    crc = _crc(buf, begin, head + body, _CRC16, 16)
    buf[begin + head + body], buf[begin + head + body + 1] = crc >> 8, crc & 0xFF
    edge = np.r_[0, np.cumsum(frames)]
    return [(buf[begin[a] : begin[b - 1] + length[b - 1]].tobytes(), length[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def _parse(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, digest, seek points and the first frame's offset."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, digest, points = 4, False, None, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            fields = int.from_bytes(body[10:18], "big")
            if fields >> 41 & 7 or (fields >> 36 & 31) != 7:
                raise ValueError("only mono streams of 8 bits are read")
            total, digest = fields & (1 << 36) - 1, body[18:34]
        if kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        at += 4 + size
    if total is None or points is None or points["n"].astype(np.int64).sum() != total:
        raise ValueError("the stream has no seek point for every frame")
    return total, digest, points, at


def decode(streams: Sequence[bytes], first: int = 0, count: int | None = None) -> list[bytes]:
    """Samples (plus 128) of each stream, or those from ``first`` on, ``count`` at most.

    Only frames that hold such samples are read; the digest is verified if all are.
    """
    starts, numbers, sizes, spans, digests, kept, needed, base = [], [], [], [], [], [], [], 0
    for s in streams:
        total, digest, points, at = _parse(s)
        end = total if count is None else min(total, first + count)
        begin, n = points["sample"].astype(np.int64), points["n"].astype(np.int64)
        use = np.flatnonzero((begin < end) & (begin + n > first))
        edge = np.r_[points["offset"].astype(np.int64), len(s) - at]
        if (np.diff(edge) < 8).any() or edge[0] != 0 or (n < 1).any():
            raise ValueError("the seek table doesn't fit the stream")
        lo, hi = (int(edge[use[0]]), int(edge[use[-1] + 1])) if len(use) else (0, 0)
        needed.append(s[at + lo : at + hi])
        starts.append(base - lo + edge[use])
        spans.append(edge[use + 1] - edge[use])
        numbers.append(use)
        sizes.append(n[use])
        skip = first - begin[use[0]] if len(use) else 0
        kept.append((len(use), skip, max(0, end - first)))
        digests.append(digest if len(use) == len(points) else None)
        base += hi - lo
    buf = np.frombuffer(b"".join(needed) + bytes(16), np.uint8)
    start, span, number, n = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, spans, numbers, sizes))
    x = _frames(buf, start, span, number, n) if len(start) else np.zeros((0, BLOCK), np.int8)
    pcm = x.view(np.uint8)
    out, at = [], 0
    for (m, skip, take), digest in zip(kept, digests):
        flat = b"".join([row[:size].tobytes() for row, size in zip(pcm[at : at + m], n[at : at + m].tolist())])
        if digest is not None and hashlib.md5(flat).digest() != digest:
            raise ValueError("the samples differ from the stream's digest")
        out.append(flat[skip : skip + take].translate(_SIGNED))
        at += m
    return out


def _frames(buf: np.ndarray, start: np.ndarray, span: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(-n, kind="stable")  # then the frames with a sample left are the first ones
    start, span, number, n = start[order], span[order], number[order], n[order]
    wide = 1 + (number >= 128) + (number >= 2048) + (number >= 65536)
    code = buf[start + 2] >> 4
    head = 4 + wide + np.select([code == 6, code == 7], [1, 2], 0) + 1
    if ((buf[start] != 0xFF) | (buf[start + 1] != 0xF8)).any():
        raise ValueError("a frame does not begin where the seek table says")
    if (_crc(buf, start, head - 1, _CRC8, 8) != buf[start + head - 1]).any():
        raise ValueError("a frame header's checksum is wrong")
    end = start + span - 2
    if (_crc(buf, start, span - 2, _CRC16, 16) != (buf[end].astype(np.uint16) << 8 | buf[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    window = np.r_[buf, np.zeros(8, np.uint8)].astype(_U)  # the 64 bits from each byte on
    for j in (1, 2, 4):
        window = window[:-j] << _U(8 * j) | window[j:]

    def read(at: np.ndarray, bits) -> np.ndarray:
        return (window[at >> 3] << (at & 7).astype(_U) >> _U(1)) >> (_U(63) - np.asarray(bits).astype(_U))

    x = np.zeros((len(n), int(n.max())), np.int8)
    kind = buf[start + head] >> 1
    bit = (start + head + 1) * 8
    if (buf[start + head] & 1).any():
        raise ValueError("wasted bits are not read")
    for f in np.flatnonzero(kind == 0):
        x[f, : n[f]] = buf[start[f] + head[f] + 1].astype(np.int8)
    for f in np.flatnonzero(kind == 1):
        x[f, : n[f]] = buf[start[f] + head[f] + 1 :][: n[f]].astype(np.int8)
    if (~((kind < 2) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))).any():
        raise ValueError("an unknown kind of subframe")
    live = np.flatnonzero(kind >= 2)
    if not len(live):
        return x[np.argsort(order)]
    y, m, bit, kind = np.zeros((len(live), 32), np.int32), n[live], bit[live], kind[live]
    warm = np.where(kind >= 32, kind - 31, kind - 8).astype(np.int64)
    for i in range(int(warm.max())):
        w = warm > i
        y[w, i] = read(bit[w] + 8 * i, 8).astype(np.uint8).astype(np.int8)
    bit = bit + 8 * warm
    coef, shift = np.zeros((len(live), max(1, int(warm.max()))), np.int32), np.zeros(len(live), np.int32)
    for t in range(1, min(len(FIXED), coef.shape[1] + 1)):
        coef[kind == 8 + t, :t] = FIXED[t]
    f = np.flatnonzero(kind >= 32)
    size, start = read(bit[f], 4).astype(np.int64) + 1, bit[f] + 9
    shift[f] = read(bit[f] + 4, 5)
    for j in range(int(warm[f].max(initial=0))):
        own = np.flatnonzero(warm[f] > j)
        v = read(start[own] + j * size[own], size[own]).astype(np.int64)
        coef[f[own], j] = v - (v >> (size[own] - 1) << size[own])
    bit[f] += 9 + size * warm[f]
    long = read(bit, 2).astype(np.int64)  # parameters of 4 or 5 bits
    part = m >> read(bit + 2, 4).astype(np.int64)
    bit = bit + 6
    # When each frame reads a parameter: at its first residual, then where partitions begin.
    turns: dict[int, list[int]] = {}
    for f, (w, p, e) in enumerate(zip(warm.tolist(), part.tolist(), m.tolist())):
        for i in {w, *range(p, e, p)}:
            turns.setdefault(i, []).append(f)
    steps, depth, least = x.shape[1], max(1, int(warm.max())), int(warm.max())
    alive = np.searchsorted(-m, -np.arange(steps), side="left").tolist()
    # Where each residual begins and its unary part ends: the next bit that is set, or nothing if it is raw.
    ones = np.flatnonzero(np.unpackbits(buf).view(bool)).astype(np.int32)
    set_ = np.repeat(ones, np.diff(ones, prepend=np.int32(-1)))
    at, end = np.zeros((steps + 1, len(live)), np.int64), np.zeros((steps, len(live)), np.int32)
    at[0] = bit
    k, raw, more, cuts = np.zeros(len(live), np.int64), np.zeros(len(live), bool), np.zeros(len(live), np.int32), []
    any_raw = False
    for i, c in enumerate(alive):
        here = at[i]
        if i in turns:
            t = np.array(turns[i])
            size = 4 + long[t]
            k[t] = read(here[t], size).astype(np.int64)
            here[t] += size
            raw[t] = k[t] == (1 << size) - 1
            t = t[raw[t]]
            k[t] = read(here[t], 5).astype(np.int64)
            here[t] += 5
            more, any_raw = (k + 1).astype(np.int32), raw.any()
        if i in turns or i % ROWS == 0:
            cuts.append((i, k.copy(), raw.copy()))
        np.take(set_, here[:c], out=end[i, :c], mode="clip")
        np.add(end[i, :c], more[:c], out=at[i + 1, :c])
        if i < least or any_raw:
            at[i + 1, :c] = np.where(warm[:c] > i, here[:c], np.where(raw[:c], here[:c] + k[:c], at[i + 1, :c]))
    # Residuals, in blocks of frames and samples; rows above the samples' hold zeros.
    z = np.zeros((depth + steps, len(live)), np.int32)
    for (i, k, raw), (j, *_) in zip(cuts, [*cuts[1:], (steps,)]):
        c = alive[i]
        begin, stop, kk = at[i:j, :c], end[i:j, :c].astype(np.int64), k[:c]
        low = (window[stop + 1 >> 3] << (stop + 1 & 7).astype(_U)) >> _U(1) >> (63 - kk).astype(_U)
        u = (stop - begin) << kk | low.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        if raw[:c].any():
            v = read(np.minimum(begin, 8 * len(buf) - 1), kk).astype(np.int64)
            v = np.where(kk == 0, 0, v - ((v >> np.maximum(kk - 1, 0) & 1) << kk))
            r = np.where(raw[:c], v, r)
        z[depth + i : depth + j, :c] = r
    # Samples: the coefficients stand in the order of the samples before.
    coef, shift = np.ascontiguousarray(coef.T[::-1]), shift.astype(np.int32)
    for i, c in enumerate(alive):
        sample = np.add.reduce(coef[:, :c] * z[i : i + depth, :c], 0, np.int32)
        sample >>= shift[:c]
        sample += z[depth + i, :c]
        z[depth + i, :c] = sample if i >= least else np.where(warm[:c] <= i, sample, y[:c, i])
    y = z[depth:].astype(np.int8).T
    x[live] = y
    return x[np.argsort(order)]


def _batches(items: Sequence, most: int) -> Iterator[slice]:
    at = 0
    while at < len(items):
        end, held = at, 0
        while end < len(items) and (end == at or held + len(items[end]) <= most):
            held += len(items[end])
            end += 1
        yield slice(at, end)
        at = end


_SILENCE = encode([b""])[0]


def padded(text: str | None) -> bytes:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def write_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Add the FLAC stream of each text's padded bytes, and n_bytes, the bytes without padding."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = list(batch)
            for part in _batches([range(len(t or "")) for t in texts], WRITTEN):
                yield pd.Series(encode([padded(t) for t in texts[part]]), dtype=object)
        give_back()

    return df.withColumns({to: F.pandas_udf(run, "binary")(text), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def pcm_blocks(df: DataFrame, media: str = "media", first: int = 0, count: int | None = None) -> DataFrame:
    """Each stream of df as rows of its other columns, first_sample, samples and pcm (unsigned bytes).

    A block holds up to FRAMES frames; blocks of a stream follow each other. With ``first``
    and ``count`` only that range of samples is read, by the seek table. Every checksum of what is read is verified.
    """
    made = [T.StructField("first_sample", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("pcm", T.BinaryType())]
    rest = [f for f in df.schema.fields if f.name != media and f.name.lower() not in ("first_sample", "samples", "pcm")]
    whole = BLOCK * FRAMES

    def decoded(streams: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Rows (stream, first sample, samples); a long stream is read by ranges."""
        if len(streams) > 1 or len(streams[0]) <= READ:
            yield [(i, first + at, p[at : at + whole]) for i, p in enumerate(decode(streams, first, count)) for at in range(0, max(1, len(p)), whole)]
            return
        total, digest, _, _ = _parse(streams[0])
        end, seen = total if count is None else min(total, first + count), hashlib.md5()
        for at in range(first, max(end, first + 1), 16 * whole):
            (p,) = decode(streams, at, min(16 * whole, end - at))
            seen.update((np.frombuffer(p, np.uint8) ^ 0x80).tobytes())
            yield [(0, at + i, p[i : i + whole]) for i in range(0, max(1, len(p)), whole)]
        if first == 0 and end == total and seen.digest() != digest:
            raise ValueError("the samples differ from the stream's digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(media)
            parts = _batches([range(n or 0) for n in pc.binary_length(held).to_pylist()], READ)
            for part, rows in ((part, rows) for part in parts for rows in decoded([m or _SILENCE for m in held[part].to_pylist()])):
                row, begin, pcm = zip(*rows)
                others = batch.slice(part.start, part.stop - part.start).select([f.name for f in rest]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array(begin, pa.int64()), pa.array([len(p) for p in pcm], pa.int64()), pa.array(pcm, pa.binary())], [*others.schema.names, *(f.name for f in made)])

    return df.select(*[f.name for f in rest], media).mapInArrow(run, T.StructType([*rest, *made]))


class Digest:
    """What the query says of a stream's samples, from its blocks one after another."""

    def __init__(self):
        self.sha, self.tail, self.n, self.sum, self.energy, self.peak, self.crossings, self.last = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-64:])[-64:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        if not len(x):
            return
        low = x < 0
        self.crossings += int(np.count_nonzero(low[1:] != low[:-1])) + int(self.last is not None and self.last != low[0])
        self.last, self.n, self.sum, self.energy, self.peak = bool(low[-1]), self.n + len(x), self.sum + int(x.sum()), self.energy + int((x * x).sum()), max(self.peak, int(np.abs(x).max()))

    def feature(self) -> str:
        """Frames, sum, energy, peak and zero crossings of the samples."""
        return f"frames={-(-self.n // BLOCK)};sum={self.sum};energy={self.energy};peak={self.peak};crossings={self.crossings}"


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as FLAC in a table in the shared checkpoint folder, read the stored bytes back as blocks of PCM, and describe both.

    The table holds streams, not samples; blocks of a stream go through the task that read it, in order.
    """
    media = stored(write_media(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "n_bytes", "media"), "media")
    described = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    names = ("doc_id", "n_bytes", "media_bytes", "media_sha256")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, out = Digest(), None, []

        def close() -> None:
            if of is not None:
                out.append((*of, held.n, held.sha.hexdigest(), zlib.crc32(held.tail), held.feature()))

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * len(kinds), kinds)], columns)
            out.clear()
            return made

        for batch in batches:
            for *own, first, pcm in zip(*(batch.column(c).to_pylist() for c in (*names, "first_sample", "pcm"))):
                if first == 0:
                    close()
                    held, of = Digest(), own
                held.add(pcm)
            yield rows()
        close()
        yield rows()

    columns = [*names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    out = pcm_blocks(described).mapInArrow(fold, schema)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
