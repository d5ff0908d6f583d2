"""Phrase collocations, mined from count streams in prefix and suffix order.

One pass counts words. A second one makes a stream of trigrams: one from every word of
a piece, with an end where the piece has no more words, so the counts of pairs and of
words are sums over their continuations. Tasks sort their blocks of the stream and add
up equal entries before anything is sent; a message holds the sorted entries that one
part of the stream gets from one block. A part merges its messages in prefix order:
runs of a first pair give the pair's count, and entries at or above LEAST go on, sorted.

What is left is joined by merging sorted streams: pairs with words by the first and by
the last word, trigrams with pairs by the first two words (prefix order: left counts,
extensions to the right) and by the last two (suffix order: right counts, extensions to
the left). Only candidates and frequent words are in those streams, and their words'
strings; a phrase's parts are as frequent as the phrase.

Words are known by 64-bit hashes of (lang, word); the table of words shows whether two
of them share one, and then all is done again with another seed, so counts are exact.

Hot phrases: a part of the stream is what hashes of the first two words send there. If
both words are frequent (MANY or more, or a 2**20th of all), the third one takes part in
the hash, and the pair's count is summed over parts.

Nulls: a null text is empty, a null lang is ``und``. Documents that repeat count again.
Ties in scores go by count, then by the phrase's bytes. Texts of any length are read in
strides; a word of STRIDE bytes or more is hashed by another function. An empty table
gives an empty result. Other columns take no part. Counts must be below 10**13.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.session import stored

#: The least count of a candidate, the share of it (in hundredths) that a longer one must have to drop it, and how many are returned of each lang.
LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes that are hashed at a time, words of a block, entries of a part of the stream, and the count that makes a word frequent.
STRIDE, BLOCK, PART, MANY = 1 << 18, 1 << 20, 1 << 19, 1 << 19
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_IS_BREAK, _IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_IS_GAP[list(_BREAKS + _SPACES)] = True
_GAP = re.compile(b"[.,;:!?\n\x0b\x0c\r \t]")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def strides(data: bytes) -> Iterator[bytes]:
    """data in pieces of some STRIDE bytes, cut before gaps; a longer word makes a longer piece."""
    at = 0
    while at < len(data):
        end = at + STRIDE
        if end < len(data):
            cut = max(data.rfind(bytes([b]), at + 1, end) for b in _BREAKS + _SPACES)
            if cut < 0:
                found = _GAP.search(data, end)
                cut = found.start() if found else len(data)
            end = cut
        yield data[at:end]
        at = end


class Hasher:
    """64-bit hashes of the words of one lang; never 0, which stands for an end."""

    def __init__(self, lang: str, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.odd = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
        digest = hashlib.blake2b(f"{seed}:{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.lang = np.uint64(int.from_bytes(digest, "little"))
        n = STRIDE + 2
        self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, self.odd, np.uint64)])
        self.inverses = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, pow(self.odd, -1, 2**64), np.uint64)])

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Hashes, starts and ends of the words of a stride, breaks before each, and breaks in all."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[True, _IS_GAP[raw], True]))
        starts, ends = edge[::2], edge[1::2]
        breaks = np.cumsum(_IS_BREAK[raw])
        if len(starts) == 1 and ends[0] - starts[0] >= STRIDE:
            h = np.array([int.from_bytes(hashlib.blake2b(data[starts[0] : ends[0]], digest_size=8).digest(), "little")], np.uint64)
        else:
            total = np.r_[np.uint64(0), np.cumsum(self.value[raw] * self.powers[: len(raw)])]
            h = (total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)
        h = words.mixed(words.mixed(h) ^ self.lang)
        h[h == 0] = 1
        return h, starts, ends, breaks[starts] if len(starts) else np.zeros(0, np.int64), int(breaks[-1]) if len(raw) else 0


def _by_lang(batch: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
    """All texts of a batch that share a lang as bytes in lower case, with breaks between them."""
    for lang, texts in batch.text.groupby(batch.lang):
        data = b"\n".join(words.encoded(texts)) + b"\n"
        yield lang, data.translate(bytes.maketrans(_UPPER, _LOWER))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, n) of every word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashers: dict[str, Hasher] = {}
        for batch in batches:
            for lang, data in _by_lang(batch):
                hasher = hashers[lang] = hashers.get(lang) or Hasher(lang, seed)
                for piece in _joined(strides(data)):
                    kept, starts, ends, held = [], [], [], 0
                    for part in piece:
                        h, s, e, _, _ = hasher.words(part)
                        kept.append(h)
                        starts.append(s + held)
                        ends.append(e + held)
                        held += len(part)
                    h, whole = np.concatenate(kept), b"".join(piece)
                    if not len(h):
                        continue
                    own, first, n = np.unique(h, return_index=True, return_counts=True)
                    s, e = np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist()
                    yield pd.DataFrame({"h": own.view(np.int64), "lang": lang, "word": [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(s, e)], "n": n})
        words.give_back()

    return texts.mapInPandas(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _joined(pieces: Iterator[bytes], most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Lists of pieces of some ``most`` bytes together."""
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sorted_entries(h: np.ndarray, piece: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places in words of the three of each entry, counts) of a block, in prefix order; the last two words begin entries only if the block is the last."""
    n = len(h)
    own, at = np.unique(np.r_[np.uint64(0), h], return_inverse=True)
    at = at[1:].astype(np.int64)
    key = at << 42
    same = piece[1:] == piece[:-1]
    key[:-1] |= np.where(same, at[1:], 0) << 21
    if n > 2:
        key[:-2] |= np.where(piece[2:] == piece[:-2], at[2:], 0)
    key = np.sort(key if last else key[: n - 2])
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, count = key[new], np.diff(np.r_[new, len(key)])
    mask = (1 << 21) - 1
    return own, np.stack([key >> 42, key >> 21 & mask, key & mask]).astype(np.int32), count


def _packed(own: np.ndarray, ids: np.ndarray, count: np.ndarray) -> bytes:
    """A message: its words, then the places of each entry's three in them, then counts."""
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(3, -1).astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
    head = np.array([len(used), ids.shape[1], at.itemsize], np.int64)
    # Sorted first words are long runs, so their steps pack best.
    at[0] = np.diff(at[0], prepend=at.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join((head.tobytes(), own[used].tobytes(), at.tobytes(), count.astype(np.uint32).tobytes())))


def _unpacked(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The three hashes of each entry, and counts."""
    raw = zstandard.ZstdDecompressor().decompress(message)
    n_words, n, width = np.frombuffer(raw, np.int64, 3).tolist()
    own = np.frombuffer(raw, np.uint64, n_words, 24)
    at = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, 3 * n, 24 + 8 * n_words).reshape(3, n).copy()
    at[0] = np.cumsum(at[0], dtype=at.dtype)
    return own[at], np.frombuffer(raw, np.uint32, n, len(raw) - 4 * n).astype(np.int64)


def messages(texts: DataFrame, seed: int, parts: int, frequent: np.ndarray) -> DataFrame:
    """(part, message): the sorted entries that each block of words has for each part of the stream."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def flush(h: np.ndarray, piece: np.ndarray, last: bool) -> pd.DataFrame:
        own, ids, count = _sorted_entries(h, piece, last)
        often = sent.value
        at = np.minimum(np.searchsorted(often, own), len(often) - 1) if len(often) else np.zeros(len(own), int)
        hot = (often[at] == own) & (own > 0) if len(often) else np.zeros(len(own), bool)
        one, two, three = own[ids]
        spread = np.where(hot[ids[0]] & hot[ids[1]], three, np.uint64(0))
        part = (words.mixed(words.mixed(one * np.uint64(31) + two) + spread) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        numbers, firsts = np.unique(part[order], return_index=True)
        rows = [_packed(own, ids[:, some], count[some]) for some in np.split(order, firsts[1:])]
        return pd.DataFrame({"part": numbers, "message": rows})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashers: dict[str, Hasher] = {}
        kept, pieces, held, seen = [], [], 0, 0
        for batch in batches:
            for lang, data in _by_lang(batch):
                hasher = hashers[lang] = hashers.get(lang) or Hasher(lang, seed)
                for part in strides(data):
                    h, _, _, breaks, n = hasher.words(part)
                    kept.append(h)
                    pieces.append(breaks + seen)
                    seen, held = seen + n, held + len(h)
                    if held >= BLOCK:
                        h, piece = np.concatenate(kept), np.concatenate(pieces)
                        yield flush(h, piece, False)
                        kept, pieces, held = [h[-2:]], [piece[-2:]], 2
        if held:
            yield flush(np.concatenate(kept), np.concatenate(pieces), True)
        words.give_back()

    return texts.mapInPandas(run, "part long, message binary")


def merged(parts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(one, two, three, n) of the pairs (three is 0) and trigrams that may have LEAST occurrences, in prefix order within parts."""
    sent = parts.sparkSession.sparkContext.broadcast(frequent)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        read = [_unpacked(m) for m in group.message]
        own, n = np.concatenate([r[0] for r in read], axis=1), np.concatenate([r[1] for r in read])
        order = np.lexsort(own[::-1])
        own, n = own[:, order], n[order]
        step = np.ones(own.shape[1], bool)
        step[1:] = (own[:, 1:] != own[:, :-1]).any(0)
        new = np.flatnonzero(step)
        own, n = own[:, new], np.add.reduceat(n, new)
        step = np.ones(own.shape[1], bool)
        step[1:] = (own[:2, 1:] != own[:2, :-1]).any(0)
        new = np.flatnonzero(step)
        pair, pair_n = own[:2, new], np.add.reduceat(n, new)
        often = lambda x: np.isin(x, sent.value)  # noqa: E731  # such pairs have counts in other parts
        some = (pair[1] > 0) & ((pair_n >= LEAST) | (often(pair[0]) & often(pair[1])))
        full = (own[2] > 0) & (n >= LEAST)
        rows = np.concatenate([np.vstack([pair[:, some], np.zeros((1, some.sum()), np.uint64)]), own[:, full]], axis=1)
        counts = np.r_[pair_n[some], n[full]]
        order = np.lexsort(rows[::-1])
        one, two, three = rows[:, order].view(np.int64)
        return pd.DataFrame({"one": one, "two": two, "three": three, "n": counts[order]})

    found = parts.groupBy("part").applyInPandas(merge, "one long, two long, three long, n long")
    return found.groupBy("one", "two", "three").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _score(left: str, right: str) -> Column:
    a, part = F.col("a").cast("decimal(13,0)"), lambda c: F.col(c).cast("decimal(13,0)")
    whole = F.lit(1_000_000).cast("decimal(7,0)") * a * a
    return F.call_function("div", whole, part(left) * part(right))


def candidates(pairs: DataFrame, trigrams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate that no longer one drops.

    pairs: (one, two, n); trigrams: (one, two, three, n); vocabulary: (h, lang, word, n).
    """
    word = lambda key, name: vocabulary.select(F.col("h").alias(key), F.col("word").alias(name), F.col("n").alias(f"{name}_n"), "lang").hint("merge")
    named = stored(pairs.join(word("one", "first"), "one").join(word("two", "second").drop("lang"), "two"), "collocation-pairs")
    prefix = named.select("one", "two", "lang", "first", "second", "first_n", F.col("n").alias("left_n")).hint("merge")
    suffix = named.select(F.col("one").alias("two"), F.col("two").alias("three"), F.col("second").alias("third"), F.col("second_n").alias("third_n"), F.col("n").alias("right_n")).hint("merge")
    longer = trigrams.join(prefix, ["one", "two"]).join(suffix, ["two", "three"])
    longer = longer.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), F.col("n").alias("a"), "first_n", "right_n", "left_n", "third_n")
    one, two = _score("first_n", "right_n"), _score("left_n", "third_n")
    cut = longer.withColumns({"s1": one, "s2": two}).withColumn("early", F.col("s1") <= F.col("s2"))
    pick = lambda x, y: F.when(F.col("early"), F.col(x)).otherwise(F.col(y))
    long = cut.select("lang", "phrase", "a", pick("first_n", "left_n").alias("l"), pick("right_n", "third_n").alias("r"), pick("s1", "s2").alias("score"))
    to_right = trigrams.groupBy("one", "two").agg(F.max("n").alias("right_most")).hint("merge")
    to_left = trigrams.groupBy(F.col("two").alias("one"), F.col("three").alias("two")).agg(F.max("n").alias("left_most")).hint("merge")
    extended = named.join(to_right, ["one", "two"], "left").join(to_left, ["one", "two"], "left")
    most = F.coalesce(F.greatest("right_most", "left_most"), F.lit(0))
    short = extended.where(100 * most < SHARE * F.col("n")).select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), F.col("n").alias("a"), F.col("first_n").alias("l"), F.col("second_n").alias("r"))
    return long.unionByName(short.withColumn("score", _score("l", "r")))


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """rows with their rank in their lang, the first ``top``; each of 64 shares of a lang is cut before they meet."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("lang", "share")).where(F.col("rank") <= top)
    return some.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= top).drop("share")


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each lang of docs (text, lang)."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    for seed in range(1, 9):
        vocabulary = stored(word_counts(texts, seed), "collocation-words")
        if not vocabulary.groupBy("h").count().where("count > 1").limit(1).count():
            break
    else:
        raise ArithmeticError("words share hashes under each of eight seeds")
    every = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    total = every.agg(F.sum("n")).first()[0] or 0
    # Words that are frequent: fewer than 2 ** 20 and than total / MANY, 8 bytes each.
    often = np.sort(np.array([r.h for r in vocabulary.where(F.col("n") >= max(MANY, total >> 20)).select("h").collect()], np.int64).view(np.uint64))
    parts = max(1, -(-total // PART))
    counts = stored(merged(messages(texts, seed, parts, often), often), "collocation-counts")
    pairs, trigrams = counts.where("three = 0").drop("three"), counts.where("three <> 0")
    found = first_of_each(candidates(pairs, trigrams, vocabulary.where(F.col("n") >= LEAST)), top)
    return found.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, unnest([1, 2, 3]) as k, ws, i from i),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, any_value(ws[i:i + k - 1]) as ws, count(*) as a from g where i + k - 1 <= len(ws) group by lang, k, phrase),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, ws, a, unnest(range(1, k)) as cut from f where k > 1 and a >= 10),
s as (select c.lang, c.phrase, c.ws, c.k, c.a, c.cut, x.a as l, y.a as r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score from c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:c.cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) as pick from s),
d as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a from f where k = 3 and a >= 10),
m as (select lang, phrase, max(a) as most from d group by lang, phrase),
t as (select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank from b left join m on m.lang = b.lang and m.phrase = b.phrase where pick = 1 and not coalesce(100 * m.most >= 50 * b.a, false))
select t.lang, rank, phrase, a, l, r, n, score from t join n on n.lang = t.lang where rank <= 2000"""
