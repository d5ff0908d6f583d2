"""Byte-pair encoding and decoding with a given vocabulary file.

A short word's pairs stand in a list of ranks, and the least is sought again and
again. A longer word's symbols form a doubly linked list; a priority queue holds the
ranks of the pairs that may merge. An entry whose symbols have meanwhile been merged
is stale and is skipped. Pieces between white space are encoded when they are first
met. Decoding joins the vocabulary strings of a text's ids.

Nulls: a null text counts as an empty one and gives no ids. Empty texts give no
ids and an empty decoded text. Long texts are encoded whole; rows repeat as they
are. Columns of the input with the names of outputs are replaced.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words

#: Distinct pieces of text (and as many words) whose encodings a Python worker keeps, in each of two generations.
CACHE = 240_000
#: Symbols of a word from which on a queue is faster than a list.
LONG = 64
#: The rank of a pair that doesn't merge.
NEVER = 1 << 60
#: Rows whose results a task holds, and the columns that encode() adds.
SLICE, NEW = 128, ("ids", "n_tokens", "decoded")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(plain))
    return [chr(c) for _, c in sorted([(b, b) for b in plain] + [(b, 256 + i) for i, b in enumerate(other)])]


class Kept(dict):
    """Encodings, made when first asked for; two generations, so that frequent keys outlive rare ones."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        x = self.old.get(key)
        if x is None:
            x = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = x
        return x


class Codec:
    """A vocabulary: merges, ids, special tokens, and the encodings of the pieces seen last."""

    def __init__(self, text: str, most: int = CACHE):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("only byte-level BPE files without an unknown token are read")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.ids
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.names = [named.get(i, "") for i in range(max(named) + 1)]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        characters = byte_characters()
        self.first = [ids[c] for c in characters]
        self.last = {ids[c]: ids[c + self.suffix] for c in characters}
        # The rank of each pair of bytes within a word.
        self.pairs = [[self.ranks.get(a << 32 | b, NEVER) for b in self.first] for a in self.first]
        self.shortest = min(map(len, self.special), default=1 << 60)
        self.alone = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.white = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.odd = "\x1c\x1d\x1e\x1f"  # white space to str.split() alone
        self.words, self.pieces = Kept(self.packed, most), Kept(self.piece, most)

    def word(self, word: str) -> list[int]:
        """Ids of one word, by the merge of least rank again and again, the leftmost first."""
        raw = word.encode()
        ids = [*map(self.first.__getitem__, raw)]
        ids[-1] = self.last[ids[-1]]
        if len(ids) > LONG:
            return self.long(ids)
        if len(ids) == 1:
            return ids
        rank_of, made = self.ranks.get, self.made
        now = [of[b] for of, b in zip(map(self.pairs.__getitem__, raw), raw[1:])]
        now[-1] = rank_of(ids[-2] << 32 | ids[-1], NEVER)
        while now and (least := min(now)) < NEVER:
            i = now.index(least)
            new = ids[i] = made[least]
            del ids[i + 1], now[i]
            if i < len(now):
                now[i] = rank_of(new << 32 | ids[i + 1], NEVER)
            if i:
                now[i - 1] = rank_of(ids[i - 1] << 32 | new, NEVER)
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same of a word's first symbols, in n log n steps."""
        n, rank_of, made = len(ids), self.ranks.get, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # The rank of the pair that begins at each symbol now: an entry of another rank is stale.
        now = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        now.append(-1)
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            if now[i] != entry >> 32:
                continue
            j = after[i]
            new = ids[i] = made[entry >> 32]
            ids[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank_of(new << 32 | ids[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of(ids[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def packed(self, word: str) -> bytes:
        ids = self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, piece: str) -> bytes:
        """The ids of a piece without white space or special tokens."""
        # Lower case is by character: a capital sigma never becomes a final one.
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.split.findall(piece.lower())))

    def piece(self, piece: str) -> bytes:
        if len(piece) < self.shortest or not any(s in piece for s in self.special):
            return self.plain(piece)
        found, at = [], 0
        for m in self.alone.finditer(piece):
            found += [self.plain(piece[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*found, self.plain(piece[at:])])

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the ids decoded again."""
        if not text:
            return b"", ""
        pieces = self.white.split(text) if any(c in text for c in self.odd) else text.split()
        ids = b"".join(map(self.pieces.__getitem__, pieces))
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids; without a decoder in the file a blank stands between them."""
        return " ".join(map(self.names.__getitem__, ids))


@contextmanager
def _codec(text: str, pieces: int) -> Iterator[Codec]:
    """A task's codec. Workers live on after their tasks, so what it keeps is given back at the end."""
    codec = Codec(text, pieces)
    try:
        yield codec
    finally:
        for kept in (codec.words, codec.pieces):
            kept.clear()
            kept.old = {}
        del kept, codec
        words.give_back()


def encode(df: DataFrame, vocabulary: str, text: str = "text", decoded: bool = True, pieces: int = CACHE, digest: bool = False) -> DataFrame:
    """Add ``ids`` (binary, 32-bit little-endian), ``n_tokens`` and, if asked for, ``decoded`` (or its SHA-256) to every row.

    vocabulary: path of the file on the driver; its content (a few MB, whatever the
    corpus) is broadcast, so executors need no copy. A few rows are held at a time, and
    the encodings of ``pieces`` distinct pieces twice; fewer take more time, not less care.
    """
    content = _broadcast(df, vocabulary)
    rows = df.drop("ids", "decoded", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(content.value, pieces) as codec:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    found = [codec.encode(t.as_py()) for t in part.column(text)]
                    made = [pa.array([x[0] for x in found], pa.binary()), pa.array([len(x[0]) // 4 for x in found], pa.int64())]
                    made += [pa.array([hashlib.sha256(x[1].encode()).hexdigest() if digest else x[1] for x in found], pa.string())] * decoded
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *NEW[: len(made)]])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(NEW, (T.BinaryType(), T.LongType(), T.StringType()))][: 2 + decoded]])
    return rows.mapInArrow(run, schema)


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every document, and give both results as SHA-256."""
    content = _broadcast(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(content.value, CACHE) as codec:
            for batch in batches:
                out = []
                for text in batch.column("text"):
                    ids, decoded = codec.encode(text.as_py())
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                n, ids, decoded = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _broadcast(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
