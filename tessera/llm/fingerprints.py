"""Fingerprints of documents by Order MinHash: alike for texts a few edits apart.

A text's k-mers are its runs of K words, one from every word on (the last ones are
shorter); the copies of a k-mer are numbered in the order of the text. Hashes of
(k-mer, number) deal them into BINS bins of two halves, and each half selects its
least. The two of a bin are put back in the order of the text, and the tuple is hashed
to the bin's code. So moving words, repeating them or leaving them out changes codes,
also where sets of words stay the same.

Only DataFrame functions are used, and texts are exchanged once, by blocks of
neighbouring ids: a block's documents are sorted, and the first one of the next
block comes along as a guest, so each row finds its next document in its block. A
block has some BLOCK_DOCS documents; its limits are a sample of ids of at most
some MOST_BLOCKS. A text's k-mers live in one array of 8 bytes each: texts of up
to 2**30 words.

Nulls and ties: a null text is empty; null ids come first; rows that share an id
are in the order of their texts (an id's rows share a block). A text without words
has the fingerprint of empty bins only, and two such texts are alike (1). Equal
texts have equal fingerprints. A single document follows itself. An empty table
gives an empty result. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Words of a k-mer, and bins (a power of two).
K, BINS = 3, 64
#: Documents of a block, and the most blocks.
BLOCK_DOCS, MOST_BLOCKS = 200, 1 << 16
#: The code of a bin without k-mers; others are 4 hexadecimal digits.
EMPTY = "...."
_PLACE = 30  # bits of a packed number that hold a place in the text; the 33 above hold a hash
_LOW = (1 << _PLACE) - 1


def _packed(h: Column, place: Column) -> Column:
    """33 bits of h above a place, never negative."""
    return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(~_LOW & (2**63 - 1))).bitwiseOR(place)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _same(x: Column, y: Column, bits: int = _PLACE) -> Column:
    """Whether two packed numbers differ in their lowest bits only; null if one is missing."""
    return x.bitwiseXOR(y) < F.lit(1 << bits)


def _kmers(text: Column) -> Column:
    """The packed hash and place of each k-mer, in the order of the text."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    return let(words, lambda ws: F.transform(ws, lambda w, i: _packed(F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, K)]), i.cast("long"))))


def _numbered(kmers: Column) -> Column:
    """The packed hash of (k-mer, number) and place of each k-mer; a first copy keeps the k-mer's own hash.

    Sorted, the copies of a k-mer are neighbours. How many stand before one is found by
    doubling steps, from the widest down; few k-mers have any, so few need the steps.
    """

    def numbers(s: Column) -> Column:
        farther = lambda x, i: lambda seen, step: F.when(_same(F.get(s, i - seen - step), x), seen + step).otherwise(seen)
        numbered = lambda x, i, steps: _packed(F.xxhash64(x - _place(x), F.aggregate(steps, F.lit(0), farther(x, i))), _place(x))
        doubled = F.transform(F.sequence(F.floor(F.log2(F.size(s))).cast("int"), F.lit(0)), lambda e: F.call_function("shiftleft", F.lit(1), e))
        return let(doubled, lambda steps: F.transform(s, lambda x, i: F.when(_same(F.get(s, i - 1), x), numbered(x, i, steps)).otherwise(x)))

    return let(F.sort_array(kmers), numbers)


def fingerprint(text: Column) -> Column:
    """A string of BINS codes of four characters."""
    half, whole = 62 - int(math.log2(BINS)), 63 - int(math.log2(BINS))

    def of_least(least: Column) -> Column:  # the least of each half of each bin
        def code(x: Column, i: Column) -> Column:
            other, own = F.get(least, i + 1), lambda y: y - _place(y)
            pair = F.when(_place(x) < _place(other), F.xxhash64(own(x), own(other))).otherwise(F.xxhash64(own(other), own(x)))
            hashed = F.when(_same(other, x, whole), pair).otherwise(F.xxhash64(own(x)))
            again = _same(F.get(least, i - 1), x, whole)
            return F.when(again, F.lit(None)).otherwise(F.struct(F.shiftright(x, whole).cast("int").alias("bin"), F.lpad(F.hex(hashed.bitwiseAND(F.lit(65535))), 4, "0").alias("code")))

        filled = F.filter(F.transform(least, code), lambda c: c.isNotNull())
        slot = lambda codes, bins: lambda b: F.coalesce(F.get(codes, (F.array_position(bins, b) - 1).cast("int")), F.lit(EMPTY))
        slots = lambda codes, bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), slot(codes, bins))
        return let(filled, lambda own: let(own["code"], lambda codes: let(own["bin"], lambda bins: F.array_join(slots(codes, bins), ""))))

    least = let(F.sort_array(_numbered(_kmers(text))), lambda v: F.filter(v, lambda x, i: (i == 0) | ~_same(F.get(v, i - 1), x, half)))
    return let(least, of_least)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal codes among the bins that either fingerprint fills, from 0 to 1."""
    codes = lambda x: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(x, i * 4 + 1, F.lit(4)))
    pairs = F.filter(F.arrays_zip(codes(a).alias("a"), codes(b).alias("b")), lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    equal = lambda ps: F.size(F.filter(ps, lambda p: p["a"] == p["b"]))
    return let(pairs, lambda ps: F.when(F.size(ps) == 0, 1.0).otherwise(equal(ps) / F.size(ps)))


def _numbers(values: list[int]) -> Column:
    """Many numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _not_above(sorted_numbers: list[int], x: Column) -> Column:
    """How many of the numbers are not above x, by halving."""
    if not sorted_numbers:
        return F.lit(0)
    middle = lambda s: ((s["low"] + s["high"]) / 2).cast("int")

    def search(numbers: Column) -> Column:
        def half(s: Column, _: Column) -> Column:
            below = (s["low"] < s["high"]) & (F.get(numbers, middle(s)) <= x)
            low = F.when(below, middle(s) + 1).otherwise(s["low"])
            high = F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle(s))
            return F.struct(low.alias("low"), high.alias("high"))

        steps = F.sequence(F.lit(0), F.lit(len(sorted_numbers).bit_length()))
        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(sorted_numbers)).alias("high")), half, lambda s: s["low"])

    return let(_numbers(sorted_numbers), search)


def with_next(docs: DataFrame) -> DataFrame:
    """(block, key, doc_id, text, next_text, guest): each document with the text of the next one by ascending id, the first one after the last.

    Rows with ``guest`` set are the copies at the ends of blocks; they are needed by further
    windows over (block; guest, key, doc_id, text) and are to be dropped after those.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = rows.count()
    blocks = min(MOST_BLOCKS, max(1, n // BLOCK_DOCS))
    below = math.ceil(blocks / max(1, n) * (1 << 40))
    sampled = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(below)).select("key").distinct().limit(2 * blocks + 1000)
    cuts = sorted(r.key for r in sampled.collect()) if blocks > 1 else []  # limits of blocks, whatever the table's size
    rows = rows.withColumn("block", _not_above(cuts, F.col("key")))
    firsts = {r.block: r.key for r in rows.groupBy("block").agg(F.min("key").alias("key")).collect()}  # a row for each block
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    at = F.col("block")
    first = F.get(_numbers([firsts.get(b, 0) for b in range(len(cuts) + 1)]), at) == F.col("key")
    guest_of = F.get(_numbers([before.get(b, 0) for b in range(len(cuts) + 1)]), at).cast("int")
    spot = lambda block, guest: F.struct(block.alias("block"), F.lit(guest).alias("guest"))
    dealt = rows.withColumn("spot", F.explode(F.when(first, F.array(spot(at, False), spot(guest_of, True))).otherwise(F.array(spot(at, False)))))
    dealt = dealt.select("spot.block", "spot.guest", "key", "doc_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("block").orderBy("guest", "key", F.col("doc_id").asc_nulls_first(), "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the
    first as many (or all) of the next document's.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("quarter")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("quarter")))
    rows = rows.withColumn("edited", edited)
    made = rows.select(
        "block", "guest", "key", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"),
        F.when(F.col("guest"), F.lit(None)).otherwise(fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    made = made.withColumn("next_fingerprint", F.lead("fingerprint").over(_order())).where(~F.col("guest"))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
