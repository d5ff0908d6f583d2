"""Join of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Texts that are equal form a class and take part once. Bands of MinHash values
bring texts together; a pair's values are then compared a few at a time, and it is
dropped when the posterior probability of reaching the similarity falls below
TOLERANCE (Bayesian pruning; the prior is uniform). What survives only says which
texts belong together in a bunch: within each bunch all pairs are compared again,
pruned alike, and verified exactly on the shingles, which are hashed once for a
text. No pair is written as a row: tasks count links and write trees. Bunches and
buckets of n texts, more than WHOLE, are split into parts of some 4 sqrt(n); each
pair of parts is a task's group, and groups are dealt to tasks in turn. So a text
is sent sqrt(n) / 4 times, and no task's share grows faster than that.

A pair of similarity 0.8 meets in one of 24 bands of 5 values with a probability
of 0.99993, one of 0.85 with 0.999998.

Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z in lower case. A
text of fewer than five words has one shingle: all its words; texts without words
are linked to none, but share a class if equal. A null text counts as an empty
one. Null ids take no part and get no row. A row that repeats is a copy of itself
and gets one row. An id with several texts ties their classes together; its links
are those of its texts added up, its text_id and copies the least and the largest.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.graphs import components, small_components
from tessera.llm.names import apart

#: Bands, values in a band, values compared at a time.
BANDS, ROWS, STEP = 24, 5, 24
SIMILARITY, TOLERANCE = 0.8, 1e-4
#: Texts of a bunch that is compared whole, of a part of a larger one at least, and pairs that a task holds at a time.
WHOLE, LEAST, PAIRS = 256, 64, 200_000
SHINGLE = 5
_U = np.uint64
_FACTORS = np.random.default_rng(77).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, n = words.hashes(words.encoded(texts))
    s, k = words.shingles(h, n, SHINGLE)
    ends, start, out = np.cumsum(k), np.cumsum(n) - n, []
    for i, (end, size) in enumerate(zip(ends, k)):
        if size or not n[i]:
            out.append(np.unique(s[end - size : end]))
        else:
            own = h[start[i] : start[i] + n[i]]
            out.append(words.mixed(np.array([len(own)], _U) + np.bitwise_xor.reduce(own * (np.arange(len(own), dtype=_U) * _U(2) + _U(1)), keepdims=True)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash value (all 0 for an empty set)."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        start = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for j, f in enumerate(_FACTORS):
            out[full, j] = words.mixed(np.minimum.reduceat(every * f, start)) >> _U(48)
    return out


def least_matches() -> list[int]:
    """For STEP, 2 STEP, ... values: the fewest matches with which a pair stays."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # With m of n matches the posterior of J is Beta(m + 1, n - m + 1); its tail is a binomial sum.
        tail = lambda m, n=n: sum(math.comb(n + 1, j) * SIMILARITY**j * (1 - SIMILARITY) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= TOLERANCE))
    return out


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay, comparing STEP values at a time."""
    matches = np.zeros(len(a), np.int16)
    for i, least in enumerate(least_matches()):
        part = sig[:, i * STEP : (i + 1) * STEP]
        matches = matches + (part[a] == part[b]).sum(1, dtype=np.int16)
        stay = matches >= least
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by group) within a group; of a group with two sides, those across."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = np.repeat(start, np.diff(np.r_[start, len(group)]))
    place = np.arange(len(group)) - first
    two = np.repeat(np.maximum.reduceat(side, start) != np.minimum.reduceat(side, start), np.diff(np.r_[start, len(group)]))
    cut = np.searchsorted(np.cumsum(place), np.arange(0, place.sum() + PAIRS, PAIRS))
    for lo, hi in zip(np.r_[0, cut[1:]], np.r_[cut[1:], len(group)]):
        n = place[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = np.repeat(first[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = ~two[a] | (side[a] != side[b])
        yield a[ok], b[ok]


def _runs(batches: Iterator[pd.DataFrame], most: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Whole groups, many at a time (some ``most`` bytes), from batches sorted by bunch, i, j."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            held.append(part)
            size += int(part[part.columns[-1]].str.len().sum()) + 400 * len(part)
            if size < most:
                continue
            rows = pd.concat(held, ignore_index=True)
            key = rows[["bunch", "i", "j"]].to_numpy()
            last = np.flatnonzero((key != key[-1]).any(1))
            if len(last):
                yield rows.iloc[: last[-1] + 1]
                rows = rows.iloc[last[-1] + 1 :]
            held, size = [rows], int(rows[rows.columns[-1]].str.len().sum()) + 400 * len(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_numbers(rows: pd.DataFrame) -> np.ndarray:
    key = rows[["bunch", "i", "j"]].to_numpy()
    return np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(1)])


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (bunch, id, ...) with i, j, side: each pair of a bunch's parts is a group, dealt to tasks in turn."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.greatest(F.lit(float(LEAST)), 4 * F.sqrt("n"))
    parts = F.when(F.col("n") <= WHOLE, 1).otherwise(F.ceil(F.col("n") / part)).cast("int")
    columns = [c for c in rows.columns if c not in ("bunch", "id")]
    rows = rows.join(sizes.select("bunch", parts.alias("parts")), "bunch")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("if(parts = 1, array(0), sequence(0, parts - 1))"))).drop("parts")
    rows = rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    turn = F.pmod(F.xxhash64("bunch") % 1_000_003 + F.col("j") * (F.col("j") + 1) / 2 + F.col("i"), F.lit(tasks)).cast("int")
    return rows.select("bunch", "i", "j", "side", "id", *columns).repartitionById(tasks, turn).sortWithinPartitions("bunch", "i", "j", "id")


def _bunch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _runs(batches):
        sig = np.stack([np.frombuffer(s, np.uint16) for s in rows.sig])
        left, right = [], []
        for a, b in pairs(_group_numbers(rows), rows.side.to_numpy()):
            a, b = pruned(sig, a, b)
            left.append(a)
            right.append(b)
        root = small_components(len(rows), np.concatenate(left), np.concatenate(right))
        ids, joined = rows.id.to_numpy(), root != np.arange(len(rows))
        yield pd.DataFrame({"a": ids[joined], "b": ids[root[joined]]})
    words.give_back()


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each pair shares: by matrix products where pairs are dense."""
    own, at = np.unique(np.r_[a, b], return_inverse=True)
    if len(a) < 8 * len(own):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    every, column, n = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    shared = n > 1
    column, row = (np.cumsum(shared) - 1)[column][shared[column]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row, total = column[order], row[order], np.zeros((len(own), len(own)), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        part = slice(*np.searchsorted(column, (lo, lo + 2048)))
        m = np.zeros((len(own), 2048), np.float32)
        m[row[part], column[part] - lo] = 1
        total += m @ m.T
    at_a, at_b = at[: len(a)], at[len(a) :]
    return total[at_a, at_b].astype(np.int64)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their texts' shingles, a little at a time."""
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.iloc[at : at + 128]
            yield part.drop(columns="text").assign(shingles=[s.tobytes() for s in shingle_sets(part.text)])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _runs(batches):
        number, side, ids = _group_numbers(rows), rows.side.to_numpy(), rows.id.to_numpy()
        start = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(rows)]
        for lo, hi in zip(start[:-1], start[1:]):
            own = rows.iloc[lo:hi]
            sets = [np.frombuffer(s, _U) for s in own.shingles]
            size = np.array([len(s) for s in sets])
            sig = np.stack([np.frombuffer(s, np.uint16) for s in own.sig])
            links, left, right = np.zeros(hi - lo, np.int64), [], []
            for a, b in pairs(np.zeros(hi - lo, int), side[lo:hi]):
                a, b = pruned(sig, a, b)
                common = _common(sets, a, b) if len(a) else np.zeros(0, int)
                good = (5 * common >= 4 * (size[a] + size[b] - common)) & (common > 0)
                a, b = a[good], b[good]
                links += np.bincount(a, minlength=hi - lo) + np.bincount(b, minlength=hi - lo)
                left.append(a)
                right.append(b)
            root = small_components(hi - lo, np.concatenate(left), np.concatenate(right))
            some = links > 0
            yield pd.DataFrame({"a": ids[lo:hi][some], "b": ids[lo:hi][root[some]], "links": links[some]})
    words.give_back()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's digest), sig (binary), n: shingles of each document."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, at, size = [], 0, 0
            texts = list(batch)
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > words.STRIDE or i == len(texts) - 1:
                    sets = shingle_sets(texts[at : i + 1])
                    out += [(s.tobytes(), len(x)) for s, x in zip(signatures(sets), sets)]
                    at, size = i + 1, 0
            yield pd.DataFrame(out, columns=["sig", "n"])
        words.give_back()

    made = F.pandas_udf(run, "sig binary, n int")
    return _texts(docs).select("doc_id", _digest().alias("key"), made("text").alias("m")).select("doc_id", "key", "m.sig", "m.n")


def _digest() -> Column:
    return F.md5(F.encode("text", "UTF-8"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """The rows of join(), with the least digest of each id's texts as ``key``."""
    rows = describe(docs).checkpoint()
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    texts = texts.withColumn("id", F.monotonically_increasing_id()).checkpoint()  # numbers that hold once they are written
    nodes = texts.where("n > 0").select("id", "sig")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    bands = nodes.select("id", band.alias("bunch"))
    sizes = bands.groupBy("bunch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    members = bands.join(sizes.select("bunch"), "bunch", "left_semi").join(nodes, "id")
    edges = _dealt(members, sizes).mapInPandas(_bunch, "a long, b long").distinct()
    bunches = components(edges)
    sizes = bunches.groupBy(F.col("root").alias("bunch")).agg(F.count(F.lit(1)).alias("n"))
    inside = bunches.select("id", F.col("root").alias("bunch")).join(texts.select("id", "sig", F.col("least").alias("doc_id"), "key"), "id")
    whole = _texts(docs).withColumn("key", _digest()).join(inside, ["doc_id", "key"]).dropDuplicates(["id"])
    hashed = whole.select("bunch", "id", "sig", "text").mapInPandas(_hashed, "bunch long, id long, sig binary, shingles binary")
    found = _dealt(hashed, sizes).mapInPandas(_verify, "a long, b long, links long").checkpoint()
    # The texts of one id belong together.
    owned = rows.select("doc_id", "key").distinct().join(texts.select("key", "id"), "key").select("doc_id", "key", "id").checkpoint()
    several = owned.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b <> top")
    tied = owned.join(several, "doc_id").select(F.col("id").alias("a"), "b")
    roots = components(found.select("a", "b").unionByName(tied))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    known = texts.select("id", "least", "copies").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).checkpoint()
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    out = owned.join(known.join(least, "root"), "id").groupBy("doc_id")
    return out.agg(F.min("key").alias("key"), F.min("class_id").alias("class_id"), F.min("least").alias("text_id"), F.max("copies").alias("copies"), F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, text_id, copies, n_links of every document.

    text_id: the least id with the same text; copies: rows with that text; n_links:
    other texts of similarity 0.8 or more; class_id: the least id that links lead to.
    """
    return classes(docs).drop("key")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class: the one of the least id (of its texts, that of the least digest). Rows without an id stay."""
    kept = classes(docs).where("doc_id = class_id").select("doc_id", F.col("key").alias("__key"))
    safe, own = apart(docs, "doc_id", "text")  # columns may have any names
    known = safe.where("doc_id is not null").withColumn("__key", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    one = known.join(kept, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return one.select(*own).unionByName(docs.where("doc_id is null"))
