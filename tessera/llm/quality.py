"""Regularised quadratic discriminant over transformed statistics of documents.

Each class has its own mean and covariance, shrunk towards the pooled one and
the diagonal. A score is the posterior of label 1: the difference of two
Mahalanobis log densities, from Cholesky factors that are computed once.

Nulls: a null text counts as an empty one; documents without a label take no
part in the fit; null labels are ignored. Empty texts and texts of any length
get a score. Repeated rows keep their places. If the labels hold fewer than two
classes, every score is the share of label 1 (0.5 without any label). An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.names import apart

NAMES = (
    "log_words", "distinct_share", "repeat_next", "top_share", "word_length", "symbol_share", "table_share", "digit_share",
    "upper_share", "stop_share", "line_repeat", "line_words", "odd_words", "beyond_ascii", "control_share", "pair_share",
)
#: Labels that kept() learns from at most (their ids are broadcast).
MOST_LABELS = 200_000
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 1  # symbols
_CLASS[[ord(c) for c in "|<>{}[]\\/_="]] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 6
_CLASS[128:] = 7
_CLASS[[*range(9), *range(14, 32), 127]] = 8


def statistics(texts) -> np.ndarray:
    """One row of transformed statistics (NAMES) for each text."""
    out, part, held = [np.zeros((0, len(NAMES)))], [], 0
    for text in texts:  # a little at a time, whatever the texts' lengths
        raw = words.encoded([text])[0]
        if part and held + len(raw) > words.STRIDE:
            out.append(_statistics(part))
            part, held = [], 0
        part.append(raw)
        held += len(raw)
    if part:
        out.append(_statistics(part))
    return np.concatenate(out)


def _statistics(raw: list[bytes]) -> np.ndarray:
    size = np.array([len(t) for t in raw])
    buf, starts, ends, n = words.spans(raw)
    h, _ = words.hashes(raw)
    kind = _CLASS[buf]
    first = np.cumsum([1, *(size + 1)])[:-1]

    def share(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first, dtype=np.int64) / np.maximum(size, 1)

    doc = np.repeat(np.arange(len(raw)), n)
    w = np.maximum(n, 1)

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag, len(raw)) / w

    def groups(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the most frequent one's count, of each text."""
        packed = np.sort(of.astype(np.uint64) << np.uint64(40) | key >> np.uint64(24))
        begin = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, int)
        owner = (packed[begin] >> np.uint64(40)).astype(int)
        most = np.zeros(len(raw))
        np.maximum.at(most, owner, np.diff(np.r_[begin, len(packed)]))
        return np.bincount(owner, minlength=len(raw)), most

    distinct, most = groups(h, doc)
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    pair = words.mixed(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h[:0]
    inside = doc[1:] == doc[:-1]
    pairs, _ = groups(pair[inside], doc[1:][inside])
    length = ends - starts
    last, alike = kind[ends - 1], kind[starts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
    count = np.maximum([len(x) for x in lines], 1)
    unique = np.array([len(set(x)) for x in lines])
    stop = np.isin(buf, np.frombuffer(b".!?", np.uint8))
    cols = [
        np.log1p(n),
        np.log1p(distinct) - 0.85 * np.log1p(n),
        np.sqrt(per_word(same)),
        np.sqrt(most / w),
        np.log1p(per_word(length)),
        np.sqrt(share(kind == 1)),
        np.sqrt(share(kind == 2)),
        np.sqrt(share(kind == 3)),
        np.sqrt(share(kind == 4)),
        np.sqrt(share(stop)),
        np.sqrt(np.maximum(0, 1 - unique / count)),
        np.log1p(n / count),
        np.sqrt(per_word(np.isin(last, (1, 2)) | np.isin(alike, (1, 2)))),
        np.sqrt(share(kind == 7)),
        np.sqrt(share(kind == 8)),
        np.where(n > 1, np.sqrt(np.maximum(0, 1 - pairs / np.maximum(n - 1, 1))), 0),
    ]
    return np.stack(cols, 1)


def forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The solution z of factor z = y, by forward substitution in the lower triangle."""
    z = np.empty_like(y)
    for i in range(len(factor)):
        z[i] = (y[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances, and the prior's log odds."""

    mean: np.ndarray
    factor: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (forward(f, (x - m).T) ** 2).sum(0) - np.log(np.diag(f)).sum() for m, f in zip(self.mean, self.factor)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700, 700)))


def statistics_of(text: str) -> Column:
    """A text column's statistics (array of doubles)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(statistics(batch)))
        words.give_back()

    return F.pandas_udf(run, "array<double>")(text)


def fit(x: DataFrame, shrink: float = 0.15, ridge: float = 1e-3) -> Discriminant | None:
    """From rows of (x, label): Spark sums the moments, so all labelled rows count.

    The driver gets 2 x (k + 1)^2 sums of k statistics, whatever the input.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(NAMES) + 1
        total = np.zeros((2, k, k))
        for batch in batches:
            for label in (0, 1):
                if len(part := batch[batch.label == label]):
                    one = np.c_[np.ones(len(part)), np.stack(part.x.to_numpy())]
                    total[label] += one.T @ one
        label, i, j = np.indices(total.shape).reshape(3, -1)
        yield pd.DataFrame({"label": label, "i": i, "j": j, "v": total.ravel()})

    rows = x.select("label", "x").mapInPandas(moments, "label int, i int, j int, v double").groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(NAMES) + 1
    total = np.zeros((2, k, k))
    for r in rows:
        total[r.label, r.i, r.j] = r.v
    n = total[:, 0, 0]
    if n.min() < 2:
        return None
    mean = total[:, 0, 1:] / n[:, None]
    cov = total[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    floor = np.diag(np.diag(pooled) * ridge + 1e-6)
    # The fewer rows a class has, the more it leans on the pooled covariance.
    own = [shrink + (1 - shrink) * len(NAMES) / (len(NAMES) + m) for m in n]
    factor = np.stack([np.linalg.cholesky((1 - s) * c + s * pooled + floor) for s, c in zip(own, cov)])
    return Discriminant(mean, factor, float(np.log(n[1] / n[0])))


def known_labels(labels: DataFrame, learn: Column | None, label: str) -> DataFrame:
    """(doc_id, label) of the labels that count."""
    known = labels.where(F.col(label).isin(0, 1))
    return (known if learn is None else known.where(learn)).select("doc_id", F.col(label).cast("int").alias("label"))


def model_of(training: DataFrame) -> tuple[Discriminant | None, float]:
    """The model of rows (x, label), or None with the score that then holds for all."""
    model = fit(training)
    share = None if model else training.agg(F.avg("label")).first()[0]
    return model, 0.5 if share is None else float(share)


def scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality") -> DataFrame:
    """doc_id and score for every document; ``learn`` says which rows of labels count.

    The statistics (128 bytes a document) are written to the shared checkpoint
    folder, so that the texts are read once; texts are never shuffled.
    """
    x = docs.select("doc_id", statistics_of("text").alias("x")).checkpoint()
    model, share = model_of(x.join(known_labels(labels, learn, label), "doc_id"))
    if model is None:
        return x.select("doc_id", F.lit(share).alias("score"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack(batch.to_numpy())) if len(batch) else np.zeros(0))

    return x.select("doc_id", F.pandas_udf(run, "double")("x").alias("score"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.3, learn: Column | None = None, label: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that score ``least`` or more, with all their columns.

    Columns may have any names. The model is fitted first, on about ``most`` labels at most, chosen by hash and
    broadcast: so only labelled texts are measured for it. Each text is then scored
    where it lies, and no text is shuffled.
    """
    safe, own = apart(docs, "doc_id", "text")
    known = known_labels(labels, learn, label)
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))
    training = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(statistics_of("text").alias("x"), "label")
    model, share = model_of(training)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(statistics(batch)) if len(batch) else np.zeros(0))
        words.give_back()

    score = F.lit(share) if model is None else F.pandas_udf(run, "double")("text")
    return safe.withColumn("__score", score).where(F.col("__score") >= least).select(*own)


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
