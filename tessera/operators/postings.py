"""A stored inverted index: blocks of postings with bounds, searched block-max first, kept up by signed rows.

Documents are dealt by the hash of their key into buckets, each an index of its own, so a
query finds all its terms of a document in one task and a changed document touches one
bucket. A row is a block of at most BLOCK postings of a term: numbers of documents as
steps, counts and places as varints, and the greatest count and least length of its
documents, from which a bound of its BM25 follows whatever the corpus has become. One
more row of each bucket (the empty term) has its keys, in order, and their lengths.

A search reads the blocks of the queries' terms, found by a join of terms. In a bucket,
a query's bounds add up to a step function over its documents; steps are scored from the
highest on, and those below the k-th score so far are never decoded. Counts of texts
that hold a term are sums of blocks' counts; only prefixes of several terms and phrases
need their documents for that.

A pass deals the changed texts and the removed keys to their buckets, the only time that
they are shuffled. A bucket takes out what such documents had and puts in what they have
now, in arrays of numbers; one in which nothing differs is not written, and neither are
buckets that no key is dealt to: they stay the files that they are. ``signed`` tells the
same difference as rows of -1 and +1. A version is a table of buckets' folders with the
totals, put in place by one rename, so readers see the version before or the one after.
Old versions stay readable until ``vacuum``.

Null keys take no part, null texts are empty. Of rows that share a key the greatest text
counts. An empty table makes an index without buckets, which finds nothing.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.search import B, K1, Asked, _index_terms, blocks, rounded
from tessera.session import remove

#: Postings of a block, bytes of text in a bucket when an index is built, and numbers or bytes that are coded at a time.
BLOCK, BUCKET, STRIDE = 128, 1 << 25, 1 << 20
_COLUMNS = [("bucket", T.IntegerType()), ("term", T.StringType()), ("n", T.IntegerType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("most", T.IntegerType()), ("shortest", T.IntegerType()), ("docs", T.BinaryType()), ("counts", T.BinaryType()), ("places", T.BinaryType())]


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes of seven bits, the last of each without its top bit; and where each begins."""
    return _coded(x, np.arange(len(x)))


def _coded(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, with the begins of some numbers (sorted) alone."""
    parts, begins, so_far = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for lo in range(0, len(x), STRIDE):
        raw, begin = _varints(x[lo : lo + STRIDE])
        parts.append(raw)
        begins.append(begin[of[np.searchsorted(of, lo) : np.searchsorted(of, lo + STRIDE)] - lo] + so_far)
        so_far += len(raw)
    return np.concatenate(parts), np.concatenate(begins)


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.int64)
    size = 1 + sum((x >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        some = size > i
        out[begin[some] + i] = (x[some] >> 7 * i & 127) | np.where(size[some] > i + 1, 128, 0)
    return out, begin


def numbers(raw: bytes) -> np.ndarray:
    """What varints() wrote."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    begin = np.r_[0, ends[:-1] + 1]
    out = np.zeros(len(ends), np.int64)
    for i in range(int((ends - begin).max(initial=-1)) + 1):
        some = begin + i <= ends
        out[some] |= (b[begin[some] + i].astype(np.int64) & 127) << 7 * i
    return out


def _every(raws: Iterable[bytes]) -> np.ndarray:
    """The numbers (below 2**31) of many blocks in a row."""
    out, held, size = [], [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size >= STRIDE:
            out.append(numbers(b"".join(held)).astype(np.int32))
            held, size = [], 0
    return np.concatenate([*out, numbers(b"".join(held)).astype(np.int32)])


@dataclass
class Postings:
    """Sorted postings of a bucket: term, document, count, and all places in a row."""

    term: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    places: np.ndarray


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of neighbours; the first of each run stays."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[new] = x[new]
    return out


def _blocks(bucket: int, names: np.ndarray, p: Postings, keys: list, lengths: np.ndarray) -> pd.DataFrame:
    """The rows of a bucket; names are sorted and p is sorted by term and document."""
    run = np.flatnonzero(np.diff(p.term, prepend=-1))
    at = np.arange(len(p.term)) - np.repeat(run, np.diff(np.r_[run, len(p.term)]))
    first = np.flatnonzero(at % BLOCK == 0)
    last = np.r_[first[1:], len(p.term)][: len(first)] - 1
    new = np.zeros(len(p.term), bool)
    new[first] = True
    docs = _coded(_steps(p.doc, new), first)
    counts = _coded(p.count, first)
    begin = np.cumsum(p.count) - p.count
    own = np.zeros(len(p.places), bool)
    own[begin] = True
    places = _coded(_steps(p.places, own), begin[first] if len(first) else first)
    cut = lambda raw, at: [raw[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(raw)])]
    rows = {
        "bucket": bucket, "term": names[p.term[first]], "n": last - first + 1, "first": p.doc[first], "last": p.doc[last], "most": np.maximum.reduceat(p.count, first) if len(first) else p.count,
        "shortest": np.minimum.reduceat(lengths[p.doc], first) if len(first) else lengths[p.doc], "docs": cut(*docs), "counts": cut(*counts), "places": cut(*places),
    }
    out = pd.DataFrame(rows | {"keys": None, "lengths": None})
    directory = pd.DataFrame({"bucket": [bucket], "term": [""], "n": [len(keys)], "first": [0], "last": [0], "most": [0], "shortest": [0], "docs": [b""], "counts": [b""], "places": [b""], "keys": [keys], "lengths": [lengths.tolist()]})
    return pd.concat([directory, out], ignore_index=True).astype({"bucket": np.int32, "n": np.int32, "first": np.int32, "last": np.int32, "most": np.int32, "shortest": np.int32})


def _posted(texts: Iterable[str]) -> tuple[np.ndarray, Postings, np.ndarray]:
    """The sorted terms of texts, their postings (documents are numbered as they come) and their lengths."""
    known: dict[str, int] = {}
    said, lengths = array("i"), array("i")
    for t in texts:
        terms = _index_terms("", "", t)
        said.extend([known.setdefault(x, len(known)) for x in terms])
        lengths.append(len(terms))
    names = sorted(known)
    rank = np.empty(len(names), np.int32)
    rank[[known[x] for x in names]] = np.arange(len(names), dtype=np.int32)
    del known
    length = np.array(lengths, np.int64)
    term = rank[np.array(said, np.int32)]
    del said
    order = np.argsort(term, kind="stable").astype(np.int32)
    term, doc = term[order], np.repeat(np.arange(len(length), dtype=np.int32), length)[order]
    places = order - (np.cumsum(length) - length).astype(np.int32)[doc]
    at = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(doc) != 0)]) if len(term) else np.zeros(0, np.int64)
    return np.array(names, object), Postings(term[at], doc[at], np.diff(np.r_[at, len(term)]), places), length


def _some(p: Postings, chosen: np.ndarray) -> Postings:
    """Postings by their numbers, in that order."""
    count = p.count[chosen]
    shift = (np.cumsum(p.count) - p.count)[chosen] - (np.cumsum(count) - count)
    at = np.repeat(shift.astype(np.int32), count)
    at += np.arange(len(at), dtype=np.int32)
    return Postings(p.term[chosen], p.doc[chosen], count, p.places[at])


def _in_place(own: list, of: list) -> np.ndarray:
    """Where each of the first ones is among the others, or -1."""
    at = {x: i for i, x in enumerate(of)}
    return np.array([at.get(x, -1) for x in own], np.int32)


def _changed(bucket: int, rows: pd.DataFrame | None, latest: dict) -> pd.DataFrame:
    """A bucket's rows after documents' texts have changed (None: they are gone); no rows if it stays as it is."""
    fresh = sorted(k for k, t in latest.items() if t is not None)
    names, new, lengths = _posted(latest[k] for k in fresh)
    if rows is None or not len(rows):
        return _blocks(bucket, names, new, fresh, lengths) if fresh else _none()
    old_names, old, keys, old_lengths = _held(rows)
    out = np.array([k in latest for k in keys], bool)
    again = _in_place(keys, fresh)  # the number of a document's new text
    every = sorted({*old_names, *names})
    term_of, new_term_of = _in_place(list(old_names), every), _in_place(list(names), every)
    if not (out & (again < 0)).any() and out.sum() == len(fresh):
        was = _some(old, np.flatnonzero(out[old.doc]))
        same = (term_of[was.term], new_term_of[new.term]), (again[was.doc], new.doc), (was.count, new.count), (was.places, new.places)
        if all(np.array_equal(*x) for x in same):
            return _none()
    stays = np.flatnonzero(~out)
    known = [*(keys[i] for i in stays), *fresh]
    order = sorted(range(len(known)), key=known.__getitem__)
    number = np.empty(len(known), np.int32)
    number[order] = np.arange(len(known))
    old_number = np.full(len(keys), -1, np.int32)
    old_number[stays] = number[: len(stays)]
    old = _some(old, np.flatnonzero(~out[old.doc]))
    both = Postings(np.r_[term_of[old.term], new_term_of[new.term]], np.r_[old_number[old.doc], number[len(stays) :][new.doc]], np.r_[old.count, new.count], np.r_[old.places, new.places])
    both = _some(both, np.lexsort((both.doc, both.term)))
    return _blocks(bucket, np.array(every, object), both, [known[i] for i in order], np.r_[old_lengths[stays], lengths][order])


def _none() -> pd.DataFrame:
    return pd.DataFrame([], columns=[*(n for n, _ in _COLUMNS), "keys", "lengths"])


def _bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def postings_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, places, length) of each row's terms, and one with an empty term, which holds the length alone."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch.key, batch.text):
                terms = _index_terms("", "", t or "")
                places: dict[str, list[int]] = {"": []}
                for i, x in enumerate(terms):
                    places.setdefault(x, []).append(i)
                yield pd.DataFrame({"key": k, "term": list(places), "places": list(places.values()), "length": len(terms)})

    schema = T.StructType([T.StructField("key", kind), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType())])
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return own.mapInPandas(run, schema)


def _schema(kind: T.DataType) -> T.StructType:
    more = [("keys", T.ArrayType(kind)), ("lengths", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(n, t) for n, t in [*_COLUMNS, *more]])


@dataclass
class Index:
    """A version of an index: its folder, number, buckets in all, texts and their terms in all."""

    spark: SparkSession
    folder: str
    version: int
    buckets: int
    n: int
    length: int

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/versions/{self.version:09d}")

    def blocks(self, only: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets of ``only`` (bucket)."""
        known = self.manifest().where("bucket >= 0")
        known = known if only is None else known.join(only, "bucket", "left_semi")
        paths = [r.path for r in known.select("path").distinct().collect()]  # a folder for each pass that wrote buckets still in use
        if not paths:
            return self.spark.createDataFrame([], _schema(T.LongType()))
        rows = self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/{p}" for p in paths])
        return rows.withColumn("path", F.concat(F.lit("data/pass="), F.col("pass"))).join(F.broadcast(known.select("bucket", "path")), ["bucket", "path"], "left_semi").drop("path", "pass")


def _publish(spark: SparkSession, folder: str, version: int, manifest: DataFrame) -> None:
    """Put a manifest in place by one rename to a name that nobody reads yet, and that must be free."""
    made = f"{folder}/versions/.{uuid.uuid4().hex}"
    manifest.write.parquet(made)
    fs = spark._jvm.org.apache.hadoop.fs
    to = fs.Path(f"{folder}/versions/{version:09d}")
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(made), to, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise FileExistsError(f"version {version} of {folder} exists: another writer was first") from error


def _versions(spark: SparkSession, folder: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(int(name) for s in found if (name := s.getPath().getName()).isdigit())


def load(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    version = _versions(spark, folder)[-1] if version is None else version
    totals = spark.read.parquet(f"{folder}/versions/{version:09d}").where("bucket = -1").first()
    return Index(spark, folder, version, int(totals.path), totals.n, totals.length)


def vacuum(index: Index) -> None:
    """Remove versions before this one, and the passes that no later version needs."""
    spark, at = index.spark, index.spark._jvm.org.apache.hadoop.fs.Path
    later = [v for v in _versions(spark, index.folder) if v >= index.version]
    needed = {r.path for v in later for r in load(spark, index.folder, v).manifest().where("bucket >= 0").select("path").distinct().collect()}
    for v in _versions(spark, index.folder):
        if v < index.version:
            remove(spark, f"{index.folder}/versions/{v:09d}")
    data = at(f"{index.folder}/data")
    for s in data.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(data):
        if f"data/{s.getPath().getName()}" not in needed:
            remove(spark, f"{index.folder}/data/{s.getPath().getName()}")


def _write(index: Index, made: DataFrame) -> DataFrame:
    """Write rows, a bucket's in one task, in a folder of this pass; (bucket, path, n, length) of what is there now."""
    name = f"data/pass={uuid.uuid4().hex}"
    made.sortWithinPartitions("bucket", "term", "first").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{index.folder}/{name}")
    rows = index.spark.read.schema(made.schema).parquet(f"{index.folder}/{name}").where("term = ''")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("bucket", F.lit(name).alias("path"), F.col("n").cast("long").alias("n"), total.alias("length"))


def build(rows: DataFrame, key: str, text: str, folder: str, buckets: int | None = None) -> Index:
    """Index rows in a new folder; the number of buckets follows from the bytes of text and stays."""
    spark = rows.sparkSession
    buckets = buckets or max(1, -(-(rows.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET))
    index = Index(spark, folder, 0, buckets, 0, 0)
    empty = spark.createDataFrame([], T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n", T.LongType()), T.StructField("length", T.LongType())]))
    _publish(spark, folder, 0, empty.unionByName(_totals(index)))
    return update(index, rows, key, text)


def _totals(index: Index) -> DataFrame:
    """The manifest's row of totals."""
    return index.spark.createDataFrame([(-1, str(index.buckets), index.n, index.length)], "bucket int, path string, n long, length long")


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums (below 2**31) that begin anew with each run of so many steps."""
    edge, out = np.r_[0, np.cumsum(sizes)], np.empty(len(steps), np.int32)
    cuts = np.unique(np.r_[np.searchsorted(edge, np.arange(0, len(steps), STRIDE)), len(sizes)])
    for lo, hi in zip(cuts, cuts[1:]):
        own, begin = steps[edge[lo] : edge[hi]], edge[lo:hi] - edge[lo]
        total = np.cumsum(own, dtype=np.int64)
        out[edge[lo] : edge[hi]] = total - np.repeat(total[begin] - own[begin], sizes[lo:hi])
    return out


def _held(rows: pd.DataFrame) -> tuple[np.ndarray, Postings, list, np.ndarray]:
    """The sorted terms of a bucket's rows, their postings, the keys and the lengths; all blocks are read in one go."""
    directory, own = rows[rows.term == ""].iloc[0], rows[rows.term != ""].sort_values(["term", "first"], kind="stable")
    term, names = pd.factorize(own.term.to_numpy(object))
    n = own.n.to_numpy(np.int64)
    doc, count = _sums(_every(own.docs), n), _every(own.counts)
    places = _sums(_every(own.places), count)
    return names, Postings(np.repeat(term.astype(np.int32), n), doc, count, places), list(directory["keys"]), np.asarray(directory.lengths, np.int64)


def _decoded(rows: pd.DataFrame, only: set) -> pd.DataFrame:
    """(key, term, places) of the postings of some keys."""
    names, p, keys, _ = _held(rows)
    p = _some(p, np.flatnonzero(np.array([k in only for k in keys], bool)[p.doc]))
    held = np.split(p.places, np.cumsum(p.count)[:-1]) if len(p.count) else []
    return pd.DataFrame({"key": pd.Series([keys[i] for i in p.doc], dtype=object), "term": names[p.term], "places": pd.Series(held, dtype=object)}, dtype=object)


def signed(index: Index, changed: DataFrame, key: str, text: str, gone: DataFrame | None = None) -> DataFrame:
    """(bucket, key, term, places, length, sign): what the index loses (-1) and gains (+1) by changed rows and gone keys (key).

    Terms of a changed text that stand where they stood cancel out. The empty term's rows change the lengths.
    """
    latest = changed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(text, F.lit(""))).alias("text"))
    new = postings_of(latest, "key", "text").withColumn("sign", F.lit(1))
    keys = latest.select("key")
    keys = keys if gone is None else keys.unionByName(gone.select(F.col(key).alias("key")).where("key is not null")).distinct()
    asked = keys.withColumn("bucket", _bucket_of("key", index.buckets))
    kind, old_schema = changed.schema[key].dataType, new.schema

    def old(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame([], columns=old_schema.names)
        lengths = dict(zip(rows["keys"][rows.term == ""].iloc[0], rows.lengths[rows.term == ""].iloc[0]))
        keys = {k for k in wanted.key if k in lengths}
        if not keys:
            return pd.DataFrame([], columns=old_schema.names)
        found = _decoded(rows, keys)
        out = pd.concat([found, pd.DataFrame({"key": sorted(keys), "term": "", "places": [[] for _ in keys]})], ignore_index=True)
        return out.assign(length=out.key.map(lengths), sign=-1)

    had = index.blocks(asked.select("bucket").distinct())
    if had.schema["keys"].dataType != T.ArrayType(kind):
        had = index.spark.createDataFrame([], _schema(kind))
    lost = had.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(old, old_schema)
    both = lost.unionByName(new).groupBy("key", "term", "places", "length").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
    return both.withColumn("bucket", _bucket_of("key", index.buckets))


def update(index: Index, changed: DataFrame, key: str, text: str, gone: DataFrame | None = None) -> Index:
    """The next version of the index; only buckets in which something differs are written."""
    spark, kind = index.spark, changed.schema[key].dataType
    dealt = changed.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    if gone is not None:
        dealt = dealt.unionByName(gone.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.lit(None).cast("string").alias("text")))
    dealt = dealt.withColumn("bucket", _bucket_of("key", index.buckets))
    schema = _schema(kind)

    def apply(rows: pd.DataFrame | None, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _none()
        latest: dict = {}
        for k, t in zip(own.key, own.text):
            if isinstance(t, str) and (latest.get(k) is None or t > latest[k]):
                latest[k] = t
            latest.setdefault(k, None)
        return _changed(int(own.bucket.iloc[0]), rows, latest)

    if index.version:
        had = index.blocks(dealt.select("bucket").distinct())
        if had.schema["keys"].dataType != T.ArrayType(kind):
            had = spark.createDataFrame([], schema)
        made = had.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(apply, schema)
    else:
        made = dealt.groupBy("bucket").applyInPandas(lambda own: apply(None, own), schema)
    written = _write(index, made)
    now = index.manifest().where("bucket >= 0").join(written.select("bucket"), "bucket", "left_anti").unionByName(written.where("n > 0"))
    total = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    after = Index(spark, index.folder, index.version + 1, index.buckets, total.n, total.length)
    _publish(spark, index.folder, after.version, now.unionByName(_totals(after)))
    return after


def frequencies(index: Index) -> DataFrame:
    """(term, df) of the whole index, from the blocks' counts alone."""
    return index.blocks().where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))


class _Bucket:
    """A bucket's blocks of the queries' terms, in the order of terms; each is decoded when it is first needed, many in one go."""

    def __init__(self, rows: pd.DataFrame, q: Asked):
        directory = rows[rows.term == ""].iloc[0]
        self.keys, self.lengths = directory["keys"], np.asarray(directory.lengths, float)
        own = rows[rows.term != ""].sort_values(["term", "first"], kind="stable")
        self.docs, self.counts, self.places = (own[c].to_numpy(object) for c in ("docs", "counts", "places"))
        term = own.term.to_numpy(object)
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
        self.names, self.edge, self.q = term[at], np.r_[at, len(term)], q
        self.first, self.last, self.n = (own[c].to_numpy(np.int64) for c in ("first", "last", "n"))
        self.most, self.shortest = (own[c].to_numpy(float) for c in ("most", "shortest"))
        self.at = np.r_[0, np.cumsum(self.n)]
        self.doc, self.count = np.zeros(self.at[-1], np.int32), np.zeros(self.at[-1], np.int32)
        self.held, self.used = np.zeros(len(term), bool), np.zeros(len(term), bool)  # used: by the query at hand

    def terms(self, part: str, prefix: bool) -> tuple[int, int]:
        """The first and the next after the last of the terms in a row."""
        lo = int(np.searchsorted(self.names, part))
        if prefix:
            return lo, int(np.searchsorted(self.names, part + "\U0010ffff"))
        return lo, lo + int(lo < len(self.names) and self.names[lo] == part)

    def parts(self, word: str) -> list[tuple[str, bool]]:
        """A token's terms in a row; only the last of a phrase is a prefix."""
        parts = self.q.phrases.get(word)
        return [(word, self.q.prefix)] if parts is None else [(p, i == len(parts) - 1) for i, p in enumerate(parts)]

    def blocks(self, part: tuple[str, bool]) -> slice:
        lo, hi = self.terms(*part)
        return slice(int(self.edge[lo]), int(self.edge[hi]))

    def read(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of some blocks (sorted), in a row."""
        self.used[chosen] = True
        new = chosen[~self.held[chosen]]
        if len(new):
            n = self.n[new]
            to = np.repeat(self.at[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.doc[to], self.count[to] = _sums(_every(self.docs[new]), n), _every(self.counts[new])
            self.held[new] = True
        if len(chosen) and chosen[-1] - chosen[0] + 1 == len(chosen):
            own = slice(self.at[chosen[0]], self.at[chosen[-1] + 1])
        else:
            n = self.n[chosen]
            own = np.repeat(self.at[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.doc[own], self.count[own]

    def bounding(self, word: str) -> slice:
        """The blocks whose bounds bound the token: all of its terms', or a phrase's first term's."""
        return self.blocks(self.parts(word)[0])

    def found(self, word: str, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold a token, and how often; with ``some``, of blocks that reach one of those documents (running counts of a mask)."""
        parts = self.parts(word)
        if len(parts) > 1:
            return self._phrase(parts)
        own = self.bounding(word)
        chosen = np.arange(own.start, own.stop)
        if some is not None:
            chosen = chosen[some[self.last[own] + 1] > some[self.first[own]]]
        doc, count = self.read(chosen)
        lo, hi = self.terms(*parts[0])
        if hi - lo > 1:
            sums = np.bincount(doc, count, len(self.keys))
            doc = np.flatnonzero(sums)
            count = sums[doc].astype(np.int64)
        return doc, count

    def _phrase(self, parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        begins = None  # document and place where the phrase begins
        for i, part in enumerate(parts):
            own = self.blocks(part)
            doc, count = self.read(np.arange(own.start, own.stop))
            places = _sums(_every(self.places[own]), count)
            at = (np.repeat(doc.astype(np.int64), count) << 32 | places) - i
            begins = at if begins is None else np.intersect1d(begins, at)
        doc, count = np.unique(begins >> 32, return_counts=True)
        return doc, count

    def df(self, word: str) -> int:
        parts = self.parts(word)
        lo, hi = self.terms(*parts[0])
        if len(parts) == 1 and hi - lo <= 1:
            return int(self.n[self.blocks(parts[0])].sum())
        return len(self.found(word)[0])


def _saturated(count, length, mean: float):
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


def _best(bucket: _Bucket, words: list[str], idf: dict[str, float], mean: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a query and their scores, decoding blocks by falling bounds."""
    n = len(bucket.keys)
    rise = np.zeros(n + 1)
    for w in words:
        own = bucket.bounding(w)
        if own.stop > own.start:
            bound = idf[w] * _saturated(bucket.most[own], bucket.shortest[own], mean)
            rise += np.bincount(bucket.first[own], bound, n + 1)
            rise -= np.bincount(bucket.last[own] + 1, bound, n + 1)
    edge = np.flatnonzero(rise[:n])
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0)
    bound, size = np.cumsum(rise[edge]) + 1e-6, np.diff(np.r_[edge, n])
    order = np.argsort(-bound, kind="stable")
    docs, scores, least, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4 * k
    while at < len(order) and bound[order[at]] >= max(least, 2e-6):
        end, held = at, 0
        while end < len(order) and held < step and bound[order[end]] >= max(least, 2e-6):
            held += size[order[end]]
            end += 1
        some = np.zeros(n, bool)
        for s in order[at:end]:
            some[edge[s] : edge[s] + size[s]] = True
        score, so_far = np.zeros(n), np.r_[0, np.cumsum(some)]
        for w in words:
            doc, count = bucket.found(w, so_far)
            mine = some[doc]
            doc, count = doc[mine], count[mine]
            score[doc] += idf[w] * _saturated(count, bucket.lengths[doc], mean)
        new = np.flatnonzero(score > 0)
        docs, scores = np.r_[docs, new], np.r_[scores, rounded(score[new], 1e6) / 1e6]
        keep = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        least = scores[-1] if len(scores) == k else 0.0
        at, step = end, 4 * step  # few rounds, as each looks at all words again
    return docs, scores


def _wanted(index: Index, q: Asked) -> DataFrame:
    """The blocks of terms that a query's token is, begins, or has as a part; and the buckets' directories."""
    rows = index.blocks()
    if not q.phrases:
        rows = rows.withColumn("places", F.lit(None).cast("binary"))  # asked by phrases alone
    parts = [p for w in q.words for p in ([(w, q.prefix)] if w not in q.phrases else [(x, i == len(q.phrases[w]) - 1) for i, x in enumerate(q.phrases[w])])]
    exact, begins = sorted({p for p, prefix in parts if not prefix} | {""}), {p for p, prefix in parts if prefix}
    wanted = F.col("term").isin(exact)  # of one block of queries
    for n in sorted({len(x) for x in begins}):
        wanted = wanted | F.left("term", F.lit(n)).isin(sorted(x for x in begins if len(x) == n))
    return rows.where(wanted)


def _counting(q: Asked):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = _Bucket(rows, q)
        return pd.DataFrame([(i, n) for i, w in enumerate(q.words) if (n := bucket.df(w))], columns=["word", "n"])

    return count


def _scoring(q: Asked, idf: dict[str, float], mean: float, k: int, names: list[str]):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, out = _Bucket(rows, q), []
        for key, own in zip(q.keys, q.sets):
            bucket.used[:] = False
            out += [(key, bucket.keys[d], s, None, None) for d, s in zip(*_best(bucket, sorted(own), idf, mean, k))]
            own_blocks = np.zeros(len(bucket.used), bool)
            for w in own:
                for part in bucket.parts(w):
                    own_blocks[bucket.blocks(part)] = True
            out.append((key, None, None, int(bucket.used.sum()), int(own_blocks.sum())))
        return pd.DataFrame(out, columns=names)

    return best


def bm25(index: Index, queries: DataFrame, query_key: str, query_text: str, k: int, prefix: bool = True, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(query_key, key, score, rank): the k best keys of each query; and (query_key, read, held): blocks that it read of those that its terms have.

    Queries come in blocks of at most ``most``. The second table is of the last step's own work, without the counting of texts that hold a prefix.
    """
    spark = index.spark
    kind = index.blocks().schema["keys"].dataType.elementType
    asked_kind = queries.schema[query_key].dataType
    schema = T.StructType([T.StructField("query", asked_kind), T.StructField("key", kind), T.StructField("score", T.DoubleType()), T.StructField("read", T.LongType()), T.StructField("held", T.LongType())])
    every = spark.createDataFrame([], schema)
    for q in blocks(queries, query_key, query_text, most, prefix):
        found = _wanted(index, q)
        counted = {r.word: r.n for r in found.groupBy("bucket").applyInPandas(_counting(q), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the block's tokens
        idf = {w: max(1e-6, float(np.log((index.n - counted.get(i, 0) + 0.5) / (counted.get(i, 0) + 0.5)))) for i, w in enumerate(q.words)}
        every = every.unionByName(found.groupBy("bucket").applyInPandas(_scoring(q, idf, index.length / max(1, index.n), k, schema.names), schema))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    rows = every.where("read is null").withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query_key), "key", "score", "rank")
    work = every.where("read is not null").groupBy(F.col("query").alias(query_key)).agg(F.sum("read").alias("read"), F.sum("held").alias("held"))
    return rows, work
