"""Centroid clustering of vectors by an incremental matrix of exact dot products.

Components become whole numbers, floor(SCALE * x). Beside each vector stands its dot
product with every centroid, in a table that is written anew each round; a round adds to
it only what the nonzero changes of each centroid's components bring, and takes the
least of |c|^2 - 2 x.c anew. Sums of clusters change by the vectors that moved, which
are all that the second pass of a round reads. Everything is exact: squared distances
and dot products stay under 2**62. The driver holds centroids, sums and counts only.

Each round's table is in the shared folder and the one before it is removed, so lost
executors cost no more than their tasks, and two tables at most exist.

Vectors take part if they have DIMS components, none null or non-finite or of 2**27 or
more in size once scaled (distances might not fit a long). The first centroids are the
vectors whose ids hash least; null ids come last, ties go by components. Fewer vectors
than centroids give fewer centroids. Rows that repeat count as often as they occur. An
inertia that doesn't fit a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import remove, with_checkpoints

#: Centroids, rounds, components of a vector, and what they are multiplied by.
CLUSTERS, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: Whole components are below this in size.
LARGEST = 1 << 27


def whole(df: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """df's sound vectors with x, their whole components."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))
    return df.where((F.size(vector) == dims) & sound).withColumn("x", scaled.cast("array<int>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, places, differences) of the centroids that have nonzero changes."""
    moved = ((c, np.flatnonzero(d), d) for c, d in enumerate(new - old))
    return [(c, at, d[at]) for c, at, d in moved if len(at)]


def assigned(vectors: DataFrame, steps: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> DataFrame:
    """(vec_id, x, dots, cluster, before, distance): dot products after the steps, and the nearest centroid."""
    norms, (k, dims) = (centroids * centroids).sum(1), centroids.shape

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, dots = _matrix(b["x"], dims).astype(np.int64), _matrix(b["dots"], k).copy()
            for c, at, by in steps:
                dots[:, c] += x[:, at] @ by
            reach = norms - 2 * dots
            near = reach.argmin(1)
            distance = (x * x).sum(1) + reach[np.arange(len(x)), near]
            rows = pa.ListArray.from_arrays(np.arange(0, k * len(x) + 1, k, dtype=np.int32), dots.ravel())
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["x"], rows, pa.array(near.astype(np.int32)), b["cluster"], pa.array(distance)], ["vec_id", "x", "dots", "cluster", "before", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(update, f"vec_id {kind}, x array<int>, dots array<long>, cluster int, before int, distance long")


def moved_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """How the sums and counts of the clusters change by the vectors that moved; a task sends at most k * (dims + 1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dims + 1), np.int64)  # the last row: vectors that were nowhere
        for b in batches:
            x = np.c_[_matrix(b["x"], dims), np.ones(b.num_rows)].astype(np.int64)
            np.add.at(total, b["cluster"].to_numpy(), x)
            np.subtract.at(total, b["before"].to_numpy(), x)
        c, d = np.nonzero(total[:k])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], ["cluster", "place", "n"])

    out = np.zeros((k, dims + 1), np.int64)
    moved = state.where("cluster <> before").select("x", "cluster", "before").mapInArrow(run, "cluster int, place int, n long")
    for r in moved.groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect():  # a row for each component of a centroid
        out[r.cluster, r.place] = r.n
    return out[:, :dims], out[:, dims]


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, vector_id: str = "vec_id", vector: str = "embedding", seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, before, distance) of every sound vector after the last round, and the centroids."""
    spark = df.sparkSession
    own = df.select(F.col(vector_id).alias("vec_id"), F.col(vector).alias("v"))
    vectors = whole(own, "v", dims, scale).select("vec_id", "x")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dims)
    k = len(centroids)
    state = vectors.withColumns({"dots": F.array_repeat(F.lit(0).cast("long"), k), "cluster": F.lit(-1)})
    if not k:
        return assigned(state, [], np.zeros((1, dims), np.int64)), centroids
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/centroids-{uuid.uuid4().hex}"
    steps = changes(np.zeros_like(centroids), centroids)
    sums, counts = np.zeros_like(centroids), np.zeros(k, np.int64)
    for turn in range(rounds + 1):
        assigned(state, steps, centroids).write.option("compression", "zstd").parquet(f"{folder}/{turn}")
        state = spark.read.parquet(f"{folder}/{turn}")
        if turn:
            remove(spark, f"{folder}/{turn - 1}")
        if turn == rounds:
            break
        more, n = moved_sums(state, k, dims)
        sums, counts = sums + more, counts + n
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        steps, centroids = changes(centroids, new), new
        if not steps:  # so the rounds that are left change nothing
            break
    return state, centroids


def _of_cluster(values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))


def report(df: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every sound vector."""
    state, centroids = cluster(df, **options)
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # a row for each centroid
    known = [own.get(c, 0) for c in range(len(centroids))]
    total = sum(known) if None not in known and sum(known) < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return state.select("vec_id", "cluster", "distance", _of_cluster(known).cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), _of_cluster(names).alias("centroid_sha256"))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 3) -> str:
    """SQL for report(): rounds one after another, every distance computed anew."""
    parts = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)) as x from embeddings "
        f"where len(embedding) = {dims} and len(list_filter(embedding, lambda e: abs(e::double) * {scale} < {LARGEST})) = {dims})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 as c, x from v order by sha256('{seed}:' || vec_id), x limit {k})",
    ]
    for i in range(rounds + 1):
        near = f"min(((list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::bigint) * {k} + c.c)"
        parts.append(f"a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(v.x) as x, ({near} % {k})::int as cluster, {near} // {k} as distance from v cross join c{i} c group by r)")
        if i < rounds:
            parts.append(f"u{i} as (select cluster, unnest(x) as e, unnest(range({dims})) as j from a{i})")
            parts.append(f"n{i} as (select cluster, j, sum(e)::bigint as s, count(*) as n from u{i} group by all)")
            parts.append(f"m{i} as (select cluster, list(((s - ((s % n) + n) % n) // n)::double order by j) as x from n{i} group by cluster)")
            parts.append(f"c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on m.cluster = c.c)")
    return (
        f"with {', '.join(parts)} select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, "
        f"sha256(array_to_string(list_transform(c.x, lambda e: e::bigint::varchar), ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.c = a.cluster"
    )
