"""Clustering around centroids, exact in integers, with partial distances.

Components are scaled to integers, so sums, means and distances are the same however the rows are
dealt. A round reads the vectors once: each task assigns its own and sends one sum for each cluster and
dimension, which are added by an exchange; only clusters x dimensions numbers reach the driver.

To assign, squared differences are added up along the dimensions of largest variance first. A centroid
is given up once its partial sum is strictly above the best full distance so far; those that stay go
through all dimensions, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeplan.llm.shared import attach, materialize

#: Scaled components beyond this have squared distances that are no longs.
LARGEST = 1 << 27
#: Dimensions added between two looks at which centroids are still in question.
STEP = 8


def scaled(vectors: DataFrame, id_col: str, column: str, dims: int, scale: int) -> DataFrame:
    """(id, c): vectors of exactly `dims` components, as little-endian 32-bit integers floor(scale * x).

    Null vectors, those of another length, and those with null, non-finite or too large (LARGEST) components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dims)
            x = lists.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(x * scale)
                good = (np.abs(v) <= LARGEST).all(axis=1)  # false for nulls, which are nan here, nan and infinities
            data = v[good].astype("<i4")
            starts = np.arange(len(data) + 1, dtype=np.int32) * (4 * dims)
            packed = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), packed], names=["id", "c"])

    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("v"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("c", T.BinaryType())]))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", "<i4")[starts[0] // 4 : starts[-1] // 4].reshape(-1, dims).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the nearest centroid, its squared distance, and how many squared differences were added in all.

    The first `step` dimensions of `order` are added for all centroids; the one with the least sum is completed first, as the others
    are then soon given up."""
    x, centroids = x[:, order], centroids[:, order]
    n, k, dims = len(x), len(centroids), x.shape[1]
    part = np.stack([((x[:, :step] - c[:step]) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = part.argmin(axis=1)
    best = part[np.arange(n), at] + ((x[:, step:] - centroids[at, step:]) ** 2).sum(axis=1)
    added, first = n * (k * min(step, dims) + max(0, dims - step)), at.copy()
    for c in range(k):
        alive = np.flatnonzero((first != c) & (part[:, c] <= best))
        d = part[alive, c]
        for lo in range(step, dims, step):
            if not len(alive):
                break
            d = d + ((x[alive, lo : lo + step] - centroids[c, lo : lo + step]) ** 2).sum(axis=1)
            added += len(alive) * (min(lo + step, dims) - lo)
            on = d <= best[alive]
            alive, d = alive[on], d[on]
        wins = (d < best[alive]) | (c < at[alive])  # equal or less by now
        at[alive[wins]], best[alive[wins]] = c, d[wins]
    return at, best, added


def _order(rows: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all rows; it decides only how soon centroids are given up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(s), pa.array(q)], names=["dim", "n", "s", "q"])

    made = rows.select("c").mapInArrow(run, "dim long, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    spread = {r.dim: r.q / max(r.n, 1) - (r.s / max(r.n, 1)) ** 2 for r in made}
    return np.array(sorted(range(dims), key=lambda d: (-spread.get(d, 0.0), d)))


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the exact mean of each; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            if not len(x):
                continue
            at = nearest(x, centroids, order)[0]
            by = np.argsort(at, kind="stable")
            own, starts = np.unique(at[by], return_index=True)
            sums[own] += np.add.reduceat(x[by], starts, axis=0)
            counts += np.bincount(at, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims)), pa.array(np.tile(np.arange(dims), len(used))), pa.array(np.repeat(counts[used], dims)), pa.array(sums[used].ravel())], names=["c", "dim", "n", "s"])

    exact = T.DecimalType(38, 0)
    made = rows.select("c").mapInArrow(run, "c long, dim long, n long, s long").groupBy("c", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s"))
    out = centroids.copy()
    for r in made.collect():  # clusters x dimensions rows
        out[r.c, r.dim] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_col, cluster int, distance, cluster_inertia, inertia, centroid_sha256, centroid) for each vector that scaled() keeps.

    Centroids start as the k vectors with the smallest sha256 of `<seed>:<id>` (ties: by components); `rounds` times all vectors are
    assigned and centroids moved, then assigned once more. Sums of distances that are no longs are null.

    Fewer vectors than k: fewer centroids. A null id counts as an empty text in the hash; repeated rows count again, and may be centroids
    more than once, of which the smaller number has all; an empty table gives no rows; other columns may have any names."""
    attach(vectors.sparkSession)
    rows = materialize(scaled(vectors, id_col, column, dims, scale), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.select(hashed.alias("h"), "c").orderBy("h", "c").limit(k).collect()
    made = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    name = id_col
    if not start:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("centroid", "array<int>"))]
        return rows.select(F.col("id").alias(name), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *empty)
    centroids = np.stack([np.frombuffer(bytes(r.c), "<i4") for r in start]).astype(np.int64)
    order = _order(rows, dims)
    for _ in range(rounds):
        moved = _moved(rows, centroids, order)
        if (moved == centroids).all():
            break  # later rounds would do the same
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            if len(x):
                at, best, _ = nearest(x, centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    assigned = materialize(rows.mapInArrow(run, made), "assigned")
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    as_long = lambda v: v if v < 1 << 63 else None
    told = [
        (c, as_long(sums.get(c, 0)), as_long(sum(sums.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v) for c, v in enumerate(centroids.tolist())
    ]
    facts = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias(name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
