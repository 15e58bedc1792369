"""Exact top-k search by inner product, with bounds from segment statistics.

A vector's components are cut into 1, 2, 4, ... even segments; of each segment the mean and
the standard deviation are kept. For two vectors,

    |q - x|^2 >= sum over segments of len * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

and as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a lower bound of the distance is an upper bound
of the inner product: sum of len * (mean_q mean_x + dev_q dev_x). Bounds are taken coarse to
fine: a level is computed only for candidates that the level before left to some query of
the same step. At each level the candidates that it likes best are scored exactly, which
raises the query's threshold (its k-th best score so far); what cannot reach that is
dropped, and at the end exact integer scores are computed for the survivors.

Queries and candidates are cut into blocks by a hash of their ids, of a bounded size and
small enough that all cores have some; one task row searches one block of queries in one
block of candidates, and each block's best k per query are merged by a window over the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeplan.llm.shared import attach, partitions

#: Rows of a block at most, and at least where there are more cores than blocks.
QUERIES = 4096
CANDIDATES, LEAST = 8192, 1024
#: Queries that are compared at a time; survivors that are scored one by one, beyond that share of a step all are.
ROWS, STEP, DENSE = 64, 4096, 1 / 32


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(len) * mean and sqrt(len) * deviation of each segment, by row; their inner product is the bound."""
    cut = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    means = np.stack([x[:, c].mean(axis=1) * np.sqrt(len(c)) for c in cut], axis=1)
    devs = np.stack([x[:, c].std(axis=1) * np.sqrt(len(c)) for c in cut], axis=1)
    return np.concatenate([means, devs], axis=1)


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, seen: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: (its row, rows of its best candidates, their scores); rows of float64 integers.

    seen gets, for each step, the pairs that were left after each level."""
    levels = [s for s in (1, 2, 4, 8, 16, 32) if s <= max(1, x.shape[1] // 2)]
    sx = [statistics(x, s).astype(np.float32) for s in levels]
    longest = np.sqrt((x * x).sum(axis=1).max(initial=0))
    for at in range(0, len(q), ROWS):
        own, ids = q[at : at + ROWS], q_ids[at : at + ROWS]
        # single precision: sums of up to thousands of products err by less than this share of |q| |x|
        slack = 2e-5 * (1 + longest * np.sqrt((own * own).sum(axis=1, keepdims=True)))
        columns, alive = np.arange(len(x)), ids[:, None] != x_ids[None, :]
        least, left = np.full((len(own), 1), -np.inf), [int(alive.sum())]
        for level, segments in enumerate(levels):
            bound = np.where(alive, statistics(own, segments).astype(np.float32) @ sx[level][columns].T, -np.inf)
            if len(columns) >= k:  # the k that this level likes best are as good as they are: a threshold
                likely = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                scores = np.einsum("rd,rcd->rc", own, x[columns[likely]])
                scores[~np.take_along_axis(alive, likely, 1)] = -np.inf
                least = np.maximum(least, scores.min(axis=1, keepdims=True))
            alive &= bound >= (least - slack).astype(np.float32)
            used = alive.any(axis=0)
            columns, alive = columns[used], alive[:, used]
            left.append(int(alive.sum()))
        if seen is not None:
            seen.append(left)
        if left[-1] > DENSE * alive.size:  # so many that one product of all is less work than to gather them
            exact = own @ x[columns].T
            r, c = np.nonzero(alive & (exact >= least))
            exact = exact[r, c]
        else:
            r, c = np.nonzero(alive)
            exact = np.concatenate([np.einsum("nd,nd->n", own[r[i : i + STEP]], x[columns[c[i : i + STEP]]]) for i in range(0, len(r), STEP)] or [np.zeros(0)])
            good = exact >= least[r, 0]
            r, c, exact = r[good], c[good], exact[good]
        c, cut = columns[c], np.searchsorted(r, np.arange(len(own) + 1))
        for i in range(len(own)):
            rows, s = c[cut[i] : cut[i + 1]], exact[cut[i] : cut[i + 1]]
            order = np.lexsort((x_ids[rows], -s))[:k]
            yield at + i, rows[order], s[order]


def _plain(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for components too large for float64, in unbounded integers; scores beyond a long saturate."""
    big = [[int(v) for v in row] for row in x]
    for i, row in enumerate(q):
        own = [int(v) for v in row]
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), int(x_ids[j]), j) for j, v in enumerate(big) if x_ids[j] != q_ids[i])[:k]
        yield i, np.array([j for *_, j in scored], np.int64), [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, *_ in scored]


def _work(k: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for query, dims, ids, parts in zip(*(batch.column(c).to_pylist() for c in ("query", "dims", "ids", "vectors")), strict=True):
                got[query].append((np.frombuffer(ids, np.int64), np.frombuffer(parts, np.float64).reshape(-1, dims)))
        if not got[True] or not got[False]:
            return
        (q_ids, q), (x_ids, x) = (tuple(np.concatenate(v) for v in zip(*got[side], strict=True)) for side in (True, False))
        most = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
        find = search if q.shape[1] * most * most < 2**53 else _plain
        out = [(int(q_ids[i]), int(x_ids[j]), int(s)) for i, rows, scores in find(q, q_ids, x, x_ids, k) for j, s in zip(rows, scores, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score long): for each row with `is_query` the k rows of
    highest score among all others, ties to the smaller id; fewer where there are fewer.

    Score: the inner product of floor(scale * component), as integers. Vectors that are null,
    empty, or hold null or non-finite components take no part, nor do null ids; vectors are
    compared with those of as many components. Rows that repeat an id are rows of their own, also among
    the results; as queries they share one list of ranks. An empty table gives no rows; other columns are not
    looked at; a very long vector is one row of its block.
    """
    attach(vectors.sparkSession)
    v = F.col("v")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(
        v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    counts = good.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    slabs, groups = -(-max(counts.n, 1) // CANDIDATES), -(-max(counts.q, 1) // QUERIES)
    slabs = max(slabs, min(-(-counts.n // LEAST), -(-8 * cores // groups)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(sizes)
            query, place = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy(zero_copy_only=False)
            group = batch.column(4).to_numpy(zero_copy_only=False)
            rows = []
            for dims in np.unique(sizes):
                of = sizes == dims
                x = flat[np.repeat(of, sizes)].reshape(-1, dims)
                own, q, s, g = ids[of], query[of], place[of], group[of]
                for asked, at in ((False, s), (True, g)):
                    for block in np.unique(at if not asked else at[q]):
                        some = (at == block) & (q | (not asked))
                        rows.append((int(block), asked, int(dims), own[some].tobytes(), x[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "query", "dims", "ids", "vectors"])

    def block(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("int")

    made = good.select("id", "v", "query", block(slabs, 1), block(groups, 2)).mapInArrow(blocks, "block int, query boolean, dims int, ids binary, vectors binary")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), slabs).otherwise(groups) - 1)).alias("other")
    dealt = made.select("*", across).select("query", "dims", "ids", "vectors", F.when(F.col("query"), F.col("block")).otherwise(F.col("other")).alias("g"), F.when(F.col("query"), F.col("other")).otherwise(F.col("block")).alias("s"))
    # as many partitions as there is work for: without the number small blocks would be put together in few tasks
    tasks = min(slabs * groups, max(partitions(vectors.sparkSession), 4 * cores))
    best = dealt.repartition(tasks, "dims", "g", "s").groupBy("dims", "g", "s").applyInArrow(_work(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
