"""Frames, greedy batches with resets, and the token bucket."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from treeplan.operators.ranking import running
from treeplan.work import importable

#: A batch closes at so many files or bytes; a larger file goes alone.
FILES, BYTES, ALONE = 256, 64 << 20, 4 << 20
#: Rows that are batched in one step; a bound of memory that changes no result.
BLOCK = 1 << 18


def frames(rows: DataFrame, stream: str, order: str, size: int) -> DataFrame:
    """Adds frame: so many rows of a stream in order."""
    return running(rows, stream, order).withColumn("frame", F.expr(f"(nth - 1) div {size}").cast("long")).drop("nth")


def _closings(size: np.ndarray, files: int, limit: int, alone: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, if a batch began there: the row after which nothing is open again, and how many batches that took."""
    n, at = len(size), np.arange(len(size))
    sums = np.concatenate([[0], np.cumsum(size)])
    full = np.minimum(np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + limit), at + 1), at + files), n)
    big = np.append(np.flatnonzero(size > alone), n)
    lone = big[np.searchsorted(big, at)]
    first = lone < full  # closes what is open, and is a batch of its own
    return np.where(first, lone + 1, full), np.where(first & (lone > at), 2, 1)


def greedy(rows: DataFrame, stream: str, order: str, files: int = FILES, limit: int = BYTES, alone: int = ALONE, block: int = BLOCK) -> DataFrame:
    """Adds batch: rows of each stream in order; a batch closes once it has `files` rows or `limit` bytes, and a
    row of over `alone` bytes closes the one before and is its own. Columns: stream, order and size. A null stream is
    one, a null size is 0; rows equal in order go by size.

    No stream is a task of its own. Rows are numbered and cut into blocks, each with the first `files` rows of the next
    one. A batch has at most so many rows, so the first one that begins in a block begins at one of its first `files`
    rows: a block says for each of these where the next block would begin and how many batches lie between. Only these
    short tables are followed along a stream; then every block numbers its own batches. A stream of one block has nothing
    to follow, so it is batched at once."""
    block, files = max(block, files, 1), max(files, 1)
    kept = rows.select(stream, order, "size")
    named = kept.select(F.col(stream).alias("s"), F.col(order).alias("o"), F.col("size").alias("size"))
    numbered = running(named, "s", F.struct("o", "size")).select("s", "o", "size", (F.col("nth") - 1).alias("at"))
    wide = numbered.where(F.col("at") == block).select(F.col("s").alias("t"))  # streams of more than one block
    several = not wide.isEmpty()
    same = F.col("s").eqNullSafe(F.col("t"))
    narrow = numbered.join(wide, same, "left_anti") if several else numbered
    own = F.expr(f"at div {block}")
    both = F.when((F.col("at") % block < files) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = numbered.join(wide, same, "left_semi").withColumn("block", F.explode(both))

    def ready(table: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray]:
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        size = np.array(pc.fill_null(table.column("size").cast(pa.int64()), 0).to_numpy())
        return table, int((at // block == table.column("block")[0].as_py()).sum()), *_closings(size, files, limit, alone)

    def ways(table: pa.Table) -> pa.Table:
        table, n, after, took = ready(table)
        to, count = after.tolist(), took.tolist()
        for i in range(n - 1, -1, -1):
            if to[i] < n:
                to[i], count[i] = to[to[i]], count[i] + count[to[i]]
        some = min(n, files)
        lists = [pa.array([[x - n for x in to[:some]]], pa.list_(pa.int64())), pa.array([count[:some]], pa.list_(pa.int64()))]
        return pa.Table.from_arrays([table.column("s").slice(0, 1), table.column("block").slice(0, 1), *lists], names=["s", "block", "to", "count"])

    def followed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = nothing = object()  # no key equals it, null is one
        first = batch = 0
        for part in parts:
            begins, batches = [], []
            for key, to, count in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if now is nothing or key != now:
                    now, first, batch = key, 0, 0
                begins.append(first), batches.append(batch)
                if first < len(to):
                    first, batch = to[first], batch + count[first]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(begins, pa.int64()), pa.array(batches, pa.int64())], names=["t", "own", "first", "batch"])

    def batched(table: pa.Table) -> pa.Table:
        table, n, after, took = ready(table)
        begins, at, to = [], table.column("first")[0].as_py(), after.tolist()
        first = end = at
        while at < n:
            begins.append(at)
            at = end = to[at]
        begins = np.array(begins, np.int64)
        ends, steps = np.append(begins[1:], end)[: len(begins)], took[begins]
        batch = np.repeat(table.column("batch")[0].as_py() + np.cumsum(steps) - steps, ends - begins)
        batch[ends[steps == 2] - 1 - first] += 1
        return table.select(["s", "o", "size"]).slice(first, end - first if len(begins) else 0).append_column("batch", pa.array(batch, pa.int64()))

    kinds = [StructField(new, f.dataType) for new, f in zip(("s", "o", "size"), kept.schema.fields, strict=True)]
    kinds.append(StructField("batch", LongType()))
    importable(dealt.sparkSession)
    none = F.lit(0).cast("long")
    single = narrow.withColumns({"block": none, "first": none, "batch": none}).groupBy("s").applyInArrow(batched, StructType(kinds))
    if not several:
        return single.toDF(*kept.columns, "batch")
    tables = dealt.groupBy("s", "block").applyInArrow(ways, StructType([kinds[0], StructField("block", LongType()), StructField("to", ArrayType(LongType())), StructField("count", ArrayType(LongType()))]))
    entries = tables.repartition("s").sortWithinPartitions("s", "block").mapInArrow(followed, StructType([StructField("t", kinds[0].dataType), *(StructField(x, LongType()) for x in ("own", "first", "batch"))]))
    joined = dealt.join(entries, F.col("s").eqNullSafe(F.col("t")) & (F.col("block") == F.col("own"))).drop("t", "own")
    return joined.groupBy("s", "block").applyInArrow(batched, StructType(kinds)).unionByName(single).toDF(*kept.columns, "batch")


def payloads(batches: DataFrame, contents: DataFrame, stream: str, order: str) -> DataFrame:
    """(stream, batch, rel_paths, lengths, payload): what one message of a batch carries, its files' contents behind each
    other. batches: stream, order, rel_path, batch; contents: rel_path, content. A batch is bounded by greedy()."""
    own = batches.join(contents.select("rel_path", "content"), "rel_path")
    per = own.groupBy(stream, "batch").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "rel_path", "content"))).alias("v"))
    parts = per.select(stream, "batch", F.col("v.rel_path").alias("rel_paths"), F.transform("v", lambda x: F.coalesce(F.octet_length(x["content"]), F.lit(0)).cast("long")).alias("lengths"), F.col("v.content").alias("parts"))

    def joined(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([b"".join(x or b"" for x in row.column(4)[0].as_py())], pa.binary())], names=[*row.schema.names[:4], "payload"])

    importable(parts.sparkSession)
    return parts.mapInArrow(joined, StructType([*parts.schema.fields[:4], StructField("payload", BinaryType())]))


def wire_sizes(frames: DataFrame, stream: str, level: int = 3) -> DataFrame:
    """(stream, frame, single_bytes, frame_bytes): what zlib makes of the files of a frame one by one, and together.
    frames: stream, frame, rel_path, content."""

    @F.arrow_udf("long")
    def packed(x: pa.Array) -> pa.Array:
        return pa.array([len(zlib.compress(v.as_py() or b"", level)) for v in x], pa.int64())

    per = frames.withColumn("one", packed("content")).groupBy(stream, "frame").agg(F.sum("one").alias("single_bytes"), F.sort_array(F.collect_list(F.struct("rel_path", "content"))).alias("v"))

    @F.arrow_udf("long")
    def together(x: pa.Array) -> pa.Array:
        return pa.array([len(zlib.compress(b"".join(p or b"" for p in v.as_py()), level)) for v in x], pa.int64())

    return per.select(stream, "frame", "single_bytes", together("v.content").alias("frame_bytes"))


def token_bucket(rows: DataFrame, stream: str, order: str, rate: int) -> DataFrame:
    """Adds finish_ns, when each row's bytes have passed a bucket of one second's capacity that starts full and
    is asked at once; the wait is the deficit over the rate. In closed form: everything beyond the first
    second's bytes takes its time."""
    passed = running(rows.select(stream, order, "size"), stream, order, F.col("size"))
    return passed.withColumn("finish_ns", F.expr(f"cast((cast(greatest(passed - {rate}, 0) as decimal(28,0)) * 1000000000) div {rate} as bigint)")).drop("nth", "passed")
