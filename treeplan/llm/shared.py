"""What the operators share: work tables, Arrow slices, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.work import BATCH_ROWS, MALLOC

#: Bytes of an Arrow batch, about: rows of whole shingle sets or shards may have 100 KB each, and a batch stands in the executor
#: and in its Python worker.
BATCH_BYTES = 4 << 20
#: Text bytes that one step of an Arrow kernel handles at a time; a longer text is a step of its own.
SLICE_BYTES = 1 << 20


def attach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the
    session's Arrow batches, whose default of 10,000 rows is meant for rows of a few numbers, and
    which may have any number of bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for k, v in MALLOC.items():
        env.setdefault(k, v)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only a local master may do without it."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='treeplan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/treeplan/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps neither repeat its
    work nor depend on the executors that did it. Options are those of Spark's Parquet writer."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeplan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_treeplan_path", None)
    if path:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def clear_work(spark: SparkSession) -> None:
    """Removes all work tables of this application; results not yet written need them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold at most `limit` bytes together, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value starts; nulls are empty."""
    column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over hashable items."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        if x not in up:
            up[x] = x
            return x
        r = x
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a bounded run of batches by one star for each of their components."""
    held, n = Forest(), 0

    def out() -> pa.RecordBatch:
        rows = [(held.root(x), x) for x in list(held.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.join(a, b)
        n += batch.num_rows
        if n > 1_000_000:
            yield out()
            held, n = Forest(), 0
    if n:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. Returns (item, root): root is the smallest item that item is connected to.

    Alternates large-star and small-star steps; each keeps one link per item and neighbour
    that matters, so hot items shrink to stars. All steps are aggregations with a map-side
    part and equi-joins on split-able keys; links stay distributed and each round is a
    written table.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).select("a", "b")
    now = materialize(links.mapInArrow(_stars, "a long, b long").distinct(), "links")
    seen = None
    while True:
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: u and its smaller neighbours move to the least of them
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        small = moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        after = materialize(small, "links")
        discard(now)
        now = after
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("count(distinct b)").alias("d")).first()
        if state == seen or (state.n == state.d and not now.join(now.select(F.col("b").alias("a")), "a", "left_semi").take(1)):
            break
        seen = state
    roots = now.groupBy(F.col("b").alias("item")).agg(F.min("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("item"), "root").distinct())


def exactly(column: str) -> Column:
    """The column of this very name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def hex_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


#: Bits of a member map: 16 for each member, between these powers of two. It is collected and broadcast, so
#: the larger bounds both (2^27 bits are 16 MB).
MEMBER_BITS = (20, 27)
_RANGE = 17


class Members:
    """A bit map of hashed longs: `may_hold` misses no member and lets others through at the share of
    bits that are set. It only decides which rows need an exact join; at its largest size it lets
    more through as members grow, at worst all."""

    def __init__(self, values: DataFrame) -> None:
        """values: one long column, of a table that is cheap to read twice."""
        bits = min(max((16 * values.count()).bit_length(), MEMBER_BITS[0]), MEMBER_BITS[1])

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.unique(_cell(batch.column(0), bits))
                part = cell >> _RANGE
                for k in np.unique(part):
                    own = (cell[part == k] & ((1 << _RANGE) - 1)).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "cells"])

        def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(1 << _RANGE, bool)
            for batch in batches:
                for value in batch.column("cells"):
                    own[np.frombuffer(value.as_py(), "<u4")] = True
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["part", "bits"])

        got = {r.part: bytes(r.bits) for r in values.mapInArrow(cells, "part int, cells binary").groupBy("part").applyInArrow(merged, "part int, bits binary").collect()}
        empty = bytes(1 << (_RANGE - 3))
        self.bits, self.sent = bits, values.sparkSession.sparkContext.broadcast(b"".join(got.get(k, empty) for k in range(1 << (bits - _RANGE))))

    def holder(self) -> Callable[[pa.Array], pa.Array]:
        """The test of `may_hold` for Arrow kernels, which then need no Python worker beside their own."""
        sent, bits = self.sent, self.bits

        def test(x: pa.Array) -> pa.Array:
            at = _cell(x, bits)
            held = np.frombuffer(sent.value, np.uint8)
            return pa.array((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

        return test

    def may_hold(self, column: Column) -> Column:
        holds = self.holder()

        @F.arrow_udf("boolean")
        def test(x: pa.Array) -> pa.Array:
            return holds(x)

        return test(column)


def _cell(x: pa.Array, bits: int) -> np.ndarray:
    x = pc.fill_null(x.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    return (mixed(x + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
