"""Contents from operations, and checks of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeplan.operators.chunks import content_of
from treeplan.work import importable


def rebuilt(ops: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel_path, content binary): operations in order, copies from the old content, writes from the new.

    Operations are gathered by file first, so each content is joined once, not once for each operation. Null where an
    operation reaches beyond what it reads from."""
    per = ops.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("op_idx", "kind", "src_offset", "len"))).alias("ops"))
    joined = per.join(src.select("rel_path", content_of(src).alias("new")), "rel_path").join(dst.select("rel_path", content_of(dst).alias("old")), "rel_path", "left")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                new, old = (memoryview(x.as_buffer()) if x.is_valid else b"" for x in (batch.column(2)[k], batch.column(3)[k]))
                parts, good = [], True
                for op in batch.column(1)[k].as_py():
                    data, at, n = old if op["kind"] == "copy" else new, op["src_offset"], op["len"]
                    good &= 0 <= at <= at + n <= len(data)
                    parts.append(data[at : at + n])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([b"".join(parts) if good else None], pa.binary())], names=["rel_path", "content"])

    importable(joined.sparkSession)
    return joined.select("rel_path", "ops", "new", "old").mapInArrow(made, "rel_path string, content binary")


def verified(content: DataFrame, src: DataFrame) -> DataFrame:
    """(rel_path, size, digest, ok): the rebuilt content against the source's digest."""
    want = src.select("rel_path", F.sha2(content_of(src), 256).alias("want"))
    got = F.sha2("content", 256)
    return content.join(want, "rel_path").select("rel_path", F.octet_length("content").cast("long").alias("size"), got.alias("digest"), F.coalesce(got == F.col("want"), F.lit(False)).alias("ok"))


def appended(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel_path, append_bytes, tail_digest): what lies beyond the destination's length, where there is anything."""
    both = src.select("rel_path", "size", content_of(src).alias("content")).join(dst.select("rel_path", F.col("size").alias("dst_size")), "rel_path")
    return both.where("size > dst_size").select("rel_path", (F.col("size") - F.col("dst_size")).alias("append_bytes"), F.sha2(F.expr("substring(content, cast(dst_size + 1 as int))"), 256).alias("tail_digest"))


def in_place(ops: DataFrame) -> DataFrame:
    """By file: copies whose bytes are where they belong already, and all copies."""
    order = Window.partitionBy("rel_path").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("len").over(order), F.lit(0))
    marked = ops.withColumn("hit", (F.col("kind") == "copy") & (F.col("src_offset") == at))
    return marked.groupBy("rel_path").agg(F.count_if("hit").alias("in_place"), F.count_if(F.col("kind") == "copy").alias("copies"))


def zero_blocks(blocks: DataFrame) -> DataFrame:
    """Adds is_zero to (.., data binary): of 4096 bytes or more and all zero."""
    return blocks.withColumn("is_zero", (F.octet_length("data") >= 4096) & (F.octet_length(F.expr("btrim(data, X'00')")) == 0))


#: Bytes of the buckets that ranges meet in.
BUCKET = 1 << 20


def _overlapping(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(rel_path, op_idx) of `reads` whose source range meets a result range of `writes`."""
    over = lambda place: F.explode(F.sequence(F.floor(F.col(place) / BUCKET), F.floor((F.col(place) + F.col("len") - 1) / BUCKET)))
    r = reads.select("rel_path", "op_idx", F.col("src_offset").alias("a"), (F.col("src_offset") + F.col("len")).alias("b"), over("src_offset").alias("bucket"))
    w = writes.select("rel_path", F.col("off").alias("c"), (F.col("off") + F.col("len")).alias("d"), over("off").alias("bucket"))
    return r.join(w, ["rel_path", "bucket"]).where("a < d and c < b").select("rel_path", "op_idx").distinct()


def in_place_steps(ops: DataFrame) -> DataFrame:
    """(rel_path, op_idx, kind, off, src_offset, len, phase, spool): how operations are done inside the old content itself.

    Copies that stay where they are need nothing and have no row. Copies that move back are done from the front, those that move ahead from
    the end: so none of one kind overwrites what another of its kind still reads, as results do not overlap. The kinds do meet: a copy of the
    second kind whose source the first kind overwrites waits on it and the other way round, so it is read beforehand (spool). For each file the
    kind goes first that leaves less to spool. Order by phase (0 spooled, 1, 2, then 3 writes), and inside 1 and 2 by off, falling
    where off > src_offset."""
    moved = ops.where("len > 0 and not (kind = 'copy' and off = src_offset)")
    copies = moved.where("kind = 'copy'")
    back, ahead = copies.where("off < src_offset"), copies.where("off > src_offset")
    hit = _overlapping(ahead, back).withColumn("ahead", F.lit(True)).unionByName(_overlapping(back, ahead).withColumn("ahead", F.lit(False)))
    rows = moved.join(hit, ["rel_path", "op_idx"], "left")
    cost = rows.groupBy("rel_path").agg(*[F.coalesce(F.sum(F.when(F.col("ahead") == on, F.col("len"))), F.lit(0)).alias(c) for c, on in (("ahead_bytes", True), ("back_bytes", False))])
    rows = rows.join(cost, "rel_path").withColumn("back_first", F.col("ahead_bytes") <= F.col("back_bytes"))
    is_copy, goes_ahead = F.col("kind") == "copy", F.col("off") > F.col("src_offset")
    spool = is_copy & F.coalesce(F.col("ahead") == F.col("back_first"), F.lit(False))
    phase = F.when(~is_copy, 3).when(spool, 0).when(goes_ahead == F.col("back_first"), 2).otherwise(1)
    return rows.select("rel_path", "op_idx", "kind", "off", "src_offset", "len", phase.alias("phase"), spool.alias("spool"))
