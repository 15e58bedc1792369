"""Deltas between two chunkings: copy what the destination has, write the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_index(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Fixed chunks: a copy where the chunk of the same number is equal. Returns ops."""
    d = dst.select("rel_path", "idx", F.col("h").alias("dh"), F.col("off").alias("doff"), F.col("len").alias("dlen"))
    hit = F.coalesce(F.col("h") == F.col("dh"), F.lit(False))
    return _ops(src.join(d, ["rel_path", "idx"], "left"), hit)


def by_hash(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Content-defined chunks: a copy of the first destination chunk of equal hash, wherever it is. Returns ops."""
    first = dst.groupBy("rel_path", "h").agg(F.min(F.struct("idx", "off", "len")).alias("d"))
    d = first.select("rel_path", "h", F.col("d.off").alias("doff"), F.col("d.len").alias("dlen"))
    return _ops(src.join(d, ["rel_path", "h"], "left"), F.col("doff").isNotNull())


def by_strategy(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Chunks with is_cdc: by hash where both sides of a file are content-defined, else by number. Returns ops."""
    hashed = src.where("is_cdc").select("rel_path").distinct().join(dst.where("is_cdc").select("rel_path").distinct(), "rel_path")
    part = lambda chunks, how: chunks.join(hashed, "rel_path", how)
    return by_hash(part(src, "left_semi"), part(dst, "left_semi")).unionByName(by_index(part(src, "left_anti"), part(dst, "left_anti")))


def _ops(joined: DataFrame, hit) -> DataFrame:
    """(rel_path, op_idx, kind, off, src_offset, len): off is the place in the result; src_offset the place in
    the old content of a copy, in the new content of a write."""
    return joined.select("rel_path", F.col("idx").alias("op_idx"), F.when(hit, "copy").otherwise("write").alias("kind"), "off", F.when(hit, F.col("doff")).otherwise(F.col("off")).alias("src_offset"), F.when(hit, F.least("len", "dlen")).otherwise(F.col("len")).alias("len"))


def totals(ops: DataFrame) -> DataFrame:
    """Bytes to transfer and to reuse, and the final size, by file."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("len"))), F.lit(0)).cast("long")
    out = ops.groupBy("rel_path").agg(F.count("*").alias("ops"), part("write").alias("transfer_bytes"), part("copy").alias("reuse_bytes"), F.sum("len").cast("long").alias("final_size"))
    return out.withColumns({"transfer_free": F.col("transfer_bytes") == 0, "savings": F.when(F.col("final_size") == 0, 1.0).otherwise(F.round(F.col("reuse_bytes") / F.col("final_size"), 6))})


def differing(src: DataFrame, dst: DataFrame) -> DataFrame:
    """By file: chunks that differ by number (missing ones differ), the source bytes in those, and whether both
    sides are identical."""
    s = src.select("rel_path", "idx", "h", "len")
    d = dst.select("rel_path", "idx", F.col("h").alias("dh"))
    both = s.join(d, ["rel_path", "idx"], "full")
    same = F.coalesce(F.col("h") == F.col("dh"), F.lit(False))
    return both.groupBy("rel_path").agg(F.count_if(~same).alias("diff_count"), F.coalesce(F.sum(F.when(~same, F.col("len"))), F.lit(0)).cast("long").alias("delta_bytes"), F.bool_and(same).alias("identical"))


def merged_copies(ops: DataFrame) -> DataFrame:
    """Runs of copies whose places follow on both sides, as one range each: (rel_path, off, src_offset, len), only
    those that move."""
    order = Window.partitionBy("rel_path").orderBy("off")
    copies = ops.where("kind = 'copy'").withColumn("new", (F.lag(F.col("off") + F.col("len")).over(order).eqNullSafe(F.col("off")) & F.lag(F.col("src_offset") + F.col("len")).over(order).eqNullSafe(F.col("src_offset"))).cast("int"))
    runs = copies.withColumn("run", F.sum(1 - F.col("new")).over(order))
    return runs.groupBy("rel_path", "run").agg(F.min("off").alias("off"), F.min("src_offset").alias("src_offset"), F.sum("len").cast("long").alias("len")).where("off <> src_offset").drop("run")


def payload_order(ops: DataFrame) -> DataFrame:
    """(rel_path, op_idx, payload): the n-th write takes the n-th payload."""
    order = Window.partitionBy("rel_path").orderBy("op_idx")
    return ops.where("kind = 'write'").select("rel_path", "op_idx", F.row_number().over(order).alias("payload"))
