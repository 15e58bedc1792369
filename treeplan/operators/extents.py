"""Extent maps: holes, density, comparison, flags. extents: (file_id, ord, logical, physical, length, flags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Flag bits.
LAST, UNWRITTEN, SHARED = 0x1, 0x800, 0x2000


def of_tree(found: DataFrame) -> DataFrame:
    """Extents of a live tree, as fs_tree.extents() finds them, in the columns that the others take; the paths are the ids, physical places are not known."""
    last = Window.partitionBy("rel_path").orderBy(F.desc("ord"))
    flag = F.when(F.row_number().over(last) == 1, LAST).otherwise(0)
    return found.select(F.col("rel_path").alias("file_id"), "ord", "logical", F.lit(None).cast("long").alias("physical"), "length", flag.alias("flags"))


def flags(extents: DataFrame) -> DataFrame:
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    return extents.withColumns({"is_last": bit(LAST), "is_unwritten": bit(UNWRITTEN), "is_shared": bit(SHARED), "end": F.col("logical") + F.col("length")})


def sparse_info(extents: DataFrame, files: DataFrame) -> DataFrame:
    """files: (file_id, size). By file: data bytes, extents, holes with the trailing one, is_sparse, density (1 if empty)."""
    order = Window.partitionBy("file_id").orderBy("ord")
    gaps = extents.withColumn("gap", F.col("logical") > F.coalesce(F.lag(F.col("logical") + F.col("length")).over(order), F.lit(0)))
    per = gaps.groupBy("file_id").agg(F.sum("length").cast("long").alias("data"), F.count("*").alias("n"), F.count_if("gap").alias("holes"), F.max(F.col("logical") + F.col("length")).alias("end"))
    both = files.select("file_id", "size").join(per, "file_id", "left")
    holes = F.coalesce("holes", F.lit(0)) + (F.coalesce("end", F.lit(0)) < F.col("size")).cast("int")
    data = F.coalesce("data", F.lit(0))
    return both.select("file_id", data.cast("long").alias("data_bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("extent_count"), holes.cast("long").alias("hole_count"), (holes > 0).alias("is_sparse"), F.when(F.col("size") == 0, 1.0).otherwise(F.round(data / F.col("size"), 6)).alias("density"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """By file: whether both maps have the same places and lengths in the same order, and how many differ."""
    x = a.select("file_id", "ord", "logical", "length")
    y = b.select("file_id", "ord", F.col("logical").alias("l2"), F.col("length").alias("n2"))
    same = F.coalesce((F.col("logical") == F.col("l2")) & (F.col("length") == F.col("n2")), F.lit(False))
    return x.join(y, ["file_id", "ord"], "full").groupBy("file_id").agg(F.bool_and(same).alias("same"), F.count_if(~same).alias("differing"))


def copied(extents: DataFrame) -> DataFrame:
    """By file: bytes and extents that a sparse copy reads, without unwritten ones."""
    return extents.where(F.col("flags").bitwiseAND(F.lit(UNWRITTEN)) == 0).groupBy("file_id").agg(F.sum("length").cast("long").alias("bytes"), F.count("*").alias("extents"))
