"""Numbers and sums along streams of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeplan.work import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder of spark.checkpoint.dir; only a local master may do without that setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def running(rows: DataFrame, stream: str, order: Column | str, value: Column | None = None) -> DataFrame:
    """Adds nth, a row's number in its stream from 1, and with `value` passed, the sum up to and with the row.

    No stream is a task of its own: rows are dealt to ranges of (stream, order) and numbered inside each; of each range
    only a count and a sum by stream go on to the ranges after it. Ranges are bounded by a sample, so they are written
    before they are read twice. Rows equal in both share a range; which of them comes first is open. A null stream is one.
    """
    of = F.lit(0).cast("long") if value is None else value
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order) if isinstance(order, str) else order
    placed = checkpointed(rows.withColumn("__value", of).repartitionByRange(ranges, F.col(stream), order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy(F.col(stream).alias("__stream"), F.col("__range").alias("__own")).agg(F.count("*").alias("__n"), F.sum("__value").alias("__sum"))
    before = Window.partitionBy("__stream").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    counts = counts.select("__stream", "__own", zero("__n").alias("__n"), zero("__sum").alias("__sum"))
    inside = Window.partitionBy(stream, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = placed.join(counts, F.col(stream).eqNullSafe(F.col("__stream")) & (F.col("__range") == F.col("__own")))
    out = both.withColumn("nth", F.row_number().over(inside) + F.col("__n"))
    if value is not None:
        out = out.withColumn("passed", F.sum("__value").over(inside) + F.col("__sum"))
    return out.drop("__value", "__range", "__stream", "__own", "__n", "__sum")
