"""Plans over snapshots that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.options import SyncOptions
from treeplan.plans import log, manifest, sync


def changes(spark: SparkSession, folder: str, schema, dst: DataFrame, o: SyncOptions = SyncOptions()) -> DataFrame:
    """A stream of planned rows: each file of `folder` is part of a source snapshot, planned against dst, which stays as it is.
    A stream-static join on the path; keyed.planned() carries state along."""
    rows = spark.readStream.schema(schema).parquet(folder).alias("s")
    here = F.col("s.rel_path") == F.col("d.rel_path")
    return rows.join(dst.alias("d"), here, "left").select("s.rel_path", sync.action(o).alias("action"), "s.size")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Handles all that has arrived, exactly once, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(spark: SparkSession, folder: str, schema, state: str, snapshot_id: str, out: str, checkpoint: str, o: SyncOptions = SyncOptions()) -> None:
    """Handles all snapshots that have arrived, one file of `folder` at a time, and stops: each is planned against the
    manifest log `snapshot_id` below `state`, its plan written to `out`/batch=N, and the log gets an entry of what changes.

    Every batch joins the whole manifest, as it must to find what is to be deleted; keyed.py does without where snapshots say what is gone.

    An entry tells the batch that it is of. A batch that is done again, after a crash at any place, is planned against
    the entries before its own, so its plan is the same, and its entry is not written twice."""
    place = f"{state}/{snapshot_id}"

    def one(rows: DataFrame, number: int) -> None:
        src, tag = rows.select(*schema.names), f"{checkpoint}#{number}"
        found = log.entries(spark, place)
        if found is None:  # nothing yet, or nothing to be trusted
            log.reset(spark, place)
            log.commit(spark, place, 0, src.limit(0), folder, "base")
            found = log.entries(spark, place)
        mine = next((e for e in found if e.tag == tag), None)
        if mine is None and len(found) > log.COMPACT and log.compact(spark, place):
            found = log.entries(spark, place)
        known = log.load(spark, place, before=mine.number if mine else None)
        sync.plan(src, known, o).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if mine is None:
            done = spark.read.parquet(f"{out}/batch={number}")
            if manifest.changed(done):
                log.commit(spark, place, found[-1].number + 1, log.changes(done, src), folder, tag=tag)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
