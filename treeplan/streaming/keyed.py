"""Plans along a stream of snapshots, from state kept by path: work is in proportion to what arrives.

A row says what a snapshot `seq` holds at a path, or, with `gone`, that it holds nothing there any more. The
state of a path is what its destination has after the plans so far. It is versioned by batch with the
stream's checkpoint: a batch done again, after a crash at any place, starts from the state it started from
before and gives the same plan; the file sink counts it once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from treeplan import work
from treeplan.options import SyncOptions
from treeplan.plans import sync

#: What is kept of a path.
KNOWN = "size long, mtime_ns long, mode int, is_symlink boolean, symlink_target string, uid long, gid long, dev long, ino long"
_NAMES = [c.split()[0] for c in KNOWN.split(", ")]
SNAPSHOT = f"seq long, gone boolean, rel_path string, {KNOWN}"
PLANNED = "seq long, rel_path string, action string, size long, dst_size long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Paths(StatefulProcessor):
    def __init__(self, o: SyncOptions) -> None:
        self.o = o

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.known.get() if self.known.exists() else None
        there = before = dict(zip(_NAMES, held, strict=True)) if held is not None else None
        for row in sorted(rows, key=lambda r: r.seq):
            had = there["size"] if there else None
            if row.gone:
                if not self.o.delete or there is None:
                    continue
                action, size, there = "delete", had, None
            else:
                now = {c: row[c] for c in _NAMES}
                action, size = sync.decided(self.o, now, there), now["size"]
                if action != "skip":
                    there = now
            yield Row(seq=row.seq, rel_path=key[0], action=action, size=size, dst_size=had)
        if there is None:
            if before is not None:
                self.known.clear()
        elif there is not before:
            self.known.update(tuple(there[c] for c in _NAMES))

    def close(self) -> None:
        pass


def planned(arriving: DataFrame, o: SyncOptions = SyncOptions()) -> DataFrame:
    """PLANNED rows for SNAPSHOT rows, by the ladder of `o` (not by content); several of one path are taken in the order of seq."""
    if o.checksum == "content":
        raise ValueError("state by path holds no contents")
    work.importable(arriving.sparkSession)
    wanted = arriving.select(*[c.split()[0] for c in SNAPSHOT.split(", ")])
    return wanted.groupBy("rel_path").transformWithState(_Paths(o), PLANNED, "append", "none")


def snapshot(files: DataFrame, seq: int, before: DataFrame | None = None) -> DataFrame:
    """The rows of a snapshot; with the one before it also what is gone since."""
    as_rows = lambda f, gone: f.select(F.lit(seq).cast("long").alias("seq"), F.lit(gone).alias("gone"), "rel_path", *[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in KNOWN.split(", "))])
    rows = as_rows(files, False)
    return rows if before is None else rows.unionByName(as_rows(before.join(files.select("rel_path"), "rel_path", "left_anti"), True))


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str, o: SyncOptions = SyncOptions()) -> None:
    """Plans all SNAPSHOT files of `folder` that have arrived, into Parquet below `out`, and stops."""
    was = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = planned(spark.readStream.schema(SNAPSHOT).parquet(folder), o)
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, was)


def destination(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(rel_path, ...KNOWN): the state after the last batch, which is the destination's manifest."""
    held = spark.read.format("statestore").option("stateVarName", "known").load(checkpoint)
    return held.select(F.col("key.rel_path").alias("rel_path"), "value.*")
