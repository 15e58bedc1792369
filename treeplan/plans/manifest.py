"""State across runs: manifests are Parquet snapshots of what was synchronised."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.functions import paths
from treeplan.options import SyncOptions
from treeplan.plans import log, sync
from treeplan.work import UNREADABLE
from treeplan.sources import fs_tree
from treeplan.sources.snapshots import META, dir_times

VERSION = 4


def save(spark: SparkSession, path: str, snapshot_id: str, source_path: str, files: DataFrame, created_ns: int = 0, dirs: DataFrame | None = None) -> None:
    """Writes files and directory times (rel_path, mtime_ns; by default those of files) under a new name, then the
    header, whose row names them and makes them valid, then removes what the header before named. So a reader finds
    the old manifest, none or the new one, never a mixture."""
    place, name = f"{path}/{snapshot_id}", uuid.uuid4().hex
    before = _header(spark, place)
    files.select(*META).write.parquet(f"{place}/files-{name}")
    (dir_times(files) if dirs is None else dirs.select("rel_path", "mtime_ns")).write.parquet(f"{place}/dirs-{name}")
    head = spark.read.parquet(f"{place}/files-{name}").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    known = {"snapshot_id": F.lit(snapshot_id), "version": F.lit(VERSION), "created_ns": F.lit(created_ns).cast("long"), "source_path": F.lit(source_path), "data": F.lit(name)}
    head.withColumns(known).coalesce(1).write.mode("overwrite").parquet(f"{place}/header")
    if before is not None:
        jvm = spark._jvm
        for part in ("files", "dirs"):
            old = jvm.org.apache.hadoop.fs.Path(f"{place}/{part}-{before.data}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)


def _header(spark: SparkSession, place: str, source_path: str | None = None):
    """The header's row, or None if there is no valid one of this version and source; one that can't be read is none."""
    try:
        head = spark.read.parquet(f"{place}/header").first()
        named = head is None or all(head[c] is not None for c in ("version", "data", "source_path"))
    except UNREADABLE:
        return None
    return None if not named or head is None or head.version != VERSION or source_path not in (None, head.source_path) else head


def load(spark: SparkSession, path: str, snapshot_id: str, source_path: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(files, dirs), or None if there is no valid manifest of this version and source; a manifest may be a log."""
    place = f"{path}/{snapshot_id}"
    head = _header(spark, place, source_path)
    if head is None:
        files = log.load(spark, place, source_path)
        return None if files is None else (files, dir_times(files))
    return (spark.read.parquet(f"{place}/files-{head.data}"), spark.read.parquet(f"{place}/dirs-{head.data}"))


def load_toc(spark: SparkSession, path: str, snapshot_id: str, source_path: str | None = None):
    """(header, dirs), the small part of a manifest: counts, bytes, and directory times ordered by path; or None."""
    place = f"{path}/{snapshot_id}"
    head = _header(spark, place, source_path)
    return None if head is None else (head, spark.read.parquet(f"{place}/dirs-{head.data}").orderBy("rel_path"))


def trusted(spark: SparkSession, path: str, snapshot_id: str, source_path: str, now_dirs: DataFrame, o: SyncOptions) -> bool:
    """Whether nothing is to be done, as no directory's time has changed: no file is looked at. Only with
    o.trust_mtime, and not where files are deleted or compared by content."""
    if not o.trust_mtime or o.delete or o.checksum:
        return False
    toc = load_toc(spark, path, snapshot_id, source_path)
    return toc is not None and unchanged(now_dirs, toc[1]).first().unchanged


def trusted_now(spark: SparkSession, path: str, snapshot_id: str, root: str, o: SyncOptions) -> bool:
    """trusted() of the live tree at root: only the directories that the manifest knows are looked at, on the executors."""
    toc = load_toc(spark, path, snapshot_id, root)
    return toc is not None and trusted(spark, path, snapshot_id, root, fs_tree.times_now(toc[1], root), o)


def changed_dirs(now: DataFrame, toc: DataFrame) -> DataFrame:
    """(rel_path, changed) of the directories that a manifest knows (rel_path, mtime_ns): another time now, or gone. Only files directly
    in these have to be looked at, if times can be trusted."""
    both = toc.select("rel_path", F.col("mtime_ns").alias("was")).join(now.select("rel_path", "mtime_ns"), "rel_path", "left")
    return both.select("rel_path", F.coalesce(F.col("was") != F.col("mtime_ns"), F.lit(True)).alias("changed"))


def plan_live(spark: SparkSession, path: str, snapshot_id: str, root: str, o: SyncOptions = SyncOptions(), chain: list = ()) -> DataFrame | None:
    """What a tree has for its destination, whose manifest is kept: None, without a scan, if its directories' times can be trusted and none has
    changed; else the plan over a scan with rules and sizes pushed into it."""
    if trusted_now(spark, path, snapshot_id, root, o):
        return None
    known = load(spark, path, snapshot_id, root)
    src = fs_tree.scan(spark, root, chain, min_size=o.min_size, max_size=o.max_size).where("not is_dir and error is null")
    return sync.plan(src, src.limit(0) if known is None else known[0], o, chain)


def changed(planned: DataFrame) -> bool:
    """Whether a plan does anything, which is when its manifest is written again."""
    return not planned.where("action <> 'skip'").isEmpty()


def as_destination(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("abs_path", F.concat_ws("/", F.lit(root), "rel_path"))


def by_directory(files: DataFrame) -> DataFrame:
    """(parent, files, bytes): what an incremental scan looks up by directory."""
    return files.groupBy(paths.parent(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def names_by_directory(files: DataFrame) -> DataFrame:
    """(parent, entries): the names, sizes and times of the files of each directory, by name."""
    entry = F.struct(paths.name(F.col("rel_path")).alias("name"), "size", "mtime_ns")
    return files.groupBy(paths.parent(F.col("rel_path")).alias("parent")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def parents(files: DataFrame) -> DataFrame:
    """The directories that files are in."""
    return files.select(paths.parent(F.col("rel_path")).alias("parent")).distinct()


def subdirectories(dirs: DataFrame) -> DataFrame:
    return dirs.where("rel_path <> ''").groupBy(paths.parent(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("dirs"))


def unchanged(now: DataFrame, before: DataFrame) -> DataFrame:
    """(dirs, changed, unchanged): whether every directory known before still has its time; a missing one has changed."""
    return changed_dirs(now, before).agg(F.count("*").alias("dirs"), F.count_if("changed").alias("changed"), F.coalesce(F.bool_and(~F.col("changed")), F.lit(True)).alias("unchanged"))


def incremental(now_files: DataFrame, now_dirs: DataFrame, was_files: DataFrame, was_dirs: DataFrame) -> DataFrame:
    """(rel_path, size, mtime_ns, origin): names of unchanged directories come from the manifest (`cached`), of
    others from a listing (`listed`); both are looked at live for size and time."""
    same = now_dirs.join(was_dirs, ["rel_path", "mtime_ns"], "left_semi").select(F.col("rel_path").alias("parent"))
    own = now_files.select("rel_path", "size", "mtime_ns", paths.parent(F.col("rel_path")).alias("parent"))
    known = was_files.select("rel_path", paths.parent(F.col("rel_path")).alias("parent")).join(same, "parent", "left_semi").select("rel_path")
    cached = own.join(known, "rel_path", "left_semi").select("rel_path", "size", "mtime_ns", F.lit("cached").alias("origin"))
    listed = own.join(same, "parent", "left_anti").select("rel_path", "size", "mtime_ns", F.lit("listed").alias("origin"))
    return cached.unionByName(listed)


def synced(planned: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """The destination's metadata after the plan was carried out without failures."""
    done = planned.where("action <> 'delete'").select("rel_path", F.col("action").alias("__action"))
    copied = src.join(done.where("__action <> 'skip'").select("rel_path"), "rel_path", "left_semi")
    left = dst.join(done.where("__action = 'skip'").select("rel_path"), "rel_path", "left_semi")
    return copied.select(*META).unionByName(left.select(*META))
