"""Live file trees: a Python data source for scanning, and a writer that carries out a plan."""

from __future__ import annotations

import errno
import filecmp
import hashlib
import json
import os
import re
import shutil
import socket
import stat
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeplan.functions import paths
from treeplan.functions.rules import Rule
from treeplan.operators.ranking import checkpointed
from treeplan.work import importable

SCHEMA = "rel_path string, is_dir boolean, size long, mtime_ns long, mode int, is_symlink boolean, symlink_target string, uid long, gid long, dev long, ino long, error string"


#: The end of a part's name that many tasks write to.
PLACED = ".treeplan-part"
#: Names of one directory that a partition looks at; a directory with more, if the driver opens it, is split.
WIDE = 50_000


class _Part(InputPartition):
    """Directories to read: (path, whether to walk on, share, shares). Of a split directory a part looks at the names whose hash is its share."""

    def __init__(self, tasks: list[tuple[str, bool, int, int]]) -> None:
        self.tasks = tasks


class FsTree(DataSource):
    """spark.read.format("fs_tree").load(root); options recursive, links (preserve or follow), one_file_system, subtrees, and what scan() pushes
    down: rules, prune_children, min_size, max_size.

    The root must be visible to all executors. Directories are opened level by level until there are `subtrees` of them (32) or no more;
    these, with what is below, are packed into at most `subtrees` partitions. A directory of over WIDE names that was opened so is split by
    name. Rows are files and directories, the root left out. What cannot be read becomes a row with `error`, links that
    lead nowhere are left out when they are followed."""

    @classmethod
    def name(cls) -> str:
        return "fs_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = os.path.abspath(options["path"])
        self.recursive = options.get("recursive", "true") == "true"
        self.follow = options.get("links", "preserve") == "follow"
        self.one = options.get("one_file_system", "false") == "true"
        self.subtrees = max(1, int(options.get("subtrees", "32")))
        self.chain = [(kind, re.compile(regex), dir_only, anchored) for kind, regex, dir_only, anchored in json.loads(options.get("rules", "[]"))]
        self.prune = options.get("prune_children", "false") == "true"
        self.least, self.most = int(options.get("min_size", "-1")), int(options.get("max_size", str(1 << 62)))

    def excluded(self, path: str, is_dir: bool) -> bool:
        for kind, regex, dir_only, anchored in self.chain:
            if (is_dir or not dir_only) and regex.search(path if anchored else path.rsplit("/", 1)[-1]):
                return kind == "exclude"
        return False

    def partitions(self) -> list[InputPartition]:
        if not self.recursive:
            return [_Part([("", False, 0, 1)])]
        tasks, level = [], [""]
        while level and len(level) < self.subtrees:
            below = []
            for rel in level:
                names, n = self._directories(rel)
                tasks += [(rel, False, k, shares) for shares in [-(-n // WIDE) or 1] for k in range(shares)]
                below += [f"{rel}/{name}" if rel else name for name in names]
            level = below
        tasks += [(rel, True, 0, 1) for rel in level]
        # the walked subtrees are dealt first, in turn, as they are the most work
        tasks.sort(key=lambda t: not t[1])
        return [_Part(tasks[k :: self.subtrees]) for k in range(min(self.subtrees, len(tasks)))]

    def _directories(self, rel: str) -> tuple[list[str], int]:
        """Names of the directories in one that would be walked into, and the number of all names; an unreadable one has none here and is told of
        by read()."""
        found, n = [], 0
        try:
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    n += 1
                    if e.is_dir(follow_symlinks=False) and self._walked(f"{rel}/{e.name}" if rel else e.name) and not (self.one and e.stat().st_dev != os.stat(self.root).st_dev):
                        found.append(e.name)
        except OSError:
            return [], 0
        return sorted(found), n

    def _walked(self, path: str) -> bool:
        return not (self.prune and self.excluded(path, True))

    def read(self, partition: _Part) -> Iterator[tuple]:
        dev = os.stat(self.root).st_dev
        todo = list(reversed(partition.tasks))
        while todo:
            rel, deep, share, shares = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, rel)) as found:
                    entries = sorted((e for e in found if shares == 1 or zlib.crc32(os.fsencode(e.name)) % shares == share), key=lambda e: e.name)
            except OSError as e:
                yield (rel, True, 0, 0, 0, False, None, 0, 0, 0, 0, str(e))
                continue
            for entry in entries:
                path = f"{rel}/{entry.name}" if rel else entry.name
                known_dir = entry.is_dir(follow_symlinks=False)
                out = self.excluded(path, known_dir)
                if out and (not known_dir or self.prune):
                    continue  # not looked at, nor what is below
                try:
                    info = entry.stat(follow_symlinks=False)
                    link = stat.S_ISLNK(info.st_mode)
                    if link and self.follow:
                        info, link = os.stat(entry.path), False
                except OSError as e:
                    if not self.follow:
                        yield (path, False, 0, 0, 0, False, None, 0, 0, 0, 0, str(e))
                    continue
                is_dir = stat.S_ISDIR(info.st_mode) and not (self.follow and entry.is_symlink())
                if is_dir and self.one and info.st_dev != dev:
                    continue
                size = 0 if link or is_dir else info.st_size
                if not out and (is_dir or self.least <= size <= self.most):
                    yield (path, is_dir, size, info.st_mtime_ns, info.st_mode & 0o7777, link, os.readlink(entry.path) if link else None, info.st_uid, info.st_gid, info.st_dev, info.st_ino, None)
                if is_dir and deep:
                    todo.append((path, True, 0, 1))


def scan(spark: SparkSession, root: str, chain: list[Rule] = (), prune_children: bool = False, min_size: int | None = None, max_size: int | None = None, **options: str) -> DataFrame:
    """Rows of FsTree. The rules of `chain` and the sizes are looked at where names are read: what is excluded is not looked at further, and with
    prune_children an excluded directory is not opened. Same rows as rules.kept() and size limits on files afterwards."""
    importable(spark)
    spark.dataSource.register(FsTree)
    pushed = {"rules": json.dumps([(r.kind, r.regex, r.dir_only, r.anchored) for r in chain])} if chain else {}
    pushed |= {"prune_children": "true"} if prune_children else {}
    pushed |= {k: str(v) for k, v in (("min_size", min_size), ("max_size", max_size)) if v is not None}
    return spark.read.format("fs_tree").options(**pushed, **options).load(root)


def stat_directories(root: str, names: Iterable[str | None]) -> Iterator[tuple[str, int]]:
    """(rel_path, mtime_ns) of those that are directories still: one look at each, and at no file."""
    for rel in names:
        try:
            info = os.lstat(os.path.join(root, rel)) if rel else os.stat(root)
        except OSError:
            continue
        if stat.S_ISDIR(info.st_mode):
            yield rel, info.st_mtime_ns


def times_now(dirs: DataFrame, root: str) -> DataFrame:
    """(rel_path, mtime_ns): the times that known directories (rel_path; the root is '') have now; those that are gone have no row. A new directory
    changes the time of the one it is in, so a tree is known to be unchanged without a listing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(stat_directories(root, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()))], names=["rel_path", "mtime_ns"])

    importable(dirs.sparkSession)
    return dirs.select("rel_path").where("rel_path is not null").mapInArrow(run, "rel_path string, mtime_ns long")


def digests(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, digest): SHA-256 of these files, read in blocks where the rows are, so of any size; null for links and what cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                digest = None
                try:
                    place = inside(root, path)
                    if not os.path.islink(place):
                        with open(place, "rb") as f:
                            digest = hashlib.file_digest(f, "sha256").hexdigest()
                except OSError:
                    pass
                out.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rel_path", "digest"])

    importable(files.sparkSession)
    return files.select("rel_path").mapInArrow(run, "rel_path string, digest string")


def inside(root: str, path: str) -> str:
    """The place of a relative path below root. Refused (OSError) are absolute and empty paths, those with a component `..`, and those whose parent
    directory is, by links, outside of root."""
    if not path or path.startswith("/") or "\0" in path or ".." in path.split("/"):
        raise OSError(errno.EPERM, "refused, as it may leave the root", path)
    top, parent = os.path.realpath(root), os.path.realpath(os.path.join(root, os.path.dirname(path)))
    if parent != top and not parent.startswith(top.rstrip("/") + "/"):
        raise OSError(errno.EPERM, "refused, as a link leads out of the root", path)
    return os.path.join(root, path)


def _destination(root: str, anywhere: bool) -> str:
    """The root of a writer, unless it is a system directory."""
    root = os.path.abspath(root)
    if not anywhere and re.match("/(" + "|".join(paths.SYSTEM_DIRS) + ")", root):
        raise ValueError(f"{root} begins like a system directory; anywhere=True allows it")
    return root


def contents(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, content binary, error): the bytes of these files (rel_path), read where the rows are. Symbolic links and
    what cannot be read have null. A file is one value, so up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = error = None
                try:
                    place = os.path.join(root, path)
                    if not os.path.islink(place):
                        with open(place, "rb") as f:
                            content = f.read()
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["rel_path", "content", "error"])

    importable(files.sparkSession)
    return files.select("rel_path").mapInArrow(run, "rel_path string, content binary, error string")


def ranges_of(root: str):
    """A reader for operators/segments.py: rows (rel_path, at, n, ...) get `data`, n bytes of the file from `at`. Rows are dealt first, so that the segments of
    one large file are read by many tasks. What cannot be read has null."""

    def read(wanted: DataFrame) -> DataFrame:
        kept = [c for c in wanted.columns if c not in ("rel_path", "at", "n")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, (path, at, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                    data = None
                    try:
                        f = os.open(inside(root, path), os.O_RDONLY | os.O_NOFOLLOW)
                        try:
                            data = b"".join(_blocks(f, at, n))
                        finally:
                            os.close(f)
                    except OSError:
                        pass
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([data], pa.binary())], names=[*batch.schema.names, "data"])

        rows = wanted.select("rel_path", "at", "n", *kept)
        importable(rows.sparkSession)
        return rows.repartition("rel_path", "at").mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())]))

    return read


def _blocks(f: int, at: int, n: int) -> Iterator[bytes]:
    """n bytes of an open file from `at`, or what there is; one call may give less."""
    while n > 0 and (data := os.pread(f, n, at)):
        yield data
        at, n = at + len(data), n - len(data)


def place_segments(segments: DataFrame, root: str, segment: int, anywhere: bool = False) -> DataFrame:
    """Writes segments (rel_path, seg, data) at their places in a part beside each file, many tasks at once: (rel_path, action, ok, error) for each
    segment. Done again, as after a lost executor, it writes the same. finish_segments() then puts the part in place."""
    root = _destination(root, anywhere)

    def act(row: dict) -> None:
        dst = inside(root, row["rel_path"])
        if row["data"] is None:
            raise OSError(errno.EINVAL, "a segment without data", row["rel_path"])
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        f = os.open(f"{dst}{PLACED}", os.O_WRONLY | os.O_CREAT | os.O_NOFOLLOW, 0o600)
        try:
            at, left = row["seg"] * segment, memoryview(row["data"])
            while left:
                done = os.pwrite(f, left, at)
                at, left = at + done, left[done:]
        finally:
            os.close(f)

    return _each(segments.select("rel_path", F.concat(F.lit("segment "), F.col("seg").cast("string")).alias("action"), "seg", "data"), act)


def finish_segments(files: DataFrame, placed: DataFrame, root: str, segment: int, anywhere: bool = False) -> DataFrame:
    """Puts the parts of files (rel_path, size, mtime_ns, mode) in place where `placed` has all their segments, written; else the part goes and the file
    stays as it was: (rel_path, action, ok, error)."""
    root = _destination(root, anywhere)
    counts = checkpointed(placed).groupBy("rel_path").agg(F.bool_and("ok").alias("all_ok"), F.count_distinct("action").alias("n"))
    good = counts.join(files.select("rel_path", F.expr(f"(size + {segment - 1}L) div {segment}L").alias("want")), "rel_path").select("rel_path", (F.col("all_ok") & (F.col("n") == F.col("want"))).alias("good"))
    rows = files.where("size > 0").select("rel_path", F.lit("place").alias("action"), "size", "mtime_ns", "mode").join(good, "rel_path")

    def act(row: dict) -> None:
        dst = inside(root, row["rel_path"])
        part = f"{dst}{PLACED}"
        if not os.path.lexists(part):
            info = os.stat(dst)
            if row["good"] and (info.st_size, info.st_mtime_ns) == (row["size"], row["mtime_ns"]):
                return  # done before, by a task that was lost
            raise OSError(errno.ENOENT, "no part", part)
        if row["good"] and os.path.getsize(part) > row["size"]:
            os.truncate(part, row["size"])  # left from an earlier, longer one
        if not row["good"] or os.path.getsize(part) != row["size"]:
            os.unlink(part)
            raise OSError(errno.EINVAL, "not all segments were written", row["rel_path"])
        os.chmod(part, row["mode"])
        os.utime(part, ns=(row["mtime_ns"],) * 2)
        os.replace(part, dst)

    return _each(rows, act)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files and their content, for the chunkers: read beside the metadata only where a plan asks for it."""
    return files.join(contents(files, root).where("content is not null").select("rel_path", "content"), "rel_path")


def extents(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, ord, logical, length): where these files hold data, the holes between left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    f = os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW)
                except OSError:
                    continue
                try:
                    at = n = 0
                    while True:
                        at = os.lseek(f, at, os.SEEK_DATA)
                        end = os.lseek(f, at, os.SEEK_HOLE)
                        rows.append((path, n, at, end - at))
                        at, n = end, n + 1
                except OSError:  # no data any more
                    pass
                finally:
                    os.close(f)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["rel_path", "ord", "logical", "length"])

    importable(files.sparkSession)
    return files.select("rel_path").mapInArrow(run, "rel_path string, ord int, logical long, length long")


def scan_again(root: str, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """A scan that reuses names: (rel_path, is_dir, size, mtime_ns, mode, is_symlink, symlink_target, uid, gid, dev, ino, error, origin).

    files and dirs (rel_path, mtime_ns; '' is the root) are those of the scan before. A directory whose time is the same is
    not listed: its names are known (`cached`). Others are listed, and directories new in them walked (`listed`). Every
    name is looked at live; what is gone is left out."""
    key = lambda frame: frame.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir"), F.struct(F.substring_index("rel_path", "/", -1).alias("name")).alias("e"))
    names = key(files).groupBy("dir").agg(F.sort_array(F.collect_list("e.name")).alias("names"))
    below = key(dirs.where("rel_path <> ''")).groupBy("dir").agg(F.sort_array(F.collect_list("e.name")).alias("dirs"))
    known = dirs.select(F.col("rel_path").alias("dir"), "mtime_ns").join(names, "dir", "left").join(below, "dir", "left")

    def row(path: str, info: os.stat_result, origin: str) -> tuple:
        link, is_dir = stat.S_ISLNK(info.st_mode), stat.S_ISDIR(info.st_mode)
        target = os.readlink(os.path.join(root, path)) if link else None
        return (path, is_dir, 0 if link or is_dir else info.st_size, info.st_mtime_ns, info.st_mode & 0o7777, link, target, info.st_uid, info.st_gid, info.st_dev, info.st_ino, None, origin)

    def walk(rel: str, old: set[str] | None) -> Iterator[tuple]:
        """old: directories that have a row of their own in `dirs`; those are not walked into."""
        try:
            with os.scandir(os.path.join(root, rel)) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            yield (rel, True, 0, 0, 0, False, None, 0, 0, 0, 0, str(e), "listed")
            return
        for entry in found:
            path = f"{rel}/{entry.name}" if rel else entry.name
            try:
                yield row(path, entry.stat(follow_symlinks=False), "listed")
            except OSError:
                continue
            if entry.is_dir(follow_symlinks=False) and entry.name not in (old or ()):
                yield from walk(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string())
        for batch in batches:
            for one in batch.to_pylist():
                rel, rows = one["dir"], []
                try:
                    same = os.stat(os.path.join(root, rel)).st_mtime_ns == one["mtime_ns"]
                except OSError:
                    continue  # gone; its parent's time tells
                if not same:
                    rows = list(walk(rel, set(one["dirs"] or [])))
                else:
                    for name in [*(one["names"] or []), *(one["dirs"] or [])]:
                        path = f"{rel}/{name}" if rel else name
                        try:
                            rows.append(row(path, os.lstat(os.path.join(root, path)), "cached"))
                        except OSError:
                            pass
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")] + ["origin"])

    importable(known.sparkSession)
    return known.select("dir", "mtime_ns", "names", "dirs").mapInArrow(run, SCHEMA + ", origin string")


def dir_times(root: str, scanned: DataFrame) -> DataFrame:
    """(rel_path, mtime_ns) of a scan's directories and of the root, as ''."""
    own = scanned.where("is_dir and error is null").select("rel_path", "mtime_ns")
    top = scanned.sparkSession.range(1).select(F.lit("").alias("rel_path"), F.lit(os.stat(root).st_mtime_ns).cast("long").alias("mtime_ns"))
    return own.unionByName(top)


DONE = "rel_path string, action string, ok boolean, error string"


def _each(rows: DataFrame, act) -> DataFrame:
    """(rel_path, action, ok, error) of act(row) for each row, a dict; what the file system refuses is a row, not an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                error = None
                try:
                    act(row)
                except OSError:
                    try:
                        act(row)
                    except OSError as e:
                        error = str(e)
                out.append((row["rel_path"], row["action"], error is None, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["rel_path", "action", "ok", "error"])

    importable(rows.sparkSession)
    return rows.mapInArrow(run, DONE)


def _replaced(dst: str, make) -> None:
    """make(part), then dst becomes part: a task that runs again after a lost executor does no harm."""
    part = f"{dst}.part{socket.gethostname()}-{os.getpid()}"
    if os.path.lexists(part):
        os.unlink(part)
    try:
        make(part)
        os.replace(part, dst)
    except OSError:
        if os.path.lexists(part):
            os.unlink(part)
        raise


def execute(planned: DataFrame, src_root: str, dst_root: str, backups: DataFrame | None = None, metadata: DataFrame | None = None, xattrs: bool = False, anywhere: bool = False) -> DataFrame:
    """Carries a plan out on file systems that all executors see: (rel_path, action, ok, error).

    Rows are dealt by path. Paths that would leave a root are refused: such a row has an error. backups (rel_path, backup_path, below dst_root): what a file is moved
    to before it is overwritten; metadata (as sync.final_metadata): what a copy ends with, nulls left as they are.
    Without it a copy has the source's mode, time and extended attributes; with it those attributes if xattrs is set.
    What fails is tried once more by itself."""
    dst_root = _destination(dst_root, anywhere)

    def act(row: dict) -> None:
        path, action = row["rel_path"], row["action"]
        if action == "skip":
            return
        dst = inside(dst_root, path)
        if action == "delete":
            if os.path.lexists(dst):
                os.unlink(dst)
            return
        src = inside(src_root, path)
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        if row.get("backup_path") and os.path.lexists(dst):
            to = inside(dst_root, row["backup_path"])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            # a copy, so that a task that dies between the two steps leaves the file in place
            _replaced(to, lambda part: shutil.copy2(dst, part, follow_symlinks=False))
        link = os.path.islink(src)

        def make(part: str) -> None:
            if link:
                os.symlink(os.readlink(src), part)
                return
            if "final_mode" not in row:
                shutil.copy2(src, part)
                return
            shutil.copyfile(src, part)
            for name in os.listxattr(src) if xattrs else ():
                os.setxattr(part, name, os.getxattr(src, name))
            own = [-1 if row[c] is None else row[c] for c in ("final_uid", "final_gid")]
            now = os.stat(part)
            if own[0] not in (-1, now.st_uid) or own[1] not in (-1, now.st_gid):
                os.chown(part, *own)
            if row["final_mode"] is not None:
                os.chmod(part, row["final_mode"])
            if row["final_mtime_ns"] is not None:
                os.utime(part, ns=(row["final_mtime_ns"],) * 2)

        _replaced(dst, make)

    rows = planned.select("rel_path", "action")
    if backups is not None:
        rows = rows.join(backups.select("rel_path", "backup_path"), "rel_path", "left")
    if metadata is not None:
        rows = rows.join(metadata.select("rel_path", "final_mode", "final_mtime_ns", "final_uid", "final_gid"), "rel_path", "left")
    return _each(rows.repartition("rel_path"), act)


def apply_ops(ops: DataFrame, src_root: str, dst_root: str, anywhere: bool = False) -> DataFrame:
    """Carries deltas out on live trees: (rel_path, action, ok, error). ops: rel_path, op_idx, kind, src_offset, len.

    A file's operations are done in order into a part beside it, copies from what is there, writes from the source,
    and the part takes its place. An operation that reaches beyond what it reads from is an error and changes nothing;
    done again, as after a lost executor, copies would read the new content, so a file whose content is the source's
    already is left alone."""
    rows, dst_root = ops.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("op_idx", "kind", "src_offset", "len"))).alias("ops")), _destination(dst_root, anywhere)

    def act(row: dict) -> None:
        src, dst = inside(src_root, row["rel_path"]), inside(dst_root, row["rel_path"])
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        if os.path.exists(dst) and os.path.getsize(dst) == os.path.getsize(src) and filecmp.cmp(src, dst, shallow=False):
            return

        def make(part: str) -> None:
            with open(src, "rb") as new, open(dst if os.path.exists(dst) else os.devnull, "rb") as old, open(part, "wb") as out:
                size = {f: os.fstat(f.fileno()).st_size for f in (new, old)}
                for op in row["ops"]:
                    f, at, left = old if op["kind"] == "copy" else new, op["src_offset"], op["len"]
                    if not 0 <= at <= at + left <= size[f]:
                        raise OSError(f"operation {op['op_idx']} reaches beyond {size[f]} bytes")
                    f.seek(at)
                    while left:
                        data = f.read(min(left, 4 << 20))
                        if not data:
                            raise OSError(f"operation {op['op_idx']} ends early")
                        out.write(data)
                        left -= len(data)
            shutil.copystat(src, part)

        _replaced(dst, make)

    return _each(rows.select("rel_path", F.lit("delta").alias("action"), "ops"), act)


def copy_sparse(planned: DataFrame, found: DataFrame, src_root: str, dst_root: str, anywhere: bool = False) -> DataFrame:
    """Copies files of a plan (rel_path, action) with their holes: (rel_path, action, ok, error). found: where they hold data, as extents() gives it.

    Only data is read and written, the part takes the source's size by being cut to it, and then the file's place. A file that has changed since its
    extents were read, so that they reach beyond its end, is an error and leaves the destination as it was."""
    dst_root = _destination(dst_root, anywhere)
    held = found.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("logical", "length"))).alias("extents"))
    rows = planned.where("action in ('copy_new', 'copy_full')").select("rel_path", "action").join(held, "rel_path", "left")

    def act(row: dict) -> None:
        src, dst = inside(src_root, row["rel_path"]), inside(dst_root, row["rel_path"])
        os.makedirs(os.path.dirname(dst), exist_ok=True)

        def make(part: str) -> None:
            with open(src, "rb") as new, open(part, "wb") as out:
                size = os.fstat(new.fileno()).st_size
                out.truncate(size)
                for e in row["extents"] or []:
                    if e["logical"] + min(e["length"], 1) > size:
                        raise OSError(errno.EIO, "changed since its extents were read", row["rel_path"])
                    _copied(new, e["logical"], out, e["logical"], min(e["length"], size - e["logical"]), None)
            shutil.copystat(src, part)

        _replaced(dst, make)

    return _each(rows, act)


class _Journal:
    """What a file held where it is written to in place, so that a task that is lost can be undone: records of (offset, length, bytes)."""

    HEAD = struct.Struct("<QQ")

    def __init__(self, path: str, old: BinaryIO, size: int) -> None:
        self.path, self.old, self.size = path, old, size
        with open(f"{path}.new", "wb") as f:
            f.write(self.HEAD.pack(size, 0))
        os.replace(f"{path}.new", path)
        self.out = open(path, "ab")  # noqa: SIM115 - closed by done()

    def save(self, at: int, n: int) -> None:
        self.old.seek(at)
        data = self.old.read(max(0, min(n, self.size - at)))
        if data:
            self.out.write(self.HEAD.pack(at, len(data)) + data)
            self.out.flush()

    def done(self) -> None:
        self.out.close()
        os.unlink(self.path)

    @classmethod
    def undo(cls, path: str, dst: str) -> None:
        """Puts a file back, the last record first; a record cut short was not followed by its write."""
        if not os.path.exists(path):
            return
        with open(path, "rb") as f, open(dst, "r+b") as out:
            size, places = cls.HEAD.unpack(f.read(cls.HEAD.size))[0], []
            while len(head := f.read(cls.HEAD.size)) == cls.HEAD.size:
                at, n = cls.HEAD.unpack(head)
                if f.tell() + n > os.fstat(f.fileno()).st_size:
                    break
                places.append((f.tell(), at, n))
                f.seek(n, os.SEEK_CUR)
            for where, at, n in reversed(places):
                f.seek(where)
                out.seek(at)
                out.write(f.read(n))
            out.truncate(size)
        os.unlink(path)


def apply_in_place(steps: DataFrame, files: DataFrame, src_root: str, dst_root: str, anywhere: bool = False) -> DataFrame:
    """Carries deltas out inside the destination's files, without a second copy: (rel_path, action, ok, error).

    steps as rebuild.in_place_steps() gives them; files (rel_path): what they are for, also those that only get another size or time. Bytes are saved
    to a journal beside the file before they are overwritten. A task that runs again, as after a lost executor, first undoes what the
    journal tells of; one that finds the source's size, time and bytes does nothing. An operation that reaches beyond what it reads from is an
    error that leaves the file as it was. Files with several links or none yet are better served by apply_ops()."""
    dst_root = _destination(dst_root, anywhere)
    per = steps.groupBy("rel_path").agg(F.collect_list(F.struct("phase", "op_idx", "kind", "off", "src_offset", "len")).alias("steps"))
    rows = files.select("rel_path", F.lit("in_place").alias("action")).join(per, "rel_path", "left")

    def act(row: dict) -> None:
        src, dst = inside(src_root, row["rel_path"]), inside(dst_root, row["rel_path"])
        log, spool = f"{dst}.treeplan-journal", f"{dst}.treeplan-spool"
        _Journal.undo(log, dst)
        want = os.stat(src)
        now = os.lstat(dst)
        if not stat.S_ISREG(now.st_mode):
            raise OSError(errno.EINVAL, "no regular file", row["rel_path"])
        if (now.st_size, now.st_mtime_ns) == (want.st_size, want.st_mtime_ns) and filecmp.cmp(src, dst, shallow=False):
            return
        todo = sorted(row["steps"] or [], key=lambda s: (s["phase"], -s["off"] if s["phase"] in (1, 2) and s["off"] > s["src_offset"] else s["off"]))
        for s in todo:
            size = now.st_size if s["kind"] == "copy" else want.st_size
            if not 0 <= s["src_offset"] <= s["src_offset"] + s["len"] <= size:
                raise OSError(errno.EINVAL, f"operation {s['op_idx']} reaches beyond {size} bytes")
        with open(src, "rb") as new, open(dst, "r+b") as out, open(dst, "rb") as old, open(spool, "w+b") as kept:
            places = []
            for s in todo:
                if s["phase"] == 0:
                    places.append((s, kept.tell()))
                    _copied(out, s["src_offset"], kept, kept.tell(), s["len"], None)
            journal = _Journal(log, old, now.st_size)
            for s in todo:
                if s["phase"] > 0:
                    _copied(out if s["kind"] == "copy" else new, s["src_offset"], out, s["off"], s["len"], journal)
            for s, at in places:
                _copied(kept, at, out, s["off"], s["len"], journal)
            if want.st_size < now.st_size:
                journal.save(want.st_size, now.st_size - want.st_size)
            out.truncate(want.st_size)
        shutil.copystat(src, dst)
        journal.done()
        os.unlink(spool)

    return _each(rows, act)


def _copied(source: BinaryIO, at: int, out: BinaryIO, to: int, n: int, journal: _Journal | None, block: int = 1 << 20) -> None:
    """n bytes from one place to another, also inside one file: in blocks from the end where they move ahead, else from the front."""
    starts = range(0, n, block)
    for k in reversed(starts) if source is out and to > at else starts:
        source.seek(at + k)
        data = source.read(min(block, n - k))
        if len(data) != min(block, n - k):
            raise OSError(errno.EIO, "a read ended early")
        if journal is not None:
            journal.save(to + k, len(data))
        out.seek(to + k)
        out.write(data)
        out.flush()


def link_up(links: DataFrame, dst_root: str, leader_root: str | None = None, anywhere: bool = False) -> DataFrame:
    """Makes files hard links of their leaders (rel_path, leader; as sync.hard_links), which must be there: run it after
    the copies. leader_root: where the leaders are, if not in dst_root (an older copy on the same file system)."""
    dst_root = _destination(dst_root, anywhere)
    base = leader_root or dst_root

    def act(row: dict) -> None:
        first, dst = inside(base, row["leader"]), inside(dst_root, row["rel_path"])
        if os.path.lexists(dst) and os.path.samefile(first, dst):
            return
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        _replaced(dst, lambda part: os.link(first, part, follow_symlinks=False))

    rows = links.select("rel_path", F.lit("link").alias("action"), "leader")
    return _each(rows if leader_root else rows.where("rel_path <> leader"), act)


def make_dirs(dirs: DataFrame, root: str, anywhere: bool = False) -> DataFrame:
    """Makes directories (rel_path), in any order."""
    root = _destination(root, anywhere)
    return _each(dirs.select("rel_path", F.lit("mkdir").alias("action")), lambda row: os.makedirs(inside(root, row["rel_path"]), exist_ok=True))


def remove_dirs(dirs: DataFrame, root: str, force: bool = False, anywhere: bool = False) -> DataFrame:
    """Removes directories (rel_path), the deepest first; with force what is in them too. Directories below one of
    the first level go in one task, as they wait for each other."""
    root = _destination(root, anywhere)

    def act(row: dict) -> None:
        path = inside(root, row["rel_path"])
        if not os.path.lexists(path):
            return
        if force:
            shutil.rmtree(path)
        else:
            os.rmdir(path)

    rows = dirs.select("rel_path", F.lit("rmdir").alias("action"), F.size(F.split("rel_path", "/")).alias("depth"))
    return _each(rows.repartition(F.substring_index("rel_path", "/", 1)).sortWithinPartitions(F.desc("depth")), act)
