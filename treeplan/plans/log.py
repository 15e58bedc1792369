"""The manifest as a log: each run adds the rows that it changed, and reading merges them.

`log/<number>` is an entry, made all at once and only if there is none of that number; it names the folder
with its rows, written before. Entries are `base`, a whole manifest, or `change`, rows of META that are new
or other than before, and paths that are gone. A crash leaves the state before an entry or after it, and
perhaps a folder that no entry names. An entry that can't be read, is not what was written, or is missing
between others leaves no manifest at all, as a manifest that is partly trusted is worse than none.
"""

from __future__ import annotations

import json
import uuid
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan import work
from treeplan.sources.snapshots import META

VERSION = 1
#: Changes after a base that reading merges before follow() makes a new base.
COMPACT = 16


class Entry(NamedTuple):
    number: int
    kind: str
    data: str
    source_path: str
    created_ns: int
    tag: str
    rows: int

    def text(self) -> str:
        body = json.dumps({**self._asdict(), "version": VERSION}, sort_keys=True)
        return json.dumps({"body": body, "check": zlib.crc32(body.encode())})


def _parsed(text: str | None) -> Entry | None:
    try:
        outer = json.loads(text)
        body = json.loads(outer["body"])
        if outer["check"] != zlib.crc32(outer["body"].encode()) or body.pop("version") != VERSION:
            return None
        return Entry(**body)
    except (TypeError, ValueError, KeyError):
        return None


def entries(spark: SparkSession, place: str) -> list[Entry] | None:
    """Entries from the last base on, in order; None if there is none, one is corrupt, or one is missing."""
    log, files = work.hadoop_path(spark, f"{place}/log")
    if not files.exists(log):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(log) if not s.getPath().getName().startswith("."))
    if not names:
        return None
    try:
        texts = {r.name: r.value for r in spark.read.text(f"{place}/log", wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), "value").collect()}
    except work.UNREADABLE:
        return None
    found: list[Entry] = []
    for name in reversed(names):
        entry = _parsed(texts.get(name))
        if entry is None or name != f"{entry.number:012d}" or (found and entry.number != found[0].number - 1):
            return None
        found.insert(0, entry)
        if entry.kind == "base":
            return found
    return None


def load(spark: SparkSession, place: str, source_path: str | None = None, before: int | None = None) -> DataFrame | None:
    """The manifest (META) after all entries, or those with a number below `before`; None if there is no valid one, or one of another source."""
    found = entries(spark, place)
    if found is None:
        return None
    used = [e for e in found if before is None or e.number < before]
    if not used or any(source_path not in (None, e.source_path) for e in used):
        return None
    try:
        return _merged(spark, place, used)
    except work.UNREADABLE:  # a folder is gone
        return None


def _merged(spark: SparkSession, place: str, used: list[Entry]) -> DataFrame:
    base = spark.read.parquet(f"{place}/{used[0].data}").select(*META)
    if len(used) == 1:
        return base
    changes = None
    for e in used[1:]:
        rows = spark.read.parquet(f"{place}/{e.data}").select(F.lit(e.number).alias("number"), "gone", F.struct(*META).alias("row"))
        changes = rows if changes is None else changes.unionByName(rows)
    last = changes.groupBy(F.col("row.rel_path").alias("rel_path")).agg(F.max_by(F.struct("gone", "row"), "number").alias("last"))
    kept = base.join(last.select("rel_path"), "rel_path", "left_anti").select(*META)
    return kept.unionByName(last.where("not last.gone").select("last.row.*"))


def changes(planned: DataFrame, src: DataFrame) -> DataFrame:
    """(META, gone): what carrying a plan out changes in the destination's manifest."""
    done = planned.where("action <> 'skip'").select("rel_path", (F.col("action") == "delete").alias("gone"))
    own = src.select(*META).join(done.where("not gone"), "rel_path").select(*META, "gone")
    none = [F.lit(None).cast(t).alias(c) for c, t in src.select(*META).dtypes if c != "rel_path"]
    return own.unionByName(done.where("gone").select("rel_path", *none, "gone").select(*META, "gone"))


def commit(spark: SparkSession, place: str, number: int, rows: DataFrame, source_path: str, kind: str = "change", tag: str = "", created_ns: int = 0) -> bool:
    """Adds an entry: rows are (META, gone), of a base (META). False, and nothing changes, if there is one of that number."""
    data = f"data-{uuid.uuid4().hex}"
    rows = rows.select(*META, "gone") if kind == "change" else rows.select(*META)
    rows.write.parquet(f"{place}/{data}")
    n = spark.read.parquet(f"{place}/{data}").count()
    done = work.put_if_absent(spark, f"{place}/log/{number:012d}", Entry(number, kind, data, source_path, created_ns, tag, n).text().encode())
    if not done:
        work.remove(spark, f"{place}/{data}")
    return done


def compact(spark: SparkSession, place: str) -> bool:
    """Adds a base that holds what all entries say; readers of older entries are not disturbed, see vacuum()."""
    found = entries(spark, place)
    if not found or len(found) == 1:
        return False
    last = found[-1]
    return commit(spark, place, last.number + 1, _merged(spark, place, found), last.source_path, "base", created_ns=last.created_ns)


def reset(spark: SparkSession, place: str) -> None:
    """Removes a log that entries() holds for none, so that a new one can begin."""
    if entries(spark, place) is None:
        work.remove(spark, place)


def vacuum(spark: SparkSession, place: str) -> None:
    """Removes entries before the last base, the oldest first, and folders that no entry names. Not while others read or write here."""
    found = entries(spark, place)
    if not found:
        return
    log, files = work.hadoop_path(spark, f"{place}/log")
    for name in sorted(s.getPath().getName() for s in files.listStatus(log)):
        if name.startswith(".") or name < f"{found[0].number:012d}":
            work.remove(spark, f"{place}/log/{name}")
    named = {e.data for e in found}
    for s in files.listStatus(work.hadoop_path(spark, place)[0]):
        if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named:
            work.remove(spark, s.getPath().toString())
