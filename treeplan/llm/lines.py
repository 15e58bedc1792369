"""Line dedup that documents can be added to and taken from: sharded cuckoo filters over exact references.

A reference says that a document holds a line's key. References are the truth, a table that only gets
rows, or loses those of documents that go. A cuckoo filter for each shard of the keys holds one
fingerprint of 16 bits for each distinct key, in one of two buckets; (fingerprint, buckets) is its cell.

Adding documents: the cells of their keys, one for each task and cell, are dealt to the shards and go
through the filter in turn. A cell that the filter holds already, or that a task met twice, is marked;
any other is new and enters. A key that two documents hold has its cell met twice, so it is always marked,
and only references in marked cells are counted exactly: lines that stand once, which are most, are never dealt
with their documents. Where several keys turn out to share a cell, the filter gets a copy for each. Taking
documents: keys without references left lose a copy. So filters and counts are after any order of steps what the
documents held now would give, and dedup is reversible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeplan.llm.shared import Members, attach, materialize, mixed, slices

WHITE = " \t\n\x0b\x0c\r"
#: Keys of fewer code points are never repeated lines.
LEAST = 10
#: Buckets of a shard's filter (a power of two), entries of a bucket, and the keys that a shard is made for.
BUCKETS, SLOTS, SHARD_KEYS = 1 << 14, 4, 40_000
#: How many times those keys make a shard too full, references counted for keys.
FULL = 1.25
#: Entries moved for one that finds no place, before it goes to the shard's list of homeless cells.
MOVES = 200
#: Bits of a cell: 16 of the fingerprint, then those of the smaller bucket.
_BUCKET_BITS = BUCKETS.bit_length() - 1
CELL_BITS = 16 + _BUCKET_BITS
#: Cells that a task holds before it passes them on.
HELD = 1 << 20
#: Null ids count as this one.
NO_ID = -(1 << 63)

FILTERS = "shard long, bits binary, homeless array<long>"


def _key(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def _places(keys: np.ndarray) -> np.ndarray:
    """Of 16-byte keys: 34 bits that choose a shard, then the cell."""
    h = keys.view("<u8").reshape(-1, 2)
    print_ = np.maximum(h[:, 1] & np.uint64(0xFFFF), 1)
    bucket = (h[:, 1] >> np.uint64(16)) & np.uint64(BUCKETS - 1)
    cell = print_ << np.uint64(_BUCKET_BITS) | np.minimum(bucket, bucket ^ _step(print_))
    return ((h[:, 0] >> np.uint64(CELL_BITS)) << np.uint64(CELL_BITS) | cell).view(np.int64)


def _step(print_: np.ndarray) -> np.ndarray:
    """What a fingerprint's two buckets differ by."""
    return mixed(print_) & np.uint64(BUCKETS - 1)


class Cuckoo:
    """A filter of cells: add, drop, and how many copies of a cell are held (no fewer than were added and not dropped)."""

    def __init__(self, bits: bytes | None = None, homeless: list[int] | None = None) -> None:
        self.table = np.zeros((BUCKETS, SLOTS), np.uint16) if bits is None else np.frombuffer(bits, np.uint16).reshape(BUCKETS, SLOTS).copy()
        self.homeless = list(homeless or [])

    @staticmethod
    def _parts(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (cells >> _BUCKET_BITS).astype(np.uint64)
        one = cells & (BUCKETS - 1)
        return print_.astype(np.uint16), one, one ^ _step(print_).astype(np.int64)

    def copies(self, cells: np.ndarray) -> np.ndarray:
        print_, one, two = self._parts(cells)
        n = (self.table[one] == print_[:, None]).sum(axis=1) + np.where(one == two, 0, (self.table[two] == print_[:, None]).sum(axis=1))
        if self.homeless:
            at, counts = np.unique(np.array(self.homeless), return_counts=True)
            k = np.minimum(np.searchsorted(at, cells), len(at) - 1)
            n = n + np.where(at[k] == cells, counts[k], 0)
        return n

    def add(self, cells: np.ndarray) -> None:
        for side in (1, 2):
            if not len(cells):
                return
            print_, bucket = self._parts(cells)[0], self._parts(cells)[side]
            order = np.argsort(bucket, kind="stable")
            cells, print_, bucket = cells[order], print_[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = np.cumsum(self.table[bucket] == 0, axis=1)
            fits = rank < free[:, -1]
            slot = (free == rank[:, None] + 1).argmax(axis=1)
            self.table[bucket[fits], slot[fits]] = print_[fits]
            cells = cells[~fits]
        for cell in cells.tolist():
            self._push(cell)

    def _push(self, cell: int) -> None:
        """Puts an entry into a full bucket; what stood there moves to its other bucket, and so on. In a filter that had no place before, no
        more is tried."""
        for move in range(0 if len(self.homeless) > SLOTS else MOVES):
            print_, one, two = (int(x[0]) for x in self._parts(np.array([cell])))
            bucket = one if move == 0 else two if bucket == one else one  # noqa: F821 - set by the move before
            free = np.flatnonzero(self.table[bucket] == 0)
            slot = int(free[0]) if len(free) else move % SLOTS
            was, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            if not was:
                return
            other = bucket ^ int(_step(np.array([was], np.uint64))[0])
            cell = was << _BUCKET_BITS | min(bucket, other)
        self.homeless.append(cell)

    def drop(self, cell: int) -> None:
        if cell in self.homeless:
            self.homeless.remove(cell)
            return
        print_, one, two = (int(x[0]) for x in self._parts(np.array([cell])))
        for bucket in (one, two):
            at = np.flatnonzero(self.table[bucket] == print_)
            if len(at):
                self.table[bucket, at[0]] = 0
                return


class Index(NamedTuple):
    """refs (id, tag, key, place): what documents hold; tag tells rows of one id apart. counts (key, refs, first, last): keys
    of at least two documents, with the smallest and largest. filters (shard, bits, homeless); `shards` of them."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, tag, key, place): one row for each row of docs and distinct key of at least `least` code points."""
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                lowered, rows, made = pc.ascii_lower(part.column(2)), [], []
                for i in range(part.num_rows):
                    own = {k for line in lowered[i].as_py().split("\n") if len(k := line.strip(WHITE)) >= least}
                    made += map(_key, own)
                    rows += [i] * len(own)
                at, raw = pa.array(rows, pa.int64()), b"".join(made)
                places = _places(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(made, pa.binary()), pa.array(places)], names=["id", "tag", "key", "place"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(_id(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id long, tag long, key binary, place long")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("place", CELL_BITS), F.lit(shards).cast("long"))


def _cell() -> Column:
    return F.col("place").bitwiseAND(F.lit((1 << CELL_BITS) - 1).cast("long"))


def _whole_cell(shards: int) -> Column:
    """Shard and cell as one number."""
    return F.shiftleft(_shard(shards), CELL_BITS).bitwiseOR(_cell())


def _met(refs: DataFrame, shards: int) -> DataFrame:
    """(shard, cell, n): how often a task met a cell; a task passes each on once, or once for every HELD cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells >> CELL_BITS), pa.array(cells & ((1 << CELL_BITS) - 1)), pa.array(np.minimum(counts, 2).astype(np.int32))], names=["shard", "cell", "n"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n > HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return refs.select(_whole_cell(shards).alias("cell")).mapInArrow(run, "shard long, cell long, n int")


def _turned(filters: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """(shard, bits, homeless, marks): each shard's filter after its rows (shard, cell, n) went through it one after another.

    kind: `met`, a cell was met n times: it enters if the filter has none, else is marked; `hold`, the filter shall hold n copies;
    `drop`, n copies go. A shard is one sorted run of rows, of which only the filter is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, marks = None, Cuckoo(), []

        def out() -> pa.RecordBatch:
            found = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            values = [[now], [held.table.tobytes()], [held.homeless], [(found | now << CELL_BITS).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["shard", "bits", "homeless", "marks"])

        def turn(cells: np.ndarray, n: np.ndarray) -> None:
            if kind == "met":
                cells, at = np.unique(cells, return_inverse=True)
                n = np.bincount(at, weights=n)
                known = held.copies(cells) > 0
                held.add(cells[~known])
                marks.append(cells[known | (n > 1)])
            elif kind == "hold":
                held.add(np.repeat(cells, np.maximum(n - held.copies(cells), 0)))
            else:
                for cell in np.repeat(cells, n).tolist():
                    held.drop(cell)

        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else [0]
            for a, b in zip(cut, cut[1:]):
                if shards[a] != now:
                    if now is not None:
                        yield out()
                    now, held, marks = int(shards[a]), Cuckoo(), []
                part = batch.slice(a, b - a)
                if not part.column(1)[0].as_py():
                    held = Cuckoo(part.column(4)[0].as_py(), part.column(5)[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    turn(part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False))
        if now is not None:
            yield out()

    none = [F.lit(None).cast(t).alias(c) for c, t in (("bits", "binary"), ("homeless", "array<long>"))]
    before = filters.select("shard", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("n"), "bits", "homeless")
    stream = before.unionByName(rows.select("shard", F.lit(1).alias("turn"), "cell", "n", *none))
    dealt = stream.repartition("shard").sortWithinPartitions("shard", "turn")
    return dealt.mapInArrow(run, FILTERS + ", marks array<long>")


def _counted(refs: DataFrame) -> DataFrame:
    """(key, refs, first, last) of keys that at least two documents hold."""
    return refs.groupBy("key").agg(F.count("*").alias("refs"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")


def empty(spark: SparkSession, keys: int = 0) -> Index:
    """An index without documents, made for about so many keys."""
    attach(spark)
    none = lambda schema: spark.createDataFrame([], schema)
    return Index(none("id long, tag long, key binary, place long"), none("key binary, refs long, first long, last long"), none(FILTERS), max(1, -(-keys // SHARD_KEYS)))


def insert(index: Index | None, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> Index:
    """The index with these documents too; rows it holds already must be removed first. Where shards would get too full all filters
    are made again first, for twice the keys."""
    new = materialize(references(docs, id_col, text_col, least), "references")
    n = new.count()
    index = index or empty(docs.sparkSession, n)
    n += index.refs.count()
    if n > index.shards * FULL * SHARD_KEYS:
        index = resharded(index, 2 * n)
    refs = index.refs.unionByName(new)
    turned = materialize(_turned(index.filters, _met(new, index.shards), "met"), "turned")
    may = Members(turned.select(F.explode("marks").alias("cell"))).may_hold(_whole_cell(index.shards))
    counted = materialize(_counted(refs.where(may)), "counts")
    # keys that share a cell: as many copies as keys
    keys = refs.where(may).select("key", "place").distinct()
    shared = keys.groupBy(_shard(index.shards).alias("shard"), _cell().alias("cell")).agg(F.count("*").cast("int").alias("n")).where("n > 1")
    filters = materialize(_turned(turned.select("shard", "bits", "homeless"), shared, "hold").drop("marks"), "filters")
    counts = index.counts.join(counted.select("key"), "key", "left_anti").unionByName(counted)
    return Index(refs, counts, filters, index.shards)


def remove(index: Index, ids: DataFrame, id_col: str = "doc_id") -> Index:
    """The index without the documents of these ids; ids it does not hold change nothing."""
    ids = materialize(ids.select(_id(id_col).alias("id")).distinct(), "gone")
    left = index.refs.join(ids, "id", "left_anti")
    touched = materialize(index.refs.join(ids, "id", "left_semi").select("key", "place").distinct(), "touched")
    again = left.where(Members(touched.select("place")).may_hold(F.col("place"))).join(touched.select("key"), "key", "left_semi")
    again = materialize(again.groupBy("key").agg(F.count("*").alias("refs"), F.min("id").alias("first"), F.max("id").alias("last")), "again")
    dead = touched.join(again, "key", "left_anti").groupBy(_shard(index.shards).alias("shard"), _cell().alias("cell")).agg(F.count("*").cast("int").alias("n"))
    filters = materialize(_turned(index.filters, dead, "drop").drop("marks"), "filters")
    counts = index.counts.join(touched.select("key"), "key", "left_anti").unionByName(again.where("first < last"))
    return Index(left, counts, filters, index.shards)


def resharded(index: Index, keys: int) -> Index:
    """The same references with filters made anew for about so many keys."""
    shards = max(1, -(-keys // SHARD_KEYS))
    cells = index.refs.select("key", "place").distinct().groupBy(_shard(shards).alias("shard"), _cell().alias("cell")).agg(F.count("*").cast("int").alias("n"))
    return Index(index.refs, index.counts, materialize(_turned(index.filters.limit(0), cells, "hold").drop("marks"), "filters"), shards)


def save(index: Index, path: str) -> None:
    """Writes the index below `path`, which must not exist; it is whole once `filters` is."""
    for name in ("refs", "counts", "filters"):
        table = getattr(index, name)
        (table.withColumn("shards", F.lit(index.shards)) if name == "filters" else table).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    attach(spark)
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.first()
    return Index(spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/counts"), filters.drop("shards"), first.shards if first else 1)


def known(index: Index, lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(line, found): whether a line may be held, by the filters alone: never false for one that is."""
    attach(lines.sparkSession)
    filters, shards = index.filters, index.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key((t or "").strip(WHITE)) for t in pc.ascii_lower(batch.column(0)).to_pylist()]
            places = _places(np.frombuffer(b"".join(keys), np.uint8)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places)], names=["line", "place"])

    asked = lines.select(F.col(f"`{line_col}`").alias("line")).mapInArrow(run, "line string, place long").select(_shard(shards).alias("shard"), "line", _cell().alias("cell"))

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(len(left), bool)
        if len(right) and len(left):
            found = Cuckoo(right.column("bits")[0].as_py(), right.column("homeless")[0].as_py()).copies(left.column("cell").to_numpy()) > 0
        return pa.table({"line": left.column("line"), "found": pa.array(found)})

    return asked.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look, "line string, found boolean")


def without_repeats(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept, kept_sha256), one row for each row of docs, which the index holds: lines whose key a document of
    smaller id holds too are dropped, the others joined as they stand. Rows the index does not hold keep all lines."""
    attach(docs.sparkSession)
    hash_of = F.xxhash64("key")
    likely = index.refs.where(Members(index.counts.select(hash_of)).may_hold(hash_of))
    # a key of very many documents is a skewed side of this join, which adaptive execution splits
    gone = likely.join(index.counts.select("key", "first"), "key").where("id <> first")
    gone = materialize(gone.groupBy("id", "tag").agg(F.collect_list("key").alias("gone")), "gone")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _id(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    # only documents that may lose lines are dealt to meet them
    hit = Members(gone.select("tag")).may_hold(F.col("tag"))
    met = rows.where(hit).join(gone, ["id", "tag"], "left").select("doc_id", "text", "gone")
    rest = rows.where(~hit).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lowered, out = pc.ascii_lower(part.column(1)), []
                for i, (text, gone) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    text, gone = text.as_py(), set(gone.as_py() or ())
                    if not gone:
                        out.append(((text or "").count("\n") + 1, 0, text, hashlib.sha256((text or "").encode()).hexdigest()))
                        continue
                    lines = text.split("\n")
                    stays = [line for line, low in zip(lines, lowered[i].as_py().split("\n"), strict=True) if _key(low.strip(WHITE)) not in gone]
                    kept = "\n".join(stays)
                    out.append((len(lines), len(lines) - len(stays), kept, hashlib.sha256(kept.encode()).hexdigest()))
                made = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])

    kinds = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept", T.StringType()), ("kept_sha256", T.StringType())]
    return met.unionByName(rest).mapInArrow(cut, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(c, t) for c, t in kinds]]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """without_repeats() of a new index over docs.

    A null or empty text is one empty line; null ids count as one document before all others; rows of one id are one document, so
    they keep what that document is the first to hold; lines shorter than `least` stay; a very long text is handled whole; an
    empty table gives no rows; other columns may have any names."""
    return without_repeats(insert(None, docs, id_col, text_col, least), docs, id_col, text_col)
