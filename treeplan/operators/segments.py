"""Contents of any size, in segments: no row holds more than a segment, and a file's segments are worked on side by side.

A segment is read with some bytes behind it and ahead of it. Content-defined chunks are cut from a guess: chunking starts behind the segment, and as
cuts depend on what is near, it has usually met the true cuts by where the segment begins. A segment then tells where its first chunk
starts and where the first chunk after it does. The guess is right if the segment before says the same; segments where it
is not are cut again from there, at once if a task has both, else in rounds, until all agree. Data that keeps no cuts, as a long run of one byte does, would need as many rounds as
it has segments, so after some rounds the files still open are walked from front to end, a segment at a time.

Operations are split where segments of what they read from and of the result begin, meet the segments they read in an exchange, and their pieces
meet in the segments of the result. Segments that no operation reads stay out of it.

Contents are the largest thing here, so they are dealt as seldom as can be: rows that hold theirs are cut where they are, and checked() takes
digests where the pieces of a small file are made, or as those of a larger one arrive, so that no result is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeplan.operators.chunks import PIECE, CdcParams, _dealt, boundaries, boundaries_of, content_of
from treeplan.operators.ranking import checkpointed
from treeplan.work import importable

#: Bytes of a segment, and rounds before what is still open is walked.
SEGMENT, ROUNDS = 64 << 20, 4
#: Segments that are few enough to be sent to all tasks by name, so that no contents are dealt to meet them.
FEW = 20_000
#: Bits of the map of segments that operations read: 16 MB. Where very many are read, it lets through some that are not.
MAP_BITS = 1 << 27
#: Segments of a file that lie in the same BLOCK bytes (or one, if larger) meet in a task; a result within the first is told of there.
BLOCK = 1 << 20

#: From ranges (rel_path, size, seg, at, n, ...) of files to the same rows with `data`, the bytes there.
Reader = Callable[[DataFrame], DataFrame]


def numbered(files: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(rel_path, size, seg) of each segment of files (rel_path, size); empty files have none."""
    last = F.expr(f"(size + {segment - 1}L) div {segment}L - 1")
    return files.where("size > 0").select("rel_path", F.col("size").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seg"))


def ranges(segments: DataFrame, segment: int, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Adds what is read of each: `at`, the first byte, and `n`, how many."""
    start = F.greatest(F.col("seg") * segment - behind, F.lit(0).cast("long"))
    stop = F.least(F.col("seg") * segment + segment + ahead, F.col("size"))
    return segments.withColumn("at", start).withColumn("n", stop - F.col("at"))


def from_rows(files: DataFrame) -> Reader:
    """Reads from rows with `content` or `text`."""
    held = files.select("rel_path", content_of(files).alias("content"))
    return lambda wanted: wanted.join(held, "rel_path").select(*wanted.columns, F.expr("substring(content, cast(at + 1 as int), cast(n as int))").alias("data"))


def _held(files: DataFrame) -> DataFrame:
    """(rel_path, content, size) of files with `content` or `text`, for _sliced()."""
    rows = _dealt(files.where("size > 0").select("rel_path", content_of(files).alias("content"), F.col("size").cast("long").alias("size")))
    importable(rows.sparkSession)
    return rows


def _sliced(batches: Iterator[pa.RecordBatch], segment: int, behind: int = 0, ahead: int = 0) -> Iterator[pa.RecordBatch]:
    """What a reader gives of all segments (rel_path, size, seg, entry, at, data) of rows (rel_path, content, size); a batch holds little more than PIECE bytes."""
    kinds = (("rel_path", pa.string()), ("size", pa.int64()), ("seg", pa.int64()), ("entry", pa.int64()), ("at", pa.int64()), ("data", pa.binary()))
    rows, total = [], 0
    for batch in batches:
        for path, content, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            held = memoryview(content.as_buffer()) if content.is_valid else None
            for seg in range(-(-size // segment)):
                at = max(seg * segment - behind, 0)
                data = None if held is None else bytes(held[at : seg * segment + segment + ahead])
                rows.append((path, size, seg, None if seg else 0, at, data))
                total += len(data or b"")
                if total >= PIECE:
                    yield _batch_of(rows, kinds)
                    rows, total = [], 0
    if rows:
        yield _batch_of(rows, kinds)


def read(files: DataFrame, reader: Reader | None = None, segment: int = SEGMENT) -> DataFrame:
    """(rel_path, size, seg, data): files (rel_path, size) in segments; without a reader, of their own `content` or `text`, which is not dealt."""
    if reader is None:
        names = ["rel_path", "size", "seg", "data"]
        return _held(files).mapInArrow(lambda batches: (b.select(names) for b in _sliced(batches, segment)), "rel_path string, size long, seg long, data binary")
    return reader(ranges(numbered(files, segment), segment)).select("rel_path", "size", "seg", "data")


_CUT = "rel_path string, size long, seg long, entry long, leave long, off array<long>, len array<long>, h array<binary>, before long"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64())
_NAMES = [c.split()[0] for c in _CUT.split(", ")]


def _row(path: str, size: int, seg: int, start: int, at: int, data: memoryview, cuts: list[int], segment: int, before: int | None = None) -> tuple:
    """Chunks that start in a segment, of those that were cut from `start`, where the first after it starts, and where known, how many are before."""
    begin, end = seg * segment, min((seg + 1) * segment, size)
    cuts = [start + c for c in cuts]
    own = [c for c in cuts if begin <= c < end]
    leave = next((c for c in cuts if c >= end), size)
    stops = [*own[1:], leave][: len(own)]
    return (path, size, seg, own[0] if own else leave, leave, own, [b - a for a, b in zip(own, stops)], [hashlib.sha256(data[a - at : b - at]).digest() for a, b in zip(own, stops)], before)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=_NAMES)


def _cut(files: DataFrame, reader: Reader | None, target: int, segment: int, rounds: int) -> DataFrame:
    """The columns of _CUT: true chunks of each segment, with digests as bytes."""
    p = CdcParams(target)
    if segment < p.most:
        raise ValueError(f"segments of at least the largest chunk, {p.most}")
    behind, here = 4 * p.most, reader is None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ("", -1, 0, 0)  # path, number and leave of the segment before, and chunks up to its end
        for batch in batches:  # small segments are hashed together
            rows = [(*r, memoryview(data.as_buffer())) for *r, data in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True) if data.is_valid]
            if not here:
                rows.sort(key=lambda r: (r[0], r[2]))
            starts = [at if entry is None else entry for _, _, _, entry, at, _ in rows]
            found = boundaries_of([data[start - at :] for start, (*_, at, data) in zip(starts, rows, strict=True)], p)
            out = []
            for start, cuts, (path, size, seg, _, at, data) in zip(starts, found, rows, strict=True):
                true = last[2] if last[:2] == (path, seg - 1) else None
                if true is not None and true != next((start + c for c in cuts if start + c >= seg * segment), size):
                    start, cuts = true, boundaries(data[true - at :], p)
                before = 0 if seg == 0 else last[3] if true is not None else None
                out.append(_row(path, size, seg, start, at, data, cuts, segment, before))
                last = (path, seg, out[-1][4], (before or 0) + len(out[-1][5]))
            yield _batch(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, entry = None, 0
        for batch in batches:
            for path, size, seg, first, at, data in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                held, start = memoryview(data.as_buffer()), entry if path == last else first
                row = _row(path, size, seg, start, at, held, boundaries(held[start - at :], p), segment)
                last, entry = path, row[4]
                yield _batch([row])

    def made(wanted: DataFrame, how=cut, few: bool = False) -> DataFrame:
        """wanted: (rel_path, size, seg, entry)."""
        asked = ranges(wanted, segment, behind, p.most)
        got = reader(F.broadcast(asked) if few else asked).select("rel_path", "size", "seg", "entry", "at", "data").where("data is not null")
        if how is walk:
            got = got.repartition("rel_path").sortWithinPartitions("rel_path", "seg")
        importable(got.sparkSession)
        return got.mapInArrow(how, _CUT)

    if here:  # a task has all segments of its files in order, so each meets the one before and no guess is left
        return _held(files).mapInArrow(lambda batches: cut(_sliced(batches, segment, behind, p.most)), _CUT)
    all_ = numbered(files, segment).withColumn("entry", F.when(F.col("seg") == 0, F.lit(0).cast("long")))
    now, order = checkpointed(made(all_)), Window.partitionBy("rel_path").orderBy("seg")
    for round_ in range(rounds + 1):
        told = now.select("rel_path", "size", "seg", "entry", F.coalesce(F.lag("leave").over(order), F.lit(0).cast("long")).alias("begins"))
        wrong = checkpointed(told.where("entry <> begins").select("rel_path", "size", "seg", F.col("begins").alias("entry")))
        open_ = wrong.count()
        if not open_:
            break
        few = open_ <= FEW
        if round_ == rounds:  # from the first wrong one on, in order
            first = wrong.groupBy("rel_path").agg(F.min(F.struct("seg", "entry")).alias("first"))
            rest = now.select("rel_path", "size", "seg").join(first, "rel_path").where("seg >= first.seg")
            again = checkpointed(made(rest.select("rel_path", "size", "seg", F.when(F.col("seg") == F.col("first.seg"), F.col("first.entry")).alias("entry")), walk))
        else:
            again = checkpointed(made(wrong, few=few))
        done = again.select("rel_path", "seg")
        now = checkpointed(now.join(F.broadcast(done) if few and round_ < rounds else done, ["rel_path", "seg"], "left_anti").unionByName(again))
    return now


def cdc_chunks(files: DataFrame, reader: Reader | None, target: int, segment: int = SEGMENT, rounds: int = ROUNDS) -> DataFrame:
    """(rel_path, idx, off, len, h) of files (rel_path, size), the same as chunks.cdc_chunks() whatever the segments; without a reader,
    files hold their `content` or `text`, which is cut where it is."""
    now, order = _cut(files, reader, target, segment, rounds), Window.partitionBy("rel_path").orderBy("seg")
    if reader is not None:
        before = F.coalesce(F.sum(F.size("off")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = now.select("rel_path", "seg", before.alias("before"))
        now = now.drop("before").join(counts, ["rel_path", "seg"])
    rows = now.select("rel_path", "before", F.posexplode(F.arrays_zip("off", "len", "h")).alias("k", "c"))
    return rows.select("rel_path", (F.col("before") + F.col("k")).alias("idx"), "c.off", "c.len", F.lower(F.hex("c.h")).alias("h"))


def cdc_places(files: DataFrame, reader: Reader | None, target: int, segment: int = SEGMENT, rounds: int = ROUNDS) -> DataFrame:
    """cdc_chunks() for delta.by_hash(), with no exchange: `idx` is a chunk's place, which has the same order, and `h` the digest as bytes."""
    rows = _cut(files, reader, target, segment, rounds).select("rel_path", F.explode(F.arrays_zip("off", "len", "h")).alias("c"))
    return rows.select("rel_path", F.col("c.off").alias("idx"), "c.off", "c.len", "c.h")


def fixed_chunks(files: DataFrame, reader: Reader | None, size: int, segment: int = SEGMENT) -> DataFrame:
    """(rel_path, idx, off, len, h); `size` divides `segment`."""
    if size < 512 or segment % size:
        raise ValueError("chunks have 512 bytes or more and fill segments")
    per, data = segment // size, read(files, reader, segment)
    rows = data.select("rel_path", "seg", "data", F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(data) + {size - 1}) div {size} - 1 as int)"))).alias("k"))
    rows = rows.select("rel_path", (F.col("seg") * per + F.col("k")).alias("idx"), F.expr(f"substring(data, k * {size} + 1, {size})").alias("chunk"))
    return rows.select("rel_path", "idx", (F.col("idx") * size).alias("off"), F.octet_length("chunk").cast("long").alias("len"), F.sha2("chunk", 256).alias("h"))


def _within(place: Column, n: Column, segment: int) -> Column:
    """The numbers of the segments that a range of n > 0 bytes touches."""
    return F.sequence(F.floor(place / segment), F.floor((place + n - 1) / segment))


def _read_of(side: DataFrame, used: DataFrame) -> DataFrame:
    """Rows of side (rel_path, kind, seg, ...) that used (rel_path, kind, seg) has too, and few others: a bit map of bounded size tells, so that
    contents need not be dealt to know."""
    bit = F.pmod(F.xxhash64("rel_path", "kind", "seg"), F.lit(MAP_BITS)) + 1
    bits = used.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
    map_ = bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    both = side.withColumn("place", F.bitmap_bit_position(bit)).withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(map_), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return both.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(*side.columns)


#: Rows of pieces: by the segment of the result that they belong to, the bytes at a place; without a place the digest that is wanted of the
#: segment; with a size what _told() says of a whole file, as segment -1.
_PIECE = (("rel_path", pa.string()), ("seg", pa.int64()), ("to", pa.int64()), ("data", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("ok", pa.bool_()))
_PIECES = "rel_path string, seg long, to long, data binary, size long, digest string, ok boolean"


def _batch_of(rows: list[tuple], kinds: tuple = _PIECE) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _made(ops: DataFrame, new: DataFrame, old: DataFrame, segment: int, tell: bool = False) -> DataFrame:
    """The pieces of results, as _PIECES. With `tell`, the digests that are wanted too, and of files whose operations read and write within
    the first block only what _told() says."""
    S, per, none = segment, max(BLOCK // segment, 1), F.lit(None).cast("long")
    ops = ops.where("len > 0")
    used = ops.select("rel_path", "kind", "off", "src_offset", "len", F.explode(_within(F.col("src_offset"), F.col("len"), S)).alias("seg"))
    lo, hi = F.greatest(F.col("src_offset"), F.col("seg") * S), F.least(F.col("src_offset") + F.col("len"), (F.col("seg") + 1) * S)
    parts = used.select("rel_path", "kind", "seg", lo.alias("lo"), (hi - lo).alias("n"), (F.col("off") + lo - F.col("src_offset")).alias("to"))
    parts = parts.select("*", F.explode(_within(F.col("to"), F.col("n"), S)).alias("out"))
    lo, hi = F.greatest(F.col("to"), F.col("out") * S), F.least(F.col("to") + F.col("n"), (F.col("out") + 1) * S)
    parts = parts.select("rel_path", "kind", "seg", "out", lo.alias("to"), (F.col("lo") + lo - F.col("to") - F.col("seg") * S).alias("at"), (hi - lo).alias("n"), F.lit(None).cast("binary").alias("data"))
    side = lambda f, kind, data="data": f.select("rel_path", F.lit(kind).alias("kind"), "seg", none.alias("out"), none.alias("to"), none.alias("at"), none.alias("n"), data)
    stream = _read_of(side(new, "write").unionByName(side(old, "copy")), used).unionByName(parts)
    if tell:
        ends = ops.groupBy("rel_path").agg(F.max(F.greatest("off", "src_offset") + F.col("len")).alias("end"), F.min(F.least("off", "src_offset")).alias("start"))
        first = ends.where(f"start >= 0 and end <= {per * S}L").select("rel_path", F.lit(0).cast("long").alias("seg"), F.lit(None).cast("binary").alias("data"))
        stream = stream.unionByName(side(first, " first")).unionByName(side(new, " want", F.unhex(F.sha2("data", 256)).alias("data")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, held = None, None, b""
        rows, total = [], 0  # to be sent
        own, size = None, 0  # pieces of a file that is whole here, else None

        def closed() -> list[tuple]:
            found = sorted(own, key=lambda r: (r[1], r[2] is not None, r[2]))
            size, digest, ok, _ = _told(_results(found, S))
            return [(group[0], -1, None, None, size, digest, ok)]

        for batch in batches:
            for k, (path, kind, seg, out, to, at, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)):
                if (path, seg // per) != group:
                    if own is not None:
                        rows += closed()
                    group, own, size = (path, seg // per), None, 0
                if total >= PIECE or len(rows) >= 1000:
                    yield _batch_of(rows)
                    rows, total = [], 0
                if kind == " first":
                    own = []
                    continue
                if kind == " want":
                    row = (path, seg, None, batch.column(7)[k].as_py(), None, None, None)
                elif out is None:
                    key, held = (path, kind, seg), memoryview(batch.column(7)[k].as_buffer())
                    continue
                else:
                    data = bytes(held[at : at + n]) if (path, kind, seg) == key else b""
                    row = (path, out, to, data if len(data) == n else None, None, None, None)
                (rows if own is None else own).append(row)
                if own is None:
                    total += n or 0
                elif (size := size + (n or 0)) > per * S:  # operations that write the same places
                    rows, total, own = rows + own, total + size, None
        if own is not None:
            rows += closed()
        if rows:
            yield _batch_of(rows)

    block = F.floor(F.col("seg") / per)
    dealt = stream.repartition("rel_path", block).sortWithinPartitions("rel_path", block, "kind", "seg", F.col("out").isNotNull())
    importable(dealt.sparkSession)
    return dealt.mapInArrow(pieces, _PIECES)


def _results(rows: Iterable[tuple], segment: int) -> Iterator[tuple[str, int, bool, bytes | None, bytes | None]]:
    """(path, seg, whether it has pieces, data, wanted digest) from pieces in order, a segment at a time; data is None without a row of pieces that has no gap."""
    key, parts, end, want = None, [], 0, None
    whole = lambda: (*key, bool(parts), b"".join(parts) if parts and None not in parts else None, want)
    for path, seg, to, data, *_ in rows:
        if (path, seg) != key:
            if key is not None:
                yield whole()
            key, parts, end, want = (path, seg), [], seg * segment, None
        if to is None:
            want = data
            continue
        parts.append(data if data is not None and to == end else None)
        end = to + len(data or b"")
    if key is not None:
        yield whole()


def _told(results: Iterable[tuple]) -> tuple[int, str | None, bool, int]:
    """Of one file: size and digest, null where a segment is null or missing, whether all segments are as wanted, and behind the last that has pieces."""
    held, size, good, same, after = hashlib.sha256(), 0, True, True, 0
    for _, seg, some, data, want in results:
        same &= data is not None and want == hashlib.sha256(data).digest()
        if some:
            good &= data is not None and seg == after
            if good:
                held.update(data)
                size += len(data)
            after = seg + 1
    return size, held.hexdigest() if good else None, same, after


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def rebuilt(ops: DataFrame, new: DataFrame, old: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(rel_path, seg, data): the results of operations, in segments; new and old as read() gives them, with the same `segment`.

    data is null where an operation reaches beyond what it reads from or none writes a byte. An empty result has no rows.
    Pieces of one old segment that very many operations copy are made in one task, which holds only the segment."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, seg, _, data, _ in _results(_rows(batches), segment):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seg], pa.int64()), pa.array([data], pa.binary())], names=["rel_path", "seg", "data"])

    made = _made(ops, new, old, segment).select("rel_path", "seg", "to", "data")
    return made.repartition("rel_path", "seg").sortWithinPartitions("rel_path", "seg", "to").mapInArrow(joined, "rel_path string, seg long, data binary")


def checked(ops: DataFrame, new: DataFrame, old: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(rel_path, size, digest, ok): what digests() and verified() tell of rebuilt(), where it has rows, in one pass.

    A file within one block is told of where its pieces are made. Pieces of others pass through the task of their file in order, as for any
    digest of a whole file, a segment at a time, and meet the digests of the segments that are wanted; no result is written or dealt once more."""
    kinds = (("rel_path", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("ok", pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, group in groupby(_rows(batches), key=lambda r: r[0]):
            first = next(group)
            if first[4] is not None:  # told already; what else there is of the file are segments that are wanted beyond its result
                rows.append((path, first[4], first[5], first[6] and next(group, None) is None))
            else:
                size, digest, ok, some = _told(_results(chain([first], group), segment))
                if some:
                    rows.append((path, size, digest, ok))
            if len(rows) >= 1000:
                yield _batch_of(rows, kinds)
                rows = []
        if rows:
            yield _batch_of(rows, kinds)

    made = _made(ops, new, old, segment, tell=True)
    return made.repartition("rel_path").sortWithinPartitions("rel_path", "seg", "to").mapInArrow(run, "rel_path string, size long, digest string, ok boolean")


def digests(segments: DataFrame) -> DataFrame:
    """(rel_path, size, digest): SHA-256 of whole contents from their segments, which pass through a task in order, one at a time; null if one is null or missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, size, good, after = None, hashlib.sha256(), 0, True, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([held.hexdigest() if good else None], pa.string())], names=["rel_path", "size", "digest"])

        for batch in batches:
            for k, (name, seg) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if name != path:
                    if path is not None:
                        yield out()
                    path, held, size, good, after = name, hashlib.sha256(), 0, True, 0
                data = batch.column(2)[k]
                good &= data.is_valid and seg == after
                if good:
                    held.update(data.as_buffer())
                    size += data.as_buffer().size
                after = seg + 1
        if path is not None:
            yield out()

    rows = segments.select("rel_path", "seg", "data").repartition("rel_path").sortWithinPartitions("rel_path", "seg")
    importable(rows.sparkSession)
    return rows.mapInArrow(run, "rel_path string, size long, digest string")


def verified(result: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, size, ok): whether results and sources have equal segments; no content is whole anywhere."""
    short = lambda f, c: f.select("rel_path", "seg", F.octet_length("data").cast("long").alias(f"{c}n"), F.sha2("data", 256).alias(c))
    both = short(new, "want").join(short(result, "got"), ["rel_path", "seg"], "full")
    return both.groupBy("rel_path").agg(F.coalesce(F.sum("gotn"), F.lit(0)).cast("long").alias("size"), F.bool_and(F.coalesce(F.col("want") == F.col("got"), F.lit(False))).alias("ok"))
