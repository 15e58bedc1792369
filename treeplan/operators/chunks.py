"""Fixed and content-defined chunks of file contents.

Fixed chunks are plain column expressions. Content-defined ones need a rolling hash with
carry, byte by byte; that is one kernel over Arrow batches, which takes their digests too, so
no content is sent back.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeplan.work import importable

MASK64 = (1 << 64) - 1
#: Fixed value: what the table of byte values is made from.
SEED = 0x123456789ABCDEF0


@lru_cache(maxsize=1)
def gear() -> tuple[int, ...]:
    """256 outputs of splitmix64."""
    out, state = [], SEED
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & MASK64
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK64
        out.append(z ^ (z >> 31))
    return tuple(out)


@dataclass(frozen=True)
class CdcParams:
    """target T: chunks have T/4 to 4T bytes unless given."""

    target: int
    least: int = 0
    most: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "least", self.least or self.target // 4)
        object.__setattr__(self, "most", self.most or self.target * 4)
        if self.target < 256 or self.least < 64 or not self.least < self.target < self.most:
            raise ValueError("a target of 256 or more, 64 <= least < target < most")

    @property
    def masks(self) -> tuple[int, int]:
        """Before and from the target: two bits more and two less than log2(target)."""
        bits = self.target.bit_length() - 1
        return (1 << min(bits + 2, 63)) - 1, (1 << max(bits - 2, 1)) - 1


#: Bytes whose hashes are held at a time (at least twice the largest chunk); bytes of a lane, and those it warms up on.
PIECE, LANE, WARM = 2 << 20, 1024, 128
#: A content up to this size that comes alone is stepped byte by byte: lanes cost as much as a thousand steps, however few there are.
ALONE = 16 << 10
#: So many open contents are stepped side by side; two answers beside the place of a cut.
MANY, NONE, UNKNOWN = 64, -1, -2


def running_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, never started anew: h = (h >> 1) + value of the byte, modulo 2^64.

    Lanes are hashed side by side, each from a guess: what it has after the WARM bytes before it. Shifts lose an older
    state within some 64 bytes, so guesses are right but for rare carries; each is held against the lane before, and a
    wrong one is hashed again from the true state until both agree."""
    table, n = np.array(gear(), np.uint64), len(raw)
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.uint8)
    grid[:n] = raw
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    h, one = np.zeros(lanes, np.uint64), np.uint64(1)
    for row in grid[LANE - WARM :]:
        h[1:] = (h[1:] >> one) + table[row[:-1]]
    guess, out = h, np.empty((LANE, lanes), np.uint64)
    for k, row in enumerate(grid):
        h = (h >> one) + table[row]
        out[k] = h
    flat = out.T.reshape(-1)[:n]
    for lane in (np.flatnonzero(guess[1:] != out[-1, :-1]) + 1).tolist():
        true = int(flat[lane * LANE - 1])
        for i in range(lane * LANE, n):
            true = (true >> 1) + gear()[raw[i]] & MASK64
            if true == int(flat[i]):
                break
            flat[i] = true
    return flat


def _following_many(raw: np.ndarray, running: np.ndarray, hits: list[np.ndarray], starts: np.ndarray, stops: np.ndarray, p: CdcParams) -> np.ndarray:
    """following() for many chunks side by side: where each next one starts, NONE without, UNKNOWN if its hash did not meet
    the running one soon."""
    table, one, out = np.array(gear(), np.uint64), np.uint64(1), np.full(len(starts), NONE)
    own = np.flatnonzero(starts + p.least < stops)  # others are too short to be cut
    first, stop, h = starts[own], stops[own], np.zeros(len(own), np.uint64)
    warm = min(p.least, WARM)
    for k in range(warm):  # no cut may be here
        h = (h >> one) + table[raw[first + k]]
    met = np.where(h == running[first + warm - 1], first + warm, UNKNOWN)
    open_, out[own] = np.flatnonzero(met == UNKNOWN), UNKNOWN
    h = h[open_]
    for k in range(warm, warm + WARM):
        at = first[open_] + k
        inside = at < stop[open_]
        out[own[open_[~inside]]] = NONE
        open_, h, at = open_[inside], h[inside], at[inside]
        if not len(open_):
            break
        h = (h >> one) + table[raw[at]]
        cut = np.zeros(len(at), bool) if k < p.least else np.ones(len(at), bool) if k >= p.most else (h & np.uint64(p.masks[k >= p.target])) == 0
        out[own[open_[cut]]] = at[cut]
        same = (h == running[at]) & ~cut
        met[open_[same]] = at[same] + 1
        keep = ~cut & ~same
        open_, h = open_[keep], h[keep]
    rest = np.flatnonzero(met != UNKNOWN)
    for found, low, high in ((hits[0], p.least, p.target), (hits[1], p.target, p.most)):
        if len(found):
            k = np.searchsorted(found, np.maximum(met[rest], first[rest] + low))
            next_ = found[np.minimum(k, len(found) - 1)]
            cut = (k < len(found)) & (next_ < np.minimum(first[rest] + high, stop[rest]))
            out[own[rest[cut]]] = next_[cut]
            rest = rest[~cut]
    last = first[rest] + p.most
    out[own[rest]] = np.where(last < stop[rest], last, NONE)
    return out


def _cuts(raw: np.ndarray, starts: list[int], p: CdcParams) -> list[list[int]]:
    """For each content raw[starts[i] : starts[i + 1]], where its chunks start, counted in raw.

    A chunk's own hash starts anew with it; it is stepped until it meets the running hash, from where on both are one
    and the next cut is the next hit of that. As long as many contents are open, their chunks are stepped side by side."""
    running, (hard, easy) = running_hashes(raw), p.masks
    places = [np.flatnonzero((running & np.uint64(m)) == 0) for m in (hard, easy)]
    hits, value = [x.tolist() for x in places], gear()

    def following(start: int, stop: int) -> int | None:
        h, met = 0, None
        for at in range(start, stop, WARM):
            for i, (x, other) in enumerate(zip(raw[at : min(at + WARM, stop)].tolist(), running[at : min(at + WARM, stop)].tolist()), at):
                h = (h >> 1) + value[x] & MASK64
                pos = i - start
                if pos >= p.least and (pos >= p.most or not h & (hard if pos < p.target else easy)):
                    return i
                if h == other:
                    met = i + 1
                    break
            if met is not None:
                break
        else:
            return None
        for found, low, high in ((hits[0], p.least, p.target), (hits[1], p.target, p.most)):
            k = bisect_left(found, max(met, start + low))
            if k < len(found) and found[k] < min(start + high, stop):
                return found[k]
        return start + p.most if start + p.most < stop else None

    out = [[start] if stop > start else [] for start, stop in zip(starts, starts[1:])]
    begin = np.array(starts, np.int64)
    active = np.flatnonzero(begin[1:] > begin[:-1])
    now = begin[active]
    while len(active) >= MANY:
        cut = _following_many(raw, running, places, now, begin[active + 1], p)
        for j in np.flatnonzero(cut == UNKNOWN).tolist():
            found = following(int(now[j]), int(begin[active[j] + 1]))
            cut[j] = NONE if found is None else found
        active, now = active[cut != NONE], cut[cut != NONE]
        for i, at in zip(active.tolist(), now.tolist()):
            out[i].append(at)
    for i in active.tolist():
        cuts, stop = out[i], starts[i + 1]
        while (cut := following(cuts[-1], stop)) is not None:
            cuts.append(cut)
    return out


def _stepped(data: bytes, p: CdcParams) -> list[int]:
    """boundaries(), by their definition."""
    value, (hard, easy), cuts = gear(), p.masks, [0]
    while cuts[-1] + p.least < len(data):
        start, h, cut = cuts[-1], 0, cuts[-1] + p.most
        target = start + p.target
        for x in data[start : start + p.least]:
            h = (h >> 1) + value[x] & MASK64
        for i, x in enumerate(data[start + p.least : cut], start + p.least):
            h = (h >> 1) + value[x] & MASK64
            if not h & (hard if i < target else easy):
                cut = i
                break
        if cut >= len(data):
            break
        cuts.append(cut)
    return cuts


def boundaries(data: bytes, p: CdcParams) -> list[int]:
    """Where chunks start. A hit byte belongs to the next chunk; hashing starts anew with it."""
    if not data:
        return []
    if len(data) <= ALONE:
        return _stepped(data, p)
    raw, cuts, size = np.frombuffer(data, np.uint8), [0], max(PIECE, 2 * p.most)
    while True:  # a cut depends on no byte after it, so the next piece starts at the last cut
        at = cuts[-1]
        part = raw[at : at + size]
        cuts += [at + c for c in _cuts(part, [0, len(part)], p)[0][1:]]
        if at + size >= len(raw):
            return cuts


def boundaries_of(contents: list[bytes], p: CdcParams) -> Iterator[list[int]]:
    """boundaries() of each, small ones hashed together."""
    at = 0
    while at < len(contents):
        to, total = at, 0
        while to < len(contents) and (to == at or total + len(contents[to]) <= PIECE):
            total += len(contents[to])
            to += 1
        if to == at + 1:
            yield boundaries(contents[at], p)
        else:
            starts = [0, *accumulate(map(len, contents[at:to]))]
            for start, cuts in zip(starts, _cuts(np.frombuffer(b"".join(contents[at:to]) or b"\0", np.uint8), starts, p)):
                yield [c - start for c in cuts]
        at = to


def content_of(files: DataFrame):
    """The bytes of files: their column `content`, or `text` in UTF-8."""
    return F.col("content") if "content" in files.columns else F.encode("text", "UTF-8")


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """(rel_path, idx, off, len, h) of files with `content` or `text`; empty files have none."""
    if size < 512:
        raise ValueError("chunks have 512 bytes or more")
    content, n = content_of(files), F.col("size")
    last = F.expr(f"(size + {size - 1}) div {size} - 1")
    rows = files.where("size > 0").select("rel_path", content.alias("content"), n.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx"))
    off = F.col("idx") * size
    chunk = F.expr(f"substring(content, cast(idx * {size} + 1 as int), {size})")
    return rows.select("rel_path", "idx", off.alias("off"), F.least(F.lit(size).cast("long"), F.col("size") - off).alias("len"), F.sha2(chunk, 256).alias("h"))


def cdc_chunks(files: DataFrame, target: int) -> DataFrame:
    """(rel_path, idx, off, len, h), content-defined."""
    p = CdcParams(target)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, PIECE):
                names, contents = part.column(0).to_pylist(), [c.as_buffer() if c.is_valid else pa.py_buffer(b"") for c in part.column(1)]
                path, idx, off, size, digest = [], [], [], [], []
                for name, data, starts in zip(names, map(memoryview, contents), boundaries_of(contents, p), strict=True):
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True)):
                        path.append(name), idx.append(k), off.append(a), size.append(b - a), digest.append(sha256(data[a:b]).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), *(pa.array(np.array(x, np.int64)) for x in (idx, off, size)), pa.array(digest, pa.string())], names=["rel_path", "idx", "off", "len", "h"])

    rows = _dealt(files.where("size > 0").select("rel_path", content_of(files).alias("content")))
    importable(rows.sparkSession)
    return rows.mapInArrow(cut, "rel_path string, idx long, off long, len long, h string")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt by path if they come from fewer table files than there are cores, and by the plan's estimate would give each core
    less than one scan partition: such a file may be one row group, so one task, and hashing a content costs several times what its
    exchange does. Larger tables, whose files are not listed for this, and live trees, whose size is not known beforehand, stay as they are read."""
    spark = rows.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return rows.repartition(cores, "rel_path") if small and 0 < len(rows.inputFiles()) < cores else rows


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose contents hold at most `limit` bytes together, or one row; nothing is copied."""
    at = total = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if k > at and total + size > limit:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < batch.num_rows:
        yield batch.slice(at)


def strategy(size, chunk_size: int):
    """cdc for files of at least four chunks, else fixed; empty files are fixed."""
    return F.when(size >= 4 * chunk_size, "cdc").otherwise("fixed")


def chunks(files: DataFrame, chunk_size: int) -> DataFrame:
    """(rel_path, idx, off, len, h, is_cdc) by the strategy of each file."""
    is_cdc = strategy(F.col("size"), chunk_size) == "cdc"
    return cdc_chunks(files.where(is_cdc), chunk_size).withColumn("is_cdc", F.lit(True)).unionByName(fixed_chunks(files.where(~is_cdc), chunk_size).withColumn("is_cdc", F.lit(False)))
