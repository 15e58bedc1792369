"""Substring dedup: every repeated word window goes but its first occurrence.

A window is `size` consecutive words of a document. Pass one finds each window's anchor,
the least hash of the `gram`-word grams inside it (equal windows have equal anchors, and
some (size - gram) windows in a row share one), and adds the anchors to a count-min sketch:
two rows of counters, cut into blocks, an anchor's counters all in one block. Each run of
documents sends its part of a block, and parts are merged by block. Merged counters only
ever overestimate, so a window whose anchor is estimated to occur once is unique and needs
no more work. Pass two exactly groups the other windows by the 128-bit BLAKE2b digest of
their words:

* within a run, a window met before (in document order) is decided on the spot, so a group
  sends one row from each run at most, however many copies it has;
* across runs, windows meet by an exchange on their anchor, and those of one digest are
  ranked by document and place.

The sketch grows with the text (a counter of each row for eight bytes, about four for each
anchor), so the share of unique windows that pass is the same at every size. It is never
gathered or broadcast: its blocks stay where they were merged, the anchors are dealt to
them, and those estimated repeated go back to their documents. No window is ever lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from treeplan.llm.shared import attach, discard, materialize, Members, mixed, exactly, slices, utf8

#: Rows of counters; a merged counter is kept as one bit (counted twice or not).
ROWS = 2


@dataclass(frozen=True)
class Sizes:
    """Bounds that change the work and no result."""

    #: Text bytes for each counter of a row.
    counted: int = 8
    #: Counters of a block in a row are two to the power of this: at least, and at most; in between so that there are some `blocks`.
    block_bits: tuple[int, int] = (20, 23)
    blocks: int = 4096
    #: Windows that a task holds before it sends what it has decided.
    held: int = 300_000
    #: Text bytes that are hashed at a time; some 20 arrays of eight bytes for each are alive meanwhile.
    step: int = 1 << 19


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    key, most = int(base), 1 << max(12, (n - 1).bit_length())
    table = _TABLES.get((key, most))
    if table is None:
        table = np.ones(most, np.uint64)
        table[1:] = base
        table = _TABLES[key, most] = np.multiply.accumulate(table)
    return table


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts raw[starts[i] : starts[i + 1]]: for each a 64-bit hash and its text's number.

    A word's hash is a polynomial of its bytes modulo 2^64, its length mixed in. Unlike words can be made that share
    it, so it only picks anchors, where that costs work and no result."""
    blank = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts[:-1][starts[:-1] < len(raw)]] = True
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = inside.copy()
    last[:-1] &= blank[1:] | edge[1:-1]
    end = np.flatnonzero(last) + 1
    size = (end - begin).astype(np.uint64)
    table, sums = _powers(_BASE, len(raw) + 1), np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * table[: len(raw)], out=sums[1:])
    back = _powers(_inverse(_BASE), len(raw) + 1)
    return mixed((sums[end] - sums[begin]) * back[begin] + size * _STEP), np.searchsorted(starts, begin, side="right") - 1


def _rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each n neighbours of h."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * base + h[k : k + len(out)]
    return mixed(out)


class Windows:
    """The windows of some texts: .doc (number of text), .at (first word), .anchor (hash)."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, size: int, gram: int) -> None:
        h, text = word_hashes(raw, starts)
        words = np.bincount(text, minlength=len(starts) - 1)
        self.doc = self.at = self._spot = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(h) < size:
            return
        offset = np.concatenate([[0], np.cumsum(words)])[:-1]
        whole = np.flatnonzero(text[: len(h) - size + 1] == text[size - 1 :])
        grams = _rolled(h, gram, _STEP)
        least, span = grams[: len(h) - size + 1].copy(), size - gram + 1
        spot = np.arange(len(least))
        for k in range(1, span):  # ties: the first of the window
            own = grams[k : k + len(least)]
            less = own < least
            least[less] = own[less]
            spot[less] = np.flatnonzero(less) + k
        self.doc, self.at, self.anchor, self._spot = text[whole], whole - offset[text[whole]], least[whole], spot[whole]

    def heads(self) -> np.ndarray:
        """Of the windows that share a place of their anchor the first."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self._spot[1:] != self._spot[:-1]) | (self.doc[1:] != self.doc[:-1])  # places never go back from window to window
        return np.flatnonzero(new)


def digests(text: str, starts: list[int], size: int) -> list[bytes]:
    """BLAKE2b (128 bits) of the words of the windows that start at these words, joined by one space."""
    words = text.encode("utf-8", "replace").split()  # bytes: ASCII white space only
    line, at = b" ".join(words), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    return [hashlib.blake2b(line[at[k] : at[k + size] - 1], digest_size=16).digest() for k in starts]


class Layout:
    """How many blocks of how many counters a sketch of so many text bytes has, and where an anchor's counters are."""

    def __init__(self, text_bytes: int, sizes: Sizes) -> None:
        counters = max(1, text_bytes // sizes.counted)
        self.sizes = sizes
        self.bits = min(max((counters // sizes.blocks).bit_length(), sizes.block_bits[0]), sizes.block_bits[1])
        self.blocks = max(1, -(-counters // (1 << self.bits)))

    def block(self, anchors: np.ndarray) -> np.ndarray:
        high = mixed(anchors ^ _BASE) >> np.uint64(32)
        return (high * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)

    def cell(self, anchors: np.ndarray, row: int) -> np.ndarray:
        """Within the block: the place of the counter among those of all rows."""
        return (mixed(anchors + np.uint64((row + 1) * int(_STEP) % 2**64)) >> np.uint64(64 - self.bits)).astype(np.int64) + (row << self.bits)

    def repeated(self, bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Whether all counters of each anchor of a block counted two or more."""
        out = np.ones(len(anchors), bool)
        for row in range(ROWS):
            at = self.cell(anchors, row)
            out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _runs(batch: pa.RecordBatch, text: int, step: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, text, step):
        yield part, *utf8(part.column(text))


def sketch(docs: DataFrame, layout: Layout, size: int, gram: int) -> DataFrame:
    """(block int, bits binary): for each block a bit map of the counters that counted two or more; docs has `text`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            anchors = np.concatenate(held)
            block = layout.block(anchors)
            every = np.concatenate([block * (ROWS << layout.bits) + layout.cell(anchors, row) for row in range(ROWS)])
            place, times = np.unique(every, return_counts=True)
            own = place // (ROWS << layout.bits)
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            low = ((place - own * (ROWS << layout.bits)) << 1 | (times > 1)).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array(own[cut].astype(np.int32)), pa.array([x.tobytes() for x in np.split(low, cut[1:])], pa.binary())], names=["block", "cells"])

        for batch in batches:
            for _, raw, starts in _runs(batch, 0, layout.sizes.step):
                w = Windows(raw, starts, size, gram)
                held.append(w.anchor[w.heads()])
                n += len(held[-1])
                if n > 2 * layout.sizes.held:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merged(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (np.zeros(ROWS << layout.bits, bool) for _ in range(2))
        for batch in tables:
            for value in batch.column("cells"):
                got = np.frombuffer(value.as_buffer(), "<u4")
                at = got >> 1
                two[at] |= one[at] | (got & 1).astype(bool)
                one[at] = True
        if two.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], names=["block", "bits"])

    return docs.select("text").mapInArrow(counted, "block int, cells binary").groupBy("block").applyInArrow(merged, "block int, bits binary")


def _tag(text: str) -> int:
    """Tells rows of one doc_id apart: the low half of Spark's xxhash64, as a signed int."""
    return ((xxh64_intdigest(text.encode("utf-8", "replace"), 42) + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


def _tagged(docs: DataFrame) -> DataFrame:
    """docs and the same tag as a column."""
    low = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.withColumn("tag", F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int"))


def repeated_anchors(docs: DataFrame, layout: Layout, counters: DataFrame, size: int, gram: int) -> DataFrame:
    """(doc_id, tag, heads array<int>): by document the first windows of those anchors that are estimated to occur
    more than once, by an exchange of all anchors to the blocks of their counters. docs: (doc_id, text)."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            anchor, doc, tag, at = (np.concatenate(x) for x in zip(*held, strict=True))
            _, where, times = np.unique(anchor, return_inverse=True, return_counts=True)
            # met twice in this run, so repeated for sure: goes on without a question, dealt by document
            sure = times[where] > 1
            block = np.where(sure, -1 - (mixed(doc.view(np.uint64)) % np.uint64(layout.blocks)).astype(np.int64), layout.block(anchor))
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32))], names=["block", "anchor", "doc_id", "tag", "at"])

        for batch in batches:
            for part, raw, starts in _runs(batch, 1, layout.sizes.step):
                w = Windows(raw, starts, size, gram)
                if not len(w.anchor):
                    continue
                ids, k = part.column(0).to_numpy(zero_copy_only=False), w.heads()
                tags = np.array([_tag(t) for t in part.column(1).to_pylist()], np.int32)
                held.append((w.anchor[k], ids[w.doc[k]], tags[w.doc[k]], w.at[k]))
                n += len(k)
                if n > layout.sizes.held:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def answered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(["doc_id", "tag", "at"])
        if key[0].as_py() < 0 or not len(rows):
            return rows
        if not len(right):
            return rows.slice(0, 0)
        bits = np.frombuffer(right.column("bits")[0].as_py(), np.uint8)
        return rows.filter(pa.array(layout.repeated(bits, left.column("anchor").to_numpy().view(np.uint64))))

    question = docs.select("doc_id", "text").mapInArrow(asked, "block long, anchor long, doc_id long, tag int, at int")
    answer = question.groupBy("block").cogroup(counters.select(F.col("block").cast("long").alias("block"), "bits").groupBy("block")).applyInArrow(answered, "doc_id long, tag int, at int")
    return answer.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("heads"))


def repeated_windows(docs: DataFrame, size: int = 20, gram: int = 10, sizes: Sizes = Sizes()) -> DataFrame:
    """docs: (doc_id long, text string), no nulls. Returns, for documents that have any, the first words of
    the windows that also start earlier: (doc_id, tag int, at array<int>, decided array<binary>); decided
    holds more of them as little-endian 32-bit numbers."""
    layout = Layout(docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0, sizes)
    counters = materialize(sketch(docs, layout, size, gram), "sketch")
    heads = materialize(repeated_anchors(docs, layout, counters, size, gram), "heads")
    discard(counters)
    # only documents that have repeated anchors are dealt to meet them
    some = docs.where(Members(heads.select("doc_id")).may_hold(F.col("doc_id")))
    # by exchange at any size, so that no task has two Python workers
    texts = _tagged(some).join(heads.hint("merge"), ["doc_id", "tag"]).select("doc_id", "text", "heads")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def passed(w: Windows, part: pa.RecordBatch) -> np.ndarray:
            k = w.heads()
            place = np.repeat(k, np.diff(np.append(k, len(w.anchor))))  # of each window the first with its anchor
            lists = part.column(2)
            own = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            named = own << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return np.flatnonzero(np.isin(w.doc[place] << 32 | w.at[place], named))

        def out() -> pa.RecordBatch:
            anchor, one, two, doc, tag, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((at, doc, two, one))
            anchor, one, two, doc, tag, at = (x[order] for x in (anchor, one, two, doc, tag, at))
            head = np.ones(len(one), bool)
            head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(one)), 0))
            first = (doc == doc[lead]) & (at == at[lead])  # more than one only if rows share a doc_id
            # decided here: an earlier start was met in this run
            later = np.flatnonzero(~first)
            later = later[np.lexsort((at[later], tag[later], doc[later]))]
            d, t, p = doc[later], tag[later], at[later].astype("<u4")
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
            blobs = [x.tobytes() for x in np.split(p, cut[1:])] if len(d) else []
            # open: one row for windows that follow each other and share their anchor
            keep = np.flatnonzero(first)
            keep = keep[np.lexsort((at[keep], anchor[keep], tag[keep], doc[keep]))]
            new = np.ones(len(keep), bool)
            near = keep[1:], keep[:-1]
            new[1:] = np.logical_or.reduce([x[near[0]] != x[near[1]] for x in (doc, tag, anchor)]) | (at[near[0]] != at[near[1]] + 1)
            start, m, k = np.flatnonzero(new), int(new.sum()), len(cut)
            ends = np.append(start, len(keep)).astype(np.int32)
            lists = lambda x, kind: pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x[keep])), pa.nulls(k, pa.list_(kind))])
            head = keep[start]
            fill = mixed(d[cut].view(np.uint64) + t[cut].astype(np.uint64)).view(np.int64)  # spreads decided rows over the exchange
            columns = [np.concatenate(x) for x in ((anchor[head].view(np.int64), fill), (doc[head], d[cut]), (tag[head], t[cut]), (at[head].astype(np.int32), np.zeros(k, np.int32)))]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), lists(one, pa.int64()), lists(two, pa.int64()), pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(blobs, pa.binary())])],
                names=["anchor", "doc_id", "tag", "at", "one", "two", "decided"],
            )

        for batch in batches:
            for part, raw, starts in _runs(batch, 1, layout.sizes.step):
                w = Windows(raw, starts, size, gram)
                some = passed(w, part) if len(w.anchor) else []
                if not len(some):
                    continue
                ids, own = part.column(0).to_numpy(zero_copy_only=False), w.doc[some]
                tags, made = np.zeros(len(part), np.int32), []
                cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist()
                for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
                    text = part.column(1)[int(own[a])].as_py()
                    tags[own[a]] = _tag(text)
                    made += digests(text, w.at[some[a:b]].tolist(), size)
                both = np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)
                held.append((w.anchor[some], both[:, 0], both[:, 1], ids[own], tags[own], w.at[some]))
                n += len(some)
                if n > layout.sizes.held:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    found = texts.mapInArrow(suspects, "anchor long, doc_id long, tag int, at int, one array<long>, two array<long>, decided binary")
    # equal windows have equal anchors: one exchange on those, then digests are ranked inside each partition
    each = found.repartition("anchor").select("anchor", "doc_id", "tag", "at", "decided", F.posexplode_outer(F.arrays_zip("one", "two")).alias("k", "d"))
    each = each.select("anchor", "doc_id", "tag", (F.col("at") + F.coalesce("k", F.lit(0))).alias("at"), "decided", F.col("d.one").alias("one"), F.col("d.two").alias("two"))
    order = Window.partitionBy("anchor", "one", "two", F.col("decided").isNull()).orderBy("doc_id", "at")
    later = each.withColumn("nth", F.rank().over(order)).where("decided is not null or nth > 1")
    return later.groupBy("doc_id", "tag").agg(F.collect_list(F.when(F.col("decided").isNull(), F.col("at"))).alias("at"), F.collect_list("decided").alias("decided"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, starts: np.ndarray, size: int) -> tuple[int, np.ndarray, bytes]:
    """The number of words, which of them no listed window covers, and the text of those: runs of
    kept words as they stand, with the last white space before each."""
    spans = [m.span() for m in _WORD.finditer(text)]
    cover = np.zeros(len(spans) + size + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    kept = np.cumsum(cover)[: len(spans)] == 0
    out, before = [], -2
    for k in np.flatnonzero(kept).tolist():
        a, b = spans[k]
        gap = text[spans[k - 1][1] : a] if k else b""
        out += [(gap if before == k - 1 else b"\n" if b"\n" in gap else b" ") if out else b"", text[a:b]]
        before = k
    return len(spans), kept, b"".join(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, gram: int = 10, extra: tuple[str, ...] = (), sizes: Sizes = Sizes()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (text), kept_sha256 (of the kept words
    joined by one space), then the columns of docs named in `extra`, as a struct `extra`.

    Words are runs without ASCII white space. A word goes if a window of `size` words covers it whose
    word sequence also starts earlier: in a smaller doc_id, or in this document before. Windows
    are judged on the input. Where nothing goes the text stays as it is.

    A null text has no words and stays null; a null doc_id sorts before all others; rows that
    share a doc_id are judged row by row, and equal starts in them are not earlier; an empty
    table gives no rows; other columns of docs may have any names. A very long text is handled
    whole, as one step of its task.
    """
    attach(docs.sparkSession)
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[exactly(c).alias(c) for c in extra] or [F.lit(0).alias("none")]).alias("extra"))
    keyed = _tagged(rows.withColumn("key", F.coalesce("doc_id", F.lit(lowest))))
    marks = repeated_windows(rows.where("text is not null").select(F.coalesce("doc_id", F.lit(lowest)).alias("doc_id"), "text"), size, gram, sizes)
    # only documents that may have marks are dealt to meet them
    marks = materialize(marks.withColumnRenamed("doc_id", "key"), "marks")
    members = Members(marks.select("key"))
    holds = members.holder()
    joined = keyed.where(members.may_hold(F.col("key"))).join(marks.hint("merge"), ["key", "tag"], "left").select("doc_id", "text", "extra", "at", "decided")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text, at, decided in zip(part.column(1), part.column(3), part.column(4), strict=True):
                    text, at, decided = text.as_py(), at.as_py(), decided.as_py()
                    raw = (text or "").encode("utf-8", "replace")
                    if at or decided:
                        starts = np.concatenate([np.array(at or [], np.int64), *[np.frombuffer(b, "<u4").astype(np.int64) for b in decided or []]])
                        n, kept, left = without(raw, starts, size)
                        rows.append((n, n - int(kept.sum()), left.decode(), hashlib.sha256(b" ".join(left.split())).hexdigest()))
                    else:
                        found = raw.split()
                        rows.append((len(found), 0, text, hashlib.sha256(b" ".join(found)).hexdigest()))
                made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, part.column(2)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "extra"])

    def uncut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that surely have no marks."""
        for batch in batches:
            part = batch.filter(pc.invert(holds(batch.column(3)))).select([0, 1, 2])
            none = [pa.nulls(part.num_rows, pa.list_(t)) for t in (pa.int32(), pa.binary())]
            yield from cut(iter([pa.RecordBatch.from_arrays([*part.columns, *none], names=["doc_id", "text", "extra", "at", "decided"])]))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType()), joined.schema["extra"]])
    return joined.mapInArrow(cut, schema).unionByName(keyed.select("doc_id", "text", "extra", "key").mapInArrow(uncut, schema))
