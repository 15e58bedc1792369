"""Token matrices for training: best-fit-decreasing packing with a segment-tree search.

Documents longer than a sequence are split losslessly. The pieces of a run of documents
(bounded by RUN_IDS ids, so memory is bounded too) are placed longest first, each into the
open sequence whose free room is the smallest that still holds it. Open sequences are
counted by free room; a segment tree over the rooms 0..width finds the best one in
log2(width) steps. Runs are packed on their own, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeplan.llm.shared import attach, slices
from treeplan.llm.tokens import encoder

RUN_IDS = 1 << 21
#: Sequences in one output row's matrix.
MATRIX_ROWS = 128
SCHEMA = "matrix_id long, n_rows int, width int, ids binary, positions binary, used array<int>, cu_seqlens array<array<int>>, doc_ids array<array<long>>, starts array<array<long>>"


class Rooms:
    """Open sequences by free room; best(n) is the smallest room of at least n that has one."""

    def __init__(self, width: int) -> None:
        self.size = 1 << (width + 1).bit_length()
        self.any = [False] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        at = self.size + room
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, room: int) -> int:
        out, tree = self.held[room].pop(), self.any
        if not self.held[room]:
            at = self.size + room
            tree[at] = False
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = False
                at >>= 1
        return out

    def best(self, n: int) -> int | None:
        tree, at = self.any, self.size + n
        if tree[at]:
            return n
        while at > 1:  # up to the first subtree on the right that holds one, then down its left edge
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Indexes of `lengths` by sequence, placed longest first (ties: in order)."""
    rooms, out = Rooms(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = rooms.best(lengths[i])
        if room is None:
            room, k = width, len(out)
            out.append([])
        else:
            k = rooms.take(room)
        out[k].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], k)
    return out


def token_matrices(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 50256, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each matrix of up to MATRIX_ROWS packed sequences of `width` ids.

    ids: the matrix, row by row, little-endian unsigned 32-bit, padded with end_id.
    positions: of the same shape, unsigned 16-bit; starts at 0 again with each piece (and
    with the padding). used: ids before the padding, by row. cu_seqlens: by row, 0 and then
    the end of each piece. doc_ids, starts: by row, the document of each piece and how many
    of its ids come before the piece. matrix_id: unique.

    A document's ids are its text's and then end_id; a null or empty text is that id alone.
    A null doc_id is kept; repeated rows are packed again; an empty table gives no rows;
    other columns are not looked at; a very long text is split at each `width` ids.

    Documents are packed in runs of RUN_IDS ids within a task, so which share a sequence, and the matrix_id,
    depend on how rows are dealt to tasks; the ids, their order and the padding rule do not.
    """
    if not 1 <= width <= 65536:
        raise ValueError("width must be from 1 to 65536")

    def matrices(run: list[tuple], count: int) -> Iterator[tuple]:
        own = [(doc, at, ids[at : at + width]) for doc, ids in run for at in range(0, len(ids), width)]
        bins = best_fit([len(x[2]) for x in own], width)
        for k in range(0, len(bins), MATRIX_ROWS):
            part = bins[k : k + MATRIX_ROWS]
            m, p = np.full((len(part), width), end_id, "<u4"), np.zeros((len(part), width), "<u2")
            ramp, ends = np.arange(width, dtype="<u2"), []
            for r, members in enumerate(part):
                cu = [0]
                for i in members:
                    ids = own[i][2]
                    m[r, cu[-1] : cu[-1] + len(ids)] = ids
                    p[r, cu[-1] : cu[-1] + len(ids)] = ramp[: len(ids)]
                    cu.append(cu[-1] + len(ids))
                p[r, cu[-1] :] = ramp[: width - cu[-1]]
                ends.append(cu)
            yield (count + k // MATRIX_ROWS, len(part), width, m.tobytes(), p.tobytes(), [c[-1] for c in ends], ends, [[own[i][0] for i in b] for b in part], [[own[i][1] for i in b] for b in part])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, count = encoder(vocabulary, ranks, pattern), np.array([end_id], "<u4"), TaskContext.get().partitionId() << 33
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for row in matrices(held, count):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
                count = row[0] + 1

        for batch in batches:
            for part in slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.concatenate([enc.ids(text.as_py() or ""), tail])
                    held.append((doc, ids))
                    n += len(ids)
                    if n >= RUN_IDS:
                        yield from out()
                        held, n = [], 0
        if held:
            yield from out()

    attach(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Writes the matrices as Parquet through Spark's commit protocol: a row is one binary id matrix
    with its cumulative lengths and position resets, readable by np.frombuffer."""
    matrices.write.parquet(path)


def sequences(matrices: DataFrame) -> DataFrame:
    """One row for each packed sequence: sequence_id, ids, positions, cu_seqlens, doc_ids, starts, used, width."""
    at = F.col("__row")
    return matrices.select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("__row")).select(
        (F.col("matrix_id") * MATRIX_ROWS + at).alias("sequence_id"),
        F.expr("substring(ids, __row * width * 4 + 1, width * 4)").alias("ids"),
        F.expr("substring(positions, __row * width * 2 + 1, width * 2)").alias("positions"),
        F.get("cu_seqlens", at).alias("cu_seqlens"), F.get("doc_ids", at).alias("doc_ids"), F.get("starts", at).alias("starts"), F.get("used", at).alias("used"), "width",
    )
