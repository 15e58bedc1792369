"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two (the binary digits
of n, with as many of the largest size as fit), and a sequence is one piece: no sequence
crosses documents, and none of them needs padding. Sequences of equal length form a
bucket, so a batch takes rows from one bucket.

Everything happens in one pass over the texts: no shuffle, no state between documents.
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

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ROWS = 8192


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first; `longest` is a power of two."""
    out = [(at, longest) for at in range(0, n - n % longest, longest)]
    at, size = n - n % longest, longest >> 1
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0, ranks: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset (always 0), ids
    (little-endian unsigned 32-bit; with keep_ids=False their CRC-32 as ids_crc32 instead).

    A document's ids are its text's, then end_id; a null or empty text is that id alone.
    `length` is also the bucket: write with partitionBy("length") to get one folder for each.
    sequence_id is unique: the number of the task's input partition times 2^33, plus a count
    that runs through the task's pieces bucket by bucket within each batch of rows.
    A null doc_id is kept; repeated rows are packed again; an empty table gives no rows;
    other columns are not looked at; a very long text is many pieces of `longest`.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, count = encoder(vocabulary, ranks, pattern), np.array([end_id], "<u4"), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.concatenate([enc.ids(text.as_py() or ""), tail])
                    raw = memoryview(ids.tobytes())
                    for at, n in pieces(len(ids), longest):
                        own = raw[4 * at : 4 * (at + n)]
                        rows.append((n, doc, at, len(ids), bytes(own) if keep_ids else zlib.crc32(own)))
                rows.sort(key=lambda r: -r[0])
                for k in range(0, len(rows), ROWS):
                    n, doc, at, total, ids = zip(*rows[k : k + ROWS], strict=True)
                    m = len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(count, count + m)), pa.array(np.zeros(m, np.int64)), pa.array(ids, pa.binary() if keep_ids else pa.int64())],
                        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids" if keep_ids else "ids_crc32"],
                    )
                    count += m

    attach(docs.sparkSession)
    schema = SCHEMA if keep_ids else SCHEMA.replace("ids binary", "ids_crc32 long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
