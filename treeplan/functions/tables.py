"""Table functions for SQL: chunks of a content in a lateral join."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treeplan.operators.chunks import CdcParams, boundaries
from treeplan.work import importable

CHUNKS = "idx long, off long, len long, h string"


class CdcChunks:
    """cdc_chunks(content binary, target int): chunks.cdc_chunks() of one content. Null and empty contents have none. A call sees one content at a time;
    chunks.cdc_chunks() steps many small ones side by side and is faster for whole tables."""

    def eval(self, content: bytes | None, target: int) -> Iterator[tuple]:
        data = bytes(content or b"")
        starts = boundaries(data, CdcParams(target))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)], strict=True) if starts else ()):
            yield k, a, b - a, sha256(data[a:b]).hexdigest()


class FixedChunks:
    """fixed_chunks(content binary, size int): pieces of `size` bytes, the last one what is left."""

    def eval(self, content: bytes | None, size: int) -> Iterator[tuple]:
        data = bytes(content or b"")
        for k, a in enumerate(range(0, len(data), size)):
            piece = data[a : a + size]
            yield k, a, len(piece), sha256(piece).hexdigest()


def register(spark: SparkSession) -> None:
    """Makes cdc_chunks and fixed_chunks known to the session's SQL."""
    importable(spark)
    for name, made in (("cdc_chunks", CdcChunks), ("fixed_chunks", FixedChunks)):
        spark.udtf.register(name, F.udtf(made, returnType=CHUNKS, useArrow=True))
