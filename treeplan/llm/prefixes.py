"""Document fingerprints from prefix polynomial hashes.

A text's prefix array under a prime p and a base b holds, for every i, the sum of
code(j) * b^j (j < i) mod p. Two spans are equal (up to a chance of about 2^-61) if their
differences, brought to the same power, agree under two primes; so any span equality takes
constant time and the longest common extension of two positions a binary search.

A fingerprint holds the whole text's value under both primes, its length, and the spans
between at most CUTS cuts, each as the span's value and length. A cut stands where the hash
of the GRAM code points before it, a span of the prefix array, ends in many zero bits; so
equal passages are cut alike wherever they stand. Likeness is told from two fingerprints
alone: the share of the longer text in spans that both have. Each cut has its number of zero
bits, so the finer of two fingerprints is joined to the cuts of the coarser, as the value of
two neighbouring spans follows from their values and lengths.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeplan.llm.shared import attach, materialize, partitions, slices

PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253 % 2147483629))
BLOCK = 1 << 20
#: Rows and bytes of text of a range partition, about.
ROWS_A_PART, BYTES_A_PART = 16384, 64 << 20
#: Code points that decide on a cut, zero bits of any cut, cuts of a fingerprint at most.
GRAM, LEAST, CUTS = 6, 2, 32
#: A place is no cut if one of so many possible ones before it follows the same code points: a run of one word is one span.
SINCE = 16
#: A cut's zero bits as one sign; the last stands for the text's end.
LEVELS = "0123456789abcdefghijklmnopqrstuvwxyz"
MIX = 0x9E3779B97F4A7C15


class _Powers:
    """b^0, b^1, ... mod p, as far as they were needed."""

    def __init__(self, p: int, b: int) -> None:
        self.p, self.b, self.table = p, b, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.b, len(self.table), self.p))
            self.table = np.concatenate([self.table, self.table * step % np.uint64(self.p)])
        return self.table


_POWERS = [_Powers(p, b) for p, b in PRIMES]
_INVERSE = _Powers(PRIMES[0][0], pow(PRIMES[0][1], -1, PRIMES[0][0]))


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.arrays, self.told = len(codes), [], None
        for (p, _), powers in zip(PRIMES, _POWERS, strict=True):
            out, at = np.zeros(self.n + 1, np.uint64), 0
            table = powers.upto(self.n)
            while at < self.n:
                to = min(self.n, at + BLOCK)  # so that the sums stay under 2^52
                out[at + 1 : to + 1] = (np.cumsum(codes[at:to] * table[at:to] % np.uint64(p)) + out[at]) % np.uint64(p)
                at = to
            self.arrays.append(out)

    def equal(self, i: int, other: "Prefixes", j: int, n: int) -> bool:
        """Whether self[i : i + n] is other[j : j + n]."""
        for k, (p, _) in enumerate(PRIMES):
            table = _POWERS[k].upto(max(i, j) + 1)
            a = (int(self.arrays[k][i + n]) - int(self.arrays[k][i])) % p
            b = (int(other.arrays[k][j + n]) - int(other.arrays[k][j])) % p
            if a * int(table[j]) % p != b * int(table[i]) % p:
                return False
        return True

    def extension(self, i: int, other: "Prefixes", j: int) -> int:
        """The longest n with self[i : i + n] equal to other[j : j + n]."""
        least, most = 0, min(self.n - i, other.n - j)
        if self.equal(i, other, j, most):
            return most
        while most - least > 1:
            mid = (least + most) // 2
            least, most = (mid, most) if self.equal(i, other, j, mid) else (least, mid)
        return least

    def ending(self, other: "Prefixes", limit: int) -> int:
        """The longest common end of at most `limit`."""
        least, most = 0, limit
        if self.equal(self.n - most, other, other.n - most, most):
            return most
        while most - least > 1:
            mid = (least + most) // 2
            least, most = (mid, most) if self.equal(self.n - mid, other, other.n - mid, mid) else (least, mid)
        return least

    def cuts(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The level from which there are at most CUTS cuts, where these are, and their levels."""
        p, a = np.uint64(PRIMES[0][0]), self.arrays[0]
        starts = max(0, self.n - GRAM)  # none at the end itself
        grams = (a[GRAM : GRAM + starts] + p - a[:starts]) % p * _INVERSE.upto(starts)[:starts] % p
        mixed = grams * np.uint64(MIX) >> np.uint64(32) | np.uint64(1 << 32)
        at = np.flatnonzero(mixed & np.uint64((1 << LEAST) - 1) == 0)
        new = np.ones(len(at), bool)
        for k in range(1, min(SINCE, len(at) - 1) + 1):
            new[k:] &= grams[at[k:]] != grams[at[:-k]]
        at = at[new]
        mixed = mixed[at]
        levels = np.log2(mixed & (~mixed + np.uint64(1))).astype(np.int64)
        least = LEAST if len(at) <= CUTS else int(np.partition(levels, -CUTS - 1)[-CUTS - 1]) + 1
        kept = levels >= least
        return least, at[kept] + GRAM, levels[kept]

    def fingerprint(self) -> str:
        """Values under both primes (8 digits each), the length, the level, then each span's value, its end's level and its length."""
        if self.told is None:
            p = np.uint64(PRIMES[0][0])
            least, at, levels = self.cuts()
            ends = np.append(at, self.n)
            starts = np.concatenate([[0], at]).astype(np.int64)
            values = (self.arrays[0][ends] + p - self.arrays[0][starts]) % p * _INVERSE.upto(self.n + 1)[starts] % p
            spans = zip(values.tolist(), [*levels.tolist(), len(LEVELS) - 1], (ends - starts).tolist(), strict=True)
            self.told = "".join(f"{int(x[-1]):08x}" for x in self.arrays) + f"{self.n:x}.{LEVELS[least]}" + "".join(f".{v:08x}{LEVELS[z]}{n:x}" for v, z, n in spans)
        return self.told

    def common(self, other: "Prefixes") -> int:
        """Code points of the common start and, behind it, the common end."""
        start = self.extension(0, other, 0)
        return start + self.ending(other, min(self.n, other.n) - start)

    @classmethod
    def joined(cls, a: "Prefixes", i: int, b: "Prefixes", j: int) -> "Prefixes":
        """Of a[:i] + b[:j], from the arrays of a and b."""
        self = cls.__new__(cls)
        self.n, self.arrays, self.told = i + j, [], None
        for k, (p, _) in enumerate(PRIMES):
            shift = np.uint64(int(_POWERS[k].upto(i + 1)[i]))
            head = a.arrays[k][: i + 1]
            self.arrays.append(np.concatenate([head, (b.arrays[k][1 : j + 1] * shift + head[i]) % np.uint64(p)]))
        return self


def _spans(told: list[str], least: int) -> Counter:
    """(value, length) of the spans of a fingerprint between cuts of at least that level."""
    p, base = PRIMES[0]
    out, value, length = Counter(), 0, 0
    for span in told:
        value = (value + int(span[:8], 16) * pow(base, length, p)) % p
        length += int(span[9:], 16)
        if LEVELS.index(span[8]) >= least:
            out[value, length] += 1
            value = length = 0
    return out


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: the share of the longer text in spans that both have, in any order and each as often
    as both have it; two empty texts: 1. Equal texts have 1; of an edited passage the span that holds its edge is lost too."""
    (head_a, least_a, *told_a), (head_b, least_b, *told_b) = a.split("."), b.split(".")
    most = max(int(head_a[16:], 16), int(head_b[16:], 16))
    if a == b or not most:
        return 1.0
    least = max(LEVELS.index(least_a), LEVELS.index(least_b))
    both = _spans(told_a, least) & _spans(told_b, least)
    return sum(length * times for (_, length), times in both.items()) / most


def _row(text: str, own: Prefixes, after: str, other: Prefixes) -> tuple:
    cut = own.n // 2
    head, taken = own.n - cut, min(cut, other.n)
    edited = Prefixes.joined(own, head, other, taken)
    digest = hashlib.sha256((text[:head] + after[:taken]).encode("utf-8", "replace")).hexdigest()
    near = likeness(own.fingerprint(), edited.fingerprint()), likeness(own.fingerprint(), other.fingerprint())
    return own.n, digest, own.fingerprint(), edited.fingerprint(), *near, own.common(edited), own.common(other)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order. Each row but the last has its result; the first and the last
    come back with their text as well, as the neighbours of other partitions."""
    kinds, names = [*_KINDS, pa.int32(), pa.string(), pa.string()], [*_NAMES, "part", "edge", "text"]
    part, before, none = TaskContext.get().partitionId(), None, (None,) * (len(_NAMES) - 1)
    for batch in batches:
        for few in slices(batch, 1):
            rows = []
            for doc, text in zip(few.column(0).to_pylist(), few.column(1), strict=True):
                text = text.as_py() or ""
                arrays = Prefixes(text)
                if before is None:
                    rows.append((doc, *none, part, "first", text))
                else:
                    rows.append((before[0], *_row(before[1], before[2], text, arrays), part, None, None))
                before = (doc, text, arrays)
            if rows:
                yield _batch(rows, kinds, names)
    if before is not None:
        yield _batch([(before[0], *none, part, "last", before[1])], kinds, names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for few in slices(batch, 1):
            rows = [(doc, *_row(text, Prefixes(text), after, Prefixes(after))) for doc, text, after in zip(*(c.to_pylist() for c in few.columns), strict=True)]
            if rows:
                yield _batch(rows, _KINDS, _NAMES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both neighbours.

    Edited text: the last floor(n/2) code points are replaced by the first as many (or all) of
    the next document's; next is by ascending doc_id (ties: by the text's hash; null ids first), after
    the last comes the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (likeness() of the fingerprints, nothing else),
    common_edited, common_next (code points that both texts begin with and, behind these, end with,
    by binary search in the prefix arrays).

    A null text is empty, two empty texts have likeness 1, a table of one row is its own
    next; repeated rows are rows of their own; an empty table gives no rows; other columns
    are not looked at; a very long text is one row of its task.

    One range exchange brings neighbours together; each text passes once, with only its
    predecessor in memory. Only the edges of partitions (two rows each) are joined later.
    """
    spark = docs.sparkSession
    attach(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(partitions(spark), -(-held.n // ROWS_A_PART), -(-held.bytes // BYTES_A_PART))
    own = own.withColumn("tie", F.xxhash64("text"))  # so that rows of one id, or without, are not one task
    done = materialize(own.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(_neighbours, f"{RESULT}, part int, edge string, text string"), "neighbours", compression="zstd")
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("after"))
    # the part behind each that has rows, the first behind the last: one small row a part
    every = Window.orderBy("part")
    follow = firsts.select(F.col("part").alias("own"), F.coalesce(F.lead("part").over(every), F.first("part").over(every.rowsBetween(Window.unboundedPreceding, 0))).alias("part"))
    lasts = done.where("edge = 'last'").select("doc_id", "text", F.col("part").alias("own")).join(follow, "own").join(firsts, "part")
    return done.where("edge is null").select(*_NAMES).unionByName(lasts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "after").mapInArrow(_edges, RESULT))
