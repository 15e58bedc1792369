"""SimHash near-duplicates: BK-trees over bounded shards of fingerprints.

A fingerprint has 64 bits; bit k is set if it is set in over half of the XXH64 values of
the document's word shingles. Fingerprints within `radius` bits are linked, and documents
are grouped by the connected components of those links.

How all links are found without comparing all pairs, exactly and for any corpus size:

* equal fingerprints become one node (an aggregation with a map-side part);
* the bits are cut into radius + 2 blocks; two fingerprints within the radius agree on at
  least two whole blocks, so each node goes to one bucket for each pair of blocks, and
  buckets of one node are dropped by a count;
* a bucket of over REFINE nodes is dealt again by pairs of blocks of its free bits. With
  radius 2 that leaves 16 free bits, so no bucket can hold over 65,536 nodes;
* a bucket is cut into shards of about SHARD nodes. A shard is a BK-tree: children are
  keyed by their integer Hamming distance to the parent, and a search for radius r visits
  only edges with keys in [d - r, d + r]. Each shard's tree is built once and sent to every
  other shard of its bucket (a broadcast inside the bucket, of bounded size, that never
  passes the driver), one task row for each pair of shards;
* a pair of shards gives back a spanning forest of its links, never all pairs.

similar_groups() groups by the Jaccard similarity of word shingles instead. Fingerprints of
texts that are 0.8 alike differ in up to about 20 of 64 bits, too many for blocks of bits,
so there the buckets are min-hash bands; inside a shard the BK-tree proposes links within
REACH bits, signatures rank them, spanning forests of the likeliest are kept, and each of
their links must pass an exact comparison of whole shingle sets. Where signatures leave a
link in doubt, SPARE forests stand beside each other, so that a link that fails has others.
A band of over HOT sets is first compared with its LEADERS only; sets that these connect
(by exact links, over all bands) need no comparison with each other any more. What is left,
sets that share a passage and little else, is dealt again by FINE keys of min-hashes that no
band uses, so only sets that agree in one of these too are compared. So neither one large
group of near copies nor a passage in very many documents costs a square of its size.

All this finds most links, and may miss some: pairs that share no band or no key of a hot one,
candidates beyond the forests or the bounds. The rest is found exactly, between components that
are not connected yet: shingles have one order, rare ones first, and two sets that are alike
enough share one among the first (1 - similarity) of each. Sets that share such a shingle meet,
unless their sizes, the shingle's places or bit maps of their shingles rule it out for certain;
what remains passes the same exact check. Shingles of over RUN sets meet by shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from treeplan.llm.shared import Forest, Members, attach, components, discard, materialize, mixed, exactly, slices

SHARD = 192
REFINE = 4096
#: similar_groups(): differing bits that a link of similar texts may have; bands, rows of each, min-hashes.
REACH = 22
BANDS, BAND_ROWS, HASHES = 16, 5, 128
#: Signatures may fall short of the similarity asked for by this much (3.5 standard errors) before a link is dropped unchecked;
#: beyond it by as much, a link is taken to hold. Of links between, so many forests without common links are checked.
SHORT = 0.12
SPARE = 4
#: Sets of a band beyond which it is compared with so many leaders first.
HOT, LEADERS = 4096, 16
#: Keys by which such a band is dealt again, and min-hashes of each; a pair at 0.8 shares one with a chance of 0.998.
FINE, FINE_ROWS = 12, 4
#: One row of EVERY tells which shingles are common, at least KNOWN rows, about, and so many of the commonest have a rank of their own.
#: A share, not a number: so a shingle of more than a few dozen sets is known at any size of the table. Only the order of shingles
#: hangs on that, and links are found by any order; a good one lets few sets meet.
KNOWN, EVERY, COMMON = 8000, 6, 1 << 18
#: Sets of a shingle that meet in one step; bits of a small set's bit map (larger sets have as many bits as shingles, or up to twice that).
RUN, BITS = 256, 1024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every `words`-word shingle of the A-Z-lower-cased text, repeats included.
    Words are runs without ASCII white space; fewer words than that are one shingle."""
    if text is None:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "replace").lower().split()  # bytes: both touch ASCII only
    line = b" ".join(found)
    if len(found) < words:
        return np.array([xxh64_intdigest(line, 42)] if found else [], np.uint64)
    at = [0, *accumulate([len(w) + 1 for w in found])]
    return np.fromiter((xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(at, at[words:])), np.uint64, len(found) - words + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Fingerprints under integer Hamming distance; a node's children are keyed by it."""

    def __init__(self, values=()) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        values, children, at = self.values, self.children, 0
        if values:
            while True:
                d = (values[at] ^ value).bit_count()
                to = children[at].get(d)
                if to is None:
                    children[at][d] = len(values)
                    break
                at = to
        values.append(value)
        children.append({})

    def packed(self) -> tuple[list[int], list[int]]:
        """For each value but the first, its parent's number and its distance from it."""
        parents, edges = [0] * (len(self.values) - 1), [0] * (len(self.values) - 1)
        for at, own in enumerate(self.children):
            for d, to in own.items():
                parents[to - 1], edges[to - 1] = at, d
        return parents, edges

    @classmethod
    def unpacked(cls, values: list[int], parents: list[int], edges: list[int]) -> "BKTree":
        self = cls()
        self.values, self.children = values, [{} for _ in values]
        for to, (at, d) in enumerate(zip(parents, edges, strict=True), 1):
            self.children[at][d] = to
        return self

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The values within the radius."""
        values, children = self.values, self.children
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield values[at]
            for key, to in children[at].items():
                if d - radius <= key <= d + radius:
                    stack.append(to)


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """One mask for each choice of `keep` of `blocks` even blocks of these bit positions."""
    cut = np.array_split(np.array(bits), blocks)
    return [sum(1 << int(b) for k in chosen for b in cut[k]) for chosen in combinations(range(blocks), keep)]


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for shards in batch.column(0).to_pylist():
                first = [_unsigned(x) for x in shards[0]["fps"]]
                rest = [_unsigned(x) for x in shards[1]["fps"]] if len(shards) > 1 else first
                tree, joined = BKTree.unpacked(first, shards[0]["parents"], shards[0]["edges"]), Forest()
                for x in rest:
                    for y in tree.near(x, radius):
                        if x != y and joined.join(x, y):
                            a.append(_signed(x))
                            b.append(_signed(y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each shard's tree to (c, key, of, shard, fps)."""
    for batch in batches:
        made = [BKTree(_unsigned(x) for x in fps).packed() if fps else ([], []) for fps in batch.column(4).to_pylist()]
        trees = [pa.array([m[k] for m in made], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int8()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *trees], names=[*batch.schema.names, "parents", "edges"])


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes: distinct (fp long). Returns (a, b): links that connect all fingerprints within the radius."""
    top = _masks(list(range(64)), radius + 2, 2)
    free = [[b for b in range(64) if not m >> b & 1] for m in top]
    deep = [m | s for m, own in zip(top, free) for s in _masks(own, radius + 2, 2)]
    per = len(deep) // len(top)

    def keys(masks: list[int], fp: str):
        return F.array(*[F.struct(F.lit(c).alias("c"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in masks])

    def counted(entries: DataFrame) -> DataFrame:
        sizes = entries.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
        return entries.join(sizes, ["c", "key"])

    first = counted(nodes.select("fp", F.inline(keys(list(enumerate(top)), "fp"))))
    sub = F.create_map(*[x for c in range(len(top)) for x in (F.lit(c), keys([(len(top) + c * per + i, deep[c * per + i]) for i in range(per)], "fp"))])
    second = counted(first.where(F.col("n") > REFINE).select("fp", F.inline(sub[F.col("c")])))
    entries = first.where(F.col("n") <= REFINE).unionByName(second)
    count = F.ceil(F.col("n") / SHARD).cast("int")
    shards = (
        entries.select("c", "key", "fp", count.alias("of"), F.pmod(F.xxhash64("fp"), count.cast("long")).cast("int").alias("shard"))
        .groupBy("c", "key", "of", "shard").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .mapInArrow(_planted, "c int, key long, of int, shard int, fps array<long>, parents array<int>, edges array<byte>")
    )
    pairs = (
        shards.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .groupBy("c", "key", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"))
        .agg(F.sort_array(F.collect_list(F.struct("shard", "fps", "parents", "edges"))).alias("shards"))
    )
    return pairs.select("shards").mapInArrow(_linker(radius), "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs; a null or word-less text has fp 0."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint_of(shingle_hashes(t.as_py(), words))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    attach(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that is reached over links
    of at most `radius` differing bits, the document itself included.

    Nulls and empty texts have fingerprint 0 and are linked like any other; a null doc_id is
    kept and never the smallest unless alone; repeated rows give repeated rows; an empty
    table gives none; other columns of docs are not looked at; a very long text is one row of its task.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("item", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MULTIPLY = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FLIP = mixed(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The low bytes of HASHES min-hashes, and a signed key for each band; of distinct shingle hashes."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        some = (hashes[i : i + 2048, None] ^ _FLIP) * _MULTIPLY
        np.minimum(least, (some ^ (some >> np.uint64(32))).min(axis=0), out=least)
    bands = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return (least >> np.uint64(13)).astype(np.uint8).tobytes(), key.view(np.int64).tolist()


def _set_hash(distinct: np.ndarray) -> int:
    return _signed(xxh64_intdigest(distinct.astype("<u8").tobytes(), 42))


def _likeliest(equal: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Of links (x, y) among n nodes with so many equal min-hashes, those of SPARE spanning forests of the
    likeliest; one of at least `sure` needs no other beside it. Links inside trees of all forests are passed
    over together, step by step, so a dense group costs little more than its forests."""
    forests = [Forest() for _ in range(SPARE)]
    order, kept = np.lexsort((y, x, -equal)), []
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        roots = np.array([[f.root(v) for v in range(n)] for f in forests])
        for k in some[(roots[:, x[some]] != roots[:, y[some]]).any(axis=0)].tolist():
            ends = int(x[k]), int(y[k])
            if equal[k] >= sure:
                new = all([f.join(*ends) for f in forests])
            else:
                new = any(f.join(*ends) for f in forests)
            if new:
                kept.append(k)
    return x[kept], y[kept]


def _proposed(similarity: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for value in batch.column(0):  # one by one, as a batch may hold very many nodes
                sides = [s["nodes"] for s in value.as_py()]
                alone = len(sides) == 1
                nodes = np.unique([x["node"] for side in sides for x in side])
                sigs = np.zeros((len(nodes), HASHES), np.uint8)
                by: dict[int, list[int]] = {}
                for side in sides:
                    for x in side:
                        x["at"] = int(np.searchsorted(nodes, x["node"]))
                        sigs[x["at"]] = np.frombuffer(x["sig"], np.uint8)
                for x in sides[0]:
                    by.setdefault(_unsigned(x["fp"]), []).append(x["at"])
                tree, found = BKTree(by), []
                for x in sides[-1]:
                    near = np.array([y for fp in tree.near(_unsigned(x["fp"]), REACH) for y in by[fp]], np.int64)
                    near = near[near < x["at"]] if alone else near[near != x["at"]]
                    equal = (sigs[near] == sigs[x["at"]]).sum(axis=1)
                    enough = equal >= (similarity - SHORT) * HASHES
                    found.append((equal[enough], np.full(int(enough.sum()), x["at"]), near[enough]))
                if found:
                    x, y = _likeliest(*(np.concatenate(c) for c in zip(*found, strict=True)), len(nodes), (similarity + SHORT) * HASHES)
                    a += nodes[x].tolist()
                    b += nodes[y].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _led(similarity: float):
    """Likely links of a set to the leaders of its band: the two likeliest."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                own = np.frombuffer(row["sig"], np.uint8)
                sigs = np.stack([np.frombuffer(y["sig"], np.uint8) for y in row["leaders"]])
                alike = (sigs == own).mean(axis=1)
                near = [(-v, y["node"]) for v, y in zip(alike.tolist(), row["leaders"]) if v >= similarity - SHORT and y["node"] != row["node"] and (_unsigned(row["fp"]) ^ _unsigned(y["fp"])).bit_count() <= REACH]
                for _, node in sorted(near)[:2]:
                    a.append(row["node"])
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _dealt_again(met: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """(node, key, kin) of met, where bands of over `hot` sets (n) are cut by FINE keys each; a key that holds one
    set only, or sets of one kin only, has nothing to compare and goes."""
    at = BANDS * BAND_ROWS + 1
    keys = F.array(*[F.struct(F.lit(k).alias("fine"), F.substring("sig", at + k * FINE_ROWS, FINE_ROWS).alias("low")) for k in range(FINE)])
    large = met.where(F.col("n") > hot).select("node", "key", "kin").join(nodes.select("node", "sig"), "node")
    fine = large.select("node", "key", "kin", F.inline(keys)).select("node", F.xxhash64("key", "fine", "low").alias("key"), "kin")
    found = fine.groupBy("key").agg(F.count("*").alias("all"), F.count("kin").alias("akin"), F.min("kin").alias("least"), F.max("kin").alias("most"))
    found = found.where((F.col("all") > 1) & ((F.col("akin") < F.col("all")) | (F.col("least") < F.col("most")))).select("key")
    return met.where(F.col("n") <= hot).select("node", "key", "kin").unionByName(fine.join(found, "key", "left_semi").select("node", "key", "kin"))


def _shard_pairs(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shards): one row for each pair of shards that is to be compared. entries: (node, key, kin): of one band (key) all
    pairs are, but those of a large group of equal kin, which are connected already; a null kin is equal to none."""
    mine = Window.partitionBy("key")
    groups = entries.where("kin is not null").groupBy("key", "kin").agg(F.count("*").alias("m")).where(F.col("m") > SHARD)
    ranges = groups.withColumn("wide", F.ceil(F.col("m") / SHARD).cast("long"))
    ranges = ranges.withColumns({"from": F.sum("wide").over(mine.orderBy("kin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("wide"), "all": F.sum("wide").over(mine)})
    grouped = entries.join(ranges.select("key", "kin", "wide", "from"), ["key", "kin"], "left")
    rest = grouped.where("wide is null").groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("rest"))
    sizes = rest.join(ranges.select("key", "all").distinct(), "key", "full").select("key", F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("all", F.lit(0)).alias("all"))
    # the shards of the rest come first, those of each group stand together behind
    place = F.when(F.col("wide").isNull(), F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.col("rest") + F.col("from") + F.pmod(F.xxhash64("node"), F.col("wide")))
    low = F.when(F.col("wide").isNotNull(), F.col("rest") + F.col("from"))
    dealt = grouped.join(sizes, "key").select("node", "key", place.alias("shard"), low.alias("low"), (low + F.col("wide")).alias("high"), (F.col("rest") + F.col("all")).alias("of"))
    shards = dealt.join(nodes.select("node", "fp", "sig"), "node").groupBy("key", "of", "shard", "low", "high").agg(F.sort_array(F.collect_list(F.struct("node", "fp", "sig"))).alias("nodes"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda o: F.col("low").isNull() | (o < F.col("low")) | (o >= F.col("high")))
    return (
        shards.withColumn("other", F.explode(others)).groupBy("key", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"))
        .agg(F.sort_array(F.collect_list(F.struct("shard", "nodes"))).alias("shards"), F.first(F.col("shard") == F.col("other")).alias("self"))
        .where("self or size(shards) = 2").select("shards")
    )


class Order:
    """One order of all shingles: those not known as common by their hashes, then the common ones without a rank by theirs, then
    the commonest, rare ones first."""

    def __init__(self, commonest: np.ndarray) -> None:
        """commonest: signed hashes, the most common first."""
        hashes = commonest.view(np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by], (len(by) - by).astype(np.int32)

    def first(self, distinct: np.ndarray, similarity: float, known: Callable[[pa.Array], pa.Array] | None = None) -> np.ndarray:
        """The shingles of a set of which it shares one with every set that is as similar; each shares at least similarity * n of n.
        known: whether signed hashes may be common; it may let others through, the same ones for all sets."""
        n = len(distinct)
        if not n:
            return distinct.astype(np.int64)
        rank = np.zeros(n, np.int32)
        if known is not None:
            rank += known(pa.array(distinct.view(np.int64))).to_numpy(zero_copy_only=False)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            rank = np.where(self.hashes[at] == distinct, self.ranks[at] + 1, rank)
        return distinct[np.lexsort((distinct, rank))][: n - int(np.ceil(similarity * n - 1e-6)) + 1].view(np.int64)


def bit_map(distinct: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit: maps differ in at most as many bits as sets in shingles. There are BITS bits,
    doubled until they are as many as shingles: a map of fewer would differ in too few bits to tell large sets apart."""
    bits = BITS
    while bits < len(distinct):
        bits *= 2
    odd = np.bincount((mixed(distinct) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Maps of `size` bytes or more as those of so many bytes, a row each: halves laid upon each other are the map of half the bits."""
    parts = [x if len(x) == size else np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0).tobytes() for x in maps]
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, size // 8)


def _differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits the maps of each pair differ, at the size of the smaller."""
    sizes, out = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64), np.zeros(len(x), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.bitwise_count(_folded([x[k] for k in at], size) ^ _folded([y[k] for k in at], size)).sum(axis=1, dtype=np.int64)
    return out


def _unlike(similarity: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many shingles at most sets of these sizes differ if they are similar."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def _meetings(similarity: float):
    """From (shingle, node, n, place, kin), sorted by shingle: (a, b, null) for sets of unlike kin that share a shingle and may be similar,
    or (node, null, shingle) for each set of a shingle of over RUN sets."""
    least = similarity / (1 + similarity)

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, key)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, node, n, place, kin = rows
        for d in range(1, len(shingle)):
            i = np.flatnonzero(shingle[:-d] == shingle[d:])
            if not len(i):
                break
            j = i + d
            most = np.minimum(n[i] - place[i], n[j] - place[j])  # shingles that both may share, if none before this one
            k = (kin[i] != kin[j]) & (most >= least * (n[i] + n[j]) - 1e-6)
            i, j = i[k], j[k]
            if len(i):
                yield out(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), None)

    def done(rows: np.ndarray, known: int | None) -> Iterator[pa.RecordBatch]:
        """Whole runs, but for one of the shingle `known`, of which many came before."""
        _, at, count = np.unique(rows[0], return_inverse=True, return_counts=True)
        long = count[at] > RUN if known is None else (count[at] > RUN) | (rows[0] == known)
        if long.any():
            yield out(rows[1][long], None, rows[0][long])
        yield from pairs(rows[:, ~long & (count[at] > 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, known = [], 0, None
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            total += batch.num_rows
            if total < 1 << 16:
                continue
            rows = np.concatenate(held, axis=1)
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last))  # the last run may go on
            yield from done(rows[:, :cut], known)
            rows, known = rows[:, cut:], known if known == last else None
            if rows.shape[1] > RUN or known is not None:
                yield out(rows[1], None, rows[0])
                rows, known = rows[:, :0], int(last)
            held, total = [rows], rows.shape[1]
        if total:
            yield from done(np.concatenate(held, axis=1), known)

    return run


def _possible(similarity: float):
    """Pairs (a, b) of which sizes and bit maps leave open whether they are similar; of rows (a, b, n, m, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            keep = np.abs(n - m) <= _unlike(similarity, n, m)
            at = np.flatnonzero(keep)
            keep[at] = _differ(*(batch.column(k).take(pa.array(at)).to_pylist() for k in (4, 5))) <= _unlike(similarity, n[at], m[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _possible_of_shards(similarity: float):
    """The same of pairs of shards, whose nodes have their size as fp and their bit map as sig."""

    def by_map(nodes: list[dict]) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """(nodes, sizes, bit maps) of those whose maps have one size."""
        some: dict[int, list[dict]] = {}
        for o in nodes:
            some.setdefault(len(o["sig"]), []).append(o)
        return [(np.array([o["node"] for o in own]), np.array([o["fp"] for o in own]), [o["sig"] for o in own]) for own in some.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                shards = value.as_py()
                for (p, n, x), (q, m, y) in product(by_map(shards[0]["nodes"]), by_map(shards[-1]["nodes"])):
                    near = np.abs(n[:, None] - m) <= _unlike(similarity, n[:, None], m)
                    near &= (q > p[:, None]) if len(shards) == 1 else (q != p[:, None])
                    if not near.any():
                        continue
                    size = min(len(x[0]), len(y[0]))
                    x, y = _folded(x, size), _folded(y, size)
                    for k in np.flatnonzero(near.any(axis=1)):
                        at = np.flatnonzero(near[k])
                        other = q[at[np.bitwise_count(x[k] ^ y[at]).sum(axis=1, dtype=np.int64) <= _unlike(similarity, n[k], m[at])]]
                        if len(other):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, p[k])), pa.array(np.maximum(other, p[k]))], names=["a", "b"])

    return run


def _not_yet_found(nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of sets of unlike components that may be similar. nodes: (node, n, map, first); roots: (item, root)."""
    kin = nodes.select("node").join(roots.select(F.col("item").alias("node"), "root"), "node", "left").select("node", F.coalesce("root", "node").alias("kin"))
    kin = materialize(kin, "kin")
    entries = nodes.join(kin, "node").select("node", "n", "kin", F.posexplode("first").alias("place", "shingle")).select("shingle", "node", "n", "place", "kin")
    met = entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_meetings(similarity), "a long, b long, key long")
    met = materialize(met, "meetings")
    sized = nodes.select("node", "n", "map")
    end = lambda of, n, m: sized.select(F.col("node").alias(of), F.col("n").alias(n), F.col("map").alias(m))
    few = met.where("b is not null").select("a", "b").distinct().join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b")
    found = few.select("a", "b", "n", "m", "x", "y").mapInArrow(_possible(similarity), "a long, b long")
    many = met.where("b is null").select(F.col("a").alias("node"), "key").join(kin, "node")
    unlike = many.groupBy("key").agg(F.min("kin").alias("least"), F.max("kin").alias("most")).where("least < most").select("key")
    shards = _shard_pairs(many.join(unlike, "key", "left_semi").select("node", "key", "kin"), sized.select("node", F.col("n").cast("long").alias("fp"), F.col("map").alias("sig")))
    found = found.unionByName(shards.mapInArrow(_possible_of_shards(similarity), "a long, b long")).distinct()
    of = lambda c: kin.select(F.col("node").alias(c), F.col("kin").alias(f"{c}_kin"))
    found = materialize(found.join(of("a"), "a").join(of("b"), "b").where("a_kin <> b_kin").select("a", "b"), "likely")
    discard(met)
    discard(kin)
    return found


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hot: int = HOT) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs: components of links between documents whose
    sets of word shingles have a Jaccard similarity of at least `similarity`; component_id is the
    smallest doc_id of the component.

    No link is wrong: each is checked on the whole sets. None between unlike components is lost: what
    bands miss is found by the first shingles of each set.
    Texts without words are alike; equal shingle sets are one class however many copies there
    are; nulls are texts without words; a null doc_id is kept; repeated rows are copies;
    an empty table gives no rows; other columns are not looked at; a very long text is one row of its task.
    """
    return _grouped(docs, id_col, text_col, words, similarity, hot).select("doc_id", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, hot: int = HOT) -> DataFrame:
    """(doc_id, node, root, component_id) for similar_groups(): a node is a shingle set, a root a component."""
    attach(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(value.as_py(), words)).view(np.int64))], names=["shingle"])

    every = min(EVERY, max(1, rows.count() // KNOWN))
    some = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0)).select("text").distinct()
    counts = materialize(some.mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2"), "common")
    commonest = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow().column(0).to_numpy().astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(Order(commonest))  # at most COMMON numbers
    known = Members(counts.select("shingle")).holder() if len(commonest) == COMMON else None  # of the others, a bit map of bounded size
    discard(counts)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            out, first = [], []
            for text in batch.column(1):
                distinct = np.unique(shingle_hashes(text.as_py(), words))  # repeats don't count in sets, so not in these fingerprints
                out.append((_set_hash(distinct), _signed(fingerprint_of(distinct)), *signature(distinct), len(distinct), bit_map(distinct)))
                first.append(order.first(distinct, similarity, known))
            if out:
                node, fp, sig, keys, n, bits = zip(*out, strict=True)
                firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in first])]), pa.int32()), pa.array(np.concatenate(first)))
                columns = [batch.column(0), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), firsts]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "sig", "keys", "n", "map", "first"])

    made = materialize(rows.mapInArrow(describe, "doc_id long, node long, fp long, sig binary, keys array<long>, n int, map binary, first array<long>"), "described")
    nodes = made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "sig", "keys", "n", "map", "first")], F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "classes")
    ids = materialize(made.select("doc_id", "node"), "named")
    discard(made)

    def sets(batches: Iterator[pa.RecordBatch], holds: Callable[[pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(holds(batch.column(0))), 1):
                distinct = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(x) for x in distinct], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in distinct], pa.binary())], names=["node", "hashes"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def true_links(likely: DataFrame) -> DataFrame:
        """Those that hold on the whole shingle sets, of one document of each class that has a likely link."""
        ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        chosen = materialize(nodes.join(ends, "node").select("node", "least"), "chosen")
        holds = Members(chosen.select(F.coalesce("least", F.lit(0).cast("long")))).holder()  # a null is 0 to it
        # tested in the kernel, so that a task has one Python worker, not two: idle ones keep their memory as long as others work
        whole = rows.mapInArrow(lambda batches: sets(batches, holds), "node long, hashes binary")
        whole = materialize(whole.join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
        both = likely.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        held = materialize(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "held")
        discard(chosen)
        discard(whole)
        return held

    entries = nodes.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(entries.join(sizes, "key"), "met")
    large, kin = met.where(F.col("n") > hot), None
    if large.take(1):
        first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"))) <= LEADERS
        leaders = large.withColumn("first", first).where("first").join(nodes.select("node", "fp", "sig"), "node")
        leaders = leaders.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "fp", "sig"))).alias("leaders"))
        led = large.select("node", "key").join(leaders, "key").join(nodes.select("node", "fp", "sig"), "node")
        kin = true_links(materialize(led.select("node", "fp", "sig", "leaders").mapInArrow(_led(similarity), "a long, b long").distinct(), "likely"))
        of = components(kin).select(F.col("item").alias("node"), F.col("root").alias("kin"))
        met = met.join(of, "node", "left").withColumn("kin", F.when(F.col("n") > hot, F.col("kin")))
        met = materialize(_dealt_again(met, nodes, hot), "dealt")
    else:
        met = met.withColumn("kin", F.lit(None).cast("long"))
    likely = materialize(_shard_pairs(met.select("node", "key", "kin"), nodes).mapInArrow(_proposed(similarity), "a long, b long").distinct(), "likely")
    held = true_links(likely)
    discard(likely)
    held = held if kin is None else held.unionByName(kin)
    rest = _not_yet_found(nodes, components(held), similarity)
    if rest.take(1):
        held = held.unionByName(true_links(rest))
    discard(rest)
    roots = components(held)
    named = nodes.select("node", "least").join(roots.withColumnRenamed("item", "node"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return ids.join(named, "node").select("doc_id", "node", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each component of similar_groups() one row stays, that of the smallest id;
    a row with a null id only if no row of its component has one. Of several such rows of a component the one
    with the least shingle set hash stays, then with the least text, then with the least values as JSON.

    A null text is one without words, like an empty one; repeated rows are copies, one of which stays; an empty
    table gives no rows; other columns may have any names and stay; a very long text is one row of its task."""
    groups = materialize(_grouped(docs, id_col, text_col, words, similarity), "groups")
    # the row itself is a struct, so its columns may have any names
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[exactly(c).alias(c) for c in docs.columns]).alias("row"))
    # an id of one row decides by itself; where rows repeat an id or have none, each is looked up by its shingle set
    state = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("lead"))
    odd = materialize(state.where("n > 1 or not lead"), "odd")
    may = Members(odd.select("id")).may_hold
    some = may(F.coalesce("id", F.lit(0).cast("long")))
    sure = rows.where("id is not null").where(~some)
    dealt = rows.where("id is not null").where(some).join(odd.hint("merge"), "id", "left")  # an exchange: the test's Python worker and the next one's are of two stages
    several = dealt.where("n > 1 and lead").select("id", "text", "row").unionByName(rows.where("id is null"))

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pa.array([_set_hash(np.unique(shingle_hashes(t.as_py(), words))) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], names=["id", "text", "row", "node"])

    named = several.mapInArrow(noded, StructType([*several.schema.fields, StructField("node", LongType())]))
    least = named.groupBy("id", "node").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    leads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).where(F.col("doc_id").isNull() | may(F.coalesce("doc_id", F.lit(0).cast("long"))))
    chosen = leads.groupBy("root").agg(F.min("node").alias("own"), F.first("component_id").alias("first"))
    kept = least.join(chosen, F.col("node").eqNullSafe(F.col("own")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    return sure.select("row").unionByName(dealt.where("n is null").select("row")).unionByName(kept.select("row")).select("row.*")
