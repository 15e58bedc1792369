"""Each training-data operator against brute force, a round trip or held-out accuracy, and its edge cases."""

import collections
import functools
import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeplan.llm import bestfit, chat, langid, pieces, pii, powers, prefixes, queries, shared, simhash, substrings, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(random.Random(5).choices(WORDS, k=60_000))
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "One TWO three"), (7, LONG), (8, LONG + " end"), (9, "日本語 текст ▁   \U0001f600 é"),
    (None, "no id"), (10, LONG), (11, "a" * 3000), (12, "x y " * 200), (-3, "İstanbul ẞ <|endoftext|> </s>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The rows with columns whose names clash with the operators' own."""
    rows = [(d, t, "en" if d and d % 2 else None, "s", len(t or "")) for d, t in ODD]
    frame = spark.createDataFrame(rows, DOCS)
    for c in ("fingerprint", "component_id", "key", "tag", "node", "fp", "__id", "__n", "__lead", "__text", "id", "row", "made", "n", "hashes", "kept", "extra", "part", "ids", "starts", "length", "lang_pred", "query", "v", "window", "place", "conv", "cost"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame.withColumns({"a.b": F.lit("clash"), "back`tick": F.lit("clash"), "x.`y`": F.lit("clash")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 SimHash


def plain_fingerprint(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, radius=2):
    ids, up = sorted(prints), {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash(spark, sf, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    least = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", least[d]) for d in texts}


def test_simhash_odd(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.component_id].add(r.doc_id)
        assert r.fingerprint == f"{plain_fingerprint(dict(ODD)[r.doc_id]):016x}"
    assert {1, 2, 3} <= by[1] and {5, 6} <= by[5] and {7, 10} <= by[7]
    assert simhash.near_duplicates(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 2**64 - 1), st.integers(0, 20))
def test_bk_tree(values, asked, radius):
    values += [v ^ (1 << k) for k, v in enumerate(values)]
    tree = simhash.BKTree(dict.fromkeys(values))
    assert sorted(tree.near(asked, radius)) == sorted(v for v in set(values) if (v ^ asked).bit_count() <= radius)


def test_packed_trees():
    rng = random.Random(1)
    tree = simhash.BKTree(rng.getrandbits(12) for _ in range(200))
    again = simhash.BKTree.unpacked(list(tree.values), *tree.packed())
    assert again.children == tree.children and sorted(again.near(77, 3)) == sorted(tree.near(77, 3))


def test_links_in_hot_buckets(spark, monkeypatch):
    """Many shards and refined buckets find the same components."""
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "REFINE", 20)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    numbered = dict(enumerate(sorted(fps)))
    want = plain_components(numbered)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in fps], "fp long")
    roots = {r.item: r.root for r in shared.components(simhash.links(frame, 2)).collect()}
    mine = {k: roots.get(simhash._signed(v), simhash._signed(v)) for k, v in numbered.items()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(mine) == groups(want)


def test_similar_groups_keep_doubtful_links(spark):
    """Links around the threshold: no document parts from a group that brute force puts it into."""
    rng = random.Random(11)
    texts = {}
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(300)]
        for k in range(8):
            own = base[:]
            for at in rng.sample(range(300), rng.choice((0, 3, 5, 6, 7, 8, 9))):
                own[at] = f"x{g}-{k}-{at}"
            texts[g * 10 + k] = " ".join(own)
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in texts.items()}
    want = shared.Forest()
    for a in texts:
        want.root(a)
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                want.join(a, b)
    got = simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: want.root(d) for d in texts}


def test_similar_groups_ignore_repeats(spark):
    """A line that stands many times counts once in a set, so it does not part texts that are alike."""
    own = " ".join(f"w{k}" for k in range(300))
    line = "the same line of these words again "
    texts = [(1, f"{own} end {line}"), (2, f"{own} end {line * 300}"), (3, f"{own} and {line * 300}"), (4, " ".join(f"v{k}" for k in range(300)) + f" {line * 300}")]
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in texts}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in ((1, 2), (2, 3), (1, 3))) and len(sets[4] & sets[2]) < 0.1 * len(sets[2])
    got = simhash.similar_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_one_of_each_by_component(spark, odd):
    rng = random.Random(11)
    text = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    near = [t + " end" for t in text]
    rows = [(None, t) for t in text[:20]] + [(None, near[0]), (None, text[1].upper()), (None, text[1])]  # null ids: 20 components
    rows += [(7, text[20]), (7, text[21]), (7, near[21]), (7, text[22]), (5, near[22])]  # one id over three components, one led by another id
    assert simhash.one_of_each(odd).columns == odd.columns
    rows += [(None, text[23]), (9, near[23]), (-(1 << 63), text[24]), (10, text[25]), (11, near[25]), (None, None), (None, "")]
    frame = lambda some, n: spark.createDataFrame([(d, t, "x") for d, t in some], "doc_id long, text string, __own string").repartition(n)
    got = [sorted((r.doc_id or 0, r.text or "") for r in simhash.one_of_each(frame(some, n)).collect()) for some, n in ((rows, 3), (rows[::-1], 5))]
    assert got[0] == got[1]
    alike = {t: k for k, pair in enumerate(zip(text, near)) for t in (*pair, pair[0].upper())}
    want = [(0, k) for k in range(20)] + [(7, 20), (7, 21), (5, 22), (9, 23), (-(1 << 63), 24), (10, 25), (0, -1)]
    assert sorted((d, alike.get(t, -1)) for d, t in got[0]) == sorted(want)


def plain_groups(texts, words=5, similarity=0.8):
    """(doc_id -> smallest doc_id of its component, links) by comparing all pairs that share a shingle."""
    sets, by, up = {d: frozenset(simhash.shingle_hashes(t, words).tolist()) for d, t in texts.items()}, collections.defaultdict(list), {d: d for d in texts}
    for d, own in sets.items():
        for x in own:
            by[x].append(d)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for d, own in sets.items():
        for e, both in collections.Counter(e for x in own for e in by[x] if e < d).items():
            if both >= similarity * (len(own) + len(sets[e]) - both) - 1e-9:
                links.add((e, d))
                up[max(root(d), root(e))] = min(root(d), root(e))
    blank = [d for d, own in sets.items() if not own]
    for d in blank[1:]:
        up[max(root(d), root(blank[0]))] = min(root(d), root(blank[0]))
    return {d: root(d) for d in texts}, links


def test_similar_groups_recall(spark):
    """Against all pairs, on the given documents and on ones that are edited to about the similarity asked for."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rng = random.Random(12)
    for k in range(120):  # pairs of 0.74 to 0.92
        own = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        texts[10**6 + 2 * k] = " ".join(own)
        for at in rng.sample(range(5, 195), rng.randrange(2, 7)):
            own[at] = "new"
        texts[10**6 + 2 * k + 1] = " ".join(own)
    want, links = plain_groups(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lost = [x for x in links if got[x[0]] != got[x[1]]]
    assert all(want[d] == want[c] for d, c in got.items())  # no link is wrong
    assert len(links) > 100 and len(lost) <= 0.02 * len(links)


def test_similar_groups_lose_no_link(spark):
    """Pairs at 0.8 and a little above, of which bands miss some: all are found, also where bands and shingles are common to very many sets."""
    rng = random.Random(15)
    passage, texts = [f"p{k}" for k in range(60)], {}
    for k in range(0, 6000, 2):
        own = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(49, 52))] + (passage if k < 800 else [])
        n, texts[k] = len(own) - 4, " ".join(own)
        differ = int(n / 9)  # of n shingles of each
        texts[k + 1] = " ".join([f"x{k}-{i}" for i in range(differ)] + own[differ:])
    want, links = plain_groups(texts)
    assert len(links) == 3000
    got = simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=100)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_meetings_over_batches():
    """Runs that end in other batches than they begin in; those of over RUN sets are told as such, whole."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    count = [int(rng.choice([1, 2, 3, 200, 257, 900], p=[0.5, 0.3, 0.18, 0.01, 0.005, 0.005])) for _ in range(40_000)] + [70_000, 1, 140_000]
    shingle = np.repeat(np.arange(len(count)), count)
    node = np.arange(len(shingle))
    columns = [shingle, node, np.full(len(node), 10), np.zeros(len(node), int), node // 2]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 1000]) for c in columns], names=["shingle", "node", "n", "place", "kin"]) for i in range(0, len(node), 1000)]
    pairs, many = set(), []
    for b in simhash._meetings(0.8)(iter(batches)):
        for x, y, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            many.append((x, key)) if y is None else pairs.add((x, y))
    first, want = np.concatenate([[0], np.cumsum(count)]), set()
    for k, n in enumerate(count):
        if n <= simhash.RUN:
            own = range(first[k], first[k + 1])
            want |= {(x, y) for x in own for y in own if x < y and x // 2 != y // 2}
    assert pairs == want
    assert sorted(many) == [(x, k) for k, n in enumerate(count) if n > simhash.RUN for x in range(first[k], first[k + 1])]


def test_bit_maps_of_large_sets():
    """Sets of any size that are unlike are told apart, pair by pair and by shards; no pair that is alike enough is, also where maps differ in size."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    fresh = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    sets, alike = [], set()
    for n in (0, 1, 5, 40, 300, 1000, 1024, 1030, 2047, 2100, 4000, 4090, 9000, 20_000):
        own = fresh(n)
        both = round(n * 8 / 9)
        sets += [own, np.unique(np.concatenate([own[:both], fresh(n - both)])) if n % 2 else own[: int(np.ceil(0.8 * n))], fresh(n), np.unique(np.concatenate([own, fresh(n // 4)]))]
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                alike.add((a, b))
    sizes, maps = [len(x) for x in sets], [simhash.bit_map(x) for x in sets]
    assert len(set(map(len, maps))) > 3 and len(alike) > 30
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    columns = [[a for a, _ in pairs], [b for _, b in pairs], [sizes[a] for a, _ in pairs], [sizes[b] for _, b in pairs], [maps[a] for a, _ in pairs], [maps[b] for _, b in pairs]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n", "m", "x", "y"])
    found = lambda kernel, batch: {(r["a"], r["b"]) for out in kernel(0.8)(iter([batch])) for r in out.to_pylist()}
    some = found(simhash._possible, batch)
    large = lambda pairs: {(a, b) for a, b in pairs if min(sizes[a], sizes[b]) > 100}
    assert alike <= some and large(some) == large(alike)
    nodes = [{"node": k, "fp": sizes[k], "sig": maps[k]} for k in range(len(sets))]
    shards = [[{"shard": 0, "nodes": nodes[::2]}], [{"shard": 0, "nodes": nodes[::2]}, {"shard": 1, "nodes": nodes[1::2]}], [{"shard": 1, "nodes": nodes[1::2]}]]
    assert found(simhash._possible_of_shards, pa.RecordBatch.from_arrays([pa.array(shards)], names=["shards"])) == some


def test_meetings_grow_with_the_table(spark, monkeypatch):
    """Passages of 40 documents each are known as common however many documents there are, so few sets meet by them."""
    made, write, rng = [], simhash.materialize, random.Random(21)

    def counted(df, name, **options):
        out = write(df, name, **options)
        if name == "meetings":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "KNOWN", 200)
    for n in (400, 4000):
        texts = {d: " ".join([*(f"p{d % (n // 40)}-{i}" for i in range(30)), *(f"v{rng.randrange(10**7)}" for _ in range(200))]) for d in range(n)}
        got = simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8))
        assert {r.doc_id: r.component_id for r in got.collect()} == {d: d for d in texts}
    assert made[1] < 40_000


def test_common_shingles_without_a_rank(spark, monkeypatch):
    """Where more shingles are common than have a rank, the rest is told by a bit map: one order of all, and no link is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    order, common = simhash.Order(rng.permutation(values[:40]).view(np.int64)), values[:200].view(np.int64).tolist()
    known = lambda x: pa.array([v in common for v in x.to_pylist()])
    line = order.first(values, 0.0, known)[: len(values)].tolist()
    assert set(line[:300]) == set(values[200:].view(np.int64).tolist()) and set(line[-40:]) == set(values[:40].view(np.int64).tolist())
    for _ in range(20):
        own = np.sort(rng.choice(values, 60, replace=False))
        assert order.first(own, 0.8, known).tolist() == sorted(own.view(np.int64).tolist(), key=line.index)[:13]
    monkeypatch.setattr(simhash, "COMMON", 20)
    rand, passage, texts = random.Random(17), [f"p{k}" for k in range(40)], {}
    for k in range(0, 800, 2):
        own = [f"v{rand.randrange(10**6)}" for _ in range(50)] + passage
        differ = int((len(own) - 4) / 9)
        texts[k], texts[k + 1] = " ".join(own), " ".join([f"x{k}-{i}" for i in range(differ)] + own[differ:])
    want, links = plain_groups(texts)
    got = simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=100)
    assert len(links) >= 400 and {r.doc_id: r.component_id for r in got.collect()} == want


def test_batches_are_bounded_by_bytes(spark):
    """Rows of shards or whole sets may be large: a batch has a bound of bytes, not of rows only."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from treeplan.llm import shared

    shared.attach(spark)
    kernel = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    rows = spark.range(0, 600, 1, 1).select(F.array_repeat(F.struct(F.col("id").alias("node"), F.repeat(F.lit("y"), 128).alias("sig")), 400).alias("nodes"))
    sizes = [r.n for r in rows.mapInArrow(kernel, "n long").collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * shared.BATCH_BYTES


def test_large_sets_of_one_passage_are_not_compared(spark, monkeypatch):
    """Couples of long texts share a rare passage and nothing else: their whole sets need not meet."""
    rng, texts, left = random.Random(16), {}, []
    for k in range(0, 60, 2):
        passage = " ".join(f"p{k}-{i}" for i in range(20))
        for d in (k, k + 1):
            texts[d] = " ".join([passage, *(f"v{rng.randrange(10**6)}" for _ in range(4000))])
    texts[60] = texts[59].replace("v1", "w1", 30)
    find = simhash._not_yet_found

    def counted(*args):
        rest = find(*args)
        left.append(rest.count())
        return rest

    monkeypatch.setattr(simhash, "_not_yet_found", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert left == [0] and got == {d: min(d, 59) for d in texts}


def test_similar_groups_in_a_hot_band(spark):
    """A large group of near copies, some of them alike only to some others, in bands beyond the bound."""
    rng = random.Random(13)
    base, texts = [f"b{k}" for k in range(150)], {}
    for k in range(500):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 1, 2, 3])):
            own[at] = f"n{rng.randrange(40)}"
        texts[k] = " ".join(own)
    want, _ = plain_groups(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for hot in (4096, 100):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame, hot=hot).collect()} == want


def test_unlike_sets_in_a_hot_band(spark):
    """20,000 sets that share a band and nothing else are not compared with each other; likely pairs among them are."""
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 256, (20_000, simhash.HASHES), dtype=np.uint8)
    for k in range(0, 200, 2):  # alike to 0.87
        sigs[k + 1] = np.where(rng.random(simhash.HASHES) < 0.87, sigs[k], sigs[k + 1])
    nodes = spark.createDataFrame([(k, k, x.tobytes()) for k, x in enumerate(sigs)], "node long, fp long, sig binary")
    met = nodes.select("node", F.lit(7).cast("long").alias("key"), F.lit(20_000).cast("long").alias("n"), F.when(F.col("node") >= 15_000, F.lit(1)).cast("long").alias("kin"))
    pairs = set()
    for row in simhash._shard_pairs(simhash._dealt_again(met, nodes, simhash.HOT), nodes).collect():
        sides = [[x.node for x in s.nodes] for s in row.shards]
        pairs |= {(min(x, y), max(x, y)) for x in sides[0] for y in sides[-1] if x != y}
    assert len(pairs) < 1000 and sum((k, k + 1) in pairs for k in range(0, 200, 2)) >= 99
    assert simhash._dealt_again(met.withColumn("kin", F.lit(1).cast("long")), nodes, simhash.HOT).count() == 0
    assert simhash._dealt_again(met, nodes, 20_000).count() == 20_000


def test_similar_groups_of_a_common_passage(spark):
    """Documents that share a long passage, so bands are hot with unlike sets; pairs among them are alike."""
    rng = random.Random(14)
    passage, texts = [f"p{k}" for k in range(120)], {}
    for k in range(0, 500, 2):
        own = [f"o{rng.randrange(10**6)}" for _ in range(50)]
        texts[k] = " ".join(passage + own)
        own[rng.randrange(50)] = "new"
        texts[k + 1] = " ".join(passage + own) if k % 4 else " ".join(passage + own[:10])
    want, links = plain_groups(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=30).collect()}
    assert all(want[d] == want[c] for d, c in got.items())
    assert len(links) > 100 and sum(got[a] != got[b] for a, b, *_ in links) <= 0.02 * len(links)


def test_shards_of_one_kin_are_not_compared(spark):
    entries = spark.range(1000).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("key"), F.when(F.col("id") < 800, F.lit(5)).when(F.col("id") < 950, F.col("id")).cast("long").alias("kin"))
    nodes = spark.range(1000).select(F.col("id").alias("node"), F.col("id").alias("fp"), F.lit(b"s").alias("sig"))
    pairs = simhash._shard_pairs(entries, nodes).collect()
    met = set()
    for r in pairs:
        sides = [[n.node for n in s.nodes] for s in r.shards]
        met |= {(min(x, y), max(x, y)) for x in sides[0] for y in sides[-1] if x != y}
    assert met == {(x, y) for y in range(1000) for x in range(y) if y >= 800}


def test_spare_forests():
    """A link in doubt has others beside it; one beyond doubt needs none."""
    import pyarrow as pa

    base = bytes(range(128))

    def sent(step):
        nodes = [{"node": i, "fp": 0, "sig": base[: step * i] + bytes(128)[:step] + base[step * (i + 1) :]} for i in range(6)]
        kind = pa.list_(pa.struct([("shard", pa.int32()), ("nodes", pa.list_(pa.struct([("node", pa.int64()), ("fp", pa.int64()), ("sig", pa.binary())])))]))
        batch = pa.RecordBatch.from_arrays([pa.array([[{"shard": 0, "nodes": nodes}]], kind)], names=["shards"])
        return sum(len(b) for b in simhash._proposed(0.8)(iter([batch])))

    assert sent(0) == 5 and sent(19) > 10 and sent(21) == 0


def test_likeliest_links_step_by_step():
    """The same links as one by one over all forests, through several steps and with ties."""
    rng = np.random.default_rng(5)
    n = 150
    pairs = np.array([(x, y) for x in range(n) for y in range(x)])
    equal = np.where(pairs.sum(axis=1) % 2, rng.integers(85, 129, len(pairs)), rng.integers(60, 100, len(pairs)))
    pairs = pairs[equal >= 87]
    equal = equal[equal >= 87]
    forests, want = [shared.Forest() for _ in range(simhash.SPARE)], []
    for lack, x, y in sorted(zip((-equal).tolist(), *pairs.T.tolist())):
        joined = [f.join(x, y) for f in forests] if -lack >= 118 else [any(f.join(x, y) for f in forests)]
        if all(joined):
            want.append((x, y))
    x, y = simhash._likeliest(equal, pairs[:, 0], pairs[:, 1], n, 118)
    assert len(pairs) > 4096 and list(zip(x.tolist(), y.tolist())) == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.item: r.root for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    forest = shared.Forest()
    for a, b in pairs:
        if a != b:
            forest.join(a, b)
    assert got == {x: forest.root(x) for x in list(forest.up)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2 PII


def replaced(spark, *values, key="k"):
    frame = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text[4:-6] for r in sorted(pii.pseudonymize(frame, key).collect())]


def luhn(digits):
    d = [int(c) for c in re.sub(r"\D", "", digits)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pii_formats(spark):
    values = ["4111 1111 1111 1111", "4111111111111111", "4111111111111112", "+1 (555) 123-4567", "219-09-9999", "000-12-3456", "10.20.30.40", "300.1.1.1", "2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "jane.doe7@mail.example.com", "DE89 3704 0044 0532 0130 00", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "version 2.0"]
    got = dict(zip(values, replaced(spark, *values)))
    left = {"4111111111111112", "000-12-3456", "300.1.1.1", "2023-02-29", "version 2.0"}
    for same in left:
        assert got[same] == same
    for v in set(values) - left:
        assert got[v] != v
        if "." not in v or "@" in v:
            assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", got[v]))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", v))) or v.startswith("9f86")
    assert luhn(got["4111111111111111"]) % 10 == 0
    assert got["4111 1111 1111 1111"].replace(" ", "") == got["4111111111111111"]
    assert re.fullmatch("[0-9a-f]{40}", got["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"])
    iban = got["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert replaced(spark, *values) == list(got.values()) and replaced(spark, values[0], key="other") != [got[values[0]]]


def test_pii_numbers_beside_digits(spark):
    card, other = "4111 1111 1111 1111", "5555555555554444"
    values = [f"{card} {card}", f"{other} 4111111111111111", f"{card} 12/26", "4111111111111111 123", f"order 12 {card}", f"{card} 123 {other}", f"{card} 2024-05-01", f"2024-05-01 {card}", "4111 1111 1111 1112 " + other, "41 11 11 11 11 11 11 11 (555) 123-4567", f"\x00 {other} \x00", f"AB12 {card}", "378282246310005 10.20.30.40"]
    got = dict(zip(values, replaced(spark, *values)))
    one, two, day = replaced(spark, card, other, "2024-05-01")
    flat = one.replace(" ", "")
    want = {
        values[0]: f"{one} {one}", values[1]: f"{two} {flat}", values[2]: f"{one} 12/26", values[3]: f"{flat} 123", values[4]: f"order 12 {one}", values[5]: f"{one} 123 {two}",
        values[6]: f"{one} {day}", values[7]: f"{day} {one}", values[8]: f"4111 1111 1111 1112 {two}", values[10]: f"\x00 {two} \x00", values[11]: f"AB12 {one}",
    }
    assert {v: got[v] for v in want} == want
    assert got[values[9]] == " ".join(replaced(spark, "41 11 11 11 11 11 11 11", "(555) 123-4567"))
    assert got[values[12]] == " ".join(replaced(spark, "378282246310005", "10.20.30.40"))


def test_pii_phones_beside_digits(spark):
    phones = ["+1 (826) 555-4081", "+49 170 1234567", "+44 20 7946 0958", "+493012345678", "+49 170.12.34.56.78", "+33 6 12 34 56 78", "(555) 123-4567", "555-123-4567"]
    others = ["190.137.223.204", "2024-05-01", "4111 1111 1111 1111", "219-09-9999", "5555555555554444"]
    values = [f"{p} {o}" for p in phones for o in others]
    first, second = replaced(spark, *phones), replaced(spark, *others)
    assert not set(first) & set(phones) and not set(second) & set(others)
    assert replaced(spark, *values) == [f"{p} {o}" for p in first for o in second]
    assert replaced(spark, "+1 (826) 555-4081 42 300.137.223.204") == [f"{first[0]} 42 300.137.223.204"]
    assert replaced(spark, *[f"{p} 300.137.223.204" for p in phones]) == [f"{p} 300.137.223.204" for p in first]
    assert replaced(spark, "AT61 1904 3002 3457 3201 4111 1111 1111 1111") == [" ".join(replaced(spark, "AT61 1904 3002 3457 3201", "4111 1111 1111 1111"))]


def test_pii_permutes(spark):
    """Distinct values stay distinct: all 7-digit local parts' last two digits, and a run of days."""
    mails = [f"a{k:02d}@x.org" for k in range(100)]
    days = [f"19{k:02d}-01-31" for k in range(100)]
    for values in (mails, days):
        got = replaced(spark, *values)
        assert len(set(got)) == len(values) and not set(got) == set(values)


def plain_digest_of(key, kind, n, other):
    return "".join(hashlib.sha256(f"{key}\x1f{kind}\x1f{n}\x1f{other}\x1f{k}".encode()).hexdigest() for k in (0, 1))


def plain_permuted(text, key, kind, letters=26, back=False):
    """The Feistel network over classes of characters, and its inverse."""

    def shifted(half, stream, sign):
        out = ""
        for i, c in enumerate(half):
            step = sign * int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
            base, n = (48, 10) if "0" <= c <= "9" else (97, letters) if "a" <= c <= "z" else (65, letters) if "A" <= c <= "Z" else (None, None)
            out += c if base is None else chr(base + (ord(c) - base + step) % n)
        return out

    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    if back:  # after an even number of rounds halves have their old lengths
        for n in range(10, 0, -1):
            left, right = shifted(right, plain_digest_of(key, kind, n, left), -1), left
    else:
        for n in range(1, 11):
            left, right = right, shifted(left, plain_digest_of(key, kind, n, right), 1)
    return left + right


def plain_bits(value, bits, key, kind, back=False):
    mask = (1 << bits) - 1
    left, right = value >> bits, value & mask
    f = lambda n, r: int(plain_digest_of(key, kind, n, r)[:8], 16) & mask
    for n in range(10, 0, -1) if back else range(1, 11):
        left, right = (right ^ f(n, left), left) if back else (right, left ^ f(n, right))
    return left << bits | right


def plain_pair(a, b, sizes, key, kind, back=False):
    f = lambda n, other: int(hashlib.sha256(f"{key}\x1f{kind}\x1f{n}\x1f{other}".encode()).hexdigest()[:12], 16)
    for n in range(10, 0, -1) if back else range(1, 11):
        if back:
            b = (b - f(n, a)) % sizes[1]
            a = (a - f(n, b)) % sizes[0]
        else:
            a = (a + f(n, b)) % sizes[0]
            b = (b + f(n, a)) % sizes[1]
    return a, b


def plain_date(text, key, back=False):
    import datetime

    def real(y, m, d):
        try:
            return datetime.date(y, m, d)
        except ValueError:
            return None

    mark = re.search(r"[./-]", text)[0]
    p = text.split(mark)
    n = [int(x) for x in p]
    order = (0, 1, 2) if mark == "-" else (2, 0, 1) if mark == "/" and real(n[2], n[0], n[1]) else (2, 1, 0)
    least = 13 if mark == "/" and order == (2, 1, 0) else 1
    months, days = 9 if len(p[order[1]]) == 1 else 12, (9 if len(p[order[2]]) == 1 else 31) - least + 1
    kind = f"date{'//' if least == 13 else mark}{months},{days}"
    a, b = (n[order[0]] - 1900) * months + n[order[1]] - 1, n[order[2]] - least
    while True:
        a, b = plain_pair(a, b, (200 * months, days), key, kind, back)
        y, m, d = a // months + 1900, a % months + 1, b + least
        if real(y, m, d):
            break
    out = [None] * 3
    for k, v in zip(order, (y, m, d)):
        out[k] = str(v).zfill(len(p[k]))
    return mark.join(out)


def plain_digits(text, new):
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), text)


def plain_pseudonym(kind, v, key, back=False):
    digits = re.sub(r"\D", "", v)
    if kind == "date":
        return plain_date(v, key, back)
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        new = plain_bits(o[0] << 24 | o[1] << 16 | o[2] << 8 | o[3], 16, key, "ip", back)
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        while True:
            digits = plain_permuted(digits, key, "ssn", back=back)
            if not re.search(r"^(?:000|666|9)|^\d{3}00|0000$", digits):
                return plain_digits(v, digits)
    if kind == "number":
        body = plain_permuted(digits[:-1], key, "number", back=back)
        return plain_digits(v, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        head = re.match(r"(?:\+\d{1,3}(?=[ .(-]))?", v)[0]
        return head + plain_digits(v[len(head) :], plain_permuted(digits[len(re.sub(r"\D", "", head)) :], key, "phone", back=back))
    if kind == "email":
        own, _, host = v.partition("@")
        return f"{plain_permuted(own, key, 'email', back=back)}@{host}"
    if kind == "secret":
        return plain_permuted(v, key, "secret", 6, back)
    land, own = v.replace(" ", "")[:2], v.replace(" ", "")[4:]
    own = plain_permuted(own, key, "iban", back=back)
    number = int("".join(str(int(c, 36)) for c in own + land + "00"))
    it = iter(f"{land}{98 - number % 97:02d}{own}")
    return re.sub("[A-Z0-9]", lambda _: next(it), v)


def made_values(rng):
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    for _ in range(40):
        body = digits(15)
        card = body + str(-luhn(body + "0") % 10)
        yield "number", rng.choice([card, " ".join(card[i : i + 4] for i in (0, 4, 8, 12))])
        yield "phone", rng.choice([f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{digits(4)}", f"+49 170 {digits(7)}", f"{rng.randrange(200, 1000)}-{digits(3)}-{digits(4)}"])
        yield "ssn", f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        yield "ip", ".".join(str(rng.randrange(256)) for _ in range(4))
        yield "email", "".join(rng.choices("abcXYZ019._-", k=rng.randrange(1, 12))) + "@mail.example.org"
        yield "secret", "a1" + "".join(rng.choices("0123456789abcdef", k=rng.randrange(22, 60)))
        own = digits(18)
        yield "iban", f"DE{98 - int(own + '131400') % 97:02d}{own}"
        yield "date", rng.choice(["{y}-{m:02d}-{d:02d}", "{d:02d}.{m:02d}.{y}", "{d}.{m}.{y}", "{m}/{d}/{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}"]).format(y=rng.randrange(1900, 2100), m=rng.randrange(1, 13), d=rng.randrange(1, 29))


def test_pii_is_the_plain_network(spark):
    """Every kind against a plain Feistel network, and back by its inverse."""
    values = sorted(set(made_values(random.Random(11))))
    got = replaced(spark, *[v for _, v in values])
    for (kind, v), new in zip(values, got, strict=True):
        assert new == plain_pseudonym(kind, v, "k"), (kind, v)
        assert plain_pseudonym(kind, new, "k", back=True) == v, (kind, v)


def test_pii_dates_are_one_to_one(spark):
    """All days of 200 years in each format: as many pseudonyms, all real days of the same format, none another format's."""
    days = spark.sql("SELECT explode(sequence(date'1900-01-01', date'2099-12-31')) AS d")
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy"]
    written = days.select(F.explode(F.array(*[F.date_format("d", f) for f in forms])).alias("text")).distinct()
    made = pii.pseudonymize(written.withColumn("doc_id", F.lit(1)).withColumn("was", F.col("text")).select(F.col("was").alias("doc_id"), "text"), "k")
    shape = lambda c: F.regexp_replace(c, r"\d", "9")
    row = made.agg(F.count("*").alias("n"), F.countDistinct("text").alias("distinct"), F.count_if(shape("text") != shape("doc_id")).alias("other"), F.min("n_replaced").alias("least")).first()
    assert row.n == row.distinct and row.other == 0 and row.least == 1 and row.n > 250_000


def test_pii_documents(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op2_pii(spark, sf).collect()}
    assert set(rows) == set(texts)
    private = re.compile(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|\d{1,3}(?:\.\d{1,3}){3}")
    for d, t in texts.items():
        found = private.findall(t)
        invalid = {x for x in found if re.fullmatch(r"\d{16}", x) and luhn(x) % 10}
        assert all((x in rows[d].text) == (x in invalid) for x in found)
        found = set(found) - invalid
        if not found and "token" not in t:
            assert rows[d].text == t


def test_pii_odd(odd, none):
    got = collections.Counter((r.doc_id, r.text) for r in pii.pseudonymize(odd, "k").collect())
    assert got == collections.Counter(ODD)
    assert pii.pseudonymize(none, "k").count() == 0


# 3 top-k


def test_topk(spark, sf, duck):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op3_topk(spark, sf).collect())
    assert got == sorted(duck.execute(queries.ORACLES["op3_topk"]).fetchall())


def test_topk_odd(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "LEAST", 8)
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(60)] + [(100 + k, [0.5] * 5) for k in range(40)]
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (None, [1.0] * 5), (205, [1.0, 2.0]), (300, [1e12] * 5), rows[20]]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in {i for i, _ in good if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, own in good if j == q for i, v in good if i != q and len(v) == len(own))[:7]
        assert sorted(got[q]) == [(n, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(scored, 1)]
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 32))
def test_bounds(seed, dims, segments):
    rng = np.random.default_rng(seed)
    q, x = rng.normal(size=(3, dims)), rng.normal(size=(5, dims))
    assert (topk.statistics(q, segments) @ topk.statistics(x, segments).T >= q @ x.T - 1e-9).all()


def test_levels_go_coarse_to_fine(monkeypatch):
    """Vectors with structure: each level leaves fewer pairs, the last few of all, and results are those of all scores."""
    rng = np.random.default_rng(5)
    shapes = np.repeat(rng.integers(-60, 61, (40, 8)), 8, axis=1)  # segments of eight differ in their means
    x = (shapes[rng.integers(0, 40, 3000)] + rng.integers(-3, 4, (3000, 64))).astype(np.float64)
    seen, ids = [], np.arange(3000)
    for dense in (1 / 32, 2.0):
        monkeypatch.setattr(topk, "DENSE", dense)
        got = {i: (rows.tolist(), s.tolist()) for i, rows, s in topk.search(x[:200], ids[:200], x, ids, 20, seen)}
        for i in range(200):
            want = sorted((-float(x[i] @ x[j]), j) for j in range(3000) if j != i)[:20]
            assert got[i] == ([j for _, j in want], [-s for s, _ in want])
    left = np.array(seen).sum(axis=0)
    assert (np.diff(left) <= 0).all() and left[1] < left[0] and left[-1] < 0.1 * left[0]


# 4 and 8 packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab'st \n\r\t.,1é ñ¿Ü \x1c", max_size=40))
def test_ids(text):
    enc = tokens.encoder(**queries.vocabulary())
    assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


def check_packed(rows, want, width=1024):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= width
    assert len({r.sequence_id for r in rows}) == len(rows) and set(by) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_powers(spark, sf, texts, tokenizer):
    check_packed(queries.op4_powers(spark, sf).collect(), {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()})


def test_powers_odd(odd, none, tokenizer):
    rows = powers.pack(odd.where("doc_id <> 5 or doc_id is null"), **queries.vocabulary(), keep_ids=False).collect()
    check_packed(rows, {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in ODD if d != 5})
    twice = powers.pack(odd.where("doc_id = 5"), **queries.vocabulary()).collect()
    assert len({r.sequence_id for r in twice}) == len(twice) == 2 * len({r.start for r in twice})
    assert powers.pack(none, **queries.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        powers.pack(none, **queries.vocabulary(), longest=1000)


@settings(deadline=None)
@given(st.integers(0, 20_000), st.integers(4, 12))
def test_pieces_of_powers(n, k):
    got = powers.pieces(n, 1 << k)
    assert sum(m for _, m in got) == n and all(m & (m - 1) == 0 and m <= 1 << k for _, m in got)
    assert [a for a, _ in got] == [0, *itertools.accumulate(m for _, m in got)][: len(got)]


@settings(deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    got = bestfit.best_fit(lengths, 50)
    rooms, plain = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in set(rooms) if r >= lengths[i]]
        if fits:
            k = max(j for j, r in enumerate(rooms) if r == min(fits))
            rooms[k] -= lengths[i]
        else:
            rooms.append(50 - lengths[i])
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in got)
    assert sorted(50 - sum(lengths[i] for i in b) for b in got) == sorted(rooms)


def unpacked(rows, width):
    got = collections.defaultdict(list)
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(at) == width and r.cu_seqlens[-1] == r.used
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            got[d].append((s, ids[a:b].tolist()))
            assert at[a:b].tolist() == list(range(b - a))
    return {d: sum((x for _, x in sorted(v)), []) for d, v in got.items()}


def test_bestfit(spark, sf, texts, odd, none):
    enc = tokens.encoder(**queries.vocabulary())
    rows = queries.op8_bestfit(spark, sf).collect()
    assert unpacked(rows, 2048) == {d: [*enc.ids(t or "").tolist(), 50256] for d, t in texts.items()}
    assert sum(r.used for r in rows) > 0.9 * 2048 * len(rows)
    made = bestfit.sequences(bestfit.token_matrices(odd.where("doc_id <> 5 or doc_id is null"), **queries.vocabulary(), width=64)).collect()
    assert unpacked(made, 64) == {d: [*enc.ids(t or "").tolist(), 50256] for d, t in ODD if d != 5}
    assert bestfit.token_matrices(none, **queries.vocabulary()).count() == 0


# 5 languages


def test_written_matrices_come_back(spark, docs, tmp_path):
    made = bestfit.token_matrices(docs, **queries.vocabulary(), width=512)
    bestfit.write_matrices(made, f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    assert back.schema == made.schema and unpacked(bestfit.sequences(back).collect(), 512) == unpacked(bestfit.sequences(made).collect(), 512)


def test_work_tables_are_cleared(spark):
    table = shared.materialize(spark.range(3), "some")
    other = shared.materialize(spark.range(3), "other")
    folder = shared.work_folder(spark).removeprefix("file://")
    assert os.path.exists(other._treeplan_path.removeprefix("file://"))
    shared.discard(other)
    assert not os.path.exists(other._treeplan_path.removeprefix("file://")) and table.count() == 3
    shared.discard(spark.range(1))  # no work table: nothing happens
    assert os.path.isdir(folder)
    shared.clear_work(spark)
    assert not os.path.exists(folder)
    assert shared.materialize(spark.range(3), "again").count() == 3


def test_langid_knows_what_it_has_not_learned(spark, docs):
    """A whole text in a script that no label has is predicted, but with a score of 0."""
    model = langid.train(docs, "text", "lang", F.col("doc_id"))
    lone = spark.createDataFrame([(1, "\u13a0\u13a1\u13a2 \u10a0\u10a1\u10a2 \u0531\u0532"), (2, "1 2 3"), (3, docs.where("lang = 'en'").first().text)], "doc_id long, text string")
    got = {r.kept.doc_id: r for r in langid.predict(lone, model).collect()}
    assert got[1].lang_pred != "und" and got[1].score == 0 and got[2].lang_pred == "und" and got[3].score > 0.9


def test_langid(spark, sf, docs):
    rows, langs = queries.op5_langid(spark, sf).collect(), {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_langid_learns_any_number_of_languages(spark, docs):
    """Languages beyond those that have all buckets are learned too, with fewer buckets, in a model of the same bound."""
    many = docs.where("lang is not null").select("doc_id", F.col("text"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 400).cast("string")).alias("lang"))
    wide, narrow = (langid.train(many, "text", "lang", F.col("doc_id"), cells=c) for c in (langid.CELLS, 1 << 18))
    assert wide.langs == narrow.langs == sorted({r.lang for r in many.collect()}) and len(wide.langs) > 128
    assert narrow.table.size <= 1 << 18 and wide.table.size <= langid.CELLS
    few = langid.train(docs, "text", "lang", F.col("doc_id"), cells=6 << 13)
    assert few.table.shape[0] < 1 << langid.BITS
    got, truth = langid.predict(docs, few).collect(), {r.doc_id: r.lang for r in docs.collect()}
    known = [(r.lang_pred, truth[r.kept.doc_id]) for r in got if truth[r.kept.doc_id]]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def _plain_words(text):
    """(first code point, code points) of each run of letters and marks."""
    at, found = 0, []
    for inside, run in itertools.groupby(text, lambda c: unicodedata.category(c)[0] in "LM"):
        n = len(list(run))
        if inside:
            found.append((at, text[at : at + n]))
        at += n
    return found


def _plain_trigrams(word):
    """The bucket of each letter with its neighbours, by Python's integers."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    for a, b, c in zip([0, *low], low, [*low[1:], 0]):
        h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2**64
        yield ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - langid.BITS)


def _plain_script(c):
    return [name for first, name in langid.SCRIPTS if first <= ord(c)][-1]


def test_langid_is_the_plain_scorer(spark, docs):
    """The learned counts, word scores, scripts, paths, spans and shares, all made again letter by letter."""
    rows = [r for r in docs.collect() if r.text is not None]
    fitted = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    grams, scripts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in fitted:
        for _, word in _plain_words(r.text):
            grams[r.lang].update(_plain_trigrams(word))
            scripts[r.lang][_plain_script(word[0])] += sum(unicodedata.category(c)[0] == "L" for c in word)
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) + 0.1 * 2**langid.BITS for x in langs}
    uses = {x: {s for s, n in scripts[x].items() if n >= max(1, langid.SHARE * sum(scripts[x].values()))} for x in langs}
    known = set().union(*uses.values())

    def scores(word):
        script = _plain_script(word[0])
        out = [sum(math.log((grams[x][g] + 0.1) / total[x]) for g in _plain_trigrams(word)) if script in uses[x] or script not in known else -math.inf for x in langs]
        return [max(v - max(out), -langid.CLIP) for v in out]

    mixed = [(10**6, f"{rows[0].text[:300]} {rows[-1].text[-300:]}"), (10**6 + 1, "Ελληνικά κείμενο, then some words of another kind"), (10**6 + 2, "12 34"), (10**6 + 3, "")]
    asked = [(r.doc_id, r.text[:1500]) for r in rows[:60]] + mixed
    frame = spark.createDataFrame(asked, "doc_id long, text string")
    got = {r.kept.doc_id: r for r in langid.predict(frame, langid.train(docs.where(~langid.held_out()), "text", "lang", F.col("doc_id"))).collect()}
    assert len(got) == len(asked)
    for doc_id, text in asked:
        words, row = _plain_words(text), got[doc_id]
        letters = [sum(unicodedata.category(c)[0] == "L" for c in w) for _, w in words]
        if not sum(letters):
            assert (row.lang_pred, row.score, row.spans) == ("und", 0.0, [])
            continue
        s = [scores(w) for _, w in words]
        best = [(s[0][j], (j,)) for j in range(len(langs))]
        for line in s[1:]:
            before = max(range(len(langs)), key=lambda j: best[j][0])
            best = [max((best[j][0], best[j][1]), (best[before][0] - langid.SWITCH, best[before][1]), key=lambda p: p[0]) for j in range(len(langs))]
            best = [(v + line[j], (*way, j)) for j, (v, way) in enumerate(best)]
        # the operator's path, read off its spans, is worth as much as the best; all else follows from that path
        own = [next(langs.index(x.lang) for x in row.spans if x.start <= at < x.stop) for at, _ in words]
        worth = sum(line[j] for line, j in zip(s, own)) - langid.SWITCH * sum(a != b for a, b in zip(own, own[1:]))
        assert worth >= max(v for v, _ in best) - 1e-2
        by = [sum(n for n, j in zip(letters, own) if j == k) for k in range(len(langs))]
        assert row.lang_pred == langs[by.index(max(by))]
        sure = sum(n for n, j, (_, w) in zip(letters, own, words) if langs[j] == row.lang_pred and _plain_script(w[0]) in known)
        assert row.score == pytest.approx(sure / sum(letters))
        assert [x.start for x in row.spans] == [at for k, (at, _) in enumerate(words) if not k or own[k] != own[k - 1]]
        assert [x.stop for x in row.spans] == [at + len(w) for k, (at, w) in enumerate(words) if k + 1 == len(own) or own[k] != own[k + 1]]


def test_langid_ignores_labels_of_held_out(docs):
    changed = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    pick = lambda d: {r.kept.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()}
    assert pick(docs) == pick(changed)


def test_langid_spans(docs, spark):
    model = langid.train(docs, "text", "lang", F.col("doc_id"))
    by = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 800").orderBy(F.desc("doc_id")).collect() if not re.search("[|#$%&*!]", r.text[:800])}
    a, b = by["en"], by["de"]
    row = langid.predict(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and abs(row.spans[1].start - len(a)) < 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-4, 0), min_size=3, max_size=3), min_size=1, max_size=7), st.floats(0.5, 5))
def test_viterbi(scores, switch):
    s = np.array(scores, np.float64)
    value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    assert value(langid.path(s, switch).tolist()) >= max(map(value, itertools.product(range(3), repeat=len(s)))) - 1e-6


def test_langid_odd(odd, none):
    rows = langid.identify(odd).collect()
    got = {r.kept.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3)) and got[7].lang_pred == "en"
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 6 chat


def plain_digest(rows):
    by = collections.defaultdict(list)
    low = lambda x: (x is not None, x)
    for c, n, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
    return out


def digest(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(frame).collect()}


def test_chat(spark, sf, duck):
    said = "</s>[INST] ok [/INST]"
    rows = duck.execute("select conv_id, turn, role, text from conversations").fetchall() + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op6_chat(spark, sf).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == plain_digest(rows)
    assert all(r.formatted_chars >= r.loss_chars for r in got.values())


@pytest.mark.parametrize("budget, history, most", [(240, 80, 3), (4096, 1024, 4), (1, 0, 0)])
def test_chat_windows(spark, budget, history, most):
    rng = random.Random(budget)
    parts = ["<|start|>", "<|end|>\n", "<\\|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[\\\\INST]", "\\", "\n", "word ", "<", "[", "é"]
    rows = [(c, t, "system" if not t and c % 2 else rng.choice(["user", "assistant", "to\nol\\n"]), "".join(rng.choices(parts, k=rng.randrange(20)))) for c in range(12) for t in range(rng.randrange(1, 25))]
    rows += [(50, 0, None, None), (50, 0, None, None), (None, 3, "assistant", "x"), (None, None, "user", "y"), (51, 1, "assistant", LONG)]
    frame = chat.windows(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, loss string"), budget, history, most)
    assert digest(frame) == plain_digest(rows)
    for w in frame.collect():
        bodies = re.findall(r"<\|start\|>.*?<\|end\|>\n", w.formatted, re.S)
        assert "".join(bodies) == w.formatted
        cost = lambda xs: sum(len(x.encode()) for x in xs)
        assert cost(bodies) <= budget or len(bodies) - w.n_repeated == 1
        assert w.n_repeated == 0 if w.window == 0 else w.n_repeated <= most + 1


def test_chat_long_conversations(spark):
    """Linear in a conversation's turns, also in one of null ids; windows are those of a plain loop."""
    turns = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") < 2, "system").when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"), (F.col("id") % 50 + 5).alias("tokens"))
    rows = chat.windows(turns, 200, 60, 3, cost_col="tokens").select("conv_id", "window", "formatted", "n_repeated").collect()
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.conv_id][r.window] = ([int(x) for x in re.findall("turn ([0-9]+)", r.formatted)], r.n_repeated)
    for conv, first in ((7, 0), (None, 1)):
        ids = list(range(first, 100_000, 2))
        cost, at, want = [k % 50 + 5 for k in ids], 0, {}
        while at < len(ids):
            past = max([k for k in range(4) if at - k >= min(at, 1) and sum(cost[at - k : at]) <= 60]) if at else 0
            room, to = 200 - (cost[0] + sum(cost[at - past : at]) if at else 0), at
            while to < len(ids) and to // chat.STRETCH == at // chat.STRETCH and (to == at or sum(cost[at : to + 1]) <= room):
                to += 1
            repeated = ([0] if at else []) + list(range(at - past, at))
            want[len(want)] = ([ids[k] for k in (*repeated, *range(at, to))], len(repeated))
            at = to
        assert got[conv] == want


def test_chat_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(frame).count() == 0


# 7 pieces


def test_pieces(spark, sf, texts, docs):
    rows = {r.doc_id: r for r in queries.op7_pieces(spark, sf).collect()}
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows.values())
    again = pieces.encode(docs.repartition(7), model).collect()
    assert {r.doc_id: r.ids for r in again} == {d: r.ids for d, r in rows.items()}
    other = {r.doc_id: r.ids for r in pieces.encode(docs, model, seed=8).collect()}
    assert sum(other[d] != rows[d].ids for d in rows) > 0.9 * len(rows)
    back = pieces.decode(pieces.encode(docs, model), model)
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_pieces_odd(odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert sorted((r.doc_id, r.text or "") for r in pieces.decode(pieces.encode(odd, model), model).where("doc_id is not null").collect()) == sorted((d, t or "") for d, t in ODD if d is not None)
    assert {r.doc_id: r.ids for r in rows}[1] is None and {r.doc_id: r.ids for r in rows}[2] == []
    assert pieces.encode(none, model).count() == 0


def test_pieces_distribution():
    """Many draws of one word against the exact shares of all its segmentations."""
    vocab = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    text, lattice = "thenas", vocab.lattice(" thenas")

    def spell(end):
        if end == 0:
            return [((), 1.0)]
        return [((*p, i), w * v) for s, i, v in lattice[end] for p, w in spell(s)]

    exact = dict(spell(len(text) + 1))
    total = sum(exact.values())
    n = 20_000
    drawn = collections.Counter(tuple(x.tolist()) for x in pieces.Sampler(vocab, 3).draw([pieces.row_key(k) for k in range(n)], [text] * n))
    assert set(drawn) <= set(exact)
    for ids, w in exact.items():
        p = w / total
        assert abs(drawn[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_pieces_short_and_long_units_agree(monkeypatch):
    vocab = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = ["the worthless Übermut\n", "aaaaaaaa bbbb  c   d", "日本 語x"]
    first = [x.tolist() for x in pieces.Sampler(vocab, 1).draw([1, 2, 3], texts)]
    monkeypatch.setattr(pieces, "LONG", 2)
    assert [x.tolist() for x in pieces.Sampler(vocab, 1).draw([1, 2, 3], texts)] == first


# 9 fingerprints


def common(a, b):
    p = len(os.path.commonprefix([a, b]))
    return p + min(min(len(a), len(b)) - p, len(os.path.commonprefix([a[::-1], b[::-1]])))


@functools.cache
def gram_level(gram):
    """Zero bits at the end of a gram's hash, from its code points one by one."""
    p, b = prefixes.PRIMES[0]
    value = sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(gram)) % p
    mixed = (value * prefixes.MIX % 2**64) >> 32
    return next((z for z in range(32) if mixed >> z & 1), 32)


def likeness(a, b):
    """Share of the longer text in equal spans, from the texts themselves: the plain version of what two fingerprints tell."""
    if not a and not b:
        return 1.0

    def levels(t):
        may = [(i, z, t[i - prefixes.GRAM : i]) for i in range(prefixes.GRAM, len(t)) if (z := gram_level(t[i - prefixes.GRAM : i])) >= prefixes.LEAST]
        found = {i: z for k, (i, z, gram) in enumerate(may) if all(gram != g for _, _, g in may[max(0, k - prefixes.SINCE) : k])}
        return found, next(z for z in range(prefixes.LEAST, 40) if sum(x >= z for x in found.values()) <= prefixes.CUTS)

    (x, p), (y, q) = levels(a), levels(b)

    def spans(t, found):
        at = [0, *sorted(i for i, z in found.items() if z >= max(p, q)), len(t)]
        return collections.Counter(t[i:j] for i, j in zip(at, at[1:]))

    return sum(len(t) * n for t, n in (spans(a, x) & spans(b, y)).items()) / max(len(a), len(b))


def check_prefixes(rows, ordered):
    assert len(rows) == len(ordered)
    prints = collections.defaultdict(set)
    for r, (d, t), (_, n) in zip(rows, ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + n[:k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(t, edited)) and r.near_next == pytest.approx(likeness(t, n))
        assert r.near_edited == prefixes.likeness(r.fingerprint, r.edited_fingerprint)
        assert (r.common_edited, r.common_next) == (common(t, edited), common(t, n))
        prints[t].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)


def test_prefixes(spark, sf, texts):
    rows = sorted(queries.op9_prefixes(spark, sf).collect(), key=lambda r: r.doc_id)
    check_prefixes(rows, sorted(texts.items()))
    # the half that stays is told from fingerprints alone, up to the span at its edge; unlike neighbours have little
    long = [r for r in rows if r.n_chars >= 1000]
    assert np.mean([abs(r.near_edited - r.common_edited / r.n_chars) for r in long]) < 0.1
    assert np.median([r.near_next for r in long]) < 0.05 and max(len(r.fingerprint) for r in rows) < 1000


def test_prefixes_moved(texts):
    """A passage is found again wherever it stands; one word changed costs one span."""
    told = lambda t: prefixes.Prefixes(t).fingerprint()
    some = sorted((t for t in texts.values() if t and 2000 < len(t) < 6000), key=len)[:20]
    moved = [prefixes.likeness(told(t), told(t[k:] + t[:k])) for t in some for k in (len(t) // 3,)]
    changed = [prefixes.likeness(told(t), told(t[:k] + "#" + t[k + 1 :])) for t in some for k in (len(t) // 3,)]
    assert np.median(moved) > 0.7 and np.median(changed) > 0.8
    runs = "La " * 300 + "qui " * 300 + "etze " * 300 + "ne " * 300
    assert prefixes.likeness(told(runs), told(runs[:2500] + "x" + runs[2500:])) > 0.4
    for odd in ("", "a", "a" * 5000, "ab" * 3000, "\U0001f600" * 40):
        assert prefixes.likeness(told(odd), told(odd)) == 1.0 and len(told(odd)) < 1000


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=300), st.text("abc", max_size=300), st.integers(0, 300))
def test_prefixes_likeness(a, b, k):
    b = a[:k] + b
    x, y = prefixes.Prefixes(a).fingerprint(), prefixes.Prefixes(b).fingerprint()
    assert prefixes.likeness(x, y) == pytest.approx(likeness(a, b))
    assert prefixes.likeness(x, y) == prefixes.likeness(y, x)


def test_prefixes_odd(odd, none, spark):
    rows = [(d, t or "") for d, t in ODD if d is not None and d != 5]
    got = prefixes.fingerprints(odd.where("doc_id <> 5")).collect()
    check_prefixes(sorted(got, key=lambda r: r.doc_id), sorted(rows))
    assert len(prefixes.fingerprints(odd).collect()) == len(ODD)
    assert prefixes.fingerprints(none).count() == 0
    one = prefixes.fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=30), st.text("ab", max_size=30), st.data())
def test_spans(a, b, data):
    x, y = prefixes.Prefixes(a), prefixes.Prefixes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    assert x.extension(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
    assert prefixes.Prefixes.joined(x, i, y, j).fingerprint() == prefixes.Prefixes(a[:i] + b[:j]).fingerprint()


# 10 substrings


def plain_dedup(rows, size=20):
    """rows: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone.update(range(i, i + size))
            seen.add(k)
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def test_substrings(spark, sf, texts, duck):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substrings(spark, sf).collect()}
    assert got == plain_dedup(texts.items())
    assert {d: tuple(v) for d, *v in duck.execute(queries.ORACLES["op10_substrings"]).fetchall()} == got


def test_substrings_odd(odd, none, spark):
    rows = substrings.dedup(odd.where("doc_id <> 5 or doc_id is null")).collect()
    lowest = -(1 << 63)
    want = plain_dedup([(lowest if d is None else d, t) for d, t in ODD if d != 5])
    assert {lowest if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    twice = spark.createDataFrame([(1, " ".join(map(str, range(30)))), (1, " ".join(map(str, range(30)))), (2, "x " + " ".join(map(str, range(30))))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.dedup(twice).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert substrings.dedup(none).count() == 0


def thue_morse(n, x="a", y="b"):
    out = x, y
    while len(out[0]) < n:
        out = out[0] + out[1], out[1] + out[0]
    return out


def test_substrings_unlike_words_of_equal_polynomials(spark):
    """Polynomials modulo 2^64 can't tell these words apart, whatever their base."""
    one, two = thue_morse(1024)
    raw, starts = shared.utf8(__import__("pyarrow").array([one, two]))
    assert len(set(substrings.word_hashes(raw, starts)[0].tolist())) == 1
    rows = [(1, " ".join([*(f"w{k}" for k in range(19)), one])), (2, " ".join([*(f"w{k}" for k in range(19)), two]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize(
    "sizes",
    [
        substrings.Sizes(counted=4000, block_bits=(3, 4), held=40, step=200),  # far too few counters, tiny runs
        substrings.Sizes(block_bits=(3, 6), blocks=4, held=40, step=200),  # many small blocks
    ],
)
def test_substrings_whatever_the_sketch(spark, sizes):
    """Overfull, tiny or partitioned sketches and heavy repetition lose and add nothing."""
    rng = random.Random(9)
    base = [rng.choices(WORDS[:6], k=90) for _ in range(4)]
    rows = [(100, None), (101, ""), (102, " ".join(f"u{k}" for k in range(300)))]
    for d in range(60):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(90)] = rng.choice(WORDS)
        rows.append((d, "  ".join(own * rng.randrange(1, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs, sizes=sizes).collect()}
    assert got == plain_dedup(rows)


def test_sketch_keeps_its_load():
    """Counters grow with the text, so a unique window passes as seldom at any size."""
    for n in (10**6, 10**9, 3 * 10**10, 10**14):
        at = substrings.Layout(n, substrings.Sizes())
        assert at.blocks << at.bits >= n // 8 and at.blocks < 1 << 31
    layout = substrings.Layout(1 << 23, substrings.Sizes())  # 28 anchors in a thousand bytes is usual
    rng = np.random.default_rng(3)
    anchors = rng.integers(0, 2**63, 235_000).astype(np.uint64)
    passed = 0
    for block in range(layout.blocks):
        own = anchors[layout.block(anchors) == block]
        bits = np.packbits(np.bincount(np.concatenate([layout.cell(own, r) for r in range(2)]), minlength=2 << layout.bits) > 1)
        passed += layout.repeated(bits, own).sum()
    assert passed < 0.06 * len(anchors)


def test_lists_of_numbers_stay(spark):
    """Short numbers in a row are no cards, though some of their runs pass the check; cards beside other numbers still are found."""
    rng = random.Random(4)
    lists = [" ".join(str(rng.randrange(10, 100)) for _ in range(2000)), "-".join(str(rng.randrange(10)) for _ in range(500)), " ".join(str(rng.randrange(1, 32)) for _ in range(300))]
    rows = [(k, t) for k, t in enumerate(lists)] + [(9, "12 4111 1111 1111 1111 12/26"), (10, "4111111 111111111"), (11, "41111111 11111111")]
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert all(got[k] == (t, 0) for k, t in enumerate(lists))
    assert all(got[k][1] == 1 and len(got[k][0]) == len(t) and got[k][0] != t for k, t in rows[3:])
