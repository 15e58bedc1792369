"""Spelling variants, clustering and line dedup against brute force, their SQL, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeplan.llm import centroids, lines, queries, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(random.Random(5).choices(["anotherword", "Straße", "éclairs", "wordings", "naïvetés"], k=40_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one line only here"), (5, "One Line ONLY here \nx"), (5, "one line only here\n\n"), (None, "one line only here"), (None, "a line of no id\nx"), (7, LONG), (8, LONG + "\nend of the line"),
       (9, "日本語 текст \U0001f600 éclairs"), (-3, "İstanbul ẞ wordings\r\n\x0bA LINE OF NO ID\x1f"), (11, "a" * 3000), (12, "b\n" * 500 + "END OF THE LINE\x0c")]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame([(d, t, None, "s", 0) for d, t in ODD], DOCS)
    for c in ("word", "n", "key", "id", "tag", "cell", "shard", "cluster", "c", "gone", "near", "a.b", "back`tick"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same_as_sql(spark, sf, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, sf)
    assert set(names) <= set(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name,table", [("op11_variants", "documents"), ("op12_centroids", "embeddings"), ("op13_lines", "documents")])
def test_sql(spark, sf, name, table):
    same_as_sql(spark, sf, name, table)


# 11 spelling variants


def plain_words(rows, one_in=199, least=5):
    count = collections.Counter()
    for d, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        top = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top and words[top] >= 5 * n else None
        out[w] = (n, len(own))
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n, k, words[form[w]] if form[w] else -1) for w, (n, k) in out.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@given(st.lists(st.text("abß", min_size=0, max_size=7), unique=True, max_size=40), st.sampled_from([0, 0, 2]))
@settings(max_examples=150, deadline=None)
def test_trie(words, start):
    words = [("a" * start) + w for w in words]
    got = list(variants.trie_pairs(words, start))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, j in itertools.permutations(range(len(words)), 2) if near(words[i], words[j])}


def test_cut_shards(spark):
    """A third of the words share a long start or end: shards are cut at several letters, and every pair comes once."""
    rng = random.Random(3)
    made = {"".join(rng.choices("abc", k=rng.randint(6, 9))) for _ in range(250)}
    made |= {"sharedbegin" + "".join(rng.choices("abç", k=rng.randint(0, 4))) for _ in range(150)}
    made |= {"".join(rng.choices("xyz", k=rng.randint(0, 4))) + "sharedend" for _ in range(150)}
    made |= {"sharedbegin" * 500, "sharedbegin" * 500 + "x"}
    words = spark.createDataFrame([(w, 1) for w in made], "word string, n long")
    want = sorted((a, b) for a, b in itertools.permutations(made, 2) if near(a, b))
    for limits in ((8, 1 << 18), (2048, 64), (2048, 1 << 18)):
        assert sorted((r.word, r.near) for r in variants.near_words(words, 6, *limits).collect()) == want


def test_roots_of_long_ways(spark):
    chain = [(f"w{k:03}", f"w{k + 1:03}" if k < 40 else None) for k in range(41)]
    got = variants.roots(spark.createDataFrame(chain, "word string, form string").where("form is not null")).collect()
    assert {(r.word, r.root) for r in got} == {(w, "w040") for w, f in chain if f}


def test_variants(spark, sf, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(variants.variants(docs)) == plain_variants(plain_words(texts))
    assert rows_of(variants.variants(docs, one_in=3, least=1)) == plain_variants(plain_words(texts, 3, 1))  # many more variants
    assert rows_of(variants.variants(odd)) == plain_variants(plain_words(ODD))
    assert variants.variants(none).count() == 0
    monkeypatch.setattr(variants, "STEP", 7)  # words go on over the steps
    monkeypatch.setattr(variants, "HELD_WORDS", 3)
    assert rows_of(variants.variants(odd)) == plain_variants(plain_words(ODD))


# 12 clustering


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), [b"".join(int(x).to_bytes(4, "little", signed=True) for x in r[1])]))[:k]
    cents = [v for _, v in start]
    assign = lambda: [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, at) in zip(kept, own) if at == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = [sum(d for d, at in own if at == n) for n in range(len(cents))]
    return sorted((-1 if i is None else i, at, d, inertia[at], sum(inertia), hashlib.sha256(",".join(map(str, cents[at])).encode()).hexdigest()) for (i, _), (d, at) in zip(kept, own))


def clusters_of(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(300).collect()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters_of(centroids.cluster(frame)) == plain_clusters(rows)


def test_odd_vectors(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-2, 2) for _ in range(64)]
    one = vec()
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None] * 64), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (7, one), (7, one), (8, one), (None, vec()), (9, [1e9] * 64), *[(i, vec()) for i in range(10, 30)], *[(i, one) for i in range(30, 45)]]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, id string, `c.d` string")
    fits = [r for r in rows if r[0] != 9]
    assert clusters_of(centroids.cluster(frame)) == plain_clusters(fits)
    assert clusters_of(centroids.cluster(frame.where("vec_id in (7, 8)"))) == plain_clusters([r for r in rows if r[0] in (7, 8)])
    empty = centroids.cluster(frame.where("vec_id < 7"))
    assert empty.count() == 0 and empty.columns == centroids.cluster(frame).columns


@given(st.integers(0, 10_000), st.integers(1, 12), st.sampled_from([1, 5, 8, 64]))
@settings(max_examples=60, deadline=None)
def test_partial_distances(seed, k, step):
    """Ties go to the smaller number, and structure saves additions."""
    rng = np.random.default_rng(seed)
    cents = rng.integers(-3, 4, (k, 16)) * np.array([8] * 4 + [1] * 12)
    x = np.concatenate([cents[rng.integers(0, k, 40)] + rng.integers(-1, 2, (40, 16)), rng.integers(-9, 9, (10, 16))])
    full = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    at, best, added = centroids.nearest(x, cents, rng.permutation(16), step)
    assert at.tolist() == full.argmin(axis=1).tolist() and best.tolist() == full.min(axis=1).tolist() and added <= 50 * k * 16


def test_partial_distances_save(spark):
    rng = np.random.default_rng(2)
    cents = rng.integers(-900, 900, (8, 64))
    x = cents[rng.integers(0, 8, 500)] + rng.integers(-40, 40, (500, 64))
    assert centroids.nearest(x, cents, np.arange(64))[2] < 0.3 * 500 * 8 * 64


# 13 lines


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows, least=10):
    number = lambda d: -(1 << 63) if d is None else d
    held = collections.defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key_of(line)].add(number(d))
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key_of(x)) < least or min(held[key_of(x)]) == number(d)]
        out.append((number(d), len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def lines_of(df):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_lines(spark, sf, odd, none):
    assert lines_of(lines.dedup(odd)) == plain_lines(ODD)
    assert lines_of(lines.dedup(none)) == [] and lines_of(lines.dedup(odd.where("text is null"))) == plain_lines([(1, None)])
    hot = [(i, f"the very common line\nonly in {i}\nshared by {i // 3} some") for i in range(900)]
    assert lines_of(lines.dedup(spark.createDataFrame(hot, "doc_id long, text string").repartition(5))) == plain_lines(hot)


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300, unique=True), st.randoms())
@settings(max_examples=40, deadline=None)
def test_cuckoo(numbers, rng):
    """No cell that was added and not dropped is ever missed, also in a filter that is too full."""
    old = lines.BUCKETS, lines._BUCKET_BITS
    lines.BUCKETS, lines._BUCKET_BITS = 32, 5
    try:
        raw = b"".join(hashlib.blake2b(str(n).encode(), digest_size=16).digest() for n in numbers)
        cells = (lines._places(np.frombuffer(raw, np.uint8)) & ((1 << 21) - 1)).astype(np.int64)
        f, held = lines.Cuckoo(), collections.Counter()
        for at in range(0, len(cells), 50):
            f.add(cells[at : at + 50])
            held.update(cells[at : at + 50].tolist())
            f = lines.Cuckoo(f.table.tobytes(), f.homeless)
        for cell in rng.sample(cells.tolist(), len(cells) // 2):
            f.drop(cell)
            held[cell] -= 1
            assert all(n <= c for n, c in zip(held.values(), f.copies(np.array(list(held)))))
        assert int((f.table > 0).sum()) + len(f.homeless) == sum(held.values())
    finally:
        lines.BUCKETS, lines._BUCKET_BITS = old


def as_rows(index):
    """What an index holds, filters as the copies of each cell."""
    filters = {}
    for r in index.filters.collect():
        f = lines.Cuckoo(r.bits, r.homeless)
        bucket, slot = np.nonzero(f.table)
        prints = f.table[bucket, slot].astype(np.uint64)
        cells = prints << np.uint64(lines._BUCKET_BITS) | np.minimum(bucket.astype(np.uint64), bucket.astype(np.uint64) ^ lines._step(prints))
        held = collections.Counter(cells.astype(np.int64).tolist() + f.homeless)
        if held:
            filters[r.shard] = held
    return sorted(map(repr, index.refs.select("id", "key").collect())), sorted(map(repr, index.counts.collect())), filters


def test_lines_are_reversible(spark, tmp_path):
    """Any order of insertions and removals leaves what the documents held now would give, filters included."""
    rng = random.Random(9)
    docs = {i: "\n".join(rng.choice([f"shared line {rng.randint(0, 30)}", f"line of its own {i} {rng.random()}", "short"]) for _ in range(8)) for i in range(120)}
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    index = lines.insert(lines.empty(spark, 90_000), frame(range(0, 60)))
    assert index.shards == 3
    index = lines.insert(index, frame(range(60, 120)))
    everything = as_rows(index)
    index = lines.remove(index, frame([*range(0, 120, 3), 119]))
    index = lines.remove(index, spark.createDataFrame([(5000,), (None,)], "doc_id long"))  # not held
    left = [i for i in range(119) if i % 3]
    fresh = lines.insert(lines.empty(spark, 90_000), frame(left))
    assert as_rows(index) == as_rows(fresh)
    assert lines_of(lines.without_repeats(index, frame(left))) == plain_lines([(i, docs[i]) for i in left])
    lines.save(index, f"{tmp_path}/index")
    back = lines.insert(lines.load(spark, f"{tmp_path}/index"), frame([*range(0, 120, 3), 119]))
    assert as_rows(back) == everything
    assert lines_of(lines.without_repeats(back, frame(range(120)))) == plain_lines(list(docs.items()))
    asked = spark.createDataFrame([(f"  SHARED line {k} ",) for k in range(31)] + [(f"never seen {k}",) for k in range(500)], "line string")
    held = {key_of(x) for t in docs.values() for x in t.split("\n")}
    got = [(r.line, r.found) for r in lines.known(back, asked).collect()]
    assert len(got) == 531 and all(found for x, found in got if key_of(x) in held) and sum(found for x, found in got if key_of(x) not in held) < 5


def test_filters_grow(spark):
    """Shards made for fewer keys than come are made anew, with a copy for each key where keys share a cell."""
    rows = [(i, "\n".join(f"a line with the number {i * 1000 + k}" for k in range(1000))) for i in range(56)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    index = lines.insert(lines.empty(spark, 1), frame(rows[:40]))
    assert index.shards == 1
    index = lines.insert(index, frame(rows[40:]))
    assert index.shards == 3 and index.filters.count() == 3
    assert sum(sum(c.values()) for c in as_rows(index)[2].values()) == 56_000


def test_full_filter():
    """A filter with more cells than places keeps the rest in its list."""
    raw = b"".join(hashlib.blake2b(str(n).encode(), digest_size=16).digest() for n in range(66_500))
    cells = lines._places(np.frombuffer(raw, np.uint8)) & ((1 << lines.CELL_BITS) - 1)
    f = lines.Cuckoo()
    f.add(cells)
    assert (f.copies(cells) > 0).all() and int((f.table > 0).sum()) + len(f.homeless) == 66_500
