import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeplan import catalog
from treeplan.operators import chunks
from treeplan.operators.chunks import MASK64, CdcParams, boundaries, gear


def spans(data, target):
    at = boundaries(data, CdcParams(target))
    return [(a, b - a) for a, b in zip(at, [*at[1:], len(data)])]


def lcg(n):
    s, out = 0xDEADBEEFCAFEBABE, bytearray()
    for _ in range(n):
        s = (s * 6364136223846793005 + 1442695040888963407) & MASK64
        out.append(s >> 56)
    return bytes(out)


def test_gear():
    assert gear()[0] == 0x161922C645CE50E8 and gear()[255] == 0xEA2BE3A8ADBD94DA and 0 not in gear()


@pytest.mark.parametrize(
    "data, target, count, last",
    [
        (b"", 4096, 0, None), (b"\xaa" * 100, 4096, 1, (0, 100)), (bytes(i % 251 for i in range(100_000)), 4096, 7, (98304, 1696)), (bytes(i * 7 % 256 for i in range(200_000)), 4096, 13, (196608, 3392)),
        (bytes(i * 13 % 256 for i in range(500_000)), 4096, 31, (491520, 8480)), (bytes(i % 199 for i in range(80_000)), 4096, 5, (65536, 14464)), (bytes(100_000), 4096, 7, (98304, 1696)), (b"\xbb" * 256, 1024, 1, (0, 256)), (b"\xcc" * 4096, 1024, 1, (0, 4096)),
    ],
)
def test_vectors(data, target, count, last):
    got = spans(data, target)
    assert len(got) == count and (got[-1] if got else None) == last


def test_insertion_moves_few_cuts():
    data = lcg(200_000)
    got = spans(data, 8192)
    assert len(got) == 21 and got[:4] == [(0, 9025), (9025, 14227), (23252, 12407), (35659, 8740)] and got[-1] == (192890, 7110)
    moved = spans(data[:100] + b"\xff" + data[100:], 8192)
    assert moved[:2] == [(0, 9026), (9026, 14227)]
    cut = lambda d, s: {d[a : a + n] for a, n in s}
    assert len(cut(data, got) & cut(data[:100] + b"\xff" + data[100:], moved)) == 20


@pytest.mark.parametrize("target, least, most", [(256, 32, 8192), (4096, 16384, 4096), (128, 0, 0), (4096, 1024, 4096)])
def test_parameters(target, least, most):
    with pytest.raises(ValueError):
        CdcParams(target, least, most)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000))
def test_partition(data):
    got = spans(data, 256)
    assert sum(n for _, n in got) == len(data)
    assert all(n <= 1024 for _, n in got) and all(n >= 64 for _, n in got[:-1])


def test_query_against_kernel(spark, sf):
    rows = catalog.chunks_cdc(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.rel_path, []).append((r.idx, r.off, r.len))
    files = {r.rel_path: r.text.encode() for r in catalog._src(spark, sf).where("size > 0 and not is_symlink").collect()}
    assert {k: [(o, n) for _, o, n in sorted(v)] for k, v in by.items()} == {k: spans(v, 256) for k, v in files.items()}


def test_totals_add_up(spark, sf):
    for r in catalog.delta_totals_cdc(spark, sf).collect():
        assert r.transfer_bytes + r.reuse_bytes == r.final_size


def plain_boundaries(data, p):
    """Byte by byte."""
    cuts, start, h = [0] if data else [], 0, 0
    for i, x in enumerate(data):
        h = (h >> 1) + chunks.gear()[x] & chunks.MASK64
        pos = i - start
        if pos >= p.least and (pos >= p.most or not h & p.masks[pos >= p.target]):
            cuts.append(i)
            start, h = i, chunks.gear()[x]
    return cuts


@pytest.mark.parametrize("piece, warm, many", [(4 << 20, 128, 64), (3000, 128, 64), (3000, 8, 64), (4 << 20, 128, 2), (3000, 128, 1), (4 << 20, 8, 2)])
def test_lanes_match_the_plain_loop(monkeypatch, piece, warm, many):
    """Also where contents are cut into pieces, where guesses are often wrong, and with contents stepped side by side."""
    monkeypatch.setattr(chunks, "MANY", many)
    monkeypatch.setattr(chunks, "PIECE", piece)
    monkeypatch.setattr(chunks, "WARM", warm)
    rng = random.Random(3)
    made = [b"", b"x", bytes(1), bytes(70), b"", bytes(5000), b"\xff" * 3000, bytes(2000) + b"\x07" * 1500 + bytes(40)]
    made += [bytes(rng.choices(range(256), k=n)) for n in (63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 4096, 30000)] + [bytes(rng.choices(b"abcdefgh ", k=9000))]
    for p in (chunks.CdcParams(256), chunks.CdcParams(300, 64, 301), chunks.CdcParams(1024)):
        want = [plain_boundaries(d, p) for d in made]
        assert [chunks.boundaries(d, p) for d in made] == want
        assert list(chunks.boundaries_of(made, p)) == want
    assert list(chunks.boundaries_of([b"", b""], chunks.CdcParams(256))) == [[], []]


def test_contents_side_by_side():
    """Many contents in one step, of few and of many values, against the plain loop."""
    rng = random.Random(11)
    made = [bytes(rng.choices(range(rng.choice([1, 2, 5, 256])), k=rng.choice([0, 1, 63, 64, 65, 128, 256, 257, 1025, 3000]))) for _ in range(400)]
    for p in (CdcParams(256), CdcParams(300, 100, 320), CdcParams(512, 300, 700)):
        assert list(chunks.boundaries_of(made, p)) == [plain_boundaries(d, p) for d in made]


def test_few_files_are_dealt(spark, sf, tmp_path):
    """One file of a table goes to all cores; as many files as cores stay where they are read."""
    rows = catalog._src(spark, sf).select("rel_path", "text", "size")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(rel_path")
    assert shuffles(chunks.cdc_chunks(rows, 256)) == 1
    cores = spark.sparkContext.defaultParallelism
    rows.repartition(cores).write.parquet(str(tmp_path / "many"))
    many = chunks.cdc_chunks(spark.read.parquet(str(tmp_path / "many")), 256)
    assert shuffles(many) == 0
    assert sorted(many.collect()) == sorted(chunks.cdc_chunks(rows, 256).collect())


def test_table_functions(spark):
    """Contents of any kind in a lateral join give the rows of the operators."""
    from treeplan.functions import tables

    tables.register(spark)
    rng = random.Random(8)
    rows = [("a", rng.randbytes(9000)), ("b", b""), ("c", None), ("d", bytes(5000)), ("e", b"x")]
    frame = spark.createDataFrame([(p, len(b or b""), b) for p, b in rows], "rel_path string, size long, content binary")
    frame.createOrReplaceTempView("some_files")
    ask = lambda call: sorted(map(tuple, spark.sql(f"SELECT f.rel_path, c.* FROM some_files f, LATERAL {call} c").collect()))
    assert ask("cdc_chunks(f.content, 256)") == sorted(map(tuple, chunks.cdc_chunks(frame, 256).collect()))
    assert ask("fixed_chunks(f.content, 512)") == sorted(map(tuple, chunks.fixed_chunks(frame, 512).collect()))
    assert spark.sql("SELECT count(*) AS n FROM cdc_chunks(NULL, 256)").first().n == 0


def test_small_contents_alone_need_no_lanes(monkeypatch):
    """A content of a few KB is stepped, as lanes cost the same for any content below a thousand of them; both give the same chunks."""
    rng, p = random.Random(4), CdcParams(256)
    held = [rng.randbytes(n) for n in (1, 63, 64, 65, 1024, 5000, 16384)] + [bytes(9000), b"abc" * 3000]
    stepped = [boundaries(x, p) for x in held]
    with monkeypatch.context() as m:
        m.setattr(chunks, "ALONE", 0)
        assert [boundaries(x, p) for x in held] == stepped
    monkeypatch.setattr(chunks, "running_hashes", None)
    assert [boundaries(x, p) for x in held] == stepped


def test_workers_hold_bounded_batches(spark, sf):
    """Chunking and rebuilding bound the rows of a batch and let workers give memory back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for made in ("delta_totals_cdc", "rebuild_strategy"):
        spark.conf.set(name, "10000")
        catalog.QUERIES[made](spark, sf)
        assert int(spark.conf.get(name)) <= 1000 and spark.sparkContext.environment["MALLOC_ARENA_MAX"] == "2"
    assert chunks.PIECE <= 2 << 20
