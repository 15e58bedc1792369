"""Contents in segments against whole contents: chunks, rebuilding, and writers, at any segment size."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from treeplan import catalog
from treeplan.operators import chunks, delta, segments
from treeplan.sources import fs_tree


def contents(seed=3):
    rng = random.Random(seed)
    noise = rng.randbytes(60_000)
    return {
        "noise": noise, "zeros": bytes(30_000), "period": b"abcdefg" * 4000, "mixed": noise[:9000] + bytes(12_000) + noise[9000:20_000], "empty": b"", "one": b"x",
        "edge": noise[:8192], "below": noise[:4095], "shifted": b"!" + noise[100:50_000], "text": ("a line of text\n" * 900).encode() + noise[:500],
    }


def frame(spark, held):
    return spark.createDataFrame([(p, len(b), b) for p, b in held.items()], "rel_path string, size long, content binary")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("segment,rounds", [(1024, 4), (4096, 1), (5000, 4), (1 << 20, 4), (2048, 0)])
def test_chunks_at_any_segment(spark, segment, rounds):
    """Also where cuts never meet, as in zeros, and files are walked."""
    held = frame(spark, contents())
    assert rows(segments.cdc_chunks(held.select("rel_path", "size"), segments.from_rows(held), 256, segment, rounds)) == rows(chunks.cdc_chunks(held, 256))


def test_wrong_guesses_are_cut_again_at_once(spark, monkeypatch):
    """Where a task has the segment before, a wrong guess needs no round, so no contents are read or dealt again; cuts never meet here."""
    held, steps, kept = frame(spark, {"zeros": bytes(40_000), "mixed": contents()["mixed"]}).coalesce(1), [], segments.checkpointed
    monkeypatch.setattr(segments, "checkpointed", lambda df: steps.append(df) or kept(df))
    got = rows(segments.cdc_chunks(held.select("rel_path", "size"), segments.from_rows(held), 256, 4096))
    assert got == rows(chunks.cdc_chunks(held, 256)) and len(steps) == 2


@pytest.mark.parametrize("segment", [1024, 4096, 5000, 1 << 20])
def test_own_rows_are_cut_where_they_are(spark, tmp_path, segment):
    """Rows that hold their contents are not dealt, also where guesses are wrong and a file goes over many batches."""
    held = contents() | {"long": bytes(3_000_000) + contents(4)["noise"] * 30, "zzz": contents(9)["noise"]}
    frame(spark, held).repartition(8).write.parquet(f"{tmp_path}/held")
    table = spark.read.parquet(f"{tmp_path}/held")
    cut, places, parts = segments.cdc_chunks(table, None, 256, segment), segments.cdc_places(table, None, 256, segment), segments.read(table, None, segment)
    for df in (cut, places, parts):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = rows(chunks.cdc_chunks(table, 256))
    assert rows(cut) == want
    assert sorted((p, off, n, bytes(h).hex()) for p, _, off, n, h in places.collect()) == sorted((p, off, n, h) for p, _, off, n, h in want)
    assert sorted((r.rel_path, r.size, r.seg, bytes(r.data)) for r in parts.collect()) == sorted((p, len(b), k, b[k * segment : (k + 1) * segment]) for p, b in held.items() for k in range(-(-len(b) // segment)))


def shuffled(spark):
    """Bytes that each stage has written for others."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}


def test_contents_are_dealt_few_times(spark, tmp_path):
    """What rebuild_segments writes to disk is in proportion to few copies of the contents: those that operations read are dealt to them, once."""
    rng = random.Random(2)
    docs = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=12_000)), "en", "src0") for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        made = catalog.rebuild_segments(spark, str(tmp_path)).collect()
        took = sum(n for k, n in shuffled(spark).items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(made) == 196 and all(r.ok and r.digest == hashlib.sha256(docs[int(r.rel_path[-13:].split("_")[-1].split(".")[0])][1].encode()).hexdigest() for r in made)
    assert took < 2 * 200 * 12_000


def test_fixed_chunks(spark):
    held = frame(spark, contents())
    for segment in (512, 4096, 1 << 20):
        assert rows(segments.fixed_chunks(held.select("rel_path", "size"), segments.from_rows(held), 512, segment)) == rows(chunks.fixed_chunks(held, 512))


def random_ops(rng, new, old):
    """Operations that make up new: copies of equal ranges of old, else writes, of any lengths."""
    ops, at = [], 0
    while at < len(new):
        n = min(rng.choice([1, 7, 300, 5000]), len(new) - at)
        k = old.find(new[at : at + n])
        ops.append(("copy", k, n) if k >= 0 and rng.random() < 0.8 else ("write", at, n))
        at += n
    return ops


@pytest.mark.parametrize("segment", [64, 4096, 1 << 20])
def test_rebuilt(spark, segment, monkeypatch):
    rng, new, old = random.Random(1), contents(), contents()
    old = {p: b[5:] + b"tail" if p not in ("zeros", "one") else b for p, b in old.items() if p != "below"}
    if segment == 64:
        new, old = ({p: b[:2000] for p, b in x.items()} for x in (new, old))
    ops, want = [], {}
    for p, b in new.items():
        off = 0
        for k, (kind, at, n) in enumerate(random_ops(rng, b, old.get(p, b""))):
            ops.append((p, k, kind, off, at, n))
            off += n
        if b:
            want[p] = (len(b), hashlib.sha256(b).hexdigest())
    table = spark.createDataFrame(ops, "rel_path string, op_idx long, kind string, off long, src_offset long, len long")
    n, o = (frame(spark, x) for x in (new, old))
    wanted, had = (segments.read(f.select("rel_path", "size"), segments.from_rows(f), segment) for f in (n, o))
    made = segments.rebuilt(table, wanted, had, segment).cache()
    assert made.agg(F.max(F.octet_length("data"))).first()[0] <= segment
    assert {r.rel_path: (r.size, r.digest) for r in segments.digests(made).collect()} == want
    assert {(r.rel_path, r.size, r.ok) for r in segments.verified(made, wanted).collect()} == {(p, n, True) for p, (n, _) in want.items()}
    blocks = (segments.BLOCK, 2 * segment)  # all files within the first, and not
    for block in blocks:
        monkeypatch.setattr(segments, "BLOCK", block)
        assert {r.rel_path: (r.size, r.digest, r.ok) for r in segments.checked(table, wanted, had, segment).collect()} == {p: (*w, True) for p, w in want.items()}
    # beyond the old content, a gap, and a missing file
    bad = spark.createDataFrame([("edge", 0, "copy", 0, len(old["edge"]) - 2, 50), ("one", 0, "write", 5, 0, 1), ("gone", 0, "copy", 0, 0, 3)], table.schema)
    assert all(r.digest is None for r in segments.digests(segments.rebuilt(bad, wanted, had, segment)).collect())
    # the same, a result that is right but longer, one that is short, one that is wrong but whole
    odd = [("noise", 0, "write", 0, 0, 100), ("zeros", 0, "write", 0, 0, 30_000), ("zeros", 1, "copy", 30_000, 0, 9), ("text", 0, "copy", 0, 0, len(old["text"])), ("below", 0, "write", 0, 0, 1), ("below", 1, "write", 4090, 0, 1), ("mixed", 0, "write", 0, 0, 8000), ("mixed", 1, "write", 0, 0, 8000)]
    for ops in (bad, bad.unionByName(spark.createDataFrame([(p, k, kind, off, at, min(n, len((new if kind == "write" else old)[p]) - at)) for p, k, kind, off, at, n in odd], table.schema))):
        whole = segments.rebuilt(ops, wanted, had, segment)
        told = segments.digests(whole).join(segments.verified(whole, wanted).select("rel_path", "ok"), "rel_path")
        for block in blocks:
            monkeypatch.setattr(segments, "BLOCK", block)
            assert sorted(map(repr, segments.checked(ops, wanted, had, segment).collect())) == sorted(map(repr, told.select("rel_path", "size", "digest", "ok").collect()))


def test_segments_that_none_reads(spark):
    """Those that are read are kept whatever their keys, most others go; no rows, no map."""
    side = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("rel_path"), F.when(F.col("id") % 2 == 0, "write").otherwise("copy").alias("kind"), F.col("id").alias("seg"))
    used = side.where("seg % 7 = 3")
    got, want = rows(segments._read_of(side, used.unionByName(used))), rows(used)
    assert set(want) <= set(got) and len(set(got)) == len(got) < len(want) + 5
    assert rows(segments._read_of(side, used.where("false"))) == []


def test_live_segments(spark, tmp_path):
    """Live files are read by range, chunked, rebuilt and written by many tasks; writing again changes nothing, a failed file stays as it was."""
    src, dst = f"{tmp_path}/src", f"{tmp_path}/dst"
    held = contents(5)
    for root, change in ((src, lambda b: b), (dst, lambda b: b[3:] + b"old")):
        for p, b in held.items():
            os.makedirs(f"{root}/d", exist_ok=True)
            open(f"{root}/d/{p}", "wb").write(change(b))
    scan = lambda root: fs_tree.scan(spark, root).where("not is_dir")
    s, d, read, had = scan(src), scan(dst), fs_tree.ranges_of(src), fs_tree.ranges_of(dst)
    cut = [segments.cdc_chunks(f.select("rel_path", "size"), r, 256, 4096) for f, r in ((s, read), (d, had))]
    ops = delta.by_hash(*cut)
    assert not ops.where("kind = 'copy'").isEmpty()
    wanted, old = (segments.read(f.select("rel_path", "size"), r, 4096) for f, r in ((s, read), (d, had)))
    made = segments.rebuilt(ops, wanted, old, 4096).cache()
    made.count()
    lost = made.where("rel_path <> 'd/noise' or seg <> 2")
    placed = fs_tree.place_segments(lost, dst, 4096)
    assert placed.where("not ok").isEmpty()
    before = open(f"{dst}/d/noise", "rb").read()
    open(f"{dst}/d/text.treeplan-part", "wb").write(b"left" * 20_000)  # of an earlier run
    done = {r.rel_path: r.ok for r in fs_tree.finish_segments(s, placed, dst, 4096).collect()}
    assert all(ok == (p != "d/noise") for p, ok in done.items()) and open(f"{dst}/d/noise", "rb").read() == before and set(done) == {f"d/{p}" for p, b in held.items() if b}
    for again in range(2):
        done = fs_tree.finish_segments(s, fs_tree.place_segments(made, dst, 4096), dst, 4096).collect()
        assert all(r.ok for r in done)
    for p, b in held.items():
        if b:
            assert open(f"{dst}/d/{p}", "rb").read() == b and os.stat(f"{dst}/d/{p}").st_mtime_ns == os.stat(f"{src}/d/{p}").st_mtime_ns
    broken = made.withColumn("data", F.when(F.col("rel_path") != "d/text", F.col("data")))
    kept = open(f"{dst}/d/text", "rb").read()
    done = {r.rel_path: r.ok for r in fs_tree.finish_segments(s, fs_tree.place_segments(broken, dst, 4096), dst, 4096).collect()}
    assert not done["d/text"] and sum(not ok for ok in done.values()) == 1 and open(f"{dst}/d/text", "rb").read() == kept
    assert not [n for n in os.listdir(f"{dst}/d") if "part" in n]
