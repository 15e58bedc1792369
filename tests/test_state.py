"""State across runs, trusted times, pruned scans, safe writers, and links in a row, against plain versions."""

import itertools
import json
import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from treeplan import work
from treeplan.functions.rules import rules, verdict
from treeplan.options import SyncOptions
from treeplan.plans import log, manifest, sync
from treeplan.sources import fs_tree, snapshots
from treeplan.streaming import keyed
from treeplan.streaming.snapshots import follow

FILES = "rel_path string, size long, mtime_ns long, mode int, is_symlink boolean, symlink_target string, uid long, gid long, dev long, ino long"


def files(spark, rows):
    return spark.createDataFrame([(p, s, t, 420, False, None, 1, 1, 1, 1) for p, s, t in rows], FILES)


def held(frame):
    return sorted((r.rel_path, r.size, r.mtime_ns) for r in frame.collect())


OPTIONS = [
    SyncOptions(**{k: v for k, v in zip(("existing", "ignore_existing", "update", "whole_file", "size_only", "modify_window", "mode"), x) if v})
    for x in itertools.product((0, True), (0, True), (0, True), (0, True), (0, True), (0, 2), (0, "network"))
] + [SyncOptions(checksum="rule")]


def test_both_ladders_agree(spark):
    """The CASE and the plain function, for all options and pairs of states."""
    times, sizes = (None, 0, 2_999_999_999, 3_000_000_000, -1), (None, 0, 5)
    pairs = [(s, t, there, ds, dt) for s, t, there, ds, dt in itertools.product(sizes, times, (True, False), sizes, times)]
    rows = spark.createDataFrame([(str(i), *p) for i, p in enumerate(pairs)], "rel_path string, s long, t long, there boolean, ds long, dt long").cache()
    src, dst = rows.select("rel_path", F.col("s").alias("size"), F.col("t").alias("mtime_ns")).alias("s"), rows.where("there").select("rel_path", F.col("ds").alias("size"), F.col("dt").alias("mtime_ns")).alias("d")
    both = src.join(dst, F.col("s.rel_path") == F.col("d.rel_path"), "left")
    got = both.select("s.rel_path", *[sync.action(o).alias(f"a{k}") for k, o in enumerate(OPTIONS)]).collect()
    for r in got:
        s, t, there, ds, dt = pairs[int(r.rel_path)]
        for k, o in enumerate(OPTIONS):
            assert r[f"a{k}"] == sync.decided(o, {"size": s, "mtime_ns": t}, {"size": ds, "mtime_ns": dt} if there else None), (o, pairs[int(r.rel_path)])


def test_log(spark, tmp_path):
    place = f"{tmp_path}/m"
    assert log.load(spark, place) is None
    a = files(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)])
    assert log.commit(spark, place, 0, a, "/s", "base")
    src = files(spark, [("a", 1, 1), ("b", 9, 9), ("d", 4, 4)])
    planned = sync.plan(src, log.load(spark, place), SyncOptions(delete=True))
    assert log.commit(spark, place, 1, log.changes(planned, src), "/s", tag="t")
    entry = log.entries(spark, place)[1]
    assert (entry.rows, entry.tag) == (3, "t")  # b, c and d, not a
    assert held(log.load(spark, place, "/s")) == [("a", 1, 1), ("b", 9, 9), ("d", 4, 4)] and held(log.load(spark, place, before=1)) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]
    assert log.load(spark, place, "/other") is None and log.load(spark, place, before=0) is None
    assert not log.commit(spark, place, 1, log.changes(planned, src).limit(0), "/s")  # the number is taken
    again = files(spark, [("c", 7, 7), ("d", 5, 5)])
    assert log.commit(spark, place, 2, again.withColumn("gone", F.lit(False)), "/s")
    now = [("a", 1, 1), ("b", 9, 9), ("c", 7, 7), ("d", 5, 5)]
    assert held(log.load(spark, place)) == now
    assert log.compact(spark, place) and [e.kind for e in log.entries(spark, place)] == ["base"] and held(log.load(spark, place)) == now
    log.vacuum(spark, place)
    assert len(os.listdir(f"{place}/log")) <= 2 and held(log.load(spark, place)) == now and sum(n.startswith("data-") for n in os.listdir(place)) == 1
    assert held(manifest.load(spark, str(tmp_path), "m")[0]) == now


def test_log_after_crashes(spark, tmp_path, monkeypatch):
    """Whatever step a save dies in, a reader finds the state before or after it; what is corrupt is none."""
    place = f"{tmp_path}/m"
    log.commit(spark, place, 0, files(spark, [("a", 1, 1)]), "/s", "base")
    new = files(spark, [("b", 2, 2)]).withColumn("gone", F.lit(False))

    class Died(Exception):
        pass

    def die(*args):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(work, "put_if_absent", die)  # rows are written, the entry is not
        with pytest.raises(Died):
            log.commit(spark, place, 1, new, "/s")
    assert held(log.load(spark, place)) == [("a", 1, 1)]
    open(f"{place}/log/.half", "w").write('{"body')  # the entry is half written, under its other name
    assert held(log.load(spark, place)) == [("a", 1, 1)]
    log.commit(spark, place, 1, new, "/s")
    log.commit(spark, place, 2, files(spark, [("c", 3, 3)]).withColumn("gone", F.lit(False)), "/s")
    assert [p for p, *_ in held(log.load(spark, place))] == ["a", "b", "c"]
    path = f"{place}/log/{1:012d}"
    text = open(path).read()
    bodies = [text[:-5], "", "\x00\xff", text.replace("change", "chance"), json.dumps({"body": "{}", "check": 1}), json.dumps([1])]
    crc = f"{place}/log/.{1:012d}.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    for bad in bodies:
        open(path, "w", encoding="utf-8").write(bad)
        assert log.entries(spark, place) is None and log.load(spark, place) is None
    os.unlink(path)  # one is missing
    assert log.load(spark, place) is None
    open(path, "w").write(text)
    assert len(held(log.load(spark, place))) == 3
    shutil.rmtree(f"{place}/{log.entries(spark, place)[1].data}")  # its rows are missing
    assert log.load(spark, place) is None
    log.reset(spark, place)
    assert os.path.exists(f"{place}/log")  # entries are valid: nothing is removed
    open(path, "w").write("x")
    log.reset(spark, place)
    assert not os.path.exists(place)


@pytest.mark.parametrize("damage", [b"", b"PAR1 nothing else", b"\x00" * 300])
def test_corrupt_header_is_none(spark, tmp_path, damage):
    manifest.save(spark, str(tmp_path), "one", "/data", files(spark, [("a", 1, 1)]))
    head = f"{tmp_path}/one/header"
    for name in os.listdir(head):
        if name.endswith(".crc"):
            os.unlink(f"{head}/{name}")
        elif name.endswith(".parquet"):
            open(f"{head}/{name}", "wb").write(damage)
    assert manifest.load(spark, str(tmp_path), "one", "/data") is None
    assert manifest.load_toc(spark, str(tmp_path), "one", "/data") is None
    manifest.save(spark, str(tmp_path), "one", "/data", files(spark, [("b", 1, 1)]))  # written again over it
    assert held(manifest.load(spark, str(tmp_path), "one", "/data")[0]) == [("b", 1, 1)]


def as_table(df):
    return sorted((r.rel_path, r.action) for r in df.collect())


def test_follow_replays(spark, tmp_path):
    """The stream's own commit is lost: the batch runs again, with the same plan and no second entry; also over compaction."""
    run = lambda o=SyncOptions(delete=True): follow(spark, f"{tmp_path}/in", files(spark, []).schema, f"{tmp_path}/state", "s", f"{tmp_path}/out", f"{tmp_path}/check", o)
    state = {}
    old, log.COMPACT = log.COMPACT, 2
    try:
        for k in range(5):
            rows = [(f"f{i}", i, k if i % 3 == k % 3 else 0) for i in range(k, 40 + 5 * k)]
            files(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run()
            want = [(p, "copy_new" if p not in state else "skip" if state[p] == (s, t) else "copy_full") for p, s, t in rows] + [(p, "delete") for p in state if p not in {r[0] for r in rows}]
            first = as_table(spark.read.parquet(f"{tmp_path}/out/batch={k}"))
            assert first == sorted(want)
            state = {p: (s, t) for p, s, t in rows}
            entries = log.entries(spark, f"{tmp_path}/state/s")
            for name in (str(k), f".{k}.crc"):
                if os.path.exists(f"{tmp_path}/check/commits/{name}"):
                    os.unlink(f"{tmp_path}/check/commits/{name}")
            run()
            assert as_table(spark.read.parquet(f"{tmp_path}/out/batch={k}")) == first and log.entries(spark, f"{tmp_path}/state/s") == entries
            assert held(manifest.load(spark, f"{tmp_path}/state", "s")[0]) == sorted((p, *x) for p, x in state.items())
    finally:
        log.COMPACT = old


def plain_plans(snaps, o):
    out, state = [], {}
    for seq, rows in snaps:
        for p in [p for p in state if p not in rows]:
            if o.delete:
                out.append((seq, p, "delete"))
                del state[p]
        for p, (s, t) in rows.items():
            there = {"size": state[p][0], "mtime_ns": state[p][1]} if p in state else None
            action = sync.decided(o, {"size": s, "mtime_ns": t}, there)
            out.append((seq, p, action))
            if action != "skip":
                state[p] = (s, t)
    return sorted(out), state


@pytest.mark.parametrize("o", [SyncOptions(delete=True), SyncOptions(update=True), SyncOptions(existing=True, delete=True)])
def test_keyed_state(spark, tmp_path, o):
    """Any sequence of snapshots, several in a batch too, and a batch that runs again after its commit was lost."""
    rng = random.Random(4)
    snaps = [(k, {f"p{rng.randrange(25)}": (rng.randrange(3), rng.randrange(3)) for _ in range(18)}) for k in range(1, 8)]
    want, state = plain_plans(snaps, o)
    frame = lambda rows: files(spark, [(p, *x) for p, x in rows.items()])
    for at, (k, rows) in enumerate(snaps):
        keyed.snapshot(frame(rows), k, frame(snaps[at - 1][1]) if at else None).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 3, 4, 7):
            keyed.run_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", o)
    got = lambda: sorted((r.seq, r.rel_path, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got() == want
    for name in ("3", ".3.crc"):
        if os.path.exists(f"{tmp_path}/check/commits/{name}"):
            os.unlink(f"{tmp_path}/check/commits/{name}")
    keyed.run_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", o)
    assert got() == want
    assert held(keyed.destination(spark, f"{tmp_path}/check")) == sorted((p, *x) for p, x in state.items())


# links


def test_links_in_a_row(spark):
    """Rows of any length, loops and dangling ones, against a walk."""
    rng = random.Random(6)
    names = [f"{'d/' * (i % 3)}n{i}" for i in range(300)]
    target = {}
    for i, p in enumerate(names):
        if i % 50 == 0:
            continue  # a file
        to = names[i - 1] if i < 200 else rng.choice([*names, "missing", "../outside"])
        target[p] = "../" * (p.count("/")) + to
    target["loop"] = "loop"
    rows = [(p, 7 if p in target else 100 + k, k, 420, p in target, target.get(p), 1, 1, 1, 1) for k, p in enumerate([*names, "loop"])]

    def walk(p, seen=()):
        if p not in target:
            return p if p in names else None
        to = os.path.normpath(os.path.join(os.path.dirname(p), target[p]))
        return None if p in seen else walk(to, (*seen, p))

    size = {r[0]: r[1] for r in rows}
    want = sorted((p, size[w]) for p in [*names, "loop"] if (w := walk(p)) is not None)
    got = snapshots.resolved_links(spark.createDataFrame(rows, FILES))
    assert sorted((r.rel_path, r.size) for r in got.collect()) == want and got.where("is_symlink").isEmpty()


# live trees


def make_tree(root, names):
    for k, name in enumerate(names):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "w").write(name * (k + 1))


def test_trusted_times_look_at_directories_only(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/src"
    make_tree(root, [f"d{i}/e{j}/f{k}" for i in range(3) for j in range(2) for k in range(4)] + ["top"])
    o, place = SyncOptions(trust_mtime=True), f"{tmp_path}/m"
    scanned = fs_tree.scan(spark, root)
    manifest.save(spark, place, "s", root, scanned.where("not is_dir"), dirs=fs_tree.dir_times(root, scanned))
    toc = manifest.load_toc(spark, place, "s", root)[1]
    looked = []
    for f in ("stat", "lstat", "scandir", "listdir"):
        monkeypatch.setattr(os, f, lambda p, *a, _f=getattr(os, f), _n=f, **k: (looked.append((_n, str(p))), _f(p, *a, **k))[1])
    known = [r.rel_path for r in toc.collect()]
    looked.clear()
    assert len(list(fs_tree.stat_directories(root, known))) == len(known) == 10
    mine = [x for x in looked if x[1].startswith(root)]
    monkeypatch.undo()
    assert len(mine) == 10 and all(os.path.isdir(p) for _, p in mine) and not any(n in ("scandir", "listdir") for n, _ in mine)
    assert manifest.trusted_now(spark, place, "s", root, o) and manifest.plan_live(spark, place, "s", root, o) is None
    assert manifest.plan_live(spark, place, "s", root).where("action <> 'skip'").isEmpty()  # not trusted: scanned
    open(f"{root}/d1/e1/new", "w").write("x")
    assert not manifest.trusted_now(spark, place, "s", root, o)
    assert as_table(manifest.plan_live(spark, place, "s", root, o).where("action <> 'skip'")) == [("d1/e1/new", "copy_new")]
    shutil.rmtree(f"{root}/d2")
    assert not manifest.trusted_now(spark, place, "s", root, o)
    assert sorted(r.rel_path for r in fs_tree.times_now(toc, root).collect()) == ["", "d0", "d0/e0", "d0/e1", "d1", "d1/e0", "d1/e1"]


def test_scans_prune(spark, tmp_path, monkeypatch):
    """An excluded subtree is never opened, sizes are looked at where names are read, and the rows are those of filters afterwards."""
    root = f"{tmp_path}/t"
    make_tree(root, [f"{a}/{b}/f{k}.{e}" for a in ("keep", "drop", "x") for b in ("drop", "in") for k in range(3) for e in ("log", "txt")] + ["drop.log", "a.txt"])
    chain = rules(["f1.log"], ["drop/", "*.log", "x/in/**"])
    plain = fs_tree.scan(spark, root)
    from treeplan.functions.rules import kept

    rows = lambda f: sorted((r.rel_path, r.is_dir, r.size) for r in f.collect())
    for prune in (True, False):
        want = kept(plain, chain, prune, F.col("is_dir")).where("is_dir or size between 20 and 60")
        for n in ("1", "3", "32"):
            assert rows(fs_tree.scan(spark, root, chain, prune, 20, 60, subtrees=n)) == rows(want)
    opened = []
    reader = fs_tree._Reader({"path": root, "rules": json.dumps([(r.kind, r.regex, r.dir_only, r.anchored) for r in chain]), "prune_children": "true"})
    monkeypatch.setattr(os, "scandir", lambda p, _f=os.scandir: (opened.append(os.path.relpath(p, root)), _f(p))[1])
    got = [row[0] for part in reader.partitions() for row in reader.read(part)]
    assert got and not any("drop" in p.split("/")[:-1] or p == "drop" for p in [*opened, *got]) and "x/in" in opened


def test_scan_partitions_are_bounded(tmp_path, monkeypatch):
    root = f"{tmp_path}/w"
    make_tree(root, [f"d{i}/f" for i in range(400)] + [f"d0/g{i}" for i in range(90)] + [f"r{i}" for i in range(200)])
    reader = fs_tree._Reader({"path": root})
    parts = reader.partitions()
    assert len(parts) == 32 and max(len(p.tasks) for p in parts) <= 14
    rows = [row[0] for p in parts for row in reader.read(p)]
    assert len(rows) == len(set(rows)) == 400 + 400 + 90 + 200
    monkeypatch.setattr(fs_tree, "WIDE", 100)
    parts = reader.partitions()
    assert len({(k, n) for p in parts for r, _, k, n in p.tasks if r == ""}) == 6 and len(parts) == 32  # the root is split by name
    assert sorted(row[0] for p in parts for row in reader.read(p)) == sorted(rows)


def test_digests(spark, tmp_path):
    root, other = f"{tmp_path}/a", f"{tmp_path}/b"
    make_tree(root, ["p/x", "p/y", "z"])
    shutil.copytree(root, other)
    open(f"{other}/p/y", "w").write("p/yp/Y")  # as long, but not the same
    open(f"{other}/z", "a").write("more")
    os.symlink("z", f"{root}/link")
    s, d = (fs_tree.scan(spark, r).where("not is_dir") for r in (root, other))
    pairs = sync.same_size(s, d)
    assert sorted(r.rel_path for r in pairs.collect()) == ["p/x", "p/y"]  # the only contents that are read
    s, d = (f.join(fs_tree.digests(pairs, r), "rel_path", "left") for f, r in ((s, root), (d, other)))
    assert as_table(sync.plan(s, d, SyncOptions(checksum="content"))) == [("link", "copy_new"), ("p/x", "skip"), ("p/y", "copy_full"), ("z", "copy_full")]
    bytes_ = [f.join(fs_tree.contents(f, r).drop("error"), "rel_path") for f, r in ((fs_tree.scan(spark, root).where("not is_dir"), root), (fs_tree.scan(spark, other).where("not is_dir"), other))]
    assert as_table(sync.plan(*bytes_, SyncOptions(checksum="content"))) == [("link", "copy_new"), ("p/x", "skip"), ("p/y", "copy_full"), ("z", "copy_full")]


BAD = ["../out", "/tmp/out", "a/../../out", "way/out", "", "a/../b"]


def test_writers_stay_inside(spark, tmp_path):
    """No path of a plan, a backup, a link, an operation or a directory leads out of the destination, not through a link in a parent either."""
    src, dst, out = (f"{tmp_path}/{n}" for n in ("src", "dst", "outside"))
    for p in (src, dst, out):
        os.makedirs(p)
    os.symlink(out, f"{dst}/way")
    os.makedirs(f"{src}/way")
    for p in ("out", "way/out", "b", "good"):
        open(f"{src}/{p}", "w").write("new")
    open(f"{out}/victim", "w").write("old")
    open(f"{dst}/good", "w").write("old")
    plan_of = lambda action, names: spark.createDataFrame([(p, action) for p in names], "rel_path string, action string")

    def refused(done, names):
        got = {r.rel_path: (r.ok, r.error) for r in done.collect()}
        assert set(got) == set(names) and all(not ok and "refused" in error for ok, error in got.values())

    for action in ("copy_new", "copy_full"):
        refused(fs_tree.execute(plan_of(action, BAD), src, dst), BAD)
    refused(fs_tree.execute(plan_of("delete", ["way/victim", "../outside/victim"]), src, dst), ["way/victim", "../outside/victim"])
    refused(fs_tree.execute(plan_of("copy_full", ["good"]), src, dst, backups=spark.createDataFrame([("good", "../outside/saved")], "rel_path string, backup_path string")), ["good"])
    ops = spark.createDataFrame([(p, 0, "write", 0, 3) for p in BAD], "rel_path string, op_idx long, kind string, src_offset long, len long")
    refused(fs_tree.apply_ops(ops, src, dst), BAD)
    refused(fs_tree.link_up(spark.createDataFrame([("new", "../outside/victim"), ("way/x", "good")], "rel_path string, leader string"), dst), ["new", "way/x"])
    refused(fs_tree.make_dirs(spark.createDataFrame([(p,) for p in BAD], "rel_path string"), dst), BAD)
    refused(fs_tree.remove_dirs(spark.createDataFrame([("../outside",), ("way/sub",)], "rel_path string"), dst, force=True), ["../outside", "way/sub"])
    assert os.listdir(out) == ["victim"] and open(f"{out}/victim").read() == "old" and sorted(os.listdir(dst)) == ["good", "way"] and open(f"{dst}/good").read() == "old"
    assert sorted(os.listdir(tmp_path)) == ["dst", "outside", "src"]
    assert fs_tree.execute(plan_of("copy_full", ["good"]), src, dst).first().ok and open(f"{dst}/good").read() == "new"
    for write in (lambda r: fs_tree.execute(plan_of("copy_new", ["b"]), src, r), lambda r: fs_tree.make_dirs(plan_of("x", ["b"]), r), lambda r: fs_tree.apply_ops(ops, src, r)):
        for root in ("/etc", "/usr/share/x", "/tmp/../etc/x"):
            with pytest.raises(ValueError, match="system"):
                write(root)


def test_workers_find_the_package(tmp_path):
    """From another folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(work.__file__)))
    make_tree(f"{tmp_path}/s", ["a/b", "c"])
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from treeplan.operators import segments
from treeplan.plans import sync
from treeplan.sources import fs_tree
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
s = fs_tree.scan(spark, "{tmp_path}/s").where("not is_dir")
assert all(r.ok for r in fs_tree.execute(sync.plan(s, s.limit(0)), "{tmp_path}/s", "{tmp_path}/d").collect())
assert segments.cdc_chunks(s.select("rel_path", "size"), fs_tree.ranges_of("{tmp_path}/d"), 256, 4096).count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_sparse_copies(spark, tmp_path):
    """Copies have the source's bytes and allocated blocks, and a live tree tells its holes."""
    from treeplan.operators import extents

    src, dst = f"{tmp_path}/s", f"{tmp_path}/d"
    os.makedirs(f"{src}/x")
    for name, parts, size in (("x/holes", [(1 << 20, b"a" * 70_000), (5 << 20, b"b" * 4096)], 9 << 20), ("x/full", [(0, b"c" * 300_000)], 300_000), ("empty", [], 0), ("hole", [], 3 << 20)):
        with open(f"{src}/{name}", "wb") as f:
            f.truncate(size)
            for at, data in parts:
                f.seek(at)
                f.write(data)
    s = fs_tree.scan(spark, src).where("not is_dir")
    found = fs_tree.extents(s, src).cache()
    found.count()
    done = fs_tree.copy_sparse(sync.plan(s, s.limit(0)), found, src, dst).collect()
    assert len(done) == 4 and all(r.ok for r in done)
    for name in ("x/holes", "x/full", "empty", "hole"):
        a, b = os.stat(f"{src}/{name}"), os.stat(f"{dst}/{name}")
        assert open(f"{src}/{name}", "rb").read() == open(f"{dst}/{name}", "rb").read() and (a.st_blocks, a.st_mtime_ns) == (b.st_blocks, b.st_mtime_ns)
    info = {r.file_id: r for r in extents.sparse_info(extents.of_tree(found), s.select(F.col("rel_path").alias("file_id"), "size")).collect()}
    assert info["x/holes"].hole_count == 3 and info["hole"].density == 0 and not info["x/full"].is_sparse and info["empty"].density == 1
    assert extents.compared(extents.of_tree(found), extents.of_tree(fs_tree.extents(s, dst))).where("not same").isEmpty()
    os.truncate(f"{src}/x/holes", 2000)
    done = {r.rel_path: r.ok for r in fs_tree.copy_sparse(sync.plan(s, s.limit(0)), found, src, dst).collect()}
    assert not done["x/holes"] and os.path.getsize(f"{dst}/x/holes") == 9 << 20 and sorted(os.listdir(f"{dst}/x")) == ["full", "holes"]
