import collections
import itertools
import os
import random

import pytest

from treeplan.functions import paths
from treeplan.functions.rules import glob_regex, listed, rules, rules_from_files, verdict
from treeplan.operators import batching, chunks, delta, ranking, rebuild, stats
from treeplan.options import SyncOptions, parse_chmod, parse_chown, parse_remote, parse_size
from treeplan.plans import manifest, sync
from treeplan.sources import fs_tree, snapshots
from treeplan.streaming.snapshots import changes, follow, run_available
from pyspark.sql import functions as F


def plain_match(pattern, text):
    """The rule's definition, character by character."""
    if not pattern:
        return not text
    if pattern.startswith("**"):
        rest = pattern[3:] if pattern[2:3] == "/" else pattern[2:]
        return any(plain_match(rest, text[k:]) for k in range(len(text) + 1))
    if pattern[0] == "*":
        stop = (text + "/").index("/")
        return any(plain_match(pattern[1:], text[k:]) for k in range(stop + 1))
    if not text:
        return False
    if pattern[0] == "?":
        return text[0] != "/" and plain_match(pattern[1:], text[1:])
    if pattern[0] == "[":
        negated = pattern[1:2] == "!"
        end = pattern.find("]", 2 + negated)
        if end > 0:
            body, hit, k = pattern[1 + negated : end], False, 0
            while k < len(body):
                if body[k + 1 : k + 2] == "-" and k + 2 < len(body):
                    hit, k = hit or body[k] <= text[0] <= body[k + 2], k + 3
                else:
                    hit, k = hit or body[k] == text[0], k + 1
            return hit != negated and plain_match(pattern[end + 1 :], text[1:])
    return pattern[0] == text[0] and plain_match(pattern[1:], text[1:])


def test_globs_by_their_definition(spark):
    """Every short text over a small alphabet, for patterns that meet slashes, nested stars, brackets and nothing."""
    texts = ["".join(t) for n in range(5) for t in itertools.product("xy/]", repeat=n)] + ["q+(z)", "a.b", "a^b", "long/way/down/x"]
    patterns = ["", "*", "**", "?", "x", "x*", "*y", "x?y", "*/*", "**/x", "x/**", "**/x/**/y", "***", "x**y", "[x]", "[!x]", "[]]", "[!]]x", "[]x]*", "[x-y]/[!y]", "[x", "x]", "q+(z)", "a.b", "a^b", "[a^]*", "?**?", "/", "*/"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", *[F.col("t").rlike(glob_regex(p)).alias(str(k)) for k, p in enumerate(patterns)]).collect()
    for row in got:
        for k, p in enumerate(patterns):
            assert row[str(k)] == plain_match(p, row.t), (p, row.t)


def test_first_rule_decides(spark):
    rng = random.Random(8)
    names = ["keep", "drop", "keep/x", "drop/keep", "a/keep", "a/b"]
    made = [(rng.choice(["include", "exclude"]), rng.choice(["keep", "drop/", "a/**", "*", "k*/", "./a/b", "drop/*"])) for _ in range(40)]
    rows = spark.createDataFrame([(n, d) for n in names for d in (True, False)], "p string, d boolean")
    for cut in range(0, 40, 4):
        some = made[cut : cut + 4]
        chain = rules([t for k, t in some if k == "include"], [t for k, t in some if k == "exclude"])
        for r in rows.select("p", "d", verdict(chain, F.col("p"), F.col("d")).alias("v")).collect():
            want = "neutral"
            for kind, text in [x for x in some if x[0] == "include"] + [x for x in some if x[0] == "exclude"]:
                plain = text.removesuffix("/").removeprefix("./")
                if (r.d or not text.endswith("/")) and plain_match(plain, r.p if "/" in plain else r.p.split("/")[-1]):
                    want = f"{kind}d"
                    break
            assert r.v == want, (some, r)


def test_rule_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("  \n# comment\n\tkept.* \n")
    (tmp_path / "ex.txt").write_text("*.q\n#*.r\n")
    chain = rules_from_files(spark, [], ["z/"], [f"{tmp_path}/in.txt"], [f"{tmp_path}/ex.txt"])
    assert [(r.kind, r.pattern, r.dir_only) for r in chain] == [("include", "kept.*", False), ("exclude", "z", True), ("exclude", "*.q", False)]
    files = spark.createDataFrame([("kept.*",), ("other",)], "rel_path string")
    assert [r.rel_path for r in listed(spark, files, f"{tmp_path}/in.txt").collect()] == ["kept.*"]
    with pytest.raises(Exception):
        rules_from_files(spark, exclude_from=[f"{tmp_path}/none.txt"])


def test_literals():
    assert parse_size("3K") == 3072 and parse_size("7") == 7
    assert parse_remote("h:/p") == ("h", 2377, "/p") and parse_remote("h:99:/p") == ("h", 99, "/p")
    assert parse_chmod("640")(0) == 0o640 and parse_chmod("u+x,go-r")(0o644) == 0o700 and parse_chmod("a=r")(0o777) == 0o444
    assert parse_chown("1:2") == (1, 2) and parse_chown(":2") == (None, 2) and parse_chown("root:root") == (0, 0)
    for bad in (lambda: parse_chown("no such user:"), lambda: parse_size("x"), lambda: parse_remote("nothing"), lambda: parse_chmod("9"), lambda: SyncOptions(mode="x")):
        with pytest.raises(ValueError):
            bad()


def make(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)


def files_of(spark, root):
    return fs_tree.scan(spark, root, subtrees="2").where("not is_dir and error is null")


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}


def grown(root, seed, n=60):
    """A generated tree: files of random bytes at random depths, empty and hidden ones among them."""
    rng, files = random.Random(seed), {}
    for k in range(n):
        folder = "/".join(f"d{rng.randrange(3)}" for _ in range(rng.randrange(5)))
        name = f"{'.' * (k % 7 == 0)}f{k}.{rng.choice(['bin', 'txt'])}"
        files[f"{folder}/{name}" if folder else name] = rng.randbytes(rng.choice([0, 1, 700, 5000, 40_000]))
    for path, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(data)
    return files


def read_tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_scan(spark, tmp_path):
    root = f"{tmp_path}/t"
    files = grown(root, 1)
    path = max(files, key=lambda p: p.count("/"))
    os.symlink(os.path.basename(path), f"{root}/{os.path.dirname(path)}/to")
    os.symlink("missing", f"{root}/bad")
    dirs = {os.path.relpath(os.path.join(d, n), root) for d, names, _ in os.walk(root) for n in names if not os.path.islink(os.path.join(d, n))}
    links = {f"{os.path.dirname(path)}/to", "bad"}
    for subtrees in ("1", "5", "40"):
        rows = fs_tree.scan(spark, root, subtrees=subtrees).collect()
        assert len(rows) == len({r.rel_path for r in rows})
        assert {r.rel_path for r in rows if r.is_dir} == dirs and {r.rel_path for r in rows if r.is_symlink} == links
        assert {r.rel_path: r.size for r in rows if not r.is_dir and not r.is_symlink} == {p: len(b) for p, b in files.items()}
    followed = {r.rel_path: r for r in fs_tree.scan(spark, root, links="follow").collect()}
    assert followed[f"{os.path.dirname(path)}/to"].size == len(files[path]) and "bad" not in followed
    assert {r.rel_path for r in fs_tree.scan(spark, root, recursive="false").collect()} == {p.split("/")[0] for p in [*files, *links]}


def test_sync_twice(spark, tmp_path):
    src, dst = f"{tmp_path}/src", f"{tmp_path}/dst"
    files, old = grown(src, 2), grown(dst, 3)
    planned = sync.plan(files_of(spark, src), files_of(spark, dst), SyncOptions(delete=True))
    want = {p: "delete" for p in old} | {p: "copy_full" if p in old else "copy_new" for p in files}
    assert {r.rel_path: r.action for r in planned.collect()} == want
    assert manifest.changed(planned)
    assert fs_tree.execute(planned, src, dst).where("not ok").count() == 0
    assert read_tree(src) == read_tree(dst) == files
    again = sync.plan(files_of(spark, src), files_of(spark, dst), SyncOptions(delete=True))
    assert {r.action for r in again.collect()} == {"skip"} and not manifest.changed(again)


def test_deltas_on_live_trees(spark, tmp_path):
    """Scan, chunk, delta, apply, compare: bytes that are no text included."""
    src, dst = f"{tmp_path}/src", f"{tmp_path}/dst"
    files = grown(src, 4, 30)
    rng = random.Random(5)
    for p, data in files.items():
        os.makedirs(os.path.dirname(f"{dst}/{p}") or dst, exist_ok=True)
        at = rng.randrange(len(data) + 1)
        with open(f"{dst}/{p}", "wb") as f:
            f.write(data[:at] + b"\xff\x00" + data[at : len(data) - rng.randrange(9)])
    planned = sync.plan(files_of(spark, src), files_of(spark, dst), SyncOptions(mode="network")).where("action = 'delta'")
    both = [fs_tree.with_content(files_of(spark, r).join(planned.select("rel_path"), "rel_path", "left_semi"), r) for r in (src, dst)]
    both = [ranking.checkpointed(f) for f in both]
    ops = ranking.checkpointed(delta.by_strategy(*(ranking.checkpointed(chunks.chunks(f, 512)) for f in both)))
    assert {r.kind for r in ops.select("kind").distinct().collect()} == {"copy", "write"}
    made = rebuild.verified(rebuild.rebuilt(ops, *both), both[0])
    assert made.where("not ok").count() == 0 and made.count() == len([b for b in files.values() if b])
    bad = ops.withColumn("src_offset", F.col("src_offset") + 10**6)
    assert rebuild.verified(rebuild.rebuilt(bad, *both), both[0]).where("ok").count() == 0
    held = read_tree(dst)
    assert fs_tree.apply_ops(bad, src, dst).where("ok").count() == 0 and read_tree(dst) == held
    for _ in range(2):
        assert fs_tree.apply_ops(ops, src, dst).where("not ok").count() == 0
    assert {p: b for p, b in read_tree(dst).items() if files[p]} == {p: b for p, b in files.items() if b}


def test_scan_again_reuses_names(spark, tmp_path):
    root = f"{tmp_path}/t"
    files = grown(root, 6)
    first = ranking.checkpointed(fs_tree.scan(spark, root))
    dirs = ranking.checkpointed(fs_tree.dir_times(root, first))
    plain = ["rel_path", "is_dir", "size", "mtime_ns", "mode", "is_symlink", "ino"]
    again = fs_tree.scan_again(root, first.where("not is_dir"), dirs)
    assert {r.origin for r in again.collect()} == {"cached"}
    assert manifest.unchanged(fs_tree.dir_times(root, again), dirs).first().unchanged
    os.makedirs(f"{root}/d0/new/deep")
    open(f"{root}/d0/new/deep/x", "w").close()
    os.unlink(f"{root}/{next(p for p in files if p.startswith('d1/'))}")
    again = fs_tree.scan_again(root, first.where("not is_dir"), dirs)
    assert sorted(map(tuple, again.select(*plain).collect())) == sorted(map(tuple, fs_tree.scan(spark, root).select(*plain).collect()))
    assert {r.rel_path: r.origin for r in again.collect()}["d0/new/deep/x"] == "listed" and again.where("origin = 'cached'").count() > 0


def test_extents_and_attributes(spark, tmp_path):
    src, dst = f"{tmp_path}/src", f"{tmp_path}/dst"
    make(src, {"a": "x"})
    with open(f"{src}/holes", "wb") as f:
        f.seek(1 << 20)
        f.write(b"end")
    rows = fs_tree.extents(spark.createDataFrame([("a",), ("holes",), ("none",)], "rel_path string"), src).collect()
    assert sum(r.length for r in rows if r.rel_path == "a") == 1
    assert max(r.logical + r.length for r in rows if r.rel_path == "holes") == (1 << 20) + 3
    try:
        os.setxattr(f"{src}/a", "user.k", b"v")
    except OSError:
        return  # this file system has none
    meta = spark.createDataFrame([("a", 0o600, None, None, None)], "rel_path string, final_mode int, final_mtime_ns long, final_uid long, final_gid long")
    planned = spark.createDataFrame([("a", "copy_new")], "rel_path string, action string")
    assert fs_tree.execute(planned, src, dst, metadata=meta, xattrs=True).first().ok and os.getxattr(f"{dst}/a", "user.k") == b"v"


def test_links_across_directories(spark):
    kind = "rel_path string, size long, mtime_ns long, mode int, is_symlink boolean, symlink_target string"
    rows = [("a/f", 5, 1, 420, False, None), ("b/l", 0, 2, 511, True, "../a/f"), ("l2", 0, 2, 511, True, "./b/l"), ("l3", 0, 2, 511, True, "l2"), ("out", 0, 2, 511, True, "../x"), ("abs", 0, 2, 511, True, "/a/f"), ("gone", 0, 2, 511, True, "nothing"), ("r1", 0, 2, 511, True, "r2"), ("r2", 0, 2, 511, True, "r1")]
    got = snapshots.resolved_links(spark.createDataFrame(rows, kind)).collect()
    assert {r.rel_path: (r.size, r.mtime_ns, r.is_symlink) for r in got} == {p: (5, 1, False) for p in ("a/f", "b/l", "l2", "l3")}


def plain_batches(rows, files, limit, alone):
    """{(stream, at, size): batches}, row by row."""
    out = {}
    for s in {r[0] for r in rows}:
        batch = n = total = 0
        for row in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], -1 if r[2] is None else r[2])):
            size = row[2] or 0
            if size > alone:
                batch += n > 0
                out.setdefault(row, []).append(batch)
                batch, n, total = batch + 1, 0, 0
                continue
            out.setdefault(row, []).append(batch)
            n, total = n + 1, total + size
            if n >= files or total >= limit:
                batch, n, total = batch + 1, 0, 0
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("files, limit, alone, block", [(4, 12, 20, 1 << 18), (4, 12, 20, 1), (3, 1000, 9, 7), (5, 30, 25, 16), (1, 10, 5, 4)])
def test_batches_by_blocks(spark, files, limit, alone, block):
    """Blocks of any size give the batches of one fold; null streams and sizes, ties, streams of one row."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None, "c"]), i if rng.random() < 0.9 else i // 2, rng.choice([None, 0, 1, 3, 7, 10, 25, 31])) for i in range(400)] + [("one", 1, 50), ("two", 1, 1), ("two", 2, 99)]
    got = {}
    for r in batching.greedy(spark.createDataFrame(rows, "stream string, at long, size long"), "stream", "at", files, limit, alone, block).collect():
        got.setdefault(tuple(r)[:3], []).append(r.batch)
    assert {k: sorted(v) for k, v in got.items()} == plain_batches(rows, files, limit, alone)


def test_batches_of_null_streams(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["s", None]), k, rng.choice([None, 1, 5, 30])) for k in range(200)]
    frame = spark.createDataFrame(rows, "stream string, at long, size long")
    assert batching.greedy(frame.limit(0), "stream", "at").collect() == []
    named = batching.greedy(frame.where("stream = 's'"), "stream", "at", files=4).withColumn("rel_path", F.col("at").cast("string"))
    sent = batching.payloads(named, frame.select(F.col("at").cast("string").alias("rel_path"), F.encode(F.concat(F.lit("<"), F.col("at").cast("string")), "UTF-8").alias("content")), "stream", "at").collect()
    assert all(bytes(r.payload) == b"".join(b"<" + p.encode() for p in r.rel_paths) and sum(r.lengths) == len(r.payload) for r in sent)
    assert [int(p) for r in sorted(sent, key=lambda r: r.batch) for p in r.rel_paths] == sorted(k for s, k, _ in rows if s)


def test_small_rules(spark):
    src = spark.createDataFrame([("a/b/c", 1)], "rel_path string, size long")
    dirs = spark.createDataFrame([("a",), ("a/b",), ("z",)], "rel_path string")
    assert {r.rel_path for r in sync.orphan_dirs_pushed(src, dirs).collect()} == {"a", "z"}
    planned = spark.createDataFrame([("a/b/c", "copy_new"), ("no", "delta"), ("x", "skip")], "rel_path string, action string")
    assert {(r.rel_path, r.size, r.error is None) for r in sync.looked_up(planned, src).collect()} == {("a/b/c", 1, True), ("no", None, False)}
    one = spark.range(1).select(paths.human_speed(F.lit(3 << 20), F.lit(2.0)).alias("x"), paths.human_speed(F.lit(5), F.lit(0.0)).alias("y")).first()
    assert (one.x, one.y) == ("1.50 MiB/s", "0 B/s")
    side = lambda n, d: F.struct(F.lit(n).alias("rel_path"), F.lit(d).alias("is_dir"), F.lit(False).alias("is_symlink"), F.lit(1).alias("size"), F.lit(1).alias("mtime_ns"), F.lit(7).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"))
    pairs = spark.range(1).select(side("new", True).alias("s"), F.when(F.lit(False), side("new", True)).alias("d"))
    assert stats.itemized(pairs).first().line.startswith("cd+") and stats.itemized(pairs.select("s", F.col("s").alias("d"))).first().line.startswith(".d")
    entries = manifest.names_by_directory(src.withColumn("mtime_ns", F.lit(4)).unionByName(spark.createDataFrame([("a/b/a", 2, 5)], "rel_path string, size long, mtime_ns int"))).first()
    assert entries.parent == "a/b" and [e.name for e in entries.entries] == ["a", "c"]


def test_human_sizes_round_halves_to_even(spark):
    """As printf does, which SQL has: whole halves at every unit, carries into the next whole number, nulls."""
    sizes = [k * step + d for step in (1 << 10, 1 << 20, 1 << 30) for k in (1, 125, 625) for d in (0, step // 8, 3 * step // 8, 5 * step // 8, 7 * step // 8, step - 1, step // 200)] + [0, 1023, 1 << 50]
    unit = lambda n: next(((k, u) for k, u in ((30, "GiB"), (20, "MiB"), (10, "KiB")) if n >= 1 << k), None)
    plain = lambda n: f"{n / (1 << unit(n)[0]):.2f} {unit(n)[1]}" if unit(n) else f"{n} B"
    got = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long").select("n", paths.human_size(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == [*map(plain, sizes), None]
    assert plain(128128) == "125.12 KiB"


def test_manifest(spark, sf, tmp_path):
    src = snapshots.src_files(spark, sf)
    manifest.save(spark, str(tmp_path), "one", "/data", src)
    files, dirs = manifest.load(spark, str(tmp_path), "one", "/data")
    assert files.count() == src.count() and dirs.count() > 0
    assert manifest.load(spark, str(tmp_path), "two") is None and manifest.load(spark, str(tmp_path), "one", "/other") is None
    assert {r.action for r in sync.plan(src, files).collect()} == {"skip"}
    assert manifest.unchanged(snapshots.dir_times(src), dirs).first().unchanged
    manifest.save(spark, str(tmp_path), "one", "/data", src.limit(5))  # again under the same id: the old parts go
    assert manifest.load(spark, str(tmp_path), "one")[0].count() == 5 and len(os.listdir(tmp_path / "one")) == 3
    head, toc = manifest.load_toc(spark, str(tmp_path), "one", "/data")
    assert head.file_count == 5 and toc.count() == manifest.load(spark, str(tmp_path), "one")[1].count()
    now, o = snapshots.dir_times(manifest.load(spark, str(tmp_path), "one")[0]), SyncOptions(trust_mtime=True)
    trusted = lambda dirs, o: manifest.trusted(spark, str(tmp_path), "one", "/data", dirs, o)
    assert trusted(now, o) and not trusted(now, o.but(delete=True)) and not trusted(now, SyncOptions())
    assert not trusted(now.withColumn("mtime_ns", F.col("mtime_ns") + 1), o) and not trusted(now.limit(0), o)


def test_stream(spark, sf, tmp_path):
    src = snapshots.src_files(spark, sf).select(*snapshots.META)
    src.write.parquet(f"{tmp_path}/in")
    made = changes(spark, f"{tmp_path}/in", src.schema, snapshots.dst_files(spark, sf))
    for _ in range(2):  # the second run finds nothing new
        run_available(made, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.rel_path, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r.rel_path, r.action) for r in sync.plan(src, snapshots.dst_files(spark, sf)).collect())


def test_stream_keeps_its_state(spark, sf, tmp_path):
    src = snapshots.src_files(spark, sf).select(*snapshots.META)
    files = [src.where("size % 2 = 0"), src.where("size % 2 = 1 or size < 500"), src.where("size < 500").withColumn("mtime_ns", F.col("mtime_ns") + 1)]
    counts = []
    for k, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", src.schema, f"{tmp_path}/state", "s", f"{tmp_path}/out", f"{tmp_path}/check")
        counts.append({r.action: r.n for r in spark.read.parquet(f"{tmp_path}/out/batch={k}").groupBy("action").agg(F.count("*").alias("n")).collect()})
    n = lambda where: src.where(where).count()
    both = n("size % 2 = 0 and size < 500")
    assert counts == [{"copy_new": n("size % 2 = 0")}, {"copy_new": n("size % 2 = 1"), **({"skip": both} if both else {})}, {"copy_full": n("size < 500")}]
    assert manifest.load(spark, f"{tmp_path}/state", "s")[0].count() == src.count()


def test_running_along_a_hot_stream(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("hot", "hot", "hot", "b", None)), k, rng.randrange(9)) for k in rng.sample(range(10**6), 700)]
    frame = spark.createDataFrame(rows, "stream string, at long, size long")
    want, n, total = set(), collections.Counter(), collections.Counter()
    for s, k, v in sorted(rows, key=lambda r: r[1]):
        n[s] += 1
        total[s] += v
        want.add((s, k, v, n[s], total[s]))
    made = ranking.running(frame, "stream", "at", F.col("size"))
    assert made.columns == ["stream", "at", "size", "nth", "passed"] and {tuple(r) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(stream" in plan and "__range" in plan
    back = ranking.running(frame.select("stream", "at"), "stream", F.desc("at")).collect()
    assert {(r.stream, r.at): n[r.stream] + 1 - r.nth for r in back} == {(s, k): i for s, k, _, i, _ in want}
    assert ranking.running(frame.limit(0), "stream", "at").count() == 0


def test_ranked_statistics_are_exact(spark):
    rng = random.Random(4)
    groups = {"many": [rng.gauss(0, 50) for _ in range(400)], "same": [7.0] * 130, "mixed": [0.0, -1.5, 2.0, -1e300, 1e-300, float("inf"), float("-inf")] * 3, "few": [3.0, -3.0], None: [1.0, 2.0, 4.0], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    got = {r.g: r for r in stats.bench_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        v, r = sorted(vs), got[g]
        n = len(v)
        assert r.n == n
        if not n:
            assert r.median is None and r.p95 is None and r.p99 is None
            continue
        assert (r.median, r.p95, r.p99) == (v[n // 2], v[int(n * 0.95)] if n >= 20 else v[-1], v[int(n * 0.99)] if n >= 100 else v[-1])


def test_writers_carry_a_plan_out(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    for root, files in ((src, {"a.txt": "new a", "sub/b.txt": "b", "sub/c.txt": "b", "deep/er/d.txt": "d"}), (dst, {"a.txt": "old a", "old/x/y.txt": "y", "sub/b.txt": "b"})):
        for name, text in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(text)
    os.symlink("a.txt", src / "l")
    planned = spark.createDataFrame([("a.txt", "copy_full"), ("sub/b.txt", "skip"), ("sub/c.txt", "copy_new"), ("deep/er/d.txt", "copy_new"), ("l", "copy_new"), ("old/x/y.txt", "delete"), ("gone.txt", "copy_new")], "rel_path string, action string")
    backups = spark.createDataFrame([("a.txt", "kept/a.txt")], "rel_path string, backup_path string")
    meta = spark.createDataFrame([("a.txt", 0o600, 10**18, None, None), ("sub/c.txt", None, None, None, None), ("deep/er/d.txt", 0o640, 5, None, None)], "rel_path string, final_mode int, final_mtime_ns long, final_uid long, final_gid long")
    for _ in range(2):  # again, as after a lost executor
        done = {r.rel_path: (r.ok, r.error) for r in fs_tree.execute(planned, str(src), str(dst), backups, meta).collect()}
        assert not done.pop("gone.txt")[0] and all(ok for ok, _ in done.values()) and len(done) == 6
        backups = None
    assert (dst / "kept/a.txt").read_text() == "old a" and (dst / "a.txt").read_text() == "new a" and os.readlink(dst / "l") == "a.txt"
    assert (dst / "a.txt").stat().st_mtime_ns == 10**18 and (dst / "a.txt").stat().st_mode & 0o777 == 0o600 and (dst / "deep/er/d.txt").stat().st_mode & 0o777 == 0o640
    links = spark.createDataFrame([("sub/b.txt", "sub/b.txt"), ("sub/c.txt", "sub/b.txt")], "rel_path string, leader string")
    for _ in range(2):
        assert [(r.rel_path, r.ok) for r in fs_tree.link_up(links, str(dst)).collect()] == [("sub/c.txt", True)]
    assert os.path.samefile(dst / "sub/b.txt", dst / "sub/c.txt")
    assert all(r.ok for r in fs_tree.make_dirs(spark.createDataFrame([("n/e/w",), ("n",)], "rel_path string"), str(dst)).collect()) and (dst / "n/e/w").is_dir()
    orphans = spark.createDataFrame([("old",), ("old/x",), ("sub",)], "rel_path string")
    for _ in range(2):
        assert {r.rel_path: r.ok for r in fs_tree.remove_dirs(orphans, str(dst)).collect()} == {"old": True, "old/x": True, "sub": False}
    assert not (dst / "old").exists() and all(r.ok for r in fs_tree.remove_dirs(orphans, str(dst), force=True).collect()) and not (dst / "sub").exists()
    assert not [p for p in dst.rglob("*.part*")]


def test_strategy_totals(spark):
    """The 50 new files are all written (159,148 bytes); of the others 156,258 bytes are."""
    from treeplan import catalog

    got = catalog.delta_strategy(spark, "/root/testdata/sf0.01").groupBy("kind").agg(F.sum("len").alias("n")).collect()
    assert {r.kind: r.n for r in got} == {"copy": 2070799, "write": 156258 + 159148}
