"""Deltas inside the old file against rebuilding, and rules as a relation against the list."""

import os
import random

import pytest
from pyspark.sql import functions as F

from treeplan.functions import rules as R
from treeplan.operators import rebuild
from treeplan.sources import fs_tree

OPS = "rel_path string, op_idx long, kind string, off long, src_offset long, len long"


def overlapping(rng, old):
    """Random operations: copies from anywhere, many of them onto what others read, and some writes; also the content they give."""
    ops, new, at = [], b"", 0
    for k in range(rng.randrange(0, 14)):
        n = rng.randrange(0, 30)
        if rng.random() < 0.75 and len(old) > n:
            a = min(at, len(old) - n) if rng.random() < 0.3 else rng.randrange(len(old) - n)
            ops.append((k, "copy", at, a, n))
            new += old[a : a + n]
        else:
            ops.append((k, "write", at, at, n))
            new += rng.randbytes(n)
        at += n
    return ops, new


@pytest.fixture()
def trees(spark, tmp_path):
    rng = random.Random(12)
    src, dst, ops, want, had = f"{tmp_path}/s", f"{tmp_path}/d", [], {}, {}
    for i in range(120):
        path, old = f"x{i % 4}/f{i}", rng.randbytes(rng.randrange(0, 200))
        own, new = overlapping(rng, old)
        for root, data in ((src, new), (dst, old)):
            os.makedirs(f"{root}/x{i % 4}", exist_ok=True)
            open(f"{root}/{path}", "wb").write(data)
        os.utime(f"{src}/{path}", (1_600_000_000 + i, 1_600_000_000 + i))
        ops += [(path, *o) for o in own]
        want[path], had[path] = new, old
    return src, dst, spark.createDataFrame(ops, OPS), spark.createDataFrame([(p,) for p in want], "rel_path string"), want, had


def bytes_of(root, names):
    return {p: open(f"{root}/{p}", "rb").read() for p in names}


def test_in_place(spark, trees, monkeypatch):
    """Every delta gives the new content, done again it changes nothing, and some need spooling."""
    src, dst, ops, files, want, _ = trees
    steps = rebuild.in_place_steps(ops).cache()
    assert not steps.where("spool").isEmpty() and steps.where("kind = 'copy' and off = src_offset").isEmpty()
    for _ in range(2):
        done = fs_tree.apply_in_place(steps, files, src, dst).collect()
        assert all(r.ok for r in done), [r.error for r in done if not r.ok][:3]
        assert bytes_of(dst, want) == want and not [n for d in os.listdir(dst) for n in os.listdir(f"{dst}/{d}") if "treeplan" in n]


def test_in_place_after_a_lost_task(spark, trees, monkeypatch):
    """A task dies at any write; the next one undoes it from the journal and finishes."""
    src, dst, ops, files, want, had = trees
    rows = {r.rel_path: r.steps for r in rebuild.in_place_steps(ops).groupBy("rel_path").agg(F.collect_list(F.struct("phase", "op_idx", "kind", "off", "src_offset", "len")).alias("steps")).collect()}
    acts = []
    monkeypatch.setattr(fs_tree, "_each", lambda _, act: acts.append(act))
    fs_tree.apply_in_place(rebuild.in_place_steps(ops), files, src, dst)
    rng, plain = random.Random(3), fs_tree._copied

    class Lost(Exception):
        pass

    for path, steps in sorted(rows.items()):
        row = {"rel_path": path, "steps": [s.asDict() for s in steps]}
        left = rng.randrange(len(steps) + 1)

        def dying(source, at, out, to, n, journal, block=3):
            nonlocal left
            if journal is not None:
                if left == 0:
                    if n > 1:  # half of it is written
                        plain(source, at if source is not out or to < at else at + n - n // 2, out, to if source is not out or to < at else to + n - n // 2, n // 2, journal, block)
                    raise Lost
                left -= 1
            plain(source, at, out, to, n, journal, block)

        monkeypatch.setattr(fs_tree, "_copied", dying)
        try:
            acts[0](row)
        except Lost:
            pass
        monkeypatch.setattr(fs_tree, "_copied", plain)
        if rng.random() < 0.5 and os.path.exists(f"{dst}/{path}.treeplan-journal"):
            with open(f"{dst}/{path}.treeplan-journal", "ab") as f:
                f.write(b"\x01\x00\x00")  # a record cut short
        fs_tree._Journal.undo(f"{dst}/{path}.treeplan-journal", f"{dst}/{path}")
        assert open(f"{dst}/{path}", "rb").read() in (had[path], want[path])
        acts[0](row)
        assert open(f"{dst}/{path}", "rb").read() == want[path]


def test_in_place_refuses(spark, trees):
    src, dst, _, _, _, had = trees
    names = sorted(had)[:3]
    bad = spark.createDataFrame([(names[0], 0, "copy", 5, len(had[names[0]]) - 1, 9), (names[1], 0, "write", 5, 10_000, 9), ("../x", 0, "copy", 1, 2, 3)], OPS)
    done = {r.rel_path: r.ok for r in fs_tree.apply_in_place(rebuild.in_place_steps(bad), bad.select("rel_path"), src, dst).collect()}
    assert not any(done.values()) and len(done) == 3 and bytes_of(dst, names) == {p: had[p] for p in names}


def plain_verdict(chain, path, is_dir):
    import re

    for r in chain:
        if (is_dir or not r.dir_only) and re.search(r.regex, path if r.anchored else path.rsplit("/", 1)[-1]):
            return "included" if r.kind == "include" else "excluded"
    return "neutral"


def test_rules_as_a_relation(spark):
    rng = random.Random(2)
    words = ["a", "b", "lib", "x.log", "y.tar.gz", ".git", "k"]
    made = ["*.log", "*.gz", "*.tar.gz", "lib", "lib/", "./a/b", "a/*", "a/**", "a/b/*.log", "**/k", "*", "?", "[ab]", "a*", "b/lib/", "./k", "x.log", "*/lib", ".*"]
    files = spark.createDataFrame([("/".join(rng.choices(words, k=rng.randint(1, 4))), rng.random() < 0.5) for _ in range(400)] + [(None, False)], "rel_path string, is_dir boolean")
    for _ in range(4):
        chain = [R.rule(rng.choice(["include", "exclude"]), t) for t in rng.sample(made, 9)]
        got = R.judged(files, R.relation(spark, chain), F.col("is_dir")).collect()
        assert len(got) == files.count()
        assert all(r.verdict == (plain_verdict(chain, r.rel_path, r.is_dir) if r.rel_path is not None else "neutral") for r in got)


def test_ten_thousand_rules(spark):
    """The same verdicts as the list, and a plan that is no larger than for ten rules."""
    rng = random.Random(5)
    name = lambda: f"d{rng.randrange(60)}/e{rng.randrange(30)}/f{rng.randrange(40)}.{rng.choice(['c', 'h', 'o'])}"
    texts = [rng.choice([name(), name().rsplit("/", 1)[-1], f"*.x{rng.randrange(10**6)}", f"d{rng.randrange(60)}/e{rng.randrange(30)}/*.{rng.choice('cho')}", f"d{rng.randrange(60)}/e{rng.randrange(30)}/"]) for _ in range(10_000)] + ["*.o"]
    kinds = [rng.choice(["include", "exclude"]) for _ in texts]
    lines = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(zip(kinds, texts))], "ord long, kind string, line string")
    files = spark.createDataFrame([(name(),) for _ in range(300)], "rel_path string").distinct()
    made = R.judged(files, R.relation(spark, lines=lines))
    chain = [R.rule(k, t) for k, t in zip(kinds, texts)]
    assert {r.rel_path: r.verdict for r in made.collect()} == {r.rel_path: plain_verdict(chain, r.rel_path, False) for r in files.collect()}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(made) < 1.2 * size(R.judged(files, R.relation(spark, lines=lines.limit(10))))
    many = spark.createDataFrame([(i, "include", f"*a{i}*") for i in range(200_000)], "ord long, kind string, line string")
    with pytest.raises(ValueError, match="wildcard"):
        R.judged(files, R.relation(spark, lines=many))
