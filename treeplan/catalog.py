"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.functions import paths, rules, tables
from treeplan.operators import batching, chunks, delta, extents, ranking, rebuild, segments, stats
from treeplan.options import SyncOptions
from treeplan import work
from treeplan.plans import log, manifest, sync
from treeplan.sources import fs_tree, snapshots
from treeplan.streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHUNK = 512

#: The fixture snapshots in SQL.
FILES = """
WITH d AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 50 = 49 THEN '' ELSE text END AS body, doc_id % 50 = 49 AS is_symlink,
           1000000 + min(doc_id) OVER (PARTITION BY text) AS ino FROM documents),
src AS (SELECT doc_id, source, source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE doc_id % 5 WHEN 0 THEN '.toml' WHEN 1 THEN '.rs' WHEN 2 THEN '.json' WHEN 3 THEN '.bin' ELSE '.log' END AS rel_path,
           body AS text, CAST(octet_length(encode(body)) AS BIGINT) AS size, 1700000000000000000 + doc_id * 1000000007 AS mtime_ns,
           CASE WHEN doc_id % 11 = 0 THEN 2541 WHEN doc_id % 7 = 0 THEN 493 ELSE 420 END AS mode, is_symlink, CASE WHEN is_symlink THEN 'doc_00000000.toml' END AS symlink_target,
           CAST(1000 AS BIGINT) AS uid, 1000 + doc_id % 3 AS gid, CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS dev, ino FROM d),
e AS (SELECT * REPLACE (CASE WHEN is_symlink THEN text ELSE CASE doc_id % 20 WHEN 1 THEN '!' || text WHEN 2 THEN left(text, length(text) // 2) WHEN 5 THEN text || text ELSE text END END AS text,
           mtime_ns + CASE doc_id % 20 WHEN 1 THEN -5000000000 WHEN 2 THEN -86400000000000 WHEN 3 THEN 3000000000 WHEN 4 THEN -900000000 WHEN 5 THEN 60000000000 ELSE 0 END AS mtime_ns,
           CASE WHEN doc_id % 20 = 6 THEN 384 ELSE mode END AS mode) FROM src WHERE doc_id % 20 <> 0),
dst AS (SELECT * REPLACE (CAST(octet_length(encode(text)) AS BIGINT) AS size) FROM e
        UNION ALL SELECT * REPLACE ('stale/' || source || '/doc_' || doc_id || '.old' AS rel_path, false AS is_symlink, NULL AS symlink_target, ino + 5000000 AS ino) FROM src WHERE doc_id % 25 = 7)
"""
#: Directories of both trees, by path components.
DIRS = FILES + """
, sd AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS rel_path FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(rel_path, '/') AS p FROM src))),
dd AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS rel_path FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(rel_path, '/') AS p FROM dst)))
"""
PARENT = "regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _src(spark, d, **k):
    return snapshots.src_files(spark, d, **k)


def _dst(spark, d, **k):
    return snapshots.dst_files(spark, d, **k)


def _ladder(steps: str, last: str = "copy_full") -> str:
    return FILES + f"SELECT s.rel_path, CASE {steps} ELSE '{last}' END AS action, s.size FROM src s LEFT JOIN dst d USING (rel_path)"


SAME = "WHEN s.size = d.size AND s.mtime_ns = d.mtime_ns THEN 'skip'"
NEW = "WHEN d.rel_path IS NULL THEN 'copy_new'"
_PLANS = {
    "plan_default": (SyncOptions(), _ladder(f"{NEW} {SAME}")),
    "plan_existing": (SyncOptions(existing=True), _ladder(f"WHEN d.rel_path IS NULL THEN 'skip' {SAME}")),
    "plan_ignore_existing": (SyncOptions(ignore_existing=True), _ladder(f"WHEN d.rel_path IS NOT NULL THEN 'skip' {NEW}")),
    "plan_update": (SyncOptions(update=True), _ladder(f"WHEN d.mtime_ns > s.mtime_ns THEN 'skip' {NEW} {SAME}")),
    "plan_whole_file": (SyncOptions(whole_file=True), _ladder(NEW)),
    "plan_checksum_ref": (SyncOptions(checksum="rule"), _ladder(NEW)),
    "plan_checksum": (SyncOptions(checksum="content"), _ladder(f"{NEW} WHEN sha256(s.text) = sha256(d.text) THEN 'skip'")),
    "plan_size_only": (SyncOptions(size_only=True), _ladder(f"{NEW} WHEN s.size = d.size THEN 'skip'")),
    "plan_window1": (SyncOptions(modify_window=1), _ladder(f"{NEW} WHEN s.size = d.size AND abs(s.mtime_ns - d.mtime_ns) // 1000000000 <= 1 THEN 'skip'")),
    "plan_network": (SyncOptions(mode="network"), _ladder(f"{NEW} {SAME}", "delta")),
}


def _planner(o: SyncOptions):
    return lambda spark, d: sync.plan(_src(spark, d), _dst(spark, d), o).select("rel_path", "action", "size")


for _name, (_o, _sql) in _PLANS.items():
    QUERIES[_name], ORACLES[_name] = _planner(_o), _sql


@query(FILES + f"SELECT action, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT s.size, CASE {NEW} {SAME} ELSE 'copy_full' END AS action FROM src s LEFT JOIN dst d USING (rel_path)) GROUP BY action")
def plan_summary(spark, d):
    return sync.totals(sync.plan(_src(spark, d), _dst(spark, d)))


@query(FILES + f"SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN 'delete' {NEW} {SAME} ELSE 'copy_full' END AS action, coalesce(s.size, d.size) AS size, CASE WHEN s.rel_path IS NOT NULL AND d.rel_path IS NOT NULL THEN least(s.size, d.size) = 0 OR (greatest(s.size, d.size) - least(s.size, d.size)) * 4 > greatest(s.size, d.size) END AS size_gap_large FROM src s FULL JOIN dst d ON s.rel_path = d.rel_path")
def plan_delete(spark, d):
    return sync.plan(_src(spark, d), _dst(spark, d), SyncOptions(delete=True)).select("rel_path", "action", "size", "size_gap_large")


@query(FILES + f"SELECT d.rel_path, CASE WHEN s.rel_path IS NULL THEN 'copy_new' WHEN s.size = d.size AND s.mtime_ns = d.mtime_ns THEN 'skip' ELSE 'delta' END AS action, d.size FROM dst d LEFT JOIN src s ON s.rel_path = d.rel_path")
def plan_pull(spark, d):
    return sync.plan_pull(_src(spark, d), _dst(spark, d)).select("rel_path", "action", "size")


@query(FILES + "SELECT rel_path, CASE WHEN s.is_symlink THEN 'link' WHEN s.size = 0 THEN 'empty' WHEN s.size <= 32768 THEN 'batched' WHEN s.size >= 4194304 THEN 'direct' ELSE 'plain' END AS writer FROM src s LEFT JOIN dst d USING (rel_path) WHERE d.rel_path IS NULL OR NOT (s.size = d.size AND s.mtime_ns = d.mtime_ns)")
def writers(spark, d):
    s = _src(spark, d)
    return sync.writers(sync.plan(s, _dst(spark, d)), s)


CHAIN = rules.rules(["*7.log"], ["*.log", "src2/**", "*1[0-4]?.rs"], [], ["# comment", "", "doc_0000000[!0-6].*"])


@query(FILES + r"SELECT rel_path, CASE WHEN regexp_full_match(n, '[^/]*7\.log') THEN 'included' WHEN regexp_full_match(n, '[^/]*\.log') OR regexp_full_match(rel_path, 'src2/.*') OR regexp_full_match(n, '[^/]*1[0-4][^/]\.rs') OR regexp_full_match(n, 'doc_0000000[^0-6]\.[^/]*') THEN 'excluded' ELSE 'neutral' END AS verdict FROM (SELECT rel_path, string_split(rel_path, '/')[-1] AS n FROM src)")
def filter_first_match(spark, d):
    return _src(spark, d).select("rel_path", rules.verdict(CHAIN, F.col("rel_path")).alias("verdict"))


@query(FILES + r"SELECT rel_path, size FROM src WHERE NOT regexp_full_match(rel_path, 'src1[^/]*/en/[^/]*\.json') AND NOT regexp_full_match(rel_path, 'src3/.*')")
def filter_anchored(spark, d):
    return rules.kept(_src(spark, d), rules.rules([], ["./src1*/en/*.json", "src3/**"])).select("rel_path", "size")


@query(DIRS + "SELECT rel_path FROM sd WHERE NOT regexp_full_match(string_split(rel_path, '/')[-1], 'fr')")
def filter_dir_only(spark, d):
    return rules.kept(snapshots.directories(_src(spark, d)), rules.rules([], ["fr/"]), is_dir=F.lit(True))


@query(FILES + "SELECT rel_path FROM src WHERE NOT list_contains(string_split(rel_path, '/')[1:-2], 'fr')")
def filter_prune_children(spark, d):
    return rules.kept(_src(spark, d), rules.rules([], ["fr/"]), prune_children=True).select("rel_path")


@query(FILES + r"SELECT rel_path FROM src WHERE NOT regexp_full_match(string_split(rel_path, '/')[-1], 'doc_[^/]*[13579]\.[jr][^/]*')")
def filter_charclass(spark, d):
    return rules.kept(_src(spark, d), rules.rules([], ["doc_*[13579].[jr]*"])).select("rel_path")


@query(FILES + "SELECT rel_path, size FROM src WHERE size BETWEEN 1024 AND 8192")
def filter_size(spark, d):
    return sync.selected(_src(spark, d), SyncOptions(min_size=1 << 10, max_size=8 << 10)).select("rel_path", "size")


@query(FILES + """, r AS (SELECT doc_id AS ord, rel_path AS p, 'n' AS how, string_split(rel_path, '/')[-1] AS k, CASE WHEN doc_id % 6 = 0 THEN 'included' ELSE 'excluded' END AS kind FROM src WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id + 100000000, rel_path, 'p', rel_path, 'included' FROM src WHERE doc_id % 7 = 1),
g AS (SELECT rel_path, min(ord) AS ord FROM (SELECT s.rel_path, r.ord FROM src s JOIN r ON r.how = 'n' AND r.k = string_split(s.rel_path, '/')[-1] UNION ALL SELECT s.rel_path, r.ord FROM src s JOIN r ON r.how = 'p' AND r.k = s.rel_path
    UNION ALL SELECT rel_path, 200000000 FROM src WHERE rel_path LIKE 'src1/en/%' AND rel_path LIKE '%.json' UNION ALL SELECT rel_path, 200000001 FROM src WHERE rel_path LIKE '%.log' UNION ALL SELECT rel_path, 200000002 FROM src WHERE regexp_full_match(string_split(rel_path, '/')[-1], '[^/]*99[^/]*')) GROUP BY rel_path)
SELECT s.rel_path, coalesce(r.kind, CASE g.ord WHEN 200000000 THEN 'included' WHEN 200000001 THEN 'excluded' WHEN 200000002 THEN 'excluded' END, 'neutral') AS verdict FROM src s LEFT JOIN g USING (rel_path) LEFT JOIN r ON r.ord = g.ord""")
def filter_relation(spark, d):
    """As many rules as a table has: names and paths of its files, then three patterns."""
    s = _src(spark, d)
    i = F.col("doc_id")
    lines = s.where(i % 3 == 0).select(i.alias("ord"), F.when(i % 6 == 0, "include").otherwise("exclude").alias("kind"), paths.name(F.col("rel_path")).alias("line"))
    lines = lines.unionByName(s.where(i % 7 == 1).select((i + 100000000).alias("ord"), F.lit("include").alias("kind"), F.col("rel_path").alias("line")))
    few = spark.createDataFrame([(200000000, "include", "src1/en/*.json"), (200000001, "exclude", " *.log "), (200000002, "exclude", "*99*"), (200000003, "exclude", "# nothing")], "ord long, kind string, line string")
    return rules.judged(s, ranking.checkpointed(rules.relation(spark, lines=lines.unionByName(few)))).select("rel_path", "verdict")


@query(FILES + "SELECT rel_path, size FROM src WHERE doc_id % 9 = 0")
def files_from(spark, d):
    lines = _src(spark, d).where("doc_id % 9 = 0").select(F.concat(F.lit("  "), "rel_path", F.lit(" ")).alias("value"))
    wanted = lines.select(F.trim("value").alias("rel_path")).where("rel_path <> '' and not startswith(rel_path, '#')")
    return _src(spark, d).select("rel_path", "size").join(wanted, "rel_path", "left_semi")


@query(FILES + "SELECT rel_path, size FROM src WHERE dev = 1")
def one_file_system(spark, d):
    return sync.selected(_src(spark, d), SyncOptions(one_file_system=1)).select("rel_path", "size")


@query(FILES + "SELECT rel_path, size FROM src WHERE len(string_split(rel_path, '/')) = 1 UNION ALL SELECT rel_path, size FROM (SELECT string_split(rel_path, '/')[-1] AS rel_path, size FROM src WHERE rel_path LIKE 'src0/en/%')")
def scan_flat(spark, d):
    s = _src(spark, d).select("rel_path", "size")
    return s.where(paths.depth(F.col("rel_path")) == 1).unionByName(s.where(F.col("rel_path").startswith("src0/en/")).select(paths.name(F.col("rel_path")).alias("rel_path"), "size"))


@query(FILES + "SELECT s.rel_path, s.size, s.mtime_ns, s.mode FROM src s WHERE NOT is_symlink UNION ALL SELECT l.rel_path, t.size, t.mtime_ns, t.mode FROM src l JOIN src t ON l.is_symlink AND NOT t.is_symlink AND t.rel_path = " + "regexp_extract(l.rel_path, '^(.*)/[^/]*$', 1) || '/' || l.symlink_target")
def follow_links(spark, d):
    return snapshots.resolved_links(_src(spark, d)).select("rel_path", "size", "mtime_ns", "mode")


@query()
def scan_fs(spark, d):
    """The folder of the tables as a live tree."""
    return fs_tree.scan(spark, d).select("rel_path", "is_dir", "size", "mtime_ns", "mode", "is_symlink")


@query(FILES + "SELECT rel_path, size FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src)")
def delete_plan(spark, d):
    return sync.deletions(_src(spark, d), _dst(spark, d))


_OLD = rules.rules([], ["*2.old", "*.rs"])


@query(FILES + r"SELECT rel_path, size FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src WHERE NOT regexp_full_match(string_split(rel_path, '/')[-1], '[^/]*2\.old|[^/]*\.rs')) AND NOT regexp_full_match(string_split(rel_path, '/')[-1], '[^/]*2\.old|[^/]*\.rs')")
def delete_kept_excluded(spark, d):
    return sync.deletions(_src(spark, d), _dst(spark, d), SyncOptions(), _OLD)


@query(FILES + r"SELECT rel_path, size FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src WHERE NOT regexp_full_match(string_split(rel_path, '/')[-1], '[^/]*2\.old|[^/]*\.rs'))")
def delete_excluded(spark, d):
    return sync.deletions(_src(spark, d), _dst(spark, d), SyncOptions(delete_excluded=True), _OLD)


@query(FILES + "SELECT rel_path, size FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src) ORDER BY rel_path LIMIT 7")
def max_delete(spark, d):
    return sync.deletions(_src(spark, d), _dst(spark, d), SyncOptions(max_delete=7))


@query(DIRS + "SELECT rel_path, len(string_split(rel_path, '/')) AS depth FROM sd WHERE rel_path NOT IN (SELECT rel_path FROM dd WHERE rel_path NOT LIKE 'src1%')")
def dirs_to_create(spark, d):
    there = snapshots.directories(_dst(spark, d)).where("rel_path not like 'src1%'")
    return sync.new_dirs(snapshots.directories(_src(spark, d)), there).withColumn("depth", F.col("depth").cast("long"))


@query(DIRS + "SELECT rel_path, len(string_split(rel_path, '/')) AS depth FROM dd WHERE rel_path NOT IN (SELECT rel_path FROM sd)")
def orphan_dirs(spark, d):
    return sync.orphan_dirs(snapshots.directories(_src(spark, d)), snapshots.directories(_dst(spark, d))).withColumn("depth", F.col("depth").cast("long"))


@query(DIRS + "SELECT rel_path FROM dd WHERE rel_path NOT IN (SELECT rel_path FROM sd)")
def prune_empty(spark, d):
    s = _src(spark, d)
    return sync.empty_dirs(snapshots.directories(_dst(spark, d)), s)


@query(FILES + ", g AS (SELECT dev, ino, min(rel_path) AS leader FROM src WHERE size > 0 AND NOT is_symlink GROUP BY ALL HAVING count(*) > 1) SELECT rel_path, leader, rel_path = leader AS is_leader FROM src JOIN g USING (dev, ino) WHERE size > 0 AND NOT is_symlink")
def hardlink_groups(spark, d):
    return sync.hard_links(_src(spark, d, inodes=True))


@query(FILES + "SELECT rel_path, size, mtime_ns FROM src WHERE rel_path NOT IN (SELECT rel_path FROM dst) AND doc_id % 3 = 0")
def link_dest(spark, d):
    s = _src(spark, d)
    return sync.linked_from(sync.plan(s, _dst(spark, d)), s, s.where("doc_id % 3 = 0")).select("rel_path", "size", "mtime_ns")


@query(FILES + "SELECT rel_path, 'old/' || rel_path AS backup_path FROM src s JOIN dst d USING (rel_path) WHERE NOT (s.size = d.size AND s.mtime_ns = d.mtime_ns)")
def backup_paths(spark, d):
    return sync.backups(sync.plan(_src(spark, d), _dst(spark, d)), SyncOptions(backup_dir="old/"))


@query(FILES + "SELECT rel_path, mode & 1023 AS final_mode, mtime_ns AS final_mtime_ns, uid AS final_uid, gid AS final_gid FROM src")
def final_metadata(spark, d):
    return sync.final_metadata(_src(spark, d), SyncOptions(superuser=False))


@query(FILES + "SELECT rel_path, (mode & 4077) | 128 AS final_mode, CAST(NULL AS BIGINT) AS final_mtime_ns, CAST(7 AS BIGINT) AS final_uid, CAST(8 AS BIGINT) AS final_gid FROM src")
def chmod_chown(spark, d):
    return sync.final_metadata(_src(spark, d), SyncOptions(chmod="u+w,g-w,o-w", chown="7:8", times=False))


FIXED = FILES + f"""
, sc AS (SELECT rel_path, i AS idx, i * {CHUNK} AS off, least({CHUNK}, size - i * {CHUNK}) AS len, sha256(b[i * {CHUNK} + 1 : i * {CHUNK} + {CHUNK}]) AS h FROM (SELECT rel_path, size, encode(text) AS b, unnest(range(0, (size + {CHUNK - 1}) // {CHUNK})) AS i FROM src WHERE NOT is_symlink)),
dc AS (SELECT rel_path, i AS idx, i * {CHUNK} AS off, least({CHUNK}, size - i * {CHUNK}) AS len, sha256(b[i * {CHUNK} + 1 : i * {CHUNK} + {CHUNK}]) AS h FROM (SELECT rel_path, size, encode(text) AS b, unnest(range(0, (size + {CHUNK - 1}) // {CHUNK})) AS i FROM dst WHERE NOT is_symlink)),
ops AS (SELECT s.rel_path, s.idx AS op_idx, CASE WHEN s.h = d.h THEN 'copy' ELSE 'write' END AS kind, s.off, CASE WHEN s.h = d.h THEN d.off ELSE s.off END AS src_offset, s.len FROM sc s LEFT JOIN dc d USING (rel_path, idx))
"""


def _sc(spark, d):
    return chunks.fixed_chunks(_src(spark, d).where("not is_symlink"), CHUNK)


def _dc(spark, d):
    return chunks.fixed_chunks(_dst(spark, d).where("not is_symlink"), CHUNK)


@query(FIXED + "SELECT 'src' AS side, * FROM sc UNION ALL SELECT 'dst' AS side, * FROM dc")
def chunks_fixed(spark, d):
    return _sc(spark, d).select(F.lit("src").alias("side"), "*").unionByName(_dc(spark, d).select(F.lit("dst").alias("side"), "*"))


@query(FIXED + "SELECT rel_path, op_idx, kind, off, src_offset, len FROM ops")
def delta_fixed(spark, d):
    return delta.by_index(_sc(spark, d), _dc(spark, d))


TOTALS = "SELECT rel_path, count(*) AS ops, CAST(coalesce(sum(len) FILTER (kind = 'write'), 0) AS BIGINT) AS transfer_bytes, CAST(coalesce(sum(len) FILTER (kind = 'copy'), 0) AS BIGINT) AS reuse_bytes, CAST(sum(len) AS BIGINT) AS final_size, coalesce(sum(len) FILTER (kind = 'write'), 0) = 0 AS transfer_free, round(coalesce(sum(len) FILTER (kind = 'copy'), 0) / sum(len), 6) AS savings FROM ops GROUP BY rel_path"


@query(FIXED + TOTALS)
def delta_totals_fixed(spark, d):
    return delta.totals(delta.by_index(_sc(spark, d), _dc(spark, d)))


@query(FIXED + "SELECT rel_path, count(*) FILTER (s.h IS DISTINCT FROM d.h) AS diff_count, CAST(coalesce(sum(s.len) FILTER (s.h IS DISTINCT FROM d.h), 0) AS BIGINT) AS delta_bytes, bool_and(s.h IS NOT DISTINCT FROM d.h) AS identical FROM sc s FULL JOIN dc d USING (rel_path, idx) GROUP BY rel_path")
def diff_count(spark, d):
    return delta.differing(_sc(spark, d), _dc(spark, d))


@query(FIXED + "SELECT rel_path, op_idx, row_number() OVER (PARTITION BY rel_path ORDER BY op_idx) AS payload FROM ops WHERE kind = 'write'")
def payload_order(spark, d):
    return delta.payload_order(delta.by_index(_sc(spark, d), _dc(spark, d))).withColumn("payload", F.col("payload").cast("long"))


@query(FIXED + "SELECT rel_path, count(*) FILTER (kind = 'copy' AND src_offset = coalesce(pos, 0)) AS in_place, count(*) FILTER (kind = 'copy') AS copies FROM (SELECT *, sum(len) OVER (PARTITION BY rel_path ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM ops) GROUP BY rel_path")
def inplace_hits(spark, d):
    return rebuild.in_place(delta.by_index(_sc(spark, d), _dc(spark, d)))


@query(FIXED + "SELECT side, count(*) AS n, count(DISTINCT h) AS distinct_chunks, CAST(sum(len) AS BIGINT) AS bytes, CAST(min(len) AS BIGINT) AS least, CAST(max(len) AS BIGINT) AS most FROM (SELECT 'src' AS side, * FROM sc UNION ALL SELECT 'dst', * FROM dc) GROUP BY side")
def chunk_size_stats(spark, d):
    return chunks_fixed(spark, d).groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("h").alias("distinct_chunks"), F.sum("len").cast("long").alias("bytes"), F.min("len").alias("least"), F.max("len").alias("most"))


@query(FIXED + "SELECT CAST(sum(n * len) AS BIGINT) AS bytes, CAST(sum(len) AS BIGINT) AS unique_bytes, round(1 - sum(len) / sum(n * len), 6) AS saved FROM (SELECT h, count(*) AS n, min(len) AS len FROM (SELECT h, len FROM sc UNION ALL SELECT h, len FROM dc) GROUP BY h)")
def dedup_ratio(spark, d):
    per = chunks_fixed(spark, d).groupBy("h").agg(F.count("*").alias("n"), F.min("len").alias("len"))
    return per.agg(F.sum(F.col("n") * F.col("len")).cast("long").alias("bytes"), F.sum("len").cast("long").alias("unique_bytes")).withColumn("saved", F.round(1 - F.col("unique_bytes") / F.col("bytes"), 6))


@query(FILES + f"SELECT rel_path, CASE WHEN size >= {4 * CHUNK} THEN 'cdc' ELSE 'fixed' END AS strategy FROM src")
def chunk_strategy(spark, d):
    return _src(spark, d).select("rel_path", chunks.strategy(F.col("size"), CHUNK).alias("strategy"))


@query(FILES + "SELECT rel_path, size, sha256(text) AS digest FROM src")
def file_digests(spark, d):
    return _src(spark, d).select("rel_path", "size", F.sha2(F.col("text"), 256).alias("digest"))


def _cdc_side(name: str, table: str) -> str:
    """Content-defined chunks of a table (target 256) as SQL: a fold over the bytes of each file."""
    moved = "(s.h // 2 + e.g) % 18446744073709551616::HUGEINT"
    return f"""
{name}b AS (SELECT rel_path, size, encode(text) AS c FROM {table} WHERE NOT is_symlink AND size > 0),
{name}r AS (SELECT rel_path, size, c, list_reduce(
    list_transform(range(0, size), lambda i: {{'i': i, 'g': gears[('0x' || hex(c[i + 1 : i + 1]))::INTEGER + 1], 'h': 0::HUGEINT, 'first': 0::BIGINT, 'cuts': []::BIGINT[]}}),
    lambda s, e: CASE WHEN e.i - s.first >= 64 AND (e.i - s.first >= 1024 OR {moved} % CASE WHEN e.i - s.first < 256 THEN 1024 ELSE 64 END = 0)
        THEN {{'i': e.i, 'g': e.g, 'h': e.g, 'first': e.i, 'cuts': list_append(s.cuts, e.i)}}
        ELSE {{'i': e.i, 'g': e.g, 'h': {moved}, 'first': s.first, 'cuts': s.cuts}} END,
    {{'i': -1::BIGINT, 'g': 0::HUGEINT, 'h': 0::HUGEINT, 'first': 0::BIGINT, 'cuts': [0::BIGINT]}}).cuts AS cuts FROM {name}b, gear),
{name}c AS (SELECT rel_path, CAST(k - 1 AS BIGINT) AS idx, cuts[k] AS off, coalesce(cuts[k + 1], size) - cuts[k] AS len, sha256(c[cuts[k] + 1 : coalesce(cuts[k + 1], size)]) AS h
    FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS k FROM {name}r))"""


#: The table of byte values is splitmix64 from its seed, modulo 2^64.
CDC = FILES + f""", gear AS (SELECT list(CAST(xor(c, c >> 31) AS HUGEINT) ORDER BY i) AS gears FROM (
    SELECT i, xor(b, b >> 27) * {0x94D049BB133111EB}::UHUGEINT % 18446744073709551616::UHUGEINT AS c FROM (
    SELECT i, xor(a, a >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT % 18446744073709551616::UHUGEINT AS b FROM (
    SELECT i, ({chunks.SEED}::UHUGEINT + (i + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS a FROM range(256) AS r(i))))),
{_cdc_side("s", "src")}"""
CDC_OPS = CDC + f""",{_cdc_side("d", "dst")},
first AS (SELECT rel_path, h, arg_min(off, idx) AS doff, arg_min(len, idx) AS dlen FROM dc GROUP BY ALL),
ops AS (SELECT rel_path, s.idx AS op_idx, CASE WHEN doff IS NULL THEN 'write' ELSE 'copy' END AS kind, s.off, coalesce(doff, s.off) AS src_offset, CASE WHEN doff IS NULL THEN s.len ELSE least(s.len, dlen) END AS len FROM sc s LEFT JOIN first USING (rel_path, h))
"""


@query(CDC + " SELECT rel_path, idx, off, len, h FROM sc")
def chunks_cdc(spark, d):
    return chunks.cdc_chunks(_src(spark, d).where("not is_symlink"), 256)


@query(CDC + " SELECT rel_path, idx, off, len, h FROM sc")
def chunks_cdc_sql(spark, d):
    """The chunks of chunks_cdc, by a table function in SQL."""
    tables.register(spark)
    cores = spark.sparkContext.defaultParallelism
    files = _src(spark, d).where("not is_symlink").select("rel_path", F.encode("text", "UTF-8").alias("content")).repartition(cores, "rel_path")
    return spark.sql("SELECT f.rel_path, c.* FROM {files} f, LATERAL cdc_chunks(f.content, 256) c", files=files)


def _cdc_ops(spark, d):
    pair = lambda f: chunks.cdc_chunks(f.where("not is_symlink"), 256)
    return delta.by_hash(pair(_src(spark, d)), pair(_dst(spark, d)))


@query(CDC_OPS + "SELECT rel_path, op_idx, kind, off, src_offset, len FROM ops")
def delta_cdc(spark, d):
    return _cdc_ops(spark, d)


@query(CDC_OPS + TOTALS)
def delta_totals_cdc(spark, d):
    return delta.totals(_cdc_ops(spark, d))


@query(CDC_OPS + """SELECT rel_path, off, src_offset, len FROM (SELECT rel_path, run, min(off) AS off, min(src_offset) AS src_offset, CAST(sum(len) AS BIGINT) AS len FROM (
    SELECT *, sum(breaks) OVER (PARTITION BY rel_path ORDER BY off) AS run FROM (
    SELECT *, CASE WHEN lag(off + len) OVER w = off AND lag(src_offset + len) OVER w = src_offset THEN 0 ELSE 1 END AS breaks FROM ops WHERE kind = 'copy' WINDOW w AS (PARTITION BY rel_path ORDER BY off)))
    GROUP BY rel_path, run) WHERE off <> src_offset""")
def shifted_ranges(spark, d):
    return delta.merged_copies(_cdc_ops(spark, d))


def _by_strategy(spark, d):
    s, t = (f.where("not is_symlink") for f in (_src(spark, d), _dst(spark, d)))
    return delta.by_strategy(chunks.chunks(s, CHUNK), chunks.chunks(t.join(s.select("rel_path"), "rel_path", "left_semi"), CHUNK))


@query()
def delta_strategy(spark, d):
    """Tests hold it against golden totals and the rebuilt contents."""
    return _by_strategy(spark, d)


@query(FILES + "SELECT rel_path, size, sha256(text) AS digest, true AS ok FROM src WHERE NOT is_symlink AND size > 0")
def rebuild_strategy(spark, d):
    s = _src(spark, d)
    return rebuild.verified(rebuild.rebuilt(_by_strategy(spark, d), s, _dst(spark, d)), s)


@query(FILES + "SELECT rel_path, size, sha256(text) AS digest, true AS ok FROM src WHERE NOT is_symlink AND size > 0")
def rebuild_verify(spark, d):
    s = _src(spark, d)
    return rebuild.verified(rebuild.rebuilt(_cdc_ops(spark, d), s, _dst(spark, d)), s)


@query(CDC_OPS + """, c AS (SELECT *, off > src_offset AS ahead FROM ops WHERE kind = 'copy' AND off <> src_offset AND len > 0),
met AS (SELECT DISTINCT r.rel_path, r.op_idx FROM c r JOIN c w ON r.rel_path = w.rel_path AND r.ahead <> w.ahead AND r.src_offset < w.off + w.len AND w.off < r.src_offset + r.len),
cost AS (SELECT rel_path, coalesce(sum(len) FILTER (m.op_idx IS NOT NULL AND ahead), 0) <= coalesce(sum(len) FILTER (m.op_idx IS NOT NULL AND NOT ahead), 0) AS back_first FROM c LEFT JOIN met m USING (rel_path, op_idx) GROUP BY rel_path)
SELECT rel_path, op_idx, CASE WHEN spool THEN 0 WHEN ahead = back_first THEN 2 ELSE 1 END AS phase, spool FROM (SELECT c.*, back_first, m.op_idx IS NOT NULL AND ahead = back_first AS spool FROM c JOIN cost USING (rel_path) LEFT JOIN met m USING (rel_path, op_idx))
UNION ALL SELECT rel_path, op_idx, 3, false FROM ops WHERE kind = 'write' AND len > 0""")
def inplace_steps(spark, d):
    return rebuild.in_place_steps(_cdc_ops(spark, d)).select("rel_path", "op_idx", "phase", "spool")


#: Segments so small that most contents of the tables have several.
SMALL = 4096


def _segmented(spark, d):
    return [f.where("not is_symlink").select("rel_path", "size", "text") for f in (_src(spark, d), _dst(spark, d))]


@query(CDC + " SELECT rel_path, idx, off, len, h FROM sc")
def chunks_cdc_segments(spark, d):
    """The chunks of chunks_cdc, from segments that are cut side by side."""
    return segments.cdc_chunks(_segmented(spark, d)[0], None, 256, SMALL)


@query(FIXED + "SELECT rel_path, idx, off, len, h FROM sc")
def chunks_fixed_segments(spark, d):
    return segments.fixed_chunks(_segmented(spark, d)[0], None, CHUNK, SMALL)


@query(FILES + "SELECT rel_path, size, sha256(text) AS digest, true AS ok FROM src WHERE NOT is_symlink AND size > 0")
def rebuild_segments(spark, d):
    """The contents of rebuild_verify, from operations and segments that meet by place; no content is one row."""
    s, t = _segmented(spark, d)
    ops = delta.by_hash(*(segments.cdc_places(f, None, 256, SMALL) for f in (s, t)))
    return segments.checked(ops, *(segments.read(f, None, SMALL) for f in (s, t)), SMALL)


@query(FILES + "SELECT rel_path, s.size - d.size AS append_bytes, sha256(encode(s.text)[d.size + 1 :]) AS tail_digest FROM src s JOIN dst d USING (rel_path) WHERE s.size > d.size")
def append_plan(spark, d):
    return rebuild.appended(_src(spark, d), _dst(spark, d))


@query(FILES + "SELECT rel_path, size >= 4096 AS is_zero FROM src WHERE doc_id % 2 = 0 UNION ALL SELECT rel_path, false FROM src WHERE doc_id % 2 = 1")
def zero_blocks(spark, d):
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
    return rebuild.zero_blocks(_src(spark, d).select("rel_path", F.when(F.col("doc_id") % 2 == 0, zeros).otherwise(F.concat(zeros, F.lit(b"\x01"))).alias("data"))).select("rel_path", "is_zero")


DIRTIMES = FILES + f", sd AS (SELECT {PARENT} AS rel_path, max(mtime_ns) AS mtime_ns FROM src GROUP BY 1), dd AS (SELECT {PARENT} AS rel_path, max(mtime_ns) AS mtime_ns FROM dst GROUP BY 1)"


@query(DIRTIMES + "SELECT count(*) AS dirs, count(*) FILTER (s.mtime_ns IS DISTINCT FROM d.mtime_ns) AS changed, bool_and(s.mtime_ns IS NOT DISTINCT FROM d.mtime_ns) AS unchanged FROM dd d LEFT JOIN sd s USING (rel_path)")
def toc_check(spark, d):
    return manifest.unchanged(snapshots.dir_times(_src(spark, d)), snapshots.dir_times(_dst(spark, d)))


@query(DIRTIMES + f", k AS (SELECT rel_path FROM sd JOIN dd USING (rel_path, mtime_ns)), l AS (SELECT rel_path, size, mtime_ns, {PARENT} AS parent FROM src) SELECT rel_path, size, mtime_ns, 'listed' AS origin FROM l WHERE parent NOT IN (SELECT rel_path FROM k) UNION ALL SELECT l.rel_path, l.size, l.mtime_ns, 'cached' FROM l WHERE parent IN (SELECT rel_path FROM k) AND l.rel_path IN (SELECT rel_path FROM dst)")
def incremental_scan(spark, d):
    s, t = _src(spark, d), _dst(spark, d)
    return manifest.incremental(s, snapshots.dir_times(s), t, snapshots.dir_times(t))


@query(FILES + f"SELECT {PARENT} AS parent, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM src GROUP BY 1")
def files_by_dir(spark, d):
    return manifest.by_directory(_src(spark, d))


@query(DIRS + f"SELECT {PARENT} AS parent, count(*) AS dirs FROM sd GROUP BY 1")
def subdirs_by_dir(spark, d):
    return manifest.subdirectories(snapshots.directories(_src(spark, d)))


@query(FILES + "SELECT rel_path, '/backup/' || rel_path AS abs_path FROM dst")
def manifest_destination(spark, d):
    return manifest.as_destination(_dst(spark, d), "/backup").select("rel_path", "abs_path")


@query(FILES + "SELECT 'skip' AS action, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM src")
def manifest_second_run_all_skip(spark, d):
    s, t = _src(spark, d), _dst(spark, d)
    return sync.totals(sync.plan(s, manifest.synced(sync.plan(s, t), s, t)))


@query(FILES + f"""SELECT count(*) FILTER (action = 'copy_new') AS new, count(*) FILTER (action = 'copy_full') AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'delete') AS deleted,
  CAST(sum(size) FILTER (action LIKE 'copy%') AS BIGINT) AS transferred, CAST(sum(size) FILTER (action = 'skip') AS BIGINT) AS saved, (SELECT CAST(sum(size) AS BIGINT) FROM src) AS scanned,
  round(sum(size) FILTER (action = 'skip') * 100.0 / sum(size) FILTER (action <> 'delete'), 4) AS saved_pct, round(sum(size) FILTER (action = 'skip') * 100.0 / (SELECT sum(size) FROM src), 4) AS saved_pct_scanned
  FROM (SELECT CASE WHEN s.rel_path IS NULL THEN 'delete' {NEW} {SAME} ELSE 'copy_full' END AS action, coalesce(s.size, d.size) AS size FROM (SELECT * FROM src WHERE size <= 8192) s FULL JOIN dst d ON s.rel_path = d.rel_path)""")
def summary(spark, d):
    s = _src(spark, d)
    return stats.summary(sync.plan(s, _dst(spark, d), SyncOptions(delete=True, max_size=8192)), s.agg(F.sum("size").cast("long").alias("scanned")))


@query(FILES + "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (is_symlink) AS links FROM src")
def scan_totals(spark, d):
    return stats.scan_totals(_src(spark, d))


@query(FILES + "SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN '*deleting ' || d.rel_path ELSE CASE WHEN d.rel_path IS NULL OR s.size <> d.size OR s.mtime_ns <> d.mtime_ns THEN '>' ELSE '.' END || CASE WHEN s.is_symlink THEN 'L' ELSE 'f' END || CASE WHEN d.rel_path IS NULL THEN '++++++' ELSE '.' || CASE WHEN s.size <> d.size THEN 's' ELSE '.' END || CASE WHEN s.mtime_ns <> d.mtime_ns THEN 't' ELSE '.' END || CASE WHEN s.mode <> d.mode THEN 'p' ELSE '.' END || '..' END || ' ' || s.rel_path END AS line FROM src s FULL JOIN dst d ON s.rel_path = d.rel_path")
def itemize(spark, d):
    pack = lambda f, n: f.select(F.col("rel_path").alias(f"{n}p"), F.struct("rel_path", "size", "mtime_ns", "mode", "uid", "gid", "is_symlink").alias(n))
    return stats.itemized(pack(_src(spark, d), "s").join(pack(_dst(spark, d), "d"), F.col("sp") == F.col("dp"), "full"))


@query(FILES + f"SELECT rel_path, action || ' ' || rel_path || ' ' || size || ' bytes' AS line FROM (SELECT s.rel_path, s.size, CASE {NEW} {SAME} ELSE 'copy_full' END AS action FROM src s LEFT JOIN dst d USING (rel_path)) WHERE action <> 'skip'")
def log_lines(spark, d):
    return stats.log_lines(sync.plan(_src(spark, d), _dst(spark, d)))


@query("SELECT c_name AS name, round(s * 3 * 10 / 3600 / 1000 * 1000, 6) AS wh_saved, round(s * 3 * 10 / 3600 / 1000 * 8766, 6) AS kwh_year, round(s * 3 * 10 / 3600 / 1000 * 8766 * 0.475, 6) AS kg_year, round(s * 3 * 10 / 3600 / 1000 * 8766 / 10700 * 100, 6) AS home_pct FROM (SELECT c_name, CAST(c_custkey AS DOUBLE) / 7 AS s FROM customer)")
def energy(spark, d):
    runs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), (F.col("c_custkey").cast("double") / 7).alias("seconds"))
    return stats.energy(runs)


@query("SELECT l_returnflag, n, round(m, 4) AS mean, v[n // 2 + 1] AS median, round(s, 4) AS stddev, CASE WHEN n >= 20 THEN v[CAST(floor(n * 0.95) AS BIGINT) + 1] ELSE v[n] END AS p95, CASE WHEN n >= 100 THEN v[CAST(floor(n * 0.99) AS BIGINT) + 1] ELSE v[n] END AS p99, round(s / m * 100, 4) AS cv_pct FROM (SELECT l_returnflag, count(*) AS n, avg(CAST(l_quantity AS DOUBLE)) AS m, stddev_samp(CAST(l_quantity AS DOUBLE)) AS s, list(CAST(l_quantity AS DOUBLE) ORDER BY l_quantity) AS v FROM lineitem GROUP BY l_returnflag)")
def bench_stats(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return stats.bench_statistics(rows, "l_returnflag", "q")


@query("SELECT l_returnflag, round(exp(avg(ln(CAST(l_extendedprice AS DOUBLE)))), 6) AS geomean FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag")
def geomean(spark, d):
    return stats.geometric_mean(spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("p")), "l_returnflag", "p")


@query("SELECT o_orderkey, floor(CAST(o_totalprice AS DOUBLE) / (o_orderkey % 97 + 1) * 10) / 10 AS speedup FROM orders")
def speedup(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", stats.speedup(F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 97 + 1).cast("double").alias("speedup"))


@query(FILES + "SELECT rel_path, mode & 4095 AS root_mode, mode & 1023 AS user_mode FROM src")
def mode_masks(spark, d):
    m = F.col("mode")
    return _src(spark, d).select("rel_path", paths.final_mode(m).alias("root_mode"), paths.final_mode(m, False).alias("user_mode"))


@query(FILES + "SELECT rel_path, CAST(t - ((t % 1000000000) + 1000000000) % 1000000000 AS BIGINT) // 1000000000 AS secs, ((t % 1000000000) + 1000000000) % 1000000000 AS nanos, t AS back FROM (SELECT rel_path, mtime_ns - 1700000500000000000 AS t FROM src)")
def mtime_split(spark, d):
    rows = _src(spark, d).select("rel_path", (F.col("mtime_ns") - 1700000500000000000).alias("t"))
    s, n = paths.seconds(F.col("t")), paths.nanos(F.col("t"))
    return rows.select("rel_path", s.alias("secs"), n.alias("nanos"), paths.joined_ns(s, n).alias("back"))


GUARDED = "CASE WHEN doc_id % 4 = 0 THEN '/' || rel_path WHEN doc_id % 4 = 1 THEN 'a/../' || rel_path WHEN doc_id % 4 = 2 THEN 'a..b/' || rel_path ELSE '/binary/' || rel_path END"


@query(FILES + f"SELECT p AS path, p LIKE '/%' OR list_contains(string_split(p, '/'), '..') AS unsafe, regexp_matches(p, '^/(etc|bin|sbin|usr|boot|dev|proc|sys|root)') AS system FROM (SELECT {GUARDED} AS p FROM src)")
def path_guard(spark, d):
    p = F.col("path")
    return _src(spark, d).select(F.expr(GUARDED).alias("path")).select("path", paths.unsafe(p).alias("unsafe"), paths.system_place(p).alias("system"))


@query(FILES + f"SELECT rel_path, {PARENT} AS parent, string_split(rel_path, '/')[-1] AS name, len(string_split(rel_path, '/')) AS depth FROM src")
def path_parts(spark, d):
    p = F.col("rel_path")
    return _src(spark, d).select("rel_path", paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.depth(p).cast("long").alias("depth"))


@query(FILES + "SELECT rel_path, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE printf('%d B', n) END AS shown FROM (SELECT rel_path, size * 1001 * (doc_id % 3) AS n FROM src)")
def human_sizes(spark, d):
    n = F.col("size") * 1001 * (F.col("doc_id") % 3)
    return _src(spark, d).select("rel_path", paths.human_size(n).alias("shown"))


@query(FILES + "SELECT rel_path, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id * CASE doc_id % 5 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1 END END AS bytes FROM src")
def size_literals(spark, d):
    i = F.col("doc_id")
    text = F.concat(i.cast("string"), F.when(i % 5 == 1, "K").when(i % 5 == 2, "m").when(i % 5 == 3, "G").when(i % 5 == 4, "x").otherwise(""))
    return _src(spark, d).select("rel_path", paths.size_literal(text).alias("bytes"))


@query(FILES + "SELECT rel_path, source AS host, CAST(CASE WHEN doc_id % 2 = 0 THEN 2377 ELSE doc_id END AS BIGINT) AS port, '/' || rel_path AS path FROM src")
def remote_literals(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(":/"), "rel_path")).otherwise(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":/"), "rel_path"))
    got = _src(spark, d).select("rel_path", paths.remote_literal(text).alias("r"))
    return got.select("rel_path", "r.host", F.col("r.port").cast("long").alias("port"), "r.path")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_totalprice AS DOUBLE) / (o_orderkey % 7) ELSE 0 END AS rate FROM orders")
def throughput(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", paths.rate(F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 7).alias("rate"))


@query(FILES + "SELECT rel_path, row_number() OVER (PARTITION BY source ORDER BY ino, rel_path) AS by_inode, row_number() OVER (PARTITION BY source ORDER BY rel_path DESC) AS from_end FROM src")
def sort_orders(spark, d):
    one = ranking.running(_src(spark, d, inodes=True).select("source", "ino", "rel_path"), "source", F.struct("ino", "rel_path")).withColumnRenamed("nth", "by_inode")
    return ranking.running(one, "source", F.desc("rel_path")).select("rel_path", "by_inode", F.col("nth").alias("from_end"))


@query(FILES + "SELECT rel_path, (row_number() OVER (PARTITION BY source ORDER BY rel_path) - 1) // 200 AS frame FROM src")
def frames_200(spark, d):
    return batching.frames(_src(spark, d), "source", "rel_path", 200).select("rel_path", "frame")


@query(FILES + "SELECT rel_path, n || ' ' || rel_path AS line FROM (SELECT rel_path, size, row_number() OVER (PARTITION BY source ORDER BY rel_path) AS n FROM src) WHERE n % 10 = 0 OR size >= 8192")
def progress_lines(spark, d):
    return stats.progress(_src(spark, d), "source", "rel_path", every=10, large=8192)


@query(FILES + "SELECT source, frame, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT source, size, (row_number() OVER (PARTITION BY source ORDER BY rel_path) - 1) // 128 AS frame FROM src) GROUP BY ALL")
def frame_totals(spark, d):
    return batching.frames(_src(spark, d), "source", "rel_path", 128).groupBy("source", "frame").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g AS (SELECT source, r, doc_id, size, CAST(0 AS BIGINT) AS batch, CASE WHEN size > 16384 THEN 1 WHEN size >= 32768 THEN 1 ELSE 0 END AS nb, CASE WHEN size > 16384 THEN 0 ELSE 1 END AS n, CASE WHEN size > 16384 THEN 0 ELSE size END AS t FROM s WHERE r = 1
UNION ALL SELECT source, r, doc_id, size, b, CASE WHEN size > 16384 OR n2 >= 8 OR t2 >= 32768 THEN b + 1 ELSE b END, CASE WHEN size > 16384 OR n2 >= 8 OR t2 >= 32768 THEN 0 ELSE n2 END, CASE WHEN size > 16384 OR n2 >= 8 OR t2 >= 32768 THEN 0 ELSE t2 END
 FROM (SELECT s.source, s.r, s.doc_id, s.size, CASE WHEN s.size > 16384 AND g.n > 0 THEN g.nb + 1 ELSE g.nb END AS b, g.n + 1 AS n2, g.t + s.size AS t2 FROM g JOIN s ON s.source = g.source AND s.r = g.r + 1))
SELECT source, doc_id, size, batch FROM g""")
def greedy_batches(spark, d):
    rows = snapshots._documents(spark, d).select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return batching.greedy(rows, "source", "doc_id", files=8, limit=32768, alone=16384)


@query("SELECT source, doc_id, size, (greatest(p - 4096, 0) * 1000000000) // 4096 AS finish_ns FROM (SELECT source, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS p FROM documents)")
def token_bucket(spark, d):
    rows = snapshots._documents(spark, d).select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return batching.token_bucket(rows, "source", "doc_id", 4096)


EXTENTS = "x AS (SELECT doc_id AS file_id, CAST(o AS INTEGER) AS ord, o * 8192 + (doc_id % 3) * 512 * o AS logical, doc_id * 65536 + o * 8192 AS physical, CAST(8192 AS BIGINT) AS length, CAST(CASE WHEN o = doc_id % 4 THEN 1 ELSE 0 END + CASE WHEN (doc_id + o) % 5 = 0 THEN 2048 ELSE 0 END + CASE WHEN (doc_id + o) % 7 = 0 THEN 8192 ELSE 0 END AS INTEGER) AS flags FROM (SELECT doc_id, unnest(range(0, doc_id % 4 + 1)) AS o FROM documents)), f AS (SELECT doc_id AS file_id, (doc_id % 4 + 1) * 9216 + (doc_id % 2) * 100 AS size FROM documents)"


def _extents(spark, d):
    o, i = F.col("o"), F.col("doc_id")
    rows = snapshots._documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), i % 4)).alias("o"))
    flag = F.when(o == i % 4, 1).otherwise(0) + F.when((i + o) % 5 == 0, 2048).otherwise(0) + F.when((i + o) % 7 == 0, 8192).otherwise(0)
    return rows.select(i.alias("file_id"), o.cast("int").alias("ord"), (o * 8192 + (i % 3) * 512 * o).alias("logical"), (i * 65536 + o * 8192).alias("physical"), F.lit(8192).cast("long").alias("length"), flag.alias("flags"))


def _extent_files(spark, d):
    i = F.col("doc_id")
    return snapshots._documents(spark, d).select(i.alias("file_id"), ((i % 4 + 1) * 9216 + (i % 2) * 100).alias("size"))


@query(f"WITH {EXTENTS} SELECT file_id, ord, flags & 1 <> 0 AS is_last, flags & 2048 <> 0 AS is_unwritten, flags & 8192 <> 0 AS is_shared, logical + length AS \"end\" FROM x")
def extent_flags(spark, d):
    return extents.flags(_extents(spark, d)).select("file_id", "ord", "is_last", "is_unwritten", "is_shared", "end")


@query(f"WITH {EXTENTS}, g AS (SELECT *, logical > coalesce(lag(logical + length) OVER (PARTITION BY file_id ORDER BY ord), 0) AS gap FROM x), p AS (SELECT file_id, CAST(sum(length) AS BIGINT) AS data, count(*) AS n, count(*) FILTER (gap) AS h, max(logical + length) AS e FROM g GROUP BY file_id) SELECT file_id, data AS data_bytes, n AS extent_count, h + CASE WHEN e < size THEN 1 ELSE 0 END AS hole_count, h + CASE WHEN e < size THEN 1 ELSE 0 END > 0 AS is_sparse, round(data / size, 6) AS density FROM f JOIN p USING (file_id)")
def sparse_info(spark, d):
    return extents.sparse_info(_extents(spark, d), _extent_files(spark, d))


@query(f"WITH {EXTENTS} SELECT file_id, bool_and(ok) AS same, count(*) FILTER (NOT ok) AS differing FROM (SELECT file_id, file_id % 3 = 0 OR ord = 0 AS ok FROM x) GROUP BY file_id")
def extent_compare(spark, d):
    x = _extents(spark, d)
    return extents.compared(x, x.withColumn("logical", F.col("ord").cast("long") * 8192))


@query(f"WITH {EXTENTS} SELECT file_id, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS extents FROM x WHERE flags & 2048 = 0 GROUP BY file_id")
def sparse_copy(spark, d):
    return extents.copied(_extents(spark, d))


#: Three snapshots in a row, the second and third with what is gone since the one before.
EVENTS = FILES + """, third AS (SELECT * REPLACE (mtime_ns + CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE 0 END AS mtime_ns, size + doc_id % 7 // 6 AS size) FROM src WHERE doc_id % 10 <> 0),
ev AS (SELECT 1 AS seq, rel_path, size, mtime_ns, false AS gone FROM dst
    UNION ALL SELECT 2, rel_path, size, mtime_ns, false FROM src UNION ALL SELECT 2, rel_path, size, mtime_ns, true FROM dst WHERE rel_path NOT IN (SELECT rel_path FROM src)
    UNION ALL SELECT 3, rel_path, size, mtime_ns, false FROM third UNION ALL SELECT 3, rel_path, size, mtime_ns, true FROM src WHERE doc_id % 10 = 0)
"""


@query(EVENTS + """SELECT seq, rel_path, CASE WHEN gone THEN 'delete' WHEN had IS NULL OR was_gone THEN 'copy_new' WHEN size = had AND mtime_ns = was THEN 'skip' ELSE 'copy_full' END AS action,
    CASE WHEN gone THEN had ELSE size END AS size, CASE WHEN NOT coalesce(was_gone, true) THEN had END AS dst_size
    FROM (SELECT *, lag(size) OVER w AS had, lag(mtime_ns) OVER w AS was, lag(gone) OVER w AS was_gone FROM ev WINDOW w AS (PARTITION BY rel_path ORDER BY seq))""")
def stream_plan(spark, d):
    """Snapshots that arrive one after another, planned from state kept by path."""
    place, s = work.new_folder(spark), _src(spark, d)
    i = F.col("doc_id")
    third = s.where(i % 10 != 0).withColumns({"mtime_ns": F.col("mtime_ns") + F.when(i % 3 == 0, 1000000000).otherwise(0), "size": F.col("size") + F.expr("doc_id % 7 div 6")})
    states = [_dst(spark, d), s, third]
    for k, files in enumerate(states):
        keyed.snapshot(files, k + 1, states[k - 1] if k else None).write.mode("append").parquet(f"{place}/in")
        if k != 1:  # the second and third come in one batch
            keyed.run_available(spark, f"{place}/in", f"{place}/out", f"{place}/state", SyncOptions(delete=True))
    return spark.read.parquet(f"{place}/out").withColumn("seq", F.col("seq").cast("int"))


@query(FILES + "SELECT s.rel_path, s.size, s.mtime_ns, CASE WHEN s.size = d.size AND s.mtime_ns = d.mtime_ns THEN d.mode ELSE s.mode END AS mode FROM src s LEFT JOIN dst d USING (rel_path)")
def manifest_log(spark, d):
    """A destination's manifest as a log: its base, an entry of what a plan changes, and both merged."""
    place, s, t = work.new_folder(spark), _src(spark, d), _dst(spark, d)
    log.commit(spark, place, 0, t, "src", "base")
    log.commit(spark, place, 1, log.changes(sync.plan(s, log.load(spark, place), SyncOptions(delete=True)), s), "src")
    return log.load(spark, place).select("rel_path", "size", "mtime_ns", "mode")


@query(FILES + """, l AS (SELECT doc_id, rel_path, size, doc_id % 40 <> 0 AS link, doc_id - 1 AS next FROM src),
way AS (SELECT rel_path, next FROM l WHERE link), found AS (
    WITH RECURSIVE f AS (SELECT rel_path, next FROM way UNION ALL SELECT f.rel_path, l.next FROM f JOIN l ON l.doc_id = f.next AND l.link) SELECT f.rel_path, l.size FROM f JOIN l ON l.doc_id = f.next AND NOT l.link)
SELECT rel_path, size FROM l WHERE NOT link UNION ALL SELECT rel_path, size FROM found""")
def link_chains(spark, d):
    """Links that point to links, up to 39 in a row."""
    s = _src(spark, d).drop("text")
    before = s.select((F.col("doc_id") + 1).alias("doc_id"), F.concat(F.lit("/"), "rel_path").alias("target"))
    link = F.col("doc_id") % 40 != 0
    up = F.concat(F.repeat(F.lit("../"), F.size(F.split("rel_path", "/")) - 1), F.substring("target", 2, 1000))
    chained = s.join(before, "doc_id", "left").withColumns({"is_symlink": link, "symlink_target": F.when(link, F.coalesce(up, F.lit("nowhere")))})
    return snapshots.resolved_links(chained).select("rel_path", "size")


@query(FILES + f"SELECT parent, count(*) AS files, string_agg(n || ':' || size, ' ' ORDER BY n) AS names FROM (SELECT {PARENT} AS parent, string_split(rel_path, '/')[-1] AS n, size FROM src) GROUP BY parent")
def names_by_dir(spark, d):
    made = manifest.names_by_directory(_src(spark, d))
    return made.select("parent", F.size("entries").cast("long").alias("files"), F.array_join(F.transform("entries", lambda e: F.concat(e["name"], F.lit(":"), e["size"].cast("string"))), " ").alias("names"))


@query(DIRS + f", k AS (SELECT DISTINCT {PARENT} AS rel_path FROM src WHERE source <> 'src1') SELECT rel_path, len(string_split(rel_path, '/')) AS depth FROM dd WHERE rel_path NOT IN (SELECT rel_path FROM k)")
def orphan_dirs_pushed(spark, d):
    made = sync.orphan_dirs_pushed(_src(spark, d).where("source <> 'src1'"), snapshots.directories(_dst(spark, d)))
    return made.withColumn("depth", F.col("depth").cast("long"))


@query(FILES + f"SELECT p.rel_path, p.action, l.size, CASE WHEN l.rel_path IS NULL THEN 'not in the local tree' END AS error FROM (SELECT s.rel_path, CASE {NEW} {SAME} ELSE 'copy_full' END AS action FROM src s LEFT JOIN dst d USING (rel_path)) p LEFT JOIN (SELECT * FROM src WHERE doc_id % 4 <> 0) l ON l.rel_path = p.rel_path WHERE p.action <> 'skip'")
def looked_up(spark, d):
    s = _src(spark, d)
    return sync.looked_up(sync.plan(s, _dst(spark, d)), s.where("doc_id % 4 <> 0").select("rel_path", "size", "mtime_ns")).select("rel_path", "action", "size", "error")


@query(FILES + f"SELECT DISTINCT {PARENT} AS parent FROM src")
def parents(spark, d):
    return manifest.parents(_src(spark, d))


@query(DIRS + f"SELECT rel_path, rel_path IN (SELECT {PARENT} FROM src WHERE source = 'src1') AS changed FROM sd")
def changed_dirs_live(spark, d):
    """The directories of the snapshot are made in the shared folder, their times kept; then something new is put beside each file of
    one source. The times of known directories alone, read on the executors, tell where."""
    s, place = _src(spark, d), work.new_folder(spark)
    root = place.removeprefix("file://")
    if ":" in root:
        raise ValueError("a live tree needs a shared folder that executors can open by path")
    made = fs_tree.make_dirs(snapshots.directories(s), f"{root}/tree", anywhere=True)
    if made.where("not ok").count():
        raise OSError(f"directories could not be made in {root}")
    fs_tree.times_now(snapshots.directories(s), f"{root}/tree").write.parquet(f"{place}/toc")
    toc = spark.read.parquet(f"{place}/toc")
    beside = s.where("source = 'src1'").select(F.concat(paths.parent(F.col("rel_path")), F.lit("/.new")).alias("rel_path")).distinct()
    if fs_tree.make_dirs(beside, f"{root}/tree", anywhere=True).where("not ok").count():
        raise OSError(f"directories could not be made in {root}")
    return manifest.changed_dirs(fs_tree.times_now(toc, f"{root}/tree"), toc)


@query(DIRS + f""", st AS (SELECT rel_path, coalesce(m, 0) AS m FROM sd LEFT JOIN (SELECT {PARENT} AS rel_path, max(mtime_ns) AS m FROM src GROUP BY ALL) USING (rel_path)),
dt AS (SELECT rel_path, coalesce(m, 0) AS m FROM dd LEFT JOIN (SELECT {PARENT} AS rel_path, max(mtime_ns) AS m FROM dst GROUP BY ALL) USING (rel_path))
SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, CASE WHEN s.rel_path IS NULL THEN '*deleting ' || d.rel_path WHEN d.rel_path IS NULL THEN 'cd++++++ ' || s.rel_path ELSE '.d..' || CASE WHEN s.m <> d.m THEN 't' ELSE '.' END || '... ' || s.rel_path END AS line
FROM st s FULL JOIN dt d ON s.rel_path = d.rel_path""")
def itemize_dirs(spark, d):
    def pack(files, n):
        dirs = snapshots.directories(files).join(snapshots.dir_times(files), "rel_path", "left")
        fixed = [F.lit(v).alias(k) for k, v in (("size", 0), ("mode", 0o755), ("uid", 1000), ("gid", 1000), ("is_symlink", False), ("is_dir", True))]
        return dirs.select(F.col("rel_path").alias(f"{n}p"), F.struct("rel_path", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), *fixed).alias(n))

    return stats.itemized(pack(_src(spark, d), "s").join(pack(_dst(spark, d), "d"), F.col("sp") == F.col("dp"), "full"))


@query(f"SELECT b.source, b.batch, count(*) AS files, CAST(sum(b.size) AS BIGINT) AS bytes, sha256(string_agg(d.text, '' ORDER BY d.doc_id)) AS payload_sha256 FROM ({ORACLES['greedy_batches']}) b JOIN documents d USING (doc_id) GROUP BY ALL")
def batch_payloads(spark, d):
    """What each message of the greedy batches carries: digest of the contents behind each other."""
    named = greedy_batches(spark, d).withColumn("rel_path", F.col("doc_id").cast("string"))
    contents = snapshots._documents(spark, d).select(F.col("doc_id").cast("string").alias("rel_path"), F.encode("text", "UTF-8").alias("content"))
    sent = batching.payloads(named, contents, "source", "doc_id")
    bytes_ = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return sent.select("source", "batch", F.size("rel_paths").cast("long").alias("files"), bytes_.alias("bytes"), F.sha2("payload", 256).alias("payload_sha256"))


@query(FILES + f"SELECT EXISTS (SELECT 1 FROM (SELECT CASE {NEW} {SAME} ELSE 'copy_full' END AS action FROM src s LEFT JOIN dst d USING (rel_path)) WHERE action <> 'skip') AS first_run, EXISTS (SELECT 1 FROM src s LEFT JOIN src d USING (rel_path) WHERE d.rel_path IS NULL OR s.size <> d.size OR s.mtime_ns <> d.mtime_ns) AS second_run")
def anything_changed(spark, d):
    """Whether a manifest has to be written again: against the destination, and against itself."""
    s = _src(spark, d)
    return spark.range(1).select(*[F.lit(manifest.changed(sync.plan(s, other))).alias(n) for n, other in (("first_run", _dst(spark, d)), ("second_run", s))])


@query()
def compression_ratio(spark, d):
    """Wire size of frames of 200 files and of single files, by source."""
    rows = batching.frames(_src(spark, d), "source", "rel_path", 200).select("source", "frame", "rel_path", F.encode("text", "UTF-8").alias("content"))
    return batching.wire_sizes(rows, "source")
