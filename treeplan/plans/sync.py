"""The plan: one join on the path, one ordered CASE, and what follows from the actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeplan.functions import paths
from treeplan.functions.rules import Rule, kept, verdict
from treeplan.operators.chunks import content_of
from treeplan.options import SyncOptions, parse_chmod, parse_chown

#: Sizes that physical writers treat differently.
BATCHED, DIRECT = 32 << 10, 4 << 20


def same_time(o: SyncOptions) -> Column:
    gap = F.abs(F.col("s.mtime_ns") - F.col("d.mtime_ns"))
    return paths.seconds(gap) <= o.modify_window if o.modify_window else gap == 0


def ladder(o: SyncOptions) -> list[tuple[str, str]]:
    """(condition, action), first match first, by the names that action() and decided() know."""
    steps = [("absent", "skip")] if o.existing else []
    if o.ignore_existing:
        steps.append(("present", "skip"))
    if o.update:
        steps.append(("newer", "skip"))
    steps.append(("absent", "copy_new"))
    if o.whole_file:
        steps.append(("any", "copy_full"))
    if o.checksum == "content":
        steps.append(("same_content", "skip"))
    elif o.checksum is None:
        steps.append(("same_size" if o.size_only else "same", "skip"))
    return [*steps, ("any", "delta" if o.mode == "network" else "copy_full")]


def action(o: SyncOptions) -> Column:
    """The ladder as one ordered CASE; columns of both sides are qualified s. and d."""
    here, same_size = F.col("d.rel_path").isNotNull(), F.col("s.size") == F.col("d.size")
    meaning = {
        "absent": lambda: ~here, "present": lambda: here, "newer": lambda: F.col("d.mtime_ns") > F.col("s.mtime_ns"), "any": lambda: F.lit(True),
        "same_content": lambda: F.col("s.digest") == F.col("d.digest"), "same_size": lambda: same_size, "same": lambda: same_size & same_time(o),
    }
    out = F.when(F.col("s.rel_path").isNull(), "delete")
    for condition, word in ladder(o):
        out = out.when(meaning[condition](), word)
    return out


def decided(o: SyncOptions, s: dict, d: dict | None) -> str:
    """The ladder for one path, where its state is at hand: s and d have size and mtime_ns, d is None without a destination."""
    known = d is not None and None not in (s["mtime_ns"], d["mtime_ns"])
    same_size = d is not None and None not in (s["size"], d["size"]) and s["size"] == d["size"]
    gap = abs(s["mtime_ns"] - d["mtime_ns"]) if known else None
    same_time = known and (gap // 1_000_000_000 <= o.modify_window if o.modify_window else gap == 0)
    meaning = {"absent": d is None, "present": d is not None, "newer": known and d["mtime_ns"] > s["mtime_ns"], "any": True, "same_size": same_size, "same": same_size and same_time}
    return next(word for condition, word in ladder(o) if meaning[condition])


def selected(files: DataFrame, o: SyncOptions, chain: list[Rule] = (), prune_children: bool = False) -> DataFrame:
    """The source after rules, size limits and the file-system limit."""
    if chain:
        files = kept(files, list(chain), prune_children)
    if o.max_size is not None:
        files = files.where(F.col("size") <= o.max_size)
    if o.min_size is not None:
        files = files.where(F.col("size") >= o.min_size)
    if o.one_file_system is not None:
        files = files.where(F.col("dev") == o.one_file_system)
    return files


def plan(src: DataFrame, dst: DataFrame, o: SyncOptions = SyncOptions(), chain: list[Rule] = ()) -> DataFrame:
    """(rel_path, action, size, dst_size, size_gap_large): one row for each path of src, and with o.delete one
    for each path that goes. size is the source's, or the destination's for `delete`.

    Only metadata is joined. With o.delete one full outer join serves both sides; else a left join. By content, digests are
    taken where the rows are, from `content` or `text`, or from a column `digest`, which may be null for paths that same_size() leaves out.
    """
    s, d = selected(src, o, chain), dst
    if o.checksum == "content":
        s, d = (f if "digest" in f.columns else f.withColumn("digest", F.sha2(content_of(f), 256)) for f in (s, d))
    columns = ["rel_path", "size", "mtime_ns", *(["digest"] if o.checksum == "content" else [])]
    gone = F.lit(True)
    if o.delete and chain and not o.delete_excluded:
        gone = verdict(list(chain), F.col("d.rel_path")) != "excluded"
    both = s.select(*columns).alias("s").join(d.select(*columns).alias("d"), F.col("s.rel_path") == F.col("d.rel_path"), "full" if o.delete else "left")
    big, small = F.greatest("s.size", "d.size"), F.least("s.size", "d.size")
    gap = F.when(F.col("s.rel_path").isNotNull() & F.col("d.rel_path").isNotNull(), (small == 0) | ((big - small) * 4 > big))
    return both.where(F.col("s.rel_path").isNotNull() | gone).select(
        F.coalesce("s.rel_path", "d.rel_path").alias("rel_path"), action(o).alias("action"), F.coalesce("s.size", "d.size").alias("size"), F.col("d.size").alias("dst_size"), gap.alias("size_gap_large")
    )


def same_size(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel_path) of files whose contents a plan by content has to compare: others differ by their sizes already."""
    return src.select("rel_path", "size").join(dst.select("rel_path", "size"), ["rel_path", "size"]).select("rel_path")


def totals(planned: DataFrame) -> DataFrame:
    return planned.groupBy("action").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def deletions(src: DataFrame, dst: DataFrame, o: SyncOptions = SyncOptions(), chain: list[Rule] = ()) -> DataFrame:
    """(rel_path, size) that the destination has and the source has not; excluded ones stay unless
    o.delete_excluded; of o.max_delete the first by path."""
    extra = dst.select("rel_path", "size").join(selected(src, o, chain).select("rel_path"), "rel_path", "left_anti")
    if chain and not o.delete_excluded:
        extra = kept(extra, list(chain))
    return extra if o.max_delete is None else extra.orderBy("rel_path").limit(o.max_delete)


def new_dirs(src_dirs: DataFrame, dst_dirs: DataFrame) -> DataFrame:
    """(rel_path, depth), to be made from the top."""
    return src_dirs.join(dst_dirs, "rel_path", "left_anti").select("rel_path", paths.depth(F.col("rel_path")).alias("depth"))


def orphan_dirs(src_dirs: DataFrame, dst_dirs: DataFrame) -> DataFrame:
    """(rel_path, depth), to be removed from the bottom."""
    return dst_dirs.join(src_dirs, "rel_path", "left_anti").select("rel_path", paths.depth(F.col("rel_path")).alias("depth"))


def orphan_dirs_pushed(src: DataFrame, dst_dirs: DataFrame) -> DataFrame:
    """The server's rule: it knows files only, so just the directories that files are directly in are kept."""
    kept_dirs = src.select(paths.parent(F.col("rel_path")).alias("rel_path")).distinct()
    return orphan_dirs(kept_dirs, dst_dirs)


def looked_up(planned: DataFrame, local: DataFrame) -> DataFrame:
    """The local entries of what a plan transfers, with its action and an error where there is no such entry."""
    asked = planned.where("action in ('copy_new', 'copy_full', 'delta')").select("rel_path", "action")
    own = local.select("rel_path", F.struct(*[c for c in local.columns if c != "rel_path"]).alias("entry"))
    return asked.join(own, "rel_path", "left").select("rel_path", "action", "entry.*", F.when(F.col("entry").isNull(), "not in the local tree").alias("error"))


def empty_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories without any file below them."""
    full = files.select(F.explode(paths.directories(F.col("rel_path"))).alias("rel_path")).distinct()
    return dirs.join(full, "rel_path", "left_anti")


def hard_links(files: DataFrame) -> DataFrame:
    """(rel_path, leader, is_leader) of files that share (dev, ino) with others; the leader is the smallest path."""
    own = files.where("size > 0 and not is_symlink").select("rel_path", "dev", "ino")
    groups = own.groupBy("dev", "ino").agg(F.min("rel_path").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, ["dev", "ino"]).select("rel_path", "leader", (F.col("rel_path") == F.col("leader")).alias("is_leader"))


def linked_from(planned: DataFrame, src: DataFrame, other: DataFrame) -> DataFrame:
    """New files that `other` has with the same path, size and time: these are linked, not copied."""
    new = planned.where("action = 'copy_new'").select("rel_path").join(src.select("rel_path", "size", "mtime_ns"), "rel_path")
    return new.join(other.select("rel_path", "size", "mtime_ns"), ["rel_path", "size", "mtime_ns"], "left_semi")


def backups(planned: DataFrame, o: SyncOptions) -> DataFrame:
    """(rel_path, backup_path) of files that will be overwritten."""
    p = F.col("rel_path")
    to = F.concat(F.lit(f"{o.backup_dir.rstrip('/')}/"), p) if o.backup_dir else F.concat(p, F.lit(o.backup_suffix))
    return planned.where("action in ('copy_full', 'delta')").select("rel_path", to.alias("backup_path"))


def final_metadata(src: DataFrame, o: SyncOptions) -> DataFrame:
    """Mode, time and owners that a copy ends with; null where they aren't kept."""
    mode = paths.final_mode(F.col("mode"), o.superuser)
    if o.chmod:
        change = parse_chmod(o.chmod)
        if len({change(0), change(0o777)}) == 1:
            mode = F.lit(change(0))
        else:  # each bit is kept, set or cleared
            set_, keep = change(0), change(0o7777)
            mode = F.col("mode").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(set_)).cast("int")
    user, group = parse_chown(o.chown) if o.chown else (None, None)
    pick = lambda on, c: c if on else F.lit(None).cast("long")
    return src.select(
        "rel_path", (mode if o.perms or o.chmod else F.lit(None).cast("int")).alias("final_mode"), pick(o.times, F.col("mtime_ns")).alias("final_mtime_ns"),
        (F.lit(user).cast("long") if user is not None else pick(o.owner, F.col("uid"))).alias("final_uid"), (F.lit(group).cast("long") if group is not None else pick(o.group, F.col("gid"))).alias("final_gid"),
    )


def writers(planned: DataFrame, src: DataFrame) -> DataFrame:
    """How a copy would be written: batched, direct, plain, link, or empty."""
    own = planned.where("action in ('copy_new', 'copy_full')").select("rel_path").join(src.select("rel_path", "size", "is_symlink"), "rel_path")
    word = F.when(F.col("is_symlink"), "link").when(F.col("size") == 0, "empty").when(F.col("size") <= BATCHED, "batched").when(F.col("size") >= DIRECT, "direct").otherwise("plain")
    return own.select("rel_path", word.alias("writer"))


def plan_push(src: DataFrame, dst: DataFrame, delete: bool = False) -> DataFrame:
    """The server's rule: new, same size and time, or delta."""
    return plan(src, dst, SyncOptions(mode="network", delete=delete))


def plan_pull(local: DataFrame, remote: DataFrame, delete: bool = False) -> DataFrame:
    return plan_push(remote, local, delete)
