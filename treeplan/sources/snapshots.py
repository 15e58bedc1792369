"""Snapshots of a source and a destination tree, derived from the documents table.

files: rel_path (key), size, mtime_ns, mode, is_symlink, symlink_target, uid, gid, dev, ino and,
where asked for, text. Plans never ask for text; only rows whose content is needed do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.functions import paths
from treeplan.operators.ranking import checkpointed

META = ("rel_path", "size", "mtime_ns", "mode", "is_symlink", "symlink_target", "uid", "gid", "dev", "ino")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def src_files(spark: SparkSession, sf_dir: str, inodes: bool = False) -> DataFrame:
    """One file for each document; inodes=True adds equal inodes for equal texts (a digest aggregation)."""
    i = F.col("doc_id")
    ext = F.when(i % 5 == 0, ".toml").when(i % 5 == 1, ".rs").when(i % 5 == 2, ".json").when(i % 5 == 3, ".bin").otherwise(".log")
    link = i % 50 == 49
    docs = _documents(spark, sf_dir)
    ino = (F.lit(1000000) + i).cast("long")
    if inodes:
        # equal texts share an inode; the digest, not the text, is dealt
        small = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
        docs = docs.join(small.join(small.groupBy("digest").agg(F.min("doc_id").alias("least")), "digest").select("doc_id", "least"), "doc_id")
        ino = F.lit(1000000) + F.col("least")
    text = F.when(link, "").otherwise(F.col("text"))
    return docs.select(
        "doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.lpad(i.cast("string"), 8, "0"), ext).alias("rel_path"),
        text.alias("text"), _bytes(text).alias("size"), (F.lit(1700000000000000000) + i * 1000000007).alias("mtime_ns"),
        F.when(i % 11 == 0, 2541).when(i % 7 == 0, 493).otherwise(420).alias("mode"), link.alias("is_symlink"), F.when(link, "doc_00000000.toml").alias("symlink_target"),
        F.lit(1000).cast("long").alias("uid"), (F.lit(1000) + i % 3).cast("long").alias("gid"), F.when(F.col("source") == "src1", 2).otherwise(1).cast("long").alias("dev"), ino.alias("ino"), "source",
    )


def dst_files(spark: SparkSession, sf_dir: str, inodes: bool = False) -> DataFrame:
    """The same tree, changed by doc_id % 20, with stale files (see FIXTURES.md)."""
    src, i = src_files(spark, sf_dir, inodes), F.col("doc_id")
    k, t, m = i % 20, F.col("text"), F.col("mtime_ns")
    text = F.when(F.col("is_symlink"), t).when(k == 1, F.concat(F.lit("!"), t)).when(k == 2, F.left(t, F.expr("length(text) div 2"))).when(k == 5, F.concat(t, t)).otherwise(t)
    time = m + F.when(k == 1, -5_000_000_000).when(k == 2, -86_400_000_000_000).when(k == 3, 3_000_000_000).when(k == 4, -900_000_000).when(k == 5, 60_000_000_000).otherwise(0)
    same = src.where(k != 0).withColumns({"text": text, "mtime_ns": time, "mode": F.when(k == 6, 384).otherwise(F.col("mode")), "size": _bytes(text)})
    stale = src.where(i % 25 == 7)
    stale = stale.withColumns({"rel_path": F.concat(F.lit("stale/"), "source", F.lit("/doc_"), i.cast("string"), F.lit(".old")), "is_symlink": F.lit(False), "symlink_target": F.lit(None).cast("string"), "ino": F.col("ino") + 5000000})
    return same.unionByName(stale)


def directories(files: DataFrame) -> DataFrame:
    """(rel_path) of every directory that has a file somewhere below it, without the root."""
    return files.select(F.explode(paths.directories(F.col("rel_path"))).alias("rel_path")).distinct()


def dir_times(files: DataFrame) -> DataFrame:
    """(rel_path, mtime_ns) of directories, the root as '': the latest time of a file directly inside."""
    return files.groupBy(paths.parent(F.col("rel_path")).alias("rel_path")).agg(F.max("mtime_ns").alias("mtime_ns"))


def resolved_links(files: DataFrame) -> DataFrame:
    """Symbolic links replaced by what they point to, in any directory of the tree, over any number of links in a row;
    those that dangle, leave the tree or go round go.

    A link that points to a link takes over where that one points, all at once, so a row of n links is followed in log2(n) rounds;
    what points to a link after as many rounds as all links could need goes round."""
    base = F.nullif(paths.parent(F.col("rel_path")), F.lit(""))
    to = lambda place, target: paths.normalized(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", place, target)))
    links = files.where("is_symlink").select("rel_path", to(base, F.col("symlink_target")).alias("to")).where("to is not null")
    now = checkpointed(links)
    for _ in range(now.count().bit_length()):
        onward = now.select(F.col("rel_path").alias("to"), F.col("to").alias("onward"))
        if now.join(onward, "to", "left_semi").isEmpty():  # usually at once: few links point to links
            break
        now = checkpointed(now.join(onward, "to", "left").select("rel_path", F.coalesce("onward", "to").alias("to")))
    real = files.where("not is_symlink")
    target = real.select(F.col("rel_path").alias("to"), F.struct("size", "mtime_ns", "mode").alias("target"))
    found = now.join(target, "to").select("rel_path", "target")
    own = {c: F.col(f"link.`{c}`") for c in files.columns}
    own |= {c: F.col(f"target.{c}") for c in ("size", "mtime_ns", "mode")} | {"is_symlink": F.lit(False), "symlink_target": F.lit(None).cast("string")}
    rows = files.where("is_symlink").select("rel_path", F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("link")).join(found, "rel_path")
    return real.unionByName(rows.select(*[own[c].alias(c) for c in files.columns]))
