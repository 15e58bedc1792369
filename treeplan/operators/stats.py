"""Summaries, formatted lines, the energy estimate and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeplan.operators.ranking import running


def summary(planned: DataFrame, scanned_bytes: DataFrame) -> DataFrame:
    """One row of counts and bytes; saved_pct of the planned bytes, and of all scanned bytes."""
    n = lambda a: F.count_if(F.col("action") == a).alias({"copy_new": "new", "delete": "deleted", "skip": "skipped"}[a])
    b = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    moved = F.col("action").isin("copy_new", "copy_full", "delta")
    row = planned.agg(n("copy_new"), F.count_if(F.col("action").isin("copy_full", "delta")).alias("updated"), n("skip"), n("delete"), b(moved).alias("transferred"), b(F.col("action") == "skip").alias("saved"))
    total = F.col("transferred") + F.col("saved")
    pct = lambda of: F.when(of == 0, 0.0).otherwise(F.round(F.col("saved") * 100.0 / of, 4))
    both = row.withColumn("k", F.lit(1)).join(scanned_bytes.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return both.select("*", pct(total).alias("saved_pct"), pct(F.col("scanned")).alias("saved_pct_scanned"))


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.count_if("is_symlink").alias("links"))


def itemized(pairs: DataFrame) -> DataFrame:
    """pairs: s (source) and d (destination) metadata as structs. (rel_path, line): kind and flags of what changes.
    Where both have is_dir, directories have lines too: made ones begin with c, others change in metadata only."""
    new = F.col("d").isNull()
    flag = lambda c, letter: F.when(new, "+").when(c, letter).otherwise(".")
    s, d = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"d.{c}"))
    differ = lambda c: s(c) != d(c)
    is_dir = F.coalesce(s("is_dir"), F.lit(False)) if "is_dir" in pairs.schema["s"].dataType.names else F.lit(False)
    line = F.concat(F.when(is_dir, F.when(new, "c").otherwise(".")).when(new, ">").when(differ("size") | differ("mtime_ns"), ">").otherwise("."), F.when(is_dir, "d").when(s("is_symlink"), "L").otherwise("f"), flag(F.lit(False), "c"), flag(differ("size"), "s"), flag(differ("mtime_ns"), "t"), flag(differ("mode"), "p"), flag(differ("uid"), "o"), flag(differ("gid"), "g"), F.lit(" "), s("rel_path"))
    gone = F.concat(F.lit("*deleting "), d("rel_path"))
    return pairs.select(F.coalesce(s("rel_path"), d("rel_path")).alias("rel_path"), F.when(F.col("s").isNull(), gone).otherwise(line).alias("line"))


def log_lines(planned: DataFrame) -> DataFrame:
    return planned.where("action <> 'skip'").select("rel_path", F.format_string("%s %s %d bytes", "action", "rel_path", "size").alias("line"))


def progress(files: DataFrame, stream: str, order: str, every: int = 100, large: int = 10 << 20) -> DataFrame:
    """(rel_path, line) of the files that are told of: every so many of a stream, and large ones. files: rel_path, size."""
    told = running(files, stream, order).where((F.col("nth") % every == 0) | (F.col("size") >= large))
    return told.select("rel_path", F.format_string("%d %s", "nth", "rel_path").alias("line"))


def energy(runs: DataFrame) -> DataFrame:
    """runs: (name, seconds) of CPU-saving runs. Watt-hours saved by the run at 10 W against four times its time, by
    year if hourly, carbon at 0.475 kg a kWh, and the share of a home's 10,700 kWh."""
    kwh = F.col("seconds") * 3 * 10 / 3600 / 1000
    year = kwh * 8766
    return runs.select("name", F.round(kwh * 1000, 6).alias("wh_saved"), F.round(year, 6).alias("kwh_year"), F.round(year * 0.475, 6).alias("kg_year"), F.round(year / 10700 * 100, 6).alias("home_pct"))


def _range(x: Column) -> Column:
    """The number of a value's range, never falling as values rise: 1000 ranges for each factor of e, below 4 million in all."""
    inf = float("inf")
    part = lambda y: F.floor(F.ln(y) * 1000)
    return F.when(F.isnan(x), 4_000_000).when(x == inf, 3_000_000).when(x == -inf, -3_000_000).when(x > 0, part(x) + 2_000_000).when(x < 0, -part(-x) - 2_000_000).otherwise(0)


def bench_statistics(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, upper median, sample deviation, p95 and p99 (the largest below 20 and 100 runs), cv in per cent.

    Ranked values are exact, and no group is gathered: equal values are counted, the counts of value ranges tell which
    range holds a rank, and only the values of such ranges are looked through. Null values don't count; a null group is one.
    """
    x, key = F.col("x"), F.struct(F.col(group)).alias("key")
    rows = runs.select(key, F.col(value).cast("double").alias("x"))
    per = rows.groupBy("key").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.max("x").alias("largest"))
    counted = rows.where(x.isNotNull()).groupBy("key", "x").agg(F.count("*").alias("m")).withColumn("range", _range(x))
    upto = lambda by, o: F.sum("m").over(Window.partitionBy(*by).orderBy(o))
    ends = counted.groupBy("key", "range").agg(F.sum("m").alias("m")).withColumn("upto", upto(["key"], "range"))
    at = lambda name, place: F.struct(F.lit(name).alias("name"), place.cast("long").alias("place"))
    asked = per.select("key", F.inline(F.array(at("median", F.floor(F.col("n") / 2)), at("p95", F.floor(F.col("n") * 0.95)), at("p99", F.floor(F.col("n") * 0.99)))))
    within = (F.col("upto") > F.col("place")) & (F.col("upto") - F.col("m") <= F.col("place"))
    hit = ends.join(asked, "key").where(within).select("key", "range", "name", (F.col("place") - F.col("upto") + F.col("m")).alias("place"))
    some = counted.join(hit.select("key", "range").distinct(), ["key", "range"], "left_semi").withColumn("upto", upto(["key", "range"], "x"))
    got = some.join(hit, ["key", "range"]).where(within).groupBy("key").agg(*[F.max(F.when(F.col("name") == n, x)).alias(n) for n in ("median", "p95", "p99")])
    at_least = lambda n, name: F.when(F.col("n") >= n, F.col(name)).otherwise(F.col("largest")).alias(name)
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100).otherwise(0.0)
    return per.join(got, "key", "left").select(F.col("key").getField(group).alias(group), "n", F.round("mean", 4).alias("mean"), "median", F.round("sd", 4).alias("stddev"), at_least(20, "p95"), at_least(100, "p99"), F.round(cv, 4).alias("cv_pct"))


def geometric_mean(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.where(F.col(value) > 0).groupBy(group).agg(F.round(F.exp(F.avg(F.ln(value))), 6).alias("geomean"))


def speedup(base: Column, ours: Column) -> Column:
    """To one decimal, cut off."""
    return F.floor(base / ours * 10) / 10
