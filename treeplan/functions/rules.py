"""Include and exclude rules: glob patterns compiled to one CASE over regular expressions.

The first rule that matches decides; a path that none matches is kept. `*` stops at a slash,
`**` does not, `**/` also matches nothing but may end inside a component, `?` is one
character but a slash, [a-z] and [!a-z] are classes. A rule with a slash inside is
matched against the whole path, others against the last component; a rule that ends in
a slash matches directories only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.functions import paths
from treeplan.work import importable


def glob_regex(pattern: str) -> str:
    """A regular expression that Java and RE2 read alike."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out.append(".*")
            i += 3 if pattern.startswith("/", i + 2) else 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2 + pattern.startswith("!", i + 1))) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
        i += 1
    return "^" + "".join(out) + "$"


@dataclass(frozen=True)
class Rule:
    kind: str  # include or exclude
    pattern: str
    dir_only: bool
    anchored: bool

    @property
    def regex(self) -> str:
        return glob_regex(self.pattern)


def rule(kind: str, text: str) -> Rule:
    dir_only = text.endswith("/")
    pattern = text.rstrip("/") if dir_only else text
    pattern = pattern.removeprefix("./")
    return Rule(kind, pattern, dir_only, "/" in pattern)


def rules(includes: list[str] = (), excludes: list[str] = (), include_lines: list[str] = (), exclude_lines: list[str] = ()) -> list[Rule]:
    """Includes, lines of include files, excludes, lines of exclude files, in this order."""
    lines = lambda xs: [x.strip() for x in xs if x.strip() and not x.strip().startswith("#")]
    return [rule("include", x) for x in (*includes, *lines(include_lines))] + [rule("exclude", x) for x in (*excludes, *lines(exclude_lines))]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file: trimmed, without blank lines and comments. A missing file raises."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("line")).where((line != "") & ~line.startswith("#"))


def rules_from_files(spark: SparkSession, includes: list[str] = (), excludes: list[str] = (), include_from: list[str] = (), exclude_from: list[str] = ()) -> list[Rule]:
    """rules() with the lines of these files, which become part of the plan and so must be few."""
    lines = lambda files: [r.line for f in files for r in read_lines(spark, f).collect()]
    return rules(includes, excludes, lines(include_from), lines(exclude_from))


def listed(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """The files that a list file names."""
    return files.join(read_lines(spark, path).select(F.col("line").alias("rel_path")).distinct(), "rel_path", "left_semi")


def matches(r: Rule, path: Column, is_dir: Column) -> Column:
    hit = (path if r.anchored else paths.name(path)).rlike(r.regex)
    return hit & is_dir if r.dir_only else hit


def verdict(chain: list[Rule], path: Column, is_dir: Column | None = None) -> Column:
    """included, excluded or neutral."""
    is_dir = F.lit(False) if is_dir is None else is_dir
    out = None
    for r in chain:
        word = F.lit("included" if r.kind == "include" else "excluded")
        out = F.when(matches(r, path, is_dir), word) if out is None else out.when(matches(r, path, is_dir), word)
    return F.lit("neutral") if out is None else out.otherwise("neutral")


def kept(files: DataFrame, chain: list[Rule], prune_children: bool = False, is_dir: Column | None = None) -> DataFrame:
    """Rows that are not excluded. With prune_children, also without those below an excluded directory."""
    path = F.col("rel_path")
    keep = verdict(chain, path, is_dir) != "excluded"
    if prune_children:
        keep &= ~F.exists(paths.directories(path), lambda d: verdict(chain, d, F.lit(True)) == "excluded")
    return files.where(keep)


#: Characters of the patterns of keyless rules together, at most: those go to every task.
KEYLESS = 1 << 20
_RULE = "ord long, kind string, dir_only boolean, anchored boolean, regex string, how string, key string"
_SPECIAL = re.compile(r"[*?\[]")


def _keyed(r: Rule) -> tuple[str, str]:
    """What a path must have for a rule to be worth a look: (how, key). name and path: this very name or path; end: a name that ends so from one of its
    dots; below: a path below this directory; any: no key."""
    p = r.pattern
    if not _SPECIAL.search(p):
        return ("path" if r.anchored else "name"), p
    if not r.anchored:
        return ("end", p[1:]) if p.startswith("*.") and not _SPECIAL.search(p[1:]) else ("any", "")
    parts = p.split("/")
    n = next(i for i, part in enumerate(parts) if _SPECIAL.search(part))
    return ("below", "/".join(parts[:n])) if n else ("any", "")


def relation(spark: SparkSession, chain: list[Rule] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Rules as rows, of a list or of (ord long, kind, line) of any number, where lines are as in rule files."""
    if lines is None:
        return spark.createDataFrame([(i, r.kind, r.dir_only, r.anchored, r.regex, *_keyed(r)) for i, r in enumerate(chain or [])], _RULE)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(o, r, *_keyed(r)) for o, kind, line in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (t := (line or "").strip()) and not t.startswith("#") for r in [rule(kind, t)]]
            columns = [[m[0] for m in made], *[[getattr(m[1], a) for m in made] for a in ("kind", "dir_only", "anchored", "regex")], [m[2] for m in made], [m[3] for m in made]]
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _RULE.split(", ")])

    importable(lines.sparkSession)
    return lines.select(F.col("ord").cast("long").alias("ord"), "kind", "line").mapInArrow(parsed, _RULE)


def judged(files: DataFrame, chain: DataFrame, is_dir: Column | None = None) -> DataFrame:
    """files with `verdict`, by rules of relation(): as verdict() of the list, but of a plan that is the same for any number of rules.

    A path meets only the rules that share a key with it, in one exchange, and of a key's rules that need no more than the key only the first is kept.
    Rules without a key (as `*a*`) are tried on every path in order; they are few as a rule, and more than KEYLESS characters of them are an error."""
    words = {"include": "included", "exclude": "excluded"}
    keyless = chain.where("how = 'any'")
    size = keyless.agg(F.sum(F.length("regex")).alias("n")).first().n or 0
    if size > KEYLESS:
        raise ValueError(f"rules that begin with a wildcard have {size} characters, more than {KEYLESS}")
    tried = [(r.ord, r.kind, r.dir_only, r.anchored, r.regex) for r in keyless.orderBy("ord").collect()]

    importable(files.sparkSession)

    @F.arrow_udf("long")
    def first_keyless(path: pa.Array, folder: pa.Array) -> pa.Array:
        compiled = [(o, d, a, re.compile(x)) for o, _, d, a, x in tried]
        out = []
        for p, is_folder in zip(path.to_pylist(), folder.to_pylist(), strict=True):
            name = p.rsplit("/", 1)[-1] if p is not None else ""
            out.append(next((o for o, d, a, x in compiled if (is_folder or not d) and x.search(p if a else name)), None) if p is not None else None)
        return pa.array(out, pa.int64())

    path = F.col("rel_path")
    rows = files.select(path, (F.lit(False) if is_dir is None else is_dir).alias("folder")).distinct()
    name = paths.name(path)
    dots = F.transform(F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1)) == "."), lambda i: F.substr(name, i, F.length(name)))
    key = lambda how, values: F.transform(values, lambda k: F.struct(F.lit(how).alias("how"), k.alias("key")))
    keys = F.concat(key("name", F.array(name)), key("path", F.array(path)), key("end", F.when(F.length(name) > 0, dots).otherwise(F.array().cast("array<string>"))), key("below", paths.directories(path)))
    first = chain.where("how <> 'any'").groupBy("how", "key", "dir_only", "anchored", F.when(F.col("how") == "below", F.col("regex")).alias("regex")).agg(F.min("ord").alias("ord"))
    asked = rows.select("rel_path", "folder", F.explode(keys).alias("k")).select("rel_path", "folder", "k.how", "k.key")
    met = asked.join(first, ["how", "key"]).where("(folder or not dir_only) and (regex is null or rel_path rlike regex)")
    least = met.select("rel_path", "folder", "ord")
    if tried:
        least = least.unionByName(rows.withColumn("ord", first_keyless("rel_path", "folder")).where("ord is not null"))
    least = least.groupBy("rel_path", "folder").agg(F.min("ord").alias("ord"))
    word = F.when(F.col("kind") == "include", words["include"]).otherwise(words["exclude"])
    told = least.join(chain.select("ord", "kind"), "ord").select(F.col("rel_path").alias("judged_path"), F.col("folder").alias("judged_folder"), word.alias("verdict"))
    own = (F.lit(False) if is_dir is None else is_dir).eqNullSafe(F.col("judged_folder"))
    both = files.join(told, path.eqNullSafe(F.col("judged_path")) & own, "left")
    return both.withColumn("verdict", F.coalesce("verdict", F.lit("neutral"))).drop("judged_path", "judged_folder")
