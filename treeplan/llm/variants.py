"""Spelling variants: words at edit distance one, found by a trie that is joined with itself.

The vocabulary is counted from whole texts, with a map-side part. Two words of at least m letters at
distance one share their first or their last m // 2 letters, as one edit cannot touch both. So the
vocabulary is dealt twice, by its first letters and, written backwards, by its last, and each shard is
a trie of its own, walked with the sets of active nodes: those at distance one or less from the node
where the walk is. From a node to its child by letter c, the node itself (c deleted), its other
children (c replaced), the child's children (a letter inserted) and the children by c of active nodes
are active; where a word ends, the active nodes that are ends too are its near words. The backward
tries report only words with other first letters, so each pair is found once.

A shard with too many words is cut one letter after the start that all of it shares, as often as
needed. Active nodes that go from one side of such a cut to another are at distance one, so from there
only equal letters follow: those pairs meet by an exchange on the word without the letter at the cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeplan.llm.shared import attach, discard, materialize

#: Letters of a word after A-Z are lower-cased.
LETTER = "[a-zÀ-ÿ]"
#: Code points of a text that are searched at a time, but for a word that goes on.
STEP = 1 << 20
#: Words, and their letters, that a task counts before it passes them on.
HELD_WORDS, HELD_LETTERS = 100_000, 1 << 24
#: Words, and letters, that one trie holds at most; a shard with more is cut.
SHARD_WORDS, SHARD_LETTERS = 2048, 1 << 18
#: Rows that the walk gives out at a time.
OUT_ROWS = 10_000


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 199, min_length: int = 6) -> DataFrame:
    """(word, n): words of at least `min_length` code points and how often they occur.

    Runs of letters, lower-cased by A-Z only. Where `one_in` divides crc32 of `<id>:<run>`, h, the run
    loses its code point h % length. A null text has none; a null id is an empty text in that key."""
    attach(docs.sparkSession)
    found, letter = re.compile(f"{LETTER}{{{min_length},}}"), re.compile(f"{LETTER}+")

    def runs(text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = at + STEP
            on = letter.match(text, end) if end < len(text) else None
            end = on.end() if on else end
            yield found.findall(text, at, end)
            at = end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            lowered = pc.ascii_lower(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for part in runs(lowered[i].as_py() or ""):
                    for run, n in Counter(part).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % one_in == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < min_length:
                                continue
                        if run not in held:
                            letters += len(run)
                        held[run] += n
                    if len(held) > HELD_WORDS or letters > HELD_LETTERS:
                        yield out()
                        held, letters = Counter(), 0
        if held:
            yield out()

    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trie_pairs(words: list[str], start: int = 0) -> Iterator[tuple[int, int]]:
    """Indexes (i, j), both ways, of words at distance one. The words are distinct and share their first `start` letters."""
    down: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word[start:]:
            to = down[at].get(c)
            if to is None:
                to = down[at][c] = len(down)
                down.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    todo = [(0, set(down[0].values()))]  # a node and the nodes at distance one from it
    while todo:
        at, active = todo.pop()
        if ends[at] >= 0:
            for x in active:
                if ends[x] >= 0:
                    yield ends[at], ends[x]
        for c, child in down[at].items():
            near = {at, *down[at].values(), *down[child].values()}
            near.update(y for x in active if (y := down[x].get(c)) is not None)
            near.discard(child)
            todo.append((child, near))


def _walk(rows: DataFrame, half: int) -> DataFrame:
    """(word, near, near_n) of shards (backward, shard, word, n, cut), each a trie in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cut, words, ns, out = None, 0, [], [], []

        def made() -> None:
            for i, j in trie_pairs(words, cut):
                a, b = words[i], words[j]
                if name[0]:
                    if a[len(a) - half :] == b[len(b) - half :]:
                        continue  # their first letters are the same: the forward trie has them
                    a, b = a[::-1], b[::-1]
                out.append((a, b, ns[j]))

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
            out.clear()
            return got

        for batch in batches:
            for backward, shard, word, n, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (backward, shard) != name:
                    if len(words) > 1:
                        made()
                    name, cut, words, ns = (backward, shard), at, [], []
                    if len(out) > OUT_ROWS:
                        yield batch_of()
                words.append(word)
                ns.append(n)
        if len(words) > 1:
            made()
        yield batch_of()

    dealt = rows.select("backward", "shard", "word", "n", "cut").repartition("backward", "shard").sortWithinPartitions("backward", "shard")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _shared(a: Column, b: Column) -> Column:
    """The length of the start that two different texts share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return (F.array_position(same, False) - 1).cast("int")


def _across(hot: DataFrame, half: int) -> DataFrame:
    """(word, near, near_n) of words of one shard that differ at its cut: one has another letter there, or one more."""
    letter = F.substring("word", F.col("cut") + 1, 1)  # empty where the word ends
    cut = F.struct("word", "n", letter.alias("at"))
    whole = hot.select("backward", "cut", F.col("word").alias("rest"), cut.alias("w"))
    short = hot.where(letter != "").select("backward", "cut", F.concat(F.substring("word", 1, F.col("cut")), F.expr("substring(word, cut + 2)")).alias("rest"), cut.alias("w"))
    # as many as there are letters: all words with one rest differ at one place only
    groups = whole.unionByName(short).groupBy("backward", "cut", "rest").agg(F.collect_list("w").alias("w")).where("size(w) > 1")
    pairs = groups.select("backward", F.explode("w").alias("a"), "w").select("backward", "a", F.explode("w").alias("b")).where("a.at <> b.at")
    last = lambda w: F.right(F.col(w), F.lit(half))
    pairs = pairs.where(~F.col("backward") | (last("a.word") != last("b.word")))
    back = lambda w: F.when(F.col("backward"), F.reverse(w)).otherwise(F.col(w))
    return pairs.select(back("a.word").alias("word"), back("b.word").alias("near"), F.col("b.n").alias("near_n"))


def near_words(words: DataFrame, min_length: int, shard_words: int = SHARD_WORDS, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(word, near, near_n), each pair both ways once: words at edit distance one. words: (word, n), distinct, of at least `min_length`.

    Each round cuts the shards that hold more than a trie may; what fits already is done with, so rounds grow fewer rows."""
    half = min_length // 2
    both = words.select(F.lit(False).alias("backward"), "word", "n").unionByName(words.select(F.lit(True), F.reverse("word"), "n").toDF("backward", "word", "n"))
    rows, found = materialize(both.withColumn("cut", F.lit(half)), "shards"), []
    while True:
        named = rows.withColumn("shard", F.substring("word", 1, F.col("cut")))
        sizes = named.groupBy("backward", "shard").agg(F.count("*").alias("words"), F.sum(F.char_length("word")).alias("letters"), F.min("word").alias("least"), F.max("word").alias("most"))
        large = sizes.where((F.col("words") > 1) & ((F.col("words") > shard_words) | (F.col("letters") > shard_letters)))
        large = materialize(large.select("backward", "shard", _shared(F.col("least"), F.col("most")).alias("to")), "large")
        if large.isEmpty():
            found.append(_walk(named, half))
            break
        found.append(_walk(named.join(large, ["backward", "shard"], "left_anti"), half))
        hot = materialize(named.join(large, ["backward", "shard"]).select("backward", "word", "n", F.col("to").alias("cut")), "hot")
        found.append(_across(hot, half))
        rows = hot.withColumn("cut", F.col("cut") + 1)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps of all words; a form is
    `lead` times as frequent as its word, so there are no circles and few rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        after = materialize(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        discard(now)
        now = after


def grouped(words: DataFrame, near: DataFrame, lead: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) and its near words: form is the near word of largest n (ties: the
    smallest in code-point order) if that is at least `lead` times the word's n."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    fits = -F.col("best.minus") >= lead * F.col("n")
    made = words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.minus")).alias("form_n")
    )
    made = materialize(made, "forms")
    ends = roots(made.where("form is not null"))
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 199, min_length: int = 6, least: int = 5, lead: int = 5) -> DataFrame:
    """Groups the words of whole texts by spelling: (word, form, root, n, n_near, form_n), one row for each word of at
    least `min_length` code points and `least` occurrences.

    Null and empty texts have no words; null ids count as empty in the key of occurrences(); repeated rows count again; ties
    go to the smaller word; a very long text is read in steps, a very long word is a word; an empty table gives no rows; other
    columns may have any names."""
    words = materialize(occurrences(docs, id_col, text_col, one_in, min_length).where(F.col("n") >= least), "words")
    return grouped(words, near_words(words, min_length), lead)
