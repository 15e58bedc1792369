"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run()
writes each result as Parquet to the shared folder and reads it again for the next. All
but the last return the columns of documents.

A null or letter-less text goes at the first stage, the row of a copy at the second; later
stages keep every row and change texts. Extra columns pass through to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.llm import langid, pii, powers, simhash, substrings
from treeplan.llm.queries import PII_KEY, vocabulary
from treeplan.llm.shared import discard, materialize

#: Share of a text's letters that its main language must have.
MIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose main language has at least MIN_SHARE of the letters; `lang` is kept as it is.

    Null, empty and letter-less texts go, as do texts mostly in a script that no labelled document has; repeated rows are
    judged alike; an empty table stays empty."""
    made = langid.identify(docs, keep=tuple(docs.columns))
    return made.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)).select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is alike in its shingles of five words (0.8 or more).

    Texts without words are alike, nulls among them; of repeated rows one stays, rows without an id are kept like others;
    an empty table stays empty."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 20-word windows that start earlier elsewhere; texts without any stay as they are, nulls too.
    All rows stay, also where nothing is left of a text; an empty table stays empty."""
    made = substrings.dedup(docs, size=20, extra=tuple(docs.columns))
    before = {c: F.col("extra").getField(c) for c in docs.columns}
    return _with_text(before, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(before["text"]), made)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; null and empty texts, and all rows, stay."""
    made = pii.pseudonymized(docs, F.col("text"), PII_KEY)
    return _with_text({c: F.col("row").getField(c) for c in docs.columns}, F.col("made.text"), made)


def _with_text(before: dict[str, Column], text: Column, rows: DataFrame) -> DataFrame:
    """The columns of documents with a new text, and its length where that changed."""
    after = before | {"text": text}
    if "n_chars" in before:
        after["n_chars"] = F.when(text.eqNullSafe(before["text"]), before["n_chars"]).otherwise(F.char_length(text))
    return rows.select(*[after[c].alias(c) for c in before])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs into sequences of powers of two, up to 1024 ids; a null text is an empty one, which is one id."""
    return powers.pack(docs, **vocabulary(), longest=1024, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pseudonyms),
    ("packing", packing),
]

#: The second stage's components and the learned languages are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
