import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from treeplan.llm import queries, tokens
from treeplan.llm.shared import materialize
from treeplan.llm.simhash import shingle_hashes


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf), name))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "pii", "packing"]


def test_clean_documents_stay(stages):
    assert stages[1].count() == stages[0].count()


def test_one_of_each_group(stages):
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    sets = {d: set(shingle_hashes(t, 5).tolist()) for d, t in texts.items()}
    ids, up = sorted(texts), {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[2].collect()} == {d for d in ids if root(d) == d}


def test_repeated_passages_go(stages):
    seen = collections.Counter()
    for r in stages[3].collect():
        w = r.text.split()
        seen.update({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
    assert not [k for k, n in seen.items() if n > 1]


def test_packed_texts_come_back(stages):
    enc = tokens.encoder(**queries.vocabulary())
    want = {r.doc_id: [*enc.ids(r.text or "").tolist(), 0] for r in stages[4].collect()}
    import numpy as np

    got = collections.defaultdict(list)
    for r in sorted(stages[5].collect(), key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want


def test_odd_rows(spark, sf):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, "en", "s", 5, "x"), (1, words, "en", "s", 5, "x"), (2, words + " more", "en", "s", None, "x"), (3, None, "en", "s", 0, "x"), (4, "", None, "s", 0, "x"), (None, "some other text entirely", "en", None, 1, "x"), (6, "1 2 3", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for name in ("__id", "__n", "__lead", "__text", "__made", "row", "made", "kept", "extra", "id", "node", "key", "a.b", "back`tick", "x.`y`", "clash"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns[-1] == "clash" and docs.select("__text", "made").distinct().collect() == [("clash", "clash")]
    assert sorted((r.doc_id or -1, r.text) for r in docs.collect()) == [(-1, "some other text entirely"), (1, words)]
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf), name)
    assert empty.count() == 0
