"""The query of each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeplan.llm import bestfit, centroids, chat, langid, lines, pieces, pii, powers, prefixes, simhash, substrings, topk, variants

PII_KEY = "example key; use a secret one"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[str, str]:
    """Parameters of byte-level BPE: the public vocabulary, with its rank file and pattern."""
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, radius=2)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_read(spark, sf_dir, "documents"), PII_KEY)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return powers.pack(_read(spark, sf_dir, "documents"), **vocabulary(), longest=1024, end_id=0, keep_ids=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs).select(F.col("kept.doc_id").alias("doc_id"), "lang_pred", "score", "spans").select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(added), budget=4096, history_budget=1024, max_history=4))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=7, alpha=1.0)


def op8_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.sequences(bestfit.token_matrices(_read(spark, sf_dir, "documents"), **vocabulary(), width=2048))


def op9_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.fingerprints(_read(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_read(spark, sf_dir, "documents"), size=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_read(spark, sf_dir, "documents"), one_in=199, min_length=6, least=5, lead=5)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = centroids.cluster(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)
    return made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents"), least=10).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_topk, op4_powers, op5_langid, op6_chat, op7_pieces, op8_bestfit, op9_prefixes, op10_substrings, op11_variants, op12_centroids, op13_lines)}

def _rounds(rounds: int, k: int) -> str:
    """SQL of the clustering: one table of assignments and one of centroids for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT v.vec_id, m.c, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, m{r} m) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r + 1} AS MATERIALIZED (
            SELECT m.c, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
                    SELECT c, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v USING (vec_id)) GROUP BY c, i)
                GROUP BY c) n USING (c))""")
    return f"""WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), m0 AS MATERIALIZED (
            SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v) WHERE c < {k}
        ), {", ".join(steps)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN m{rounds} USING (c)"""


ORACLES = {
    "op11_variants": """
        WITH RECURSIVE one AS (  -- a table of crc32 for each byte
            SELECT i, i AS v, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
            UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM one WHERE k < 8
        ), crc AS (SELECT list(v ORDER BY i) AS t FROM one WHERE k = 8
        ), run AS (
            SELECT doc_id, r, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
            WHERE length(r) >= 6 GROUP BY ALL
        ), raw AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM run
        ), sums AS (
            SELECT r, n, xor(4294967295, list_reduce(list_transform(range(1, length(x) // 2 + 1), lambda j: CAST('0x' || substr(x, 2 * j - 1, 2) AS BIGINT)),
                lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM raw, crc
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word FROM sums)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
        ), best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word
        ), formed AS (
            SELECT w.word, CASE WHEN top >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), way AS (
            SELECT word, word AS root, form FROM formed
            UNION ALL SELECT y.word, f.word, f.form FROM way y JOIN formed f ON f.word = y.form
        )
        SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM formed f JOIN way y ON y.word = f.word AND y.form IS NULL
    """,
    "op12_centroids": _rounds(10, 8),
    "op13_lines": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), e AS (
            SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)
        ), m AS (SELECT k, min(doc_id) AS least FROM e WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
        ), s AS (SELECT e.*, least IS NOT NULL AND least <> doc_id AS gone FROM e LEFT JOIN m USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM s GROUP BY doc_id
    """,
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.c) = len(q.c)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op10_substrings": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
        ), r AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, rank() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM s) WHERE n > 1
        ), c AS (
            SELECT DISTINCT doc_id, p + k AS q FROM r, (SELECT unnest(range(0, 20)) AS k)
        ), g AS (
            SELECT doc_id, list(q) AS q FROM c GROUP BY doc_id
        ), k AS (
            SELECT doc_id, w, len(coalesce(q, [])) AS gone,
                   list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: q IS NULL OR NOT list_contains(q, x[2])), lambda x: x[1]) AS kept
            FROM d LEFT JOIN g USING (doc_id)
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
}
