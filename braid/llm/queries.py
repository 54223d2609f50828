"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import decontaminate, html_extract, langid, line_dedup, minhash, mtree, packing, quality, sharding, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_fold(4) != 2)
    scores = quality.quality_scores(_table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(5) != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


#: DuckDB's twin of op2: all inner products.
OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"), [1.0] * 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: DuckDB's twin of op3: every window of ten words is compared as text.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS said FROM i),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
y AS (SELECT doc_id, w, p, unnest((SELECT coalesce(list(DISTINCT size), []) FROM t)) AS size FROM x),
h AS (SELECT doc_id, p, t.size, item FROM y JOIN t ON t.size = y.size AND p + y.size - 1 <= len(w) AND said = array_to_string(w[p:p + y.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: DuckDB's twin of op4: the first of each pair of consecutive lines, and the lines of all later ones.
OP4_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM s),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
n AS (SELECT doc_id, i, bare, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k WHERE bare <> ''),
w AS (SELECT doc_id, p, bare AS a, lead(bare) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM n),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS place FROM w WHERE b IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([p, p + 1]) AS p FROM f WHERE place > 1),
r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS n_runs FROM r GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.i = l.i LEFT JOIN g ON g.doc_id = n.doc_id AND g.p = n.p WHERE g.p IS NULL GROUP BY l.doc_id),
m AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN c ON c.doc_id = s.doc_id LEFT JOIN t ON t.doc_id = s.doc_id LEFT JOIN m ON m.doc_id = s.doc_id
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op10_langid": op10_langid,
        "op2_mtree": op2_mtree,
        "op3_decontaminate": op3_decontaminate,
        "op4_line_dedup": op4_line_dedup,
        "op5_html_extract": op5_html_extract,
        "op6_packing": op6_packing,
        "op7_minhash": op7_minhash,
        "op8_sharding": op8_sharding,
        "op9_suffix_dedup": op9_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_line_dedup": OP4_SQL}
