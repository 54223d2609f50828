"""The engine's registered queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.config import Recency, SearchConfig, Weights
from braid.functions.text import analyze
from braid.operators import doctor as D
from braid.operators.explain import candidate_stats, effective_weights, locate
from braid.operators.search import HybridSearch, batch_vector_search
from braid.sources.ivf import build_ivf
from braid.sources.postings import write_postings

TEXT, TERMS, QUERY_ROW = "ndon estion ingor", ("ndon", "estion", "ingor"), 7
CONFIG = dict(text_column="content", vector_column="embedding", id_column="id", language="simple", filter_columns=("lang", "source"), extra_columns=("lang",))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vectors and times."""
    d, e, v = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings", "events"))
    e, v = e.select(F.col("vec_id").alias("id"), "embedding"), v.select(F.col("event_id").alias("id"), "ts")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source").join(e, "id", "left").join(v, "id", "left")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == QUERY_ROW).select("embedding").first()[0])


def _hybrid(spark, sf_dir, text: str | None = TEXT, vector: bool = True, config: dict | None = None, **how) -> DataFrame:
    search = HybridSearch(corpus(spark, sf_dir), SearchConfig(**CONFIG | (config or {})))
    return search.search(text, _vector(spark, sf_dir) if vector else None, **how).drop("content")


def _candidates(spark, sf_dir, **how):
    return HybridSearch(corpus(spark, sf_dir), SearchConfig(**CONFIG)), _vector(spark, sf_dir)


# --- SQL twins

_CORPUS = """WITH corpus AS (SELECT d.doc_id AS id, d.text AS content, d.lang, d.source, e.embedding, v.ts FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN events v ON v.event_id = d.doc_id),
query AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7),
tok AS (SELECT *, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS toks FROM corpus)"""
_FOLD = "list_reduce(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: {0}), lambda a, b: a + b)"
_DISTANCE = {
    "cosine": "list_cosine_distance(CAST(embedding AS DOUBLE[]), q)",
    "l2": f"sqrt({_FOLD.format('(z[1] - z[2]) * (z[1] - z[2])')})",
    "ip": f"-{_FOLD.format('z[1] * z[2]')}",
    "l1": _FOLD.format("abs(z[1] - z[2])"),
}
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_COUNT = f"len(list_filter(toks, lambda t: list_contains({_LIST}, t))) * CAST(0.1 AS DOUBLE)"
_ANY = f"list_has_any(toks, {_LIST})"
_RANK = "(" + " + ".join(f"coalesce(list_sum(list_transform(range(1, len(list_filter(toks, lambda t: t = '{w}')) + 1), lambda j: CAST(0.1 AS DOUBLE) / (j * j))), 0) / 1.64493406685" for w in TERMS) + ") / 3.0"


def _sql(vector: str | None = "cosine", match: str | None = _ANY, score: str = _COUNT, where: str = "true", pool: int = 50, limit: int = 10, offset: int = 0, fusion: str = "rrf", wv: float = 1.0, wt: float = 1.0, k: int = 60, recency: bool = False, tail: str | None = None) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    near = f"SELECT id, {_DISTANCE[vector]} AS vector_distance FROM tok, query WHERE embedding IS NOT NULL AND ({where}) ORDER BY vector_distance, id LIMIT {pool}" if vector else "SELECT NULL::BIGINT AS id, NULL::DOUBLE AS vector_distance WHERE false"
    found = f"SELECT id, {score} AS text_score FROM tok WHERE ({match}) AND ({where}) ORDER BY text_score DESC, id LIMIT {pool}" if match else "SELECT NULL::BIGINT AS id, NULL::DOUBLE AS text_score WHERE false"
    v, t = (f"{d(wv)} / ({d(k)} + vector_rank)", f"{d(wt)} / ({d(k)} + text_rank)") if fusion == "rrf" else (f"{d(wv)} * (1 - vector_distance)", f"{d(wt)} * text_score")
    factor = "coalesce(exp(-0.6931471805599453 * greatest(date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') / 1e6, 0.0) / (30 * 86400.0)), 1.0)"
    score_, more = ("round(fused_score * recency_factor, 12)", "round(recency_factor, 12) AS recency_factor,") if recency else ("fused_score", "")
    inner = f"SELECT f.*, c.lang{', ' + factor + ' AS recency_factor' if recency else ''} FROM fused f JOIN corpus c ON c.id = f.id"
    final = tail or f"SELECT id, {score_} AS score, fused_score, {more} vector_rank, vector_distance, vector_contribution, text_rank, text_score, text_contribution, lang FROM ({inner}) ORDER BY {'fused_score * recency_factor' if recency else 'fused_score'} DESC, id LIMIT {limit} OFFSET {offset}"
    return f"""{_CORPUS},
vec AS (SELECT *, rank() OVER (ORDER BY vector_distance) AS vector_rank FROM ({near})),
txt AS (SELECT *, rank() OVER (ORDER BY text_score DESC) AS text_rank FROM ({found})),
fused AS (SELECT *, vector_contribution + text_contribution AS fused_score FROM (
  SELECT coalesce(vec.id, txt.id) AS id, vector_rank, vector_distance, text_rank, text_score, coalesce({v}, 0.0::DOUBLE) AS vector_contribution, coalesce({t}, 0.0::DOUBLE) AS text_contribution FROM vec FULL OUTER JOIN txt ON vec.id = txt.id))
{final}"""


_STATS = """SELECT count(*) AS fused, count(vector_rank) AS by_vector, count(text_rank) AS by_text, count(*) FILTER (WHERE vector_rank IS NOT NULL AND text_rank IS NOT NULL) AS by_both,
min(vector_contribution) FILTER (WHERE vector_rank IS NOT NULL) AS vector_min, max(vector_contribution) FILTER (WHERE vector_rank IS NOT NULL) AS vector_max,
min(text_contribution) FILTER (WHERE text_rank IS NOT NULL) AS text_min, max(text_contribution) FILTER (WHERE text_rank IS NOT NULL) AS text_max FROM fused"""
_WEIGHTS = f"""SELECT signal, nominal, span, span / sum(span) OVER () AS effective, abs(span / sum(span) OVER () - nominal) AS distortion
FROM (SELECT 'vector' AS signal, 0.5::DOUBLE AS nominal, vector_max - vector_min AS span FROM ({_STATS}) UNION ALL SELECT 'text', 0.5::DOUBLE, text_max - text_min FROM ({_STATS}))"""
_LOCATE = f"""{_CORPUS}, r AS (SELECT id, content, {_DISTANCE['cosine']} AS d, embedding IS NULL AS missing, {_ANY} AS m, {_COUNT} AS s FROM tok, query),
n AS (SELECT * FROM r WHERE contains(lower(content), 'ndon')), t AS (SELECT * FROM n ORDER BY content = 'ndon' DESC, id LIMIT 1)
SELECT id, (SELECT count(*) FROM n) AS match_count, true AS passes_filters, false AS excluded_by_query, missing AS embedding_missing, d AS vector_distance, m AS text_matches, CASE WHEN m THEN s END AS text_score,
CASE WHEN d IS NOT NULL THEN (SELECT count(*) FROM r WHERE r.d < t.d) + 1 END AS vector_rank, CASE WHEN m THEN (SELECT count(*) FROM r WHERE r.m AND r.s > t.s) + 1 END AS text_rank FROM t"""


def _recency(spark, sf_dir):
    out = _hybrid(spark, sf_dir, config={"recency": Recency("ts", 30)}, as_of=datetime(2024, 2, 1))
    return out.withColumn("score", F.round("score", 12)).withColumn("recency_factor", F.round("recency_factor", 12))


def _stats(spark, sf_dir):
    search, vector = _candidates(spark, sf_dir)
    return candidate_stats(search.candidates(TEXT, vector, None, 50))


def _weights(spark, sf_dir):
    search, vector = _candidates(spark, sf_dir)
    return effective_weights(search, TEXT, vector)


def _locate(spark, sf_dir):
    search, vector = _candidates(spark, sf_dir)
    return locate(search, "ndon", TEXT, vector, columns=["content"])


def _batch(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return batch_vector_search(e.withColumnRenamed("vec_id", "id"), queries, 10, "cosine").select("query_id", "id", "distance", "rank")


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


def _foreign(spark, sf_dir):
    """Filter by null, of a column that has nulls."""
    table = corpus(spark, sf_dir).withColumn("foreign_lang", F.nullif("lang", F.lit("en")))
    search = HybridSearch(table, SearchConfig(**CONFIG | {"filter_columns": ("foreign_lang",)}))
    return search.search(TEXT, _vector(spark, sf_dir), filters={"foreign_lang": None}).drop("content")


def _indexed(spark, sf_dir):
    """A search through written postings and all lists of a written vector index, which is exact."""
    config = SearchConfig(**CONFIG)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    words = write_postings(docs, config, _folder(spark, "postings"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = build_ivf(e, _folder(spark, "ivf"), "id", "embedding", lists=20)
    search = HybridSearch(corpus(spark, sf_dir), config, index, words, probes=20)
    return search.search(TEXT + " -ated", _vector(spark, sf_dir), filters={"lang": ["en", "de"]}).drop("content")


def _ivf_recall(spark, sf_dir):
    """Mean recall@10 over every row whose id is divisible by 100, at 1, 4 (the default of 20 lists) and all lists."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = build_ivf(e, _folder(spark, "ivf"), "id", "embedding", lists=20)
    queries = e.where((F.col("id") % 100 == 0) & F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = (1, 4, 20)
    truth = batch_vector_search(e, queries, 10, "cosine").select("query_id", "id").distinct()
    truth = truth.withColumn("probes", F.explode(F.array(*[F.lit(p) for p in probes])))
    got = reduce(DataFrame.union, [index.search_batch(queries, 10, p).select("query_id", "id", F.lit(p).alias("probes")) for p in probes]).distinct()
    each = truth.join(got.withColumn("hit", F.lit(1)), ["probes", "query_id", "id"], "left").groupBy("probes", "query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return each.groupBy("probes").agg(F.avg("recall").alias("recall")).orderBy("probes")


_h = lambda **a: partial(_hybrid, **a)
_C = lambda f: lambda spark, sf_dir: f(corpus(spark, sf_dir))
_PAIRS = "list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the')"
_PHRASE_RANK = "(" + " + ".join(f"coalesce(list_sum(list_transform(range(1, len(list_filter(toks, lambda t: t = '{w}')) + 1), lambda j: CAST(0.1 AS DOUBLE) / (j * j))), 0) / 1.64493406685" for w in ("of", "the")) + ") / 2.0"
# of two words, the minimal covers lie between neighbouring hits of different words
_HITS = "list_filter(range(1, len(toks) + 1), lambda i: toks[i] IN ('of', 'the'))"
_TWO = f"coalesce(list_sum(list_transform(list_filter(list_zip({_HITS}[:-2], {_HITS}[2:]), lambda z: toks[z[1]] <> toks[z[2]]), lambda z: CAST(0.1 AS DOUBLE) / (z[2] - z[1]))), 0)"
# a phrase without gaps and a word are covers without gaps
_DENSE = f"coalesce(list_sum(list_transform(range(0, len({_PAIRS}) + len(list_filter(toks, lambda t: t = 'ndon'))), lambda i: CAST(0.1 AS DOUBLE))), 0)"
_ROUND = lambda q: lambda s, d: q(s, d).withColumn("text_score", F.round("text_score", 12))

#: name -> (query, SQL or None)
_ALL: dict[str, tuple[Callable, str | None]] = {
    "hybrid_rrf": (_h(), _sql()),
    **{f"vector_topk_{m}": (_h(text=None, config={"metric": m}), _sql(m, None)) for m in ("cosine", "l2", "ip", "l1")},
    "text_topk_any": (_h(vector=False), _sql(None)),
    "text_topk_all_simple": (_h(text="the of", vector=False, config={"text_match": "all"}), _sql(None, "list_has_all(toks, ['of', 'the'])", _TWO)),
    "hybrid_weighted": (_h(fusion="weighted"), _sql(fusion="weighted")),
    "hybrid_weights_k": (_h(config={"weights": Weights(1.5, 0.5), "k": 10}), _sql(wv=1.5, wt=0.5, k=10)),
    "hybrid_filter_eq": (_h(filters={"lang": "en"}), _sql(where="lang = 'en'")),
    "hybrid_filter_in": (_h(filters={"lang": ["en", "de"], "source": ["src1", "src2", "src3"]}), _sql(where="lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')")),
    "hybrid_filter_null": (_h(filters={"lang": None}), _sql(where="lang IS NULL")),
    "hybrid_filter_null_rows": (_foreign, _sql(where="nullif(lang, 'en') IS NULL")),
    "hybrid_filter_empty": (_h(filters={"lang": []}), _sql(where="false")),
    "hybrid_exclusion": (_h(text=TEXT + " -ated"), _sql(where="NOT list_contains(toks, 'ated')")),
    "exclusion_only": (_h(text="-ated"), _sql(match=None, where="NOT list_contains(toks, 'ated')")),
    "hybrid_page2": (_h(offset=10), _sql(offset=10)),
    "hybrid_near_miss": (_h(near_miss=5), _sql(limit=15)),
    "hybrid_recency": (_recency, _sql(recency=True)),
    "phrase_match": (_ROUND(_h(text='"of the"', vector=False, config={"strict_phrases": True, "rank_function": "rank"})), _sql(None, f"len({_PAIRS}) > 0", f"round({_PHRASE_RANK}, 12)")),
    "rank_or": (lambda s, d: _hybrid(s, d, vector=False, config={"rank_function": "rank"}).withColumn("text_score", F.round("text_score", 12)), _sql(None, score=f"round({_RANK}, 12)")),
    "candidate_stats": (_stats, _sql(tail=_STATS)),
    "effective_weights": (_weights, _sql(tail=_WEIGHTS)),
    "find_locate": (_locate, _LOCATE),
    "duplicate_ids": (lambda s, d: D.duplicate_ids(s.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey"), "SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "null_fraction": (_C(lambda c: D.null_fraction(c, "embedding")), _CORPUS + " SELECT count(*) AS row_count, count(*) FILTER (WHERE embedding IS NULL) AS nulls, avg(CAST(embedding IS NULL AS DOUBLE)) AS null_fraction FROM corpus"),
    "common_value": (_C(lambda c: D.common_value(c, "lang")), "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "tokens_drift": (
        _C(lambda c: D.tokens_drift(c.withColumn("stored", F.when(F.col("id") % 5 == 0, F.array(F.lit("stale"))).otherwise(analyze(F.col("content"), "simple"))), "stored", "content", "simple")),
        _CORPUS + " SELECT count(*) AS row_count, count(*) FILTER (WHERE id % 5 = 0 AND toks IS DISTINCT FROM ['stale']) AS drifted FROM tok",
    ),
    "exact_ground_truth_batch": (_batch, "SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) WHERE rank <= 10"),
    "hybrid_english": (_h(config={"language": "english"}), None),
    "hybrid_cover_density": (_h(text='"of the" ndon', config={"strict_phrases": True}), _sql(match=f"(len({_PAIRS}) > 0 OR list_contains(toks, 'ndon'))", score=_DENSE)),
    "highlight_page": (_h(highlight=True), None),
    "hybrid_indexed": (_indexed, _sql(where="NOT list_contains(toks, 'ated') AND lang IN ('en', 'de')")),
    "ivf_recall": (_ivf_recall, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
