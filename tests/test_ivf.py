import numpy as np

from braid import catalog
from braid.operators.search import batch_vector_search
from braid.sources.ivf import build_ivf


def _vectors(n):
    """Vectors in 20 clusters, and one null; queries (ids divisible by 100) lie in different clusters."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in (centres[i % 20 if i % 100 else i // 100 % 20] + 0.02 * rng.normal(size=8))]) for i in range(n)]
    return rows + [(n + 1, None)]


def test_recall_of_the_default_probes(spark, tmp_path):
    table = spark.createDataFrame(_vectors(1200), "id long, embedding array<float>")
    index = build_ivf(table, str(tmp_path / "ivf"), "id", "embedding", lists=20)
    queries = table.where("id % 100 = 0").selectExpr("id AS query_id", "embedding AS vector")
    exact = {(r["query_id"], r["id"]) for r in batch_vector_search(table, queries, 10, "cosine").collect()}
    for slice_bytes in (1 << 20, 320):
        found = {(r["query_id"], r["id"]) for r in index.search_batch(queries, 10, slice_bytes=slice_bytes).collect()}
        assert len(exact) == len(found) == 120 and len(exact & found) >= 0.9 * len(exact)
    asked = queries.where("query_id = 300").first()["vector"]
    one = [tuple(r) for r in index.search(asked, 10, 2).collect()]
    assert one == [(r["id"], r["distance"]) for r in index.search_batch(queries, 10, 2).where("query_id = 300").orderBy("rank").collect()]


def test_query_searches_every_hundredth_row(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_vectors(1200), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = []
    monkeypatch.setattr(catalog, "batch_vector_search", lambda t, q, *a: asked.append({r[0] for r in q.collect()}) or batch_vector_search(t, q, *a))
    got = {r["probes"]: r["recall"] for r in catalog.queries()["ivf_recall"](spark, str(tmp_path)).collect()}
    assert asked == [set(range(0, 1200, 100))]
    assert sorted(got) == [1, 4, 20] and got[4] >= 0.9 and got[20] == 1.0
