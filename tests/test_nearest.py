import numpy as np
import pytest

from braid.functions.vector import distance, literal
from braid.operators import nearest as N
from braid.operators.search import batch_vector_search


def frames(spark, text_ids=False):
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in rng.integers(-3, 4, 6)] for _ in range(300)]
    rows[5:120] = [rows[4]] * 115  # copies
    rows += [[0.0] * 6, None, [1.0, float("nan")] + [0.0] * 4, [1.0, None] + [0.0] * 4, [1.0, 2.0], []]
    name = (lambda i: f"n{i}") if text_ids else (lambda i: i)
    table = spark.createDataFrame([(name(i), v) for i, v in enumerate(rows)], f"id {'string' if text_ids else 'long'}, embedding array<float>")
    asked = [rows[0], rows[4], rows[4], rows[200], [0.5] * 6, [0.0] * 6, None, [1.0, 3.0]]
    return table.repartition(3), spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<double>"), [(i, v) for i, v in enumerate(asked) if v]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip", "l1"])
@pytest.mark.parametrize("text_ids", [False, True])
def test_equals_one_search_for_each_query(spark, metric, text_ids, monkeypatch):
    table, queries, asked = frames(spark, text_ids)
    monkeypatch.setattr(N, "FIRST_ROWS", 20)
    usable = table.where("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x))")
    want = set()
    for i, v in asked:
        near = usable.where(f"size(embedding) = {len(v)}").select("id", distance("embedding", literal(v), metric).alias("d")).orderBy("d", "id").limit(7)
        want |= {(i, r["id"], repr(r["d"]), n + 1) for n, r in enumerate(near.collect())}
    for slice_bytes in (1 << 20, 100):
        got = {(r["query_id"], r["id"], repr(r["distance"]), r["rank"]) for r in batch_vector_search(table, queries, 7, metric, slice_bytes=slice_bytes).collect()}
        assert got == want


def test_empty(spark):
    table, queries, _ = frames(spark)
    assert batch_vector_search(table.limit(0), queries, 5, "cosine").count() == 0
    assert batch_vector_search(table, queries.limit(0), 5, "cosine").count() == 0


def test_no_join_of_all_pairs(spark):
    table, queries, _ = frames(spark)
    plan = batch_vector_search(table, queries, 5, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
