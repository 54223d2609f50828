import numpy as np
import pytest

from braid.config import SearchConfig
from braid.operators import doctor as D
from braid.sources.ivf import build_ivf


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 6))
    rows = [(i, f"text {i}", [float(x) for x in centres[i % 8] + 0.05 * rng.normal(size=6)], "a" if i % 8 == 0 or i % 3 else "b") for i in range(400)]
    # of kind c there are a few rows, near no query
    rows += [(1000 + i, "rare", [float(x) for x in 3 * rng.normal(size=6)], "c") for i in range(24)]
    table = spark.createDataFrame(rows, "id long, content string, embedding array<float>, kind string").cache()
    config = SearchConfig("content", "embedding", language="simple", filter_columns=("kind",))
    return table, config, build_ivf(table, f"{tmp_path_factory.mktemp('index')}/ivf", "id", "embedding", lists=8)


def test_percentiles():
    assert [D.percentile([3.0, 1.0, 2.0, 4.0], s) for s in (0.5, 0.95, 0.0)] == [2.0, 4.0, 1.0]


def test_samples(made):
    table = made[0]
    assert D.sample_rows(table, 7, 424).count() == 7
    assert D.sample_rows(table, 50, 4 * D.ROWS_SORTED + 1).count() <= 50
    assert 0 < D.sample_rows(table, 2 * D.ROWS_SORTED, D.ROWS_SORTED + 1).count() <= 424


def test_filter_probes(made):
    table, config, _ = made
    (tried, share), = D.filter_probes(table, config)
    assert tried == {"kind": "a"} and share == table.where("kind = 'a'").count() / 424
    assert D.filter_probes(table, config, {"kind": None}) == [({"kind": None}, 0.0)]


def test_recall_and_its_loss_under_a_filter(spark, made):
    table, config, index = made
    queries = table.where("id < 8").selectExpr("id AS query_id", "transform(embedding, x -> double(x)) AS vector")
    assert D.batch_recall(table, index, queries, 10, 8, config) == 1.0
    found = D.filtered_recall(table, config, index, queries, 10, {"kind": "c"}, 1.0, 1)
    assert len(found) == 1 and found[0].level == "warn" and "lists give" in found[0].advice
    assert D.filtered_recall(table, config, index, queries, 10, {"kind": "c"}, 1.0, 8) == []


def test_doctor(made, monkeypatch):
    table, config, index = made
    found = D.doctor(table, config, index, sample=3, k=5, sweep=True)
    assert any("p95" in f.what and "recall@5 is 1.00 at 8 of 8 lists" in f.what for f in found) and any("of rows pass" in f.what for f in found)
    assert not any("skips no list" in f.what for f in found)
    twice = D.doctor(table.union(table.limit(1)), config)
    assert any(f.level == "error" and "occurs 2 times" in f.what for f in twice) and any("no vector index" in f.what for f in twice)
    assert D.doctor(table.drop("content"), config)[0].what == "no column content"
    for how in ({"sample": 0}, {"k": 0}):
        with pytest.raises(ValueError):
            D.doctor(table, config, **how)
    with pytest.raises(ValueError):
        D.doctor(table, SearchConfig("content", "embedding"), filters={"kind": "a"})
