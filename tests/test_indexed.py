import math

import pytest

from braid.config import SearchConfig, Weights
from braid.operators.search import HybridSearch
from braid.sources.ivf import build_ivf
from braid.sources.postings import write_postings

WORDS = ["red", "fox", "of", "the", "den", "runs", "far", "renewal"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("indexes")
    rows = [(i, " ".join(WORDS[(i * 7 + j * j * (i % 5 + 1)) % 8] for j in range(i % 13)) if i % 17 else None, [math.cos(i * 0.37), math.sin(i * 0.37)] if i % 11 else None, i % 3) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, content string, embedding array<float>, kind int").cache()
    config = SearchConfig("content", "embedding", language="simple", filter_columns=("kind",))
    return table, write_postings(table, config, f"{folder}/postings"), build_ivf(table, f"{folder}/ivf", "id", "embedding", lists=8)


def both(made, text, vector=None, probes=8, filters=None, **how):
    table, postings, index = made
    config = SearchConfig("content", "embedding", language="simple", filter_columns=("kind",), **how)
    return [[tuple(r) for r in s.search(text, vector, filters=filters).collect()] for s in (HybridSearch(table, config), HybridSearch(table, config, index, postings, probes))]


@pytest.mark.parametrize(
    "text, how",
    [
        ("red fox", {}), ('"of the" den', {"strict_phrases": True}), ("red the", {"text_match": "all"}), ('"of the" -den', {"text_match": "all"}), ("red or -fox", {"text_match": "all"}),
        ("red fox", {"rank_function": "rank"}), ('"the den"', {"query_parser": "phrase", "rank_function": "rank"}), ("red -far", {}), ('den -"of the"', {}), ("nowhere", {}),
    ],
)
def test_postings_find_and_rank_as_the_table(made, text, how):
    scanned, indexed = both(made, text, **how)
    assert scanned == indexed and (scanned or text == "nowhere")


def test_all_lists_are_exact(made):
    for filters in (None, {"kind": 1}, {"kind": []}):
        scanned, indexed = both(made, "red -far", [1.0, 0.2], filters=filters)
        assert scanned == indexed


def test_lists_widen_until_the_pool_is_full(made):
    scanned, indexed = both(made, None, [1.0, 0.2], probes=1, filters={"kind": 1})
    assert scanned == indexed  # the 50 of the pool are more than any list holds
    assert len(both(made, None, [1.0, 0.2], probes=1)[1]) <= 10


def test_plans_read_the_indexes_only(made):
    table, postings, index = made
    search = HybridSearch(table, SearchConfig("content", "embedding", language="simple"), index, postings, 2)
    plan = search.candidates("red fox", [1.0, 0.2], None, 50)._jdf.queryExecution().executedPlan().toString()
    assert "In(lexeme, [" in plan and "PartitionFilters: [list#" in plan and "InMemoryTableScan" not in plan


def test_another_metric_is_refused(made):
    table, postings, index = made
    with pytest.raises(ValueError, match="the search uses l2"):
        HybridSearch(table, SearchConfig("content", "embedding", metric="l2"), index)


def test_results_say_what_matched(made):
    table, postings, index = made
    search = HybridSearch(table, SearchConfig("content", "embedding", language="simple", weights=Weights(1, 1)), index, postings, 8)
    found = search.results("renewal", [1.0, 0.2], limit=50, candidate_limit=50)
    assert {r.matched_by for r in found} >= {"both", "vector"}
    for r in found:
        assert (r.matched_by in ("both", "vector")) == (r.vector_rank is not None) and r.get("score") == r.score and r.get("nothing") is None
