import math
from datetime import datetime, timedelta

import pytest

from braid.config import IdentifierError, Recency, SearchConfig, Weights, check_name
from braid.functions import text as T
from braid.functions.stem import stem
from braid.functions.vector import checked
from braid.operators.explain import explain
from braid.operators.search import HybridSearch
from braid.plans.build import build_plan, suggest_config
from braid.sources.ivf import ivf_lists, ivf_probes

AS_OF = datetime(2024, 1, 31)
#: (id, angle, content): how often the words of the query occur decides the text ranks.
ROWS = [
    (1, 0.15, "The agreement extends itself for another year unless stopped."),
    (2, 0.28, "Either side may stop the renewal if it gives notice within the period stated."),
    (3, 0.40, "The subscription starts on the day of signing."),
    (4, 0.52, "Invoices are due in thirty days."),
    (5, 0.64, "Service levels are measured monthly."),
    (6, 0.76, "Every notice must be written."),
    (7, 0.88, "Renewal pricing: a renewal in the first period costs less than a renewal in a later period, notice aside."),
    (8, 1.00, "A renewal follows each period unless notice arrives."),
    (9, 1.12, "Courts of the capital decide."),
    (10, 1.24, "Secrets stay secret."),
    (11, 1.36, "Personal data is protected."),
    (12, 1.48, "Liability is limited."),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, c, [math.cos(a), math.sin(a)], i % 2, AS_OF - timedelta(days=30) if i == 2 else None) for i, a, c in ROWS]
    return spark.createDataFrame(rows, "id long, content string, embedding array<float>, tenant_id int, ts timestamp_ntz").cache()


def searcher(table, **how):
    return HybridSearch(table, SearchConfig(text_column="content", vector_column="embedding", filter_columns=("tenant_id",), **how))


def test_planted_answer_wins_after_fusion(table):
    rows = searcher(table).search("renewal notice period", [1.0, 0.0]).collect()
    assert [r["id"] for r in rows[:4]] == [2, 7, 8, 6]
    two = rows[0]
    assert (two["vector_rank"], two["text_rank"], round(two["text_score"], 6)) == (2, 2, 0.3)
    assert round(two["score"], 5) == 0.03226
    assert [r["text_rank"] for r in rows if r["text_rank"]] == [2, 1, 2, 4]


def test_any_and_all(table):
    s = searcher(table, text_match="all")
    assert {r["id"] for r in s.search("notice written").collect()} == {6}


def test_filters_and_exclusions(table):
    s = searcher(table)
    assert all(r["id"] % 2 == 0 for r in s.search("renewal", [1.0, 0.0], filters={"tenant_id": 0}).collect())
    assert s.search("renewal", [1.0, 0.0], filters={"tenant_id": []}).count() == 0
    assert s.search("renewal", [1.0, 0.0], filters={"tenant_id": None}).count() == 0
    kept = s.search("notice -renewal", [1.0, 0.0], limit=9).collect()
    assert len(kept) == 9 and not {2, 7, 8} & {r["id"] for r in kept}
    assert all(r["text_rank"] is None for r in s.search("-renewal", [1.0, 0.0]).collect())
    with pytest.raises(ValueError):
        s.search("x", filters={"content": 1})


def test_stop_words_only(table):
    rows = searcher(table).search("the of", [1.0, 0.0]).collect()
    assert rows and all(r["text_rank"] is None for r in rows)
    assert searcher(table).search("the of").count() == 0


def test_pages_tile(table):
    s = searcher(table)
    whole = [r["id"] for r in s.search("renewal notice", [1.0, 0.0], limit=12, candidate_limit=12).collect()]
    parts = [r["id"] for o in (0, 4, 8) for r in s.search("renewal notice", [1.0, 0.0], limit=4, offset=o, candidate_limit=12).collect()]
    assert whole == parts
    with pytest.raises(ValueError, match="candidate_limit of 16"):
        s.search("renewal", [1.0, 0.0], limit=4, offset=12, candidate_limit=12)


def test_recency(table):
    rows = searcher(table, recency=Recency("ts", 30)).search("renewal", [1.0, 0.0], as_of=AS_OF, limit=12).collect()
    factor = {r["id"]: r["recency_factor"] for r in rows}
    assert factor[2] == pytest.approx(0.5) and factor[1] == 1.0


def test_metrics_and_weights(table):
    for metric in ("cosine", "l2", "inner_product", "l1"):
        assert searcher(table, metric=metric).search(None, [1.0, 0.0]).first()["id"] == 1
    assert searcher(table, weights=Weights(0, 1)).search("renewal", [1.0, 0.0]).first()["id"] == 7
    assert searcher(table, weights=Weights(1, 0)).search("renewal", [1.0, 0.0]).first()["id"] == 1


def test_highlight_escapes(spark):
    rows = spark.createDataFrame([(1, "<b>renewal</b> & more", [1.0, 0.0])], "id long, content string, embedding array<float>")
    s = HybridSearch(rows, SearchConfig(text_column="content", vector_column="embedding"))
    assert s.search("renewal", highlight=True).first()["highlight"] == "&lt;b&gt;<mark>renewal</mark>&lt;/b&gt; &amp; more"


def test_explain_finds(table):
    s = searcher(table)
    assert explain(s, "renewal", [1.0, 0.0], find="Invoices").verdict.startswith("returned")
    assert "-term" in explain(s, "notice -invoices", [1.0, 0.0], find="Invoices").verdict
    assert "filters" in explain(s, "notice", [1.0, 0.0], filters={"tenant_id": 1}, find="Invoices").verdict
    assert "no row" in explain(s, "notice", [1.0, 0.0], find="nowhere to be found").verdict
    assert "candidates" in explain(s, "notice", [1.0, 0.0]).to_text()


def test_highlight_takes_no_words_from_entities():
    assert T.highlight("<b>cats</b> lt & more", {"lt", "amp"}, "simple") == "&lt;b&gt;cats&lt;/b&gt; <mark>lt</mark> &amp; more"


def test_all_reads_the_whole_text():
    tree = lambda text, parser="websearch": T.build_tree(T.parse_query(text), text, language="simple", parser=parser, match="all")
    assert tree("cat or dog") == ("or", (("lex", "cat"), ("lex", "dog")))
    assert tree('cat "a dog" -bird') == ("and", (("lex", "cat"), ("phrase", (("a", 0), ("dog", 1))), ("not", ("lex", "bird"))))
    assert tree('"big cat" dog', "plain") == ("and", (("lex", "big"), ("lex", "cat"), ("lex", "dog")))


def test_negated_and_or_are_exclusions():
    assert T.parse_query("cat -or -and and") == T.ParsedQuery(("cat",), ("or", "and"))


def test_parse_query():
    parsed = T.parse_query('renewal "notice period" -pricing Renewal or AND "or"')
    assert parsed.positive == ("renewal", "notice period") and parsed.negative == ("pricing",)


def test_cover_density():
    tree = ("and", (("lex", "a"), ("lex", "b")))
    assert T.cover_density("a x b".split(), tree) == pytest.approx(0.05)
    assert T.cover_density("a a a".split(), ("lex", "a")) == pytest.approx(0.3)
    assert T.cover_density("a x".split(), tree) == 0


def test_stems():
    assert [stem(w) for w in ("running", "relational", "connection", "agreed", "notices", "renewal", "dying", "sky")] == ["run", "relat", "connect", "agre", "notic", "renew", "die", "sky"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Weights(-1, 1), lambda: Weights(0, 0), lambda: Recency("ts", 0), lambda: SearchConfig("score", "v"), lambda: SearchConfig("t", "v", metric="x"), lambda: SearchConfig("t", "v", fusion="x"),
        lambda: SearchConfig("t", "v", k=-1), lambda: SearchConfig("t", "v", candidate_limit=0), lambda: checked([1.0, float("nan")]), lambda: checked([]), lambda: checked(["a"]),
    ],
)
def test_refusals(make):
    with pytest.raises(ValueError):
        make()


def test_search_refusals(table):
    s = searcher(table)
    for how in ({}, {"text": "-x"}, {"text": "or"}, {"text": "a", "limit": 0}, {"text": "a", "offset": -1}):
        with pytest.raises(ValueError):
            s.search(**how)
    with pytest.raises(IdentifierError):
        check_name("a.b.c")


def test_plan_and_lists(table):
    config = suggest_config(table)
    assert (config.text_column, config.vector_column, config.id_column, config.filter_columns) == ("content", "embedding", "id", ("tenant_id",))
    assert build_plan(table, config, 20_000)[1].required
    assert (ivf_lists(500), ivf_lists(20_000), ivf_lists(4_000_000), ivf_probes(200)) == (1, 20, 2000, 14)
