import numpy as np
import pytest

from braid.llm import minhash


@pytest.mark.parametrize("k", [512, 96])
def test_a_set_inside_its_sketch_links_with_a_set_beyond(spark, k):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n + 4))  # noqa: E731  n shingles
    rows = [(2, words("a", k + 10)), (1, words("a", k - 10)), (4, words("b", k + 1)), (3, words("b", -(-75 * (k + 1) // 100))), (6, words("c", k + 1)), (5, words("c", 75 * (k + 1) // 100 - 1))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_a_group_of_near_copies_leaves_few_pairs_beside_its_leaders(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]

    def edited(n):
        x = list(base)
        for i in rng.choice(len(x), n, replace=False):
            x[i] = f"e{rng.integers(10**9)}"
        return " ".join(x)

    texts = [edited(int(n)) for n in rng.integers(0, 12, 300)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    pairs, write = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, label: (lambda out: (label == "pairs" and pairs.append(out.count())) or out)(write(df, label)))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(group))
    assert len(pairs) == 2 and pairs[1] <= len(texts) // 4, pairs


def test_a_pair_of_many_open_lists_is_taken_once(spark):
    # (v, node, place): x and y share lists 2 and 3, x and z list 3; x is alone in list 1
    at = [(1, "x", 0), (1, "p", 0), (2, "x", 1), (2, "y", 0), (2, "p", 1), (3, "x", 2), (3, "y", 1), (3, "z", 0), (3, "p", 2)]
    component = {"x": "x", "y": "y", "z": "z", "p": "p"}
    rows = spark.createDataFrame([(v, node.encode(), 100, place, component[node].encode(), b"p", 1) for v, node, place in at], "v long, node binary, n int, place int, c binary, main binary, blocks int")
    met = minhash._other_pairs(rows, 512, 0.75)
    got = sorted((bytes(r["a"]).decode(), bytes(r["b"]).decode()) for r in met.collect())
    assert got == [("p", "x"), ("p", "y"), ("p", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
