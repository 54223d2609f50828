import numpy as np

from braid.llm.common import components


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    name = lambda i: int(i * 2654435761 % 2**32)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + int(a), 200 + int(b)) for a, b in rng.integers(0, 60, (50, 2)) if a != b]
    edges += [(b, a) for a, b in edges[:20]] + edges[:5]
    group = {i: i for e in edges for i in e}
    for a, b in edges:
        old, new = group[a], group[b]
        group = {i: new if g == old else g for i, g in group.items()}
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, 2**40), name(i))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a long, b long")
    assert {r["node"]: r["component"] for r in components(df, df).collect()} == {name(i): least[g] for i, g in group.items()}
    assert components(df.limit(0), df).count() == 0
