import numpy as np

from braid.llm import minhash


def test_near_copies_with_a_null_doc_id_are_linked(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    base, other, alone = say(120), say(120), say(120)
    rows = [(7, base), (None, base + " edited"), (None, other), (None, other + " edited"), (None, other), (None, alone), (None, None), (3, alone + " x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(7, 7, True), (None, 7, False), *[(None, None, True)] * 3, (None, 3, False), (None, None, True), (3, 3, True)]
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)
