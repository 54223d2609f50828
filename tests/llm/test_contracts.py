"""Operators against brute force on the cases that tables seldom have."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.llm import html_extract, langid, line_dedup, minhash, mtree, packing, sharding


def brute_top(rows, k=20):
    out = set()
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("size", [100, 10**9])  # inner products below and over 2**53
def test_top_k_of_many_trees_and_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(mtree, "TREE", 60)
    monkeypatch.setattr(mtree, "CHUNK", 7)
    monkeypatch.setattr(mtree, "BOUND_SAMPLE", 40)
    rng = np.random.default_rng(8)
    rows = [(i, [int(x) for x in rng.integers(-size, size, 4)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(1000 + i, [size, i]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    assert {tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0")).collect()} == brute_top(rows)


def test_top_k_answers_beyond_a_long(spark):
    v = mtree.integer_vectors(spark.createDataFrame([(0, [1e18, 1e18]), (1, [1e18, 1e18]), (2, [-1e18, -1e18]), (3, [3e38, 1.0])], "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in mtree.top_k(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert [r[3] for r in got] == [2**63 - 1, 2**63 - 1, -(2**63)] and {r[2] for r in got} == {1, 2, 3}


def test_langid_und(spark):
    model = langid.train(spark.createDataFrame([(1, "the cat", "en"), (1, "the cat", "en"), (2, "die Katze", "de")], "doc_id long, text string, lang string"))
    rows = [(1, "½ ² 12"), (2, "٣ ४"), (3, ""), (4, None), (5, "Ⅷ"), (6, "猫"), (7, "the " * 300_000), (7, "the " * 300_000)]
    got = [(r["doc_id"], r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert sorted(got) == [(1, True, True), (2, True, True), (3, True, True), (4, True, True), (5, True, True), (6, False, True), (7, False, True), (7, False, True)]


def test_packing_ids_are_those_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, "x <|endoftext|> y"), (2, "<|endoftext|><|endoftext|>"), (3, None), (4, "a　b \n\n 12's " * 50), (None, "null id"), (5, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, with_ids=True).collect()
    for doc_id, text in rows:
        pieces = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == doc_id)
        assert [x for _, ids in pieces for x in ids] == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_keeps_the_loss_limit(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "word " * (5 + i % 20), (i * 7) % 12 if i % 5 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss long")
    got = packing.pack_documents(docs, path, limit=128, segments=6, loss_limit=30, cut=False, loss_column="loss").collect()
    loss, used = {i: min(n, len((t + "").split()) + 2) if n is not None else None for i, t, n in rows}, {}
    for r in got:
        part = used.setdefault(r["sequence_id"], [0, 0, 0])
        part[0], part[1] = part[0] + r["length"], part[1] + 1
        part[2] += loss[r["doc_id"]] if loss[r["doc_id"]] is not None else r["length"]
    assert len(got) == 200 and all(a <= 128 and b <= 6 and c <= 30 for a, b, c in used.values())


def test_html_keeps_what_is_no_script():
    n = html_extract.parse("<article><p>a <noscript>b</noscript> <math>c</math><svg><text>d</text></svg></p><script>var x = '<p>no</p>';</script><p>e<style>f</p><p>g</article>")
    assert [x.text for x in n if x.tag == "text"] == ["a b cd", "e", "g"]
    assert len(html_extract.parse("<div>" + "<span>" * 50_000 + "x" + "</b>" * 50_000)) == 3


def brute_lines(rows, run=2):
    """(doc_id, text, n_lines, n_removed, n_runs) with windows told apart as text."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    lines = [[(j, x.strip(line_dedup.BLANK)) for j, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANK)] for _, t in rows]
    seen, out = set(), []
    for i in order:
        gone = set()
        for p in range(len(lines[i]) - run + 1):
            w = tuple(x for _, x in lines[i][p : p + run])
            if w in seen:
                gone |= set(range(p, p + run))
            seen.add(w)
        cut = {lines[i][p][0] for p in gone}
        text = rows[i][1] if not gone else "\n".join(x for j, x in enumerate(rows[i][1].split("\n")) if j not in cut)
        out.append((rows[i][0], text, len(lines[i]), len(gone), sum(p - 1 not in gone for p in gone)))
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup_equals_brute_force_and_keeps_columns(spark, run):
    rng = np.random.default_rng(run)
    rows = [(i, "\n".join(str(x) if x < 9 else "" for x in rng.integers(0, 10, rng.integers(0, 25)))) for i in range(120)] + [(200, None), (201, "")]
    names = ["row", "lines", "at", "late", "gone", "numbers", "_d", "h", "all", "n_lines"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    out = line_dedup.line_dedup(docs, run)
    assert out.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed", "n_runs"]
    got = out.collect()
    assert all(r[n] == n for r in got for n in names[:-1])
    assert sorted(tuple(r[c] for c in ("doc_id", "text", "n_lines", "n_removed", "n_runs")) for r in got) == sorted(brute_lines(rows, run))


def test_sharding_equals_brute_force(spark):
    rows = [(i, "x" * (i % 7)) for i in range(300)] + [(None, None), (None, "é"), (5, "again"), (5, "again")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), [1.0, 2.0, 1.0]).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in by_key.values())
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


@pytest.mark.parametrize("k", [512, 96])  # sets inside their sketches, and beyond
def test_near_duplicates_equal_brute_force_in_large_groups(spark, k):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 5000, 260)

    def edited(n):
        x = base.copy()
        x[rng.choice(len(x), n, replace=False)] = rng.integers(5000, 9000, n)
        return " ".join(f"w{y}" for y in x)

    rows = [(i, edited(int(rng.integers(0, 18)))) for i in range(70)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, passage + " " + " ".join(f"q{y}" for y in rng.integers(0, 4000, 25))) for i in range(40)]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {r[0]: least[g] for r, g in zip(rows, group)}
    assert len(set(group)) > 20 and max(map(group.count, group)) > minhash.LEADERS
