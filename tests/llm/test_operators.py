import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.llm import decontaminate, html_extract, html_pages, langid, line_dedup, minhash, mtree, packing, quality, sharding, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, v long"


def texts() -> list[tuple]:
    """Copies, edited copies, shared passages, repeated lines, nulls, empties, ties, repeated rows and a long text."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = say(120), say(25)
    out = [None, "", "   \n ", "one two", "One TWO", base, base, base.upper()]
    for _ in range(12):
        w = base.split()
        w[int(rng.integers(len(w)))] = "edited"
        out.append(" ".join(w))
    out += [say(30) + "\n" + passage + "\n" + say(9) + "\n" + passage for _ in range(10)]
    out += [f"first line {i}\nshared line one\nshared line two\nlast {i}" for i in range(6)]
    out += [say(4000), "é" * 80, "x é" * 30 + base[:90]]
    rows = [(i, t) for i, t in enumerate(out)] + [(5, base), (None, say(20)), (None, base)]
    return [(i, t, "en", "s", 0, "n", "r", 1) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none):
    rows = [(r[0], r[1]) for r in texts()]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group)), key=repr)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(none).count() == 0


def test_suffix_dedup(docs, none):
    rows = [(r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()) for r in texts()]
    first: dict[bytes, int] = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        want.append((d, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.suffix_dedup(docs, with_text=True).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, *r[1:5]) for r in got) == sorted(want)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_blind_trie_orders():
    rng = np.random.default_rng(1)
    strings = list({bytes(rng.integers(97, 100, 9).astype(np.uint8)) for _ in range(200)})
    trie = suffix_dedup.BlindTrie()
    for s in strings:
        trie.insert(s)
    assert [strings[i] for i in trie.ordered()] == sorted(strings)


def test_suffix_classes_are_those_of_the_bytes(monkeypatch):
    rng = np.random.default_rng(2)
    heads = [bytes(rng.integers(97, 99, 34).astype(np.uint8)) for _ in range(4)]
    whole = [heads[rng.integers(4)] + bytes(rng.integers(97, 99, 16).astype(np.uint8) if rng.integers(2) else b"the same tail 16") for _ in range(400)]
    text, starts = np.frombuffer(b"".join(whole), np.uint8), np.arange(400) * 50
    want = sorted(tuple(i for i in range(400) if whole[i] == s) for s in set(whole) if whole.count(s) > 1)
    for mixing in (suffix_dedup.mix, lambda x: x * np.uint64(0)):  # the second makes all hashes collide
        monkeypatch.setattr(suffix_dedup, "mix", mixing)
        order, group = suffix_dedup.suffix_classes(text, starts, 50)
        assert (np.diff(group) >= 0).all()
        found = sorted(tuple(sorted(int(i) for i in order[group == g])) for g in set(group))
        assert [x for x in found if len(x) > 1] == want
        shown = [whole[i] for i in order]
        assert shown == sorted(shown)


def test_minimizers_do_not_depend_on_the_part():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 3000).astype(np.uint8)
    found = []
    for before in (0, 70, 200_000):
        data = np.concatenate((rng.integers(97, 123, before).astype(np.uint8), shared))
        first, count, h, same = suffix_dedup.minimizer_runs(data, np.array([0, before, before + 3000]), 50)
        here = first >= before
        found.append((first[here] - before, count[here], h[here], same[here]))
    assert all((x == y).all() for f in found[1:] for x, y in zip(found[0], f))


def test_decontaminate(spark, docs, none):
    passage = texts()[20][1].split("\n")[1]
    items = [(1, passage), (2, "one TWO"), (3, None), (4, ""), (5, "nowhere to be found in any of these texts at all"), (1, passage), (None, "last 3")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    want = []
    for r in texts():
        w, hit, found = words(r[1]), set(), set()
        for window, who in windows.items():
            for j in range(len(w) - len(window) + 1):
                if tuple(w[j : j + len(window)]) == window:
                    hit |= set(range(j, j + len(window)))
                    found |= who
        want.append((r[0], len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    for limit in (10**6, 0):  # broadcast, and shuffled
        got = decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(want, key=repr)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_line_dedup(spark, docs, none):
    rows = [(1, "a\nb\nc"), (2, "x\n a \n\nb\ny"), (3, "a\nb"), (4, "q\nq\nq"), (5, None), (6, ""), (3, "a\nb")]
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a\nb\nc", 3, 0, 0), (2, "x\n\ny", 4, 2, 1), (3, "", 2, 2, 1), (4, "q", 3, 2, 1), (5, None, 0, 0, 0), (6, "", 0, 0, 0)}
    assert line_dedup.line_dedup(docs).count() == docs.count() and line_dedup.line_dedup(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, [1.0] * 8).collect()
    assert len(rows) == docs.count() and all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sum(r["size"] for r in rows) == sum(len((t[1] or "").encode()) + 1 for t in texts())
    heavy = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert sharding.shard(heavy, [3.0, 1.0]).where("shard = 0").count() == pytest.approx(3000, abs=150)
    assert sharding.shard(none, [1.0]).count() == 0


def test_packing_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, limit=256, segments=8, with_ids=True).collect()
    by_sequence: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in pieces)
        assert len(pieces) <= 8 and total <= 256 and total & (total - 1) == 0
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces[:-1]]).tolist()
    want = sorted(tuple(tokenizer.encode(t[1] or "", add_special_tokens=False).ids + [1]) for t in texts() if t[0] is not None and t[0] > 7)
    parts: dict = {}
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] > 7:
            parts.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert sorted(tuple(x for _, ids in sorted(p) for x in ids) for p in parts.values()) == want
    assert packing.pack_documents(none, path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(700)] + [(1000 + i, [0.5] * 6, "copy") for i in range(300)]
    rows += [(5000, None, ""), (5020, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (5040, [float("nan")] * 6, ""), (5060, [], "")]
    v = mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"))
    got = {tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0"), 20).collect()}
    ints = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows[:1000]}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0


def test_html():
    w, t = html_extract.model()
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A  title</h1><p>Some text &amp; more,\n of it.<p><b>Bold<br>end.</article><div class=comments><p>Nice!</div><footer>&copy; x"
    assert html_extract.main_text(page, w, t) == "A title\nSome text & more, of it.\nBold end."
    assert html_extract.main_text(None, w, t) == html_extract.main_text("", w, t) == html_extract.main_text("<p><div class=", w, t) == ""
    wrong = total = 0
    for page in html_pages.labelled_pages(40, seed=91):
        nodes = html_extract.parse(page)
        for node, p in zip(nodes, html_extract.marginals(nodes, w, t)):
            if node.tag == "text":
                wrong, total = wrong + ((p >= 0.5) != bool(node.label)), total + 1
    assert wrong < 0.02 * total


def test_langid(spark, docs, none):
    model = langid.train(spark.createDataFrame([(i, t, g) for i in range(20) for t, g in ((f"the cat and the dog number {i}", "en"), (f"die Katze und der Hund Nummer {i}", "de"), (f"le chat et le chien numéro {i}", "fr"))], "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog and the cat"), (2, "der Hund und die Katze"), (3, None), (4, "123 !"), (5, "le chien et le chat")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "fr"}
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}
    code = langid.codewords(9)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 5


def test_quality(spark, docs, none):
    rng = np.random.default_rng(4)
    good = [(i, " ".join(rng.choice(WORDS, 60)) + ".") for i in range(150)]
    bad = [(1000 + i, " ".join([str(rng.choice(WORDS)) + "!!"] * 40).upper()) for i in range(150)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 3] + [(2, None, 0)], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in quality.quality_scores(rows, labels).collect()}
    assert all((score[i] >= 0.7) == (i < 1000) for i in score if not i % 3)
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(docs, labels).collect())
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
