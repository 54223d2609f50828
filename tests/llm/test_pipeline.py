import numpy as np
import pytest

import corpus_pipeline as P

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def say(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n)) + "."


def shout(seed):
    return " ".join([WORDS[seed % len(WORDS)] + "!!"] * 40).upper()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    good, bad = [(i, say(i)) for i in range(150)], [(1000 + i, shout(i)) for i in range(150)]
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, say(900, 25)), (None, say(901, 25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, good, bad


def test_near_dedup_drops_repeated_rows_only(spark):
    a, b, c = say(1), say(2), say(3)
    near = a.replace(".", " more")
    rows = [(1, a), (1, a), (2, near), (3, b), (3, c), (None, say(4)), (None, say(5)), (None, say(5)), (None, None), (4, None), (4, ""), (2, say(6)), (None, a)]
    want = [(1, a), (3, b), (3, c), (None, say(4)), (None, say(5)), (None, None), (4, None), (4, ""), (2, say(6))]
    assert pairs(P.near_dedup(spark, frame(spark, rows), "")) == sorted(want, key=repr)


def test_quality_removes_the_text_and_not_the_doc_id(spark, tables):
    at, good, bad = tables
    extra = [(None, shout(7)), (None, say(700)), (5000, say(701)), (5000, shout(8))]
    assert pairs(P.quality_classifier(spark, frame(spark, good + bad + extra), at)) == sorted(good + [extra[1], extra[2]], key=repr)


def test_decontaminate_removes_the_text_and_not_the_doc_id(spark, tables):
    dirty = say(10) + " " + say(900, 25)
    rows = [(1, say(11)), (1, dirty), (None, dirty), (None, say(12)), (2, None), (3, dirty)]
    assert pairs(P.decontaminate(spark, frame(spark, rows), tables[0])) == sorted([rows[0], rows[3], rows[4]], key=repr)


def test_quality_keeps_all_without_labels(spark, tables, tmp_path):
    at, good, bad = tables
    docs = frame(spark, good[:3] + bad[:3] + [(None, shout(9))])
    labels = spark.read.parquet(f"{at}/labels.parquet")
    for name, some in (("none", labels.limit(0)), ("elsewhere", labels.selectExpr("doc_id + 90000 AS doc_id", "quality", "toxic")), ("null", labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality", "toxic"))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert pairs(P.quality_classifier(spark, docs, f"{tmp_path}/{name}")) == pairs(docs)


def grams(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def lines_once(rows):
    """Deletes pairs of lines that start earlier, in a smaller doc_id or further up; rows left with nothing go."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n") if t else []
        late = {k for j, two in enumerate(zip(lines, lines[1:])) if two in seen for k in (j, j + 1)}
        seen |= set(zip(lines, lines[1:]))
        if not lines or len(late) < len(lines):
            out.append((i, "\n".join(x for j, x in enumerate(lines) if j not in late) if late else t))
    return out


def test_run_equals_brute_force(spark, tables, tmp_path):
    import shutil

    import public_tokenizers
    from tokenizers import Tokenizer

    at, good, bad = tables
    # labelled good texts of each shape that the other rows have
    shapes = [(300 + i, [say(2000 + i) + "\n" + say(3000 + i, 40) + "\n" + say(4000 + i, 40), say(2000 + i) + " " + say(3000 + i, 25), say(2000 + i, 40) + "\n" + say(3000 + i, 40)][i % 3]) for i in range(120)]
    shutil.copytree(f"{at}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    more = spark.createDataFrame([(i, 1, 0) for i, _ in shapes], "doc_id long, quality int, toxic int")
    spark.read.parquet(f"{at}/labels.parquet").union(more).write.parquet(f"{tmp_path}/labels.parquet")
    shared = say(800, 40) + "\n" + say(801, 40)
    rows = good[:40] + bad[:10] + [(None, say(500)), (None, shout(3)), (200, say(0) + " edited"), (201, say(502) + "\n" + shared), (202, say(503) + "\n" + shared), (202, say(504)), (203, shared), (204, say(505) + " " + say(900, 25)), (None, say(506) + " " + say(901, 25))]
    rows += good[40:] + bad[10:] + shapes
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "'x' AS node", "2 AS _row", "3 AS score")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    loud = {t for _, t in bad} | {shout(3)}
    wanted = [lambda rows: [r for r in rows if r[1] not in loud], lines_once, None, None]

    def near(rows):
        group = list(range(len(rows)))
        sets = [grams(t, 5) for _, t in rows]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group = [group[j] if g == group[i] else g for g in group]
        least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
        return list({r: 1 for r, g, s in zip(rows, group, sets) if not s or r[0] == least[g]})

    items = [" ".join(x.strip(".").lower().split()[j : j + 10]) for x in (say(900, 25), say(901, 25)) for j in range(16)]
    wanted[2:] = [near, lambda rows: [r for r in rows if not any(i in (r[1] or "").replace(".", "").lower() for i in items)]]
    now, have = docs, rows
    for (name, stage), brute in zip(P.STAGES, wanted):
        now, have = stage(spark, now, str(tmp_path)).cache(), brute(have)
        assert pairs(now) == sorted(have, key=repr), name
        assert set(now.columns) <= set(P.DOCUMENTS)
    packed = P.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in have)
    assert {r["doc_id"] for r in packed} == {i for i, _ in have}
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
