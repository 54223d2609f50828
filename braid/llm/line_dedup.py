"""Repeated runs of lines across documents by winnowing, in DataFrame functions only.

A window of ``run`` consecutive lines keeps its least line hash, the last of equals,
as a fingerprint, so a run of that many shared lines always shares a fingerprint.
Fingerprints that occur at one position only are put aside. Around the others each
window is compared as a whole, which extends a match line by line both ways, and
every window but the first of its kind (by doc_id, then place) is deleted.

What is rare travels, not what is common: an aggregate with map-side partial results
tells, for each hash, its first position and its count, and positions return to their
document. No join is keyed by a hash that a third of all rows may share. Rows that go
through an explode are narrow, and places are matched by set operations on sorted
arrays, so a document of n lines costs about n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import gathered, materialize

BLANK = " \t\r\x0b\x0c"
_NONE = "array<int>"


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(_NONE))


def _split(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hashes() -> Column:
    """Hashes of the text's lines that aren't blank, without white space at their ends."""
    return F.filter(F.transform(_split("text"), lambda x: F.xxhash64(F.btrim(x, F.lit(BLANK)))), lambda h: h != F.xxhash64(F.lit("")))


def _least_places(run: int) -> Column:
    """For each window of ``run`` lines, the place of its least hash, the last of equals."""
    return F.transform(_steps(F.size("h") - (run - 1)), lambda i: -F.array_min(F.array(*[F.struct(F.get("h", i + j).alias("h"), (-i - j).alias("p")) for j in range(run)]))["p"])


def _return(positions: DataFrame, column: str, name: str) -> DataFrame:
    return positions.groupBy("doc_id", "row").agg(F.collect_set(column).alias(name))


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("row").eqNullSafe(F.col("_r"))
    return left.join(right.hint("merge"), on, "left").drop("_d", "_r")


def repeated_windows(docs: DataFrame, run: int) -> DataFrame:
    """doc_id, row (hash of the text), late: the places (among lines that aren't blank) where a repeated window starts."""

    def kept(df: DataFrame, label: str) -> DataFrame:
        return materialize(gathered(df, docs), label)

    none = F.array().cast(_NONE)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), _line_hashes().alias("h"))
    hashed = hashed.withColumn("least", _least_places(run))
    # runs of windows with one least place, as one number: the first window and the one after the last
    changes = F.filter(_steps(F.size("least")), lambda j: (j == 0) | (F.get("least", j) != F.get("least", j - 1)))
    hashed = hashed.withColumn("changes", changes)
    spans = F.transform("changes", lambda j, i: F.shiftleft(j.cast("long"), 31) + F.coalesce(F.get("changes", i + 1), F.size("least")))
    held = kept(hashed.select("doc_id", "row", "h", "least", spans.alias("spans")), "line-hashes").where(F.size("least") > 0)
    # a narrow row for each fingerprint; those at one position only
    prints = held.select("doc_id", "row", F.explode_outer(F.transform("spans", lambda s: F.struct(F.get("h", F.get("least", F.shiftright(s, 31).cast("int"))).alias("f"), s.alias("p")))).alias("x")).select("x.f", F.struct("doc_id", "row", "x.p").alias("where"))
    alone = prints.groupBy("f").agg(F.min("where").alias("first"), F.max("where").alias("last")).where(F.col("first").eqNullSafe(F.col("last"))).select("first.*")
    open_ = _join(held, _return(alone, "p", "alone"))
    shared = F.array_except("spans", F.coalesce("alone", F.array().cast("array<long>")))
    open_ = open_.withColumn("shared", shared).where(F.size("shared") > 0)
    starts = F.flatten(F.transform("shared", lambda s: F.sequence(F.shiftright(s, 31).cast("int"), (s.bitwiseAND(F.lit((1 << 31) - 1)) - 1).cast("int"))))
    open_ = kept(open_.select("doc_id", "row", "h", starts.alias("starts")), "line-windows")
    windows = open_.select("doc_id", "row", F.explode_outer(F.transform("starts", lambda p: F.struct(F.slice("h", p + 1, run).alias("w"), p.alias("p")))).alias("x")).select("x.w", F.struct("doc_id", "row", "x.p").alias("where"))
    first = windows.groupBy("w").agg(F.min("where").alias("first")).select("first.*")
    late = _join(open_.select("doc_id", "row", "starts"), _return(first, "p", "first")).select("doc_id", "row", F.array_except("starts", F.coalesce("first", none)).alias("late"))
    return late.where(F.size("late") > 0).dropDuplicates(["doc_id", "row"])


def line_dedup(docs: DataFrame, run: int = 2) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its repeated runs, and n_lines, n_removed, n_runs.

    Lines end at \\n and are compared without white space at their ends; blank lines
    take no part and stay. A line goes if it lies in ``run`` consecutive lines that
    also start earlier: in a smaller doc_id, or further up in the same document. Rows
    of one doc_id and text are one document, and stay alike; rows of one doc_id and
    different texts are ordered by a hash of the text; a null doc_id comes first.
    A null text stays null and has no lines; n_lines counts lines that aren't blank.
    Other columns pass through, unless they have the names of the added ones.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    # the other columns travel as one, so their names meet no other
    df = docs.select(F.struct(*names).alias("all"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    # merged at every size, so that a small table shows what a large one needs
    df = _join(df, materialize(gathered(repeated_windows(docs, run), docs), "late-lines"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("late", F.array().cast(_NONE)), lambda j: F.sequence(j, j + (run - 1))))))
    df = df.select("all", gone.alias("gone"), _split(F.col("all.text")).alias("lines"))
    df = df.withColumn("at", F.filter(_steps(F.size("lines")), lambda i: F.btrim(F.get("lines", i), F.lit(BLANK)) != ""))
    stay = F.array_except(_steps(F.size("lines")), F.transform("gone", lambda p: F.get("at", p)))
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("all.text"))
    runs = F.size("gone") - F.size(F.array_intersect("gone", F.transform("gone", lambda p: p + 1)))
    out = df.select(
        *[text.alias("text") if c == "text" else F.col("all")[c].alias(c) for c in names],
        F.size("at").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"),
    )
    return gathered(out, docs)
