"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``width`` words keeps the least hash of its k-word grams, so two equal
windows keep the same hash: any span of ``width`` shared words is found. Neighbouring
windows mostly keep the same one, so a document has a fingerprint for each run of
windows with one hash. Fingerprints of documents and benchmark are joined; only
documents with a hit are read again, where each hit is extended to the windows of its
run, and these are compared word for word. Overlapping hits merge into spans. Items of
fewer words than ``width`` are windows of their own length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import gathered, materialize

#: A word is a run of characters other than ASCII ones that are neither letter nor digit.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
GRAM = 3
#: Benchmark fingerprints (16 bytes each) and the hits of documents are broadcast up to this size each; beyond, both are
#: joined by shuffling, a fingerprint in ``SALT`` parts.
BROADCAST_BYTES, SALT = 32 << 20, 8


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. One pass lower-cases and blanks what isn't in a word; one splits."""
    text = F.trim(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _BETWEEN, string.ascii_lowercase + " " * len(_BETWEEN)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " +"))


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _least_with(step: int):
    return lambda x, i: F.least(x, F.get("_m", i + step))


def _one_window(size: int):
    return lambda i: F.struct(i.alias("at"), (i + 1).alias("until"), F.lit(size).alias("size"), F.xxhash64(*[F.get("words", i + j) for j in range(size)]).alias("h"))


def fingerprints(df: DataFrame, width: int, short: list[int]) -> DataFrame:
    """Adds ``prints``: (at, until, size, h), windows of ``size`` words that start in [at, until) and keep hash h.

    ``df`` has ``words``. Windows of fewer words, of the sizes in ``short``, are a run each.
    """
    gram = min(GRAM, width)
    df = df.withColumn("_m", F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, gram)])))
    span, have = width - gram + 1, 1
    while have < span:  # least of a window, doubling
        step = min(have, span - have)
        df = df.withColumn("_n", F.transform("_m", _least_with(step))).drop("_m").withColumnRenamed("_n", "_m")
        have += step
    df = df.withColumn("_starts", F.filter(_steps(F.size("words") - (width - 1)), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1))))
    end = F.size("words") - (width - 1)
    runs = F.transform("_starts", lambda i, j: F.struct(i.alias("at"), F.coalesce(F.get("_starts", j + 1), end).alias("until"), F.lit(width).alias("size"), F.get("_m", i).alias("h")))
    more = [F.transform(_steps(F.size("words") - (s - 1)), _one_window(s)) for s in short]
    return df.withColumn("prints", F.concat(runs, *more) if more else runs).drop("_m", "_starts")


def _said(words: Column | str, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def _windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """size, h, said, list: each distinct window with a hash of the set of items that have it; and the sizes below ``width``."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = sorted(r[0] for r in item.where(F.size("words") < width).select(F.size("words")).distinct().collect())  # width - 1 at most
    # outer, as Spark would else add a filter that evaluates the arrays once more, nested
    own = fingerprints(item, width, short).select("item", "words", F.explode_outer("prints").alias("p")).where((F.col("p.size") == width) | (F.col("p.size") == F.size("words")))
    each = F.transform(F.sequence(F.col("p.at"), F.col("p.until") - 1), lambda i: _said("words", i, F.col("p.size")))
    return own.select("item", "p.size", "p.h", F.explode_outer(each).alias("said")), short


def _merged(hits: Column) -> Column:
    """Spans [start, end) of words that the hits (i, size) cover, merged where they touch."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(spans, hit):
        last = F.element_at(spans, -1)
        new = F.struct(hit["i"].alias("start"), (hit["i"] + hit["size"]).alias("end"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= hit["i"]), F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(joined))).otherwise(F.concat(spans, F.array(new)))

    return F.aggregate(F.array_sort(hits), start, add)


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated for every row of ``docs``.

    ``spans`` are runs of words [start, end) inside occurrences of a window of any
    item, ``items`` the item_ids (as sorted strings) with such windows. A null or
    empty text has no words; an item without words has no window; a null item_id
    marks words but isn't listed; equal item_ids count once. Repeated rows are
    answered one by one, further columns are ignored, and an empty benchmark leaves
    all documents clean.
    """

    def kept(df: DataFrame, label: str, source: DataFrame = docs) -> DataFrame:
        return materialize(gathered(df, source), label)

    held, short = _windows(benchmark, width)
    held = held.groupBy("size", "h", "said").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("list", F.xxhash64(F.concat_ws("\0", "items"), F.size("items")))
    held = kept(held, "benchmark-windows", benchmark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", _key())
    read = fingerprints(base.withColumn("row", F.monotonically_increasing_id()).select("row", "key", "doc_id", words(F.col("text")).alias("words")), width, short)
    # rows are narrow from here on: no array of a document goes through the explode
    every = read.select("row", "key", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer("prints").alias("place", "p"))
    every = every.select("row", "key", "doc_id", "n_words", "place", "p", F.col("p.size").alias("size"), F.col("p.h").alias("h"))
    known = held.select("size", "h").distinct().withColumn("known", F.lit(True))
    if 16 * known.count() <= broadcast_bytes:
        met = every.join(F.broadcast(known), ["size", "h"], "left")
    else:
        # a passage that many documents share is one hash: it is met in several parts
        known = known.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
        met = every.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(known, ["size", "h", "part"], "left")
    hits = F.collect_list(F.when(F.col("known"), F.struct("p.at", "p.until", "p.size")))
    rows = met.where("known or place is null or place = 0").groupBy("row", "key", "doc_id", "n_words").agg(hits.alias("hits")).drop("row")
    rows = kept(rows, "fingerprint-hits")
    # documents with a hit once more, for their words
    wanted = rows.where(F.size("hits") > 0).dropDuplicates(["key"]).select("key", "hits")
    if (wanted.agg(F.sum(F.lit(32) + 16 * F.size("hits"))).first()[0] or 0) <= broadcast_bytes:
        wanted = F.broadcast(wanted)  # no text is shuffled
    def each(said: Column) -> Column:
        return F.flatten(F.transform("hits", lambda p: F.transform(F.sequence(p["at"], p["until"] - 1), lambda i: F.struct(i.alias("i"), p["size"].alias("size"), _said(said, i, p["size"]).alias("said")))))

    # an array of one binds the words, which would else be taken from the text again for each window
    again = base.join(wanted, "key").select("key", F.flatten(F.transform(F.array(words(F.col("text"))), each)).alias("each"))
    sure = again.select("key", F.explode_outer("each").alias("w")).select("key", "w.*").join(held.select("size", "said", "list"), ["size", "said"]).select("key", "i", "size", "list")
    sure = kept(sure, "sure-hits")
    lists = held.select("list", "items").dropDuplicates(["list"])
    items = sure.select("key", "list").distinct().join(lists, "list").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = sure.groupBy("key").agg(F.collect_set(F.struct("i", "size")).alias("sure")).join(items, "key")
    none = F.array().cast("array<string>")
    spans = _merged(F.coalesce("sure", F.array().cast("array<struct<i:int,size:int>>")))
    out = gathered(rows.select("key", "doc_id", "n_words").join(found, "key", "left"), docs)
    out = out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.sort_array(F.coalesce("items", none)).alias("items"))
    return out.select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"),
    )
