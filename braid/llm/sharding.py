"""Rendezvous hashing of record keys over weighted shards.

Each shard bids for a key with a hash of both, scaled by its weight; the best bid
wins. A further shard only adds bids, so it takes rows into itself and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braid.llm.common import materialize


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins ``key``; null keys are a key too. Ties go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and there must be one at least")

    def bid(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("bid"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[bid(i, float(w)) for i, w in enumerate(weights)]))["shard"]


def shard(docs: DataFrame, weights: list[float], added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1; ``slot`` numbers the
    rows of a shard from 0 without gaps; ``grown_shard`` is the shard after one more of
    weight ``added``. The doc_id and the weights alone decide, so rows of one doc_id
    share a shard, and equal texts of different doc_ids need not. Slots are numbered inside each
    part of the table written first, and parts are put one after another by their
    counts: no shard's rows meet in one task. Rows equal in all columns may swap slots.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, added]).alias("grown_shard"), F.spark_partition_id().alias("part"),
    )
    rows = materialize(rows, "shards")
    counts = rows.groupBy("shard", "part").count()
    before = counts.select("shard", "part", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("place", place).join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "grown_shard")
