"""An inverted-file vector index: rows partitioned by the nearest of k-means centres, as Parquet."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.functions.vector import distance, literal
from braid.operators.nearest import SLICE_BYTES, nearest

#: Rows that k-means is fitted on, at most about.
FIT_ROWS = 100_000


def ivf_lists(rows: int) -> int:
    return max(rows // 1000, 1) if rows <= 1_000_000 else int(math.sqrt(rows))


def ivf_probes(lists: int) -> int:
    return max(int(math.sqrt(lists)), 1)


def build_ivf(table: DataFrame, path: str, id_column: str, vector_column: str, metric: str = "cosine", lists: int | None = None, seed: int = 7) -> "IvfIndex":
    """Fits centres on a bounded sample, then writes every row with a vector under its list."""
    spark = table.sparkSession
    rows = table.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.transform(vector_column, lambda x: x.cast("double")).alias("v"))
    n = rows.count()
    lists = lists or ivf_lists(n)
    sample = np.array([r[0] for r in rows.sample(min(1.0, FIT_ROWS / max(1, n)), seed).select("v").limit(2 * FIT_ROWS).collect()])
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12) if metric == "cosine" else sample
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(15):
        near = ((unit**2).sum(1)[:, None] - 2 * unit @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = unit[near == j].mean(0)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x
                near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    kind = table.schema[id_column].dataType.simpleString()
    rows.mapInArrow(assign, f"id {kind}, v array<double>, list int").repartition("list").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(i, [float(x) for x in c], metric, n) for i, c in enumerate(centres)], "list int, centre array<double>, metric string, rows long").coalesce(1).write.parquet(f"{path}/centres")
    return IvfIndex(spark, path)


class IvfIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # one row for each list
        self.centres, self.metric, self.size = np.array([r["centre"] for r in held]), held[0]["metric"], held[0]["rows"]

    def search(self, vector, k: int, probes: int | None = None) -> DataFrame:
        """id, distance of the k nearest in the probed lists."""
        near = self.probe(vector, probes).select("id", distance("v", literal(vector), self.metric).alias("distance"))
        return near.orderBy("distance", "id").limit(k)

    @property
    def probes(self) -> int:
        return ivf_probes(len(self.centres))

    def probe(self, vector, probes: int | None = None) -> DataFrame:
        """The rows in the lists with the nearest centres; the filter on ``list`` prunes partitions."""
        q = np.array(vector, float)
        unit = q / max(np.linalg.norm(q), 1e-12) if self.metric == "cosine" else q
        order = ((self.centres - unit) ** 2).sum(1).argsort(kind="stable")[: probes or self.probes]
        return self.rows.where(F.col("list").isin([int(i) for i in order]))

    def probed(self, queries: np.ndarray, count: int) -> np.ndarray:
        """Boolean matrix (queries x lists): the ``count`` lists with the nearest centres of each query."""
        unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12) if self.metric == "cosine" else queries
        near = np.stack([((self.centres - q) ** 2).sum(1).argsort(kind="stable")[:count] for q in unit])
        out = np.zeros((len(queries), len(self.centres)), bool)
        np.put_along_axis(out, near, True, 1)
        return out

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, slice_bytes: int = SLICE_BYTES, kept: DataFrame | None = None) -> DataFrame:
        """query_id, id, distance, rank of many queries (query_id, vector): one pass over the index for each slice, in which a list's rows meet the queries that probe it. Only rows whose id is in ``kept``, if given."""
        count = probes or self.probes
        rows = self.rows.select("id", F.col("v").alias("vector"), "list")
        if kept is not None:
            rows = rows.join(kept.select("id"), "id", "left_semi")
        return nearest(rows, queries, k, self.metric, slice_bytes, lambda q: self.probed(q, count)).select("query_id", "id", "distance", "rank")
