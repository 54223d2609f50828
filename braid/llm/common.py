"""Shared pieces: written tables in the cluster's shared folder, and byte-level
numpy helpers that work on Arrow string columns without creating Python strings.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made, but only under a
    local master: on a cluster the driver's own disk is not visible to executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="braid-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


#: Most bytes that Spark sends to a Python worker at once while a table is written.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet under the shared folder; returns it reread, and its path.

    Batches for Python workers are kept small meanwhile: they are held twice, outside
    the JVM's heap and in the worker, by every running task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if usual is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, usual)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


#: Bytes of input for each partition that ``gathered`` leaves at least.
GATHER_BYTES = 16 << 20


def gathered(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, without a shuffle, before it is written: one for each 16 MB of ``source``, two for each core at least.

    Each file that an executor writes costs the local file system a process or two, so
    a small table in many partitions would be mostly that. ``df`` must not number its rows by
    partition. The size is the optimizer's: file sizes, or more where ``source`` has joins.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(int(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, size // GATHER_BYTES), 2**31 - 1)))


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- Arrow strings as bytes -------------------------------------------------

#: Bytes that a block of documents may hold before the next block starts.
BLOCK_BYTES = 2 << 20


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def one_by_one(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges [a, b) of about ``limit`` bytes; a longer document is a block of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_rng = np.random.default_rng(20240601)
#: A random 64-bit value for each byte; base and inverse of the polynomial hash.
_TABLE = _rng.integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        factor = np.full(size, _BASE if kind == "p" else _INVERSE, np.uint64)
        factor[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(factor)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads a polynomial hash over all 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * _power("p", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end); equal spans have equal hashes wherever they are."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power("q", len(sums))[start])


# --- How many blocks of a corpus hold a hash --------------------------------

#: Hashes that one task of ``census`` should hold.
CENSUS_HASHES = 1 << 20


def frequency_class(count: np.ndarray) -> np.ndarray:
    """One byte that grows with a count: 0 for 1, then four steps for each doubling."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash in 0 .. 2**63 - 1; it grows with the hash."""
    return ((hashes >> 31) * buckets >> 32).astype(np.int64)


def census(rows: DataFrame, of, buckets: int) -> DataFrame:
    """Counts hashes over all blocks, shipping packed arrays in place of a row for each hash.

    ``rows`` are blocks with a long column ``block``; ``of`` gives the hashes (int64,
    sorted, distinct inside the block) and counts of a row, a dict. Returns block and
    ``found``: array of (bucket, classes); the classes joined in order of bucket are the
    ``frequency_class`` of every hash of the block. A hash adds one entry for each
    block that holds it, however many rows of the block do.
    """

    def split(batches):
        for batch in batches:
            for row in one_by_one(batch):
                h, c = of(row)
                b = bucket_of(h, buckets)
                # 32 bits tell the hashes of a bucket apart; the rare ones that they don't count as one
                h, c = ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32), np.minimum(c, 255).astype(np.uint8)
                cut = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else np.zeros(0, np.int64)
                ends = [*cut[1:], len(b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b[cut].astype(np.int32)), pa.array(np.full(len(cut), row["block"], np.int64)),
                        pa.array([h[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()), pa.array([c[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes", "counts"],
                )

    def count(table: pa.Table) -> pa.Table:
        blobs = table.column("hashes").to_pylist()
        h = np.frombuffer(b"".join(blobs), np.uint32)
        c = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        _, place = np.unique(h, return_inverse=True)
        classes = frequency_class(np.bincount(place, c))[place].tobytes()
        ends = np.cumsum([len(x) // 4 for x in blobs])
        parts = [classes[e - len(x) // 4 : e] for e, x in zip(ends, blobs)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "classes": pa.array(parts, pa.binary())})

    from pyspark.sql import functions as F

    return (
        rows.mapInArrow(split, "bucket int, block long, hashes binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(count, "block long, bucket int, classes binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "classes")).alias("found"))
    )


def joined_classes(found: list[dict] | None) -> np.ndarray:
    return np.frombuffer(b"".join(x["classes"] for x in sorted(found or (), key=lambda x: x["bucket"])), np.uint8)


# --- Connected components ----------------------------------------------------


def components(edges: DataFrame, source: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round, every node takes the smallest of itself and its neighbours, and the
    edges are contracted: both ends renamed, repeated and closed ones dropped. So a
    dense group is a few edges after one round. Nodes should sort as hashes do; then a
    chain of n nodes, too, loses half of them each round. Tables are written each
    round; whether an edge is left is all that reaches the driver. ``source``: the
    table whose size decides in how many files (see ``gathered``).
    """
    from pyspark.sql import functions as F

    spark = edges.sparkSession

    def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        return write_table(gathered(df, source), label)

    left, left_path = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names, name_path = None, ""
    while True:
        both = left.union(left.select("b", "a"))
        up, up_path = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "up")
        if names is None:
            names, name_path = up.withColumnRenamed("up", "component"), up_path
        else:
            now = names.join(up.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            old, (names, name_path) = name_path, written(now, "components")
            drop_table(spark, old)
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias("up_" + c)) for c in "ab")
        moved = left.join(a, "a").join(b, "b").where("up_a <> up_b")
        less, less_path = written(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        drop_table(spark, left_path)
        if up_path != name_path:
            drop_table(spark, up_path)
        left, left_path = less, less_path
        if left.isEmpty():
            drop_table(spark, left_path)
            return names
