"""Near-duplicate documents by bottom-k sketches.

One hash function gives every document the k smallest hashes of its distinct word
shingles. Inverted lists of the retained values propose pairs, the sketch of the
union filters them, and exact Jaccard similarity over the full sets decides.

Documents with the same set are one node. A node enters only the lists of its rarest
retained values: a pair that is similar enough shares so many values that it must meet
in one of those (prefix filter). A pair met in a list is dropped if the values that
both have left from there on are fewer than such a pair shares (positional filter) or
their sizes are too far apart (length filter).

A list is not turned into all its pairs. Each member first meets the list's leaders,
up to ``LEADERS`` nodes, mostly the same in all lists that hold them: half are those
with the fewest values rarer than the list's, which in a group of copies are nearest to
all others, half are picked by hashes. The links found are contracted to components,
and only members outside a list's largest component then meet the members of other
components. In a large group of copies nearly all members are in the largest component
by then. What remains are members that no leader links and no filter rules out; each of
those is held against its list. A pair that is in many lists is taken in the first of
them only, which the members' earlier lists tell.

Two sketches that hold the whole sets decide a pair exactly; texts are read only of
sets that a set beyond its sketch may link with, and compared only where sketches say
that they may link. With k = 512, ``SIGMAS`` = 5.6
standard deviations of slack keep the chance of missing a pair under 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import (
    CENSUS_HASHES,
    blocks,
    census,
    components,
    drop_table,
    gathered,
    joined_classes,
    materialize,
    mix,
    one_by_one,
    prefix_hash,
    span_hash,
    string_buffers,
    write_table,
)

K, SIGMAS = 512, 5.6
#: Nodes of a list that all its members meet first; shorter lists are all leaders.
LEADERS = 8
#: Rows of a list in one block when members outside its largest component meet all others.
LIST_BLOCK = 256
#: Bytes of text in a block; its packed sketches stay below what the JVM's collector calls large.
BLOCK_BYTES = 1 << 18
#: Bytes of a retained value: the high bits of a 63-bit hash.
VALUE_BYTES = 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits, sorted inside a document) and each document's bounds in them.

    A document of fewer words than ``width`` has one shingle of all of them.
    """
    base, n = int(offsets[0]), len(offsets) - 1
    data, off = _LOWER[raw[base : int(offsets[-1])]], offsets - base
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    h = span_hash(prefix_hash(data), starts, ends)
    lo = np.searchsorted(starts, off[:-1])
    words = np.searchsorted(starts, off[1:]) - lo

    def chain(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), np.uint64)
        with np.errstate(over="ignore"):
            for p in parts:
                out = (out + p) * np.uint64(0xFF51AFD7ED558CCD)
                out ^= out >> np.uint64(31)
        return mix(out) >> np.uint64(1)

    count = np.where(words >= width, words - width + 1, words > 0)
    doc = np.repeat(np.arange(n), count)
    first = np.repeat(lo, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(doc), np.uint64)
    length = np.minimum(words, width)[doc]
    for size in range(1, width + 1):
        at = length == size
        if at.any():
            out[at] = chain([h[first[at] + j] for j in range(size)])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep].astype(np.int64), np.searchsorted(doc[keep], np.arange(n + 1))


def digests(hashes: np.ndarray, bound: np.ndarray) -> list[bytes]:
    """16 bytes for each document's set, the same for equal sets."""
    h = hashes.view(np.uint64)
    out = np.zeros((len(bound) - 1, 2), np.uint64)
    for k, values in enumerate((h, mix(h))):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[:, k] = mix(sums[bound[1:]] - sums[bound[:-1]])
    blob = out.tobytes()
    return [blob[i : i + 16] for i in range(0, len(blob), 16)]


def needed_overlap(n: int, k: int, similarity: float) -> int:
    """Retained values that a set of n shares, all but surely, with any set as similar as asked."""
    exact = math.ceil(similarity * n - 1e-9)
    return max(1, min(exact, math.floor(similarity * k - SIGMAS * math.sqrt(similarity * (1 - similarity) * k))))


def pack_values(h: np.ndarray) -> bytes:
    """The high ``VALUE_BYTES`` bytes of 63-bit hashes."""
    return np.ascontiguousarray(((h >> (63 - 8 * VALUE_BYTES)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :VALUE_BYTES]).tobytes()


def values(blob: bytes) -> np.ndarray:
    """What ``pack_values`` packed, in its order, as int64 of 63 bits."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, VALUE_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :VALUE_BYTES] = raw
    return out.view("<u8").ravel().astype(np.int64) << (63 - 8 * VALUE_BYTES)


def _key() -> Column:
    """A 64-bit hash of doc_id and text, by which a row's text is found again."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def sketches(docs: DataFrame, width: int = 5, k: int = K, row: Column | None = None) -> DataFrame:
    """Blocks of documents: ids, known (1 where doc_id isn't null), marks (``row``, a long, or 0), keys (``_key``), n, nodes (16 bytes of each set), v (all sketches)."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            marks, keys = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b in blocks(offsets, BLOCK_BYTES):
                h, bound = shingle_sets(raw, offsets[a : b + 1], width)
                n = np.diff(bound)
                size = np.minimum(n, k)
                take = np.repeat(bound[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out = {
                    "block": block, "ids": ids[a:b].tobytes(), "known": known[a:b].tobytes(), "marks": marks[a:b].tobytes(), "keys": keys[a:b].tobytes(),
                    "n": n.astype(np.int64).tobytes(), "nodes": b"".join(digests(h, bound)), "v": pack_values(h[take]),
                }
                yield pa.RecordBatch.from_pydict({c: [x] for c, x in out.items()})
                block += 1

    mark = F.lit(0).cast("long") if row is None else row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark"))
    return rows.withColumn("key", _key()).mapInArrow(run, "block long, ids binary, known binary, marks binary, keys binary, n binary, nodes binary, v binary")


def _rows(packed: DataFrame) -> DataFrame:
    """doc_id, row, key, n_shingles, node (null if the set is empty) of every document."""

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                n, nodes = np.frombuffer(row["n"], np.int64), row["nodes"]
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
                marks, keys = (pa.array(np.frombuffer(row[c], np.int64)) for c in ("marks", "keys"))
                named = pa.array([nodes[16 * i : 16 * i + 16] if x else None for i, x in enumerate(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, marks, keys, pa.array(n), named], names=["doc_id", "row", "key", "n_shingles", "node"])

    return packed.select("ids", "known", "marks", "keys", "n", "nodes").mapInArrow(run, "doc_id long, row long, key long, n_shingles long, node binary")


def _entries(packed: DataFrame, k: int, similarity: float) -> DataFrame:
    """(v, node, n, place, sketch): each node's rarest retained values that another document retains too.

    ``place`` is the value's place among the node's, the rarest first; the first entry
    of a node in a block also carries its sketch.
    """

    def distinct(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(values(row["v"]), return_counts=True)

    def prefixes(batches):
        for batch in batches:
            for row in one_by_one(batch):
                v, n = values(row["v"]), np.frombuffer(row["n"], np.int64)
                classes = joined_classes(row["found"])[np.searchsorted(np.unique(v), v)]
                size = np.minimum(n, k)
                begin = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(n)), size)
                order = np.lexsort((v, classes, owner))
                place = np.arange(len(v)) - np.repeat(begin, size)
                room = size - np.array([needed_overlap(int(x), k, similarity) for x in n], np.int64) + 1
                # equal sets of the block once
                names = [row["nodes"][16 * i : 16 * i + 16] for i in range(len(n))]
                once = np.zeros(len(n), bool)
                once[list({x: i for i, x in reversed(list(enumerate(names)))}.values())] = True
                of = owner[order]
                keep = (classes[order] > 0) & (place < room[of]) & once[of]
                of = of[keep]
                first = np.diff(of, prepend=-1) != 0
                blob = [row["v"][VALUE_BYTES * begin[i] : VALUE_BYTES * (begin[i] + size[i])] if f else None for i, f in zip(of.tolist(), first.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[order][keep]), pa.array([names[i] for i in of.tolist()], pa.binary()), pa.array(n[of].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(blob, pa.binary())],
                    names=["v", "node", "n", "place", "sketch"],
                )

    total = packed.agg(F.sum(F.length("v")) / VALUE_BYTES).first()[0] or 0
    found = census(packed.select("block", "v"), distinct, max(8, int(total // CENSUS_HASHES)))
    return packed.select("block", "n", "nodes", "v").join(found, "block").mapInArrow(prefixes, "v long, node binary, n int, place int, sketch binary")


def _fits(k: int, similarity: float) -> Column:
    """Length and positional filter of a pair (n, place and m, there) that meets in a list."""
    n, m, part = F.col("n"), F.col("m"), similarity / (1 + similarity)
    least, most = F.least(n, m), F.greatest(n, m)
    left = F.least(F.least(n, F.lit(k)) - F.col("place"), F.least(m, F.lit(k)) - F.col("there"))
    whole = F.ceil(F.lit(part) * (n + m) - F.lit(1e-9))
    # of the larger set, this share lies in the other; its sketch is a sample of it
    share = F.lit(part) * (F.lit(1.0) + least / most)
    sampled = F.floor(share * k - F.lit(SIGMAS) * F.sqrt(share * (F.lit(1.0) - share) * k))
    return (least >= F.lit(similarity) * most - F.lit(1e-9)) & (left >= F.when(most <= k, whole).otherwise(F.least(whole, sampled)))


def _lists(entries: DataFrame) -> DataFrame:
    """(v, node, n, place, members, leads): lists of two members at least, and whether a node leads its list."""
    one = entries.groupBy("v", "node").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    hashes = [F.xxhash64("node", F.lit(i)) for i in range(LEADERS)]
    # half of them are those with the fewest rarer values, more and more roughly
    bids = [F.struct(F.shiftright("place", 2 * i).alias("p"), x.alias("h")) if 2 * i < LEADERS else x for i, x in enumerate(hashes)]
    best = one.groupBy("v").agg(F.count("*").alias("members"), *[F.min(x).alias(f"h{i}") for i, x in enumerate(bids)]).where("members > 1")
    leads = F.col("members") <= LEADERS
    for i, x in enumerate(bids):
        leads = leads | (x == F.col(f"h{i}"))
    return one.join(best, "v").select("v", "node", "n", "place", "members", leads.alias("leads"))


def _leader_pairs(lists: DataFrame, k: int, similarity: float) -> DataFrame:
    leaders = lists.where("leads").select("v", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("place").alias("there"))
    # two leaders meet twice; one of both is enough
    met = lists.join(leaders, "v").where((F.col("node") < F.col("leader")) | ((F.col("node") > F.col("leader")) & ~F.col("leads"))).where(_fits(k, similarity))
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, node, n, place, c, main, blocks): lists of more than the leaders whose members are in several components so far."""
    named = lists.where(F.col("members") > LEADERS).select("v", "node", "n", "place").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    sizes = named.groupBy("v", "c").agg(F.count("*").alias("size"))
    stats = sizes.groupBy("v").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "c")).getField("c").alias("main")).where("parts > 1")
    return named.join(stats, "v").select("v", "node", "n", "place", "c", "main", F.ceil(F.col("all") / LIST_BLOCK).cast("int").alias("blocks"))


def _other_pairs(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs in open lists that are in different components so far, each once: in the first open list that both are in."""
    own = rows.groupBy("node", "n", "c").agg(F.sort_array(F.collect_list(F.struct("place", "v", "main", "blocks"))).alias("own"))
    each = own.select("node", "n", "c", F.col("own.v").alias("vs"), F.posexplode("own").alias("i", "e"))
    rows = each.select("node", "n", "c", "e.*", F.expr("slice(vs, 1, i)").alias("before"))
    few = rows.where("c <> main").select("v", F.col("node").alias("a"), F.col("n"), "place", F.col("c").alias("ca"), F.col("before").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
    all_ = rows.select("v", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("there"), F.col("c").alias("cb"), (F.col("c") == F.col("main")).alias("in_main"), F.col("before").alias("y"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("at"))
    met = few.join(all_, ["v", "at"]).where((F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _fits(k, similarity) & ~F.arrays_overlap("x", "y"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


NO, YES, ASK = 0, 1, 2


def sketch_says(x: np.ndarray, n: int, y: np.ndarray, m: int, k: int, percent: int) -> int:
    """Of two sorted sketches of sets of n and m: whether the sets link; ``ASK`` if the sketch of the union leaves it open."""
    if 100 * min(n, m) < percent * max(n, m):
        return NO
    both = np.concatenate((x, y))
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    if max(n, m) <= k:
        return YES if 100 * len(twice) >= percent * (n + m - len(twice)) else NO
    union = np.unique(both)[:k]
    shared, size, p = int((twice <= union[-1]).sum()), len(union), percent / 100
    return ASK if shared >= p * size - SIGMAS * math.sqrt(p * (1 - p) * size) else NO


def _sketched(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, says) of pairs that their sketches don't rule out."""

    def run(batches):
        for batch in batches:
            says, last, x = [], None, None
            for a, n, za, m, zb in zip(*(batch.column(c).to_pylist() for c in ("a", "na", "za", "nb", "zb"))):
                if a != last:
                    last, x = a, values(za)
                says.append(sketch_says(x, n, values(zb), m, k, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(says, pa.int32())], names=["a", "b", "says"])

    a, b = (held.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("z" + c)) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "na", "za", "b", "nb", "zb").mapInArrow(run, "a binary, b binary, says int").where(F.col("says") != NO)


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union, by their texts."""

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        known: dict[bytes, np.ndarray] = {}

        def sets(node: bytes, blob: bytes) -> np.ndarray:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                raw = np.frombuffer(opener.decompress(blob), np.uint8)
                known[node] = shingle_sets(raw, np.array([0, len(raw)]), width)[0]
            return known[node]

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b, za, zb = (batch.column(c)[i].as_py() for c in ("a", "b", "za", "zb"))
                both = np.concatenate((sets(a, za), sets(b, zb)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (texts.select(F.col("node").alias(c), F.col("z").alias("z" + c)) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary")


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, z): one compressed text for each wanted (key, node)."""

    def label(batches):
        closer = zstandard.ZstdCompressor(3)
        for batch in batches:
            offsets, raw = string_buffers(batch.column(0))
            for a, b in blocks(offsets, BLOCK_BYTES):
                h, bound = shingle_sets(raw, offsets[a : b + 1], width)
                z = [closer.compress(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(digests(h, bound), pa.binary()), pa.array(z, pa.binary())], names=["node", "z"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", _key())
    rows = rows.join(wanted.select("key"), "key", "left_semi").select("text")
    # the digest computed again tells whose text it is
    return rows.mapInArrow(label, "node binary, z binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, k: int = K, row: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate group of every row.

    Words are runs of bytes other than space and U+0009 to U+000D, with A-Z
    lower-cased; two documents are linked if 100 * |A and B| >= percent * |A or B|
    over their sets of distinct ``width``-word shingles. A text of fewer words has
    one shingle of all of them. ``component_id`` is the smallest doc_id that links
    reach; ``kept`` is true where it is the row's own. Null, empty and blank texts
    have no shingles, link with nothing and are kept. Repeated rows get the same
    answer each; a null doc_id never becomes a component_id while another exists.
    Further columns are ignored; an empty table gives no rows. ``row``, a long
    expression over ``docs``, passes through as a column of that name.
    """
    similarity, spark = percent / 100, docs.sparkSession

    def kept(df: DataFrame, label: str) -> DataFrame:
        return materialize(gathered(df, docs), label)

    packed, first_path = write_table(sketches(docs, width, k, row), "sketches")
    rows = kept(_rows(packed), "rows")
    nodes = kept(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key")), "nodes")
    entries = kept(_entries(packed, k, similarity), "entries")
    drop_table(spark, first_path)
    lists = kept(_lists(entries), "lists")
    listed = lists.groupBy("node").agg(F.min("n").alias("n"))
    held = kept(entries.where("sketch is not null").select("node", "sketch").dropDuplicates(["node"]).join(listed, "node"), "list-sketches")
    # a set beyond its sketch may link with one inside
    least = min(k + 1, -(-percent * (k + 1) // 100))
    texts = kept(_texts(docs, nodes.join(held.where(F.col("n") >= least).select("node"), "node").select("key", "node"), width), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        """Decided by sketches first, then by the texts of what these leave open."""
        said = kept(_sketched(pairs, held, k, percent), "sketched")
        sure = said.where(F.col("says") == YES).select("a", "b")
        return kept(sure.union(_compared(said.where(F.col("says") == ASK), texts, width, percent)), "links")

    first = kept(_leader_pairs(lists, k, similarity), "pairs")
    found = links(first)
    near = components(found, docs)
    open_ = kept(_open_lists(lists, near), "open-lists")
    second = kept(_other_pairs(open_, k, similarity).join(first, ["a", "b"], "left_anti"), "pairs")
    # further links connect components
    more = links(second)
    for end in "ab":
        more = more.join(near.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    far = components(more.where("a <> b").distinct(), docs).select(F.col("node").alias("near"), F.col("component").alias("far"))
    named = nodes.select("node", "doc_id").join(near, "node", "left").withColumn("near", F.coalesce("component", "node")).join(far, "near", "left")
    named = kept(named.select("node", "doc_id", F.coalesce("far", "near").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = named.join(smallest, "component").select("node", "component_id")
    out = gathered(rows.select("doc_id", "row", "n_shingles", "node").join(answer, "node", "left"), docs)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *([] if row is None else ["row"]), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
