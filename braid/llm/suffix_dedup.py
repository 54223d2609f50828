"""Repeated byte strings across documents, by sorted suffixes.

Every ``length``-byte window holds a minimizer: its least GRAM-byte gram by hash,
the last of equals. Equal windows have equal minimizers at the same place, so only
windows whose minimizer occurs in a second document can repeat. Those windows travel
as short runs to the bucket of their minimizer, where their suffixes are sorted
deep-shallow: multikey quicksort takes 8-byte characters to a shallow depth, then a
blind trie orders each group that still shares its whole prefix. Its leaves hold
suffixes whose bytes are equal to the full depth; all but those of its smallest
doc_id are removed.

The texts are written once, packed in compressed blocks, and what is found returns
to a block by its number. A block sends each minimizer and each equal run once, so
a string that a third of all documents hold adds one entry for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import blocks, bucket_of, census, joined_classes, materialize, mix, one_by_one, prefix_hash, span_hash, string_buffers

GRAM = 20
#: Words of 8 bytes that the multikey quicksort compares; beyond, the blind trie does.
SHALLOW_WORDS = 4
#: Bytes of text in a block, for each bucket of minimizers, for each bucket of suffixes; suffixes that are sorted at once.
BLOCK_BYTES, CENSUS_BYTES, BUCKET_BYTES, SORT_AT_ONCE = 4 << 20, 8 << 20, 1 << 20, 100_000
#: Bytes whose windows are hashed at once.
PART_BYTES = 1 << 18
#: Bits of a place beside a gram's hash: the same everywhere, so that equal windows choose alike in parts of any size.
PLACE_BITS = 32
_LAST = np.iinfo(np.int64).max


def pack(docs: DataFrame) -> DataFrame:
    """block, ids, known (1 where doc_id isn't null), sizes, z: documents in compressed blocks."""

    def run(batches):
        from pyspark import TaskContext

        closer, block = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            ids, known = batch.column(0).fill_null(_LAST).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets, BLOCK_BYTES):
                text = raw[offsets[a] : offsets[b]].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "ids": [ids[a:b].tobytes()], "known": [known[a:b].tobytes()], "sizes": [np.diff(offsets[a : b + 1]).tobytes()], "n": [len(text)], "z": [closer.compress(text)]}
                )
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, ids binary, known binary, sizes binary, n long, z binary")


def _minimizers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a few documents: see ``minimizer_runs``."""
    starts = [np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:]) if b - a >= length]
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    sums, grams = prefix_hash(data), len(data) - GRAM + 1
    at = np.arange(grams)
    h = span_hash(sums, at, at + GRAM) >> np.uint64(1)
    bits = np.uint64(PLACE_BITS)
    # the hash's high bits, then the place, later ones first: one minimum gives both
    key = (h >> bits << bits) | (np.uint64(grams) - at.astype(np.uint64))
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    windows = np.concatenate(starts)
    place = grams - (key[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    head = np.flatnonzero(new)
    count, first = np.diff(np.append(head, len(windows))), windows[head]
    return first, count, h[place[head]].astype(np.int64), span_hash(sums, first, first + count + length - 1)


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows, each in one document, with one minimizer: their start, number, gram's 63-bit hash, and the hash of all their text."""
    found = []
    for a, b in blocks(offsets, PART_BYTES):
        base = int(offsets[a])
        first, *rest = _minimizers(data[base : int(offsets[b])], offsets[a : b + 1] - base, length)
        found.append((first + base, *rest))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _open(row: dict, opener) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    data = np.frombuffer(opener.decompress(row["z"], max_output_size=row["n"]) if row["n"] else b"", np.uint8)
    return data, np.concatenate(([0], np.cumsum(sizes))), np.frombuffer(row["ids"], np.int64)


def _fingerprints(length: int):
    """A block's distinct minimizers, and the number of its documents that have each."""

    def of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        data, offsets, _ = _open(row, zstandard.ZstdDecompressor())
        at, _, h, _ = minimizer_runs(data, offsets, length)
        doc = np.searchsorted(offsets, at, side="right")
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return np.unique(h[first], return_counts=True)

    return of


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each c, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(length: int, buckets: int):
    """Each block's runs of windows with one shared minimizer, by the minimizer's bucket."""

    def run(batches):
        opener, closer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(3)
        for batch in batches:
            for row in one_by_one(batch):
                data, offsets, ids = _open(row, opener)
                at, count, h, same = minimizer_runs(data, offsets, length)
                shared = joined_classes(row["found"])[np.searchsorted(np.unique(h), h)] > 0 if len(h) else np.zeros(0, bool)
                at, count, h, same = at[shared], count[shared], h[shared], same[shared]
                doc = ids[np.searchsorted(offsets, at, side="right") - 1]
                # equal runs in the block: those of a larger doc_id are removed here
                order = np.lexsort((doc, same))
                lead = np.ones(len(order), bool)
                lead[1:] = same[order][1:] != same[order][:-1]
                least = doc[order][lead][np.cumsum(lead) - 1] if len(order) else doc
                late = np.zeros(len(order), bool)
                late[order] = doc[order] > least
                b = bucket_of(h, buckets)
                by = np.lexsort((at, b))
                out: dict[str, list] = {c: [] for c in ("bucket", "block", "at", "count", "doc", "text", "gone_at", "gone_count")}
                for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1) if len(by) else ():
                    keep, gone = part[~late[part]], part[late[part]]
                    size = count[keep] + length - 1
                    values = int(b[part[0]]), row["block"], at[keep].astype(np.int32), count[keep].astype(np.int32), doc[keep], closer.compress(data[np.repeat(at[keep], size) + _ramps(size)].tobytes()), at[gone].astype(np.int32), count[gone].astype(np.int32)
                    for column, x in zip(out.values(), values):
                        column.append(x.tobytes() if isinstance(x, np.ndarray) else x)
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], names=list(out))

    return run


class BlindTrie:
    """Orders strings of one length: inner nodes keep only the place where their branches part."""

    def __init__(self) -> None:
        self.root: list | int | None = None
        self.strings: list[bytes] = []

    def insert(self, s: bytes) -> int:
        """Goes down without comparing, meets some leaf, compares once, and parts the path there; the number of the leaf that holds ``s``."""
        number = len(self.strings)
        self.strings.append(s)
        if self.root is None:
            self.root = number
            return number
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        other = self.strings[node]
        depth = next((i for i, (x, y) in enumerate(zip(s, other)) if x != y), None)
        if depth is None:
            return node
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = number
            return number
        made = [depth, {other[depth]: node, s[depth]: number}]
        if above is None:
            self.root = made
        else:
            above[1][s[above[0]]] = made
        return number

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            elif node is not None:
                out.append(node)
        return out


def suffix_classes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at ``starts`` to ``length`` bytes: their order, and the class of equals of each place in it.

    A suffix that no other equals so far is settled and leaves the sort; it gets no place.
    """
    words, tail = min(SHALLOW_WORDS, length // 8), length - 8 * min(SHALLOW_WORDS, length // 8)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for w in range(words):
        char = np.ascontiguousarray(eight[starts[order] + 8 * w]).view(">u8").ravel().astype(np.uint64)
        by = np.argsort(char) if w == 0 else np.lexsort((char, group))
        order, group, char = order[by], group[by], char[by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (char[1:] != char[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        order, group = order[many], group[many]
    if not len(order) or not tail:
        return order, group
    tails = [np.ascontiguousarray(eight[starts[order] + at]).view(np.uint64).ravel() for at in (*range(length - tail, length - 8, 8), length - 8)]
    new = np.diff(group, prepend=-1) != 0
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    mixed = np.zeros(int(group.max()) + 1, bool)
    mixed[group[np.any([t != t[leader] for t in tails], axis=0)]] = True
    rank = np.zeros(len(order), np.int64)
    odd = np.flatnonzero(mixed[group])
    if len(odd):
        # a hash brings equals together, bytes decide whether they are
        rest = np.zeros(len(odd), np.uint64)
        with np.errstate(over="ignore"):
            for t in tails:
                rest = mix(rest + t[odd])
        to = np.lexsort((rest, group[odd]))
        by, rest = odd[to], rest[to]
        first = np.ones(len(by), bool)
        first[1:] = (group[by][1:] != group[by][:-1]) | (rest[1:] != rest[:-1])
        while True:
            heads, which = by[first], np.cumsum(first) - 1
            unlike = np.any([t[by] != t[heads][which] for t in tails], axis=0)
            if not unlike.any():
                break
            first |= unlike
        ranks = np.zeros(len(heads), np.int64)
        for part in np.split(np.arange(len(heads)), np.flatnonzero(np.diff(group[heads])) + 1):
            trie = BlindTrie()
            leaves = []
            for i in part:
                s = int(starts[order[heads[i]]]) + length - tail
                leaves.append(trie.insert(text[s : s + tail].tobytes()))
            place = {leaf: r for r, leaf in enumerate(trie.ordered())}
            ranks[part] = [place[leaf] for leaf in leaves]
        rank[by] = ranks[which]
    by = np.lexsort((rank, group))
    order, group, rank = order[by], group[by], rank[by]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (rank[1:] != rank[:-1])
    return order, np.cumsum(new) - 1


def _sorted(length: int):
    """Of one bucket: the windows that also start in a smaller doc_id, as runs in each block."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        blob = {c: table.column(c).to_pylist() for c in ("at", "count", "doc", "text", "gone_at", "gone_count")}
        opener = zstandard.ZstdDecompressor()
        blob["text"] = [opener.decompress(x) for x in blob["text"]]
        whole = {c: np.frombuffer(b"".join(blob[c]), t) for c, t in (("at", np.int32), ("count", np.int32), ("doc", np.int64), ("text", np.uint8), ("gone_at", np.int32), ("gone_count", np.int32))}
        count = whole["count"].astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        ramp = _ramps(count).astype(np.int32)
        owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
        # equal suffixes share their first bytes, so they can be sorted part by part
        parts = max(1, len(owner) // SORT_AT_ONCE)
        four = sum(whole["text"][begin[owner] + ramp + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4)) if parts > 1 else np.zeros(len(owner), np.uint32)
        with np.errstate(over="ignore"):
            part = ((four * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(parts)
        found = [np.zeros(0, np.int64)]
        for i in range(parts):
            here = np.flatnonzero(part == i)
            order, group = suffix_classes(whole["text"], begin[owner[here]] + ramp[here], length)
            doc = whole["doc"][owner[here[order]]]
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            least = np.minimum.reduceat(doc, heads)[group] if len(doc) else doc
            found.append(here[order[doc > least]])
        late = np.sort(np.concatenate(found))
        from_block = np.repeat(block, [len(x) // 4 for x in blob["at"]])
        gone_block = np.repeat(block, [len(x) // 4 for x in blob["gone_at"]])
        # runs of windows that follow each other
        new = np.ones(len(late), bool)
        new[1:] = (late[1:] != late[:-1] + 1) | (owner[late][1:] != owner[late][:-1])
        head = late[new]
        runs = np.diff(np.append(np.flatnonzero(new), len(late)))
        b = np.concatenate((from_block[owner[head]], gone_block))
        at = np.concatenate((whole["at"][owner[head]] + ramp[head], whole["gone_at"])).astype(np.int32)
        n = np.concatenate((runs, whole["gone_count"])).astype(np.int32)
        by = np.lexsort((at, b))
        parts = [g for g in np.split(by, np.flatnonzero(np.diff(b[by])) + 1) if len(g)]
        return pa.table(
            {"block": pa.array([int(b[g[0]]) for g in parts], pa.int64()), "at": pa.array([at[g].tobytes() for g in parts], pa.binary()), "count": pa.array([n[g].tobytes() for g in parts], pa.binary())}
        )

    return run


def _cut(length: int, with_text: bool):
    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in one_by_one(batch):
                data, offsets, ids = _open(row, opener)
                found = row["runs"] or ()
                at = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x["at"], np.int32) for x in found)]).astype(np.int64)
                n = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x["count"], np.int32) for x in found)]).astype(np.int64)
                step = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + n + length - 1, minlength=len(data) + 1)
                gone = np.cumsum(step[: len(data)]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(data)]
                edge[inner] = gone[inner]
                removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
                kept = [data[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                known = np.frombuffer(row["known"], bool)
                out = {
                    "doc_id": pa.array(ids, pa.int64(), mask=~known), "n_bytes": np.diff(offsets), "n_removed": np.diff(removed[offsets]), "n_spans": np.diff(spans[offsets]),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                if with_text:
                    out["kept_text"] = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_text`` if asked for).

    Removes each byte covered by a ``length``-byte string of the document that also
    starts in a document of smaller doc_id; strings are taken from the input as it is
    and never cross documents. Null and empty texts have no bytes. Repeated rows of one
    doc_id don't remove each other, a null doc_id counts as the largest, and an empty
    table gives no rows. ``kept_text`` replaces characters cut in two by U+FFFD.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    packed = materialize(pack(docs), "text-blocks")
    total = packed.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(total // BUCKET_BYTES))
    found = census(packed.select("block", "ids", "sizes", "n", "z"), _fingerprints(length), max(8, int(total // CENSUS_BYTES)))
    runs = packed.select("block", "ids", "sizes", "n", "z").join(found, "block").mapInArrow(
        _runs(length, buckets), "bucket int, block long, at binary, count binary, doc binary, text binary, gone_at binary, gone_count binary"
    )
    late = runs.groupBy("bucket").applyInArrow(_sorted(length), "block long, at binary, count binary")
    by_block = late.groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return packed.join(by_block, "block", "left").mapInArrow(_cut(length, with_text), schema)
