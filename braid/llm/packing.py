"""Packing of token sequences under several limits at once.

Vector bin packing: a sequence has room for tokens, segments and loss-bearing tokens.
Of the waiting items that fit, the one whose needs point most in the direction of the
room left goes in (dot product of both, each limit as 1). What none fits is filled by
cutting an item; the rest of it goes on waiting.

Each input partition is packed by itself, in one pass and with a bounded number of
waiting items: no shuffle, and no state beyond a partition.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Waiting items below which more are read.
WAITING = 512
SEGMENTS = 256
_tokenizers: dict[str, object] = {}


def byte_bpe(path: str):
    """Encoder text -> uint32 ids for a tokenizers JSON file of byte-level BPE.

    These are the ids of ``tokenizers`` with ``add_special_tokens=False``: the string of
    a special token in a text is that token. Beside ``x.json``, ``x.tiktoken`` has the
    same vocabulary as ranks; it gives the same ids several times as fast and is used
    where it is there, with the special tokens of the JSON file.
    """
    if path not in _tokenizers:
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import tiktoken

            with open(ranks, "rb") as lines:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            #: Fixed value: the published split pattern of this vocabulary.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            with open(path, encoding="utf-8") as whole:
                special = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"] if t.get("special")}
            encoder = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens=special)
            _tokenizers[path] = lambda text: encoder.encode_to_numpy(text, allowed_special="all")
        except (ImportError, FileNotFoundError):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _tokenizers[path] = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    return _tokenizers[path]


class Packer:
    """Takes items one by one, gives pieces: (item, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool = True) -> None:
        self.limits, self.cut, self.sequence = np.array(limits, np.float64), cut, 0
        self.items: list = []
        self.start, self.tokens, self.loss = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, items: list, tokens: list[int], loss: list[int]) -> None:
        self.items += items
        self.start = np.append(self.start, np.zeros(len(items), np.int64))
        self.tokens, self.loss = np.append(self.tokens, tokens), np.append(self.loss, loss)

    def _take(self, i: int, size: int) -> tuple:
        """``size`` tokens of item i; its loss-bearing tokens are spread evenly, as far as is known here."""
        part = int(self.loss[i]) if size == self.tokens[i] else min(size, int(np.ceil(self.loss[i] * size / self.tokens[i])))
        piece = (self.items[i], int(self.start[i]), size)
        self.start[i] += size
        self.tokens[i] -= size
        self.loss[i] -= part
        return piece, part

    def _one(self, last: bool) -> list[tuple]:
        room, pieces = self.limits.copy(), []
        while room[0] > 0 and room[1] > 0:
            here = self.tokens > 0
            fits = here & (self.tokens <= room[0]) & (self.loss <= room[2])
            if fits.any():
                gain = room[0] * self.tokens / self.limits[0] ** 2 + room[1] / self.limits[1] ** 2 + room[2] * self.loss / max(1, self.limits[2]) ** 2
                i = int(np.argmax(np.where(fits, gain, -1)))
                size = int(self.tokens[i])
            else:
                able = here & (self.loss * room[0] <= room[2] * self.tokens) if self.cut else here & (self.tokens > self.limits[0]) & (len(pieces) == 0)
                if not able.any():
                    break
                i = int(np.argmax(np.where(able, self.tokens, -1)))
                size = int(min(self.tokens[i], room[0]))
            piece, loss = self._take(i, size)
            room -= (size, 1, loss)
            pieces.append(piece)
        used = int(self.limits[0] - room[0])
        if self.cut and room[0] > 0 and used:
            # not full: the longest power of two, the rest waits
            over = used - (1 << (used.bit_length() - 1))
            while over:
                item, start, size = pieces.pop()
                back = min(over, size)
                if size > back:
                    pieces.append((item, start, size - back))
                self.items.append(item)
                self.start, self.tokens, self.loss = np.append(self.start, start + size - back), np.append(self.tokens, back), np.append(self.loss, min(back, int(self.limits[2])))
                over -= back
        return pieces

    def pack(self, last: bool):
        while (n := int((self.tokens > 0).sum())) and (last or n >= WAITING):
            offset = 0
            for item, start, size in self._one(last):
                yield item, start, size, self.sequence, offset
                offset += size
            self.sequence += 1
            if len(self.items) > 2 * n + 64:
                self._tidy()
        self._tidy()

    def _tidy(self) -> None:
        alive = np.flatnonzero(self.tokens > 0)
        self.items = [self.items[i] for i in alive]
        self.start, self.tokens, self.loss = self.start[alive], self.tokens[alive], self.loss[alive]


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = 2048, segments: int = SEGMENTS, loss_limit: int | None = None, end_id: int = 1, cut: bool = True, with_ids: bool = False, loss_column: str | None = None
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    A document is its text's ids (none for null or empty) and ``end_id``. A sequence
    has at most ``limit`` tokens, ``segments`` pieces and ``loss_limit`` loss-bearing
    tokens (default: ``limit``); ``loss_column`` holds their number for each row, all
    tokens where it is null or not given. With ``cut`` off only documents over the
    limit are cut. A sequence that cannot be filled is cut back to a power of two, so
    it needs no padding either. Repeated rows are packed each, and an empty table
    gives no rows. ``sequence_id`` is unique, not gapless. Each partition is packed in the
    order of its rows, so another split of the input gives other sequences.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encode, base = byte_bpe(tokenizer), TaskContext.get().partitionId() << 32
        packer = Packer((limit, segments, limit if loss_limit is None else loss_limit), cut)

        def rows(last: bool):
            out: list[list] = [[] for _ in names]
            for (doc_id, ids), start, size, sequence, offset in packer.pack(last):
                part = ids[start : start + size]
                for column, x in zip(out, (doc_id, start, size, zlib.crc32(part.tobytes()), len(ids), base + sequence, offset, part)):
                    column.append(x)
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, loss = [], []
                for text, share in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    x = encode(text).astype("<u4") if text else np.zeros(0, "<u4")
                    ids.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                    loss.append(len(ids[-1]) if share is None else max(0, min(int(share), len(ids[-1]))))
                packer.add(list(zip(part.column(0).to_pylist(), ids)), [len(x) for x in ids], loss)
                yield rows(False)
        yield rows(True)

    share = F.col(loss_column).cast("long") if loss_column else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", share.alias("share")).mapInArrow(run, schema)
