"""Packing by best-fit decreasing over a segment tree of remaining capacities.

A document is its token ids and a closing id.  Documents longer than a window
are first cut into full windows; the rest of each document is packed, longest
first, into the open window with the least sufficient room, which a segment
tree indexed by remaining capacity finds in log(window) steps.

Pieces are packed in groups of about GROUP pieces dealt by a hash, so memory is
bounded and groups run in parallel; a group of thousands of pieces loses well
under one percent to padding.  Only lengths and checksums are shuffled, no ids.
Equal pieces are told apart by their count within an input partition, so rows
that repeat often spread over the groups.

Defined results
  empty table          no rows
  very long text       whole: full windows and a rest
  null or empty text   the closing id alone
  null doc_id          a document like any other
  ties                 equal lengths go in the order of (doc_id, checksum)
  repeated rows        each is packed
  extra columns        ignored
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_coder
from .common import binary_column, chunks, materialise

WINDOW, CLOSE, GROUP = 4096, 2, 8192
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, close: int = CLOSE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth): full windows and the rest of every document.

    nth counts equal pieces within an input partition.
    """

    def run(batches):
        coder = shared_coder(vocabulary)
        times: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = binary_column(batch, "text")
            rows = []
            for a, some in chunks(texts, 1_000_000):
                for doc, got in zip(ids[a:], coder.encode(some)):
                    full = np.append(got, np.uint32(close)).astype("<u4")
                    for s in range(0, full.size, window):
                        piece = full[s : s + window]
                        crc = zlib.crc32(piece.tobytes())
                        same = hash((doc, s, crc))
                        times[same] = nth = times.get(same, -1) + 1
                        rows.append((doc, s, piece.size, crc, full.size, nth))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*PIECE, "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*PIECE, "nth"]))


class Rooms:
    """Open windows by remaining room, in a segment tree over 0..window."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of ``need`` or more: (room, id)."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i //= 2
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window id, offset) of each piece; lengths must not increase."""
    rooms, out, opened = Rooms(window), [], 0
    for n in lengths:
        got = rooms.take(n)
        if got is None:
            room, where = window, opened
            opened += 1
        else:
            room, where = got
        out.append((where, window - room))
        if room > n:
            rooms.put(room - n, where)
    return out


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``pieces`` (as token_pieces gives them, without nth) plus sequence_id and offset.

    A sequence's id is its group's number times 2^32 plus its number there.
    """
    pieces = materialise(pieces)
    groups = max(1, -(-pieces.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit(table.column("length").to_pylist(), window)
        base = table.column("grp")[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns(["grp"])

    dealt = pieces.select(*PIECE, F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", "nth"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(run, ", ".join(f"{c} long" for c in [*PIECE, "sequence_id", "offset"]))


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, close: int = CLOSE) -> DataFrame:
    return pack(token_pieces(docs, vocabulary, window, close), window)
