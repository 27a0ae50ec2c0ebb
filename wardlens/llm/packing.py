"""Packing token sequences: bounded-space best fit per partition, leftovers merged.

Every partition keeps at most ``open_windows`` windows of ``window`` ids.  A document goes to the open window
with the least room that still holds it; if none does, a new window opens, and when all are open the fullest is
filled to its end with the document's first ids and emitted.  What remains open at the end of a partition is
merged in groups of partitions, level by level; the last partial window is cut at powers of two, so that no
sequence needs padding.

Defined cases: null text is an empty one (only the end id); null or repeated doc_ids are packed like others;
a text longer than a window fills whole windows first; empty input gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import chunks, column, stored
from wardlens.llm.tok import encoder

#: Bytes of text that a task encodes at a time (the arrays for it take about fifteen times as much).
ENCODED_CHARS = 2_000_000

WINDOW = 4096
OPEN_WINDOWS = 64
#: Groups merged by one task: partitions at the first level, partial windows after it.
FAN_IN = 16
FAN_IN_PARTIAL = 1024

DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "level int, grp long, ids binary")
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("level", pa.int32()),
                     ("grp", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Windows of one task; closed pieces gather in ``out`` as rows of the schema above."""

    def __init__(self, level: int, group: int, window: int, open_windows: int):
        self.level, self.group, self.window, self.limit = level, group, window, open_windows
        self.sequences, self.out = 0, []
        self.rooms: list[tuple[int, int]] = []          # (room, key) of the open windows, ascending
        self.pieces: dict[int, list[tuple]] = {}        # key -> pieces (doc_id, start, ids, doc_tokens)
        self.opened = 0

    def close(self, pieces: list[tuple]) -> None:
        sequence = (self.level << 58) | (self.group << 26) | self.sequences
        self.sequences += 1
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, self.level, self.group, None))
            offset += len(ids)

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.close([(doc, start, ids[:self.window], total)])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            i = bisect_left(self.rooms, (len(ids), -1))
            if i < len(self.rooms):
                room, key = self.rooms.pop(i)
                put, left = ids, room - len(ids)
            elif len(self.rooms) < self.limit:
                key, self.opened = self.opened, self.opened + 1
                self.pieces[key] = []
                put, left = ids, self.window - len(ids)
            else:
                left, key = self.rooms.pop(0)
                put, left = ids[:left], 0
            self.pieces[key].append((doc, start, put, total))
            start, ids = start + len(put), ids[len(put):]
            if left:
                insort(self.rooms, (left, key))
            else:
                self.close(self.pieces.pop(key))

    def leave(self, level: int, group: int) -> None:
        """What is still open becomes input of ``level``, the fullest windows first."""
        for _, key in self.rooms:
            for doc, start, ids, total in self.pieces[key]:
                self.out.append((doc, start, len(ids), None, total, None, None, level, group, ids.tobytes()))

    def finish(self) -> None:
        """Close what is open without padding: sequences at powers of two."""
        for _, key in self.rooms:
            have = sum(len(p[2]) for p in self.pieces[key])
            pieces = self.pieces[key]
            while have:
                size = 1 << (have.bit_length() - 1)
                pieces, rest = cut(pieces, size)
                self.close(pieces)
                pieces, have = rest, have - size

    def take(self) -> pa.RecordBatch:
        got, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), _PIECES)] if got
                                          else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)


def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The pieces of the first ``size`` ids and those of the rest."""
    head, at = [], 0
    for k, (doc, start, ids, total) in enumerate(pieces):
        if at + len(ids) >= size:
            n = size - at
            rest = [(doc, start + n, ids[n:], total)] if n < len(ids) else []
            return [*head, (doc, start, ids[:n], total)], rest + pieces[k + 1:]
        head.append((doc, start, ids, total))
        at += len(ids)
    return head, []


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents."""
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        packer = Packer(0, task, window, open_windows)
        for part in chunks(batches, chars=ENCODED_CHARS):
            ids, counts = enc.encode(column(part, "text"))
            ends = np.cumsum(counts)
            for doc, end, n in zip(column(part, "doc_id").to_pylist(), ends.tolist(), counts.tolist()):
                packer.add(doc, 0, np.append(ids[end - n:end], np.uint32(end_id)).astype("<u4"), n + 1)
            yield packer.take()
        packer.leave(1, task // FAN_IN)
        yield packer.take()

    def merge(level: int, final: bool):
        def merged(group: pa.Table) -> pa.Table:
            packer = None
            for batch in group.to_batches():
                for r in batch.to_pylist():
                    if packer is None:
                        packer = Packer(level, r["grp"], window, 1)
                    packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            packer.finish() if final else packer.leave(level + 1, packer.group // FAN_IN_PARTIAL)
            return pa.Table.from_batches([packer.take()])
        return merged

    level, state = 1, stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, DDL), "packed")
    done = []
    while True:
        done.append(state.where(F.col("sequence_id").isNotNull()))
        open_ = state.where(F.col("sequence_id").isNull())
        top = open_.agg(F.max("grp")).first()[0]
        if top is None:
            break
        state = stored(open_.groupBy("grp").applyInArrow(merge(level, top == 0), DDL), f"packed-{level}")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
