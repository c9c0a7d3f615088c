"""Packing of token ids into fixed rows by best-fit decreasing.

Documents are encoded, cut losslessly into pieces of at most ``length`` ids
and placed, longest first, into the open row with the least room that still
fits; a segment tree over the room left finds it in O(log length).  Packing is
done in bounded windows of ids within a task, so there is no shuffle, no
state between tasks and a lost task is simply run again; a window of millions
of ids leaves only its last rows partly filled.

Output, one row for each packed row: ``pack_id``, ``doc_ids`` and
``doc_offsets`` (of each segment: its document and its first id there),
``cu_seqlens`` (0 and the end of every segment), ``position_resets`` (where
positions start again at 0), ``n_tokens`` and ``ids`` (little-endian unsigned
row of the id matrix, padded to ``length``).

Edge cases: null and empty texts have no ids and so no segment; a null
document id is kept as null in ``doc_ids``; repeated rows are packed as often
as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from .bpe import encoder
from .common import text_slices

LENGTH, PAD = 2048, 50256
#: Ids that one window of a task holds.
WINDOW = 1 << 22
SCHEMA = "pack_id long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


class RoomTree:
    """Segment tree over the room left: which rows are open with exactly that much room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._step(room, 1)

    def _step(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room >= need."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and not (i & 1 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._step(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the pieces in each row; every size is in 1..length.  Equal sizes go in input order."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def pack_window(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, first: int) -> pa.RecordBatch:
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in docs for at in range(0, len(ids), length)]
    kind = np.dtype("<u2") if pad < 1 << 16 else np.dtype("<u4")
    out: list[list] = [[] for _ in range(7)]
    for k, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        ends = np.cumsum([len(pieces[i][2]) for i in row])
        line = np.full(length, pad, kind)
        line[: ends[-1]] = np.concatenate([pieces[i][2] for i in row])
        starts = [0, *ends[:-1].tolist()]
        for column, value in zip(out, (first + k, [pieces[i][0] for i in row], [pieces[i][1] for i in row], [*starts, int(ends[-1])], starts, int(ends[-1]), line.tobytes()), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary())
    names = ["pack_id", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pad: int = PAD, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pack every text of ``df``; see the module for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done, held, total = TaskContext.get().partitionId() << 32, 0, [], 0
        enc = encoder(path)

        def flush() -> pa.RecordBatch:
            nonlocal done, held, total
            out = pack_window(held, length, pad, base + done)
            done, held, total = done + out.num_rows, [], 0
            return out

        for batch in batches:
            for part in text_slices(batch, "_text"):
                encoded = enc.encode_many(text or "" for text in part.column(1).to_pylist())
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    if len(ids):
                        held.append((doc, ids))
                        total += len(ids)
                        if total >= window:
                            yield flush()
        if held:
            yield flush()

    return df.select(df[id_col].cast("long").alias("_id"), df[text_col].alias("_text")).mapInArrow(run, SCHEMA)


def position_ids(row: Row) -> np.ndarray:
    """Positions of a packed row, from 0 in every segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(row.cu_seqlens[:-1], row.cu_seqlens[1:], strict=True)])


def write_packed(df: DataFrame, path: str) -> None:
    """Write packed rows through Spark's writer, so that any store it knows will do."""
    df.write.mode("overwrite").parquet(path)
