"""Token-ID output: best-fit-decreasing packing into fixed-width rows (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.tokenizers import Encoder, file_bytes

#: Tokens that a task packs at once.
BUFFER_TOKENS = 2_000_000

PACKED_SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"


class Capacities:
    """Open rows by free space, in a segment tree over the possible sizes 0 to ``width``.

    A leaf counts the rows with just that much room; an inner node, those of its leaves. The search
    for the tightest row with room for ``need`` climbs until a right-hand sibling holds a row and
    descends to its leftmost leaf.
    """

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the (room, row) of least room, at least ``need``."""
        at = need + self.base
        while not self.tree[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.base:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.base
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers: items by falling size, each to the open row where it leaves least room."""
    rows: list[list[int]] = []
    open_rows = Capacities(width)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room, row = open_rows.take(sizes[item]) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(item)
        if room > sizes[item]:
            open_rows.add(room - sizes[item], row)
    return rows


def _matrix(pieces: list[tuple], width: int, dtype: np.dtype, pad: int, first: int) -> pa.RecordBatch:
    """The rows of one buffer of (doc id, start, ids)."""
    columns: list[list] = [[] for _ in range(7)]
    for k, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], width)):
        ids, positions, ends, used = np.full(width, pad, dtype), np.zeros(width, "<u4"), [0], 0
        for item in row:
            tokens = pieces[item][2]
            ids[used : used + len(tokens)] = tokens
            positions[used : used + len(tokens)] = np.arange(len(tokens))
            used += len(tokens)
            ends.append(used)
        values = (first + k, used, ids.tobytes(), positions.astype("<u2" if width <= 1 << 16 else "<u4").tobytes(), ends, [pieces[i][0] for i in row], [pieces[i][1] for i in row])
        for column, value in zip(columns, values):
            column.append(value)
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack_tokens(docs: DataFrame, model_path: str, width: int = 2048, id_col: str | Column = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """Packed rows of token ids, with nothing lost.

    Each text's ids, ended by ``end_id`` (the vocabulary's end token, or the free id behind it, by default), are cut into pieces
    of at most ``width``. Each task packs its pieces in buffers of ``BUFFER_TOKENS`` by best fit
    decreasing, so no text is shuffled and a task's memory has a bound. A row has ``input_ids``
    (``width`` little-endian uint16, or uint32 for a larger vocabulary, filled up with ``end_id``),
    ``position_ids`` that start anew with each segment, ``cu_seqlens`` from 0 to ``n_tokens``, and for
    each segment its document and its place in the document's ids. ``pack_id`` is unique.

    Null and empty texts are one end token; null ids stay null; repeated rows are packed again; texts
    of any length, runs of millions of blanks or letters too, are cut into as many pieces as they
    need; pieces of one length go in the order of the input; an empty table gives no rows; other columns are not read.
    """
    model = file_bytes(model_path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, model)
        end = encoder.end if end_id is None else end_id
        first = TaskContext.get().partitionId() << 32
        buffer, held = [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.array([*encoder.encode([value.as_py() or ""])[0], end])
                for start in range(0, len(ids), width):
                    piece = ids[start : start + width]
                    buffer.append((doc, start, piece))
                    held += len(piece)
                    if held >= BUFFER_TOKENS:
                        yield (out := _matrix(buffer, width, encoder.dtype, end, first))
                        first += out.num_rows
                        buffer, held = [], 0
        if buffer:
            yield _matrix(buffer, width, encoder.dtype, end, first)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack, PACKED_SCHEMA)
