"""Packing: sum-of-squares online packing of tokenised documents into windows of fixed size.

Each task packs the documents of its own partition, so no row is shuffled. A document's full windows stand alone; its
remainder is an item. An item goes where the sum over fill levels of (open windows at that level) squared becomes
smallest, with a fresh window as one choice; the counts by level are one array. When the partition ends, the windows
still open are joined end to end and cut anew, and what is left of the last is cut into powers of two, which need no
padding.

Null texts count as empty: such a document has the closing id alone. Repeated rows are packed each for itself. An empty
table gives no rows. Columns other than ``doc_id`` and ``text`` are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajspark.llm.textbuf import chunks
from trajspark.llm.tokens import word_ids

WINDOW = 2048
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, padding int"
)


class SquaresPacker:
    """Level array and open windows of one stream of items. ``out`` gets (piece, sequence, offset); a piece is
    (doc, start, ids, tokens of the document)."""

    def __init__(self, window: int, out: Callable[[tuple, int, int], None]):
        self.window, self.out = window, out
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.sequences = 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.out(piece, self.sequences, at)
            at += len(piece[2])
        self.sequences += 1

    def place(self, size: int) -> int:
        """The fill level (0: a fresh window) to which an item of ``size`` goes."""
        n, top = self.level, self.window - size
        used = np.flatnonzero(n[: top + 1])
        if not len(used):
            return 0
        # change of the sum of squares: level h loses a window, level h + size gains one unless that is full
        change = 2 * (n[used + size] - n[used]) + 2
        if used[-1] == top:
            change[-1] = 1 - 2 * n[top]
        best = len(used) - 1 - int(np.argmin(change[::-1]))
        return int(used[best]) if change[best] <= 2 * n[size] + 1 else 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, full, self.window):
            self.close([(doc, start, ids[start : start + self.window], total)])
        if full == total:
            return
        size = total - full
        at = self.place(size)
        pieces = []
        if at:
            pieces = self.open[at].pop()
            self.level[at] -= 1
        pieces.append((doc, full, ids[full:].copy(), total))
        if at + size == self.window:
            self.close(pieces)
        else:
            self.open.setdefault(at + size, []).append(pieces)
            self.level[at + size] += 1

    def finish(self) -> None:
        left = [piece for at in sorted(self.open) for pieces in self.open[at] for piece in pieces]
        rest = sum(len(p[2]) for p in left)
        sizes = [self.window] * (rest // self.window) + [1 << k for k in range(self.window.bit_length())[::-1] if (rest % self.window) >> k & 1]
        queue = iter(left)
        doc, start, ids, total = next(queue, (None, 0, (), 0))
        for size in sizes:
            pieces, room = [], size
            while room:
                if not len(ids):
                    doc, start, ids, total = next(queue)
                pieces.append((doc, start, ids[:room], total))
                start, ids, room = start + len(pieces[-1][2]), ids[room:], room - len(pieces[-1][2])
            self.close(pieces)


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first_sequence = TaskContext.get().partitionId() << 40
    store = word_ids(path)
    rows: list[tuple] = []

    def out(piece: tuple, sequence: int, at: int) -> None:
        doc, start, ids, total = piece
        rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, first_sequence + sequence, at))

    def batch() -> pa.RecordBatch:
        columns = [*map(list, zip(*rows))] if rows else [[]] * 7
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in columns] + [pa.array([0] * len(columns[0]), pa.int32())],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"],
        )

    packer = SquaresPacker(window, out)
    for b in batches:
        docs = b.column(0).to_pylist()
        for first, last, data, offsets in chunks(b.column(1)):
            flat, bounds = store.ids(data, offsets)
            for i in range(last - first):
                ids = np.empty(bounds[i + 1] - bounds[i] + 1, np.uint32)
                ids[:-1], ids[-1] = flat[bounds[i] : bounds[i + 1]], end_id
                packer.add(docs[first + i], ids)
            if len(rows) > 50_000:
                yield batch()
    packer.finish()
    yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: each with its place in a sequence and the CRC of its ids. ``padding`` is 0 throughout,
    as every sequence is full or a power of two long."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        lambda batches: _pack(batches, tokenizer, window, end_id), SCHEMA
    )
