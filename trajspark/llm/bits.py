"""Tables of bits by hash, to be broadcast: which longs a set may have. Sized by the set, up to a fixed bound; a bit that is set
for another value only lets a row through that a later step drops.

A value may set several bits, and is let through if all of them are set: of a table of 6 to 12 bits a value, other values
pass in some 15 to 8 % with one bit for each value, in 6 to 1 % with three."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajspark.llm.textbuf import BASE, mix

#: Bits of a table at most: 128 MB.
MOST = 1 << 30
PARTS = 256
#: Bits of a value where each that is let through in vain costs much.
SEVERAL = 3
#: Tasks that set the bits of a table, at most.
TASKS = 32
#: Bits of a table, 16 MB, up to which its parts come to the driver in one job; those of a larger one come partition by
#: partition, a job each.
ONCE = 1 << 27


def size_for(n: int, each: int) -> int:
    """Bits for n values: ``each`` to twice as many for each, MOST at most."""
    return min(MOST, max(1 << 16, 1 << (each * n).bit_length()))


def spot(x: np.ndarray, bits: int, nth: int = 0) -> np.ndarray:
    """The nth place of each value in a table of ``bits``."""
    with np.errstate(over="ignore"):
        h = mix(x.view(np.uint64) + BASE * np.uint64(nth))
        return (h >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)


def at(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (table[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)


def on(table: np.ndarray | tuple[np.ndarray, int], x: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set; ``table``: as ``bit_table`` gives it."""
    table, several = table if isinstance(table, tuple) else (table, 1)
    x, bits = np.ascontiguousarray(x), len(table) * 8
    found = at(table, spot(x, bits))
    for nth in range(1, several):
        left = np.flatnonzero(found)
        found[left] = at(table, spot(x[left], bits, nth))
    return found


def _marked(batches: Iterator[pa.RecordBatch], bits: int, several: int) -> Iterator[pa.RecordBatch]:
    """Places in a table of ``bits``, by the part of the table that they lie in."""
    held, width = [], bits // PARTS

    def rows() -> pa.RecordBatch:
        spots = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
        held.clear()
        cut = np.searchsorted(spots, np.arange(PARTS + 1) * width)
        some = np.flatnonzero(np.diff(cut))
        raw = [(spots[cut[k] : cut[k + 1]] - k * width).astype(np.uint32).tobytes() for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw, pa.binary())], ["part", "spots"])

    for b in batches:
        held.extend(spot(b.column(0).to_numpy(), bits, nth) for nth in range(several))
        if sum(map(len, held)) > 500_000:
            yield rows()
    yield rows()


def _set(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    last, table = None, np.zeros(width, bool)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    for b in batches:
        for part, raw in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and part != last:
                yield row()
                table[:] = False
            last = part
            table[np.frombuffer(raw, np.uint32)] = True
    if last is not None:
        yield row()


def bit_table(values: DataFrame, each: int = 6, several: int = 1) -> np.ndarray | tuple[np.ndarray, int]:
    """Bits of the longs in the only column of ``values``, made part by part in tasks; with how many each value has, if
    ``several``."""
    bits = size_for(values.count(), each)
    partitions = min(TASKS, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = values.mapInArrow(lambda b: _marked(b, bits, several), "part int, spots binary").repartition(partitions, "part").sortWithinPartitions("part")
    table = gathered(marked.mapInArrow(lambda b: _set(b, bits // PARTS), "part int, bits binary"), bits)[0]
    return table if several == 1 else (table, several)


def gathered(parts: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """The whole table of (part, bits), and a list of each further column's values, which may be few only."""
    table, more = np.zeros(bits >> 3, np.uint8), [[] for _ in parts.columns[2:]]
    for part, raw, *rest in parts.collect() if bits <= ONCE else parts.toLocalIterator():
        table[part * len(raw) : (part + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
        for held, x in zip(more, rest):
            held.append(x)
    return table, *more
