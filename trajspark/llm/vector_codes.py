"""Compression of vectors into codes: each of a vector's parts is replaced by the number of its nearest codebook entry.

Components become integers, floor(4096 x). The parts of all vectors are sorted along a Hilbert curve and cut into flat
blocks, which are written once with the least and greatest value of every component (their box) and their sums. In each
round a block's shortlist is made of the entries that may be nearest to anything in its box: those whose least distance
to the box is not above the smallest of the entries' greatest distances to it. A block with one entry on its shortlist
gives its stored sums to that entry without a look at its vectors; else distances to the shortlist are computed. Only
sums by entry reach the driver. All arithmetic is in whole numbers: 64 bits where squares of differences fit, Python's
integers beyond. Where the curve runs only decides how tight boxes are, so its scale is taken from the first entries.

Left out are vectors that are null, empty, hold null or non-finite components (4096 x included), don't divide into
the parts, or have another length than the smallest kept vec_id's. Rows that repeat a vec_id count one by one, smaller
vectors first; rows without vec_id come last. With fewer rows than entries, codebooks are as small. Errors beyond a long
are given as the largest long. Other columns are left aside. With no kept vector there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.session import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vector parts in a block.
BLOCK = 256
MOST = (1 << 63) - 1
_BLOCKS = "part int, ids binary, raw binary, low binary, high binary, sums binary"
Book = list[list[list[int]]]


def bound(width: int) -> int:
    """Absolute values below which squared distances of ``width`` components fit into 63 bits."""
    return isqrt((1 << 62) // width) // 2


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers below 2**bits along the Hilbert curve (J. Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            inside = x[i] & q != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            place = place << 1 | ((x[i] ^ turn) >> level & 1)
    return place


def curve_places(values: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Places of vector parts along the curve through cells of equal width, three spreads to each side of the centre."""
    width = min(values.shape[1], 63)
    bits = max(1, 63 // width)
    cells = ((values[:, :width] - centre[:width]) / spread[:width] / 6 + 0.5) * (1 << bits)
    return hilbert(np.clip(np.floor(cells), 0, (1 << bits) - 1), bits)


def _parts(batches: Iterator[pa.RecordBatch], width: int, scale: list) -> Iterator[pa.RecordBatch]:
    """(part, place, id, raw) of each part: raw has 32-bit integers, or whole numbers as doubles where these are too few."""
    for b in batches:
        if not b.num_rows:
            continue
        values = np.floor(SCALE * b.column(1).flatten().to_numpy()).reshape(b.num_rows, PARTS, width)
        ids = b.column(0).to_numpy()
        for p in range(PARTS):
            own = np.ascontiguousarray(values[:, p])
            narrow = np.abs(own).max(1) < bound(width)
            small = np.where(narrow[:, None], own, 0).astype("<i4")
            raw = [(small if n else own)[i].tobytes() for i, n in enumerate(narrow.tolist())]
            columns = [pa.array(np.full(len(ids), p, np.int32)), pa.array(curve_places(own, *scale[p])), pa.array(ids), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "place", "id", "raw"])


def _numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    """Rows of whole numbers: int64, or Python's integers where they are stored as doubles."""
    if len(raw) == 4 * n * width:
        return np.frombuffer(raw, "<i4").astype(np.int64).reshape(n, width)
    return np.array([int(x) for x in np.frombuffer(raw, "<f8").tolist()], object).reshape(n, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []

    def give(rows: list[tuple[int, int, bytes]]) -> tuple:
        narrow = all(len(r[2]) == 4 * width for r in rows)
        values = np.concatenate([np.frombuffer(r[2], "<i4" if len(r[2]) == 4 * width else "<f8") for r in rows]).reshape(-1, width)
        values = values.astype("<i4" if narrow else "<f8")
        sums = values.sum(0, dtype="<i8").tobytes() if narrow else b""
        return rows[0][0], np.array([r[1] for r in rows], "<i8").tobytes(), values.tobytes(), values.min(0).tobytes(), values.max(0).tobytes(), sums

    def batch(blocks: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in blocks], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _BLOCKS.split(", ")])

    for b in batches:
        made = []
        for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if held and (len(held) == BLOCK or held[0][0] != row[0]):
                made.append(give(held))
                held = []
            held.append(row)
        yield batch(made)
    if held:
        yield batch([give(held)])


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = values[:, None, :] - entries[None]
    return (gap * gap).sum(2)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Numbers, in ascending order, of the entries that may be the nearest one of a vector in the box."""
    below, above = low - entries, entries - high
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(entries - low), np.abs(entries - high))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def _entries(book: Book, width: int) -> list[np.ndarray]:
    small = all(abs(x) < bound(width) for part in book for entry in part for x in entry)
    return [np.array(part, np.int64 if small else object).reshape(len(part), width) for part in book]


def _each(batches: Iterator[pa.RecordBatch], book: Book, width: int) -> Iterator[tuple]:
    """(part, ids, sums or None, values, entries, shortlist) of each block."""
    entries = _entries(book, width)
    for b in batches:
        for part, ids, raw, low, high, sums in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(ids, "<i8")
            low, high = (_numbers(x, 1, width) for x in (low, high))
            yield part, ids, np.frombuffer(sums, "<i8") if sums else None, _numbers(raw, len(ids), width), entries[part], shortlist(low, high, entries[part])


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, value) of a whole number in base 2**32, so that sums over tasks fit into longs."""
    place = 0
    while not -(1 << 31) <= x < 1 << 31:
        yield place, x & 0xFFFFFFFF
        x, place = x >> 32, place + 1
    yield place, x


def _sums(batches: Iterator[pa.RecordBatch], book: Book, width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, at, place, value): sums of the parts that each entry gets, their count at ``width``."""
    total = [np.zeros((len(part), width + 1), object) for part in book]
    for part, ids, sums, values, entries, some in _each(batches, book, width):
        if len(some) == 1:
            total[part][some[0], :width] += (values.sum(0) if sums is None else sums).astype(object)
            total[part][some[0], width] += len(ids)
            continue
        nearest = distances(values, entries[some]).argmin(1)
        for k in np.unique(nearest).tolist():
            own = values[nearest == k]
            total[part][some[k], :width] += own.sum(0).astype(object)
            total[part][some[k], width] += len(own)
    rows = [(p, k, at, place, value) for p, t in enumerate(total) for k in range(len(t)) if t[k, width] for at in range(width + 1) for place, value in _limbs(int(t[k, at]))]
    kinds = [pa.int32()] * 4 + [pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "entry", "at", "place", "value"])


def _codes(batches: Iterator[pa.RecordBatch], book: Book, width: int) -> Iterator[pa.RecordBatch]:
    for part, ids, _, values, entries, some in _each(batches, book, width):
        d = distances(values, entries[some])
        nearest = d.argmin(1)
        error = [min(int(x), MOST) for x in d[np.arange(len(ids)), nearest]]
        columns = [pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), pa.array(some[nearest].astype(np.int32)), pa.array(error, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "part", "entry", "error"])


def next_book(book: Book, sums: list, width: int) -> Book:
    """Entries replaced by the floor of their parts' mean; unused ones stay."""
    total = [np.zeros((len(part), width + 1), object) for part in book]
    for r in sums:
        total[r.part][r.entry, r.at] += int(r.value) << 32 * r.place
    return [[[int(s) // int(t[width]) for s in t[:width]] if t[width] else entry for t, entry in zip(own, part)] for own, part in zip(total, book)]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec_id, label, v) of the vectors of finite components whose length divides into parts."""
    v = F.col("embedding").cast("array<double>")
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | F.isnan(SCALE * x - SCALE * x))
    fits = (F.size("v") > 0) & (F.size("v") % PARTS == 0)
    return materialize(read.where(F.col("v").isNotNull() & fits & ~odd).withColumn("id", F.monotonically_increasing_id()), "vectors")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of (vec_id, embedding, label)."""
    kept = kept_vectors(vectors)
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = len(first[0].v) // PARTS
    kept = kept.where(F.size("v") == width * PARTS)
    start = np.array([r.v for r in kept.orderBy(*order).limit(ENTRIES).select("v").collect()], float)
    whole = np.floor(SCALE * start).reshape(-1, PARTS, width)
    scale = [(whole[:, p].mean(0), np.maximum(whole[:, p].std(0), 1)) for p in range(PARTS)]
    book = [[[int(x) for x in entry] for entry in whole[:, p].tolist()] for p in range(PARTS)]
    parts = kept.select("id", "v").mapInArrow(lambda b: _parts(b, width, scale), "part int, place long, id long, raw binary")
    # the last column splits places that many equal parts share
    parts = parts.repartitionByRange("part", "place", F.xxhash64("id")).sortWithinPartitions("part", "place")
    blocks = materialize(parts.mapInArrow(lambda b: _blocks(b, width), _BLOCKS), "vector-blocks")
    for _ in range(ROUNDS):
        now = book
        sums = blocks.mapInArrow(lambda b: _sums(b, now, width), "part int, entry int, at int, place int, value long")
        book = next_book(book, sums.groupBy("part", "entry", "at", "place").agg(F.sum("value").alias("value")).collect(), width)
    codes = blocks.mapInArrow(lambda b: _codes(b, book, width), "id long, part int, entry int, error long")
    most = F.lit(MOST).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(28,0)")), most).cast("long")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0")))
    coded = codes.groupBy("id").agg(F.concat_ws("", digits).alias("code"), total("error").alias("error"))
    coded = materialize(kept.select("id", "vec_id", "label").join(coded, "id").drop("id"), "vector-codes")
    discard(blocks)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
