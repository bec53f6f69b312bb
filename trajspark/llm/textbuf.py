"""Work on the UTF-8 bytes of an Arrow text column: word bounds and word hashes without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is taken whole.
CHUNK = 2 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed in steps of eight.
LONG = 256
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than usual for this session: texts are long, and a batch is held several times over
    between the JVM and the Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, CHUNK + (1 << 16))
        with np.errstate(over="ignore"):
            one = np.full(n, BASE, np.uint64)
            one[0] = 1
            _powers = np.cumprod(one, dtype=np.uint64)
            one[1:] = np.uint64(pow(int(BASE), -1, 1 << 64))
            _inverse = np.cumprod(one, dtype=np.uint64)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``h``."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column and its n+1 offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first row, row after the last, bytes, offsets from 0)."""
    if not len(column):
        return
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words of a run of texts: ``start``, ``stop`` (byte positions), ``doc`` (row in the run), ``bounds`` (of the rows
    in the list of words). ``hash()`` gives 64 bits per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        # room for reading eight bytes from any place on
        padded = np.zeros((n + 23) // 8 * 8, np.uint8)
        self.lanes = padded.view("<u8")
        self.data = padded[:n]
        self.data[:] = data
        if lower:
            self.data += ((data - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5)
        inside = np.empty(n + 1, bool)
        np.logical_and(data != 0x20, (data - np.uint8(9)) > np.uint8(4), out=inside[1:])
        inside[0] = False
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        if n and inside[-1]:
            turns = np.append(turns, n)
        self.start, self.stop = turns[0::2], turns[1::2]
        # words that touch at the bounds of two texts
        cut = np.unique(offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)])
        cut = cut[inside[cut] & inside[cut + 1]]
        if len(cut):
            self.start, self.stop = (np.insert(x, np.searchsorted(x, cut), cut) for x in (self.start, self.stop))
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def _lane(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place on as a number."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        lane = self.lanes[word] >> shift
        lane |= self.lanes[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
        # the byte that no UTF-8 text has fills what is missing
        return lane | ~_MASK[np.minimum(size, 8)]

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..stop, for arrays of spans, eight bytes at a time; no two words of up to eight bytes
        share one. What is left of a word after LONG bytes is digested at once."""
        size = stop - start
        with np.errstate(over="ignore"):
            h = mix(self._lane(start, size) + BASE)
            done, at = 8, np.flatnonzero(size > 8)
            while len(at):
                if done >= LONG:
                    rest = [hashlib.blake2b(self.data[start[i] + done : stop[i]].tobytes(), digest_size=8).digest() for i in at.tolist()]
                    h[at] = mix(h[at] * BASE + np.frombuffer(b"".join(rest), "<u8"))
                    break
                h[at] = mix(h[at] * BASE + self._lane(start[at] + done, size[at] - done))
                done += 8
                at = at[size[at] > done]
        return h

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops without up to four ASCII marks on either side; at least one byte of a word stays."""
        start, stop = self.start.copy(), self.stop.copy()
        for end in (start, stop):
            step = 1 if end is start else -1
            at = np.flatnonzero(_MARK[self.data[start if step > 0 else stop - 1]]) if len(start) else start
            for _ in range(4):
                at = at[start[at] < stop[at] - 1]
                end[at] += step
                at = at[_MARK[self.data[start[at] if step > 0 else stop[at] - 1]]]
        return start, stop

    def hash(self) -> np.ndarray:
        return self.span(self.start, self.stop)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.stop[i]].tobytes().decode("utf-8", "replace")
