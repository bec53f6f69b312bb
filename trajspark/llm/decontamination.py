"""Benchmark decontamination by edit distance on words.

A document is contaminated by an item of w words if some passage of it lies within floor((1 - similarity) * w) word
edits of the item. Words are lower-case and without marks around them.

Items are grouped by length; a window of the group's shortest length starts at every word of a document. Windows with
too few words of any benchmark item cannot match (each edit spoils one word at most) and go first. The rest are embedded
by CGK random walks: a walk copies the current symbol and moves on by a bit that depends on step and symbol, so that few
edits leave most steps equal. Bit sampling over the walk gives LSH keys; keys that a window shares with an item make a
candidate, and the exact edit distance of the item to the text around decides. Walks are added until sampled edited
copies of the items are found at the target recall. A group of long items that ``WALKS`` walks don't bring there is
searched without walks: every place with enough of an item's words around goes to the exact edit distance.

The benchmark goes to all tasks in slices of at most ``SLICE_WORDS`` words, each slice by a pass of its own.

Null texts and items count as empty; an item without words matches nothing. Repeated items and rows keep a row each.
Columns other than ``doc_id`` and ``text`` are left aside by ``contamination`` and kept by ``keep_clean``. Empty tables
give no rows and no findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.textbuf import Words, chunks, mix

SIMILARITY, RECALL = 0.8, 0.97
SLICE_WORDS = 2_000_000
#: Samples of each walk, symbols of a sample, and how many walks at most before the exact search takes their place.
SAMPLES, SYMBOLS, WALKS = 16, 3, 24


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the bounds of the texts in them. Words of marks alone are words too."""
    words = Words(data, offsets)
    return words.span(*words.bare()) | np.uint64(1), words.bounds


def edits(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def closest(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Least edit distance of the pattern (bit masks by symbol) to any passage of ``text``: bit-parallel."""
    mask, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = mask, 0, size, size
    for s in text:
        eq = pattern.get(s, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & mask, up & zero
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up, down = minus | ~(zero | plus) & mask, plus & zero
        best = min(best, score)
    return best


@dataclass
class Group:
    """Items of about one length."""

    items: list[int]
    length: int  # words of a window
    least: int  # words of it that must be known
    walks: int
    keys: np.ndarray
    owner: np.ndarray
    filter: np.ndarray
    known: np.ndarray  # whether each word of the index is one of this group's items'
    exact: bool = False  # walks miss too much: every place with enough of an item's words is a candidate


class Benchmark:
    """Index of a bounded slice of items."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 11):
        self.ids, self.similarity = ids, similarity
        column = pa.array(texts, pa.string())
        self.items: list[np.ndarray] = []
        for first, last, data, offsets in chunks(column):
            h, bounds = symbols(data, offsets)
            self.items += [h[bounds[i] : bounds[i + 1]] for i in range(last - first)]
        self.known = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        self.known_bits = np.zeros(1 << 20, bool)
        self.known_bits[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.patterns = []
        for item in self.items:
            masks: dict[int, int] = {}
            for i, s in enumerate(item.tolist()):
                masks[s] = masks.get(s, 0) | 1 << i
            self.patterns.append(masks)
        self.groups: list[Group] = []
        rng = np.random.default_rng(seed)
        order = sorted((i for i in range(len(self.items)) if len(self.items[i])), key=lambda i: len(self.items[i]))
        while order:
            length = len(self.items[order[0]])
            # items of a group differ in length by less than an eighth, so that their windows are about item-sized
            own = [i for i in order if len(self.items[i]) <= max(length, int(length * 1.125))]
            order = order[len(own) :]
            self._group(own, length, recall, rng)

    def _group(self, own: list[int], length: int, recall: float, rng: np.random.Generator) -> None:
        most = edits(len(self.items[own[-1]]), self.similarity)
        group = Group(own, length, max(1, length - most), 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1 << 20, bool), np.isin(self.known, np.concatenate([self.items[i] for i in own])))
        flat, start, stop = self._flat([self.items[i] for i in own])
        # edited copies, on which the number of walks is set
        picked = [own[int(k)] for k in rng.integers(0, len(own), 60)]
        copies = [self._edited(self.items[i], edits(len(self.items[i]), self.similarity), rng) for i in picked]
        test = self._flat(copies)
        found, keys, owner = np.zeros(len(copies), bool), [], []
        while group.walks < WALKS and (group.walks < 2 or found.mean() < recall):
            k, full = self.walk(flat, start, stop, length, group.walks)
            # a copy is met at its first words
            shifts = [self.walk(test[0], np.minimum(test[1] + d, test[2]), test[2], length, group.walks)[0] for d in range(2)]
            for c, i in enumerate(picked):
                found[c] |= any(((k[own.index(i)] == s[c]) & full[own.index(i)]).any() for s in shifts)
            # samples with blanks beyond the item say little and are left out of the index
            keys.append(k[full])
            owner.append(np.repeat(own, SAMPLES).reshape(k.shape)[full])
            group.walks += 1
        if found.mean() < recall:
            group.exact, group.walks = True, 0
            self.groups.append(group)
            return
        all_keys, all_owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(all_keys, kind="stable")
        group.keys, group.owner = all_keys[order], all_owner[order]
        group.filter[(group.keys >> np.uint64(44)).astype(np.int64)] = True
        self.groups.append(group)

    @staticmethod
    def _flat(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        return np.concatenate([*items, np.zeros(1, np.uint64)]), bounds[:-1], bounds[1:]

    @staticmethod
    def _edited(item: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        words = item.tolist()
        for _ in range(n):
            at, kind, fresh = int(rng.integers(0, len(words))), int(rng.integers(0, 3)), int(rng.integers(1 << 62)) | 1
            words[at : at + (kind != 1)] = [] if kind == 2 and len(words) > 1 else [fresh]
        return np.array(words, np.uint64)

    def walk(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (rows x SAMPLES) of one walk over the windows that begin at ``start``, and whether all symbols of each
        key are words; a window ends after ``length`` words or at ``stop``, and blanks follow."""
        rng = np.random.default_rng([length, number])
        spots = np.sort(rng.integers(0, 2 * length, (SAMPLES, SYMBOLS)), axis=1)
        odd = rng.integers(1, 1 << 63, 2 * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        end = np.minimum(start + length, stop)
        at = start.copy()
        keys = np.full((len(start), SAMPLES), np.uint64(number * 1000003 + length), np.uint64)
        full = np.ones(keys.shape, bool)
        last = len(flat) - 1
        with np.errstate(over="ignore"):
            for t in range(int(spots.max()) + 1):
                s = flat[np.minimum(at, last)]
                s[at >= end] = 0
                for j, times in enumerate((spots == t).sum(1).tolist()):
                    if times:
                        keys[:, j] = (keys[:, j] ^ s) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(t)
                        keys[:, j] ^= keys[:, j] >> np.uint64(29)
                        full[:, j] &= s != 0
                at += (s * odd[t] >> np.uint64(63)).astype(np.int64)
            return mix(keys + np.arange(SAMPLES, dtype=np.uint64)), full

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, item number, similarity) of each item found in a run of texts."""
        h, bounds = symbols(data, offsets)
        n = len(h)
        if not n or not self.groups:
            return
        known = self.known_bits[(h >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(known)
        i = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        known[maybe] = self.known[i] == h[maybe]
        # number of each word in the index; the last entry of a group's table stands for all other words
        number = np.full(n, len(self.known), np.int32)
        number[maybe] = np.where(known[maybe], i, len(self.known))
        stop = np.repeat(bounds[1:], np.diff(bounds))
        flat = np.concatenate([h, np.zeros(1, np.uint64)])
        done: list[tuple[int, int, float]] = []
        total, here = np.zeros(n + 1, np.int32), np.arange(n)
        for g in self.groups:
            np.cumsum(np.append(g.known, False)[number], out=total[1:])
            start = np.flatnonzero(total[np.minimum(here + g.length, stop)] - total[:-1] >= g.least)
            met = [self._worded(g, number, start, stop)] if g.exact and len(start) else [self._candidates(g, flat, part, stop[part]) for part in np.split(start, range(20_000, len(start), 20_000)) if len(part)]
            if not met:
                continue
            at, item = (np.concatenate([m[k] for m in met]) for k in (0, 1))
            doc = np.searchsorted(bounds, at, "right") - 1
            order = np.lexsort((at, item, doc))
            at, item, doc = at[order], item[order], doc[order]
            runs = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            for places in np.split(np.arange(len(at)), runs):
                if len(places):
                    d, k = int(doc[places[0]]), int(item[places[0]])
                    likeness = self._best(k, at[places], h[bounds[d] : bounds[d + 1]], int(bounds[d]))
                    if likeness is not None:
                        done.append((d, k, likeness))
        yield from sorted(done)

    def _candidates(self, g: Group, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) of all that share a key."""
        places, items = [], []
        for number in range(g.walks):
            keys, _ = self.walk(flat, start, stop, g.length, number)
            row, col = np.nonzero(g.filter[(keys >> np.uint64(44)).astype(np.int64)])
            k = keys[row, col]
            left = np.searchsorted(g.keys, k, "left")
            size = np.searchsorted(g.keys, k, "right") - left
            owner = np.repeat(left - np.cumsum(size) + size, size) + np.arange(size.sum())
            places.append(start[np.repeat(row, size)])
            items.append(g.owner[owner])
        codes = np.unique(np.concatenate(places) * len(self.items) + np.concatenate(items))
        return np.divmod(codes, len(self.items))

    def _worded(self, g: Group, number: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, item) of all with so many of the item's words that a passage from there may match."""
        places, items, total = [], [], np.zeros(len(number) + 1, np.int32)
        for k in g.items:
            size, most = len(self.items[k]), edits(len(self.items[k]), self.similarity)
            own = np.zeros(len(self.known) + 1, bool)
            own[np.searchsorted(self.known, self.items[k])] = True
            np.cumsum(own[number], out=total[1:])
            at = start[total[np.minimum(start + size + most, stop[start])] - total[start] >= size - most]
            places.append(at)
            items.append(np.full(len(at), k, np.int64))
        return np.concatenate(places), np.concatenate(items)

    def _best(self, item: int, at: np.ndarray, text: np.ndarray, base: int) -> float | None:
        """Similarity of the item to the closest passage around the given places, or None if below the limit."""
        size, pattern = len(self.items[item]), self.patterns[item]
        most = edits(size, self.similarity)
        left, right = np.maximum(at - base - most - 2, 0), np.minimum(at - base + size + most + 2, len(text))
        cut = np.flatnonzero(left[1:] > right[:-1]) + 1
        best = most + 1
        for a, b in zip(left[np.concatenate([[0], cut])].tolist(), right[np.concatenate([cut - 1, [len(at) - 1]])].tolist()):
            around = text[a:b].tolist()
            if sum(map(pattern.__contains__, around)) >= size - most:
                best = min(best, closest(pattern, size, around))
        return 1 - best / size if best <= most else None


def slices(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The benchmark's items in parts of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    parts = -(-words // SLICE_WORDS)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow()
        yield rows.column(0).to_pylist(), rows.column(1).to_pylist()


_ITEM = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())])


def _found(batches: Iterator[pa.RecordBatch], index, at: int) -> Iterator[tuple[pa.RecordBatch, list[list[dict]]]]:
    for b in batches:
        rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
        for first, _, data, offsets in chunks(b.column(at)):
            for doc, item, likeness in index.value.matches(data, offsets):
                rows[first + doc].append({"item_id": index.value.ids[item], "similarity": likeness})
        yield b, rows


def _report(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """Rows with what this slice of the benchmark adds to their findings."""
    for b, rows in _found(batches, index, 1):
        items = [[*old, *new] for old, new in zip(b.column(2).to_pylist(), rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, pa.list_(_ITEM))], ["doc_id", "text", "items"])


_ROWS = "doc_id long, text string, items array<struct<item_id: long, similarity: double>>"


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, contaminated, n_items, items (item_id, similarity) of every row."""
    context = docs.sparkSession.sparkContext
    none = F.expr("cast(array() as array<struct<item_id: bigint, similarity: double>>)")
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), none.alias("items"))
    for ids, texts in slices(benchmark):  # the rows pass by one slice after the other, and stay the rows they are
        index = context.broadcast(Benchmark(ids, texts, similarity, recall))
        out = out.mapInArrow(lambda b, index=index: _report(b, index), _ROWS)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def _clean(batches: Iterator[pa.RecordBatch], index, at: int) -> Iterator[pa.RecordBatch]:
    for b, rows in _found(batches, index, at):
        yield b.filter(pa.array([not r for r in rows], pa.bool_()))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Rows of ``docs``, all columns, in which no item is found."""
    at, context = docs.columns.index("text"), docs.sparkSession.sparkContext
    for ids, texts in slices(benchmark):
        index = context.broadcast(Benchmark(ids, texts, similarity, recall))
        docs = docs.mapInArrow(lambda b, index=index: _clean(b, index, at), docs.schema)
    return docs
