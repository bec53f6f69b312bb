"""Line deduplication: exact set-similarity join of lines, later matches removed.

A line is the set of its words (lower case, without marks around them). A line goes if an earlier line, by (doc_id, line
number), has the same set or one of Jaccard similarity ``similarity`` or more; whether that earlier line goes too does
not matter. Lines of fewer than ``min_tokens`` distinct words stay always, as do lines without words.

Equal sets are one class, judged at its first line. The words of a class are ordered from rare to frequent by a table of
counts over all lines. Of two similar sets all but few words are common, so within a bounded prefix of this order some
three neighbours (two in small sets) of the one are neighbours in the other as well: these are the keys of the join. A
triple is far rarer than a word, so that hardly any but similar lines meet, however many lines there are. Most keys occur
once: a first pass reports three bytes per key, from which a table, sized by the data up to KEY_BITS, tells the keys that
may be shared, and only these are shuffled whole. Sets that meet pass length, positional and parity filters; then their
words, read again from the documents, are compared (see ``matches``).

Words are told apart by 64 bits of hash, which words of up to eight bytes never share; lines by 128.

Null texts have no lines and stay null. Rows of equal doc_id are documents of their own, in the order of a hash of their
texts where line numbers are equal; rows equal in doc_id and text keep a row each, are none later than the other and
lose the same lines. Rows without doc_id come last. Empty tables give no rows. ``deduplicate`` keeps all columns and
rows, whatever the columns' names; a text whose lines all go becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.bits import at as bit_at
from trajspark.llm.bits import SEVERAL, bit_table, gathered, on, size_for
from trajspark.llm.matches import BLOBS, LIMIT, Dealer, later_matches, part_bits, whole_members, word_finder
from trajspark.llm.textbuf import Words, chunks, mix
from trajspark.session import discard, materialize

SIMILARITY, MIN_TOKENS = 0.8, 1
CELLS = 1 << 16
#: Keys that a task gathers before it reports them, and leading bits of a key by which they are put together.
GATHERED, RANGE_BITS = 2_000_000, 8
#: Bytes of text whose words a task holds at once; a longer single text is taken whole.
RUN = 1 << 20
#: Crowded keys at most that are dealt into chunks.
CROWDED = 1 << 18
_LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 42) - 1)


def needed(s: int, t: int, similarity: float) -> int:
    """Least number of common words of sets of s and t words at the similarity."""
    return int(np.ceil(similarity / (1 + similarity) * (s + t) - 1e-9))


def partners(s: int, similarity: float) -> list[tuple[int, int, int]]:
    """(u, v, o) of a set of s words and each size of a similar one: words unmatched on this and on the other side, and
    common words, at the least similarity."""
    out = []
    for t in range(int(np.ceil(similarity * s - 1e-9)), int(s / similarity + 1e-9) + 1):
        o = needed(s, t, similarity)
        if o <= min(s, t):
            out.append((s - o, t - o, o))
    return out


@lru_cache(1 << 16)
def prefix(s: int, similarity: float) -> tuple[int, int]:
    """How many triples and how many pairs of neighbours a set of s words needs as keys to meet every similar set.

    u + v unmatched words cut the common ones into u + v + 1 runs at most. If there are more than two words for each, one
    run has three: the first such begins after u + v runs of two and u unmatched words at most. Small sets may have too
    few; then some run has two, the first beginning after u + v single words and u unmatched ones."""
    triples = pairs = 0
    for u, v, o in partners(s, similarity):
        if o > 2 * (u + v + 1):
            triples = max(triples, 2 * (u + v) + u + 1)
        else:
            pairs = max(pairs, u + v + u + 1)
    return triples, pairs


@lru_cache(1 << 16)
def reach(s: int, similarity: float) -> tuple[int, int]:
    """``prefix``, but no keys if only equal sets are similar."""
    return (0, 0) if all(u == v == 0 for u, v, _ in partners(s, similarity)) else prefix(s, similarity)


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, text and number of each line of a run of texts. A break at the very end of a text opens a line of no
    words, which needs no number."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)])
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, doc, np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[doc]


class Lines:
    """Distinct words of each line of a run of texts: ``token``, their hashes, in order of rarity within ``line``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray | None):
        starts, self.doc, self.number = line_starts(data, offsets)
        words = Words(data, offsets)
        self.hash = words.span(*words.bare())
        per_line = np.diff(np.append(np.searchsorted(words.start, starts), len(words)))
        self.of = np.repeat(np.arange(len(starts)), per_line)
        self.count = len(starts)
        if rarity is None:
            return
        rank = (rarity[(self.hash >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(42)) | (self.hash & _LOW)
        parts = []
        bounds = np.searchsorted(self.of, np.arange(0, self.count + 60_000, 60_000))
        for a, b, base in zip(bounds[:-1], bounds[1:], range(0, self.count, 60_000)):
            order = np.argsort(((self.of[a:b] - base).astype(np.uint64) << np.uint64(48)) | rank[a:b])
            line, token = self.of[a:b][order], self.hash[a:b][order]
            fresh = np.ones(len(line), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
            parts.append((line[fresh], token[fresh]))
        self.line = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.token = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.size = np.bincount(self.line, minlength=self.count)
        self.begin = np.cumsum(self.size) - self.size

    @cached_property
    def cls(self) -> np.ndarray:
        return self._hash(self.token)

    @cached_property
    def check(self) -> np.ndarray:
        return self._hash(self.token ^ _ODD)

    def _hash(self, token: np.ndarray) -> np.ndarray:
        """Hash of each line's set of words."""
        with np.errstate(over="ignore"):
            return mix(self._sums(mix(token)) + self.size.astype(np.uint64))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over each line."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        return total[self.begin + self.size] - total[self.begin]

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, 128 bits in two numbers; each word flips one."""
        bit, half = np.uint64(1) << (self.token & np.uint64(63)), (self.token >> np.uint64(6) & np.uint64(1)).astype(bool)
        some, out = np.flatnonzero(self.size), []
        for own in (half, ~half):
            x = np.zeros(self.count, np.uint64)
            if len(some):
                x[some] = np.bitwise_xor.reduceat(np.where(own, bit, np.uint64(0)), self.begin[some])
            out.append(x)
        return out[0], out[1]


_ODD = np.uint64(0x9E3779B97F4A7C15)


_SURVEY = pa.schema(
    [("doc", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("place", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()), ("cell", pa.int64()), ("n", pa.int64())]
)


def addresses(docs: np.ndarray, ties: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Hash of each line's address."""
    with np.errstate(over="ignore"):
        return mix((mix(docs.view(np.uint64) * _ODD + ties.view(np.uint64)) + lines.astype(np.uint64)) * _ODD)


def _survey(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Lines with their classes, and counts of the cells of word hashes."""
    total, none = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.uint8)
    for b in batches:
        for docs, ties, data, offsets in _runs(b, 2):
            x = Lines(data, offsets, none)
            total += np.bincount((x.hash >> np.uint64(48)).astype(np.int64), minlength=CELLS)
            own = np.flatnonzero(x.size >= max(least, 1))
            doc, tie, line = docs[x.doc[own]], ties[x.doc[own]], x.number[own]
            columns = [doc, tie, line.astype(np.int32), addresses(doc, tie, line).view(np.int64), x.cls[own].view(np.int64), x.check[own].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *[pa.nulls(len(own), pa.int64())] * 2], schema=_SURVEY)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), f.type) for f in list(_SURVEY)[:6]], pa.array(some), pa.array(total[some])], schema=_SURVEY)


def rarity(cells: DataFrame) -> np.ndarray:
    """Logarithm of the count of each cell of word hashes over all lines: CELLS numbers, whatever the input."""
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return (np.log2(counts + 1) * 63 / max(1.0, np.log2(counts.max() + 1))).astype(np.uint8)


class Seen:
    """Leading 40 bits of all keys of a task, each with the number of classes that have it there."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.count = 0

    def add(self, key: np.ndarray) -> None:
        self.parts.append(key >> np.uint64(24))
        self.count += len(key)

    def rows(self, range_bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
        """(range, gaps between its keys, counts of those keys that several classes have)."""
        spots, n = np.unique(np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64), return_counts=True)
        self.parts, self.count = [], 0
        rest = 40 - range_bits
        cut = np.searchsorted(spots, np.arange((1 << range_bits) + 1).astype(np.uint64) << np.uint64(rest))
        out: tuple[list, list, list] = ([], [], [])
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own, times = (spots[cut[k] : cut[k + 1]] - np.uint64(k << rest)).astype(np.int64), n[cut[k] : cut[k + 1]]
            at = np.flatnonzero(times > 1)
            out[0].append(k)
            out[1].append(gaps(own))
            out[2].append(np.column_stack([at, times[at]]).astype(np.uint32).tobytes())
        return out


def gaps(spots: np.ndarray) -> bytes:
    """Sorted distinct numbers as steps of three bytes; the largest steps on without a number."""
    most = (1 << 24) - 1
    step = np.diff(spots, prepend=-1) - 1
    over = step // most
    out = np.full(len(step) + over.sum(), most, "<u4")
    out[np.cumsum(over + 1) - 1] = step % most
    return out.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def spots_of(raw: bytes) -> np.ndarray:
    most = (1 << 24) - 1
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    step = wide.view("<u4")[:, 0].astype(np.int64)
    full = step == most
    return np.cumsum(np.where(full, most, step + 1))[~full] - 1


def _keys(x: Lines, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, position) of the neighbour triples of a run's lines."""
    own = np.flatnonzero(x.size >= max(least, 1))
    kinds, inverse = np.unique(x.size[own], return_inverse=True)
    most = np.array([reach(s, similarity) for s in kinds.tolist()], np.int64).reshape(-1, 2)[inverse]
    keys, places, lines = [], [], []
    for width, n in ((3, most[:, 0]), (2, most[:, 1])):
        n = np.maximum(np.minimum(n, x.size[own] - width + 1), 0)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(x.begin[own], n) + pos
        key = np.full(len(at), np.uint64(width))
        with np.errstate(over="ignore"):
            for k in range(width):
                key = key * _ODD + x.token[at + k]
        keys.append(mix(key))
        places.append(pos)
        lines.append(np.repeat(own, n))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(places)


def _runs(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, tie, bytes, offsets) of runs of a batch whose rows are in order of (doc, tie)."""
    order = np.lexsort((b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)))
    b = b.take(pa.array(order))
    docs, ties = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for first, last, data, offsets in chunks(b.column(at), RUN):
        yield docs[first:last], ties[first:last], data, offsets


def _lines_on(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, ties: np.ndarray, wanted: np.ndarray | tuple, rarity: np.ndarray, also: np.ndarray | tuple | None = None) -> Lines:
    """The lines of a run whose addresses the tables ``wanted`` and ``also`` may have, with their places in the run; the
    words of others are not looked at."""
    starts, doc, number = line_starts(data, offsets)
    place = addresses(docs[doc], ties[doc], number)
    some = on(wanted, place) if also is None else on(wanted, place) & on(also, place)
    own, size = np.flatnonzero(some), np.diff(np.append(starts, len(data)))
    if len(own) < len(starts):
        data, offsets = data[np.repeat(some, size)], np.concatenate([[0], np.cumsum(size[own])])
    x = Lines(data, offsets, rarity)
    x.doc, x.number = doc[own], number[own]
    return x


def _reports(batches: Iterator[pa.RecordBatch], rare, firsts, least: int, similarity: float, range_bits: int) -> Iterator[pa.RecordBatch]:
    """What keys there are."""
    seen = Seen()

    def keys() -> pa.RecordBatch:
        part, raw, counts = seen.rows(range_bits)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw, pa.binary()), pa.array(counts, pa.binary())], ["part", "gaps", "counts"])

    for b in batches:
        for docs, ties, data, offsets in _runs(b, 2):
            seen.add(_keys(_lines_on(data, offsets, docs, ties, firsts.value, rare.value), least, similarity)[0])
            if seen.count > GATHERED:
                yield keys()
    yield keys()


def _met(batches: Iterator[pa.RecordBatch], bits: int, range_bits: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Of each range: the bits, among ``bits``, of keys that several classes have, and the crowded keys with their counts."""
    rest, width = 40 - range_bits, bits >> range_bits

    def batch(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        spots, inverse = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([c for _, c in held]), len(spots)).astype(np.int64)
        table = np.zeros(width, bool)
        table[spots[n > 1] * width >> rest] = True
        many = np.flatnonzero(n > limit)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary()), pa.array([(spots[many] + (part << rest)).astype("<i8").tobytes()], pa.binary()), pa.array([n[many].astype("<i8").tobytes()], pa.binary())],
            ["part", "bits", "crowded", "counts"],
        )

    last, held = None, []
    for b in batches:
        for part, raw, counts in zip(*(c.to_pylist() for c in b.columns)):
            if held and part != last:
                yield batch(last, held)
                held = []
            spots = spots_of(raw)
            n = np.ones(len(spots), np.int64)
            several = np.frombuffer(counts, np.uint32).reshape(-1, 2)
            n[several[:, 0]] = several[:, 1]
            last = part
            held.append((spots, n))
            if len(held) > 64:
                spots, inverse = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
                held = [(spots, np.bincount(inverse, np.concatenate([c for _, c in held]), len(spots)).astype(np.int64))]
    if held:
        yield batch(last, held)


@dataclass
class Keys:
    """What is known of the keys: a bit for each that several classes may have, and the crowded ones' numbers of chunks. Few
    bits are set, so the table travels compressed: each executor keeps a copy on its disk."""

    table: np.ndarray
    crowded: np.ndarray
    chunks: np.ndarray

    def __getstate__(self) -> tuple:
        return pa.compress(self.table, "zstd", asbytes=True), len(self.table), self.crowded, self.chunks

    def __setstate__(self, state: tuple) -> None:
        raw, size, self.crowded, self.chunks = state
        self.table = np.frombuffer(pa.decompress(raw, size, "zstd"), np.uint8)

    def shared(self, key: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (len(self.table) * 8 - 1).bit_length())
        return np.flatnonzero(bit_at(self.table, (key >> shift).astype(np.int64)))

    def dealt(self, key: np.ndarray) -> np.ndarray:
        """Number of chunks of each key."""
        out, spot = np.ones(len(key), np.int64), (key >> np.uint64(24)).astype(np.int64)
        if len(self.crowded):
            at = np.minimum(np.searchsorted(self.crowded, spot), len(self.crowded) - 1)
            out = np.where(self.crowded[at] == spot, self.chunks[at], out)
        return out


def shared_keys(reports: DataFrame, partitions: int, range_bits: int, limit: int) -> Keys:
    """``reports``: part, gaps, counts. The table has six to twelve bits for each reported key, within the bound of bit
    tables."""
    bits = max(1 << 20, size_for((reports.agg(F.sum(F.length("gaps"))).first()[0] or 0) // 3, 6))
    dealt = reports.repartition(partitions, "part").sortWithinPartitions("part")
    met = materialize(dealt.mapInArrow(lambda b: _met(b, bits, range_bits, limit), "part int, bits binary, crowded binary, counts binary"), "met-keys", few=True)
    table, crowded, counts = gathered(met, bits)
    discard(met)
    spots, n = (np.frombuffer(b"".join(x), "<i8") for x in (crowded, counts))
    keep = np.argsort(-n, kind="stable")[:CROWDED]  # the least crowded beyond that stay whole
    keep = keep[np.argsort(spots[keep])]
    return Keys(table, spots[keep], -(-n[keep] // limit))


def _members(x: Lines, docs: np.ndarray, known: Keys, least: int, similarity: float) -> tuple[dict, np.ndarray]:
    """Members of a run's lines under keys that may be shared, and their lines."""
    key, line, pos = _keys(x, least, similarity)
    shared = known.shared(key)
    key, line, pos = key[shared], line[shared], pos[shared]
    dealt, cls, (one, two) = known.dealt(key), x.cls[line], x.parity()
    chunk = (mix(cls) % dealt.astype(np.uint64)).astype(np.int32)
    return {"key": key, "cls": cls, "doc": docs[x.doc[line]], "p1": one[line], "p2": two[line], "line": x.number[line], "size": x.size[line], "pos": pos, "chunk": chunk, "chunks": dealt}, line


def _postings(batches: Iterator[pa.RecordBatch], rare, firsts, known, least: int, similarity: float, bits: int) -> Iterator[pa.RecordBatch]:
    dealer = Dealer(bits)
    for b in batches:
        for docs, ties, data, offsets in _runs(b, 2):
            yield from dealer.add(_members(_lines_on(data, offsets, docs, ties, firsts.value, rare.value), docs, known.value, least, similarity)[0])
    yield from dealer.rows()


def _whole(batches: Iterator[pa.RecordBatch], rare, firsts, known, keys, asks, wanted, least: int, similarity: float, bits: int) -> Iterator[pa.RecordBatch]:
    """Members under the keys of a table: with their words, of the lines whose addresses ``wanted`` may have, or, if it is
    None, of all lines, without words."""
    dealer = Dealer(bits)
    for b in batches:
        for docs, ties, data, offsets in _runs(b, 2):
            x = _lines_on(data, offsets, docs, ties, firsts.value, rare.value, None if wanted is None else wanted.value)
            m, line = _members(x, docs, known.value, least, similarity)
            some = on(keys.value, m["key"])
            m = {n: v[some] for n, v in m.items()}
            yield from whole_members(dealer, m, x.begin[line[some]], None if wanted is None else x.token, on(asks.value, m["cls"]))
    yield from dealer.rows()


def _sets(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """Classes and words of the lines whose addresses a table may have."""
    none = np.zeros(CELLS, np.uint8)
    for b in batches:
        for docs, ties, data, offsets in _runs(b, 2):
            x = _lines_on(data, offsets, docs, ties, wanted.value, none)
            bounds = pa.array(np.append(x.begin, len(x.token)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x.cls.view(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(x.token.view(np.int64)))], ["cls", "tokens"])


def _addressed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): rows of equal doc_id are told apart by their texts; without doc_id they come last."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, limit: int = LIMIT) -> DataFrame:
    """(doc, tie, lines): numbers from 0 of the lines that go, for each document with any, as ``_addressed`` names them."""
    spark = docs.sparkSession
    context, partitions = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_bits = max(RANGE_BITS, (4 * partitions).bit_length())
    docs = _addressed(docs)
    survey = materialize(docs.mapInArrow(lambda b: _survey(b, min_tokens), "doc long, tie long, line int, place long, cls long, check long, cell long, n long"), "lines")
    lines = survey.where("cell is null").select("doc", "tie", "line", "cls", "check")
    rare = context.broadcast(rarity(survey.where("cell is not null").select("cell", "n")))
    # the first line of each class
    first = F.min(F.struct("doc", "line", "tie", "check", "place")).alias("first")
    classes = materialize(survey.where("cell is null").groupBy("cls").agg(first, F.count(F.lit(1)).alias("n")), "classes", few=True)
    firsts = context.broadcast(bit_table(classes.select("first.place"), 6, SEVERAL))
    reports = materialize(docs.mapInArrow(lambda b: _reports(b, rare, firsts, min_tokens, similarity, range_bits), "part int, gaps binary, counts binary"), "reports")
    known = context.broadcast(shared_keys(reports, partitions, range_bits, limit))
    discard(reports)
    bits = part_bits(partitions)

    def whole(keys, asks, wanted: DataFrame | None) -> DataFrame:
        marked = None if wanted is None else context.broadcast(bit_table(classes.join(wanted.withColumnRenamed("y", "cls"), "cls", "left_semi").select("first.place"), 6, SEVERAL))
        return docs.mapInArrow(lambda b: _whole(b, rare, firsts, known, keys, asks, marked, min_tokens, similarity, bits), BLOBS)

    def sets(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted, "wanted", few=True)
        marked = context.broadcast(bit_table(classes.join(wanted, "cls", "left_semi").select("first.place"), 6, SEVERAL))
        found = docs.mapInArrow(lambda b: _sets(b, marked), "cls long, tokens array<long>")
        out = materialize(found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens")), "sets", few=True)
        discard(wanted)
        return out

    members = docs.mapInArrow(lambda b: _postings(b, rare, firsts, known, min_tokens, similarity, bits), BLOBS)
    gone = later_matches(members, whole, sets, similarity, word_finder(similarity), screen=True)
    repeated = classes.where("n > 1").select("cls", "first")
    affected = repeated.join(gone.withColumn("gone", F.lit(True)), "cls", "full")
    # a line whose second hash is not that of its class's first line is no copy of it
    later = "gone or check = first.check and (doc <> first.doc or line <> first.line or tie <> first.tie)"
    out = materialize(lines.join(affected, "cls").where(later).groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line")).alias("lines")), "removed", few=True)
    discard(survey, classes, gone)
    return out


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, removed: str | None = None) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``. ``removed`` names a column to add: how many went."""
    out = removed_lines(docs, similarity, min_tokens)
    taken = {c.lower() for c in docs.columns}
    doc, tie, lines, parts = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("doc", "tie", "lines", "parts"))
    text = F.col("text").cast("string")
    joined = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(tie, F.xxhash64(text))
    # a hash table of line numbers instead of a sort of whole texts
    joined = joined.join(out.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("lines").alias(lines)).hint("shuffle_hash"), [doc, tie], "left")
    # a column of its own, else the lambda would split the text again for each line
    joined = joined.withColumn(parts, F.when(F.col(lines).isNotNull(), F.split(text, "\n", -1)))
    left_over = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines))
    left = F.array_join(F.transform(left_over, lambda i: F.get(F.col(parts), i)), "\n")
    joined = joined.withColumn("text", F.when(F.col(lines).isNull() | F.col("text").isNull(), F.col("text")).otherwise(left))
    extra: list[Column] = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(removed)] if removed else []
    return joined.select(*docs.columns, *extra)
