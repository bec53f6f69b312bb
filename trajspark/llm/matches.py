"""Which sets are similar to an earlier one: candidates that share a key, screened by a sketch, then compared whole.

A member is a set under one of its keys: key, cls (the set), doc and line (its place), size, pos (of the key in the set), p1
and p2 (its sketch), chunk and chunks. Sets come in order of (doc, line, cls). Members travel as blobs of many, dealt by a
hash of key and chunk; a key that very many sets have is cut into ``chunks`` chunks, so that no task takes a key whole.

First, each set meets the earlier ones of each of its keys (in its own chunk, where there are several) and keeps the
likeliest, as told by a ``Finder``. Nearly all sets that go are settled by that one comparison, so the pairs grow with the
sets, not with the squares of the groups. Sets that it does not settle, and that have others to meet, then meet all of
them with their words at hand: the keys of these sets are dealt once more, chunk against chunk, and only the sets that go
come out. Where few sets ask but many share their keys, a screening without words first tells whose words are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.bits import SEVERAL, bit_table, on
from trajspark.llm.textbuf import mix
from trajspark.session import collect_garbage, discard, materialize

#: Sets of one chunk of a key, about.
LIMIT = 1024
#: Chunks of a key that are one where sets meet all others: fewer copies of their words, for the same comparisons.
MERGED = 4
#: Members, or eights of words, that a task gathers before it deals them; pairs, and words, that are worked on at once.
GATHERED, PAIRS, WORDS = 250_000, 1_000_000, 1_000_000
FIELDS = {"key": np.uint64, "cls": np.uint64, "doc": np.int64, "p1": np.uint64, "p2": np.uint64, "line": np.int32, "size": np.int32, "pos": np.int32, "chunk": np.int32, "chunks": np.int32}
_WIDTH = sum(np.dtype(t).itemsize for t in FIELDS.values())
_ODD = np.uint64(0x9E3779B97F4A7C15)
BLOBS = "part int, members binary, side binary, tokens binary"

#: (members, refs, root, asks, begin, count): for each of the rows ``asks``, the candidates among ``refs[begin : begin +
#: count]``, a group of refs beginning at its ``root``. Yields (asks, refs, margin), all pairs of a row in one run, rows in order.
Finder = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def needed(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Least number of common words of sets of a and b words at the similarity."""
    return np.ceil(similarity / (1 + similarity) * (a.astype(np.int64) + b) - 1e-9).astype(np.int64)


def word_finder(similarity: float) -> Finder:
    """Pairs screened by size, by place of the shared key in the order of words (positional filter) and by parity: each
    word flips one of 128 bits, so two sets differ by as many words at least as bits. The margin is how far below the
    allowed difference a pair lies."""

    def find(m: dict, refs: np.ndarray, root: np.ndarray, asks: np.ndarray, begin: np.ndarray, count: np.ndarray):
        for at in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
            c = count[at]
            i = np.repeat(asks[at], c)
            j = refs[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at], c)]
            a, b = m["size"][i], m["size"][j]
            need = needed(a, b, similarity)
            p, q = m["pos"][i], m["pos"][j]
            fit = (need <= np.minimum(a, b)) & (np.minimum(p, q) + np.minimum(a - p, b - q) >= need)
            i, j, margin = i[fit], j[fit], (a + b - 2 * need)[fit]
            margin = margin - np.bitwise_count(m["p1"][i] ^ m["p1"][j]) - np.bitwise_count(m["p2"][i] ^ m["p2"][j])
            fit = margin >= 0
            yield i[fit], j[fit], margin[fit]

    return find


def tree_finder(radius: int) -> Finder:
    """Pairs whose fingerprints ``p1`` lie within ``radius`` bits, by a BK-tree for each group; the margin is what the
    distance leaves of it."""
    from trajspark.llm.simhash_dedup import BKTree, popcount

    def find(m: dict, refs: np.ndarray, root: np.ndarray, asks: np.ndarray, begin: np.ndarray, count: np.ndarray):
        prints = m["p1"]
        tree = BKTree(prints[refs], root)
        some = np.flatnonzero(count)
        for at in np.split(some, range(4096, len(some), 4096)):
            q, node = tree.within(prints[asks[at]], radius, begin[at])
            q = at[q]
            fit = node < begin[q] + count[q]
            order = np.argsort(q[fit], kind="stable")
            q, node = q[fit][order], node[fit][order]
            i, j = asks[q], refs[node]
            yield i, j, radius - popcount(prints[i] ^ prints[j]).astype(np.int64)

    return find


# --- blobs ------------------------------------------------------------------------------------------------------------


def part_bits(partitions: int) -> int:
    return max(6, (2 * partitions).bit_length())


def planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then the second ones, and so on: those of small numbers are nearly all zero, which
    compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    """n numbers from what ``planes`` wrote at a place."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


class Dealer:
    """Gathers members, with sides and tokens if they have any, and gives them out as a blob for each part."""

    def __init__(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.held: list[tuple[dict, np.ndarray | None, np.ndarray | None]] = []

    def add(self, m: dict, side: np.ndarray | None = None, tokens: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``side``: chunk that a member meets and how; ``tokens``: all members' words in turn."""
        if len(m["key"]):
            self.held.append((m, side, tokens))
            self.count += len(m["key"]) if tokens is None else len(tokens) // 8
        if self.count > GATHERED:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        m = {n: np.concatenate([h[0][n] for h in self.held]) for n in FIELDS}
        side = None if self.held[0][1] is None else np.concatenate([h[1] for h in self.held])
        tokens = None if self.held[0][2] is None else np.concatenate([h[2] for h in self.held])
        self.held, self.count = [], 0
        with np.errstate(over="ignore"):
            group = m["key"] + m["chunk"].astype(np.uint64) * _ODD
            if side is not None:
                group += (side >> 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        part = (mix(group) >> np.uint64(64 - self.bits)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        begin = np.cumsum(m["size"], dtype=np.int64) - m["size"]
        columns: list[list] = [[], [], [], []]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = order[a:b]
            columns[0].append(int(part[own[0]]))
            columns[1].append(b"".join(planes(m[n][own].astype(t)) for n, t in FIELDS.items()))
            columns[2].append(None if side is None else side[own].astype(np.int64).tobytes())
            columns[3].append(None if tokens is None else tokens[spread(begin[own], m["size"][own])].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], [x.split()[0] for x in BLOBS.split(", ")])


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of ``size`` from each ``begin`` on."""
    size = size.astype(np.int64)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, np.ndarray | None, np.ndarray | None]]:
    """Members of each part, their sides and tokens."""

    def whole() -> tuple:
        out: dict[str, list] = {n: [] for n in FIELDS}
        for raw, _, _ in held:
            n, at = len(raw) // _WIDTH, 0
            for name, kind in FIELDS.items():
                out[name].append(unplaned(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
        side, tokens = (None if held[0][k] is None else np.concatenate([np.frombuffer(h[k], t) for h in held]) for k, t in ((1, np.int64), (2, np.uint64)))
        return last, {n: np.concatenate(x) for n, x in out.items()}, side, tokens

    last, held = None, []
    for b in batches:
        for part, *raw in zip(*(c.to_pylist() for c in b.columns)):
            if held and part != last:
                yield whole()
                held = []
            last = part
            held.append(raw)
    if held:
        yield whole()


def _groups(m: dict, extra: np.ndarray | None = None) -> np.ndarray:
    """Number of the group of each member: key, chunk and, with ``extra``, the chunk to meet."""
    with np.errstate(over="ignore"):
        return np.unique(mix(m["key"] + m["chunk"].astype(np.uint64) * _ODD + (0 if extra is None else mix(extra.astype(np.uint64)))), return_inverse=True)[1]


def _earlier(m: dict, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    d, e = m["doc"][j], m["doc"][i]
    k, n = m["line"][j], m["line"][i]
    return (d < e) | (d == e) & ((k < n) | (k == n) & (m["cls"][j] < m["cls"][i]))


_BEST = "y long, x long, margin int, several boolean, keys binary"


def _best(batches: Iterator[pa.RecordBatch], find: Finder) -> Iterator[pa.RecordBatch]:
    """Of each set of a group: the likeliest earlier one, and whether there are others to meet; and, packed, the keys under
    which sets have any."""
    for _, m, _, _ in _parts(batches):
        gid = _groups(m)
        some = np.flatnonzero((np.bincount(gid)[gid] > 1) | (m["chunks"] > 1))  # others meet nobody
        if not len(some):
            continue
        m, gid = {n: x[some] for n, x in m.items()}, gid[some]
        order = np.arange(len(gid))
        with np.errstate(over="ignore"):
            own = np.sort(mix(gid.astype(np.uint64) * _ODD + m["cls"]))
        if (own[1:] == own[:-1]).any():
            order = np.lexsort((m["line"], m["doc"], m["cls"], gid))
            g, c = gid[order], m["cls"][order]
            order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])]  # each set once, at its first place
        order = order[np.lexsort((m["cls"][order], m["line"][order], m["doc"][order], gid[order]))]
        m, g = {n: x[order] for n, x in m.items()}, gid[order]
        bounds = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g))
        head, rows = np.repeat(bounds[:-1], np.diff(bounds)), np.arange(len(g))
        # sets of other chunks are still to be met
        apart = np.flatnonzero(m["chunks"] > 1)
        out = [[apart], [np.zeros(len(apart), np.uint64)], [np.full(len(apart), -1)], [np.ones(len(apart), bool)]]
        for i, j, margin in find(m, rows, head, rows, head, rows - head):
            if len(i):
                # the widest margin, then the earliest
                lead = np.flatnonzero(np.diff(i, prepend=-1))
                top = np.maximum.reduceat((margin.astype(np.int64) << 32) | (np.int64(0xFFFFFFFF) - j), lead)
                for k, v in enumerate((i[lead], m["cls"][np.int64(0xFFFFFFFF) - (top & np.int64(0xFFFFFFFF))], top >> 32, np.diff(np.append(lead, len(i))) > 1)):
                    out[k].append(v)
        y, x, margin, several = (np.concatenate(v) for v in out)
        asked = np.unique(y)
        keys = np.column_stack([m["cls"][asked], m["key"][asked]]).tobytes()
        # once for each pair
        y = m["cls"][y]
        order = np.lexsort((several, margin, x, y))
        last = order[np.concatenate([(y[order][1:] != y[order][:-1]) | (x[order][1:] != x[order][:-1]), [True]])] if len(order) else order
        columns = [pa.array(y[last].view(np.int64)), pa.array(x[last].view(np.int64)), pa.array(margin[last].astype(np.int32)), pa.array(several[last]), pa.nulls(len(last), pa.binary())]
        names = [n.split()[0] for n in _BEST.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in columns[:4]], pa.array([keys], pa.binary())], names)


def _open_keys(batches: Iterator[pa.RecordBatch], asks) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            pairs = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(pairs[on(asks.value, pairs[:, 0]), 1]).view(np.int64))], ["key"])


def whole_members(dealer: Dealer, m: dict, begin: np.ndarray, tokens: np.ndarray | None, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Deal members with their words (from ``begin`` on in ``tokens``, if given) for ``_rest``. One of a key of several chunks meets
    every chunk, as one to be met (side 0) and, if ``asks``, as one that asks (1); else it is both (2)."""
    n = -(-m["chunks"].astype(np.int64) // MERGED)
    m = m | {"chunk": (m["chunk"] % n).astype(np.int32)}
    for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n * m["size"]) // WORDS)) + 1):
        one, many = at[n[at] == 1], at[n[at] > 1]
        row = np.repeat(many, n[many])
        other = np.arange(len(row)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
        asking = np.flatnonzero(asks[row])
        for own, chunk, kind, meets in (
            (one, m["chunk"][one], 2, np.zeros(len(one), np.int64)),
            (row, m["chunk"][row], 0, other),
            (row[asking], other[asking], 1, m["chunk"][row[asking]].astype(np.int64)),
        ):
            part = {k: v[own] for k, v in m.items()} | {"chunk": chunk.astype(np.int32)}
            yield from dealer.add(part, (meets << 2) | kind, None if tokens is None else tokens[spread(begin[own], m["size"][own])])


def common(tokens: np.ndarray, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common words of each pair of sets; ``tokens`` are numbers below 2**32."""
    out = np.zeros(len(i), np.int64)
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size[i].astype(np.int64) + size[j]) // PAIRS)) + 1):
        both = []
        for side in (i[part], j[part]):
            both.append(np.repeat(part, size[side]) << 32 | tokens[spread(begin[side], size[side])])
        both = np.sort(np.concatenate(both))
        out += np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(i))
    return out


def _meeting(batches: Iterator[pa.RecordBatch], find: Finder, asks) -> Iterator[tuple[dict, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
    """(members, begin, words, i, j) of the groups of each part, j being an earlier candidate of i, which asks; words are
    numbered within the part."""
    for _, m, side, tokens in _parts(batches):
        gid = _groups(m, side >> 2)
        begin = np.cumsum(m["size"], dtype=np.int64) - m["size"]
        order = np.lexsort((m["line"], m["doc"], m["cls"], side & 3, gid))
        g, c, k = gid[order], m["cls"][order], (side & 3)[order]
        order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])])]
        kind, g = (side & 3)[order], gid[order]
        m, begin = {n: x[order] for n, x in m.items()}, begin[order]
        refs = np.flatnonzero(kind != 1)
        asking = np.flatnonzero((kind != 0) & on(asks.value, m["cls"]))
        if not len(refs) or not len(asking):
            continue
        words = None
        count = np.bincount(g[refs], minlength=g[-1] + 1)
        first = np.cumsum(count) - count
        for i, j, _ in find(m, refs, first[g[refs]], asking, first[g[asking]], count[g[asking]]):
            fit = _earlier(m, j, i) & (m["cls"][i] != m["cls"][j])
            if fit.any():
                if words is None and tokens is not None:
                    words = np.unique(tokens, return_inverse=True)[1]
                yield m, begin, words, i[fit], j[fit]


def _classes(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.unique(found).view(np.int64))], ["y"])


def _screened(batches: Iterator[pa.RecordBatch], find: Finder, asks) -> Iterator[pa.RecordBatch]:
    """Sets that ask and have an earlier candidate, and these candidates."""
    for m, _, _, i, j in _meeting(batches, find, asks):
        yield _classes(m["cls"][np.concatenate([i, j])])


def _rest(batches: Iterator[pa.RecordBatch], find: Finder, asks, similarity: float) -> Iterator[pa.RecordBatch]:
    """Sets that ask and that are similar to an earlier one of a group."""
    for m, begin, tokens, i, j in _meeting(batches, find, asks):
        same = common(tokens, begin, m["size"], i, j)
        yield _classes(m["cls"][i[same >= needed(m["size"][i], m["size"][j], similarity)]])


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(y) of the pairs (y, x) whose whole sets are similar. ``sets`` gives (cls, tokens) of the classes in its ``cls``."""
    tokens = sets(pairs.select(F.explode(F.array("y", "x")).alias("cls")).distinct())
    one, two = (tokens.select(F.col("cls").alias(c), F.col("tokens").alias(f"t_{c}")) for c in ("y", "x"))
    both = F.size(F.array_intersect("t_y", "t_x"))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.size("t_y") + F.size("t_x")) - 1e-9)
    out = materialize(pairs.join(one, "y").join(two, "x").where(both >= need).select("y").distinct(), "verified", few=True)
    discard(tokens)
    return out


def later_matches(members: DataFrame, whole: Callable, sets: Callable[[DataFrame], DataFrame], similarity: float, find: Finder, screen: bool = False) -> DataFrame:
    """(cls) of the sets that are similar to an earlier one. ``members``: blobs of all members; ``whole(keys, asks)``: blobs
    of the members under the keys of one broadcast bit table, with their words, of which those in the other ask. With
    ``screen`` these members are first dealt without words, ``whole(keys, asks, None)``, which tells the sets that are
    a candidate or have one; only their words are read and dealt then, ``whole(keys, asks, classes)``."""
    spark = members.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(blobs: DataFrame) -> DataFrame:
        return blobs.repartition(partitions, "part").sortWithinPartitions("part")

    best = materialize(dealt(members).mapInArrow(lambda b: _best(b, find), _BEST), "best", few=True)
    collect_garbage(spark)  # the members' shuffle files
    found = best.where("keys is null")
    fit = F.when(F.col("margin") >= 0, F.col("x"))
    first = found.groupBy("y").agg(F.max(F.struct("margin", "x")).alias("top"), (F.max("several") | F.coalesce(F.min(fit) != F.max(fit), F.lit(False))).alias("more"))
    first = materialize(first, "first-pairs", few=True)
    gone = verified(first.where("top.margin >= 0").select("y", F.col("top.x").alias("x")), sets, similarity)
    asking = materialize(first.where("more").select("y").join(gone, "y", "left_anti"), "asking", few=True)
    if asking.isEmpty():
        discard(best, first, asking)
        out = gone.withColumnRenamed("y", "cls")
        out.scratch_path = gone.scratch_path
        return out
    context = spark.sparkContext
    asks = context.broadcast(bit_table(asking, 6, SEVERAL))
    # written, as two Python steps in one task would take two workers, which stay
    open_keys = materialize(best.where("keys is not null").select("keys").mapInArrow(lambda b: _open_keys(b, asks), "key long"), "open-keys", few=True)
    keys = context.broadcast(bit_table(open_keys, 6, SEVERAL))
    discard(best, first, open_keys)
    wanted = ()
    if screen:
        wanted = (materialize(dealt(whole(keys, asks, None)).mapInArrow(lambda b: _screened(b, find, asks), "y long").distinct(), "screened", few=True),)
    more = dealt(whole(keys, asks, *wanted)).mapInArrow(lambda b: _rest(b, find, asks, similarity), "y long")
    out = materialize(gone.union(more).distinct().select(F.col("y").alias("cls")), "gone", few=True)
    discard(gone, asking, *wanted)
    return out
