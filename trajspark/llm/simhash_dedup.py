"""SimHash near-duplicates: fingerprints of 3-word shingles, linked within a Hamming radius by BK-trees.

Fingerprints go into shards in which all linked pairs meet (see ``shards``). In each shard chunk a BK-tree is built,
children keyed by their integer distance to the parent, and its other members walk it along edges within the radius
only. A shard reports the links that join its members, not all pairs. Trees over all fingerprints would have no size
bound, so none is broadcast whole: each shard's tree goes to the tasks whose queries can meet it.

Null texts and texts without words have fingerprint 0 and link like any other. Equal texts share one fingerprint, which
enters the trees once. Repeated rows keep a row each. Columns other than ``doc_id`` and ``text`` are left aside. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.components import connected_components
from trajspark.llm.shards import LIMIT, meeting_groups, popcount, runs
from trajspark.session import materialize

SHINGLE, SEED, RADIUS = 3, 42, 2


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64 bits: bit k is set if it is in over half of the shingles' XXH64. Shingles count as often as they occur."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 200_000):
        part = h[at : at + 200_000]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([simhash(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Children of a node by their distance to it. Built and searched level by level for many values at once. With
    ``root``, the place of the first of each value's group, it is a forest of a tree for each group."""

    def __init__(self, values: np.ndarray, root: np.ndarray | None = None):
        self.values = values
        n = len(values)
        self.child = np.full((n, 65), -1, np.int32)
        node = np.zeros(n, np.int64) if root is None else root.astype(np.int64)
        waiting = np.flatnonzero(node != np.arange(n))
        node = node[waiting]
        flat = self.child.reshape(-1)
        while len(waiting):
            distance = popcount(values[waiting] ^ values[node]).astype(np.int64)
            slot = node * 65 + distance
            # the first to come takes a free edge, the others go down it
            free = flat[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            flat[taken] = waiting[free][first]
            down = flat[slot]
            stay = down != waiting
            waiting, node = waiting[stay], down[stay].astype(np.int64)

    def within(self, queries: np.ndarray, radius: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of the query, position of the value) of all pairs within ``radius``. ``start``: each query's root."""
        found = []
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64) if start is None else start.astype(np.int64)
        if not len(self.values):
            return q[:0], node[:0]
        while len(q):
            distance = popcount(queries[q] ^ self.values[node]).astype(np.int64)
            hit = distance <= radius
            found.append((q[hit], node[hit]))
            next_q, next_node = [], []
            for edge in range(-radius, radius + 1):
                d = distance + edge
                ok = (d >= 0) & (d <= 64)
                down = self.child[node[ok], d[ok]]
                there = down >= 0
                next_q.append(q[ok][there])
                next_node.append(down[there].astype(np.int64))
            q, node = np.concatenate(next_q), np.concatenate(next_node)
        return np.concatenate([x for x, _ in found] or [q]), np.concatenate([x for _, x in found] or [node])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` members reaches over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    a, b = [], []

    def batch() -> pa.RecordBatch:
        out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        a.clear(), b.clear()
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], ["a", "b"])

    for _, one, two in runs(batches):
        same = two is one or np.array_equal(one, two)
        tree = BKTree(one)
        members = one if same else np.concatenate([one, two])
        # a bounded set of queries at a time
        pairs = []
        for at in range(0, len(two), 512):
            q, v = tree.within(two[at : at + 512], radius)
            pairs.append((q + at + (0 if same else len(one)), v))
        q, v = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        apart = q != v
        if not apart.any():
            continue
        root = spanning(len(members), q[apart], v[apart])
        hang = root != np.arange(len(members))
        a.append(members[hang].view(np.int64))
        b.append(members[root[hang]].view(np.int64))
        if sum(map(len, a)) > 50_000:
            yield batch()
    yield batch()


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` that join all within ``radius`` of one another."""
    groups = meeting_groups(distinct, radius, limit)
    return groups.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, the own included."""
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), radius, limit))
    rooted = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    joined = rooted.where("fp <> root").select("root").distinct()
    # only components of several fingerprints need their smallest document looked up
    several = rooted.join(joined, "root", "left_semi")
    smallest = several.groupBy("root").agg(F.min("least").alias("smallest"))
    component = rooted.join(smallest, "root", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
