"""Components of documents whose sets of word shingles are similar: an exact join by Jaccard similarity.

Documents of equal sets are one node. Two sets link at a similarity of ``percent`` hundredths or more. Pairs are sought in
two steps, and every pair found is verified by intersecting the two sorted arrays of shingle hashes:

1. Leaders: nodes that share a minimal hash are compared with one of them. This joins most near copies in a number of
   pairs that grows with the nodes, not with the square of a group.
2. Tiles: similar sets share a shingle among the first ``size - ceil(percent * size / 100) + 1`` in any common order, so
   nodes meet under these keys; frequent shingles come last in the order. Only nodes of different components need to
   meet, and only within a size band: a tile is a key and a band, cut into blocks that meet two by two where it is
   large. Within a tile, bitmaps decide: each has the parity of the shingles hashed to each bit, so the differing bits
   of two bitmaps are no more than the shingles in one of the sets only, which bounds the overlap from above. No pair
   that is similar fails the bound, so nothing is lost. Keys with the same nodes are one tile. In all rounds but the last
   a tile gives the pairs of a spanning forest only, the closest first, so that loose groups become one component without
   all their pairs; the last round gives every pair that is left. Later rounds look only at tiles that kept pairs back: the
   pairs of all others have been given, or can't be linked, and components only grow.

Which shingles count as frequent only decides the order of keys; at most ``FREQUENT`` of them are taken, the most
frequent ones. Shingles and nodes are told apart by 64-bit hashes. Null texts and texts without words have the empty set
and link with nothing. Rows that repeat a doc_id are rows of their own, linked by their texts like others; rows
without doc_id never name a component unless all its rows lack it. Other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.bits import bit_table, on
from trajspark.llm.components import connected_components
from trajspark.llm.shingles import _class, shingle_sets
from trajspark.llm.simhash_dedup import spanning
from trajspark.llm.textbuf import mix
from trajspark.session import discard, materialize

SIZE, PERCENT, LEADERS = 5, 80, 3
#: Rounds of tiles that give forests, before the one that gives all pairs.
FORESTS = 1
#: Shingles that come last in the order of keys, at most: 8 MB.
FREQUENT = 1_000_000
#: Documents from which on a shingle is frequent.
LEAST = 48
#: Members of a tile's block.
BLOCK = 2048
#: Shingles or keys that a task holds before it sorts or sends them.
HELD = 1 << 21
_TURN = np.random.default_rng(11).integers(0, 1 << 63, LEADERS, dtype=np.uint64)
_ODD = np.random.default_rng(12).integers(0, 1 << 62, LEADERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc long, node long, size int, mins binary, bits binary, often binary, counts binary"
_NO_DOC = -(1 << 63)
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("band", pa.int32())])


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of a and b members."""
    return -(-percent * (a + b) // (100 + percent))


def parity_bits(own: np.ndarray) -> bytes:
    """One to two bits a shingle, 64 at least. They travel with every member of a tile, and are most of what does."""
    n = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own * _ODD[0] >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1, bitorder="little").tobytes()


def folded(raw: list[bytes]) -> np.ndarray:
    """Bitmaps of the shortest one's length: the halves of longer ones add up to what the shorter length would have given."""
    n = min(map(len, raw))
    rows = np.zeros((len(raw), n >> 3), np.uint64)
    for i, x in enumerate(raw):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, n >> 3), axis=0)
    return rows


class Often:
    """Counts of frequent shingles of a task, by lossy counting: after each batch, what is rarer than once a batch goes."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held, self.n, self.rounds, self.docs = [], 0, 0, 0

    def add(self, own: np.ndarray) -> None:
        self.held.append(own)
        self.docs += 1
        self.n += len(own)
        if self.n > HELD:
            self.flush()

    def flush(self) -> None:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]), return_counts=True)
        keep = counts > 1
        both = np.concatenate([self.keys, keys[keep]])
        self.keys, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts[keep]]), len(self.keys)).astype(np.int64)
        self.rounds += 1
        keep = self.counts > self.rounds
        self.keys, self.counts, self.held, self.n = self.keys[keep], self.counts[keep], [], 0

    def rows(self) -> tuple[bytes, bytes]:
        self.flush()
        keep = self.counts >= max(3, self.docs // 2000)
        return self.keys[keep].tobytes(), self.counts[keep].tobytes()


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    often, names = Often(), [x.split()[0] for x in _SIGNED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    for b in batches:
        node, sizes, mins, bits = [], [], [], []
        for own in shingle_sets(b.column(1), size):
            often.add(own)
            node.append(_class(own))
            sizes.append(len(own))
            mins.append(mix(np.array([((own ^ t) * o).min() + np.uint64(k) for k, (t, o) in enumerate(zip(_TURN, _ODD))])).tobytes() if len(own) else b"")
            bits.append(parity_bits(own) if len(own) else b"")
        columns = [b.column(0).to_pylist(), np.array(node, np.uint64).view(np.int64), sizes, mins, bits, [None] * len(sizes), [None] * len(sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, -1, None, None, *often.rows()], kinds)], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (keys, counts)], ["key", "n"])


def frequent(signed: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent shingles."""
    counts = signed.where("size < 0").select("often", "counts").mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _has(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), bool)


def _of(b: pa.RecordBatch, docs: np.ndarray) -> pa.RecordBatch:
    """Rows whose doc_id may be in the table, and those without one."""
    own = b.column(0).fill_null(_NO_DOC).to_numpy()
    return b.filter(pa.array(on(docs, own) | (own == _NO_DOC)))


def _keys(batches: Iterator[pa.RecordBatch], size: int, percent: int, docs, often, ranges: int) -> Iterator[pa.RecordBatch]:
    """Keys and nodes in blobs by range of the key; keys that are frequent shingles in blobs of ranges beyond, dealt anyhow."""
    held: list[tuple[np.ndarray, np.uint64]] = []
    n = sent = 0

    def blobs() -> pa.RecordBatch:
        nonlocal sent
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in held]])
        nodes = np.repeat(np.array([x for _, x in held], np.uint64), [len(k) for k, _ in held])
        hot = _has(often.value, keys)
        part = (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
        sent += 1
        part[hot] = ranges + (np.arange(int(hot.sum())) // 50_000 + sent * 7919) % ranges
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order], prepend=-1))
        raws = [[x[order[a:z]].tobytes() for a, z in zip(cut, [*cut[1:], len(order)])] for x in (keys, nodes)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(part[order[cut]], pa.int32()), *[pa.array(x, pa.binary()) for x in raws]], ["part", "keys", "nodes"])

    for b in batches:
        for own in shingle_sets(_of(b, docs.value).column(1), size):
            length = len(own) - -(-percent * len(own) // 100) + 1
            if len(own):
                last = _has(often.value, own)
                keys = own[~last][:length]
                held.append((np.concatenate([keys, own[last][: length - len(keys)]]), _class(own)))
                n += length
        if n > HELD // 2:
            yield blobs()
            n = 0
    yield blobs()


def _shared(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(key, node, often) of keys of several nodes, and of all frequent ones, which may repeat. A range at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = -1

    def several() -> pa.RecordBatch:
        keys, nodes = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in held]]) for k in (0, 1))
        held.clear()
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        keep = same[1:] | same[:-1]
        return rows(keys[keep], nodes[keep], False)

    def rows(keys: np.ndarray, nodes: np.ndarray, often: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(np.full(len(keys), often))], ["key", "node", "often"])

    for b in batches:
        for part, keys, nodes in zip(*(c.to_pylist() for c in b.columns)):
            keys, nodes = (np.frombuffer(x, np.int64) for x in (keys, nodes))
            if part != last and held:
                yield several()
            last = part
            if part >= ranges:
                yield rows(keys, nodes, True)
            else:
                held.append((keys, nodes))
    yield several()


def slack(sizes: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How far the bitmaps of the pairs (a, b) of members stay below the most bits in which those of linked sets can
    differ; negative if the pair can't be linked."""
    total = sizes[a] + sizes[b]
    apart = total - 2 * needed(sizes[a], sizes[b], percent)
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    at = np.flatnonzero(fits)
    out = np.full(len(a), -1, np.int64)
    out[at] = apart[at] - np.bitwise_count(bits[a[at]] ^ bits[b[at]]).sum(1, dtype=np.int64)
    return out


def forest(comp: np.ndarray, a: np.ndarray, b: np.ndarray, slacks: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) join what all of them join: each component takes its pair of most slack, again and again."""
    root, keep = np.unique(comp, return_inverse=True)[1], np.zeros(len(a), bool)
    order = np.argsort(-slacks, kind="stable")
    a, b = a[order], b[order]
    while True:
        one, two = root[a], root[b]
        apart = np.flatnonzero(one != two)
        if not len(apart):
            return keep
        ends = np.stack([one[apart], two[apart]], 1).ravel()
        best = apart[np.unique(ends, return_index=True)[1] >> 1]
        keep[order[best]] = True
        root = spanning(int(root.max()) + 1, one[best], two[best])[root]


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may be linked, of (a, b, size_a, size_b, bits_a, bits_b)."""
    for batch in batches:
        sizes = np.column_stack([batch.column(k).to_numpy() for k in (2, 3)]).astype(np.int64)
        raw = [batch.column(k).to_pylist() for k in (4, 5)]
        keep = [slack(s, folded([x, y]), np.array([0]), np.array([1]), percent)[0] >= 0 for s, x, y in zip(sizes, *raw)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tiles(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may be linked, of the runs of (tile, side, own, node, comp, size, bits, key, band): members of side
    0 meet those of side 1, or one another where all have side 0. Without ``every``, those of a spanning forest, and
    (key, band) of the tiles that keep pairs back."""
    held: list[tuple] = []
    found: list[np.ndarray] = []
    back: set[tuple[int, int]] = set()

    def meet() -> None:
        side, own, node, comp, size = (np.array([r[k] for r in held], np.int64) for k in range(1, 6))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right) and len(left) < 2:
            return
        bits = folded([r[6] for r in held])
        near: list[tuple] = []
        step = max(1, (2 << 20) // (bits.shape[1] * max(len(left), len(right))))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            b = right if len(right) else left[at:]
            one, two = (x.ravel() for x in np.meshgrid(rows, b, indexing="ij"))
            keep = (comp[one] != comp[two]) & (own[one] + own[two] > 0)
            keep &= (one < two) | bool(len(right))
            one, two = one[keep], two[keep]
            over = slack(size, bits, one, two, percent)
            near.append(tuple(x[over >= 0] for x in (one, two, over)))
        one, two, over = (np.concatenate(x) for x in zip(*near))
        if not every and len(one) > 1:
            keep = forest(comp, one, two, over)
            if not keep.all():
                back.update((r[7], r[8]) for r in held)
            one, two = one[keep], two[keep]
        if len(one):
            found.append(np.column_stack([node[one], node[two]]))

    def batch() -> pa.RecordBatch:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        found.clear()
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        rows = [*((a, b, None, None) for a, b in pairs.tolist()), *((None, None, *x) for x in back)]
        back.clear()
        return pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in rows], _FOUND)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][0] != row[0]:
                meet()
                held = []
            held.append(row)
        if sum(map(len, found)) + len(back) > 100_000:
            yield batch()
    if held:
        meet()
    yield batch()


def _arrays(batches: Iterator[pa.RecordBatch], size: int, docs) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(shingle_sets(_of(b, docs.value).column(1), size))
        node = np.array([_class(x) for x in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
            both = int(_has(y, x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Search:
    """What the two steps share: the texts, the nodes (node, least, size, mins, bits) and how pairs are verified."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text"))
        self.size, self.percent, self.context = size, percent, docs.sparkSession.sparkContext
        self.partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.signed = materialize(self.docs.mapInArrow(lambda b: _signed(b, size), _SIGNED), "jaccard-signed")
        rows = self.signed.where("size > 0").groupBy("node").agg(F.min("doc").alias("least"), F.min(F.struct("size", "mins", "bits")).alias("own"))
        self.nodes = materialize(rows.select("node", "least", "own.*"), "jaccard-nodes")

    def places(self, nodes: DataFrame):
        return self.context.broadcast(bit_table(nodes.where("least is not null").select("least")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialize(self.nodes.select("node", "least").join(wanted, "node", "left_semi"), "jaccard-wanted")
        docs, size, percent = self.places(wanted), self.size, self.percent
        found = self.docs.mapInArrow(lambda b: _arrays(b, size, docs), "node long, tokens binary").join(wanted.select("node"), "node", "left_semi")
        arrays = materialize(found.dropDuplicates(["node"]), "jaccard-arrays")
        sides = [arrays.select(F.col("node").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in "ab"]
        both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "tokens_a", "tokens_b")
        links = materialize(both.mapInArrow(lambda x: _verified(x, percent), "a long, b long"), "jaccard-links")
        discard(wanted, arrays)
        docs.destroy()
        return links

    def leader_pairs(self) -> DataFrame:
        """(a, b): nodes of one minimal hash with the least of them, as far as bitmaps allow."""
        percent = self.percent
        keyed = self.nodes.select("node", F.explode(F.array(*[F.substring("mins", 8 * k + 1, 8) for k in range(LEADERS)])).alias("key"))
        leaders = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("key", "a")
        pairs = keyed.join(leaders, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
        sides = [self.nodes.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab"]
        both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
        return materialize(both.mapInArrow(lambda x: _bounded(x, percent), "a long, b long"), "jaccard-pairs")

    def shared_keys(self) -> DataFrame:
        """(key, node) of the keys that several nodes have, one of the keys that have the same nodes."""
        ranges = 1 << (4 * self.partitions - 1).bit_length()
        docs, often = self.places(self.nodes), self.context.broadcast(frequent(self.signed))
        size, percent = self.size, self.percent
        blobs = self.docs.mapInArrow(lambda b: _keys(b, size, percent, docs, often, ranges), "part int, keys binary, nodes binary")
        blobs = blobs.repartition(self.partitions, "part").sortWithinPartitions("part")
        found = materialize(blobs.mapInArrow(lambda b: _shared(b, ranges), "key long, node long, often boolean"), "jaccard-keys")
        docs.destroy(), often.destroy()
        keys = found.where("not often").select("key", "node").union(found.where("often").select("key", "node").distinct())
        own = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"own{k}") for k in (1, 2)]
        kinds = keys.groupBy("key").agg(*own, F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("own1", "own2", "n").agg(F.min("key").alias("key"))
        out = materialize(keys.join(kinds.select("key"), "key", "left_semi"), "jaccard-keys")
        discard(found)
        return out

    def tile_pairs(self, keys: DataFrame, comps: DataFrame, every: bool, back: DataFrame | None = None) -> DataFrame:
        """(a, b, key, band): nodes (a, b) of different components (node, root) that meet in a tile, as far as bitmaps allow,
        and tiles (key, band) that keep pairs back. ``back``: the only tiles to look at."""
        percent = self.percent
        info = self.nodes.select("node", "size").join(comps, "node", "left").select("node", "size", F.coalesce("root", "node").alias("comp"))
        member = (keys if back is None else keys.join(back.select("key"), "key", "left_semi")).join(info, "node")
        # a little over the widest ratio of linked sizes, so that rounding can't put linked sizes two bands apart
        band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(101 / percent))).cast("int")
        mixed = member.groupBy("key").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).where("one < two").select("key")
        member = member.join(mixed, "key", "left_semi").withColumn("own", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("band", band + F.col("own") - 1)
        if back is not None:
            member = member.join(back, ["key", "band"], "left_semi")
        member = materialize(member, "jaccard-members")
        by_comp = member.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
        tiles = by_comp.groupBy("key", "band").agg(F.max_by("comp", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.max("own").alias("own"))
        blocks = [F.ceil(n / BLOCK).cast("int").alias(k) for n, k in ((F.col("n_main"), "mains"), (F.col("n_all") - F.col("n_main"), "others"))]
        tiles = tiles.where("own = 1 and n_main < n_all").select("key", "band", "main", *blocks)
        dealt = member.join(tiles, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.expr("comp = main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
        # blocks of the largest component meet those of the others, these meet one another too
        block, upto = F.col("block"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        spot = lambda kind, one, two, side: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.alias("side"))
        to_others = F.transform(upto("others"), lambda k: spot(0, block, k, F.lit(0)))
        to_mains = F.transform(upto("mains"), lambda k: spot(0, k, block, F.lit(1)))
        between = F.transform(upto("others"), lambda k: spot(1, F.least(k, block), F.greatest(k, block), F.when(k < block, 1).otherwise(0)))
        spread = dealt.withColumn("m", F.explode(F.when(F.expr("comp = main"), to_others).otherwise(F.concat(to_mains, between))))
        spread = spread.select(F.struct("key", "band", "m.kind", "m.one", "m.two").alias("tile"), "m.side", "own", "node", "comp", "size", "key", "band")
        spread = spread.withColumn("tile", F.xxhash64("tile")).join(self.nodes.select("node", "bits"), "node")
        rows = spread.select("tile", "side", "own", "node", "comp", "size", "bits", "key", "band").repartition(self.partitions, "tile").sortWithinPartitions("tile")
        pairs = materialize(rows.mapInArrow(lambda b: _tiles(b, percent, every), "a long, b long, key long, band int").distinct(), "jaccard-pairs")
        discard(member)
        return pairs


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) with those joined that the links (a, b) join. Nodes without links don't appear."""
    for k in "ab":
        links = links.join(comps.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left").withColumn(k, F.coalesce(f"root_{k}", k)).select("a", "b")
    joined = connected_components(links)
    roots = comps.join(joined.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return materialize(roots.union(joined.join(comps.select("node"), "node", "left_anti")), "jaccard-comps")


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, the own included) of every row."""
    search = Search(docs, size, percent)
    pairs = search.leader_pairs()
    comps = materialize(connected_components(search.verified(pairs)), "jaccard-comps")
    keys = search.shared_keys()
    discard(pairs)
    found, back = [], None
    for k in range(FORESTS + 1):
        found.append(search.tile_pairs(keys, comps, k == FORESTS, back))
        pairs, back = found[-1].where("key is null").select("a", "b"), found[-1].where("key is not null").select("key", "band")
        if pairs.isEmpty():
            break
        comps = merged(comps, search.verified(pairs))
        if back.isEmpty():
            break
    rooted = materialize(search.nodes.select("node", "least").join(comps, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "jaccard-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    component = materialize(rooted.join(smallest, "root").select("node", "component"), "jaccard-components")
    discard(*found, keys, comps, rooted, search.nodes)
    signed = search.signed.where("size >= 0").select("doc", "node", "size")
    return signed.join(component, "node", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id")
    )
