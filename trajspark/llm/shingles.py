"""Near copies of documents by five-word shingles: those similar to an earlier document go.

A document is the set of its shingles of ``size`` words (lower case); one of fewer words is one shingle. It goes if an
earlier document, by doc_id, has the same set or one of Jaccard similarity ``similarity`` or more; whether that one goes
too does not matter. So the first of each group of near copies stays.

SimHash fingerprints of the shingles are searched by BK-trees, one for each shard. At a similarity of 0.8 fingerprints
differ by 10 of 64 bits on average, which no block of bits survives, so shards are bands of minimal hashes: similar
documents share one of ``BANDS`` bands of ``ROWS`` but for 4 pairs in 10,000 at 0.8, fewer above; and of those within
``RADIUS`` bits but for 2. What a tree finds is compared by whole sets (see ``matches``, also for crowded shards).

Null texts and texts without words all have the empty set. Rows without doc_id come last. Rows of equal doc_id are in
the order of a hash of their texts; of rows equal in both, one stays. Columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.bits import SEVERAL, bit_table, on
from trajspark.llm.linededup import _LAST, RANGE_BITS, Keys, Seen, _addressed, addresses, shared_keys
from trajspark.llm.matches import BLOBS, LIMIT, Dealer, later_matches, part_bits, tree_finder, whole_members
from trajspark.llm.textbuf import Words, chunks, mix
from trajspark.session import discard, materialize

SIZE, SIMILARITY, BANDS, ROWS, RADIUS = 5, 0.8, 20, 5, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    for first, last, data, offsets in chunks(column):
        words = Words(data, offsets)
        h = words.hash()
        with np.errstate(over="ignore"):
            key = np.full(max(0, len(h) - size + 1), np.uint64(size))
            for k in range(size):
                key = mix(key * _ODD + h[k : k + len(key)])
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(key[a : b - size + 1])
            else:
                one = np.full(min(1, b - a), np.uint64(b - a))
                with np.errstate(over="ignore"):
                    for k in range(a, b):
                        one = mix(one * _ODD + h[k])
                yield one


def _class(own: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]


_DRAW = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_TURN, _TIMES = _DRAW[0], _DRAW[1] * np.uint64(2) + np.uint64(1)


def bands(own: np.ndarray) -> np.ndarray:
    """Keys of the bands of minimal hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 512):
            least = np.minimum(least, ((own[at : at + 512, None] ^ _TURN) * _TIMES).min(0))
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * _ODD + least.reshape(BANDS, ROWS)[:, r])
    return key


def fingerprint(own: np.ndarray) -> np.uint64:
    """SimHash of a set: each bit by the majority of the shingles' hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(own), 100_000):
        total += np.unpackbits(own[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(own), bitorder="little").view("<u8")[0]


_SIGNED = "doc long, tie long, place long, cls long, size int, print long, keys binary"


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, ties = (b.column(k).to_numpy() for k in (0, 1))
        cls, sizes, prints, keys = [], [], [], []
        for own in shingle_sets(b.column(2), size):
            cls.append(_class(own))
            sizes.append(len(own))
            prints.append(fingerprint(own))
            keys.append(bands(own).tobytes() if len(own) else b"")
        place = addresses(docs, ties, np.zeros(len(docs), np.int64)).view(np.int64)
        wide = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, prints)]
        columns = [b.column(0), b.column(1), pa.array(place), wide[0], pa.array(sizes, pa.int32()), wide[1], pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SIGNED.split(", ")])


def _of_firsts(b: pa.RecordBatch, firsts: np.ndarray | tuple) -> dict:
    """Members under all keys, of the first document of each class (and some others, maybe)."""
    b = b.filter(pa.array(on(firsts, b.column(2).to_numpy())))
    raw = b.column(6).to_pylist()
    n = np.array([len(x) >> 3 for x in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), n)
    doc, cls, size, prints = (b.column(k).to_numpy()[row] for k in (0, 3, 4, 5))
    zero = np.zeros(len(row), np.int64)
    return {"key": np.frombuffer(b"".join(raw), np.uint64), "cls": cls.view(np.uint64), "doc": doc, "p1": prints.view(np.uint64), "p2": zero.view(np.uint64), "line": zero, "size": size, "pos": zero, "row": row}


def _dealt(m: dict, known: Keys) -> dict:
    own = known.shared(m["key"])
    m = {n: v[own] for n, v in m.items()}
    m["chunks"] = known.dealt(m["key"])
    m["chunk"] = (mix(m["cls"]) % m["chunks"].astype(np.uint64)).astype(np.int32)
    return m


def _reports(batches: Iterator[pa.RecordBatch], firsts, range_bits: int) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for b in batches:
        seen.add(_of_firsts(b, firsts.value)["key"])
    part, raw, counts = seen.rows(range_bits)
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw, pa.binary()), pa.array(counts, pa.binary())], ["part", "gaps", "counts"])


def _postings(batches: Iterator[pa.RecordBatch], firsts, known, bits: int) -> Iterator[pa.RecordBatch]:
    dealer = Dealer(bits)
    for b in batches:
        yield from dealer.add(_dealt(_of_firsts(b, firsts.value), known.value))
    yield from dealer.rows()


def _whole(batches: Iterator[pa.RecordBatch], size: int, places, known, keys, asks, bits: int) -> Iterator[pa.RecordBatch]:
    """Members under the keys of a table, with their shingles, of the texts at ``places``."""
    dealer = Dealer(bits)
    for b in batches:
        b = b.filter(pa.array(on(places.value, addresses(b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64)))))
        for signed in _signed(iter([b]), size):
            sets = list(shingle_sets(b.column(2), size))
            m = _dealt(_of_firsts(signed, np.full(1 << 13, 255, np.uint8)), known.value)
            some = on(keys.value, m["key"])
            m = {n: v[some] for n, v in m.items()}
            lengths = np.array([len(x) for x in sets], np.int64)
            begin = np.cumsum(lengths) - lengths
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            yield from whole_members(dealer, m, begin[m["row"]], tokens, on(asks.value, m["cls"]))
    yield from dealer.rows()


def _under(batches: Iterator[pa.RecordBatch], firsts, keys) -> Iterator[pa.RecordBatch]:
    """Places of the documents that have a key of a table."""
    for b in batches:
        m = _of_firsts(b, firsts.value)
        cls = np.unique(m["cls"][on(keys.value, m["key"])])
        own = np.isin(b.column(3).to_numpy().view(np.uint64), cls)
        yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array(own))], ["place"])


def _tokens(batches: Iterator[pa.RecordBatch], size: int, wanted) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(pa.array(on(wanted.value, addresses(b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, np.int64)))))
        sets = list(shingle_sets(b.column(2), size))
        cls = np.array([_class(x) for x in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["cls", "tokens"])


def later_copies(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """(doc, tie) of the documents that go, as ``linededup._addressed`` names them."""
    spark, docs = docs.sparkSession, _addressed(docs)
    context, partitions = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_bits, bits = max(RANGE_BITS, (4 * partitions).bit_length()), part_bits(partitions)
    signed = materialize(docs.mapInArrow(lambda b: _signed(b, size), _SIGNED), "shingles")
    classes = materialize(signed.groupBy("cls").agg(F.min(F.struct("doc", "tie", "place")).alias("first"), F.count(F.lit(1)).alias("n")), "shingle-classes", few=True)
    firsts = context.broadcast(bit_table(classes.select("first.place"), 6, SEVERAL))
    known = context.broadcast(shared_keys(signed.mapInArrow(lambda b: _reports(b, firsts, range_bits), "part int, gaps binary, counts binary"), partitions, range_bits, limit))

    def whole(keys, asks) -> DataFrame:
        # written, as two Python steps in one task would take two workers, which stay
        under = materialize(signed.mapInArrow(lambda b: _under(b, firsts, keys), "place long"), "under", few=True)
        places = context.broadcast(bit_table(under, 6, SEVERAL))
        discard(under)
        return docs.mapInArrow(lambda b: _whole(b, size, places, known, keys, asks, bits), BLOBS)

    def sets(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted, "wanted", few=True)
        marked = context.broadcast(bit_table(classes.join(wanted, "cls", "left_semi").select("first.place"), 6, SEVERAL))
        found = docs.mapInArrow(lambda b: _tokens(b, size, marked), "cls long, tokens array<long>")
        out = materialize(found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens")), "shingle-sets", few=True)
        discard(wanted)
        return out

    members = signed.mapInArrow(lambda b: _postings(b, firsts, known, bits), BLOBS)
    gone = later_matches(members, whole, sets, similarity, tree_finder(RADIUS))
    affected = classes.join(gone.withColumn("gone", F.lit(True)), "cls", "left").where("gone or n > 1")
    joined = signed.select("doc", "tie", "cls").join(affected, "cls")
    out = materialize(joined.where("gone or doc <> first.doc or tie <> first.tie").select("doc", "tie").distinct(), "near-copies", few=True)
    out.repeats = not signed.groupBy("doc", "tie").count().where("count > 1").isEmpty()
    discard(signed, classes, gone)
    return out


def keep_first_similar(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those similar to an earlier one."""
    gone = later_copies(docs, size, similarity)
    taken = {c.lower() for c in docs.columns}
    doc, tie, nth = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("doc", "tie", "nth"))
    joined = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(tie, F.xxhash64(F.col("text").cast("string")))
    joined = joined.join(gone.select(F.col("doc").alias(doc), F.col("tie").alias(tie)), [doc, tie], "left_anti")
    if gone.repeats:
        joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(doc, tie).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return joined.select(docs.columns)
