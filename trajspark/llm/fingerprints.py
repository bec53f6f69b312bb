"""Document fingerprints: SimHash of weighted terms, each document beside an edited copy and its successor.

Terms are words in lower case and pairs of neighbouring words; a term votes once per occurrence, a pair with double
weight. A fingerprint has 128 bits (32 hex digits): bit k is set if the weights of terms whose hash has bit k outweigh
those without it. Likeness is the share of equal bits.

Documents are laid out in descending doc_id over blocks of ids, one shuffle of the texts in all; a block's first
document also goes to the block before it, which needs its beginning.

Permuted block tables find neighbours over all documents (``n_near``: other distinct fingerprints within
``WIDE_RADIUS`` bits): with radius r, two fingerprints agree on one of r + 1 blocks, so each block's
bits are moved to the front and documents meet those of equal front (see ``shards``); chunks of a crowded front meet
pairwise in separate tasks.

Null texts count as empty; a text without words has the fingerprint of no votes, all zero. Rows of equal doc_id follow
each other by text; a null doc_id comes last. A single document is its own successor. Columns other than ``doc_id`` and
``text`` are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.shards import LIMIT, WIDE_RADIUS, first_block, meeting_groups, popcount, runs, wide_groups
from trajspark.llm.textbuf import Words, chunks, mix
from trajspark.session import materialize

BITS = 128
_ONE = np.uint64(0x9E3779B97F4A7C15)


def votes(column) -> np.ndarray:
    """Fingerprints of an Arrow column of texts, as rows of 16 bytes."""
    out = []
    for _, _, data, offsets in chunks(column, 1 << 20):
        words = Words(data, offsets)
        h = words.hash()
        total = np.zeros((len(offsets) - 1, BITS), np.int64)
        if len(h):
            with np.errstate(over="ignore"):
                pair = mix(h[:-1] * _ONE + h[1:])
            for i in range(len(total)):
                a, b = words.bounds[i], words.bounds[i + 1]
                for terms, weight in ((h[a:b], 1), (pair[a : b - 1] if b > a else pair[:0], 2)):
                    for at in range(0, len(terms), 100_000):
                        total[i] += weight * _balance(terms[at : at + 100_000])
        out.append(np.packbits(total > 0, axis=1))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def _balance(terms: np.ndarray) -> np.ndarray:
    """Votes for less votes against each bit."""
    wide = np.stack([terms, mix(terms ^ _ONE)], 1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    return 2 * bits.sum(axis=0, dtype=np.int64) - len(terms)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block follow each other in descending order, the guest last."""
    held: tuple | None = None
    ready: list[tuple[int | None, str, str]] = []

    def batch() -> pa.RecordBatch:
        docs, texts, following = zip(*ready)
        ready.clear()
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, following)]
        own, other, after = (votes(pa.array(x, pa.string())) for x in (texts, edited, following))
        hexed = [[r.tobytes().hex() for r in x] for x in (own, other)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
                pa.array(hexed[0]),
                pa.array(hexed[1]),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, after)),
                *[pa.array(np.ascontiguousarray(own[:, k : k + 8]).view(">i8").reshape(-1).astype(np.int64)) for k in (0, 8)],
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"],
        )

    size = 0
    for b in batches:
        for block, guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            if held and held[0] == block:
                ready.append((held[1], held[2], text))
                size += len(text)
                if size > 2 << 20 or len(ready) >= 5000:
                    yield batch()
                    size = 0
            held = None if guest else (block, doc, text)
    if ready:
        yield batch()


def successors(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, guest, doc_id, text), laid out for ``_rows``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = docs.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    # block 0 has the largest ids; the number of cuts at or above an id is its block
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    block = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(edges, lambda c: c >= F.col("doc_id"))))
    heads = docs.select("doc_id").withColumn("block", block).groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    # at most ``blocks`` rows; a block's head is a guest of the block before it, the first head one of the last block
    to = {h["head"]: heads[i - 1]["block"] for i, h in enumerate(heads)}
    docs = docs.withColumn("block", block)
    target = F.create_map(*[x for h, b in to.items() if h is not None for x in (F.lit(h), F.lit(b))]) if any(h is not None for h in to) else None
    stay = docs.select("block", F.lit(False).alias("guest"), "doc_id", "text")
    if target is None:  # no row has a doc_id: they all are in one block, whose first row follows the last
        guests = docs.select("block", F.lit(True).alias("guest"), "doc_id", "text").orderBy(F.xxhash64("text"), "text").limit(1)
        out = stay.union(guests)
    else:
        leads = F.col("doc_id").isin([h for h in to if h is not None])
        both = F.when(
            leads,
            F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("g")), F.struct(target[F.col("doc_id")].alias("b"), F.lit(True).alias("g"))),
        ).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("g"))))
        out = docs.select(F.explode(both).alias("x"), "doc_id", "text").select(F.col("x.b").alias("block"), F.col("x.g").alias("guest"), "doc_id", "text")
    order = ["block", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    return out.repartition("block").sortWithinPartitions(*order)


def fingerprint_documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row."""
    blocks = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = successors(docs, blocks).mapInArrow(
        _rows,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long",
    )
    rows = materialize(rows, "fingerprint-rows")
    near = count_wide_neighbours(rows.select("hi", "lo").distinct())
    return rows.join(near, ["hi", "lo"], "left").drop("hi", "lo").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def _neighbours(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for block, one, two in runs(batches):
        n_one, n_two = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        for at in range(0, len(one), 256):
            part = one[at : at + 256, None]
            near = (popcount(part ^ two[None]) <= radius) & (part != two[None])
            i, j = np.nonzero(near)
            first = first_block(part[i, 0], two[j], radius) == block
            n_one += np.bincount(i[first] + at, minlength=len(one))
            n_two += np.bincount(j[first], minlength=len(two))
        same = len(one) == len(two) and np.array_equal(one, two)
        values, n = (one, n_one) if same else (np.concatenate([one, two]), np.concatenate([n_one, n_two]))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some])], ["fp", "n"])


def count_neighbours(distinct: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """(fp, n_near): for each distinct 64-bit ``fp``, how many others lie within ``radius``; those without any don't
    appear. No row is made per pair."""
    return (
        meeting_groups(distinct, radius, limit).mapInArrow(lambda b: _neighbours(b, radius), "fp long, n long")
        .groupBy("fp").agg(F.sum("n").alias("n_near"))
    )


def _wide_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, one, two in runs(batches):
        same = np.array_equal(one, two)
        n_one, n_two = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        for at in range(0, len(one), 256):
            apart = one[at : at + 256, None] ^ two[None]
            distance = np.bitwise_count(apart).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero((distance <= WIDE_RADIUS) & (distance > 0))
            apart = apart[i, j]
            halves = np.stack([apart[:, 0] >> np.uint64(32), apart[:, 0] & _HALF, apart[:, 1] >> np.uint64(32), apart[:, 1] & _HALF], 1)
            first = (halves == 0).argmax(1) == block  # a pair counts only in the first block on which it agrees
            n_one += np.bincount(i[first] + at, minlength=len(one))
            n_two += np.bincount(j[first], minlength=len(two))
        values, n = (one, n_one) if same else (np.concatenate([one, two]), np.concatenate([n_one, n_two]))
        some = n > 0
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(values[some, k]).view(np.int64)) for k in (0, 1)], pa.array(n[some])], ["hi", "lo", "n"])


_HALF = np.uint64(0xFFFFFFFF)


def count_wide_neighbours(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(hi, lo, n_near), as ``count_neighbours``, for distinct fingerprints of 128 bits within ``WIDE_RADIUS``."""
    return wide_groups(distinct, limit).mapInArrow(_wide_neighbours, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n_near"))
