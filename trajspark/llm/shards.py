"""Groups in which every pair of fingerprints within a Hamming radius meets, each of bounded size.

Split the 64 bits into ``radius + 1`` blocks: two fingerprints within the radius agree on one block at least. Members of
a block value form a group. A group above ``limit`` is cut into chunks by hash; every two chunks meet in a task of their
own, so no task takes more than two chunks, however large the group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fingerprints in a chunk of a group.
LIMIT = 2048
#: Radius at which fingerprints of 128 bits agree on one of four blocks.
WIDE_RADIUS = 3


def block_bounds(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    cuts = [round(i * bits / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def meeting_groups(fingerprints: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """``fingerprints``: distinct values in the long column ``fp``. Returns (block, key, one, two, side, fp), laid out so
    that each (block, key, one, two) is a run of one partition: members of chunk ``one`` have side 0 and those of chunk
    ``two`` side 1; where both are the same chunk, all have side 0."""
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)).alias("key"))
            for k, (a, n) in enumerate(block_bounds(radius))
        ]
    )
    return meet_by(fingerprints.select("fp", F.explode(keys).alias("k")).select("k.block", "k.key", "fp"), ["fp"], limit)


def wide_groups(fingerprints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """As ``meeting_groups``, for distinct fingerprints of 128 bits in the long columns ``hi`` and ``lo``, at the radius
    ``WIDE_RADIUS``: each half of each long is a block."""
    halves = [F.shiftrightunsigned(c, 32) if k == 0 else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("hi", "lo") for k in (0, 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("block"), h.alias("key")) for k, h in enumerate(halves)])
    return meet_by(fingerprints.select("hi", "lo", F.explode(keys).alias("k")).select("k.block", "k.key", "hi", "lo"), ["hi", "lo"], limit)


def meet_by(member: DataFrame, values: list[str], limit: int) -> DataFrame:
    """Chunks of the groups (block, key) of ``member``, each two of a group together."""
    size = member.groupBy("block", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = member.join(size, ["block", "key"])
    chunks = F.ceil(F.col("size") / limit).cast("int")
    member = member.withColumn("chunk", F.pmod(F.xxhash64(*values), chunks).cast("int"))
    meet = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda c: F.struct(
            F.least(c, F.col("chunk")).alias("one"),
            F.greatest(c, F.col("chunk")).alias("two"),
            F.when(c < F.col("chunk"), 1).otherwise(0).alias("side"),
        ),
    )
    spread = member.select("block", "key", *values, F.explode(meet).alias("m")).select("block", "key", "m.one", "m.two", "m.side", *values)
    group = ["block", "key", "one", "two"]
    # a set number: these rows are few bytes but much work, so they must not be put together by size
    partitions = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(partitions, *group).sortWithinPartitions(*group, "side", *values)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, chunk one, chunk two) of each group of a partition; chunk two is chunk one where a group meets itself. Wide
    fingerprints are rows of two numbers."""
    held: list[np.ndarray] = []

    def give(part: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        value = 5 if part.shape[1] == 6 else slice(5, None)
        left, right = (np.ascontiguousarray(part[part[:, 4] == k, value]) for k in (0, 1))
        same = part[0, 2] == part[0, 3]
        return int(part[0, 0]), left.view(np.uint64), (left if same else right).view(np.uint64)

    for b in batches:
        table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        if not len(table):
            continue
        if held:
            table = np.concatenate([*held, table])
        cut = np.flatnonzero((np.diff(table[:, :4], axis=0) != 0).any(axis=1)) + 1
        parts = np.split(table, cut)
        for part in parts[:-1]:
            yield give(part)
        held = [parts[-1]]
    if held:
        yield give(held[0])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def first_block(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Number of the first block on which each pair agrees: a pair counts only there."""
    different, found = a ^ b, np.full(np.broadcast(a, b).shape, radius + 1, np.int64)
    for k, (at, n) in reversed([*enumerate(block_bounds(radius))]):
        same = (different >> np.uint64(at)) & np.uint64((1 << n) - 1) == 0
        found[same] = k
    return found
