"""Vector codes against the rule in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import vector_codes as V  # noqa: E402


def brute(rows):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    whole = [[[math.floor(4096 * x) for x in r[1][p * width : (p + 1) * width]] for p in range(8)] for r in kept]
    book = [[list(w[p]) for w in whole[:16]] for p in range(8)]

    def nearest(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(6):
        new = [[list(e) for e in b] for b in book]
        for p in range(8):
            own = [nearest(p, w[p])[0] for w in whole]
            for k in range(len(book[p])):
                mine = [w[p] for w, o in zip(whole, own) if o == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        book = new
    best = [[nearest(p, w[p]) for p in range(8)] for w in whole]
    errors = [sum(b[1] for b in x) for x in best]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    most = V.MOST
    return sorted([(repr(r[0]), "".join(f"{b[0]:02x}" for b in x), min(e, most), min(labels[r[2]], most), digest) for r, x, e in zip(kept, best, errors)])


def found(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, id int").repartition(3)
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.compress(df).collect())


def vectors(n, width=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8 * width)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]


def test_clustered_vectors(spark):
    rows = vectors(900)
    rows += [(1000 + i, rows[7][1], 2) for i in range(700)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(40, 2)
    rows += [(None, rows[3][1], None), (3, rows[5][1], 1), (3, rows[5][1], 1), (50, None, 1), (51, [1.0, None] * 8, 1), (52, [float("nan")] * 16, 1), (53, [float("-inf")] * 16, 1)]
    rows += [(54, [0.0, -0.00001] * 8, 1), (55, [float(np.float32(x)) for x in [3e38, -1e30, 7e9, 2e5] * 4], 2), (0, [float(np.float32(x)) for x in [1e20, -5] * 8], 2)]
    assert found(spark, rows) == brute(rows)
    other = [(60, [1.0] * 8, 1), (61, [1.0] * 15, 1), (62, [], 1)]
    assert found(spark, rows + other) == brute(rows)


def test_few_and_no_rows(spark):
    rows = vectors(5, 1)
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert found(spark, [(1, [1e308] * 8, 1), (2, [2.0] * 8, 1)], "double") == brute([(2, [2.0] * 8, 1)])


def test_curve_visits_neighbours_in_turn():
    for width, bits in ((2, 5), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), -1).reshape(-1, width)
        place = V.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_and_settle_tight_blocks():
    rng = np.random.default_rng(2)
    entries = rng.integers(-4000, 4000, (16, 8))
    settled = 0
    for spread in (1, 30, 900, 5000):
        values = rng.integers(-4000, 4000, 8) + rng.integers(-spread, spread + 1, (200, 8))
        some = V.shortlist(values.min(0, keepdims=True), values.max(0, keepdims=True), entries)
        assert set(V.distances(values, entries).argmin(1).tolist()) <= set(some.tolist())
        settled += len(some) == 1
    assert settled >= 1
