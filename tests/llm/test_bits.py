"""Tables of bits let all their values through, and few others."""

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import bits, linededup, matches, shingles  # noqa: E402


def test_several_bits_let_few_others_through(spark):
    table = bits.bit_table(spark.range(0, 60_000 * 7, 7), 6, bits.SEVERAL)
    own = np.arange(0, 60_000 * 7, 7)
    assert bits.on(table, own).all() and bits.on(table, np.setdiff1d(np.arange(60_000 * 7), own)).mean() < 0.07
    one = bits.bit_table(spark.range(0, 60_000 * 7, 7))
    assert bits.on(one, own).all() and bits.on(one, np.setdiff1d(np.arange(60_000 * 7), own)).mean() > 0.07


def test_repeated_lines_seldom_count_as_first(spark, monkeypatch):
    tables = []
    for module in (linededup, matches, shingles):
        monkeypatch.setattr(module, "bit_table", lambda *a, f=bits.bit_table: tables.append(f(*a)) or tables[-1])
    rng = np.random.default_rng(2)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 9)) for _ in range(3000)]
    docs = [(k, "\n".join(lines[k % 100 * 30 :][:30])) for k in range(400)]
    found = linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), removed="n").collect()
    assert {r.doc_id: r.n for r in found} == {k: 30 * (k >= 100) for k in range(400)}
    ties = {r.doc: r.tie for r in linededup._addressed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    later = np.repeat(np.arange(100, 400), 30)
    place = linededup.addresses(later, np.array([ties[k] for k in later.tolist()]), np.tile(np.arange(30), 300))
    assert bits.on(tables[0], place.view(np.int64)).mean() < 0.02
