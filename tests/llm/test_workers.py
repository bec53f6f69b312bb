"""Steps of the text operators leave no more Python workers behind than they need, and give what plain code gives."""

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import bits, matches, shingles  # noqa: E402


def test_bit_tables_of_near_copies_take_one_worker_in_a_task(spark, monkeypatch):
    plans = []

    def seen(values, *rest):
        plans.append(values._jdf.queryExecution().executedPlan().toString())
        return bits.bit_table(values, *rest)

    for module in (shingles, matches):
        monkeypatch.setattr(module, "bit_table", seen)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 30, n)]
    base = word(53)
    # any two share 49 of 63 shingles, 0.778, so that each set meets all others of its group; then one near copy
    rows = [(k, " ".join(base + word(7))) for k in range(8)]
    rows.append((8, rows[0][1] + " more"))
    found = shingles.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(8))
    assert len(plans) > 3 and not any("MapInArrow" in p for p in plans)
