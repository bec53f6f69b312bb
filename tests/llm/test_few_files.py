"""Tables between steps are written in few files, however many partitions they come from, and hold the same rows."""

import glob

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark import session  # noqa: E402
from trajspark.llm import linededup, matches, shingles  # noqa: E402


@pytest.mark.parametrize("run", [linededup.deduplicate, shingles.keep_first_similar])
def test_many_partitions_make_few_files(spark, monkeypatch, run):
    files = {}

    def written(df, name, *args, **how):
        out = session.materialize(df, name, *args, **how)
        files[name] = max(files.get(name, 0), len(glob.glob(f"{out.scratch_path.removeprefix('file:')}/part-*")))
        return out

    for module in (linededup, matches, shingles):
        monkeypatch.setattr(module, "materialize", written)
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    base = word(60)
    texts = [" ".join(word(40)) for _ in range(300)] + [" ".join([*base[:k], "x", *base[k:]]) for k in range(0, 60, 2)]
    texts += [f"{texts[k]}\n{texts[k + 1]} more" for k in range(0, 300, 3)] + texts[:50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = sorted(run(docs).collect())
    few = max(files.values())
    files.clear()
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(run(docs).collect()) == plain
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 7 and few <= 16 and max(files.values()) <= 16
