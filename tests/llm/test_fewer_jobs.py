"""Tables of bits, components and line removal do no work for nothing."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import bits, components, linededup  # noqa: E402


@pytest.mark.parametrize("once", [bits.ONCE, 0])
def test_small_table_needs_no_job_for_each_partition(spark, monkeypatch, once):
    monkeypatch.setattr(bits, "ONCE", once)
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(f"bits-{once}", "")
    try:
        values = spark.range(0, 7000, 7)
        table = bits.bit_table(values)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert bits.on(table, np.arange(0, 7000, 7)).all() and np.unpackbits(table).sum() <= 1000
    if once:
        assert len(context.statusTracker().getJobIdsForGroup(f"bits-{once}")) < 10


@pytest.mark.parametrize("edges, rounds", [([(9, 1), (7, 1), (5, 1), (8, 2)], 0), ([(9, 8), (8, 7), (2, 8)], 1), ([], 0)])
def test_components_stop_at_stars(spark, monkeypatch, edges, rounds):
    made = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: made.append(name) or f(df, name))
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[a] == found[b] for a, b in edges) and all(root <= node for node, root in found.items())
    assert len(made) == 1 + rounds


def test_texts_are_split_once(spark):
    """Not within the lambda, which would split the text again for each line that stays."""
    lines = [" ".join(f"w{k}_{j}" for j in range(6)) for k in range(5)]
    docs = spark.createDataFrame([(1, "\n".join(lines[:3])), (2, "\n".join([lines[3], lines[0], "", lines[4], lines[2]])), (3, None)], "doc_id long, text string")
    out = linededup.deduplicate(docs, removed="gone")
    assert {r.doc_id: (r.text, r.gone) for r in out.collect()} == {1: ("\n".join(lines[:3]), 0), 2: (f"{lines[3]}\n\n{lines[4]}", 2), 3: (None, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get(split(" not in plan and plan.count("split(") == 1


def test_words_of_lines_without_a_mark_are_not_looked_at():
    """Lines on a table: the words and places they have among all lines."""
    texts = [b"a b c\nd e\n\nf", b"", b"g h\n", b"i", b"j k\nl"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    docs, ties, none = np.arange(5) * 3, np.arange(5) + 50, np.zeros(linededup.CELLS, np.uint8)
    x = linededup.Lines(data, offsets, none)
    place = linededup.addresses(docs[x.doc], ties[x.doc], x.number)
    for wanted in ([0, 2, 5], range(x.count), [], [1, 4, 6]):
        table = np.zeros(1 << 13, np.uint8)
        spots = bits.spot(place[list(wanted)], 1 << 16)
        np.bitwise_or.at(table, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        y = linededup._lines_on(data, offsets, docs, ties, table, none)
        own = np.flatnonzero(bits.on(table, place))
        assert (y.doc == x.doc[own]).all() and (y.number == x.number[own]).all() and (y.cls == x.cls[own]).all()
        assert y.token.tolist() == [t for i in own for t in x.token[x.begin[i] : x.begin[i] + x.size[i]]]


def test_runs_are_short():
    """A task holds the words of RUN bytes at once, or of one longer text; no row is left out."""
    texts = ["a b " * (20_000 * (1 + k % 7)) for k in range(20)] + ["x " * linededup.RUN, "", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["doc", "tie", "text"])
    docs, found = [], []
    for own, ties, data, offsets in linededup._runs(batch, 2):
        assert len(data) <= linededup.RUN == 1 << 20 or len(own) == 1
        docs += own.tolist()
        found += [data[a:z].tobytes().decode() for a, z in zip(offsets, offsets[1:])]
    assert docs == list(range(len(texts))) and found == texts
