"""Line removal moves and computes less for the same pairs."""

import pickle
import time

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import linededup, matches  # noqa: E402
from trajspark.llm.textbuf import Words  # noqa: E402
from trajspark.session import collect_garbage, materialize  # noqa: E402


def test_reach_of_keys_is_worked_out_once_for_each_size(monkeypatch):
    lines = "\n".join(" ".join(f"w{k}" for k in range(n)) for n in range(1, 90)).encode()
    x = linededup.Lines(np.frombuffer(lines, np.uint8), np.array([0, len(lines)]), np.zeros(linededup.CELLS, np.uint8))
    first = linededup._keys(x, 1, 0.8)
    calls = []
    monkeypatch.setattr(linededup, "partners", lambda *a, f=linededup.partners: calls.append(a) or f(*a))
    again = linededup._keys(x, 1, 0.8)
    assert not calls and all((a == b).all() for a, b in zip(first, again))
    # lines of up to three words have no similar ones but equal ones, so no keys
    assert not np.isin(first[1], np.arange(3)).any() and np.isin(np.arange(3, 89), first[1]).all()


def test_members_are_dealt_in_bytes_that_compress():
    rng = np.random.default_rng(4)
    n = 20_000
    m = {k: np.zeros(n, t) for k, t in matches.FIELDS.items()}
    for k in ("key", "cls", "p1", "p2"):
        m[k] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    m["doc"], m["chunks"] = np.sort(rng.integers(-5, 300_000, n)), np.ones(n, np.int64)
    for k, most in (("line", 40), ("size", 30), ("pos", 20)):
        m[k] = rng.integers(0, most, n)
    dealer = matches.Dealer(3)
    batches = [*dealer.add(m), *dealer.rows()]
    parts = list(matches._parts(iter(batches)))
    order = {k: np.concatenate([p[1][k] for p in parts]) for k in m}
    rows = lambda x: sorted(zip(*(x[k].tolist() for k in matches.FIELDS)))
    assert rows(order) == rows(m)
    raw = b"".join(r for b in batches for r in b.column(1).to_pylist())
    assert len(pa.compress(raw, "lz4_raw")) < 38 * n


def test_shuffle_files_go_before_the_next_step(spark):
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before = files()

    def step(made):
        return materialize(made.repartition(5, "id").sortWithinPartitions("id").mapInArrow(lambda b: b, "id long"), "step")

    members = spark.range(20_000).mapInArrow(lambda b: b, "id long")
    out = step(members)
    assert files() - before
    collect_garbage(spark)
    for _ in range(20):
        time.sleep(0.1)
        if not files() - before:
            break
    assert not files() - before and out.count() == members.count()


def test_bytes_of_words():
    data = np.arange(256, dtype=np.uint8)
    words = Words(data, np.array([0, 256]))
    inside = np.zeros(256, bool)
    for a, b in zip(words.start, words.stop):
        inside[a:b] = True
    assert words.data.tobytes() == data.tobytes().lower() and np.flatnonzero(~inside).tolist() == [*range(9, 14), 32]


def test_known_keys_travel_compressed():
    table = np.zeros(1 << 20, np.uint8)
    table[::13] = 4
    known = linededup.Keys(table, np.array([3, 9]), np.array([2, 5]))
    raw = pickle.dumps(known)
    again = pickle.loads(raw)
    assert len(raw) < 1 << 17 and all((getattr(again, k) == getattr(known, k)).all() for k in ("table", "crowded", "chunks"))
    keys = np.random.default_rng(8).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (again.shared(keys) == known.shared(keys)).all()


def test_common_words_of_pairs():
    rng = np.random.default_rng(5)
    sets = [rng.permutation(60)[: rng.integers(1, 40)] for _ in range(50)]
    size = np.array([len(s) for s in sets], np.int32)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    found = matches.common(np.concatenate(sets), np.cumsum(size) - size, size, i, j)
    assert found.tolist() == [len({*sets[a].tolist()} & {*sets[b].tolist()}) for a, b in zip(i, j)]
