"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import jaccard_join as J  # noqa: E402


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, size string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=repr)


def corpus(seed=5):
    """Texts with edits of all strengths, chains of them, a passage that many share, and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(60):
        text = rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 9, 14, 40, 120, 400]))
        if rng.random() < 0.5:
            text[len(text) // 2 : len(text) // 2] = passage
        texts.append(text)
        for _ in range(rng.randrange(6)):
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(text) // 60), max(1, len(text) // 30)])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: len(text) * 9 // 10] or text
            texts.append(text)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("least, block", [(48, 2048), (3, 3)])
def test_all_links_are_found(spark, monkeypatch, least, block):
    monkeypatch.setattr(J, "LEAST", least)
    monkeypatch.setattr(J, "BLOCK", block)
    texts = corpus()
    ids = random.Random(1).sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    assert found(spark, rows) == brute(rows)


def test_tiles_alone_find_all(spark, monkeypatch):
    """Without leaders, all links come from tiles."""
    monkeypatch.setattr(J.Search, "leader_pairs", lambda self: J.materialize(self.nodes.select(J.F.col("node").alias("a"), J.F.col("node").alias("b")).limit(0), "none"))
    monkeypatch.setattr(J, "BLOCK", 4)
    rows = list(enumerate(corpus(8)))
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b\x0bc d"), (8, long), (8, long + " x"), (9, long), (None, long), (None, "one two"), (None, None), (4, "one"), (10, "z " * 3000), (11, "Z z z z z z")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[rng.random(len(one)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 12), dtype=np.uint64)]))
        both = len(np.intersect1d(one, two))
        bits = J.folded([J.parity_bits(one), J.parity_bits(two)])
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(one) + len(two) - 2 * both
        if 100 * both >= 80 * (len(one) + len(two) - both):
            assert J.slack(np.array([len(one), len(two)]), bits, np.array([0]), np.array([1]), 80)[0] >= 0


def test_forest_joins_what_the_pairs_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (9, 4), (30, 200), (80, 60)):
        comp, a, b = rng.integers(0, n, n), rng.integers(0, n, m), rng.integers(0, n, m)
        keep = J.forest(comp, a, b, rng.integers(0, 9, m))
        names = np.unique(comp, return_inverse=True)[1]
        size = int(names.max()) + 1
        want, got = (J.spanning(size, names[x], names[y]) for x, y in ((a, b), (a[keep], b[keep])))
        assert (want == got).all() and keep.sum() < 2 * n
