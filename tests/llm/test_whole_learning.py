"""What is learned comes from all rows to learn from."""

import random

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from test_llm import TOKENIZER, docs_of  # noqa: E402

from trajspark.llm import jaccard_join, langid, lm, toxicity  # noqa: E402


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_every_block_is_learned_from(spark, monkeypatch):
    rng = random.Random(31)
    texts = [" ".join(rng.choices(["red", "green", "blue", "unseen", "words"], k=60)) for _ in range(40)]
    docs = docs_of(spark, texts).select("doc_id", "text").withColumn("held_out", langid.held_out(7, 2))
    models, fit = [], lm.fit

    def kept(*a):
        models.append(fit(*a))
        return models[-1]

    monkeypatch.setattr(lm, "fit", kept)
    rows = {r.doc_id: r for r in lm.score_documents(docs, TOKENIZER).collect()}
    store = lm.marked_ids(TOKENIZER)
    assert models[0].trained == sum(1 + sum(map(len, store.encode(texts[k].split()))) for k, r in rows.items() if not r.held_out)


def test_weight_leaves_out_own_counts():
    """Words that one training text alone has are unknown to that text, whatever the weight."""
    rng = np.random.default_rng(4)
    symbol, column = np.append(lm.GROUPS + np.arange(12), [0, lm.GROUPS + 12]), np.zeros(14, np.int64)
    net = lm.Attention.start(rng.integers(0, 9, (lm.CLASSES + 2, lm.CLASSES)).astype(float))
    spell = lm.spelling(14)
    ids = [np.array([3, 13]), np.array([3, 13])]
    h = lm.spelled(spell, np.array([3, 13]), np.array([0, 1]), np.array([1, 2]))
    order = np.argsort(h)
    model = lm.Model(symbol, column, np.zeros(14, np.float32), np.zeros((1, 14), np.float32), np.zeros(14, np.int64), net, np.array([True] * 12 + [False, True]), 12, spell, h[order], np.log(np.array([1, 2])[order] / 3), 3)
    none = (np.zeros(0, np.uint64), np.zeros(0))
    scores, alone = model.scores(ids, net.tables(), none, np.array([True, False]))
    own, _, _, _ = model.word_logs(ids[0], np.array([0, 2]), net.tables(), none)
    for k, w in enumerate(lm.WEIGHTS):
        mix = lambda n: np.log10((1 - w) * np.exp(own) + w * np.array(n) / 3).sum()  # noqa: B023, E731
        assert np.isclose(scores[0, k], mix([1, 2])) and np.isclose(scores[1, k], mix([1, 2]))
        assert np.isclose(alone[0, k], mix([0, 1])) and alone[1, k] == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_every_label_counts(spark, monkeypatch):
    """Words that mark toxic texts only outside the warm start are learned, and every labelled text is learned from."""
    rng = random.Random(17)
    common = [f"{a}{b}" for a in "bcdfg" for b in ("an", "er", "ing")]
    marks = [f"vile{x * 3}" for x in "abcdefghijklmnopqrst"]
    texts, toxic = [], []
    for i in range(1500):
        toxic.append(int(i % 3 == 0))
        texts.append(" ".join([*rng.choices(common, k=20), *([rng.choice(marks)] if toxic[-1] else [])]))
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic) if i % 4], "doc_id long, toxic int")
    seen, learn_from_all = [], toxicity.learn_from_all

    def watched(own, rows, *a):
        seen.append(rows.count())
        learn_from_all(own, rows, *a)

    monkeypatch.setattr(toxicity, "learn_from_all", watched)
    docs = docs_of(spark, texts)
    net = toxicity.fit(docs, labels, per_class=12)
    held = labels.where(toxicity.F.pmod(toxicity.F.xxhash64(toxicity.F.lit("held"), "doc_id"), toxicity.F.lit(5)) == 0).count()
    assert seen == [labels.count() - held]
    rows = {r.doc_id: r.predicted for r in toxicity.score(docs, net).collect()}
    apart = [i for i in range(len(texts)) if not i % 4]
    assert np.mean([rows[i] == toxic[i] for i in apart]) > 0.95
    assert toxicity.fit(docs, labels.limit(0)).constant == 0.0


# --- 11 ----------------------------------------------------------------------------------------------------------------


def test_last_round_looks_at_tiles_that_kept_pairs_back(spark, monkeypatch):
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        w = rng.choices(vocabulary, k=120)
        for _ in range(14):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    monkeypatch.setattr(jaccard_join.Search, "leader_pairs", lambda self: jaccard_join.materialize(spark.createDataFrame([], "a long, b long"), "none"))
    rounds, tile_pairs = [], jaccard_join.Search.tile_pairs

    def watched(self, keys, *a):
        found = tile_pairs(self, keys, *a)
        rounds.append((keys.count(), found.where("key is not null").count(), a[-1] and a[-1].count()))
        return found

    monkeypatch.setattr(jaccard_join.Search, "tile_pairs", watched)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, texts)).collect()} == dict(enumerate(root))
    assert len(rounds) == 2 and rounds[0][2] is None and 0 < rounds[1][2] == rounds[0][1] < rounds[0][0]
