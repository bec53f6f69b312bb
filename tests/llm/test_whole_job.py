"""Cases that earlier versions left out of the job."""

import random
import zlib

import pyarrow as pa
import pytest

pytest.importorskip("trajspark.llm.queries")

from test_llm import TOKENIZER, docs_of, removed_by_force, words_of  # noqa: E402

from trajspark.llm import decontamination, fingerprints, langid, linededup, lm, queries, textbuf  # noqa: E402


# --- 3 -----------------------------------------------------------------------------------------------------------------


def test_short_lines_take_part(spark, tmp_path):
    texts = ["All rights reserved.\nfoo\n漢字漢字漢字", "foo foo\n\nall rights RESERVED\nfoo bar\n漢字漢字漢字", "bar foo\n!!\nfoo bar baz\n", "!!\nfoo\nbaz bar foo\none two three four", "four one two three\n\n"]
    gone = removed_by_force(list(enumerate(texts)), least=1)
    assert len(gone) == 8
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op3_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in found} == want
    assert sum(r.n_removed for r in found) == len(gone)
    pipeline = pytest.importorskip("corpus_pipeline")
    assert {r.doc_id: r.text for r in pipeline.line_dedup_stage(spark, docs, "").collect()} == want
    assert linededup.deduplicate(docs_of(spark, ["", None])).count() == 2


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_model_learns_from_all_rows_and_words(spark, monkeypatch):
    """More documents than the warm start takes, and a vocabulary beyond the broadcast words."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(500)]
    docs = docs_of(spark, texts).select("doc_id", "text").withColumn("held_out", langid.held_out(7, 2))
    models, fit = [], lm.fit

    def kept(*a):
        models.append(fit(*a))
        return models[-1]

    monkeypatch.setattr(lm, "fit", kept)
    monkeypatch.setattr(lm, "SHARE", 1)
    whole = {r.doc_id: r.score for r in lm.score_documents(docs, TOKENIZER).collect()}
    store = lm.marked_ids(TOKENIZER)
    own = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert models[0].trained == sum(1 + sum(map(len, store.encode(texts[i].split()))) for i in own) and len(own) > lm.WARM
    # the memory is the same however few of its words are broadcast
    monkeypatch.setattr(lm, "HOT", 3)
    few = {r.doc_id: r.score for r in lm.score_documents(docs, TOKENIZER).collect()}
    assert len(models[1].memory) == 4
    assert max(abs(few[k] - whole[k]) for k in whole) < 0.02 * -min(whole.values())


# --- the stage of near copies --------------------------------------------------------------------------------------------


def test_stage_takes_edited_copies_out(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(30)]
    for i in range(90):
        w = texts[i % 30].split()
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [None, "", " ", "one two", "One  two", "two one"]

    def sets(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()

    s = [sets(t) for t in texts]
    want = {j for j in range(len(s)) if not any(s[i] == s[j] or len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) > 0 for i in range(j))}
    docs = docs_of(spark, texts)
    out = pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert len(want) < 70


def test_stage_tells_rows_apart(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(5, "a text of its own", 1), (5, same, 2), (1, same, 3), (7, "twice the same row", 4), (7, "twice the same row", 4), (None, "a text of nobody", 5), (None, same + " more", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc0 int")
    out = pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r._doc0 for r in out.collect()) == [1, 3, 4, 5]


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_rare_language_leaves_others_calibrated(spark):
    rng = random.Random(9)
    words = {"aa": ["lorem", "dolor", "amet", "sit"], "bb": ["quick", "brown", "fox", "the"]}
    rows = [(i, x, " ".join(rng.choices(words[x], k=12))) for i, x in enumerate(["aa", "bb"] * 200)]
    schema = "doc_id long, lang string, text string"
    usual = langid.fit(spark.createDataFrame(rows, schema))
    model = langid.fit(spark.createDataFrame([*rows, (1000, "zz", "zebra zoo")], schema))
    assert model.languages == ["aa", "bb", "zz"] and model.temperature == usual.temperature != 1.0
    assert (model.limit[:2] < float("inf")).all() and model.limit[2] == float("inf")


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_neighbours_of_all_documents(spark):
    rng = random.Random(21)
    base = " ".join(f"t{rng.randrange(4000)}" for _ in range(1500))
    texts = [base + f" x{k}" for k in range(12)] + [" ".join(f"t{rng.randrange(4000)}" for _ in range(40)) for _ in range(20)] + [None, base + " x0"]
    rows = fingerprints.fingerprint_documents(docs_of(spark, texts)).collect()
    kinds = {int(r.fingerprint, 16) for r in rows}
    assert {r.doc_id: r.n_near for r in rows} == {r.doc_id: sum(0 < (int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in kinds) for r in rows}
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(128)
        for _ in range(rng.choice([1, 2, 40])):
            prints.add(x)
            x ^= 1 << rng.randrange(128)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints], "hi long, lo long")
    got = {(r.hi, r.lo): r.n_near for r in fingerprints.count_wide_neighbours(frame, limit=16).collect()}
    want = {(signed(x >> 64), signed(x & (1 << 64) - 1)): sum(0 < (x ^ y).bit_count() <= 3 for y in prints) for x in prints}
    assert got == {k: n for k, n in want.items() if n}


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_long_items_are_all_found():
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [rng.choices(vocabulary, k=1000) for _ in range(3)]
    index = decontamination.Benchmark([0, 1, 2], [" ".join(x) for x in items])
    texts = []
    for i in range(40):
        w = list(items[i % 3])
        for at in rng.sample(range(1000), 200):
            w[at] = f"q{rng.randrange(10**6)}"
        texts.append(" ".join(rng.choices(vocabulary, k=50) + w + rng.choices(vocabulary, k=30)))
    texts += [" ".join(rng.choices(vocabulary, k=1500)) for _ in range(5)]
    found = [{(first + row, item) for row, item, _ in index.matches(data, offsets)} for first, _, data, offsets in textbuf.chunks(pa.array(texts))]
    assert set().union(*found) == {(i, i % 3) for i in range(40)}
