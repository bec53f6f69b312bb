"""The filter audit against a plain walk through every order."""

import re
from itertools import permutations

import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import filter_audit  # noqa: E402

ROWS = [  # doc_id, text, lang
    (1, "a b " * 60, "en"), (2, "a b " * 60, "en"), (3, " ".join(f"w{i}" for i in range(120)), "en"), (4, "Ab# " * 3, None), (5, None, ""),
    (6, "", "de"), (7, " ".join(f"W{i}" for i in range(120)), "de"), (8, " ".join(f"w{i}|" for i in range(120)), "de"), (2, "ΣABC é\x0bx\x1cy", "en"),
    (2, "a b " * 60, "en"), (None, "a b " * 60, "en"), (None, "nobody else", "en"), (9, "x " * 50_000, "fr"), (10, " ".join(f"w{i}" for i in range(120)), "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)]


def brute(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    failed = []
    for doc, text, lang in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        own["E"] = t in least and (doc is None or least[t] < doc)
        good, toxic = (any(x[0] == doc and x[k] == 1 for x in labels) if doc is not None else False for k in (1, 2))
        failed.append((lang or "", {k for k, v in own.items() if v}, good, toxic))
    out = {}
    for part in {x[0] for x in failed}:
        docs = [x for x in failed if x[0] == part]
        worth = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = docs
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                worth[f] += len(gone)
                fails = sum(f in x[1] for x in docs)
                out[part, "".join(order), k + 1] = [len(alive), len(gone), fails - len(gone), sum(x[1] == {f} for x in docs), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(worth[order[step - 1]])
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, n string, good int").repartition(3)
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")


def test_all_orders_against_a_walk(spark):
    found = filter_audit.audit(*frames(spark, ROWS, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(got) == len(found) == 4 * 600
    assert got == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = frames(spark, ROWS[:3], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
