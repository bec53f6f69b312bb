"""Name matching against the rule in plain Python, without an index of terms."""

import random
import re

import pytest

from trajspark.operators import alignment
from trajspark.operators import names as N
from trajspark.operators.axes import PARTS


def describe(name, context=""):
    norm = re.sub(r"[\s\-]+", "_", (name or "").strip().lower())

    def words(x):
        x = re.sub("([0-9])([a-z])", r"\1_\2", re.sub("([a-z])([0-9])", r"\1_\2", x))
        return [w for w in re.split("[^a-z0-9]+", x) if w]

    tokens = [w for w in words(norm) if w not in N.STOP_WORDS]
    spell = {norm, norm.replace("_", ""), "_".join(tokens), "".join(tokens)}
    if len(tokens) > 1:
        spell |= {"_".join(tokens[-2:]), "".join(tokens[-2:]), tokens[-1]}
    raw = set(words(re.sub(r"[\s\-]+", "_", f"{name or ''}_{context}".lower())))
    side = next((s for s in ("left", "right") if s in raw), None)
    part = next((p for p, those in PARTS.items() if raw & set(those)), None)
    return norm, tokens, spell - {""}, side, part


def likeness(s, t, grouped):
    if not s[0] or not t[0] or grouped and any(a and b and a != b for a, b in zip(s[3:], t[3:])):
        return 0
    if s[0] == t[0]:
        return 1000
    both = s[2] & t[2]
    if both:
        return int(500 + 400 * (max(map(len, both)) / max(map(len, s[2]))) + 0.5)
    if not s[1] or not t[1]:
        return 0
    n = sum(w in t[1] for w in s[1])
    if not n:
        return 300 if s[0].endswith(t[0]) or t[0].endswith(s[0]) else 0
    out = 120 * n + 220 * (s[1][-1] == t[1][-1]) + 80 * (s[1][0] == t[1][0]) + 60 * (s[0] in t[0] or t[0] in s[0])
    return out + grouped * (140 * (s[3] is not None and s[3] == t[3]) + 220 * (s[4] is not None and s[4] == t[4]))


def assigned(sources, targets, grouped, context=""):
    ds, dt = [describe(x, context) for x in sources], [describe(x) for x in targets]
    free, found = list(dict.fromkeys(targets)), {}
    for i, s in enumerate(ds):
        best = max(((likeness(s, describe(t), grouped), -k, t) for k, t in enumerate(free)), default=(0, 0, ""))
        if best[0] >= 300:
            found[i] = (best[2], best[0])
            free.remove(best[2])
    points = 50 if found else 100
    for i, s in enumerate(ds):
        if i in found:
            continue
        fits = [t for t in free]
        if grouped:
            of = dict(zip(targets, dt))
            fits = [t for t in free if not (s[3] and of[t][3] and s[3] != of[t][3]) and (not s[4] or of[t][4] == s[4])]
            if not s[4] and len({of[t][4] for t in fits} - {None}) > 1:
                fits = []
        if fits:
            found[i] = (fits[0], points)
            free.remove(fits[0])
    return {i: v for i, v in sorted(found.items())}


WORDS = ["left", "right", "shoulder", "elbow", "wrist", "thumb", "index", "joint", "arm", "pitch", "Roll", "yaw", "knee", "neck", "1", "2", "j3", "é"]


@pytest.mark.parametrize("grouped", [False, True])
def test_matches_follow_the_rule(spark, grouped):
    rng = random.Random(6)
    lists = {}
    for d in range(40):
        make = lambda: rng.choice([" ", "_", "-", ""]).join(rng.choices(WORDS, k=rng.randrange(1, 4)))  # noqa: E731, B023
        lists[d] = ([make() for _ in range(rng.randrange(1, 9))], list(dict.fromkeys(make() for _ in range(rng.randrange(1, 9)))))
    lists[40], lists[41], lists[42] = (["", " ", None], ["a", "b"]), (["q", "r", "s"], ["x", "y"]), (["left_elbow", "zz"], ["zz", "elbow_left", "LEFT elbow"])
    frames = [spark.createDataFrame([(d, i, x) for d, v in lists.items() for i, x in enumerate(v[k])], "dataset_id long, name_index int, name string") for k in (0, 1)]
    scored = {(r.dataset_id, r.source_index, r.target_index): r.score for r in N.name_scores(*frames, grouped).collect()}
    want = {(d, i, k): n for d, (a, b) in lists.items() for i, x in enumerate(a) for k, y in enumerate(b) if (n := likeness(describe(x), describe(y), grouped))}
    assert scored == want
    got = {}
    for r in N.match_names(*frames, grouped).collect():
        got.setdefault(r.dataset_id, {})[r.source_index] = (r.target_name, r.score)
    assert got == {d: a for d, v in lists.items() if (a := assigned(*v, grouped))}
    modes = {r.dataset_id: r.mode for r in N.match_summary(N.match_names(*frames, grouped)).collect()}
    assert modes[41] == "index"


def test_contexts_give_the_side(spark):
    s = spark.createDataFrame([(1, 0, "elbow", "/robot/right_arm"), (1, 1, "wrist_1", "/robot/right_arm")], "dataset_id long, name_index int, name string, context string")
    t = spark.createDataFrame([(1, 0, "left_elbow"), (1, 1, "right_elbow"), (1, 2, "right_wrist_2")], "dataset_id long, name_index int, name string")
    got = {r.source_index: (r.target_name, r.score) for r in N.match_names(s, t, grouped=True).collect()}
    assert got == assigned(["elbow", "wrist_1"], ["left_elbow", "right_elbow", "right_wrist_2"], True, "/robot/right_arm")
    assert got[0][0] == "right_elbow"


def test_topics_share_what_the_last_of_them_got(spark):
    names = ["elbow", "wrist", "zz"]
    topics = spark.createDataFrame(
        [("b", "/left/state", 0, "state", names), ("b", "/left/cmd", 1, "action", names), ("b", "/right/state", 2, "state", names), ("b", "/left/copy", 3, "state", names), ("b", "/odd", 4, "", ["elbow"])],
        "bag string, topic string, topic_order int, role string, names array<string>",
    )
    targets = spark.createDataFrame([("b", k, x) for k, x in enumerate(["right_elbow", "left_elbow", "left_wrist", "right_wrist"])], "bag string, target_index int, name string")
    got = {(r.topic, r.source_name): (r.target_name, r.from_topic) for r in alignment.assign_layout(topics, targets).collect()}
    assert got["/left/state", "elbow"] == got["/left/cmd", "elbow"] == ("left_elbow", "/left/cmd") or got["/left/cmd", "elbow"] == ("left_elbow", "/left/copy")
    assert got["/right/state", "wrist"] == ("right_wrist", "/right/state") and got["/left/copy", "wrist"] == ("left_wrist", "/left/copy")
    assert got["/odd", "elbow"][1] == "/odd" and len(got) == 13


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("make", [N.name_scores, N.match_names, lambda *a: N.match_summary(N.match_names(*a))])
def test_names_of_small_files_are_not_broadcast(spark, tmp_path, make, grouped):
    """Some thousand names are a few KB of files; what is joined are their terms and spellings, which a million of them bring to GB."""
    rows = [(d, i, f"{WORDS[(d + i) % len(WORDS)]}_{WORDS[i]}") for d in range(5) for i in range(9)]
    for name in ("s", "t"):
        spark.createDataFrame(rows, "dataset_id long, name_index int, name string").coalesce(1).write.parquet(str(tmp_path / name))
    found = make(*(spark.read.parquet(str(tmp_path / name)) for name in ("s", "t")), grouped)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3
    assert found.count()
