"""Language-model scoring: a causal self-attention model over subword ids, beside a word-count baseline.

Words are runs of bytes other than white space, A-Z in lower case; a text is its words and one end. Its ids are those of
a public tokenizer word by word, a mark between parts that a word joins without white space, and the end.

Ids fall into ``CLASSES`` classes: the mark and the commonest have a class each, the others share classes of equal weight.
The model predicts the class of each id from the ids before it; which id of the class it is follows from counts by the id
before (a full softmax over 49,000 ids for each id would take some thirty times the time). A text is cut into blocks of
``BLOCK`` ids; the queries of a block see that block and the one before it under a causal mask, so windows of two blocks
overlap by one and each id is scored once. Attention weights depend on the two classes and their distance, which for scoring
become tables. A direct path from the last class to the next starts from counts.

A word's probability ends with that of the mark not following, and its first id is taken given that no mark comes, so the
probabilities of all words after a context sum to one at most. A memory of all training words, as sequences of ids with
their shares of all tokens, is mixed in word by word; its weight is that of ``WEIGHTS`` under which all training texts, each
without its own counts, are likeliest. The end is a word of both.

All counts come from all training texts. The attention starts warm in numpy on the driver over a bounded sample of blocks
(``WARM`` documents), then learns in tasks from every block of every training document; a model per task from the same start,
averaged by the ids each has seen.

The counts of a bounded set of words, frequent in a sample of training documents, are broadcast; all other words go to
their counts by one shuffle, pre-summed by document, and come back to their documents with them, for baseline and memory.

Null texts count as empty: the end alone. Rows without doc_id are training rows. Repeated rows keep a row each and count
each. An empty table gives no rows. Columns other than ``doc_id``, ``text`` and ``held_out`` are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.textbuf import Words, chunks
from trajspark.llm.tokens import WordIds
from trajspark.session import discard, materialize

CLASSES, SHARED, CORE, BLOCK, WIDTH = 256, 48, 1024, 16, 24
#: The softmax has two levels: GROUPS groups of as many classes, and the classes of a group. The first group is the mark alone.
GROUPS = 16
ALONE = CLASSES - SHARED - GROUPS
#: One block in so many of each training document is learned from: all of them.
SHARE = 1
#: Blocks of a step of the warm start and of the tasks.
STEP, WIDE_STEP = 128, 512
#: Weights of the memory that are tried on all training texts.
WEIGHTS = (np.arange(16) + 0.5) / 16
#: Documents of the warm start, and frequent words counted ahead and broadcast.
WARM, HOT, HOT_SAMPLE = 400, 1 << 18, 20_000
LOG10 = float(np.log(10))
_TEXT = np.uint64(0x9E3779B97F4A7C15)


class MarkedIds(WordIds):
    """Ids of words with a mark between parts that join without white space."""

    def reset(self) -> None:
        super().reset()
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>") or t.startswith("<|")]] = True
        self.joint, self.end = self.size, self.size + 1
        self.blank = next((i for t, i in vocabulary.items() if t.startswith("<|")), 0)
        self.spell = spelling(self.size + 2)

    def encode(self, words: list[str]) -> list[list[int]]:
        ends, joint = self.ends, self.joint
        out = []
        for ids in super().encode(words):
            if not ids:  # no word is without ids
                ids = [self.blank]
            if len(ids) > 1:
                marked = []
                for i in ids[:-1]:
                    marked.append(i)
                    if ends[i]:
                        marked.append(joint)
                ids = [*marked, ids[-1]]
            out.append(ids)
        return out

    def spells(self, words: Words, parts: tuple) -> np.ndarray:
        """Hash of the ids of each distinct word; ``parts`` as in ``lookup``."""
        slots = self.slots_of(parts[0])
        if (slots < 0).any():  # a run with special strings has been looked up by case
            slots = self.lookup(words, parts)[0]
        begin, length = self.begin[slots], self.length[slots].astype(np.int64)
        stops = np.cumsum(length)
        flat = self.pool[np.repeat(begin - (stops - length), length) + np.arange(length.sum())]
        return spelled(self.spell, flat.astype(np.int64), stops - length, stops)


def spelling(size: int) -> np.ndarray:
    """Random number of each id."""
    return np.random.default_rng(9).integers(1, 1 << 63, size, dtype=np.uint64)


def spelled(spell: np.ndarray, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each run of ids."""
    from trajspark.llm.textbuf import powers

    up, down = powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spell[flat] * up[: len(flat)], dtype=np.uint64)])
        return (total[stops] - total[starts]) * down[starts]


_stores: dict[str, MarkedIds] = {}


def marked_ids(path: str) -> MarkedIds:
    if path not in _stores:
        _stores[path] = MarkedIds(path)
    return _stores[path]


# --- word counts -----------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    total: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            total.update(t.encode("utf-8", "replace").lower().split())
            if len(total) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """(hashes, words), in order of hash, of at most HOT words, the commonest of a sample of documents. They only choose
    the way of counting."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(1_000_000)) < int(1e6 * min(1.0, HOT_SAMPLE / max(n, 1))))
    rows = sample.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = rows.where(F.length("word") < 64).orderBy(F.desc("n"), "word").limit(HOT).select("word").toArrow().column(0).to_pylist()
    texts = [w.decode("utf-8", "replace") for w in found]
    hashes = np.concatenate([Words(data, offsets).hash() for _, _, data, offsets in chunks(pa.array(texts, pa.string()))] or [np.zeros(0, np.uint64)])
    order = np.argsort(hashes)
    return hashes[order], [texts[i] for i in order]


def _hot_counts(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(hot.value), np.int64)
    for b in batches:
        for _, _, data, offsets in chunks(b.column(0)):
            place, there = _place(hot.value, Words(data, offsets).hash())
            total += np.bincount(place[there], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])


def _place(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


ROWS = (
    "row long, doc_id long, held_out boolean, n_tokens long, hot_base double, hot_known long, words binary, spells binary, times binary, ids binary"
)


def _read(batches: Iterator[pa.RecordBatch], hot, counts, path: str) -> Iterator[pa.RecordBatch]:
    """Of each document: what its frequent words add to the baseline, its other words with their numbers, and its ids."""
    from pyspark import TaskContext

    row, store = TaskContext.get().partitionId() << 33, marked_ids(path)
    gain = np.log10(counts.value + 1.0)
    for b in batches:
        docs, held = b.column(0), b.column(1)
        for first, last, data, offsets in chunks(b.column(2)):
            n = last - first
            words = Words(data, offsets)
            kinds, one, inverse = np.unique(words.hash(), return_index=True, return_inverse=True)
            place, there = _place(hot.value, kinds)
            doc = words.doc
            base = np.bincount(doc, np.where(there, gain[place] if len(gain) else 0.0, 0.0)[inverse], n) if len(doc) else np.zeros(n)
            known = np.bincount(doc, (there & (counts.value[place] > 0) if len(gain) else there)[inverse], n) if len(doc) else np.zeros(n)
            other = ~there[inverse] if len(doc) else np.zeros(0, bool)
            pair, times = np.unique(doc[other] * max(len(kinds), 1) + inverse[other], return_counts=True)
            pair_doc, pair_word = np.divmod(pair, max(len(kinds), 1))
            cut = np.searchsorted(pair_doc, np.arange(n + 1))
            tail, times = kinds[pair_word], times.astype(np.uint32)
            flat, bounds = store.ids(data, offsets, words, (kinds, one, inverse))
            spells = store.spells(words, (kinds, one, inverse))[pair_word] if len(kinds) else np.zeros(0, np.uint64)
            flat = flat.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    docs.slice(first, n),
                    held.slice(first, n),
                    pa.array(words.count + 1),
                    pa.array(base),
                    pa.array(known.astype(np.int64)),
                    pa.array([tail[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary()),
                    pa.array([spells[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary()),
                    pa.array([times[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary()),
                    pa.array([flat[bounds[i] : bounds[i + 1]].tobytes() for i in range(n)], pa.binary()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "hot_base", "hot_known", "words", "spells", "times", "ids"],
            )
            row += n


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, held = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        words, spells, times = ([np.frombuffer(x, t) for x in b.column(k).to_pylist()] for k, t in ((2, np.int64), (3, np.int64), (4, np.uint32)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(words)), pa.array(np.concatenate(spells)), pa.array(np.repeat(rows, size)), pa.array(np.concatenate(times).astype(np.int32)), pa.array(np.repeat(held, size))],
            ["word", "spelled", "row", "times", "held_out"],
        )


def tail_words(rows: DataFrame) -> DataFrame:
    """(row, base, known, kinds, rare): baseline sums over a document's other words; ``kinds`` counts each trained word
    once; ``rare`` has (spelled, n) of each that the training texts have."""
    postings = rows.select("row", "held_out", "words", "spells", "times").mapInArrow(_tail, "word long, spelled long, row long, times int, held_out boolean")
    word = Window.partitionBy("word")
    postings = postings.withColumn("c", F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("times"))).over(word))
    postings = postings.withColumn("lead", F.min("row").over(word))
    return postings.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.when((F.col("c") > 0) & (F.col("row") == F.col("lead")), 1).otherwise(0)).alias("kinds"),
        F.collect_list(F.when(F.col("c") > 0, F.struct("spelled", F.col("c").alias("n")))).alias("rare"),
    )


# --- the model -------------------------------------------------------------------------------------------------------


def block_texts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number in it) of each block."""
    n = -(-np.diff(bounds) // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(n.sum()) - (np.cumsum(n) - n)[text]


def blocks(symbols: np.ndarray, bounds: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as blocks, or the blocks ``own`` of them: (keys, targets, valid, text). Keys are the block before and the block
    itself, shifted by one with CLASSES as the beginning; CLASSES + 1 stands for nothing."""
    text, k = block_texts(bounds)
    if own is not None:
        text, k = text[own], k[own]
    at = (bounds[:-1][text] + k * BLOCK)[:, None] + np.arange(-BLOCK, BLOCK)[None]
    low, high = bounds[:-1][text][:, None], bounds[1:][text][:, None]
    padded = np.append(symbols, np.int64(CLASSES + 1)).astype(np.int16)
    outside = len(symbols)
    before = at - 1
    keys = padded[np.where((before >= low) & (before < high), before, outside)]
    keys[before == low - 1] = CLASSES
    targets_at = at[:, BLOCK:]
    valid = targets_at < high
    targets = padded[np.where(valid, targets_at, outside)]
    return keys, targets, valid, text


_OFFSET = (np.arange(BLOCK)[:, None] + BLOCK) - np.arange(2 * BLOCK)[None]
_CAUSAL = _OFFSET >= 0
_OFFSET = np.where(_CAUSAL, _OFFSET, 0)


def grouped(x: np.ndarray) -> np.ndarray:
    """Sums over the classes of each group."""
    return x.reshape(len(x), GROUPS, -1).sum(2)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class Attention:
    """One head over class embeddings: e (CLASSES + 2, WIDTH), q, k, v, p (by distance); u to the classes of a group and
    g to the groups; b and c, the direct paths from the last class (or the beginning) to both."""

    params: dict[str, np.ndarray]

    @staticmethod
    def start(pairs: np.ndarray, seed: int = 5) -> Attention:
        """``pairs``: counts of (class, next class), the beginning as the last row but one."""
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.normal(0, scale, s)).astype(np.float32)
        root = WIDTH**-0.5
        alone = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
        return Attention(
            {
                "e": draw(CLASSES + 2, WIDTH, scale=0.5),
                "q": draw(WIDTH, WIDTH, scale=root * 0.5),
                "k": draw(WIDTH, WIDTH, scale=root * 0.5),
                "v": draw(WIDTH, WIDTH, scale=root),
                "u": draw(WIDTH, CLASSES, scale=root * 0.1),
                "g": draw(WIDTH, GROUPS, scale=root * 0.1),
                "c": np.log(grouped((pairs + 4 * alone) / (pairs.sum(1, keepdims=True) + 4))).astype(np.float32),
                "b": np.log((pairs + 4 * alone) / (pairs.sum(1, keepdims=True) + 4)).astype(np.float32),
                "p": np.zeros(2 * BLOCK, np.float32),
            }
        )

    def gradients(self, keys: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.params
        own, kinds = keys[:, BLOCK:], CLASSES + 2
        # what depends on two classes only is computed once for each pair of classes
        qe, ke, ve = w["e"] @ w["q"], w["e"] @ w["k"], w["e"] @ w["v"]
        scale = np.float32(WIDTH**-0.5)
        s = np.exp(np.clip(qe @ ke.T * scale, -15, 15))
        s[:, CLASSES + 1] = 0
        pair = own[:, :, None].astype(np.int32) * kinds + keys[:, None, :]
        a = s.take(pair) * np.where(_CAUSAL, np.exp(w["p"] - w["p"].max())[_OFFSET], np.float32(0))
        a /= a.sum(2, keepdims=True) + np.float32(1e-30)
        v = ve[keys]
        h = w["e"][own] + a @ v
        n = max(1, int(valid.sum()))
        target = np.where(valid, targets, 0).reshape(-1).astype(np.int64)
        last, flat_h, each = own.reshape(-1), h.reshape(-1, WIDTH), np.arange(target.size)
        share = (valid.reshape(-1, 1) / np.float32(n)).astype(np.float32)
        group, member = target // GROUPS, np.arange(GROUPS)
        first = _softmax(flat_h @ w["g"] + w["c"][last])
        found = first[each, group]
        # the classes of each target's own group, group by group; the mark is its group's only class
        dz, dh, g = np.zeros((len(each), GROUPS), flat_h.dtype), np.zeros_like(flat_h), {"u": np.zeros_like(w["u"])}
        order = np.argsort(group.astype(np.int8), kind="stable")
        cut = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for j in range(1, GROUPS):
            rows, own_classes = order[cut[j] : cut[j + 1]], slice(j * GROUPS, (j + 1) * GROUPS)
            if not len(rows):
                continue
            x, at = flat_h[rows], (np.arange(len(rows)), target[rows] % GROUPS)
            z = _softmax(x @ w["u"][:, own_classes] + w["b"][:, own_classes][last[rows]])
            found[rows] *= z[at]
            z[at] -= 1
            z *= share[rows]
            g["u"][:, own_classes] = x.T @ z
            dh[rows], dz[rows] = z @ w["u"][:, own_classes].T, z
        loss = -(np.log(found + 1e-30) * share[:, 0]).sum()
        first[each, group] -= 1
        first *= share
        g["g"] = flat_h.T @ first
        line = last.astype(np.int64)
        for name, row, values in (("b", line * CLASSES + group * GROUPS, dz), ("c", line * GROUPS, first)):
            g[name] = np.bincount((row[:, None] + member).ravel(), values.ravel(), w[name].size).reshape(w[name].shape).astype(np.float32)
        dh = (dh + first @ w["g"].T).reshape(h.shape)
        da = dh @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dh
        da = a * (da - (a * da).sum(2, keepdims=True))
        g["p"] = np.bincount(_OFFSET.reshape(-1), da.sum(0).reshape(-1), 2 * BLOCK).astype(np.float32)
        ds = np.bincount(pair.ravel(), da.ravel(), kinds * kinds).reshape(kinds, kinds).astype(np.float32) * scale
        sums = []
        for spots, values in ((own, dh), (keys, dv)):
            order = np.argsort(spots.reshape(-1), kind="stable")
            lead = np.flatnonzero(np.diff(spots.reshape(-1)[order], prepend=-1))
            total = np.zeros_like(w["e"])
            total[spots.reshape(-1)[order][lead]] = np.add.reduceat(values.reshape(-1, WIDTH)[order], lead, axis=0)
            sums.append(total)
        g["e"] = sums[0]
        for name, d in (("q", ds @ ke), ("k", ds.T @ qe), ("v", sums[1])):
            g["e"] = g["e"] + d @ w[name].T
            g[name] = w["e"].T @ d
        return float(loss), g

    def train(self, keys: np.ndarray, targets: np.ndarray, valid: np.ndarray, rate: float, epochs: float, batch: int = STEP) -> list[float]:
        """Adam over shuffled batches of blocks; losses by batch."""
        rng = np.random.default_rng(1)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        total = int(np.ceil(epochs * len(keys) / batch))
        order = rng.permutation(len(keys))
        for t in range(total):
            at = (t * batch) % len(keys)
            pick = order[at : at + batch]
            loss, g = self.gradients(keys[pick], targets[pick], valid[pick])
            losses.append(loss)
            step = rate * (1 - 0.9 * t / total)
            for name, grad in g.items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.01 * (grad * grad - second[name])
                up = first[name] / (1 - 0.9 ** (t + 1))
                self.params[name] -= (step * up / (np.sqrt(second[name] / (1 - 0.99 ** (t + 1))) + 1e-8)).astype(np.float32)
        return losses

    def tables(self) -> tuple[np.ndarray, ...]:
        w = self.params
        s = np.exp(np.clip((w["e"] @ w["q"]) @ (w["e"] @ w["k"]).T * np.float32(WIDTH**-0.5), -15, 15))
        s[:, CLASSES + 1] = 0
        near = np.where(_CAUSAL, np.exp(w["p"] - w["p"].max())[_OFFSET], 0).astype(np.float32)
        return s.astype(np.float32), near, w["e"] @ w["v"], w["e"], w["u"], w["b"], w["g"], w["c"]

    def logs(self, keys: np.ndarray, targets: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each target, and of the mark in its place."""
        s, near, v, e, u, b, g, c = tables
        out, mark = np.empty(targets.shape, np.float32), np.empty(targets.shape, np.float32)
        flat, kinds, one = s.reshape(-1), s.shape[1], np.ones(GROUPS, np.float32)
        slices = [np.ascontiguousarray(u[:, k * GROUPS : (k + 1) * GROUPS]) for k in range(GROUPS)]
        direct = [np.ascontiguousarray(b[:, k * GROUPS : (k + 1) * GROUPS]) for k in range(GROUPS)]
        for at in range(0, len(keys), 1024):
            part = keys[at : at + 1024].astype(np.int32)
            own = part[:, BLOCK:]
            a = flat.take(own[:, :, None] * kinds + part[:, None, :])
            a *= near
            total = a @ np.ones(2 * BLOCK, np.float32)
            total[total == 0] = 1
            h = np.matmul(a, v.take(part, axis=0))
            h /= total[:, :, None]
            h += e.take(own, axis=0)
            h, last = h.reshape(-1, WIDTH), own.reshape(-1)
            goal = np.minimum(targets[at : at + 1024], CLASSES - 1).reshape(-1).astype(np.int64)
            z = h @ g
            z += c.take(last, axis=0)
            found, marks = z[np.arange(len(z)), goal // GROUPS], z[:, 0].copy()
            np.exp(z, out=z)
            total = np.log(z @ one)
            found -= total
            mark[at : at + 1024] = (marks - total).reshape(own.shape)
            # the classes of each target's own group, group by group
            order = np.argsort((goal // GROUPS).astype(np.int8), kind="stable")
            cut = np.searchsorted(goal[order] // GROUPS, np.arange(GROUPS + 1))
            for k in range(1, GROUPS):
                rows = order[cut[k] : cut[k + 1]]
                z = h.take(rows, axis=0) @ slices[k]
                z += direct[k].take(last[rows], axis=0)
                found[rows] += z[np.arange(len(rows)), goal[rows] % GROUPS]
                np.exp(z, out=z)
                found[rows] -= np.log(z @ one)
            out[at : at + 1024] = found.reshape(own.shape)
        return out, mark


@dataclass
class Model:
    symbol: np.ndarray  # class of each id
    column: np.ndarray  # of each id: its column in ``within``; 0 for ids alone in their class
    part: np.ndarray  # log share of each id in its column
    within: np.ndarray  # log probability of a column in its class, by row of the id before
    row: np.ndarray  # of each id, as the id before
    attention: Attention
    ends: np.ndarray  # whether an id ends a word part
    joint: int
    spell: np.ndarray  # random number of each id
    memory: np.ndarray  # hashes of frequent words' ids, sorted
    memory_log: np.ndarray
    tokens: int = 1  # of all training texts
    trained: int = 0  # ids that the tasks have learned from

    def word_stops(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Positions after the last id of each word; a text's end is a word."""
        stop = self.ends[flat]
        stop[:-1] &= flat[1:] != self.joint
        stop[bounds[1:] - 1] = True
        before = bounds[1:] - 2
        stop[before[before >= bounds[:-1]]] = True
        return np.flatnonzero(stop) + 1

    def word_logs(self, flat: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, ...], rare: tuple[np.ndarray, np.ndarray], first: int = 0) -> tuple[np.ndarray, ...]:
        """(log probability of each word by its ids, the same by the memory, text and hash of each word). ``rare``: as
        ``looked_up`` gives it; the first text has number ``first`` in it."""
        keys, targets, valid, _ = blocks(self.symbol[flat], bounds)
        logs, mark = (x[valid] for x in self.attention.logs(keys, targets, tables))
        before = np.zeros(len(flat), np.int64)
        before[1:] = self.row[flat[:-1]]
        before[bounds[:-1]] = 0
        logs = logs + self.within[before, self.column[flat]] + self.part[flat]
        stops = self.word_stops(flat, bounds)
        starts = np.concatenate([[0], stops[:-1]])
        own = np.add.reduceat(logs.astype(np.float64), starts)
        # that no mark comes belongs to the word before
        no_mark = np.append(np.log1p(-np.exp(np.minimum(mark.astype(np.float64), -1e-6))), 0.0)
        inside = ~np.isin(stops, bounds)
        own += np.where(inside, no_mark[stops], 0.0) - no_mark[starts]
        known, h = np.full(len(stops), -np.inf), spelled(self.spell, flat, starts, stops)
        text = np.searchsorted(bounds, stops - 1, "right") - 1
        for keys, found, k in ((*rare, tagged(h, text + first)), (self.memory, self.memory_log, h)):
            at, there = _place(keys, k)
            known[there] = found[at[there]]
        return own, known, text, h

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of text and word, log probabilities by the memory) from a list of (spelled, n) for each text."""
        size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries = words.flatten()
        h, n = (entries.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        keys = tagged(h.astype(np.int64).view(np.uint64), np.repeat(np.arange(len(size)), size))
        order = np.argsort(keys)
        return keys[order], np.log(n[order] / max(self.tokens, 1))

    def scores(self, ids: list[np.ndarray], tables: tuple[np.ndarray, ...], rare: tuple[np.ndarray, np.ndarray], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each sequence of ids, ends included, with each of WEIGHTS; the same of those that were
        ``learned`` from, without their own counts in the memory, and zeros of others."""
        out, alone = np.zeros((len(ids), len(WEIGHTS))), np.zeros((len(ids), len(WEIGHTS)))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(total, total[first] + 200_000, "right")) - 1)
            bounds = total[first : last + 1] - total[first]
            own, known, text, h = self.word_logs(np.concatenate(ids[first:last]), bounds, tables, rare, first)
            out[first:last] = mixed(own, known, text, last - first)
            some = learned[first:last][text]
            own, known, text, h = (x[some] for x in (own, known, text, h))
            _, word, times = np.unique(tagged(h, text), return_inverse=True, return_counts=True)
            with np.errstate(divide="ignore"):
                known = np.log(np.maximum(np.rint(np.exp(known) * self.tokens) - times[word], 0) / max(self.tokens, 1))
            alone[first:last] = mixed(own, known, text, last - first)
            first = last
        return out / LOG10, alone / LOG10


def mixed(own: np.ndarray, known: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums over each of n texts of its words' log probabilities, with each of WEIGHTS for the memory's."""
    ratio = np.exp(np.minimum(known - own, 700.0))
    return np.stack([np.bincount(text, own + np.log((1 - w) + w * ratio), n) for w in WEIGHTS], 1)


def tagged(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h ^ (text.astype(np.uint64) + np.uint64(1)) * _TEXT


def _with_end(b: pa.RecordBatch, at: int, end: int) -> list[np.ndarray]:
    last = np.array([end], np.uint16)
    return [np.concatenate([np.frombuffer(x, np.uint16), last]) for x in b.column(at).to_pylist()]


def chosen(sample: np.ndarray, joint: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, column of the within table) of each id from its count. Columns: 0 for ids alone in their class,
    then the other core ids, then what is left of each shared class as a lump."""
    order = np.argsort(-sample, kind="stable")
    order = order[order != joint]
    symbol, column = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
    symbol[order[:ALONE]] = GROUPS + np.arange(ALONE)
    rest = order[ALONE:]
    weight = np.cumsum(sample[rest] + 0.01)
    symbol[rest] = GROUPS + ALONE + np.minimum((weight - 1e-9) * SHARED // weight[-1], SHARED - 1).astype(np.int64)
    column[order[ALONE:CORE]] = 1 + np.arange(CORE - ALONE)
    column[order[CORE:]] = 1 + CORE - ALONE + symbol[order[CORE:]] - ALONE - GROUPS
    return symbol, column


_WORDS = pa.list_(pa.struct([("spelled", pa.int64()), ("n", pa.int64())]))


def _id_counts(batches: Iterator[pa.RecordBatch], size: int, end: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for b in batches:
        total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *_with_end(b, 0, end)]), minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])


def _counted(batches: Iterator[pa.RecordBatch], sent, end: int) -> Iterator[pa.RecordBatch]:
    """Counts of ids (kind 0), of (class, next class) (1) and of (id before, column) (2)."""
    symbol, column, row = sent.value
    size = len(symbol)
    one, two, three = np.zeros(size, np.int64), np.zeros((CLASSES + 2) * CLASSES, np.int64), np.zeros((CORE + 1) * (column.max() + 1), np.int64)
    for b in batches:
        texts = _with_end(b, 0, end)
        for at in range(0, len(texts), 200):
            part = texts[at : at + 200]
            flat = np.concatenate(part)
            heads = np.concatenate([[0], np.cumsum([len(x) for x in part])])[:-1]
            before = np.concatenate([[0], symbol[flat[:-1]]]).astype(np.int64)
            rows = np.concatenate([[0], row[flat[:-1]]]).astype(np.int64)
            before[heads], rows[heads] = CLASSES, 0
            one += np.bincount(flat, minlength=size)
            two += np.bincount(before * CLASSES + symbol[flat], minlength=len(two))
            three += np.bincount(rows * (column.max() + 1) + column[flat], minlength=len(three))
    for kind, total in enumerate((one, two, three)):
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(total[some])], ["kind", "at", "n"]
        )


def _train(batches: Iterator[pa.RecordBatch], model, end: int, share: int) -> Iterator[pa.RecordBatch]:
    """A model per task, started from the common one; its numbers times the ids it has seen, to be averaged. Of each
    document every ``share``th block is learned from, beginning anywhere."""
    own = Attention({k: v.copy() for k, v in model.value.attention.params.items()})
    seen, texts = 0, 0
    held: list[np.ndarray] = []
    ready: list[tuple[np.ndarray, ...]] = []
    size = 0

    def pick() -> None:
        nonlocal seen, texts
        flat = np.concatenate(held)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        text, number = block_texts(bounds)
        own_blocks = np.flatnonzero((number + (text + texts) * 7) % share == 0)
        keys, targets, valid, _ = blocks(model.value.symbol[flat], bounds, own_blocks)
        texts += len(held)
        seen += int(valid.sum())
        ready.append((keys, targets, valid))
        held.clear()

    def learn() -> None:
        own.train(*(np.concatenate([r[k] for r in ready]) for k in range(3)), 0.0007, 1.0, WIDE_STEP)
        ready.clear()

    for b in batches:
        for x in _with_end(b, 0, end):
            held.append(x)
            size += len(x)
            if size > 500_000:
                size = 0
                pick()
                if sum(len(r[0]) for r in ready) > 20_000:
                    learn()
    if held:
        pick()
    if sum(len(r[0]) for r in ready):
        learn()
    if seen:
        names = sorted(own.params)
        flat = np.concatenate([own.params[k].reshape(-1) for k in names]).astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), seen))], ["at", "value", "seen"])


def fit(rows: DataFrame, store: MarkedIds, words: list[str], word_counts: np.ndarray, texts: int, tokens: int) -> Model:
    """Model from the training rows of the table that ``_read`` makes and the counts of frequent words among its ``tokens``
    training tokens in ``texts`` texts."""
    context = rows.sparkSession.sparkContext
    size, end = store.size + 2, store.end
    learn = rows.where("not held_out").select("row", "ids")
    warm = learn.orderBy(F.xxhash64("row")).limit(WARM).select("ids").toArrow()
    held = [x for b in warm.to_batches() for x in _with_end(b, 0, end)]
    occurred = learn.select("ids").mapInArrow(lambda b: _id_counts(b, size, end), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[occurred.column(0).to_numpy()] = occurred.column(1).to_numpy()
    symbol, column = chosen(total, store.joint)
    row = np.zeros(size, np.int64)
    row[np.argsort(-total, kind="stable")[:CORE]] = 1 + np.arange(CORE)
    sent = context.broadcast((symbol, column, row))
    counted = learn.select("ids").mapInArrow(lambda b: _counted(b, sent, end), "kind int, at long, n long")
    counted = counted.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (counted.column(k).to_numpy() for k in range(3))
    columns = int(column.max()) + 1
    one, two, three = np.zeros(size), np.zeros((CLASSES + 2) * CLASSES), np.zeros((CORE + 1) * columns)
    for k, total in enumerate((one, two, three)):
        total[at[kind == k]] = n[kind == k]
    # shares of an id in its column, of a column in its class, and of the latter by the id before
    by_column = np.bincount(column, one + 0.1, columns).clip(1e-9)
    part = np.where(column > 0, np.log((one + 0.1) / by_column[column]), 0).astype(np.float32)
    owner = np.zeros(columns, np.int64)
    owner[column] = symbol
    shared = by_column / np.bincount(owner[1:], by_column[1:], CLASSES).clip(1e-9)[owner]
    three = three.reshape(CORE + 1, columns)
    by_class = np.stack([np.bincount(owner[1:], x[1:], CLASSES) for x in three])[:, owner]
    within = np.log((three + 8 * shared) / (by_class + 8)).astype(np.float32)
    within[:, 0] = 0
    attention = Attention.start(two.reshape(CLASSES + 2, CLASSES))
    model = Model(symbol, column, part, within, row, attention, np.append(store.ends, [False, True]), store.joint, store.spell, np.zeros(0, np.uint64), np.zeros(0), tokens)
    _remember(model, store, words, word_counts, texts, tokens)
    if not held:
        return model
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    keys, targets, valid, _ = blocks(symbol[np.concatenate(held)], bounds)
    most = 40_000  # blocks, by chance, should the documents be long
    pick = np.random.default_rng(2).permutation(len(keys))[:most]
    attention.train(keys[pick], targets[pick], valid[pick], 0.004, max(1.0, min(8.0, 60_000 / len(pick))))
    sent = context.broadcast(model)
    mean = learn.select("ids").mapInArrow(lambda b, share=SHARE: _train(b, sent, end, share), "at long, value double, seen long").groupBy("at").agg(
        (F.sum("value") / F.sum("seen")).alias("value"), F.sum("seen").alias("seen")
    ).toArrow()
    if mean.num_rows:
        model.trained = mean.column(2)[0].as_py()
        flat = np.zeros(mean.num_rows)
        flat[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
        for name in sorted(attention.params):
            shape = attention.params[name].shape
            n = int(np.prod(shape))
            attention.params[name], flat = flat[:n].reshape(shape).astype(np.float32), flat[n:]
    return model


def _remember(model: Model, store: MarkedIds, words: list[str], counts: np.ndarray, texts: int, tokens: int) -> None:
    """Fill the memory with the training words' shares of all tokens, words of equal ids together, and the end."""
    some = np.flatnonzero(counts > 0)
    ids = [np.array(x, np.int64) for x in store.encode([words[i] for i in some])] + [np.array([store.end])]
    n = np.append(counts[some], texts)
    full = np.array([len(x) > 0 for x in ids])
    ids, n = [x for x, f in zip(ids, full) if f], n[full]
    stops = np.cumsum([len(x) for x in ids])
    h = spelled(model.spell, np.concatenate(ids), np.concatenate([[0], stops[:-1]]), stops)
    model.memory, at = np.unique(h, return_inverse=True)
    model.memory_log = np.log(np.bincount(at, n).clip(1e-9) / max(tokens, 1))


def _score(batches: Iterator[pa.RecordBatch], model, end: int) -> Iterator[pa.RecordBatch]:
    tables = model.value.attention.tables()
    for b in batches:
        rare = model.value.looked_up(b.column(b.num_columns - 1))
        learned = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        found = model.value.scores(_with_end(b, b.num_columns - 2, end), tables, rare, learned)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(WEIGHTS)).cast(pa.list_(pa.float64())) for x in found]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], *columns], [*b.schema.names[:-2], "scores", "alone"])


def score_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs``: doc_id, text, held_out. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashes, words = frequent_words(docs.where("not held_out"))
    hot = context.broadcast(hashes)
    counts = np.zeros(len(hashes), np.int64)
    rows = docs.where("not held_out").select("text").mapInArrow(lambda b: _hot_counts(b, hot), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    sent = context.broadcast(counts)
    read = materialize(docs.mapInArrow(lambda b: _read(b, hot, sent, tokenizer), ROWS), "lm-rows")
    tail = materialize(tail_words(read), "lm-tail")
    # a few sums over all rows
    ends, n_train = read.where("not held_out").agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    kinds = (tail.agg(F.sum("kinds")).first()[0] or 0) + int((counts > 0).sum()) + (1 if ends else 0)
    n_train = n_train or 0
    store = marked_ids(tokenizer)
    model, end = context.broadcast(fit(read, store, words, counts, ends, n_train)), store.end
    scored = read.join(tail, "row", "left").select("doc_id", "held_out", "n_tokens", "hot_base", "hot_known", "base", "known", "ids", "rare").mapInArrow(
        lambda b: _score(b, model, end),
        "doc_id long, held_out boolean, n_tokens long, hot_base double, hot_known long, base double, known long, scores array<double>, alone array<double>",
    )
    scored = materialize(scored, "lm-scores")
    discard(read, tail)
    sums = scored.agg(*[F.sum(F.get("alone", F.lit(k))) for k in range(len(WEIGHTS))]).first()
    best = int(np.argmax([x or 0.0 for x in sums]))
    whole = float(np.log10(n_train + kinds + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * whole).alias("base_score"),
        F.get("scores", F.lit(best)).alias("score"),
    )
