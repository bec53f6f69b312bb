"""Toxicity: convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the whole word and of its first four and six bytes. Filters of
widths 1, 2 and 3 run over the words, each filter's largest response in a text feeds a logistic output. The threshold is
calibrated by language on labelled rows kept out of the training: the language is told by the text's own letters beyond
ASCII, never by the lang column, and the output is shifted so that a score of 0.5 is the threshold.

The fit takes all labelled documents, whole texts. How many documents of each class have a bucket is counted over all of
them; buckets met in fewer than ``MIN_DOCS`` keep a zero vector, so unseen words say nothing. The network starts warm on the
driver from at most about ``per_class`` documents of each class, by hash of their id, then learns in tasks from every
document, ``ROUNDS`` times; a network per task from the same start, averaged: each vector by how often a task has moved it,
all else by documents. Where the warm start has all documents, that is all. Thresholds come from all rows kept out, counted by
output in steps of 1 / ``STEPS``.

Null and empty texts score as a text in which no filter responds. Labels that are null or other than 0 and 1 are left
aside; of several labels of one document the largest counts. Without both classes every score is the share
of toxic labels (0 without any). Repeated rows keep a row each. Columns other than those named pass through
``keep_clean`` untouched and are left aside elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.bits import bit_table, on
from trajspark.llm.textbuf import Words, chunks
from trajspark.session import discard, materialize

PER_CLASS, MIN_DOCS, ROUNDS, STEPS = 3000, 3, 2, 256
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 10
#: Documents that a task holds before it learns from them, and rows of vectors that are averaged together.
HELD, PIECE = 2000, 1 << 11
PREFIXES = (4, 6)
#: Letters that mark a language group, as the second byte after 0xC3 in UTF-8. Fixed values.
MARKS = {"german": "äöüßÄÖÜ", "french": "èêëçàâîïôùûœÈÊÇÀ", "spanish": "ñóíúáÑÓÍÚÁ"}
GROUPS = 1 + len(MARKS)
_GROUP = np.zeros(256, np.uint8)
for _k, _letters in enumerate(MARKS.values(), 1):
    for _c in _letters:
        if len(_c.encode()) == 2 and _c.encode()[0] == 0xC3:
            _GROUP[_c.encode()[1]] = _k


def word_features(words: Words) -> np.ndarray:
    """Bucket numbers of each word: whole, and by prefix; 0 is kept for the zero vector."""
    start, stop = words.bare()
    spans = [words.span(start, stop)] + [words.span(start, np.minimum(start + n, stop)) ^ np.uint64(n) for n in PREFIXES]
    return np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for h in spans], 1)


def groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Language group of each text of a run by its marked letters; 0 where there are few."""
    at = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    kind = _GROUP[data[at + 1]] if len(at) else np.zeros(0, np.uint8)
    doc = np.searchsorted(offsets, at, "right") - 1
    n = len(offsets) - 1
    table = np.bincount(doc * GROUPS + kind, minlength=n * GROUPS)[: n * GROUPS].reshape(n, GROUPS)
    table[:, 0] = np.diff(offsets) // 200
    return table.argmax(1)


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    offset: float
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))
    constant: float | None = None

    def pooled(self, vectors: np.ndarray, bounds: np.ndarray, want_at: bool = False):
        """Largest response of every filter in each text, and where. ``bounds``: texts in the list of words."""
        size = np.diff(bounds)
        out = np.full((len(size), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        places = np.zeros(out.shape, np.int64) if want_at else None
        # a text's last words see zero vectors beyond its end
        doc = np.repeat(np.arange(len(size)), size)
        full = np.flatnonzero(size)
        for k, width in enumerate(WIDTHS):
            weights = self.filters[k].reshape(width, DIM, FILTERS)
            response = vectors @ weights[0]
            for j in range(1, width):
                ahead = vectors[j:] @ weights[j]
                same = doc[j:] == doc[:-j]
                response[:-j] += ahead * same[:, None]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if len(full):
                out[full, cols] = np.maximum.reduceat(response, bounds[full], axis=0)
            if want_at:
                for f in full:
                    places[f, cols] = bounds[f] + response[bounds[f] : bounds[f + 1]].argmax(0)
        out[~np.isfinite(out)] = -1e9
        return (out, places) if want_at else out

    def logits(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        vectors = self.embedding[buckets].sum(1)
        active = np.maximum(self.pooled(vectors, bounds) + self.bias, 0)
        return active @ self.output + self.offset


def document_counts(texts: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """How many texts of each class have each bucket."""
    by_class = np.zeros((2, BUCKETS), np.int64)
    for t, y in zip(texts, label):
        by_class[int(y), np.unique(t)] += 1
    return by_class


class Learner:
    """A network and the sums of its squared gradients."""

    def __init__(self, by_class: np.ndarray, sizes: np.ndarray, rng: np.random.Generator):
        """``by_class``: texts of each class with each bucket; ``sizes``: texts of each class."""
        seen = by_class.sum(0)
        self.open = seen >= min(MIN_DOCS, max(1, sizes.sum() // 50))
        self.open[0] = False
        used = np.flatnonzero(self.open)
        e = np.zeros((BUCKETS, DIM), np.float32)
        e[used] = rng.normal(0, 0.1, (len(used), DIM))
        # the first number of each vector starts from how far the word's share of toxic texts lies above that of others
        n0, n1 = np.maximum(sizes, 1)
        share = seen[used] / (n0 + n1)
        spread = np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1)) + 1e-9
        e[used, 0] += np.clip((by_class[1, used] / n1 - by_class[0, used] / n0) / spread / 6 - 0.5, 0, 1.5)
        n_out = len(WIDTHS) * FILTERS
        net = Network(e, [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), -1.0)
        for k, f in enumerate(net.filters):
            f[0, 0], net.output[k * FILTERS] = 2.0, 1.0
            net.bias[k * FILTERS] = -1.0
        self.net = net
        self.state = {k: np.full(v.shape, 1e-6, np.float32) for k, v in (("e", e), ("b", net.bias), ("o", net.output))}
        self.state_f, self.state_0 = [np.full(f.shape, 1e-6, np.float32) for f in net.filters], 1e-6

    def known(self, text: np.ndarray) -> np.ndarray:
        """Buckets of a text with those that keep a zero vector as 0."""
        return np.where(self.open[text], text, 0)

    def learn(self, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
        """A step from a few texts; the buckets whose vectors it has moved."""
        net, e = self.net, self.net.embedding
        size = np.array([len(t) for t in texts])
        bounds = np.concatenate([[0], np.cumsum(size)])
        buckets = np.concatenate(texts)
        # words left out at random, so that a text's other words learn as well
        buckets = buckets * (rng.random((len(buckets), 1)) < rng.uniform(0.3, 1.0))
        if not len(buckets):
            return np.zeros(0, np.int64)
        pooled, places = net.pooled(e[buckets].sum(1), bounds, True)
        active = np.maximum(pooled + net.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ net.output + net.offset, -30, 30)))
        # labels are softened: no text is taken as sure
        g = (p - (0.02 + 0.96 * label)) * weight / len(texts)
        g_active = g[:, None] * net.output * (active > 0)
        g_out = active.T @ g + 1e-4 * net.output
        g_bias = g_active.sum(0)
        rows, values = [], []
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            ga, spot = g_active[:, cols], places[:, cols]
            g_f = np.zeros((width, DIM, FILTERS), np.float32)
            weights = net.filters[k].reshape(width, DIM, FILTERS)
            for j in range(width):
                inside = (spot + j < bounds[1:, None]) & (size[:, None] > 0)
                word = np.where(inside, spot + j, 0)
                v = e[buckets[word]].sum(2) * inside[:, :, None]
                g_f[j] = np.einsum("tf,tfd->df", ga, v)
                g_v = (ga * inside)[:, :, None] * weights[j].T[None]
                some = ga != 0
                b = buckets[word[some]]
                rows.append(b.reshape(-1))
                values.append(np.repeat(g_v[some], b.shape[1], axis=0))
            g_f = g_f.reshape(width * DIM, FILTERS)
            self.state_f[k] += g_f**2
            net.filters[k] -= rate * g_f / np.sqrt(self.state_f[k])
        rows_, values_ = np.concatenate(rows), np.concatenate(values)
        kinds, inverse = np.unique(rows_, return_inverse=True)
        if len(rows_):
            g_e = np.zeros((len(kinds), DIM), np.float32)
            np.add.at(g_e, inverse, values_)
            g_e += 1e-4 * e[kinds]
            self.state["e"][kinds] += g_e**2
            e[kinds] -= rate * g_e / np.sqrt(self.state["e"][kinds])
            e[0] = 0
        for key, grad, array in (("b", g_bias, net.bias), ("o", g_out, net.output)):
            self.state[key] += grad**2
            array -= rate * grad / np.sqrt(self.state[key])
        self.state_0 += g.sum() ** 2
        net.offset -= float(rate * g.sum() / np.sqrt(self.state_0))
        return kinds

    def dense(self) -> np.ndarray:
        """All numbers but those of the vectors, the sums of squares included."""
        net = self.net
        parts = [net.bias, net.output, *net.filters, self.state["b"], self.state["o"], *self.state_f, np.array([net.offset, self.state_0])]
        return np.concatenate([np.asarray(x, np.float64).ravel() for x in parts])

    def take_dense(self, flat: np.ndarray) -> None:
        net = self.net
        for x in (net.bias, net.output, *net.filters, self.state["b"], self.state["o"], *self.state_f):
            x[...], flat = flat[: x.size].reshape(x.shape), flat[x.size :]
        net.offset, self.state_0 = map(float, flat)


def train(texts: list[np.ndarray], label: np.ndarray, by_class: np.ndarray, sizes: np.ndarray, seed: int = 7) -> Learner:
    """Learner from each text's buckets (words x 3) and its label 0 or 1, and the counts of all texts."""
    rng = np.random.default_rng(seed)
    own = Learner(by_class, sizes, rng)
    texts = [own.known(t) for t in texts]
    order = np.arange(len(texts))
    epochs = int(np.clip(24_000 // max(1, len(texts)), 4, 60))
    for epoch in range(epochs):
        rate = 0.08 * (1 - epoch / epochs) + 0.01
        rng.shuffle(order)
        for at in range(0, len(order), 16):
            pick = order[at : at + 16]
            own.learn([texts[i] for i in pick], label[pick], np.ones(len(pick)), rate, rng)
    return own


def calibrate(net: Network, logit: np.ndarray, hits: np.ndarray, misses: np.ndarray, group: np.ndarray) -> None:
    """Threshold of each language group, of most F1 on counts of toxic rows (``hits``) and others by logit and group; a group
    with few toxic rows takes that of all."""

    def best(rows: np.ndarray) -> float:
        at, inverse = np.unique(-logit[rows], return_inverse=True)
        hit, miss = (np.cumsum(np.bincount(inverse, x[rows], len(at))) for x in (hits, misses))
        f1 = 2 * hit / (hit + miss + hit[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        k = int(top[len(top) // 2])
        below = -at[k + 1] if k + 1 < len(at) else -at[k] - 1
        return float((-at[k] + below) / 2)

    rows = np.arange(len(logit))
    if not len(rows) or not hits.sum():
        return
    net.threshold[:] = best(rows)
    for k in range(GROUPS):
        own = rows[group == k]
        if hits[own].sum() >= 25:
            net.threshold[k] = best(own)


def _maybe(batches: Iterator[pa.RecordBatch], marks) -> Iterator[pa.RecordBatch]:
    """Rows whose doc_id a table may have."""
    for b in batches:
        yield b.filter(pa.array(on(marks.value, b.column(0).to_numpy())))


def _features(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(label, group, buckets of each text) of runs of (toxic, text)."""
    label = b.column(0).to_numpy().astype(np.int64)
    for first, last, data, offsets in chunks(b.column(1)):
        words = Words(data, offsets)
        f = word_features(words)
        yield label[first:last], groups(data, offsets), [f[words.bounds[i] : words.bounds[i + 1]] for i in range(last - first)]


def _warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for label, _, texts in _features(b):
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array([t.tobytes() for t in texts], pa.binary())], ["toxic", "features"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for label, _, texts in _features(b):
            total += document_counts(texts, label)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["at", "n"])


def _learned(batches: Iterator[pa.RecordBatch], sent, weights: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """What a task has learned from its documents: pieces of its vectors times how often each was moved, with these numbers,
    and all else times its documents."""
    from copy import deepcopy

    own, rng = deepcopy(sent.value), np.random.default_rng(3)
    moved, docs = np.zeros(BUCKETS, np.int64), 0
    texts: list[np.ndarray] = []
    label: list[int] = []

    def learn() -> None:
        y = np.array(label)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 16):
            pick = order[at : at + 16]
            moved[own.learn([texts[i] for i in pick], y[pick], weights[y[pick]], rate, rng)] += 1
        texts.clear()
        label.clear()

    for b in batches:
        for y, _, found in _features(b):
            texts += [own.known(t) for t in found]
            label += y.tolist()
            docs += len(found)
            if len(texts) >= HELD:
                learn()
    if texts:
        learn()
    if not docs:
        return
    rows = [np.append(own.dense() * docs, docs)]
    for at in range(0, BUCKETS, PIECE):
        n = moved[at : at + PIECE, None]
        rows.append(np.hstack([own.net.embedding[at : at + PIECE] * n, own.state["e"][at : at + PIECE] * n, n]).astype(np.float32).ravel())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([x.tobytes() for x in rows], pa.binary())], ["piece", "numbers"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the numbers of each piece, of rows sorted by piece."""
    last, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "numbers"])

    for b in batches:
        for piece, raw in zip(*(c.to_pylist() for c in b.columns)):
            numbers = np.frombuffer(raw, np.float32 if piece else np.float64).astype(np.float64)
            if piece != last:
                if last is not None:
                    yield row()
                last, total = piece, np.zeros(len(numbers))
            total += numbers
    if last is not None:
        yield row()


def learn_from_all(own: Learner, rows: DataFrame, weights: np.ndarray, rounds: int = ROUNDS) -> None:
    """``own`` learns from all ``rows`` (toxic, text), each by the weight of its class."""
    context, partitions = rows.sparkSession.sparkContext, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(rounds):
        sent = context.broadcast(own)
        parts = rows.mapInArrow(lambda b, sent=sent, rate=0.02 / (k + 1): _learned(b, sent, weights, rate), "piece int, numbers binary")
        found = parts.repartition(partitions, "piece").sortWithinPartitions("piece").mapInArrow(_added, "piece int, numbers binary").toArrow()
        for piece, raw in zip(*(c.to_pylist() for c in found.columns)):
            numbers = np.frombuffer(raw, np.float64)
            if not piece:
                own.take_dense(numbers[:-1] / numbers[-1])
                continue
            numbers = numbers.reshape(PIECE, -1)
            some = np.flatnonzero(numbers[:, -1])
            mean = numbers[some, :-1] / numbers[some, -1:]
            at = (piece - 1) * PIECE + some
            own.net.embedding[at], own.state["e"][at] = mean[:, :DIM], mean[:, DIM:]
        sent.destroy()


def _logit_counts(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(group, step, toxic, n): rows by output in steps of 1 / STEPS."""
    for b in batches:
        for label, group, texts in _features(b):
            z = sent.value.logits(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
            step = np.floor(np.clip(z, -1000, 1000) * STEPS).astype(np.int64)
            kinds, n = np.unique(np.stack([group, step, label], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(kinds[:, k]) for k in range(3)), pa.array(n)], ["grp", "step", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Network from all ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    labels = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    labels = labels.withColumn("held", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0).cast("int"))
    # hardly any but labelled documents travel, and a hash table of labels instead of a sort of whole texts
    marks = docs.sparkSession.sparkContext.broadcast(bit_table(labels.select("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = rows.mapInArrow(lambda b: _maybe(b, marks), "doc_id long, text string").join(labels.hint("shuffle_hash"), "doc_id")
    rows = materialize(rows.select("doc_id", "toxic", "held", "text"), "labelled")
    marks.destroy()
    n = np.zeros((2, 2), np.int64)  # by toxic and held
    for r in rows.groupBy("toxic", "held").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["toxic"], r["held"]] = r["n"]
    if not n.sum(1).all():
        net = Network(np.zeros((BUCKETS, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0)
        sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        net.constant = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.0
        discard(rows)
        return net
    few = n[1, 1] < 5 or not n[:, 0].all()
    sizes, learn = (n.sum(1), rows) if few else (n[:, 0], rows.where("held = 0"))
    counts = learn.select("toxic", "text").mapInArrow(_bucket_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    by_class = np.zeros(2 * BUCKETS, np.int64)
    by_class[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    # the warm start: at most about two times per_class documents, whatever the input
    share = np.minimum(1.0, per_class / n.sum(1))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = learn.where(spread < F.when(F.col("toxic") == 1, int(1e6 * share[1])).otherwise(int(1e6 * share[0])))
    table = sample.select("toxic", "text").mapInArrow(_warm, "toxic int, features binary").toArrow()
    label = table.column(0).to_numpy().astype(np.int64)
    features = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in table.column(1).to_pylist()]
    # an order that does not depend on how Spark dealt the rows
    order = np.lexsort(([len(f) for f in features], [int(f.sum(dtype=np.int64)) for f in features]))
    own = train([features[i] for i in order], label[order], by_class.reshape(2, BUCKETS), sizes)
    if share.min() < 1:
        # classes weigh as in the warm start
        learn_from_all(own, learn.select("toxic", "text"), share * sizes.sum() / (share * sizes).sum())
    sent = docs.sparkSession.sparkContext.broadcast(own.net)
    test = (rows if few else rows.where("held = 1")).select("toxic", "text")
    found = test.mapInArrow(lambda b: _logit_counts(b, sent), "grp long, step long, toxic long, n long")
    found = found.groupBy("grp", "step").agg(F.sum(F.expr("n * toxic")).alias("hits"), F.sum(F.expr("n * (1 - toxic)")).alias("misses")).toArrow()
    group, step, hits, misses = (found.column(k).to_numpy() for k in range(4))
    calibrate(own.net, (step + 0.5) / STEPS, hits, misses, group)
    sent.destroy()
    discard(rows)
    return own.net


def scores(net: Network, column) -> np.ndarray:
    """Score of each text of an Arrow column."""
    if net.constant is not None:
        return np.full(len(column), net.constant)
    out = []
    for _, _, data, offsets in chunks(column, 1 << 20):
        words = Words(data, offsets)
        z = net.logits(word_features(words), words.bounds) - net.threshold[groups(data, offsets)]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def _scored(batches: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = scores(net.value, b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 up) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _scored(b, sent), "doc_id long, score double, predicted int"
    )


def _clean(batches: Iterator[pa.RecordBatch], net, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(scores(net.value, b.column(at)) < 0.5))


def keep_clean(docs: DataFrame, net: Network) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below 0.5."""
    sent, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")
    return docs.mapInArrow(lambda b: _clean(b, sent, at), docs.schema)
