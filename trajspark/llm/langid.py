"""Language identification by interpolated Kneser-Ney character models.

Characters are letters in lower case; every run of letters is a word with blanks before it and one blank after it. The
n-grams of all languages are kept in one sorted hash array per order, with a row of log probabilities by language; the
language of lowest cross-entropy per character wins. The score is its posterior at a temperature fitted on documents
kept out of the counts, which also give the rejection limit of each language.

The fit takes a bounded sample: of each language, documents are taken by hash of their id at the share that gives
``per_language`` documents; a language with fewer gives all.

Null texts and texts without letters give ``und`` with score 0. Ties go to the alphabetically first language. With no
training rows at all, every text gives ``und``. Columns other than those named are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.textbuf import Words, chunks, mix

ORDER, DISCOUNT, PER_LANGUAGE = 4, 0.75, 3000
_M = np.uint64(0x9E3779B97F4A7C15)
_letter = np.zeros(0x110000, np.int8)  # 1: a letter, -1: not, 0: not yet looked at


def letters_only(points: np.ndarray) -> np.ndarray:
    """Code points with all but letters made blanks."""
    fresh = np.unique(points)
    fresh = fresh[_letter[fresh] == 0]
    _letter[fresh] = [1 if chr(c).isalpha() else -1 for c in fresh.tolist()]
    return np.where(_letter[points] > 0, points, 32)


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each position, for n = 1 to ORDER; a word's first letters see blanks only."""
    c = points.astype(np.uint64) + np.uint64(1)
    out, blank = [mix(c)], np.uint64(33)
    back = np.full(len(c), True)  # no blank met yet, looking back
    h = c.copy()
    for n in range(1, ORDER):
        prev = np.concatenate([np.full(min(n, len(c)), blank), c[:-n]]) if len(c) else c
        if n > 1:
            near = np.concatenate([np.full(min(n - 1, len(c)), blank), c[: -(n - 1)]])
            back &= near != blank
        prev = np.where(back, prev, blank)
        with np.errstate(over="ignore"):
            h = h * _M + prev
        out.append(mix(h + np.uint64(n)))
    return out


def contexts(points: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-1 characters before each position, for n = 2 to ORDER, as ``grams`` would give it for n-grams whose
    last character is left out."""
    c = points.astype(np.uint64) + np.uint64(1)
    blank, out = np.uint64(33), []
    back, h = np.full(len(c), True), np.zeros(len(c), np.uint64)
    for n in range(1, ORDER):
        prev = np.concatenate([np.full(min(n, len(c)), blank), c[:-n]]) if len(c) else c
        if n > 1:
            near = np.concatenate([np.full(min(n - 1, len(c)), blank), c[: -(n - 1)]])
            back &= near != blank
        prev = np.where(back, prev, blank)
        with np.errstate(over="ignore"):
            h = h * _M + prev
        out.append(mix(h ^ np.uint64(0x5BD1E995 + n)))
    return out


def word_points(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the given words, each with a blank before and after it, and the word of each position."""
    raw = data.tobytes()
    text = " " + " ".join([raw[a:b].decode("utf-8", "replace").replace(" ", "") for a, b in zip(starts.tolist(), stops.tolist())]) + " "
    lower = text.lower()
    points = np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)
    # a blank ends the word before it
    word = np.cumsum(points == 32) - 1 - (points == 32)
    return letters_only(points), np.clip(word, 0, len(starts) - 1)


def scored(points: np.ndarray) -> np.ndarray:
    """Positions that the model predicts: letters, and the blank that ends a run of them."""
    is_letter = points != 32
    ends = np.zeros(len(points), bool)
    ends[1:] = is_letter[:-1] & ~is_letter[1:]
    return is_letter | ends


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # of each order, sorted
    logs: list[np.ndarray]  # rows of log probabilities by language
    context_keys: list[np.ndarray]  # from order 2
    backoff: list[np.ndarray]
    unseen: float
    temperature: float = 1.0
    limit: np.ndarray | None = None

    def score(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability by language of each predicted position, those positions)."""
        at = np.flatnonzero(scored(points))
        gram, context = [g[at] for g in grams(points)], [c[at] for c in contexts(points)]
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            keys = self.keys[n - 1]
            if len(keys) and len(left):
                g = gram[n - 1][left]
                i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                hit = keys[i] == g
                out[left[hit]] += self.logs[n - 1][i[hit]]
                left = left[~hit]
            if n > 1 and len(left) and len(self.context_keys[n - 2]):
                keys, c = self.context_keys[n - 2], context[n - 2][left]
                i = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                hit = keys[i] == c
                out[left[hit]] += self.backoff[n - 2][i[hit]]
        out[left] += self.unseen
        return out, at

    def entropies(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By runs of rows: (nats per character by language, characters)."""
        for _, _, data, offsets in chunks(column):
            words = Words(data, offsets, lower=True)
            nats, chars = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
            if len(words):
                _, first, inverse = np.unique(words.hash(), return_index=True, return_inverse=True)
                points, word = word_points(words.data, words.start[first], words.stop[first])
                logs, at = self.score(points)
                per_word = np.stack([np.bincount(word[at], logs[:, k], len(first)) for k in range(len(self.languages))], 1)
                size = np.bincount(word[at], minlength=len(first))
                doc = words.doc
                for k in range(len(self.languages)):
                    nats[:, k] = -np.bincount(doc, per_word[inverse, k], len(nats))
                chars = np.bincount(doc, size[inverse], len(nats))
            yield nats / np.maximum(chars, 1)[:, None], chars


def kneser_ney(languages: list[str], rows: list[tuple[str, str, int]]) -> Model:
    """Model from (language, n-gram of ORDER characters, count)."""
    index = {x: k for k, x in enumerate(languages)}
    points = np.array([[ord(c) for c in g] for _, g, _ in rows], np.uint32).reshape(-1, ORDER)
    lang = np.array([index[x] for x, _, _ in rows], np.int64)
    count = np.array([n for _, _, n in rows], np.float64)
    n_lang, keys, logs, context_keys, backoff = len(languages), [], [], [], []
    # an n-gram's hashes, as ``grams`` and ``contexts`` give them at its last position
    flat = np.concatenate([np.full((len(points), ORDER), 32, np.uint32), points], 1).reshape(-1)
    last = np.arange(len(points)) * 2 * ORDER + 2 * ORDER - 1
    gram, context = [g[last] for g in grams(flat)], [c[last] for c in contexts(flat)]
    unseen = np.log(1 / (len(np.unique(points[:, -1])) + 1)) if len(points) else np.log(1 / 256)
    # counts by order: raw at the top, below it the number of distinct characters seen before the n-gram
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    row, weight = np.arange(len(points)), count
    for n in range(ORDER, 0, -1):
        pair = np.stack([lang[row].astype(np.uint64), gram[n - 1][row]], 1)
        _, first, inverse = np.unique(pair, axis=0, return_index=True, return_inverse=True)
        total = np.bincount(inverse.reshape(-1), weight, len(first))
        row = row[first]
        levels.append((row, total, gram[n - 1][row], context[n - 2][row] if n > 1 else np.zeros(len(row), np.uint64)))
        weight = np.ones(len(row))
    lower_log: np.ndarray | None = None
    lower_keys: np.ndarray | None = None
    for n in range(1, ORDER + 1):
        row, total, g, ctx = levels[ORDER - n]
        l = lang[row]
        ukeys, pos = np.unique(g, return_inverse=True)
        rep = np.zeros(len(ukeys), np.int64)
        rep[pos] = row
        ckeys, cpos = np.unique(ctx, return_inverse=True)
        csum, ckinds = np.zeros((len(ckeys), n_lang)), np.zeros((len(ckeys), n_lang))
        np.add.at(csum, (cpos, l), total)
        np.add.at(ckinds, (cpos, l), 1)
        own = np.zeros((len(ukeys), n_lang))
        np.add.at(own, (pos, l), np.maximum(total - DISCOUNT, 0))
        at_ctx = np.zeros(len(ukeys), np.int64)
        at_ctx[pos] = cpos
        bow = np.where(csum > 0, DISCOUNT * ckinds / np.maximum(csum, 1), 1.0)
        if n == 1:
            below = np.full((len(ukeys), n_lang), np.exp(unseen))
        else:
            i = np.searchsorted(lower_keys, gram[n - 2][rep])
            below = np.exp(lower_log[i])
        p = own / np.maximum(csum[at_ctx], 1) + bow[at_ctx] * below
        lower_keys, lower_log = ukeys, np.log(p)
        keys.append(ukeys)
        logs.append(lower_log.astype(np.float32))
        if n > 1:
            context_keys.append(ckeys)
            backoff.append(np.log(bow).astype(np.float32))
        else:
            unseen_bow = float(np.log(bow).mean()) if len(bow) else 0.0
    return Model(languages, keys, logs, context_keys, backoff, float(unseen) + unseen_bow)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        languages = np.array(b.column(0).to_pylist(), object)
        for first, last, data, offsets in chunks(b.column(1)):
            words = Words(data, offsets)
            doc = words.doc
            for x in sorted(set(languages[first:last])):
                own = np.flatnonzero((languages[first:last] == x)[doc]) if len(words) else []
                if not len(own):
                    continue
                h = words.span(words.start[own], words.stop[own])
                _, one, n = np.unique(h, return_index=True, return_counts=True)
                points, word = word_points(words.data, words.start[own][one], words.stop[own][one])
                at = np.flatnonzero(scored(points))
                padded = np.concatenate([np.full(ORDER, 32, points.dtype), points])
                window = np.stack([padded[at + ORDER - k] for k in range(ORDER - 1, -1, -1)], 1)
                for k in range(ORDER - 2, -1, -1):  # what lies before a blank is not seen
                    later = (window[:, k + 1 : ORDER - 1] == 32).any(1)
                    window[later, k] = 32
                kinds, inverse = np.unique(window, axis=0, return_inverse=True)
                total = np.bincount(inverse.reshape(-1), n[word[at]], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * len(kinds), pa.string()), pa.array(["".join(map(chr, g)) for g in kinds.tolist()], pa.string()), pa.array(total)],
                    ["lang", "gram", "n"],
                )


def _measure(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [h.tolist() for h, _ in model.entropies(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for r in rows for h in r], pa.list_(pa.float64()))], ["lang", "nats"])


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id") -> Model:
    """Model from (key, lang, text) rows. A fifth of the sample is kept out of the counts for temperature and
    limits, but none of a language of fewer than ten rows."""
    rows = rows.where(F.col("lang").isNotNull()).select(F.col(key).alias("key"), F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return kneser_ney([], [])
    spread = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    share: Column = F.lit(0)
    for x, n in sizes.items():
        share = F.when(F.col("lang") == x, int(1_000_000 * min(1.0, per_language / n))).otherwise(share)
    sample = rows.where(spread < share).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "key"), F.lit(5)) == 0)
    # languages with hardly any rows stay wholly in the counts; the others are held out in part as ever
    few = [x for x, n in sizes.items() if n < 10]
    if few:
        sample = sample.withColumn("held", F.col("held") & ~F.col("lang").isin(few))
    counted = (
        sample.where("not held").select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    table = counted.toArrow()
    columns = [table.column(k).to_pylist() for k in range(3)]
    model = kneser_ney(languages, list(zip(*columns)))
    model.limit = np.full(len(languages), np.inf)
    held = sample.where("held").select("lang", "text").mapInArrow(lambda b: _measure(b, model), "lang string, nats array<double>").toArrow()
    if held.num_rows:
        calibrate(model, np.array(held.column(0).to_pylist(), object), np.array(held.column(1).to_pylist()))
    return model


def calibrate(model: Model, lang: np.ndarray, nats: np.ndarray) -> None:
    """Temperature of least log loss, and for each language the entropy above which a text is rejected."""
    right = np.searchsorted(model.languages, lang.astype(str))
    best = (np.inf, 1.0)
    for t in 2.0 ** np.arange(-2, 8):
        z = -t * nats
        z -= z.max(1, keepdims=True)
        loss = -(z[np.arange(len(z)), right] - np.log(np.exp(z).sum(1))).mean()
        best = min(best, (loss, t))
    model.temperature = best[1]
    for k in range(len(model.languages)):
        own = nats[right == k, k]
        if len(own) >= 20:
            model.limit[k] = np.quantile(own, 0.99) + 2 * own.std()


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, score, entropy, rejected = [], [], [], []
        if not model.languages:
            n = len(b.column(0))
            found, score, entropy, rejected = ["und"] * n, [0.0] * n, [0.0] * n, [True] * n
        for nats, chars in model.entropies(b.column(1)) if model.languages else ():
            best = nats.argmin(1)
            z = -model.temperature * nats
            z = np.exp(z - z.max(1, keepdims=True))
            p = z[np.arange(len(z)), best] / z.sum(1)
            low = nats[np.arange(len(z)), best]
            some = chars > 0
            found += np.where(some, np.array(model.languages, object)[best], "und").tolist()
            score += np.where(some, p, 0.0).tolist()
            entropy += low.tolist()
            rejected += (~some | (low > model.limit[best])).tolist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
            ["doc_id", "lang_pred", "score", "nats_per_char", "rejected"],
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, nats_per_char, rejected (its entropy is above the language's limit)."""
    schema = "doc_id long, lang_pred string, score double, nats_per_char double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _predict(b, model), schema)


def held_out(modulus: int, remainder: int = 0) -> Column:
    """Whether crc32 of the doc_id's text has that remainder; a row without doc_id counts as not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
