"""Token ids by the public tokenizers, with the ids of frequent words kept in each Python worker.

For the lower-casing word tokenizer a text's ids are those of its white-space-separated words in turn: it drops white
space before it splits, and no rule of its looks across it. So each distinct word is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np

from trajspark.llm.textbuf import Words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words whose ids a worker keeps, some 40 bytes each; beyond it the store starts anew.
WORDS_KEPT, LETTERS_KEPT = 800_000, 100_000

_SIMPLE = re.compile(r"([^\W\d_]+)([.,;:!?|]*)")


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file and its library's version."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        h.update(f.read())
    if path.endswith(".json"):
        import tokenizers

        h.update(f"tokenizers {tokenizers.__version__}".encode())
    else:
        import sentencepiece

        h.update(f"sentencepiece {sentencepiece.__version__}".encode())
    return h.hexdigest()


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable Latin-1, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordIds:
    """Ids of words by the library, kept by word hash in flat arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = _byte_chars()
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.letters: dict[str, list[int]] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 15, np.int64)
        self.length = np.zeros(1 << 15, np.int32)
        self.used = 0

    def _letters(self, word: str) -> list[int]:
        ids = self.letters.get(word)
        if ids is None:
            if len(self.letters) > LETTERS_KEPT:
                self.letters.clear()
            spelled = word if word.isascii() else "".join(self.chars[b] for b in word.encode())
            ids = self.letters[word] = [t.id for t in self.model.tokenize(spelled)]
        return ids

    def encode(self, words: list[str]) -> list[list[int]]:
        """Plain words of Latin letters with closing punctuation go to the merges directly: the library's normaliser
        leaves them as they are and its splitter cuts between letters and punctuation. All others take the whole way."""
        out: list[list[int] | None] = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            m = _SIMPLE.fullmatch(word)
            if m and (low := m[1].lower()) and (low.isascii() or max(low) < "ɐ"):
                out[i] = self._letters(low) + (self._letters(m[2]) if m[2] else [])
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def lookup(self, words: Words, parts: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each distinct word, position of each word among the distinct ones). ``parts``: numpy's unique of the
        words' hashes with first places and inverse, where the caller has it already."""
        distinct, first, inverse = parts or np.unique(words.hash(), return_index=True, return_inverse=True)
        slots = self.slots_of(distinct)
        missing = np.flatnonzero(slots < 0)
        if len(missing) and len(self.keys) + len(missing) > WORDS_KEPT:
            self.reset()
            slots[:], missing = -1, np.arange(len(distinct))
        if len(missing):
            base, n = len(self.keys), len(missing)
            found = self.encode([words.text(i) for i in first[missing].tolist()])
            sizes = np.fromiter(map(len, found), np.int64, n)
            while base + n > len(self.begin):
                self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
            while self.used + sizes.sum() > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.begin[base : base + n] = self.used + np.cumsum(sizes) - sizes
            self.length[base : base + n] = sizes
            self.pool[self.used : self.used + sizes.sum()] = np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum())
            self.used += int(sizes.sum())
            slots[missing] = base + np.arange(n)
            places = np.searchsorted(self.keys, distinct[missing])
            self.keys = np.insert(self.keys, places, distinct[missing])
            self.slots = np.insert(self.slots, places, slots[missing].astype(np.int32))
        return slots, inverse

    def slots_of(self, distinct: np.ndarray) -> np.ndarray:
        """Slots of sorted word hashes, -1 for those not kept."""
        if not len(self.keys):
            return np.full(len(distinct), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.where(self.keys[at] == distinct, self.slots[at], -1).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text of a run."""
        words = Words(data, offsets, lower=not _special(data))
        slots, inverse = self.lookup(words)
        n = np.concatenate([[0], np.cumsum(self.length[slots][inverse] if len(words) else [])]).astype(np.int64)
        return n[words.bounds[1:]] - n[words.bounds[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray, words: Words | None = None, parts: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and the n+1 offsets of the texts in them. ``words``: the run's lower-cased words,
        with ``parts`` as in ``lookup``, where the caller has them."""
        if words is None or _special(data):
            words, parts = Words(data, offsets, lower=not _special(data)), None
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        slots, inverse = self.lookup(words, parts)
        length = self.length[slots][inverse].astype(np.int64)
        ends = np.cumsum(length)
        shift = np.repeat(self.begin[slots][inverse] - (ends - length), length)
        flat = self.pool[shift + np.arange(len(shift))]
        return flat, np.concatenate([[0], ends])[words.bounds]


def _special(data: np.ndarray) -> bool:
    """Whether strings of special tokens may occur, which match by case before lower-casing."""
    return b"<|" in data.tobytes()


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's store for a tokenizer file."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def by_words(path: str) -> bool:
    """Whether ``path`` is a tokenizer whose ids can be put together from words: lower-cases, drops white space."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path) as f:
        spec = json.load(f)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Counts by the library alone, for any tokenizer file."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
