"""Token ids of whole texts with a ``tokenizers`` vocabulary, each distinct word encoded once per worker.

The vocabulary's pre-tokenizer never joins characters across white space, nor a Latin letter and an ASCII
punctuation mark after it, so a text's ids are the ids of the words between such places in order (texts
that may hold special tokens are cut at spaces only).  Words are numbered as they come; new ones are encoded
in bulk by the library and remembered in a bounded table.  When it is full, the words that came again since it was
last full stay and the others go; this never changes a result.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardlens.llm.common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and ids that a worker remembers at most.
MAX_WORDS = 250_000
MAX_IDS = 2_000_000
#: Put between words that are encoded together; a single id which words seldom contain.
SEPARATOR = "日"


class _Numbers(dict):
    """Word -> number; unseen words get the next number and wait in ``new``."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__((w, n) for n, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        sep = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = sep[0] if len(sep) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        #: Words that came in a later chunk than their first one.
        self.again = np.zeros(1024, bool)
        self.known = self.used = 0

    def _make_room(self) -> None:
        """Keep the words that came again, if they leave half of the table free."""
        again = self.again[:self.known]
        kept = np.flatnonzero(again)
        lens = self.lens[kept]
        used = int(lens.sum())
        if len(kept) > MAX_WORDS // 2 or used > MAX_IDS // 2:
            self._reset()
            return
        flat = self.flat[ragged(self.starts[kept], lens)]
        numbers = _Numbers(compress(self.numbers, again.tolist()))
        self._reset()
        self.numbers, self.known, self.used = numbers, len(kept), used
        self._grow()
        self.lens[:self.known] = lens
        self.starts[:self.known] = np.cumsum(lens) - lens
        self.flat[:self.used] = flat

    def _grow(self) -> None:
        while self.known > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
            self.again = np.concatenate([self.again, np.zeros(len(self.again), bool)])
        while self.used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))

    def _bulk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        if self.separator is not None:
            joined = self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(words)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) == len(words) - 1:
                bounds = np.concatenate([[-1], cuts, [len(ids)]])
                return np.delete(ids, cuts), np.diff(bounds) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _learn(self) -> None:
        words, self.numbers.new = self.numbers.new, []
        for i in range(0, len(words), 4096):
            ids, lens = self._bulk(words[i:i + 4096])
            word, at = self.known, self.used
            self.known += len(lens)
            self.used += len(ids)
            self._grow()
            self.lens[word:self.known] = lens
            self.starts[word:self.known] = at + np.cumsum(lens) - lens
            self.flat[at:self.used] = ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls as '') one after the other, and the number of ids of each text."""
        if self.known > MAX_WORDS or self.used > MAX_IDS:
            self._make_room()
        texts = pc.fill_null(texts, "")
        spaced = pc.replace_substring_regex(texts, r"([a-zA-Zß-öø-ÿ])([!-/:-@\[-`{-~])", r"\1 \2")
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, spaced) if pc.any(special).as_py() else spaced
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        number = self.numbers.__getitem__
        # the vocabulary is lower case: ASCII words are numbered without case
        names = [w.lower() if w.isascii() and "<|" not in w else w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        unique = np.fromiter(map(number, names), np.int64, len(names))
        index = unique[coded.indices.to_numpy()]
        self.again[unique[unique < self.known]] = True
        if self.numbers.new:
            self._learn()
        lens = self.lens[index]
        ids = self.flat[ragged(self.starts[index], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        return ids, np.diff(ends[bounds])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
