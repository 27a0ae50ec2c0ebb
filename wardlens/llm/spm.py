"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding merges adjacent symbols by the model's agenda (best score first, then leftmost).  Each candidate taken from the
agenda is skipped with probability ``DROP``; the j-th decision within a word is bit j of a hash of seed, document and
word place, so a document gives the same ids on every machine and try, and other seeds other segmentations.  Without
dropout the ids are those of the library.

No piece joins a character and a space after it, nor contains a line feed, so a text falls into words (a run of spaces
with the characters up to the next space or line feed) that merge apart.  What a word becomes depends on its decisions
alone, as many as it used; results are remembered by word and decisions in a table that is emptied when full.

Characters without a piece, and a literal U+2581, are written as bytes, so that decoding always gives the text back.

Defined cases: null text is an empty one, with no ids; repeated rows give the same ids if their doc_id is the same; a
null doc_id counts as -1; empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import chunks, column, ragged, rows, splitmix

SPACE = "▁"
#: Stands for a literal space mark; half a surrogate pair, which no text holds.
LITERAL = "\udc81"
#: Chance of a skip, in 256ths.
DROP = 8
#: Words and segmentations, and their ids, that a worker remembers at most.
MAX_ENTRIES, MAX_IDS = 1_000_000, 8_000_000
#: Words of so many characters take less than 64 decisions: each merge offers two candidates at most.
SHORT = 20
_WORD = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
_ROWS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("plain_ids", pa.int64()), ("changed_words", pa.int64())])
IDS_DDL = "doc_id long, ids array<int>, plain_ids long, changed_words long"


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.merges = {p: (-self.library.get_score(i), i) for i, p in enumerate(self.pieces)
                       if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))}
        # words merge apart only if no piece crosses their bounds
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.merges)
        self.ranks = {p: low for p, (low, _) in self.merges.items()}
        values = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([values[i]]) if i in values else p.replace(SPACE, " ").encode() if p in self.merges else b""
                      for i, p in enumerate(self.pieces)]
        #: Merges that made each piece.
        self.gains = [len(p) - 1 if p in self.merges else 0 for p in self.pieces]
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}                     # word -> entry
        self.names: list[str] = []
        self.forms: dict[tuple[int, int, int], int] = {}    # (word's entry, decisions used, decisions) -> entry
        self.used_by: dict[int, list[int]] = {}
        # per entry: where its ids are, and for words the decisions used without dropout
        self.start, self.size, self.used, self.flat = (array(t) for t in "qqqi")

    def _entry(self, used: int, ids: Iterable[int]) -> int:
        self.start.append(len(self.flat))
        self.flat.extend(ids)
        self.size.append(len(self.flat) - self.start[-1])
        self.used.append(used)
        return len(self.start) - 1

    def _ids(self, symbols: Iterable[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            if s in self.merges:
                out.append(self.merges[s][1])
            else:
                out += [self.byte_ids[b] for b in (SPACE if s == LITERAL else s).encode()]
        return tuple(out)

    def merge(self, word: str, skip) -> tuple[int, tuple[int, ...]]:
        """Decisions used and ids of a word; ``skip(j)`` tells whether the j-th candidate is skipped."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (found := self.merges.get(symbols[a] + symbols[b])):
                heapq.heappush(agenda, (found[0], a, b, symbols[a] + symbols[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        used = 0
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != joined or right[a] != b:
                continue
            used += 1
            if skip(used - 1):
                continue
            symbols[a], symbols[b] = joined, None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return used, self._ids(s for s in symbols if s is not None)

    def merge_short(self, word: str, bits: int) -> tuple[int, tuple[int, ...]]:
        """``merge`` for words of at most ``SHORT`` characters, whose decisions all fit in ``bits``."""
        rank, none = self.ranks, float("inf")
        symbols = list(word)
        best = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        used = 0
        while best and (low := min(best)) != none:
            i = best.index(low)
            skip = bits >> used & 1
            used += 1
            if skip:
                best[i] = none
                continue
            symbols[i] += symbols.pop(i + 1)
            del best[i]
            if i:
                best[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
            if i < len(best):
                best[i] = rank.get(symbols[i] + symbols[i + 1], none)
        return used, self._ids(symbols)

    def learn(self, words: list[str]) -> None:
        """Decisions and ids without dropout of new words; the library encodes those that begin as it begins a text."""
        usual = [w for w in words if w[0] == SPACE and LITERAL not in w and w.strip(SPACE)]
        for word, ids in zip(usual, self.library.encode([w[1:].replace(SPACE, " ") for w in usual])):
            self.words[word] = self._entry(sum(self.gains[i] for i in ids), ids)
        for word in words:
            if word not in self.words:
                self.words[word] = self._entry(*self.merge(word, lambda j: False))

    def dropped(self, entry: int, word: str, bits: int, more) -> int:
        """Entry of a word under the decisions ``bits`` (the first 64) and ``more(j)`` for those after."""
        for used in self.used_by.get(entry, ()):
            if (got := self.forms.get((entry, used, bits & ((1 << used) - 1)))) is not None:
                return got
        if len(word) <= SHORT:
            used, ids = self.merge_short(word, bits)
        else:
            used, ids = self.merge(word, lambda j: bits >> j & 1 if j < 64 else more(j))
        made = self._entry(used, ids)
        if used <= 64:
            self.forms[entry, used, bits & ((1 << used) - 1)] = made
            known = self.used_by.setdefault(entry, [])
            if used not in known:
                known.append(used)
        return made

    def encode(self, texts: list[str], doc_ids: list[int], seed: int = 0, drop: int = DROP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts; then for each text its number of ids, that without dropout, and the words that changed."""
        if len(self.start) >= MAX_ENTRIES or len(self.flat) >= MAX_IDS:
            self.reset()
        split = [_WORD.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        words = [w for own in split for w in own]
        known = self.words
        self.learn([w for w in dict.fromkeys(words) if w not in known])
        entry = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.array(doc_ids, np.int64).view(np.uint64), counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = splitmix(splitmix(doc ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + place.astype(np.uint64))
        bits = dropped_bits(key, 0, drop)
        plain = entry.copy()
        # only decisions that a word takes without dropout can change its course
        used = np.frombuffer(self.used, np.int64)[entry]
        first = np.where(used >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(used, 63).astype(np.uint64)) - np.uint64(1))
        touched = np.flatnonzero((bits & first != 0) | (used > 64))
        for i, e, b in zip(touched.tolist(), entry[touched].tolist(), bits[touched].tolist()):
            entry[i] = self.dropped(e, words[i], b, lambda j, k=key[i:i + 1]: int(dropped_bits(k, j // 64, drop)[0]) >> j % 64 & 1)
        # copies: the tables cannot grow while numpy looks at them
        start, size, flat = (np.array(x) for x in (self.start, self.size, self.flat))
        ids = flat[ragged(start[entry], size[entry])]
        text = np.repeat(np.arange(len(texts)), counts)
        changed = np.zeros(len(words), bool)
        changed[touched] = [flat[start[a]:start[a] + size[a]].tobytes() != flat[start[b]:start[b] + size[b]].tobytes()
                            for a, b in zip(plain[touched].tolist(), entry[touched].tolist())]
        per_text = [np.bincount(text, x, len(texts)).astype(np.int64) for x in (size[entry], size[plain], changed)]
        return ids, *per_text

    def decode(self, ids: Iterable[int]) -> str:
        """The text: pieces joined, spaces for the space mark, without the space put before the first word."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


def dropped_bits(key: np.ndarray, word: int, drop: int) -> np.ndarray:
    """64 decisions for each key: bit j is set with probability ``drop`` / 256."""
    out = np.zeros(len(key), np.uint64)
    for b in range(8):
        h = splitmix(key + np.uint64(word * 8 + b + 1))
        out = h | out if drop >> b & 1 else h & out
    return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, seed: int = 0, drop: int = DROP) -> DataFrame:
    """``doc_id, ids, plain_ids, changed_words`` of every whole text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in chunks(batches, chars=2_000_000):
            doc = column(part, "doc_id").to_pylist()
            ids, *per_text = own.encode([t or "" for t in column(part, "text").to_pylist()], [-1 if d is None else d for d in doc], seed, drop)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_text[0])]).astype(np.int32), pa.array(ids, pa.int32()))
            yield rows(_ROWS, doc, lists, *per_text[1:])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, IDS_DDL)


def round_trip(docs: DataFrame, model: str, seed: int = 0, drop: int = DROP) -> DataFrame:
    """``doc_id, n_ids, plain_ids, changed_words, ids_crc32, text_crc32, lossless``: encoded, decoded, compared."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("plain_ids", pa.int64()), ("changed_words", pa.int64()),
                        ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("lossless", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in chunks(batches, chars=2_000_000):
            doc, texts = column(part, "doc_id").to_pylist(), [t or "" for t in column(part, "text").to_pylist()]
            ids, size, plain, changed = own.encode(texts, [-1 if d is None else d for d in doc], seed, drop)
            cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
            each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            back = [own.decode(x.tolist()) for x in each]
            yield rows(schema, doc, size, plain, changed, [zlib.crc32(x.astype("<u4").tobytes()) for x in each],
                       [zlib.crc32(t.encode()) for t in back], [a == b for a, b in zip(back, texts)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_ids long, plain_ids long, changed_words long, ids_crc32 long, text_crc32 long, lossless boolean")
