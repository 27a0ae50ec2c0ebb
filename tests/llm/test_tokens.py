"""Token encoder, packing, id files: against the tokenizers library called on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from rows import ODD

from wardlens.llm import idfile, packing, tok
from wardlens.llm.tok import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    return WordEncoder(PATH)


def library(enc, text, end=None):
    ids = enc.tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids if end is None else [*ids, end]


def test_words_equal_whole_texts(enc, mid_rows):
    texts = [t for _, t in mid_rows] + [t for _, t in ODD]
    ids, counts = enc.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == library(enc, t)
        at += n


def test_words_equal_whole_texts_on_odd_characters(enc):
    r = random.Random(1)
    alphabet = "ab日 \t\n\x1c\x1d\x85\xa0 é́ΣİK<|>endoftext|>'s1½²_̀,,.!一​﻿\x00J̌"
    for _ in range(400):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(4)] + ["x<|endoftext|>y 日<|startoftext|>"]
        ids, _ = enc.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library(enc, t)]


def test_words_that_come_again_stay_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(tok, "MAX_WORDS", 300)
    enc, asked = WordEncoder(PATH), []
    bulk = enc._bulk
    monkeypatch.setattr(enc, "_bulk", lambda words: (asked.extend(words), bulk(words))[1])
    for i in range(40):
        texts = [" ".join(f"common{j} Common{j}" for j in range(50)), None, "", " ".join(f"rare{i}x{j}" for j in range(60))]
        ids, counts = enc.encode(pa.array(texts))
        expected = [library(enc, t) for t in texts]
        assert ids.tolist() == [x for e in expected for x in e] and counts.tolist() == [len(e) for e in expected]
        assert enc.known <= 300 + 110
    assert len(asked) == len(set(asked)) == 51 + 40 * 60  # and the empty word


def test_words_that_fill_the_table_alone_leave_it(monkeypatch):
    monkeypatch.setattr(tok, "MAX_WORDS", 30)
    enc = WordEncoder(PATH)
    for _ in range(4):
        text = " ".join(f"word{j}" for j in range(60))
        assert enc.encode(pa.array([text]))[0].tolist() == library(enc, text) and enc.known == 60


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, docs, enc):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(library(enc, t, 2))
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        if len(texts) > 1:
            assert sum(r["length"] for r in by_doc[d]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(texts[0])
            assert r["ids_crc32"] == crc(texts[0][at:at + r["length"]])
            at += r["length"]
        assert at == len(texts[0])
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0 and total == sum(len(x) for v in want.values() for x in v)


def test_packing_whole_table(mid, mid_rows, enc):
    check_pieces(packing.pack(mid, PATH).collect(), mid_rows, enc)


def test_packing_many_partitions_and_levels(mid, mid_rows, enc, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    monkeypatch.setattr(packing, "FAN_IN_PARTIAL", 2)
    check_pieces(packing.pack(mid.repartition(20, "doc_id"), PATH).collect(), mid_rows, enc)


def test_packing_corner_rows(odd, enc, empty):
    check_pieces(packing.pack(odd, PATH).collect(), ODD, enc)
    assert packing.pack(empty, PATH).count() == 0


def test_best_fit_and_bound():
    p = packing.Packer(0, 0, 10, 2)
    for doc, n in enumerate((6, 7, 3, 4, 5)):
        p.add(doc, 0, np.arange(n, dtype="<u4"), n)
        assert len(p.rooms) <= 2
    # 3 completes 7, 4 completes 6
    assert [[r[0] for r in p.out if r[5] == s] for s in (0, 1)] == [[1, 2], [0, 3]]


def check_file(rows, docs, enc):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [d for _, d, _, _ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    want = sorted(((d, len(x), crc(x)) for d, x in ((d, library(enc, t, 1)) for d, t in docs)), key=str)
    assert sorted(((d, n, c) for _, d, n, c in got), key=str) == want


def test_id_file_round_trip(mid, mid_rows, enc, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK_IDS", 3000)
    check_file(idfile.round_trip(mid, PATH).collect(), mid_rows, enc)


def test_id_file_corner_rows(odd, enc, empty):
    check_file(idfile.round_trip(odd, PATH).collect(), ODD, enc)
    assert idfile.round_trip(empty, PATH).count() == 0


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (5, 3), (300, 9), (3000, 12), (40000, 16)])
def test_length_limited_huffman(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 10, np.int64)
    counts[rng.permutation(n + 10)[:n]] = (1 / rng.random(n) ** 3).astype(np.int64) + 1
    lengths = idfile.code_lengths(counts, limit)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
    assert n == 1 or np.isclose((0.5 ** lengths[counts > 0]).sum(), 1)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    marks, payload = idfile.encode_block(ids, idfile.canonical_codes(lengths), lengths)
    assert (idfile.decode_block(payload, marks, len(ids), idfile.decode_table(lengths)) == ids).all()


def test_huffman_is_optimal_without_a_tight_limit():
    import heapq
    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k, 0))
        k += 1
    assert (counts * idfile.code_lengths(counts, 16)).sum() == cost
