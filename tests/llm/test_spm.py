"""Merge-dropout against the library (no dropout) and a plain agenda over whole texts (with dropout)."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from rows import ODD

from wardlens.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return spm.Codec(PATH)


def each(codec, some, seed=0, drop=spm.DROP):
    """(ids, ids without dropout, changed words) of each text."""
    ids, size, plain, changed = codec.encode(some, list(range(len(some))), seed, drop)
    cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [(ids[a:b].tolist(), p, c) for a, b, p, c in zip(cuts[:-1], cuts[1:], plain.tolist(), changed.tolist())]


def texts():
    r = random.Random(6)
    alphabet = ["the ", "of", " ", "  ", "\n", "\t", "é", "é", "▁", "日本", "ﬁ", "\x00", "\U0001f600", "word", "ing", "123", "    x", "<s>", "<0x41>", "\uffff"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(500)] + [t or "" for _, t in ODD]


def test_without_dropout_ids_are_the_librarys(codec, mid_rows):
    some = [t for t in texts() if spm.SPACE not in t] + [t for _, t in mid_rows[:300]]
    got = each(codec, some, drop=0)
    assert [g[0] for g in got] == [codec.library.encode(t) for t in some]
    assert all(len(ids) == plain and not changed for ids, plain, changed in got)


@pytest.mark.parametrize("seed,drop", [(0, 16), (1, 16), (7, 128), (3, 255)])
def test_every_text_comes_back(codec, mid_rows, seed, drop):
    some = texts() + [t for _, t in mid_rows[:100]]
    for t, (ids, _, _) in zip(some, each(codec, some, seed, drop)):
        assert codec.decode(ids) == t


def test_dropout_equals_an_agenda_without_memory(codec, mid_rows):
    """Every word is merged anew, each decision drawn by itself."""
    some = [t for _, t in mid_rows[:40]] + texts()[:100]
    for doc, (t, (ids, _, _)) in enumerate(zip(some, each(codec, some, 5, 40))):
        want = []
        words = spm._WORD.findall(spm.SPACE + t.replace(spm.SPACE, spm.LITERAL).replace(" ", spm.SPACE)) if t else []
        for place, word in enumerate(words):
            with np.errstate(over="ignore"):
                base = spm.splitmix(np.array([doc], np.uint64) ^ np.uint64(5 * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                key = spm.splitmix(base + np.uint64(place))
            want += codec.merge(word, lambda j, k=key: int(spm.dropped_bits(k, j // 64, 40)[0]) >> j % 64 & 1)[1]
        assert ids == want


def test_short_words_equal_the_agenda(codec):
    r = random.Random(9)
    for _ in range(4000):
        word = "".join(r.choice("▁theaonind\udc81é日") for _ in range(r.randrange(1, spm.SHORT + 1)))
        bits = r.getrandbits(64) & r.getrandbits(64)
        assert codec.merge_short(word, bits) == codec.merge(word, lambda j: bits >> j & 1)


def test_seeds_vary_and_repeat(codec, mid_rows):
    some = [t for _, t in mid_rows[:100]]
    a, b, again = each(codec, some, 1), each(codec, some, 2), each(spm.Codec(PATH), some, 1)
    assert a == again and a != b
    words = sum(len(t.split()) for t in some)
    assert 0.03 < sum(x[2] for x in a) / words < 0.6
    bits = spm.dropped_bits(np.arange(50_000, dtype=np.uint64), 0, 16)
    assert abs(np.mean([bin(int(x)).count("1") for x in bits]) / 64 - 1 / 16) < 0.001


def test_round_trip_rows(spark, mid, mid_rows, odd, empty):
    for frame, docs in ((mid, mid_rows), (odd, ODD)):
        got = spm.round_trip(frame, PATH).collect()
        assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in got) == sorted((str(d), zlib.crc32((t or "").encode())) for d, t in docs)
        assert all(r["lossless"] for r in got)
        assert all(r["n_ids"] >= r["plain_ids"] or r["changed_words"] for r in got)
    ids = {r["doc_id"]: r["ids"] for r in spm.encode(mid, PATH).collect()}
    assert {r["doc_id"]: zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes()) for r in spm.round_trip(mid, PATH).collect()} \
        == {r["doc_id"]: r["ids_crc32"] for r in spm.round_trip(mid.repartition(7), PATH).collect()}
    assert spm.round_trip(empty, PATH).count() == 0
