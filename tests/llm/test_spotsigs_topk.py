import hashlib
import math
import random
import re
from collections import Counter
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from rows import ODD

from wardlens.llm import queries, spotsigs, topk
from wardlens.llm.common import splitmix


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def signatures(text):
    """Signatures as word tuples, one text at a time."""
    ws = words(text)
    return {(w, *islice((x for x in islice(ws, i + 1, None) if x not in spotsigs.ANCHORS), spotsigs.CHAIN))
            for i, w in enumerate(ws) if i == 0 or w in spotsigs.ANCHORS or sparse(w)}


@cache
def sparse(word):
    return int(splitmix(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))[0]) % spotsigs.SPARSE == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signature_sets_equal_one_by_one(mid_rows):
    texts = [t for _, t in mid_rows[:300]] + ["the cat", "the", "cat", "", None, "a b c d e", "the the the cat sat mat"]
    got = spotsigs.signature_sets(pa.array(texts))
    want = [signatures(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(0, len(texts) - 1):
        assert math.isclose(spotsigs.likeness(got[i], got[i + 1]), jaccard(want[i], want[i + 1]))


def check(rows, docs, tied=False):
    order = docs if tied else sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0], reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        changed = t[:len(t) - k] + nxt[:k]
        a, b, c = signatures(t), signatures(changed), signatures(nxt)
        want[(d, len(t), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9))] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    assert got == want
    prints = {}
    texts = {d: t for d, t in docs}
    for r in rows:
        if not tied and r["doc_id"] is not None and r["doc_id"] != 11:
            assert prints.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_of_table(mid, mid_rows):
    check(spotsigs.fingerprints(mid).collect(), mid_rows)


def test_fingerprints_of_corner_rows(spark, empty):
    docs = [(d, t) for d, t in ODD if d not in (11, 12)]
    check(spotsigs.fingerprints(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, id int")).collect(), docs)
    one = [(5, "only the one row here")]
    check(spotsigs.fingerprints(spark.createDataFrame(one, "doc_id long, text string")).collect(), one)
    assert spotsigs.fingerprints(empty).count() == 0


def test_repeated_rows_and_ids(odd):
    rows = spotsigs.fingerprints(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ODD)


def components(docs):
    """Smallest id reachable of each row, by comparing all sets that share a signature."""
    sets = [signatures(t) if d is not None else set() for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    place = {}
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in place.get(x, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            place.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(docs))]


def test_near_classes_equal_brute_force(mid, mid_rows):
    got = {r["doc_id"]: r["component_id"] for r in spotsigs.near_classes(mid).collect()}
    assert got == {d: c for (d, _), c in zip(mid_rows, components(mid_rows))}
    assert {r["doc_id"]: r["component_id"] for r in spotsigs.fingerprints(mid).collect()} == got


def test_components_of_odd_rows(odd):
    want = Counter((d, c) for (d, _), c in zip(ODD, components(ODD)))
    assert Counter((r["doc_id"], r["component_id"]) for r in spotsigs.near_classes(odd).collect()) == want
    assert Counter((r["doc_id"], r["component_id"]) for r in spotsigs.fingerprints(odd).collect()) == want


def test_alike_sets_share_an_index_key():
    rng = np.random.default_rng(3)
    bounds = spotsigs.length_partitions(500, 80, 100)
    for n in [*range(1, 40), *rng.integers(40, 400, 60).tolist()]:
        # the larger set adds the most signatures that leave the likeness at 0.8, and they come first
        extra = int(rng.integers(0, n // 4 + 1))
        names = rng.permutation(1 << 20)[:n + extra].astype(np.uint64)
        a, b = names[extra:], names
        # the same likeness with signatures of its own on either side
        lost = n // 9
        c, d = np.concatenate([names[extra:extra + lost] + np.uint64(1 << 21), a[lost:]]), a
        for x, y in ((a, b), (c, d)):
            assert spotsigs.likeness(np.sort(x), np.sort(y)) >= 0.8
            assert np.intersect1d(spotsigs.posting_keys(x, bounds, 80, 100), spotsigs.posting_keys(y, bounds, 80, 100)).size
        assert len(spotsigs.posting_keys(a, bounds, 80, 100)) <= 0.34 * n + 2


def test_only_candidates_are_shuffled_as_sets(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", *(f"v{i}" for i in range(400))]) for _ in range(300)) for _ in range(80)]
    docs = [*enumerate(texts), (80, "first of " + texts[3]), (81, texts[3]), (82, ""), (83, None), (None, texts[5])]
    frames, asked = {}, []
    stored, exact = spotsigs.stored, spotsigs.exact_components
    monkeypatch.setattr(spotsigs, "stored", lambda df, name: frames.setdefault(name, stored(df, name)))
    monkeypatch.setattr(spotsigs, "exact_components", lambda sets, edges, docs, *a: (asked.append(docs), exact(sets, edges, docs, *a))[1])
    got = spotsigs.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, c) for (d, _), c in zip(docs, components(docs)))
    assert {3, 80, 81} <= {r["doc_id"] for r in asked[0].collect()} and asked[0].count() < 10
    assert "sigs" in frames["signatures"].columns and not {"bits", "lower"} & set(frames["signatures"].columns)


def test_texts_under_one_id_fill_many_ranges(spark):
    rng = random.Random(4)
    names = ["the", "and", "of", *(f"w{i}" for i in range(300))]
    docs = [(i if i % 3 else 7, " ".join(rng.choice(names) for _ in range(20))) for i in range(900)] + [(None, f"none {i}") for i in range(60)]
    rows = spotsigs.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by_hash = {(r["doc_id"], r["text"]): r["h"] for r in spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "xxhash64(text) h").collect()}
    low = -(1 << 63)
    order = sorted(docs, key=lambda d: (-(low if d[0] is None else d[0]), by_hash[d]))
    check(rows, order, tied=True)


# search -------------------------------------------------------------------
def brute_top(docs, asked, k):
    bags = [Counter(words(t)) for _, t in docs]
    n, mean = len(docs), sum(sum(b.values()) for b in bags) / len(docs)
    df = Counter(w for b in bags for w in b)
    out = []
    for q, t in asked:
        found = []
        for (d, _), b in zip(docs, bags):
            size = sum(b.values())
            s = sum(math.floor(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (b[w] * (topk.K1 + 1) / (b[w] + topk.K1 * (1 - topk.B + topk.B * size / mean))) * topk.UNIT + 0.5)
                    for w in set(words(t)) if w in b)
            if s:
                found.append((-s, d is None, d or 0, d))
        out += [(q, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out)


def test_top_k_equals_scoring_everything(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(vocab, [1 / (j + 1) for j in range(300)], k=r.randrange(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(25)] + [x for x in ODD if x[0] != 12]
    asked = [(i, docs[i][1]) for i in range(0, 700, 50)] + [(9001, ""), (9002, None), (9003, "nowhere found"), (9004, "w1 w1 W2")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4)
    q = spark.createDataFrame(asked, "query_id long, text string")
    for terms, block in ((2_000_000, 1), (60, 1), (2_000_000, 8)):
        monkeypatch.setattr(topk, "BLOCK_TERMS", terms)
        monkeypatch.setattr(topk, "BLOCK", block)
        got = sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in topk.top_k(frame, q).collect())
        assert got == brute_top(docs, asked, 10)


def test_blocks_below_the_threshold_are_not_opened(monkeypatch):
    """Few documents hold the query's rare words: most blocks stay closed, and the result is whole."""
    texts = [f"common filler w{i % 50}" for i in range(4000)] + ["rare gem common"] * 12
    terms, bounds = topk.text_terms(pa.array(texts))
    monkeypatch.setattr(topk, "BLOCK", 32)
    row = next(iter(_index_rows(texts)))
    shard = topk.Shard(row, 3.0)
    opened = []
    monkeypatch.setattr(topk, "ragged", lambda a, b, f=topk.ragged: opened.append(int(b.sum())) or f(a, b))
    asked = np.unique(terms[bounds[-2]:])
    found = list(shard.search(np.array([0, 3]), asked, np.where(np.isin(asked, terms[:3]), 0.1, 6.0), np.zeros(1), 10))
    (query, place, score), = found
    assert query == 0 and len(place) == 12 and len(set(score.tolist())) == 1
    # postings of the query's words: 4012 for "common"; only those of the first blocks are read
    assert sum(opened) < 600


def test_share_of_postings_scored(spark):
    """With the production setting, queries that have met one shard score less than 0.6 of their terms' postings in the
    next, and less than 0.75 with the block maxima that they look at; the result is whole."""
    mid_rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000").select("doc_id", "text").collect()]
    half = len(mid_rows) // 2
    shards, lengths = [], []
    for part in (mid_rows[:half], mid_rows[half:]):
        row = next(iter(_index_rows([t for _, t in part])))
        shards.append(row)
        lengths.append(np.frombuffer(row["lengths"], np.int64))
    mean = float(np.concatenate(lengths).mean())
    asked = [np.unique(topk.text_terms(pa.array([t]))[0]) for _, t in mid_rows[::50]]
    terms, bounds = np.concatenate(asked), np.concatenate([[0], np.cumsum([len(a) for a in asked])])
    frequency = {}
    for row in shards:
        for t, n in zip(np.frombuffer(row["terms"], np.int64).tolist(), np.diff(np.frombuffer(row["starts"], np.int64)).tolist()):
            frequency[t] = frequency.get(t, 0) + n
    df = np.array([frequency[t] for t in terms.tolist()])
    weights = np.log(1 + (len(mid_rows) - df + 0.5) / (df + 0.5))
    first, second = (topk.Shard(r, mean) for r in shards)
    floors = np.zeros(len(asked))
    for q, _, score in first.search(bounds, terms, weights, floors, 10):
        floors[q] = np.sort(score)[-10] if len(score) >= 10 else 0
    found = {q: dict(zip(place.tolist(), score.tolist())) for q, place, score in second.search(bounds, terms, weights, floors, 10)}
    assert second.scored < 0.6 * second.asked and second.scored + second.looked < 0.75 * second.asked and first.scored < first.asked
    for q, own in enumerate(np.split(np.arange(len(terms)), bounds[1:-1])):
        score = np.zeros(len(second.docs))
        for i in own:
            if terms[i] in second.terms:
                at = int(np.searchsorted(second.terms, terms[i]))
                run = slice(second.starts[at], second.starts[at + 1])
                score[second.places[run]] += np.floor(weights[i] * second.parts[run] * topk.UNIT + 0.5)
        best = max(floors[q], np.sort(score)[-10], 1)
        assert found.get(q, {}) == {int(p): int(score[p]) for p in np.flatnonzero(score >= best)}


def test_many_queries_are_searched_a_few_at_a_time(monkeypatch):
    """Memory does not grow with the queries sent, frequent words are not read posting by posting, the result is whole."""
    import tracemalloc
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{i}" for i in range(400)], [1 / (j + 1) for j in range(400)], k=60)) for _ in range(500)]
    shard = topk.Shard(next(iter(_index_rows(texts))), 60.0)
    own = [np.unique(topk.text_terms(pa.array([t]))[0]) for t in texts[:100]]
    weight = np.log(1 + 500 / np.diff(shard.starts))
    most, read = {}, []
    monkeypatch.setattr(topk, "ragged", lambda a, b, f=topk.ragged: read.append(int(b.sum())) or f(a, b))
    for times in (1, 30):
        asked = own * times
        terms, bounds = np.concatenate(asked), np.concatenate([[0], np.cumsum([len(a) for a in asked])])
        weights = weight[np.searchsorted(shard.terms, terms)]
        tracemalloc.start()
        found = {q: (place, score) for q, place, score in shard.search(bounds, terms, weights, np.zeros(len(asked)), 10) if q < 100}
        most[times] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most[30] < 1.5 * most[1]
    assert sum(read) < 0.5 * shard.scored
    for q, terms in enumerate(own):
        score = np.zeros(500)
        for at in np.searchsorted(shard.terms, terms):
            run = slice(shard.starts[at], shard.starts[at + 1])
            score[shard.places[run]] += np.floor(weight[at] * shard.parts[run] * topk.UNIT + 0.5)
        best = np.sort(score)[-10]
        assert dict(zip(found[q][0].tolist(), found[q][1].tolist())) == {int(p): int(score[p]) for p in np.flatnonzero(score >= best)}


def _index_rows(texts):
    """Rows of the index, built without a session."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, build, _):
            return [r for b in build(iter([batch])) for r in b.to_pylist()]
    from unittest import mock
    with mock.patch.object(topk, "F"):
        return topk.index(Frame())


def test_top_k_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(f"SELECT query_id, rank, doc_id, score FROM ({topk.ORACLE})").fetchall()
    got = queries.QUERIES["op1_topk"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == sorted(want)


def test_empty_index(spark, empty):
    assert topk.top_k(empty, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_packed_texts_come_back_whole_and_smaller():
    import pyarrow as pa
    from wardlens.llm import common
    texts = pa.array(["", None, "é" * 3, "a word and another word " * 400, "\x00\n"], pa.string())
    data = common.packed(texts)
    sizes = pa.array([None if t is None else len(t.encode()) for t in texts.to_pylist()], pa.int64())
    assert common.unpacked(pa.array(data, pa.binary()), sizes).equals(texts) and len(data[3]) < 1000
    # a chunk is bounded by the texts' sizes, not by what is left of them
    batch = pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), sizes], names=["text", "size"])
    assert [len(c) for c in common.chunks([batch], chars=9000, size="size")] == [3, 1, 1]
