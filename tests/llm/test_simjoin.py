"""The exact Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from rows import ODD

from wardlens.llm import simjoin


def shingles(text, width):
    words = bytes.lower((text or "").encode()).split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(docs, width, num, den):
    """doc row -> (size, component) by comparing all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        others = {}
        for x in s:
            for j in index.setdefault(x, []):
                others[j] = others.get(j, 0) + 1
            index[x].append(i)
        for j, both in others.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(r, n_groups=6, size=12):
    out = []
    for _ in range(n_groups):
        base = [r.choice("abcdefghij") * r.randrange(1, 4) + str(r.randrange(40)) for _ in range(r.choice((5, 12, 30, 90, 300)))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(0, max(2, len(words) // 25))):
                words[r.randrange(len(words))] = str(r.randrange(10_000))
            out.append(" ".join(words))
    return [(100 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_whole_table(mid, mid_rows, width, num):
    got = simjoin.jaccard_classes(mid, width, num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(mid_rows, width, num, 100)


@pytest.mark.parametrize("width,num,limit", [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 90, 500), (2, 70, 2_000_000)])
def test_near_copies(spark, monkeypatch, width, num, limit):
    monkeypatch.setattr(simjoin, "GROUP_SHINGLES", limit)
    docs = near_copies(random.Random(width * num)) + [(d, t) for d, t in ODD if d != 11 or t.startswith("Alpha")]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, cls int").repartition(3)
    got = simjoin.jaccard_classes(frame, width, num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, width, num, 100)


def test_repeated_id_with_other_text_and_empty(odd, empty):
    got = {(r[0], r[1]): r[2] for r in simjoin.jaccard_classes(odd, 3, 90).select("doc_id", "n_shingles", "component_id").collect()}
    assert got[(10, 4)] == got[(11, 4)] == 10 and got[(11, 5)] == 11 and got[(8, 0)] == 8 and got[(None, 5)] is None
    assert simjoin.jaccard_classes(empty, 3, 90).count() == 0


@pytest.mark.parametrize("num", [70, 80, 90])
def test_linked_pairs_share_a_signature(num):
    """Sets at and near the threshold, over sizes and bands, with and without deletion segments."""
    rng = np.random.default_rng(num)
    plain = simjoin.plan_bands(700, num, 100)
    more = [simjoin.Band(b.low, b.high, b.units, b.spare, min(b.units // 2, 1 + i % 5), b.least) for i, b in enumerate(plain)]
    for bands in (plain, more):
        lows = [b.low for b in bands]
        for _ in range(600):
            n = int(rng.integers(2, 600))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            most = simjoin.most_differences(n, num, 100)
            drop = int(rng.integers(0, most + 1))
            b = np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, most - drop + 1))).astype(np.uint64)])
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < num * (len(a) + len(b) - both) or len(a) == len(b) == both or not len(b):
                continue
            x, y = (simjoin.record_keys(s, bands, lows, num, 100) for s in (a, b))
            assert len(np.intersect1d(x, y)), (len(a), len(b), both)


def test_link_sets_is_exact():
    r = random.Random(3)
    for _ in range(60):
        base = [r.randrange(1 << 60) for _ in range(60)]
        sets = [np.unique(np.array([x if r.random() > r.choice((0, .02, .08)) else r.randrange(1 << 60) for x in base], np.uint64))
                for _ in range(r.randrange(1, 40))]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
        assert simjoin.link_sets(sets, 90, 100).tolist() == label


def test_shingles_equal_words():
    texts = [t for _, t in ODD]
    assert [len(s) for s in simjoin.shingle_sets(pa.array(texts), 3)] == [len(shingles(t, 3)) for t in texts]


def test_keep_first_keeps_one_of_each_group(mid, mid_rows):
    want = {c for _, _, c in brute(mid_rows, 5, 80, 100)}
    assert sorted(r[0] for r in simjoin.keep_first(mid).select("doc_id").collect()) == sorted(want)


def test_keep_first_on_repeated_ids(odd):
    kept = simjoin.keep_first(odd).collect()
    # 7, 8, 9 and the row without an id stay; of the equal texts the first; of id 11 the text that is not a copy
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:7]) for r in kept if r["doc_id"] != 14) == [
        (-1, "a row w"), (7, ""), (8, ""), (9, "  \n\t "), (10, "Alpha b"), (11, "another"), (12, "word wo"), (13, "xxxxxxx")]


def test_parities_keep_linked_records_together(monkeypatch):
    """Over several levels of places: records whose sets link never end in different components of the edges."""
    monkeypatch.setattr(simjoin, "BITS", 64)
    monkeypatch.setattr(simjoin, "LEVELS", 3)
    rng = np.random.default_rng(4)
    sets = []
    for n in (20, 60, 70, 130, 140, 300, 1200):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(12):
            part = base[rng.random(n) > rng.choice([0, .05, .15, .3])]
            sets.append(np.unique(np.append(part, rng.integers(0, 1 << 63, int(rng.integers(1, max(2, n // 15)))).astype(np.uint64))))
    size = np.array([len(s) for s in sets])
    found, by_level = [], {}
    for i, s in enumerate(sets):
        for bits in (simjoin.parity_bits(s, simjoin.parity_level(len(s))), simjoin.lower_bits(s, 80, 100)):
            if bits is not None:
                by_level.setdefault(len(bits), []).append((i, bits))
    for w, held in by_level.items():
        at = np.array([i for i, _ in held])
        matrix = np.frombuffer(b"".join(b for _, b in held), np.uint64).reshape(len(held), w // 8)
        found += simjoin.near_edges(np.zeros(len(at), np.int64), at, size[at], matrix, 80, 100).tolist()
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[top(a)] = top(b)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                assert top(i) == top(j)
    assert links > 50 and len({top(i) for i in range(len(sets))}) >= 7


@pytest.mark.parametrize("limit", [16, 1_000_000])
def test_shared_keys_in_parts(monkeypatch, limit):
    """Every key of several records gives one group with all of them, also where a bucket is reduced in parts."""
    monkeypatch.setattr(simjoin, "HELD_PAIRS", limit)
    r = random.Random(limit)
    pairs = [(r.randrange(40), r.randrange(30)) for _ in range(120)]
    batches = [b for at in range(0, 120, 10)
               for b in simjoin.dealt(np.array([k for k, _ in pairs[at:at + 10]], np.uint64), np.array([v for _, v in pairs[at:at + 10]]), 1)]
    groups = {}
    for batch in simjoin.shared_keys(batches):
        for gid, rid in zip(*[c.to_pylist() for c in batch.columns]):
            groups.setdefault(gid, set()).add(rid)
    want = {frozenset(v for k, v in pairs if k == key) for key in range(40)}
    assert {frozenset(g) for g in groups.values()} == {w for w in want if len(w) > 1}


def test_many_texts_under_one_id_do_not_multiply(spark, monkeypatch):
    """The texts that are looked at again grow in proportion to the rows, not to their square."""
    seen = {}
    shared = " ".join(f"common{i}" for i in range(60))
    for m in (60, 120):
        docs = spark.createDataFrame([(1, f"{shared} tail{i % 40} end{i}") for i in range(m)], "doc_id long, text string")
        count = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(simjoin, "shingle_sets", lambda texts, width, f=simjoin.shingle_sets, c=count: (c.add(len(texts)), f(texts, width))[1])
        found = simjoin.jaccard_classes(docs, width=3, num=80, den=100).collect()
        monkeypatch.undo()
        assert len(found) == m and {r["component_id"] for r in found} == {1}
        seen[m] = count.value
    assert seen[120] <= 3 * seen[60]
