"""Exact Jaccard join of shingle sets: universe partition, pigeonhole signatures, exact verification.

Sizes fall into bands.  Two sets of one band with similarity >= t differ in at most H shingles, so shingles are
hashed into H + 1 + E units of the universe.  A unit by itself is an exact segment (it tolerates no difference);
two units together form a deletion segment, indexed with its one-deletion neighbourhood (it tolerates one).
H differences cannot spoil every segment: segments worth at least 1 + E units match.  E units in reserve let a
record leave out up to E exact segments of few shingles, which unrelated sets share by chance; a record with more
of them indexes them all.  How many deletion segments a band has is chosen by estimated cost, from the number of
records per band.  A set also visits the next band if a partner can lie there.

Records that share a signature are compared by size and by the parities of ``BITS`` hashed places, which differ in no
more places than the sets have differences: what cannot be a link goes, before texts are fetched.  The rest joins records into candidate groups; each group
is verified exactly from its texts, without listing its pairs: the most central record is compared with all others
first, and a record is compared only with those in other components that size and triangle bounds allow.  Groups beyond
``GROUP_SHINGLES`` are split into chunks and every pair of chunks is verified, so no link is lost.

Defined cases: null text is an empty one; a text without words has the empty set and links with nothing; equal
sets are one class and are compared once; repeated rows stay separate rows of their class; rows without doc_id
keep their size, link with nothing and have no component; empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from wardlens.llm.common import chunks, column, components, rows, splitmix, stored

#: Shingles that one task verifies together.
GROUP_SHINGLES = 2_000_000
#: In the cost estimate: chance that a shingle of one record is also in an unrelated one.
SHARED = 0.02
#: Classes whose signatures a task remembers to have sent.
SEEN = 200_000
PIVOTS = 16
#: Pairs of key and record that a task gathers before it reduces them to one for each key.
HELD_PAIRS = 4_000_000
#: Places of the parities that tell unlike sets apart before their texts are fetched; larger sets have up to
#: ``BITS << LEVELS`` (beyond twice as many shingles, unlike sets are told apart by size only).
BITS = 1024
LEVELS = 5
#: Records of a group that are compared together; larger groups are compared chunk by chunk.
CELL = 4000
#: Bytes of rows that a task gathers before it compares them (the last group may add up to two chunks).
HELD_BYTES = 16_000_000

_SETS = pa.schema([("doc_id", pa.int64()), ("said", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("rid", pa.int64()), ("bits", pa.binary()),
                   ("lower", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())])
_SHARED = pa.schema([("gid", pa.int64()), ("rid", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    units: int          # H + 1 + E
    spare: int          # E
    deletions: int      # segments of two units
    least: int          # exact segments with fewer shingles may be left out


def most_differences(high: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets of at most ``high`` shingles."""
    return max(r + high - 2 * -(-num * (r + high) // (num + den)) for r in (high - 1, high))


def plan_bands(largest: int, num: int, den: int, records: dict[int, int] | None = None) -> list[Band]:
    """Bands up to ``largest``; ``records``: estimated number of records by band number."""
    from math import ceil, exp, factorial
    ratio, low, bands = max(1.2, den / num * 1.04), 1, []
    while low <= largest:
        high = max(low, int(low * ratio))
        h = most_differences(high, num, den)
        spare = max(1, round(0.12 * h)) if h else 0
        units = h + 1 + spare
        mean = (low + high) / 2 / units
        below = [sum(exp(-mean) * mean ** k / factorial(k) for k in range(t)) for t in (1, 2, 3)]
        least = max((t for t, p in zip((1, 2, 3), below) if p * units <= 0.8 * spare), default=1)
        n = float((records or {}).get(len(bands), 1000))
        d = np.arange(units // 2 + 1)
        exact, pair = exp(-2 * mean * (1 - SHARED)), exp(-4 * mean * (1 - SHARED))
        hit = exact * (1 - sum(exp(-mean * SHARED) * (mean * SHARED) ** k / factorial(k) for k in range(least)))
        cost = n * ((units - 2 * d) + d * (1 + 2 * mean)) + n * n / 2 * ((units - 2 * d) * hit + d * pair * (1 + 2 * mean))
        bands.append(Band(low, high, units, spare, int(np.argmin(cost)), least))
        low = high + 1
    return bands


def signatures(values: np.ndarray, number: int, band: Band) -> np.ndarray:
    """Index keys of a set (sorted distinct hashes) in the scheme of a band."""
    unit = ((values >> np.uint64(32)) * np.uint64(band.units) >> np.uint64(32)).astype(np.int64)
    segment = np.where(unit < 2 * band.deletions, unit >> 1, unit - band.deletions)
    total = band.units - band.deletions
    size = np.bincount(segment, minlength=total)
    part = splitmix(values)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    ends = np.cumsum(size)
    sums = run[ends] - run[ends - size]
    tag = splitmix(np.arange(total, dtype=np.uint64) + np.uint64(number << 40))
    few = size[band.deletions:] < band.least
    send = np.ones(total, bool)
    if few.sum() <= band.spare:
        send[band.deletions:] = ~few
    keys = [splitmix(sums[send] ^ tag[send])]
    if band.deletions:
        near = segment < band.deletions
        keys.append(splitmix((sums[segment[near]] - part[near]) ^ tag[segment[near]]))
    return np.concatenate(keys)


def record_keys(values: np.ndarray, bands: list[Band], lows: list[int], num: int, den: int) -> np.ndarray:
    b = bisect_right(lows, len(values)) - 1
    out = []
    if bands[b].units > 1:
        out.append(signatures(values, b, bands[b]))
    if b + 1 < len(bands) and len(values) * den // num >= bands[b + 1].low:
        out.append(signatures(values, b + 1, bands[b + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    unique = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    blank = np.array([not w for w in coded.dictionary.to_pylist()], bool)
    index = coded.indices.to_numpy()
    bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    if blank.any():
        full = ~blank[index]
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        index = index[full]
    word = unique[index] if len(unique) else np.zeros(0, np.uint64)
    chained = np.full(max(0, len(word) - width + 1), width, np.uint64)
    for k in range(width):
        chained = splitmix(chained ^ word[k:k + len(chained)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            own = np.sort(chained[a:b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = splitmix(h ^ w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def link_sets(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component label of each set under ``den * |a & b| >= num * |a | b|``; exact."""
    n = len(sets)
    labels, open_ = np.arange(n), np.ones(n, bool)
    if n < 2:
        return labels
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    starts = np.cumsum(size) - size
    df = np.bincount(code)
    post = owner[np.argsort(code, kind="stable")]
    first = np.cumsum(df) - df
    pivots: list[np.ndarray] = []
    for x in np.argsort(-np.bincount(owner, df[code].astype(np.float64), n), kind="stable"):
        left = labels[open_]
        if (left == left[0]).all():
            break
        open_[x] = False
        maybe = open_ & (labels != labels[x]) & (den * np.minimum(size, size[x]) >= num * np.maximum(size, size[x]))
        for p in pivots:
            maybe &= np.abs(p - p[x]) <= (den - num) / den + 1e-9
        if not maybe.any():
            continue
        own = code[starts[x]:starts[x] + size[x]]
        own = own[df[own] > 1]
        both = np.bincount(np.concatenate([post[first[c]:first[c] + df[c]] for c in own]) if len(own) else own, minlength=n)
        either = size + size[x] - both
        if len(pivots) < PIVOTS:
            pivots.append(1 - both / either)
        linked = maybe & (den * both >= num * either)
        if linked.any():
            joined = np.unique(np.append(labels[linked], labels[x]))
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def class_of(values: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; none for the empty set."""
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def record_id(cls: bytes | None) -> int | None:
    """A class's number among candidates; should two classes share one, only a candidate group grows."""
    return None if cls is None else int.from_bytes(cls[:8], "little", signed=True)


def dealt(keys: np.ndarray, rids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """``(bucket, pairs)``: the (key, record) pairs of each bucket as bytes."""
    if not len(keys):
        return
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    pairs = np.stack([keys.view(np.int64), rids], 1)[order]
    names, first = np.unique(bucket[order], return_index=True)
    yield rows(_DEALT, names, [p.tobytes() for p in np.split(pairs, first[1:])])


def distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs


def shared_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs sorted by bucket, ``(gid, rid)``: the records of every key that several records have.

    Keys with the same records are one group, named by the sum of the records' hashes.  Held are a bucket's keys with
    their smallest records and at most ``HELD_PAIRS`` pairs more; a bucket beyond that names its groups by key."""
    def settle(parts: list[bytes], by_key: bool, out: list[np.ndarray]) -> bytes:
        pairs = distinct_pairs(np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2))
        begins = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
        size = np.diff(np.append(begins, len(pairs)))
        several = np.repeat(size > 1, size)
        if several.any():
            shared = pairs[several]
            size = size[size > 1]
            if not by_key:
                starts = np.cumsum(size) - size
                total = np.add.reduceat(splitmix(shared[:, 1].astype(np.uint64)), starts)
                shared[:, 0] = np.repeat(total.view(np.int64), size)
                shared = distinct_pairs(shared)
            out.append(shared)
        return pairs[begins].tobytes()

    bucket, parts, held, cut = None, [], 0, False
    for batch in batches:
        out: list[np.ndarray] = []
        for name, data in zip(column(batch, "bucket").to_pylist(), column(batch, "pairs").to_pylist()):
            if name != bucket and parts:
                settle(parts, cut, out)
                parts, held, cut = [], 0, False
            bucket = name
            parts.append(data)
            held += len(data)
            if held >= 16 * HELD_PAIRS:
                parts, held, cut = [settle(parts, True, out)], 0, True
        for shared in out:
            yield rows(_SHARED, shared[:, 0], shared[:, 1])
    if parts:
        out = []
        settle(parts, cut, out)
        for shared in out:
            yield rows(_SHARED, shared[:, 0], shared[:, 1])


def parity_level(n: int) -> int:
    """Sets of up to ``BITS << level`` shingles have as many places, ``BITS << LEVELS`` at most."""
    return min(LEVELS, max(0, (n - 1) // BITS).bit_length())


def parity_bits(values: np.ndarray, level: int) -> bytes:
    """The parities of the numbers of shingles that fall on each of ``BITS << level`` places.

    A shingle in one of two sets only changes one parity, so the parities of linked sets differ in no more places than
    the sets have differences."""
    places = np.uint64(BITS << level)
    place = (splitmix(values ^ np.uint64(BITS)) % places).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=BITS << level) & 1).astype(bool)).tobytes()


def lower_bits(values: np.ndarray, num: int, den: int) -> bytes | None:
    """Parities at the level of partners that are small enough to have fewer places, if there can be any."""
    own, least = parity_level(len(values)), parity_level(-(-num * len(values) // den))
    return parity_bits(values, own - 1) if least < own else None


def near_edges(group: np.ndarray, rid: np.ndarray, size: np.ndarray, bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """Edges between the records of each group (adjacent rows) whose sizes and parities allow a link: not all such
    pairs, but as many as join the same records."""
    parent = np.arange(len(group))
    label = parent.copy()
    most = int(np.max(np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))), initial=0))
    edges = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    i = np.arange(len(group))
    for step in range(1, most):
        i = i[i + step < len(group)]
        i = i[group[i] == group[i + step]]
        k = i[label[i] != label[i + step]]
        k = k[den * np.minimum(size[k], size[k + step]) >= num * np.maximum(size[k], size[k + step])]
        for at in range(0, len(k), 100_000):
            a = k[at:at + 100_000]
            apart = np.bitwise_count(bits[a] ^ bits[a + step]).sum(1, dtype=np.int64)
            for x in a[apart * (den + num) <= (size[a] + size[a + step]) * (den - num)].tolist():
                p, q = top(x), top(x + step)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((x, x + step))
        while (parent[label] != label).any():
            label = parent[label]
    found = rid[np.array(edges, np.int64).reshape(-1, 2)]
    return found[found[:, 0] != found[:, 1]]


def candidate_edges(shared: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)`` from the groups ``shared(gid, rid)``: edges that leave no linked pair of a group apart.

    Groups beyond ``CELL`` records are cut into chunks, and every pair of chunks is looked at."""
    parts = F.ceil(F.col("size") / CELL).cast("long")
    large = shared.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL).select("gid", parts.alias("parts"))
    chunk = F.pmod(F.xxhash64("rid"), F.col("parts"))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                       lambda o: F.struct(F.least(chunk, o).alias("i"), F.greatest(chunk, o).alias("j")))
    placed = shared.join(large, "gid", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) \
        .select("gid", "rid", F.explode(cell).alias("cell")) \
        .select("rid", F.xxhash64("gid", "cell").alias("gid"))
    described = sets.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).groupBy("cls", "rid", "n") \
        .agg(F.first("bits").alias("bits"), F.first("lower").alias("lower")) \
        .select("rid", "n", F.explode(F.array_compact(F.array("bits", "lower"))).alias("bits"))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: list[pa.RecordBatch], last: bool) -> tuple[np.ndarray, list[pa.RecordBatch]]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = column(whole, "gid").to_numpy()
            end = len(group) if last else int(np.searchsorted(group, group[-1]))
            part = whole.slice(0, end)
            bits, found = column(part, "bits"), [np.zeros((0, 2), np.int64)]
            width = pc.binary_length(bits).to_numpy()
            for w in np.unique(width).tolist():  # the rows of a group have one width
                own = np.flatnonzero(width == w)
                same = part.take(pa.array(own))
                matrix = np.frombuffer(b"".join(column(same, "bits").to_pylist()), np.uint64).reshape(len(own), w // 8)
                found.append(near_edges(group[own], column(same, "rid").to_numpy(), column(same, "n").to_numpy(), matrix, num, den))
            return np.concatenate(found), [whole.slice(end)] if end < len(group) else []

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                found, held = edges(held, False)
                yield rows(_LINKS, found[:, 0], found[:, 1])
        if held:
            found, _ = edges(held, True)
            yield rows(_LINKS, found[:, 0], found[:, 1])

    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.hint("merge").join(described, "rid") \
        .select(F.xxhash64("gid", F.octet_length("bits")).alias("gid"), "rid", "n", "bits").repartition(n, "gid").sortWithinPartitions("gid") \
        .mapInArrow(near, "a long, b long").distinct()


def exact_components(sets: DataFrame, edges: DataFrame, docs: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]],
                     num: int, den: int) -> DataFrame:
    """``(cls, root, component_id)`` of the classes in ``sets(doc_id, n, cls, rid)``, exactly.

    ``edges(a, b)`` join records (``rid``) into candidate groups that no link leaves; ``sets_of`` makes the sets of
    texts again, and ``cls`` is the 128-bit hash of a set.  ``docs(doc_id, text)`` may carry the sets themselves as
    ``text``, then with the ``said`` of ``sets``."""
    if "said" not in docs.columns:
        docs = docs.withColumn("said", F.xxhash64("text"))
    groups = components(edges, "groups")
    classes = sets.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("cls", "rid", "n").agg(F.min(F.struct("doc_id", "said")).alias("least")) \
        .select("cls", "rid", "n", "least.doc_id", "least.said")
    member = stored(classes.join(groups.withColumnRenamed("id", "rid"), "rid"), "members")
    total = member.groupBy("root").agg(F.sum("n").alias("total"))
    parts = F.ceil(F.col("total") / GROUP_SHINGLES)
    chunk = F.pmod(F.xxhash64("cls"), F.col("parts"))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                       lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    placed = member.join(total, "root").withColumn("parts", parts).withColumn("chunk", chunk) \
        .select("root", "cls", "doc_id", "said", F.explode(cell).alias("cell"))
    # a class brings the text of one row: many texts under one doc_id do not meet each other's classes.  The same plan at every size: texts are shuffled once, never a side broadcast
    texts = placed.hint("merge").join(docs.select("doc_id", "text", "said"), ["doc_id", "said"]).select("root", "cell", "cls", "text")

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found: dict[bytes, np.ndarray] = {}
        for batch in group.to_batches():
            for cls, values in zip(column(batch, "cls").to_pylist(), sets_of(column(batch, "text"))):
                # equal hashes of texts may bring the text of another class
                if class_of(values) == cls:
                    found[cls] = values
        names = list(found)
        labels = link_sets(list(found.values()), num, den)
        linked = [(names[i], names[k]) for i, k in enumerate(labels.tolist()) if i != k]
        return pa.Table.from_batches([rows(_EDGES, *zip(*linked))] if linked else [], schema=_EDGES)

    links = texts.groupBy("root", "cell").applyInArrow(verify, "a binary, b binary")
    linked = components(links, "links").select(F.col("id").alias("cls"), "root")
    least = classes.select("cls", "doc_id").join(linked, "cls", "left") \
        .select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    return stored(least.join(least.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
                       .select("cls", "root", "component_id"), "components")


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, cls, root, component_id`` of every document.

    ``cls`` tells different sets apart, ``root`` components, and ``component_id`` is the smallest doc_id that links
    of at least ``num / den`` reach."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ratio = max(1.2, den / num * 1.04)
    # a guess at sizes, for the cost estimate only: about seven bytes a word
    guess = F.floor(F.log(F.greatest(F.octet_length("text") / 7, F.lit(1.0))) / float(np.log(ratio))).cast("long")
    counted = docs.select(guess.alias("b"), F.octet_length("text").alias("size")).groupBy("b") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")).collect()
    longest = max([r["longest"] or 0 for r in counted], default=0)
    by_size = sorted((ratio ** r["b"], r["n"]) for r in counted if r["b"] is not None)
    # a word takes two bytes at least
    bands = plan_bands(longest // 2 + 2, num, den)
    lows = [b.low for b in bands]
    records: dict[int, int] = {}
    for size, n in by_size:
        b = bisect_right(lows, max(1, int(size))) - 1
        records[b] = records.get(b, 0) + n
    bands = plan_bands(longest // 2 + 2, num, den, records)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = shingle_sets(column(part, "text"), width)
            cls = [class_of(v) for v in found]
            yield rows(_SETS, column(part, "doc_id"), column(part, "said"), [len(v) for v in found], cls, [record_id(c) for c in cls],
                       [parity_bits(v, parity_level(len(v))) for v in found], [lower_bits(v, num, den) for v in found])

    sets = stored(docs.withColumn("said", F.xxhash64("text")).mapInArrow(describe, "doc_id long, said long, n long, cls binary, rid long, bits binary, lower binary"), "sets")

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in chunks(batches):
            keys, rids = [], []
            for values in shingle_sets(column(part, "text"), width):
                cls = class_of(values)
                if cls is None or cls in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                keys.append(record_keys(values, bands, lows, num, den))
                rids.append(np.full(len(keys[-1]), record_id(cls)))
            if keys:
                yield from dealt(np.concatenate(keys), np.concatenate(rids), buckets)

    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.where(F.col("doc_id").isNotNull()).mapInArrow(index, "bucket int, pairs binary")
    shared = stored(postings.repartition(buckets // 8, "bucket").sortWithinPartitions("bucket")
                    .mapInArrow(shared_keys, "gid long, rid long").distinct(), "shared")
    edges = candidate_edges(shared, sets, num, den)
    component = exact_components(sets, edges, docs, lambda texts: shingle_sets(texts, width), num, den)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    joined = out.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull()).join(component, "cls") \
        .select("doc_id", "n_shingles", "cls", "root", "component_id")
    alone = out.where(F.col("cls").isNull() | F.col("doc_id").isNull()) \
        .select("doc_id", "n_shingles", "cls", F.lit(None).cast("binary").alias("root"), F.when(F.col("cls").isNull(), F.col("doc_id")).alias("component_id"))
    return joined.unionByName(alone)


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component: that of its smallest doc_id (of repeated ids with several texts in it, the smallest
    class).  Rows without words or without an id are kept as they are."""
    found = jaccard_classes(docs, width, num, den)
    kept = found.where(F.col("doc_id") == F.col("component_id")).where(F.col("cls").isNotNull()) \
        .groupBy("root", F.col("doc_id").alias("_doc")).agg(F.min("cls").alias("_cls")).select("_doc", "_cls")

    def classed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            cls = [class_of(v) for v in shingle_sets(column(part, "text"), width)]
            yield part.append_column("_cls", pa.array(cls, pa.binary()))

    numbered = docs.mapInArrow(classed, StructType([*docs.schema.fields, StructField("_cls", BinaryType())])) \
        .withColumn("_doc", F.col("doc_id").cast("long"))
    plain = F.col("_doc").isNull() | F.col("_cls").isNull()
    named = numbered.where(~plain).join(kept, ["_doc", "_cls"], "left_semi").dropDuplicates(["_doc", "_cls"])
    return named.select(*docs.columns).unionByName(numbered.where(plain).select(*docs.columns))
