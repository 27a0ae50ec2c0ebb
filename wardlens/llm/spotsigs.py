"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A signature is made of an anchor and the content words (words that are no common words) after it: the next ``CHAIN``, or
fewer at the end of a text.  Anchors are the common words and, so that texts in any language and of any length have
signatures by the same rule, the first word and one word in ``SPARSE`` by its hash.  A text's fingerprint is its set of
signatures, written as sorted 32-bit hashes in hex; only texts without words have an empty one.

Likeness is the Jaccard similarity of the sets.  ``near_classes`` finds all sets that are alike: sets are dealt to
partitions of set length such that alike sets lie in one partition or in neighbours, and indexed there by their rarest
signatures, enough of them that alike sets share one.  Records that share one are pruned by set length and by the
parities of hashed places, and what is left is compared exactly in the groups this forms.  ``fingerprints`` gives each
document the component it belongs to.

Defined cases: null text is an empty one; two empty fingerprints have likeness 1, an empty and another 0, but an empty
one is alone in its component; equal ids are ordered by a hash of the text; rows without id come last and have no
component; a single row is its own next document; empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import chunks, column, packed, rows, splitmix, stored, unpacked
from wardlens.llm.simjoin import SEEN, candidate_edges, class_of, dealt, exact_components, lower_bits, parity_bits, parity_level, record_id, shared_keys

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset("""
a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was
were which will with you
als am auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie sind und von war wie zu zum zur
au aux avec ce cette dans de du elle en est et il la le les mais ne nous ou par pas pour que qui sur un une vous
al como con del el ella ellos era lo los las más no para pero por se sin su sus una y
""".split())
CHAIN = 2
#: One word in so many is an anchor by its hash.
SPARSE = 8
#: Cells that count signatures; a signature's rarity is the power of two of its cell.
CELLS = 1 << 18
#: Places that tell which records are candidates; others that fall on the same place are only read in vain.
PLACES = 1 << 23

_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("component_id", pa.int64())])
PRINTS_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, component_id long")
_SIGNED = pa.schema([("doc_id", pa.int64()), ("said", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("rid", pa.int64()), ("sigs", pa.binary())])
_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("rid", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("lower", pa.binary())])


def _chains(word: np.ndarray, anchor: np.ndarray, content: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each anchor place and its chain of content places before ``end``."""
    place = np.flatnonzero(content)
    at = np.flatnonzero(anchor)
    nxt = np.searchsorted(place, at, side="right")
    h = splitmix(word[at])
    padded = np.append(place, np.full(CHAIN, len(word)))
    for k in range(CHAIN):
        p = padded[np.minimum(nxt + k, len(place))]
        real = p < end[at]
        h[real] = splitmix(h[real] ^ word[p[real]])
    return h


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures (as unsigned 64-bit numbers) of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    words = pc.ascii_split_whitespace(plain)
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy()
    bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    real = np.array([bool(w) for w in names], bool)[index] if names else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    index = index[real]
    if not len(index):
        return [np.zeros(0, np.uint64)] * len(texts)
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[index]
    common = np.array([w in ANCHORS for w in names], bool)[index]
    end = np.repeat(bounds[1:], np.diff(bounds))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    anchor = common | (splitmix(word) % np.uint64(SPARSE) == 0)
    anchor[bounds[:-1][np.diff(bounds) > 0]] = True
    hashes = _chains(word, anchor, ~common, end) >> np.uint64(32)
    pairs = np.unique(owner[anchor].astype(np.uint64) << np.uint64(32) | hashes)
    cuts = np.searchsorted(pairs, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    low = pairs & np.uint64(0xFFFFFFFF)
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a comparison if the set lengths alone rule out ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (small + large - same)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id`` of every
    document; ``component_id`` is that of ``near_classes`` at a likeness of ``num / den``.

    Documents are dealt by ranges of doc_id, and of the text's hash within an id that fills several ranges; each range's
    first row also goes to the end of the range before it (the very first to the last), so every row meets the next one
    in its own task and texts are shuffled once, each compressed.  The components come to the same ranges as rows without text.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = near_classes(docs, num, den).groupBy("doc_id", F.col("said").alias("h")).agg(F.max("component_id").alias("component_id"))
    ids = docs.select(F.coalesce("doc_id", F.lit(none)).alias("id"), "h")
    # a few ranges for each partition, dealt by hash
    ranges = 4 * parts
    at = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    # an id that is a quantile k times has k ranges of hashes
    times = {int(x): (at or []).count(x) for x in at or []}
    cuts = np.array(sorted(times), np.int64)
    pieces = np.array([1, *(times[c] for c in cuts[::-1].tolist())], np.int64)
    offset = np.cumsum(pieces) - pieces

    def bucket(values: np.ndarray, h: np.ndarray) -> np.ndarray:
        low = np.searchsorted(cuts, values, side="left")
        b = len(cuts) - low
        hot = np.append(cuts, 0)[low] == values
        hot &= low < len(cuts)
        piece = ((h >> 32) + (1 << 31)) * pieces[b] >> 32
        return offset[b] + np.where(hot, piece, pieces[b] - 1)

    head_schema = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("h", pa.int64())])

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            values, h = column(batch, "id").to_numpy(), column(batch, "h").to_numpy()
            own = bucket(values, h)
            order = np.lexsort((h, ~values, own))
            first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])] if len(order) else order
            for b, i, x in zip(own[first].tolist(), values[first].tolist(), h[first].tolist()):
                best[b] = min(best.get(b, (~i, x)), (~i, x))
        yield rows(head_schema, list(best), [~i for i, _ in best.values()], [x for _, x in best.values()])

    # one row for each range that has rows: its largest id, and the smallest hash of that
    first = {r["bucket"]: (r["least"]["id"], r["least"]["h"]) for r in ids.mapInArrow(heads, "bucket int, id long, h long").groupBy("bucket")
             .agg(F.min_by(F.struct("id", "h"), F.struct(F.bitwise_not("id"), "h")).alias("least")).collect()}
    filled = sorted(first)
    before = {first[b]: filled[i - 1] for i, b in enumerate(filled)}
    deal_schema = pa.schema([("bucket", pa.int32()), ("copy", pa.bool_()), ("id", pa.int64()), ("h", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()),
                             ("text", pa.binary()), ("size", pa.int64()), ("component_id", pa.int64())])
    deal_ddl = "bucket int, copy boolean, id long, h long, place int, doc_id long, text binary, size long, component_id long"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            doc, size = column(part, "doc_id"), pc.binary_length(column(part, "text")).cast(pa.int64())
            text = pa.array(packed(column(part, "text")), pa.binary())
            values, h = pc.fill_null(doc, none).to_numpy(), column(part, "h").to_numpy()
            leads = {key: i for i, key in enumerate(zip(values.tolist(), h.tolist())) if key in before}
            lead, n = np.array(list(leads.values()), np.int64), len(part)
            yield rows(deal_schema, bucket(values, h), [False] * n, values, h, [1] * n, doc, text, size, [None] * n)
            if len(lead):
                yield rows(deal_schema, [before[key] for key in leads], [True] * len(lead), values[lead], h[lead], [1] * len(lead),
                           doc.take(pa.array(lead)), text.take(pa.array(lead)), size.take(pa.array(lead)), [None] * len(lead))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = column(batch, "doc_id"), len(batch)
            values, h = pc.fill_null(doc, none).to_numpy(), column(batch, "h").to_numpy()
            yield rows(deal_schema, bucket(values, h), [False] * n, values, h, [0] * n, doc, [None] * n, [None] * n, column(batch, "component_id"))

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: each with the one after it in its range (the first copy, at the end); a label before its texts."""
        held: tuple | None = None       # (bucket, doc, text, signatures, component) waiting for its next row
        component = None

        def result(group: list[tuple], following: list[tuple]) -> pa.RecordBatch:
            changed = [edited(g[2], f[2]) for g, f in zip(group, following)]
            marks = signature_sets(pa.array(changed, pa.string()))
            return rows(_PRINTS, [g[1] for g in group], [len(g[2]) for g in group], [hashlib.sha256(c.encode()).hexdigest() for c in changed],
                        [written(g[3]) for g in group], [written(m) for m in marks], [likeness(g[3], m) for g, m in zip(group, marks)],
                        [likeness(g[3], f[3]) for g, f in zip(group, following)], [g[4] for g in group])

        for part in chunks(batches, size="size"):
            group, following = [], []
            texts = unpacked(column(part, "text"), column(part, "size"))
            for b, copy, place, doc, text, sigs, own in zip(*(column(part, c).to_pylist() for c in ("bucket", "copy", "place", "doc_id")),
                                                            texts.to_pylist(), signature_sets(texts), column(part, "component_id").to_pylist()):
                if place == 0:
                    component = own
                    continue
                row = b, doc, text, sigs, component
                if held is not None and held[0] == b:
                    group.append(held)
                    following.append(row)
                # after the first copy a range is done
                held = None if copy else row
            if group:
                yield result(group, following)

    dealt_rows = docs.mapInArrow(deal, deal_ddl).unionByName(known.mapInArrow(label, deal_ddl))
    return dealt_rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.desc("id"), "h", "place") \
        .select("bucket", "copy", "place", "doc_id", "text", "size", "component_id").mapInArrow(prints, PRINTS_DDL)


def length_partitions(longest: int, num: int, den: int) -> list[int]:
    """First set length of each partition: sets of likeness ``num / den`` lie in one partition or in neighbours."""
    bounds, n = [1], 1
    while n <= longest:
        n = n * den // num + 1
        bounds.append(n)
    return bounds


def posting_keys(ordered: np.ndarray, bounds: list[int], num: int, den: int) -> np.ndarray:
    """Index keys of a set whose signatures are in an order that all sets share; alike sets have one in common.

    Alike sets share all but ``n - ceil(n * num / den)`` signatures of each, so in the set's own partition so many and one
    more are keys.  In the next partition it meets larger sets only, and shares more with the least of them."""
    n = len(ordered)
    own = bisect_right(bounds, n)
    up = -(-num * (n + bounds[own]) // (num + den))
    return np.concatenate([splitmix(ordered[:max(0, n - least + 1)] | np.uint64(p << 32)) >> np.uint64(1)
                           for p, least in ((own, -(-n * num // den)), (own + 1, up))])


def near_classes(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, said, n_signatures, component_id``: smallest doc_id reachable over fingerprints of likeness ``num / den``
    or more; ``said`` is the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = signature_sets(column(part, "text"))
            cls = [class_of(s) for s in found]
            yield rows(_SIGNED, column(part, "doc_id"), column(part, "said"), [len(s) for s in found], cls, [record_id(c) for c in cls],
                       [s.astype("<u4").tobytes() for s in found])

    sets = stored(docs.withColumn("said", F.xxhash64("text"))
                  .mapInArrow(make, "doc_id long, said long, n long, cls binary, rid long, sigs binary"), "signatures")
    named = sets.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())

    def cell(signatures: np.ndarray) -> np.ndarray:
        return (splitmix(signatures) % np.uint64(CELLS)).astype(np.int64)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(cell(np.frombuffer(b"".join(column(batch, "sigs").to_pylist()), "<u4").astype(np.uint64)), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    # one number a cell, whatever the number of signatures
    counted = named.select("sigs").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(CELLS, np.int8)
    rarity[counted.column("cell").to_numpy()] = np.log2(counted.column("n").to_numpy()).astype(np.int8)
    bounds = length_partitions(sets.agg(F.max("n")).first()[0] or 0, num, den)
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, rids = [], []
            for cls, rid, data in zip(*(column(batch, c).to_pylist() for c in ("cls", "rid", "sigs"))):
                if cls in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                s = np.frombuffer(data, "<u4").astype(np.uint64)
                keys.append(posting_keys(s[np.lexsort((splitmix(s), rarity[cell(s)]))], bounds, num, den))
                rids.append(np.full(len(keys[-1]), rid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rids))], ["key", "rid"])

    def shared_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shared_keys(b for batch in batches for b in dealt(batch["key"].to_numpy().view(np.uint64), batch["rid"].to_numpy(), buckets))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(data, "<u4").astype(np.uint64) for data in column(batch, "sigs").to_pylist()]
            yield rows(_DESCRIBED, *(column(batch, c) for c in ("doc_id", "cls", "rid", "n")),
                       [parity_bits(s, parity_level(len(s))) for s in found], [lower_bits(s, num, den) for s in found])

    # copies are left out in each task, not by a shuffle of the sets
    postings = named.select("cls", "rid", "sigs").mapInArrow(index, "key long, rid long")
    # a row a signature: rows of a bucket and task would grow with the square of the partitions
    shared = stored(postings.repartition(buckets // 8, "key").sortWithinPartitions(F.pmod("key", F.lit(buckets)))
                    .mapInArrow(shared_rows, "gid long, rid long").distinct(), "shared")
    described = named.mapInArrow(describe, "doc_id long, cls binary, rid long, n long, bits binary, lower binary")
    edges = stored(candidate_edges(shared, described, num, den), "edges")
    place = F.col("rid").bitwiseAND(PLACES - 1)
    marked = edges.select(F.explode(F.array("a", "b")).alias("rid")).select(F.shiftright(place, 6).alias("word"), F.pmod("rid", F.lit(64)).alias("bit")) \
        .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, int(bit)))").alias("bits")).toArrow()
    marks = np.zeros(PLACES // 64, np.int64)
    marks[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = column(batch, "rid").to_numpy() & (PLACES - 1)
            yield batch.filter(pa.array((marks[at >> 6] >> (at & 63) & 1).astype(bool))).select(["doc_id", "said", "text"])

    # only the sets of candidates are shuffled
    asked = named.select("doc_id", "said", F.col("sigs").alias("text"), "rid").mapInArrow(candidates, "doc_id long, said long, text binary")
    component = exact_components(sets, edges, asked, lambda column: [np.frombuffer(x, "<u4").astype(np.uint64) for x in column.to_pylist()], num, den)
    return sets.select("doc_id", "said", F.col("n").alias("n_signatures"), "cls").join(component, "cls", "left") \
        .select("doc_id", "said", "n_signatures",
                F.when(F.col("cls").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
