"""Token-id files: canonical length-limited Huffman blocks in ascending document order.

Format: a folder with two Parquet tables, which every store that Spark writes to can hold.

* ``codebook``: one row ``(id, length)`` per id that occurs.  Codes are canonical: ordered by (length, id).
* ``blocks``: one row per independent block, in ascending ``doc_id`` within and across the parts:
  ``part``, ``first`` (ids of the part before the block), ``n_ids``, ``doc_ids`` and ``doc_lens`` (whole
  documents only), ``checkpoints`` (bit offset of every ``STRIDE``-th id) and ``payload`` (codes, first bit
  first).  Any block decodes by itself; within it all checkpoints decode side by side with one table.

Defined cases: null text is an empty one (only the end id); null ids come first; repeated ids are ordered by
their content; an empty input gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.llm.common import chunks, column, rows, scratch, stored
from wardlens.llm.tok import encoder

#: Longest code in bits for up to 65,536 ids (the decoding table has 2 ** LIMIT entries).
LIMIT = 16
#: Ids between two checkpoints, and the ids after which a block is closed.
STRIDE = 256
BLOCK_IDS = 1 << 18

_TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("doc_lens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64())])
TOKENS_DDL = "doc_id long, n long, ids binary"
BLOCKS_DDL = ("part int, first long, n_ids long, doc_ids array<long>, doc_lens array<long>, checkpoints array<long>, "
              "payload binary")
DOCS_DDL = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``(doc_id, n, ids)``: little-endian unsigned ids of each whole text with ``end_id`` at the end.

    Ids take two bytes if the vocabulary allows, else four (``len(ids) / n`` tells)."""
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for part in chunks(batches):
            ids, counts = enc.encode(column(part, "text"))
            ends = np.cumsum(counts)
            data = np.insert(ids.astype(kind), ends, end_id)
            at = (np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * data.itemsize).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)])
            yield rows(_TOKENS, column(part, "doc_id"), counts + 1, binary)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, TOKENS_DDL)


def _ids(data: pa.Scalar, n: int) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer, "<u2" if buffer.size == 2 * n else "<u4")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge (0 for counts of 0)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaves, items = [], weights
    for level in range(limit):
        leaf = np.ones(n, bool)
        if level:
            pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
            items = np.concatenate([weights, pairs])
            rank = np.argsort(items, kind="stable")
            items, leaf = items[rank], rank < n
        leaves.append(leaf)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(leaves):
        chosen = int(leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes ordered by (length, id): each is the one before plus 1, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths[order].max())
        steps = np.left_shift(1, longest - lengths[order])
        codes[order] = (np.cumsum(steps) - steps) >> (longest - lengths[order])
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Checkpoints and payload of the ids (codes of at most 32 bits)."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    total = int(size.sum())
    words = np.zeros(total // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(here, first) if len(first) else 0
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return at[::STRIDE], words.byteswap().tobytes()[:(total + 7) // 8]


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits looked at, then for each bit pattern the id and its code length."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    symbol, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    if len(order):
        spans = np.left_shift(1, bits - lengths[order])
        filled = int(spans.sum())
        symbol[:filled], size[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return bits, symbol, size


def decode_block(payload: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a block: every checkpoint's run advances by one id a step."""
    bits, symbol, size = table
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
    window = np.zeros(len(data) - 4, np.uint64)
    for k in range(5):
        window |= data[k:len(data) - 4 + k] << np.uint64(32 - 8 * k)
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((STRIDE, len(at)), np.uint32)
    last = len(window) - 1
    for step in range(min(STRIDE, n_ids)):
        peek = (window[np.minimum(at >> 3, last)] >> (40 - bits - (at & 7)).astype(np.uint64)).astype(np.int64) & ((1 << bits) - 1)
        out[step] = symbol[peek]
        at += size[peek]
    return out.T.ravel()[:n_ids]


def write_ids(tokens: DataFrame, folder: str, parts: int) -> None:
    """Write ``tokenized`` rows in ascending ``doc_id`` order to ``folder`` in the format above."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.concatenate([_ids(d, n) for d, n in zip(column(batch, "ids"), column(batch, "n").to_pylist())]))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[:len(got)] += got
        used = np.flatnonzero(total)
        yield rows(_COUNTS, used, total[used])

    spark = tokens.sparkSession
    counted = tokens.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    needed = int(np.ceil(np.log2(max(2, np.count_nonzero(counts)))))
    lengths = code_lengths(counts, LIMIT if needed <= LIMIT else needed + 2)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "length": lengths[used]})).coalesce(1).write.parquet(f"{folder}/codebook")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), 0, 0
        ids, docs = [], []

        def close() -> pa.RecordBatch:
            checkpoints, payload = encode_block(np.concatenate(ids).astype(np.int64), codes, lengths)
            return rows(_BLOCKS, [part], [first], [held], [docs], [[len(x) for x in ids]], [checkpoints], [payload])

        for batch in batches:
            for doc, n, data in zip(column(batch, "doc_id").to_pylist(), column(batch, "n").to_pylist(), column(batch, "ids")):
                docs.append(doc)
                ids.append(_ids(data, n))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    first, held, ids, docs = first + held, 0, [], []
        if docs:
            yield close()

    tokens.repartitionByRange(parts, "doc_id", "n").sortWithinPartitions("doc_id", "n", "ids") \
        .mapInArrow(blocks, BLOCKS_DDL).write.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.int64)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for b in batch.to_pylist():
                ids = decode_block(b["payload"], b["checkpoints"], b["n_ids"], table).astype("<u4")
                sizes = np.array(b["doc_lens"], np.int64)
                ends = np.cumsum(sizes)
                yield rows(_DOCS, b["doc_ids"], [b["part"]] * len(sizes), b["first"] + ends - sizes, sizes,
                           [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())])

    stored_blocks = spark.read.parquet(f"{folder}/blocks")
    # one row per written part: as many as the writer was told to make
    parts = stored_blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = stored_blocks.mapInArrow(decode, DOCS_DDL)
    return docs.join(F.broadcast(before), "part") \
        .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Tokenise, write, read back: the documents as the files hold them."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = stored(tokenized(docs, vocabulary, end_id), "ids-raw")
    folder = scratch(spark, "ids")
    write_ids(tokens, folder, parts)
    return read_ids(spark, folder)
