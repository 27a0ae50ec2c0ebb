"""Splits and folds that do not depend on partitioning or task order.

``randomSplit`` and ``rand()`` change with the partition layout; these use a
mixing hash of the row key (portable to any SQL engine) or the declared
row order, so a rerun after executor loss gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ordered import ntile_folds

# Hash values lie in [0, HASH_MOD): 12 hex digits of an MD5.
HASH_MOD = 1 << 48


def hash_bits(key, salt=0) -> Column:
    """A mixing hash of any key (numbers of any size, strings, null as '') and a salt:
    the first 12 hex digits of ``md5(key || ':' || salt)``, the same in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    s = salt if isinstance(salt, Column) else F.lit(salt)
    text = F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), s.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


_MD5_SHIFTS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, 0).ravel().astype(np.uint32)
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _md5_halves(words: Sequence[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of many messages of one block: 16 words, each an array (None: all zero)."""
    n = len(words[14])
    a, b, c, d = (np.full(n, v, np.uint32) for v in _MD5_START)
    f, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += _MD5_ADDED[i]
        if words[g] is not None:
            f += words[g]
        np.right_shift(f, np.uint32(32 - _MD5_SHIFTS[i]), out=low)
        f <<= _MD5_SHIFTS[i]
        f |= low
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + _MD5_START[0], b + _MD5_START[1]


def hash_numbers(keys: Sequence[bytes], salts: Sequence[bytes]) -> np.ndarray:
    """``hash_bits`` of every key (its UTF-8 text) with every salt, as a matrix of keys x salts."""
    out, size = np.empty((len(keys), len(salts)), np.int64), np.array([len(k) for k in keys])
    longest = max(map(len, salts))
    # the salt with what comes before and after it, one row each
    tails = np.zeros((len(salts), longest + 2), np.uint8)
    for row, salt in zip(tails, salts):
        row[:len(salt) + 2] = np.frombuffer(b":" + salt + b"\x80", np.uint8)
    lengths = np.array([len(s) + 1 for s in salts], np.uint32)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        if n + longest + 1 > 55:  # more than one block
            for k in own:
                out[k] = [int.from_bytes(hashlib.md5(keys[k] + b":" + s).digest()[:6], "big") for s in salts]
            continue
        used = -(-(n + longest + 2) // 4)
        text = np.zeros((len(own), len(salts), used * 4), np.uint8)
        if n:
            text[:, :, :n] = np.frombuffer(b"".join(keys[k] for k in own), np.uint8).reshape(len(own), 1, n)
        text[:, :, n:n + longest + 2] = tails
        block = text.reshape(-1, used * 4).view("<u4")
        words = [np.ascontiguousarray(block[:, i]) if i < used else None for i in range(16)]
        words[14] = np.tile((lengths + np.uint32(n)) * np.uint32(8), len(own))
        a, b = _md5_halves(words)
        out[own] = ((a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> np.uint32(16))).reshape(len(own), -1)
    return out


def hash_sql(key: str, salt: int = 0) -> str:
    """``hash_bits`` as DuckDB SQL."""
    return f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '') || ':{salt}'), 1, 12) AS BIGINT)"


def hash_bucket(key, buckets: int = 100) -> Column:
    return hash_bits(key) % buckets


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, name: str = "split") -> DataFrame:
    """``test`` when the hash bucket (of a million) is below that share of them."""
    cut = int(round(test_fraction * 1_000_000))
    return df.withColumn(name, F.when(hash_bucket(key, 1_000_000) < cut, F.lit("test")).otherwise(F.lit("train")))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows first in hash order (ties by key): a distributed top-n."""
    return df.orderBy(hash_bits(key), F.col(key)).limit(n)


def stratified_folds(df: DataFrame, label_col: str, order_col: str, k: int = 5, name: str = "fold") -> DataFrame:
    """k stratified folds without shuffling: each class is cut in row order into k
    blocks, the first ``n mod k`` one row larger."""
    return ntile_folds(df, order_col, k, [label_col], name=name)


def fold_train_test(df: DataFrame, fold_col: str, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def train_class_weights(df: DataFrame, fold_col: str = "fold", label_col: str = "label") -> DataFrame:
    """negatives / positives of the training part of every fold."""
    from pyspark.sql import Window
    per = df.groupBy(fold_col).agg(F.sum(1 - F.col(label_col)).alias("neg"), F.sum(label_col).alias("pos"))
    w = Window.partitionBy()
    per = per.withColumn("tneg", F.sum("neg").over(w)).withColumn("tpos", F.sum("pos").over(w))
    return per.select(fold_col, (F.col("tneg") - F.col("neg")).cast("long").alias("n_neg"),
                      (F.col("tpos") - F.col("pos")).cast("long").alias("n_pos"),
                      F.try_divide((F.col("tneg") - F.col("neg")).cast("double"),
                                   (F.col("tpos") - F.col("pos")).cast("double")).alias("class_weight"))


def hash_fraction(df: DataFrame, key: str, fraction: float, salt: int = 0) -> DataFrame:
    """A repeatable fraction of the rows: those whose salted hash bucket (of
    a million) falls below that share of them.  Unlike ``df.sample`` it does not
    change with the partition layout, so a task retry keeps the same rows."""
    cut = int(round(fraction * 1_000_000))
    return df.where(hash_bits(key, salt) % 1_000_000 < cut)
