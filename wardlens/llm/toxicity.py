"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 6, with word ends marked) of its lower-cased words,
hashed to ``BUCKETS``.  From a sample of labelled rows (at most ``SAMPLE[label]`` of each label, by hash
order of doc_id) the log-count ratio of every feature is taken, and a logistic regression is fitted on the
features scaled by those ratios.  Every whole text is scored.

Defined cases: null text is an empty one, scored by the intercept; a document labelled more than once takes the
larger label; null labels are not used; without labels of both kinds the score is the smoothed share of toxic
labels; repeated rows are scored each; empty input gives no row; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import chunks, column, ragged, rows, splitmix, stored

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
#: Most labelled rows of each label that a model is fitted on.
SAMPLE = {0: 4000, 1: 2000}
#: Features in fewer sampled documents are not used.
MIN_DOCS = 3
#: Features with a smaller log-count ratio than this, either way, are not used.
MIN_RATIO = 2.0
THRESHOLD = 0.7
#: Words whose features a task remembers at most; bytes of text whose features it has at a time.
MAX_WORDS = 100_000
TEXT_BYTES = 500_000

_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


class Features:
    """Distinct feature numbers of texts; ``renumber`` maps buckets to the features in use (-1: none)."""

    def __init__(self, renumber: np.ndarray | None = None):
        self.renumber = renumber
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Features of new words, all at once: a hash of every run of 3 to 6 characters of " word "."""
        text = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        grams, owners = [], []
        for n in ORDERS:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint64)
            for k in range(n):
                h = splitmix(h ^ text[k:len(text) - n + 1 + k])
            inside = owner[:len(h)] == owner[n - 1:]
            grams.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[:len(h)][inside])
        gram = np.concatenate([*grams, np.zeros(0, np.int32)])
        own = np.concatenate([*owners, np.zeros(0, np.int64)])
        if self.renumber is not None:
            gram = self.renumber[gram]
            gram, own = gram[gram >= 0], own[gram >= 0]
        order = np.argsort(own, kind="stable")
        lens = np.bincount(own, minlength=len(words))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, gram[order]])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(text number, feature)`` pairs, each once, by text."""
        if len(self.numbers) > MAX_WORDS:
            self.reset()
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        unique, new = np.zeros(len(coded.dictionary), np.int64), []
        for i, w in enumerate(coded.dictionary.to_pylist()):
            if (n := self.numbers.get(w)) is None:
                n = self.numbers[w] = len(self.numbers)
                new.append(w)
            unique[i] = n
        if new:
            self._learn(new)
        offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        # a word counts once in a text, before its features are laid out
        pair = np.unique(text * len(unique) + coded.indices.to_numpy())
        text, word = np.divmod(pair, max(1, len(unique)))
        number = unique[word] if len(unique) else word
        lens = self.lens[number]
        feature = self.flat[ragged(self.starts[number], lens)].astype(np.int64)
        both = np.unique(np.repeat(text, lens) << 20 | feature)
        return both >> 20, both & (BUCKETS - 1)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, renumber: np.ndarray):
        self.weights, self.bias, self.renumber = weights, bias, renumber

    def scores(self, features: Features, texts: pa.Array) -> np.ndarray:
        text, feature = features.of(texts)
        z = self.bias + np.bincount(text, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ratios(positive: float, total: float, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log-count ratios of features held by ``p`` toxic and ``q`` other documents of ``total``."""
    return np.log((p + 1) / (positive + 2)) - np.log((q + 1) / (total - positive + 2))


def fit(sample: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the features scaled by their ratios (full batches, Adam, both
    labels with equal weight in total); the documents hold numbers of the features in use."""
    positive = float((labels == 1).sum())
    feature, doc = np.concatenate(sample), np.repeat(np.arange(len(sample)), [len(x) for x in sample])
    values = ratio[feature]
    balance = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive))
    weight, bias = np.zeros(len(ratio)), 0.0
    moments = [np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)]
    for step in range(1, rounds + 1):
        z = bias + np.bincount(doc, values * weight[feature], len(sample))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * balance
        grad = np.append(np.bincount(feature, values * error[doc], len(ratio)) + penalty * weight, error.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad ** 2
        move = 0.01 * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight * ratio, float(bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on at most ``sample[label]`` labelled documents of each label that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_label")) \
        .where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("doc_id").cast("long"))) \
        .groupBy("doc_id").agg(F.max("_label").alias("_label"))
    picked = None
    for label, most in sample.items():
        # a sort with a limit keeps `most` rows of each task; the result is at most that many rows
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        schema = pa.schema([("label", pa.int32()), ("grams", pa.binary())])
        for part in chunks(batches, chars=TEXT_BYTES):
            text, feature = features.of(column(part, "text"))
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield rows(schema, column(part, "_label"),
                       [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, grams in zip(column(batch, "label").to_pylist(), column(batch, "grams").to_pylist()):
                held[label][np.frombuffer(grams, "<u4")] += 1
        found = np.flatnonzero(held.sum(0))
        yield rows(pa.schema([("feature", pa.int32()), ("p", pa.int64()), ("q", pa.int64())]), found, held[1][found], held[0][found])

    # ids that occur more than once give one row each: the first text by hash
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id") \
        .groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("_label", "text")
    sample_grams = stored(chosen.mapInArrow(extract, "label int, grams binary"), "grams")
    of = {r["label"]: r["n"] for r in sample_grams.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.full(BUCKETS, -1, np.int32)
    if len(of) < 2:
        share = (of.get(1, 0) + 1) / (sum(of.values()) + 2)
        return Model(np.zeros(1), float(np.log(share / (1 - share))), none)
    # counts of the features stay with the tasks; those in use come here, at most one row a bucket
    used = sample_grams.mapInArrow(count, "feature int, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")) \
        .where(F.col("p") + F.col("q") >= MIN_DOCS)
    positive, total = float(of[1]), float(sum(of.values()))
    log_ratio = F.log((F.col("p") + 1) / F.lit(positive + 2)) - F.log((F.col("q") + 1) / F.lit(total - positive + 2))
    used = used.where(F.abs(log_ratio) >= MIN_RATIO).toArrow().combine_chunks()
    order = np.argsort(used["feature"].to_numpy())
    none[used["feature"].to_numpy()[order]] = np.arange(len(order))
    ratio = ratios(positive, total, used["p"].to_numpy()[order], used["q"].to_numpy()[order])
    shared = docs.sparkSession.sparkContext.broadcast(none)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value[np.frombuffer(g, "<u4")] for g in column(batch, "grams").to_pylist()]
            yield rows(pa.schema([("label", pa.int32()), ("grams", pa.binary())]), column(batch, "label"), [x[x >= 0].tobytes() for x in own])
    got = sample_grams.mapInArrow(keep, "label int, grams binary").toArrow()
    weights, bias = fit([np.frombuffer(b.as_buffer(), np.int32) for b in got["grams"]], got["label"].to_numpy().astype(np.float64), ratio)
    return Model(weights, bias, none)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.renumber))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        features = Features(own.renumber)
        for part in chunks(batches, chars=TEXT_BYTES):
            yield rows(_SCORED, column(part, "doc_id"), own.scores(features, column(part, "text")))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, train(docs, labels)) \
        .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((lambda m: (m.weights, m.bias, m.renumber))(train(docs, labels)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        features = Features(own.renumber)
        for part in chunks(batches, chars=TEXT_BYTES):
            yield part.filter(pa.array(own.scores(features, column(part, "text")) < threshold))
    return docs.mapInArrow(run, docs.schema)
