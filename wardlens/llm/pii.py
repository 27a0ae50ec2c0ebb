"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

The base kinds are patterns: email, ip, card and phone.  A found value is a protected entity.  Over all
documents, n_e documents hold entity e, n_t hold term t and n_et both; of N documents

    information(e) = ln(N / n_e)        pmi(e, t) = ln(N * n_et / (n_e * n_t))

``pmi / information`` is the share of the entity's information that the term gives away.  In documents that hold
e, terms with a share of ``REMOVE`` or more are removed, those with ``GENERALIZE`` or more are generalised to what
kind of term they are.  A share needs ``MIN_SUPPORT`` documents with both, else it is chance.  Documents without an
entity stay as they are.

A term can reach the share only if n_t <= n_e ** a * N ** (1 - a), a = GENERALIZE (as n_et <= n_e): more frequent
terms leave the join before any pair is made, so pairs grow with the rare terms of documents with entities.

Defined cases: null text is an empty one (a null text stays null when sanitised); repeated rows are documents of
their own in the counts; null and repeated ids are allowed (a row is found by its id and text); digits are ASCII;
matches that fail their test are dropped and not retried; empty input gives no row; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardlens.llm.common import chunks, column, rows, stored

KINDS = ("email", "ip", "card", "phone")
REMOVE, GENERALIZE, MIN_SUPPORT = 1.0, 0.9, 3
#: Term counts that a task holds before it hands them on.
HELD_TERMS = 500_000

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"\w+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers of at most 255, taken in fours from each run of dotted numbers."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by kind, then start."""
    digit = any(c in text for c in "0123456789")
    return [(kind, a, b) for kind in KINDS if ("@" in text if kind == "email" else digit and (kind != "phone" or "+" in text))
            for a, b in FINDERS[kind](text)]


def written(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def entity_of(kind: str, value: str) -> int:
    """An entity's number: the value without case and, for numbers, without separators."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") >> 1


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Term number -> places of the lower-cased words outside the base spans."""
    taken = sorted((a, b) for _, a, b in spans)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out: dict[int, list[tuple[int, int]]] = {}
    for m in _TERM.finditer(text):
        i = bisect_left(starts, m.end())
        if i and merged[i - 1][1] > m.start():
            continue
        out.setdefault(term_number(m.group()), []).append(m.span())
    return out


def term_number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower()) >> 1


def row_number(doc_id: int | None, text: str) -> int:
    """Finds a row again: its id and whole text."""
    return xxhash.xxh3_64_intdigest(f"{doc_id}:{text}") >> 1


def disclosures(docs: DataFrame, remove: float = REMOVE, generalize: float = GENERALIZE) -> DataFrame:
    """``(row, terms)``: the terms to change in each row, as ``struct(term, removed)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.count()
    pair_schema = pa.schema([("row", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))])

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            out = []
            for doc, t in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist()):
                if spans := base_spans(t or ""):
                    out.append((row_number(doc, t), sorted({entity_of(k, t[a:b]) for k, a, b in spans}), sorted(terms_of(t, spans))))
            if out:
                yield rows(pair_schema, *zip(*out))

    # documents with an entity: their entities and terms; equal rows are held once with their number m
    bearing = docs.mapInArrow(held, "row long, entities array<long>, terms array<long>").groupBy("row") \
        .agg(F.count(F.lit(1)).alias("m"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    bearing = stored(bearing, "bearing")
    entities = bearing.select("m", F.explode("entities").alias("entity")).groupBy("entity") \
        .agg(F.sum("m").alias("n_e")).where(F.col("n_e") >= MIN_SUPPORT)
    entities = stored(entities, "entities")
    row_entity = stored(bearing.select("row", "m", F.explode("entities").alias("entity")).join(entities, "entity"), "row-entities")
    row_term = bearing.join(row_entity.select("row").distinct(), "row", "left_semi").select("row", F.explode("terms").alias("term"))
    wanted = row_term.select("term").distinct()

    # how many documents hold each term: counted per task, then over tasks
    count_schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_counts: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            got = rows(count_schema, [term_number(w) for w in held_counts], list(held_counts.values()))
            held_counts.clear()
            return got

        for part in chunks(batches):
            for t in column(part, "text"):
                held_counts.update({w.lower() for w in set(_TERM.findall(t.as_py() or ""))})
                if len(held_counts) > HELD_TERMS:
                    yield hand_on()
        yield hand_on()

    counted = docs.select("text").mapInArrow(count, "term long, n long").join(wanted, "term", "left_semi") \
        .groupBy("term").agg(F.sum("n").alias("n_t"))
    counted = stored(counted, "term-counts")
    # the most frequent entity bounds which terms can matter at all
    most = entities.agg(F.max("n_e")).first()[0] or 0
    rare = counted.where(F.col("n_t") <= most ** generalize * max(1, total) ** (1 - generalize))
    row_term = row_term.join(rare, "term")
    both = row_entity.join(row_term, "row") \
        .where(F.col("n_t") <= F.pow("n_e", F.lit(generalize)) * F.lit(float(max(1, total)) ** (1 - generalize)))
    both = stored(both, "pairs")
    share = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    shares = both.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("m").alias("n_et")) \
        .where((F.col("n_et") >= MIN_SUPPORT) & (F.col("n_e") < total)).withColumn("share", share) \
        .where(F.col("share") >= generalize - 1e-12).select("entity", "term", "share")
    return both.select("row", "entity", "term").join(shares, ["entity", "term"]) \
        .groupBy("row", "term").agg(F.max("share").alias("share")) \
        .groupBy("row").agg(F.collect_list(F.struct("term", (F.col("share") >= remove - 1e-12).alias("removed"))).alias("terms"))


def generalized(word: str) -> str:
    """What a term is, in place of the term."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def spans_of(text: str, terms: list[dict] | None) -> list[tuple[str, int, int]]:
    """Base spans, then those of the terms: ``term`` (removed) and ``class`` (generalised), by start."""
    base = base_spans(text)
    if not terms:
        return base
    removed = {t["term"]: t["removed"] for t in terms}
    more = [("term" if removed[k] else "class", a, b) for k, places in terms_of(text, base).items() if k in removed for a, b in places]
    return base + sorted(more, key=lambda s: (s[0] == "class", s[1]))


def sanitize(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans and terms replaced; overlapping base spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]" if kind in KINDS else "[REMOVED]" if kind == "term" else generalized(text[a:b]))
        at = b
    return "".join(out) + text[at:]


def _with_spans(docs: DataFrame, ddl, make) -> DataFrame:
    """``make(batch, texts, spans)`` for the rows of each batch; only rows with base spans are joined to their terms."""
    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = column(part, "text").to_pylist()
            bare = [not base_spans(t or "") for t in texts]
            if any(bare):
                yield make(part.filter(pa.array(bare)), [t for t, x in zip(texts, bare) if x], [[]] * sum(bare))

    numbered_schema = StructType([*docs.schema.fields, StructField("_row", LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = column(part, "text").to_pylist()
            found = [bool(base_spans(t or "")) for t in texts]
            if any(found):
                ids = [row_number(d, t) for d, t, x in zip(column(part, "doc_id").to_pylist(), texts, found) if x]
                part = part.filter(pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64())], [*part.schema.names, "_row"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts, terms = column(part, "text").to_pylist(), column(part, "_terms").to_pylist()
            yield make(part.drop_columns(["_row", "_terms"]), texts, [spans_of(t, x) for t, x in zip(texts, terms)])

    terms = disclosures(docs).select(F.col("row").alias("_row"), F.col("terms").alias("_terms"))
    bearing = docs.mapInArrow(number, numbered_schema).join(terms, "_row", "left") \
        .select(*docs.columns, "_row", "_terms").mapInArrow(joined, ddl)
    return docs.mapInArrow(plain, ddl).unionByName(bearing)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def make(part: pa.RecordBatch, texts: list, spans: list[list]) -> pa.RecordBatch:
        base = [[s for s in x if s[0] in KINDS] for x in spans]
        return rows(schema, column(part, "doc_id"), *[[sum(s[0] == k for s in x) for x in base] for k in KINDS],
                    [hashlib.sha256(written(x).encode()).hexdigest() for x in base], [written(x) for x in spans])
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), ddl, make)


def sanitized(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; ``n_chars``, if there, follows the text of changed rows."""
    def make(part: pa.RecordBatch, texts: list, spans: list[list]) -> pa.RecordBatch:
        new = [sanitize(t, x) if x else t for t, x in zip(texts, spans)]
        names = part.schema.names
        columns = {n: part.column(i) for i, n in enumerate(names)}
        columns["text"] = pa.array(new, columns["text"].type)
        if "n_chars" in columns:
            sizes = [len(t) if x else n for t, x, n in zip(new, spans, columns["n_chars"].to_pylist())]
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)
    return _with_spans(docs, docs.schema, make)
