"""Conversation structure repair: a cost DP, then the least audit by prefix-doubling path ranking.

Rows are damaged by a hash of (conv_id, turn).  A conversation is read by turn (nulls first, ties by role, then by a hash
of the content); equal rows of one turn are one entry with a number of copies.  Edits keep a row, give it another
role, delete it or insert an empty one, so that the roles read ``(s?(ua)+)?``.  Four states tell what may follow:
nothing yet, after a system row, after a user row, after an assistant row.

The DP gives every node (entry, state) its cheapest cost to the end.  The arcs that attain it are the optimal ones.  Nodes
are ranked by the first 1, 2, 4, ... letters of their least audit, each time by the pair (own rank, rank behind the doubled
pointer), and the arc with the least (letter, rank of its end) is taken; the path is read off through the doubled
pointers, all its steps at once.

Rows are range partitioned and sorted; a task cuts a conversation into segments of bounded size.  A conversation inside
one segment is finished where it is read.  Of the others every segment gives a 4 x 4 cost table, the tables are combined
to the end of the conversation by doubling (joins of segment i with i + 2^k), and in the same way the states at
the segments' starts from its beginning; then all segments are repaired side by side.  Only the text for a
conversation's SHA-256, which is sequential, streams through one task in order, a segment at a time.

Defined cases: null conv_id, turn, role and text are one space in the damage hash, and null role and text are damaged and
repaired as one space; rows with null conv_id are one conversation; an empty role has no initial and cannot be kept;
repeated rows are rows; conversations whose rows are all dropped are returned; null turns do not count in gaps; empty
input gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardlens.llm.common import column, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Entries and bytes of a segment at most (a single entry may be larger); entries that are repaired together.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 2_000_000
TOGETHER = 16_384
BLANKS = " \t\n\x0b\x0c\r"
FAR = np.int64(1) << 50

#: States: nothing yet, after system, after user, after assistant; the state behind an inserted or changed row.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = np.array([USER, USER, ASSISTANT, USER])
#: Least cost from each state to each by insertions alone, and to the end.
INSERTIONS = np.array([[0, FAR, INSERT, 2 * INSERT], [FAR, 0, INSERT, 2 * INSERT], [FAR, FAR, 0, INSERT], [FAR, FAR, INSERT, 0]])
END = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = np.frombuffer(b"DIKR", np.uint8)
INITIALS = {"u": 1, "a": 2, "s": 3}
#: State behind a kept row by (initial, state); -1: not legal.
KEPT = np.array([[-1, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [SYSTEM, -1, -1, -1]])


def _entry_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code (initial, must go, truncated): cost of keeping and of changing from each state, and the state behind."""
    keep, change = np.full((16, 4), FAR), np.full((16, 4), FAR)
    for code in range(16):
        initial, gone, cut = code >> 2, code >> 1 & 1, code & 1
        if not gone:
            keep[code] = np.where(KEPT[initial] >= 0, KEEP + TRUNCATED * cut, FAR)
            change[code] = REROLE + TRUNCATED * cut
    return keep, change


KEEP_COST, CHANGE_COST = _entry_tables()


def costs(codes: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Cheapest cost from every entry and state on: ``(segments, entries + 1, 4, exits)``.

    ``codes`` is ``(segments, entries)`` with -1 behind a segment's last one, ``exits`` ``(segments, 4, exits)``."""
    out = np.empty((codes.shape[0], codes.shape[1] + 1, 4, exits.shape[2]), np.int64)
    out[:, -1] = exits
    for i in range(codes.shape[1] - 1, -1, -1):
        code, then = codes[:, i], out[:, i + 1]
        best = DELETE + then
        kept = np.maximum(KEPT[code >> 2], 0)
        best = np.minimum(best, KEEP_COST[code][:, :, None] + np.take_along_axis(then, kept[:, :, None], 1))
        best = np.minimum(best, CHANGE_COST[code][:, :, None] + then[:, AFTER])
        best = (INSERTIONS[None, :, :, None] + best[:, None]).min(2)
        out[:, i] = np.where((code < 0)[:, None, None], then, np.minimum(best, FAR))
    return out


def least_paths(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray, last: np.ndarray, entry: np.ndarray):
    """``(segment, letter, entry, state behind)`` of every step of each segment's least optimal path from state
    ``entry``, in order, and the state in which it ends.  ``values`` are ``costs`` for one exit."""
    n, width = codes.shape
    seg, at, state = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(width + 1), np.arange(4), indexing="ij"))
    node = np.arange(len(seg))
    value = values.ravel()
    inside = at < sizes[seg]
    code = np.where(inside, codes[seg, np.minimum(at, width - 1)], 0) if width else np.zeros(len(seg), np.int64)
    ahead = np.minimum(node + 4 - state, len(node) - 4)  # state 0 of the next entry
    may_insert = inside | ((at == sizes[seg]) & last[seg])
    arcs = []
    for letter, cost, end, real in (
            (1, np.full(len(node), INSERT), node - state + AFTER[state], may_insert),
            (0, np.full(len(node), DELETE), ahead + state, inside),
            (2, KEEP_COST[code, state], ahead + np.maximum(KEPT[code >> 2, state], 0), inside),
            (3, CHANGE_COST[code, state], ahead + AFTER[state], inside)):
        optimal = np.flatnonzero(real & (value < FAR) & (cost + value[end] == value))
        arcs.append((optimal, np.full(len(optimal), letter), end[optimal]))
    source, letter, target = (np.concatenate(x) for x in zip(*arcs))
    # ranks by the first 1, 2, 4, ... letters of the least audit; 0: the path ends
    rank = np.zeros(len(node), np.int64)
    order = np.lexsort((letter, source))[::-1]
    pointer = node.copy()
    pointer[source[order]] = target[order]      # of a node's optimal arcs the least letter is written last
    rank[source[order]] = letter[order] + 1
    steps = (rank > 0).astype(np.int64)
    doubled, length = [pointer], steps
    while True:
        jump = doubled[-1]
        if not steps[jump].any() or (jump == jump[jump]).all():
            break
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        doubled.append(jump[jump])
    # the arc with the least letter and then the least rank behind it
    order = np.lexsort((rank[target], letter, source))
    first = order[np.flatnonzero(np.diff(source[order], prepend=-1))]
    chosen, end_of = np.zeros(len(node), np.int64), node.copy()
    chosen[source[first]], end_of[source[first]] = letter[first], target[first]
    begin = np.arange(n) * 4 * (width + 1) + entry
    many = length[begin]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    here = np.repeat(begin, many)
    for k, jump in enumerate(doubled):
        here = np.where(step >> k & 1, jump[here], here)
    final = begin
    for k, jump in enumerate(doubled):
        final = np.where(many >> k & 1, jump[final], final)
    return seg[here], chosen[here], at[here], end_of[here] % 4, final % 4


class Segment:
    """A run of entries of one conversation and what its rows amount to."""

    def __init__(self, conv, first: bool):
        self.conv, self.first, self.last = conv, first, False
        self.roles, self.texts, self.copies, self.codes = [], [], [], []
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.extra = 0
        self.low = self.high = None
        self.head = self.tail = ""

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        bare = text.rstrip(BLANKS)
        initial = role[:1]
        cut = 0
        if not bare:
            self.blank += copies
        elif again:
            self.duplicate += copies
        else:
            self.duplicate += copies - 1
            cut = int(bare[-1] not in ".!?")
            self.truncated += cut
        if self.roles:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        else:
            self.head = initial
        self.illegal += copies - 1
        self.tail = initial
        self.extra += DELETE * (copies - 1)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.codes.append(INITIALS.get(initial, 0) << 2 | (not bare or again) << 1 | cut)
        self.bytes += len(text) + len(role)

    def facts(self) -> dict:
        return {"entries": len(self.roles)} | {k: getattr(self, k) for k in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "extra", "head", "tail")}


def _padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in codes], np.int64)
    out = np.full((len(codes), int(sizes.max()) if len(codes) else 0), -1, np.int64)
    for row, c in zip(out, codes):
        row[:len(c)] = c
    return out, sizes


def _alike(sizes: list[int]) -> Iterator[list[int]]:
    """Places of segments of like size, so that padding stays small."""
    groups: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        groups.setdefault(n.bit_length(), []).append(i)
    for found in groups.values():
        step = max(1, TOGETHER // max(1, max(sizes[i] for i in found)))
        for low in range(0, len(found), step):
            yield found[low:low + step]


def repaired(codes: list[np.ndarray], copies: list, roles: list, texts: list, exits: np.ndarray, last: np.ndarray,
             entry: np.ndarray) -> list[tuple[int, str, list[str], int]]:
    """Of every segment: cost of its path, its audit, its repaired lines and the state behind it."""
    out: list = [None] * len(codes)
    for own in _alike([len(c) for c in codes]):
        held, sizes = _padded([codes[i] for i in own])
        values = costs(held, exits[own][:, :, None])[..., 0]
        seg, letter, at, behind, final = least_paths(held, sizes, values, last[own], entry[own])
        audits, lines = [[] for _ in own], [[] for _ in own]
        for s, kind, i, state in zip(seg.tolist(), letter.tolist(), at.tolist(), behind.tolist()):
            k = own[s]
            if kind == 1:
                audits[s].append("I")
                lines[s].append("user:" if state == USER else "assistant:")
                continue
            audits[s].append("DIKR"[kind] + "D" * (copies[k][i] - 1))
            if kind == 2:
                lines[s].append(f"{roles[k][i]}:{texts[k][i]}")
            elif kind == 3:
                lines[s].append(f"{'user' if state == USER else 'assistant'}:{texts[k][i]}")
        spent = values[np.arange(len(own)), 0, entry[own]] - exits[own][np.arange(len(own)), final]
        for s, k in enumerate(own):
            out[k] = int(spent[s]), "".join(audits[s]), lines[s], int(final[s])
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the damaged rows, equal ones once with their number; a row without copies
    for each conversation that lost a row."""
    c = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name.cast("binary")) % 20
    gone = F.col("fate") == 0
    return c.withColumn("fate", fate).select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("fate") == 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies")) \
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def entries(conversations: DataFrame) -> DataFrame:
    """The damaged rows with ``again`` (role and text were seen in an earlier turn), range partitioned and sorted."""
    rows_ = damaged(conversations)
    plain = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.md5(F.concat(F.col("conv_id").isNull().cast("string"), F.length(plain).cast("string"), F.lit(":"), plain,
                          F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows_ = rows_.withColumn("said", said).withColumn("when", F.struct(F.col("turn").isNotNull(), "turn"))
    # only content that was said more than once is looked up: the first turn of each
    first = rows_.where("copies > 0").groupBy("said").agg(F.min("when").alias("first"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["conv_id", "turn", "role", "said"]
    return rows_.join(first, "said", "left").withColumn("again", F.coalesce(F.col("when") > F.col("first"), F.lit(False))) \
        .select("conv_id", "turn", "role", "text", "copies", "again", "said") \
        .repartitionByRange(n, *by).sortWithinPartitions(*by).drop("said")


_FACTS = [("entries", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
          ("truncated", pa.int64()), ("illegal", pa.int64()), ("extra", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
           ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_FACTS_DDL = "entries long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, extra long, head string, tail string"


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def segments(rows_: DataFrame, kind: pa.DataType, ddl: str) -> DataFrame:
    """Finished conversations (``done``) and the segments of those that may go on in another task."""
    schema = pa.schema([("conv_id", kind), ("done", pa.bool_()), ("part", pa.int32()), ("seg", pa.int64()), *_FACTS, ("cost", pa.int64()),
                        ("audit", pa.string()), ("sha", pa.string()), ("table", pa.binary()), ("codes", pa.binary()),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        ready: list[Segment] = []
        current: Segment | None = None

        def made() -> pa.RecordBatch:
            nonlocal number
            done = [s for s in ready if s.first and s.last]
            codes = [np.array(s.codes, np.int64) for s in done]
            paths = repaired(codes, [s.copies for s in done], [s.roles for s in done], [s.texts for s in done],
                             np.tile(END, (len(done), 1)), np.ones(len(done), bool), np.zeros(len(done), np.int64))
            out = [{"conv_id": s.conv, "done": True, "part": part, **s.facts(), "cost": p[0] + s.extra, "audit": p[1],
                    "sha": hashlib.sha256("\n".join(p[2]).encode("utf-8", "surrogatepass")).hexdigest()} for s, p in zip(done, paths)]
            for s in ready:
                if not (s.first and s.last):
                    held, _ = _padded([np.array(s.codes, np.int64)])
                    exits = np.where(np.eye(4, dtype=bool), np.int64(0), FAR)[None]
                    out.append({"conv_id": s.conv, "done": False, "part": part, "seg": number, **s.facts(),
                                "table": costs(held, exits)[0, 0].tobytes(), "codes": bytes(s.codes), "roles": s.roles, "texts": s.texts, "copies": s.copies})
                    number += 1
            ready.clear()
            return pa.RecordBatch.from_pylist(out, schema=schema)

        opened = False
        for batch in batches:
            for conv, turn, role, text, copies, again in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again"))):
                if current is None or conv != current.conv or (conv is None) != (current.conv is None):
                    if current is not None:
                        # the first conversation of a task may have begun in the task before
                        current.last = True
                        ready.append(current)
                    current = Segment(conv, opened)
                    opened = True
                elif len(current.roles) >= SEGMENT_ROWS or current.bytes >= SEGMENT_BYTES:
                    ready.append(current)
                    current = Segment(conv, False)
                if copies:
                    current.add(turn, role, text, copies, again)
            if sum(len(s.roles) for s in ready) >= TOGETHER or sum(s.bytes for s in ready) >= SEGMENT_BYTES:
                yield made()
        if current is not None:
            ready.append(current)
        if ready:
            yield made()

    return rows_.mapInArrow(run, f"conv_id {ddl}, done boolean, part int, seg long, {_FACTS_DDL}, cost long, audit string, sha string, "
                                 "table binary, codes binary, roles array<string>, texts array<string>, copies array<long>")


def _doubled(df: DataFrame, payload: str, combine, forward: bool, name: str) -> DataFrame:
    """``df(i, conv_id, payload)`` with each payload combined with those of all later (earlier) segments of its
    conversation: ranges of 1, 2, 4, ... segments are joined until no range grows."""
    step, sign = 1, 1 if forward else -1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, more = column(batch, payload).to_pylist(), column(batch, "more").to_pylist()
            new = [a if b is None else combine(a, b) for a, b in zip(own, more)]
            at = batch.schema.get_field_index(payload)
            yield batch.set_column(at, payload, pa.array(new, pa.binary())).drop_columns(["more"])

    df = stored(df, name)
    while True:
        other = df.select((F.col("i") - sign * step).alias("i"), F.col("conv_id").alias("_conv"), F.col(payload).alias("more"))
        joined = df.join(other, (df["i"] == other["i"]) & df["conv_id"].eqNullSafe(other["_conv"]), "left").select(df["i"], df["conv_id"], df[payload], "more")
        joined = stored(joined, name)
        if joined.where(F.col("more").isNotNull()).isEmpty():
            return df
        df = stored(joined.mapInArrow(run, df.schema), name)
        step *= 2


def _times(a: bytes, b: bytes) -> bytes:
    x, y = (np.frombuffer(v, np.int64).reshape(4, 4) for v in (a, b))
    return np.minimum((x[:, :, None] + y[None]).min(1), FAR).tobytes()


def _then(late: bytes, early: bytes) -> bytes:
    return bytes(late[s] for s in early)


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    spark = conversations.sparkSession
    field = conversations.schema["conv_id"].dataType
    kind, ddl = to_arrow_type(field), field.simpleString()
    found = stored(segments(entries(conversations), kind, ddl), "segments")
    result = pa.schema([("conv_id", kind), *_RESULT])
    result_ddl = f"conv_id {ddl}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    done = found.where("done").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))

    # one row a task: where its open segments begin among all
    counts = {r["part"]: r["n"] for r in found.where("NOT done").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return done
    begins, total = [], 0
    for part in sorted(counts):
        begins.append((part, total))
        total += counts[part]
    offsets = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))
    opened = stored(found.where("NOT done").join(offsets, "part").withColumn("i", F.col("begin") + F.col("seg")).drop("done", "part", "seg", "begin", "cost", "audit", "sha"), "open")

    # costs from each segment's start to the end of its conversation; the exit costs are those of the next one
    onward = _doubled(opened.select("i", "conv_id", F.col("table").alias("costs")), "costs", _times, True, "costs")
    after = onward.select((F.col("i") - 1).alias("i"), F.col("conv_id").alias("_conv"), F.col("costs").alias("exit"))
    slim = opened.select("i", "conv_id", "codes")
    faced = stored(slim.join(after, (slim["i"] == after["i"]) & slim["conv_id"].eqNullSafe(after["_conv"]), "left")
                   .select(slim["i"], slim["conv_id"], "codes", "exit"), "faced")

    def exit_costs(cells: list) -> np.ndarray:
        return np.array([END if e is None else np.minimum((np.frombuffer(e, np.int64).reshape(4, 4) + END).min(1), FAR) for e in cells]).reshape(-1, 4)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state behind each segment's least path, for every state before it."""
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8).astype(np.int64) for c in column(batch, "codes").to_pylist()]
            exits, last = exit_costs(column(batch, "exit").to_pylist()), column(batch, "exit").is_null().to_numpy(zero_copy_only=False)
            states = np.zeros((len(codes), 4), np.uint8)
            for own in _alike([len(c) for c in codes]):
                held, sizes = _padded([codes[i] for i in own])
                values = costs(held, exits[own][:, :, None])[..., 0]
                for entry in range(4):
                    states[own, entry] = least_paths(held, sizes, values, last[own], np.full(len(own), entry))[4]
            yield pa.record_batch({"i": column(batch, "i"), "conv_id": column(batch, "conv_id"), "states": pa.array([s.tobytes() for s in states], pa.binary())})

    passed = _doubled(faced.mapInArrow(walk, f"i long, conv_id {ddl}, states binary"), "states", _then, False, "states")
    before = passed.select((F.col("i") + 1).alias("i"), F.col("conv_id").alias("_conv"), "states")
    entered = faced.join(before, (faced["i"] == before["i"]) & faced["conv_id"].eqNullSafe(before["_conv"]), "left") \
        .select(faced["i"], "exit", F.col("states").alias("entry"))

    def mend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8).astype(np.int64) for c in column(batch, "codes").to_pylist()]
            entry = np.array([0 if s is None else s[0] for s in column(batch, "entry").to_pylist()], np.int64)
            paths = repaired(codes, column(batch, "copies").to_pylist(), column(batch, "roles").to_pylist(), column(batch, "texts").to_pylist(),
                             exit_costs(column(batch, "exit").to_pylist()), column(batch, "exit").is_null().to_numpy(zero_copy_only=False), entry)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "conv_id"), column(batch, "i"), *[column(batch, f) for f, _ in _FACTS], pa.array([p[0] for p in paths], pa.int64()),
                 pa.array([p[1] for p in paths], pa.string()), pa.array(["\n".join(p[2]) for p in paths], pa.string()), pa.array([bool(p[2]) for p in paths])],
                schema=pa.schema([("conv_id", kind), ("i", pa.int64()), *_FACTS, ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.string()), ("some", pa.bool_())]))

    mended = opened.join(entered, "i").mapInArrow(mend, f"conv_id {ddl}, i long, {_FACTS_DDL}, cost long, audit string, lines string, some boolean")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**held, "gaps": _gaps(held["low"], held["high"], held["turns"]), "audit": "".join(held["audits"]),
                                                "repaired_sha256": held["sha"].hexdigest()}], schema=result)
        for batch in batches:
            for r in (x for low in range(0, batch.num_rows, 8) for x in batch.slice(low, 8).to_pylist()):
                if held is None or r["conv_id"] != held["conv_id"] or (r["conv_id"] is None) != (held["conv_id"] is None):
                    if held is not None:
                        yield row()
                    held = {"conv_id": r["conv_id"], "audits": [], "sha": hashlib.sha256(), "some": False, "low": None, "high": None, "tail": None,
                            **dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)}
                for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    held[k] += r[k]
                held["cost"] += r["cost"] + r["extra"]
                if r["entries"]:
                    held["illegal"] += held["tail"] is not None and held["tail"] + r["head"] not in ("su", "ua", "au")
                    held["tail"] = r["tail"]
                if r["low"] is not None:
                    held["turns"] -= r["low"] == held["high"]  # a turn on both sides of a cut
                    held["low"], held["high"] = r["low"] if held["low"] is None else held["low"], r["high"]
                held["audits"].append(r["audit"])
                if r["some"]:
                    held["sha"].update((("\n" if held["some"] else "") + r["lines"]).encode("utf-8", "surrogatepass"))
                    held["some"] = True
        if held is not None:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = mended.repartition(n, "conv_id").sortWithinPartitions("conv_id", "i").mapInArrow(merge, result_ddl)
    return done.unionByName(merged)
